"""Signatures of licences, in order: label | priority | keyword | pattern.

A pattern is matched against a text's words (ASCII lower case, marks dropped, one blank
between words). The keyword is a substring that any match holds, whichever way the pattern goes; patterns whose keyword a
text lacks are not tried. A higher priority wins where detections overlap; among equals the
longer one, then the earlier rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Phrases whose labels always stand: phrase words -> label.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

_TABLE = r"""
apache-2.0|90|apache license|apache license,? version 2(?: 0)?
apache-2.0|95|apache license|licensed under the apache license version 2 0(?: the license)?
apache-2.0|90|apache 2 0|spdx license identifier apache 2 0
apache-2.0|70|apache 2|apache 2(?: 0)? licen[sc]ed?
apache-2.0|60|apache org|apache org licenses license 2 0
apache-2.0|60|asl 2|\basl 2 0\b
apache-1.1|90|apache|apache software license version 1 1
apache-1.1|80|apache 1 1|spdx license identifier apache 1 1
apache-1.0|90|apache 1 0|spdx license identifier apache 1 0
apache|40|apache|(?:the )?apache (?:software )?license
mit|90|mit license|(?:released|licensed|distributed|available|provided) under the (?:terms of the )?mit license
mit|85|identifier mit|spdx license identifier mit\b(?! 0)
mit|80|permission is hereby|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|60|opensource org|opensource org licenses mit\b
mit|55|mit licensed|\bmit licensed\b
mit|50|expat|\bexpat licen[sc]e
mit|40|mit license|(?:the )?mit license
mit-0|90|mit 0|spdx license identifier mit 0
mit-0|85|mit no attribution|mit no attribution
x11|80|x11 license|\bx11 license
x11|70|x consortium|except as contained in this notice the name of the x consortium
bsd-2-clause|95|redistribution|redistribution and use in source and binary forms(?:(?!neither the name).){0,900}this software is provided by
bsd-2-clause|90|bsd 2|spdx license identifier bsd 2 clause
bsd-2-clause|80|simplified bsd|simplified bsd license
bsd-2-clause|80|2 clause bsd|2 clause bsd
bsd-2-clause|70|freebsd license|freebsd license
bsd-3-clause|96|neither the name|neither the name of(?: the)? (?:\w+ ){1,12}nor the names of its contributors
bsd-3-clause|90|bsd 3|spdx license identifier bsd 3 clause
bsd-3-clause|80|bsd|(?:new|modified|revised|3 clause) bsd
bsd-3-clause|80|new bsd|new bsd license
bsd-3-clause|80|modified bsd|modified bsd license
bsd-4-clause|96|advertising materials|all advertising materials mentioning features or use of this software
bsd-4-clause|90|bsd 4|spdx license identifier bsd 4 clause
bsd-4-clause|80|original bsd|original bsd license
bsd-0-clause|90|0bsd|spdx license identifier 0bsd
bsd-0-clause|80|zero clause|zero clause bsd
bsd|30|bsd|bsd (?:style )?license
bsd|30|bsd style|bsd style license
gpl-3.0|95|general public license|gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?! or later)
gpl-3.0|90|gpl 3|spdx license identifier gpl 3 0(?: only)?(?! or later)
gpl-3.0|70|gplv3|\bgplv3\b
gpl-3.0|70|gpl v3|\bgpl v3\b
gpl-3.0|60|gpl 3 0|gnu org licenses gpl 3 0
gpl-3.0-or-later|97|general public license|gnu general public license (?:as published by the free software foundation )?(?:either )?version 3(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-3.0-or-later|95|gpl 3|spdx license identifier gpl 3 0 or later
gpl-3.0-or-later|75|gplv3|\bgplv3 or later
gpl-2.0|95|general public license|gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?(?! 1)
gpl-2.0|90|gpl 2|spdx license identifier gpl 2 0(?: only)?(?! or later)
gpl-2.0|70|gplv2|\bgplv2\b
gpl-2.0|70|gpl v2|\bgpl v2\b
gpl-2.0|60|gpl 2 0|gnu org licenses (?:old licenses )?gpl 2 0
gpl-2.0-or-later|97|general public license|gnu general public license (?:as published by the free software foundation )?(?:either )?version 2(?: 0)?(?: of the license)? or (?:at your option )?any later version
gpl-2.0-or-later|95|gpl 2|spdx license identifier gpl 2 0 or later
gpl-2.0-or-later|75|gplv2|\bgplv2 or later
gpl-1.0|85|general public license|gnu general public license version 1
gpl-1.0|80|gpl 1|spdx license identifier gpl 1 0
gpl|40|general public license|(?:the )?gnu general public license
gpl|30|gnu gpl|\bgnu gpl\b
gpl-classpath-exception|92|classpath|classpath exception
gpl-gcc-exception|92|runtime library exception|gcc runtime library exception
gpl-font-exception|92|font exception|gpl(?: v?\d)?(?: with)? font exception
lgpl-3.0|95|lesser general|gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 3
lgpl-3.0|90|lgpl 3|spdx license identifier lgpl 3 0
lgpl-3.0|70|lgplv3|\blgplv3\b
lgpl-2.1|95|lesser general|gnu lesser general public license (?:as published by the free software foundation )?(?:either )?version 2 1
lgpl-2.1|90|lgpl 2|spdx license identifier lgpl 2 1
lgpl-2.1|70|lgplv2|\blgplv2(?: 1)?\b
lgpl-2.0|90|library general|gnu library general public license(?: version 2)?
lgpl-2.0|80|lgpl 2 0|spdx license identifier lgpl 2 0
lgpl|45|lesser general|(?:gnu )?lesser general public license
lgpl|30|lgpl|\blgpl\b
agpl-3.0|95|affero|gnu affero general public license (?:as published by the free software foundation )?(?:either )?version 3
agpl-3.0|90|agpl 3|spdx license identifier agpl 3 0
agpl-3.0|70|agplv3|\bagplv3\b
agpl-1.0|85|affero|affero general public license version 1
agpl|45|affero|(?:gnu )?affero general public license
agpl|30|agpl|\bagpl\b
gfdl-1.3|90|free documentation|gnu free documentation license version 1 3
gfdl-1.2|90|free documentation|gnu free documentation license version 1 2
gfdl-1.1|90|free documentation|gnu free documentation license version 1 1
gfdl|45|free documentation|gnu free documentation license
gfdl|30|gfdl|\bgfdl\b
cc-by-4.0|85|cc by 4|\bcc by 4 0\b
cc-by-3.0|85|cc by 3|\bcc by 3 0\b
cc-by-2.5|85|cc by 2 5|\bcc by 2 5\b
cc-by-2.0|85|cc by 2 0|\bcc by 2 0\b
cc-by-4.0|90|attribution 4|creative commons attribution 4 0
cc-by-3.0|90|attribution 3|creative commons attribution 3 0
cc-by-4.0|80|licenses by 4|creativecommons org licenses by 4 0
cc-by-3.0|80|licenses by 3|creativecommons org licenses by 3 0
cc-by-sa-4.0|92|cc by sa 4|\bcc by sa 4 0\b
cc-by-sa-3.0|92|cc by sa 3|\bcc by sa 3 0\b
cc-by-sa-2.5|92|cc by sa 2|\bcc by sa 2 5\b
cc-by-sa-4.0|94|alike 4|creative commons attribution share ?alike 4 0
cc-by-sa-3.0|94|alike 3|creative commons attribution share ?alike 3 0
cc-by-sa-4.0|82|by sa 4|creativecommons org licenses by sa 4 0
cc-by-sa-3.0|82|by sa 3|creativecommons org licenses by sa 3 0
cc-by-sa|50|cc by sa|\bcc by sa\b
cc-by-nc-4.0|92|cc by nc 4|\bcc by nc 4 0\b
cc-by-nc-3.0|92|cc by nc 3|\bcc by nc 3 0\b
cc-by-nc-2.5|92|cc by nc 2|\bcc by nc 2 5\b
cc-by-nc-4.0|94|commercial 4|creative commons attribution non ?commercial 4 0
cc-by-nc-3.0|94|commercial 3|creative commons attribution non ?commercial 3 0
cc-by-nc-4.0|82|by nc 4|creativecommons org licenses by nc 4 0
cc-by-nc|50|cc by nc|\bcc by nc\b
cc-by-nd-4.0|92|cc by nd 4|\bcc by nd 4 0\b
cc-by-nd-3.0|92|cc by nd 3|\bcc by nd 3 0\b
cc-by-nd|50|cc by nd|\bcc by nd\b
cc-by-nd-4.0|94|deriv|creative commons attribution no ?deriv(?:ative)?s 4 0
cc-by-nc-sa-4.0|96|cc by nc sa 4|\bcc by nc sa 4 0\b
cc-by-nc-sa-3.0|96|cc by nc sa 3|\bcc by nc sa 3 0\b
cc-by-nc-sa|55|cc by nc sa|\bcc by nc sa\b
cc-by-nc-sa-4.0|96|commercial share|attribution non ?commercial share ?alike 4 0
cc-by-nc-sa-3.0|96|commercial share|attribution non ?commercial share ?alike 3 0
cc-by-nc-nd-4.0|96|cc by nc nd 4|\bcc by nc nd 4 0\b
cc-by-nc-nd-3.0|96|cc by nc nd 3|\bcc by nc nd 3 0\b
cc-by-nc-nd|55|cc by nc nd|\bcc by nc nd\b
cc-by-nc-nd-4.0|96|commercial no|attribution non ?commercial no ?deriv(?:ative)?s 4 0
cc0-1.0|90|cc0|\bcc0(?: 1 0)?\b
cc0-1.0|85|publicdomain zero|creativecommons org publicdomain zero 1 0
cc0-1.0|85|creative commons zero|creative commons zero
cc-pdm-1.0|85|publicdomain mark|creativecommons org publicdomain mark 1 0
cc-by|40|cc by|\bcc by\b
cc|20|creative commons|creative commons(?: license)?
mpl-2.0|95|mozilla public|mozilla public license(?: mpl)?(?: version| v)? 2 0
mpl-2.0|90|mpl 2|spdx license identifier mpl 2 0
mpl-2.0|60|mozilla org|mozilla org mpl 2 0
mpl-1.1|95|mozilla public|mozilla public license(?: version)? 1 1
mpl-1.1|90|mpl 1 1|spdx license identifier mpl 1 1
mpl-1.0|90|mozilla public|mozilla public license(?: version)? 1 0
mpl|40|mozilla public|mozilla public license
mpl|30|mpl 2 0|\bmpl 2 0\b
epl-2.0|95|eclipse public|eclipse public license(?: version| v)? 2 0
epl-2.0|90|epl 2|spdx license identifier epl 2 0
epl-1.0|95|eclipse public|eclipse public license(?: version| v)? 1 0
epl-1.0|90|epl 1|spdx license identifier epl 1 0
epl|40|eclipse public|eclipse public license
edl-1.0|85|eclipse distribution|eclipse distribution license
cpl-1.0|85|common public license|common public license(?: version)? 1 0
cpl-1.0|60|common public license|common public license
ipl-1.0|80|ibm public|ibm public license
cddl-1.1|92|development and distribution|common development and distribution license(?: version)? 1 1
cddl-1.0|90|development and distribution|common development and distribution license(?: cddl)?(?: version)?(?: 1 0)?
cddl-1.0|85|cddl 1 0|spdx license identifier cddl 1 0
cddl|30|cddl|\bcddl\b
isc|90|identifier isc|spdx license identifier isc\b
isc|85|isc license|\bisc license
isc|80|permission to use copy|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
unlicense|90|unlicense|(?:the|spdx license identifier) unlicense\b
unlicense|85|free and unencumbered|this is free and unencumbered software released into the public domain
unlicense|70|unlicense org|\bunlicense org\b
wtfpl|90|wtfpl|\bwtfpl\b
wtfpl|85|do what the|do what the fuck you want to public license
zlib|90|identifier zlib|spdx license identifier zlib\b
zlib|85|zlib|zlib(?: libpng)? license
zlib|80|origin of this software|the origin of this software must not be misrepresented
libpng|80|libpng|\blibpng license
boost-1.0|92|boost software|boost software license(?: version)?(?: 1 0)?
boost-1.0|90|bsl 1|spdx license identifier bsl 1 0
artistic-2.0|92|artistic license|artistic license(?: version)? 2 0
artistic-2.0|90|artistic 2|spdx license identifier artistic 2 0
artistic-1.0|90|artistic license|artistic license(?: version)? 1 0
artistic|40|artistic license|artistic license
perl|70|same terms as perl|under the same terms as perl itself
python-2.0|90|python software foundation|python software foundation license(?: version 2)?
python-2.0|85|psf license|\bpsf license
ruby|80|ruby license|\bruby license
php-3.01|90|php license|php license(?: version)? 3 01
php-3.0|85|php license|php license(?: version)?(?: 3 0)?
ofl-1.1|92|open font|sil open font license(?: version)?(?: 1 1)?
ofl-1.1|90|ofl 1|spdx license identifier ofl 1 1
odbl-1.0|90|open database license|open database license
odbl-1.0|80|odbl|\bodbl\b
odc-by-1.0|85|open data commons attribution|open data commons attribution license
odc-by-1.0|85|odc by|\bodc by(?: 1 0)?\b
pddl-1.0|85|public domain dedication|open data commons public domain dedication
cdla-permissive|85|community data license|community data license agreement permissive
cdla-sharing|85|community data license|community data license agreement sharing
ogl-uk-3.0|85|open government|open government licen[cs]e(?: version| v)? ?3
ogl-uk|50|open government|open government licen[cs]e
etalab-2.0|80|licence ouverte|licence ouverte(?: open licence)?
dl-de-by-2.0|80|datenlizenz|datenlizenz deutschland namensnennung
eupl-1.2|92|european union public|european union public licen[cs]e(?: version| v)? ?1 2
eupl-1.1|92|european union public|european union public licen[cs]e(?: version| v)? ?1 1
eupl|50|european union public|european union public licen[cs]e
eupl|30|eupl|\beupl\b
cecill-2.1|90|cecill|\bcecill 2 1\b
cecill-b|90|cecill b|\bcecill b\b
cecill-c|90|cecill c|\bcecill c\b
cecill|40|cecill|\bcecill\b
ms-pl|90|microsoft public|microsoft public license
ms-pl|85|ms pl|\bms pl\b
ms-rl|90|microsoft reciprocal|microsoft reciprocal license
afl-3.0|90|academic free|academic free license(?: version| v)? ?3 0
afl|50|academic free|academic free license
osl-3.0|90|open software license|open software license(?: version| v)? ?3 0
osl|50|open software license|open software license
ncsa|85|illinois|university of illinois ncsa open source license
ecl-2.0|85|educational community|educational community license(?: version)?(?: 2 0)?
upl-1.0|85|universal permissive|universal permissive license
postgresql|85|postgresql license|postgresql license
openssl|85|openssl license|openssl license
openssl|80|openssl project|this product includes software developed by the openssl project
curl|80|curl license|\bcurl license
w3c|80|w3c software|w3c software (?:notice|license)
unicode-dfs|80|unicode|unicode(?: inc)? license agreement data files
unicode-3.0|80|unicode license|unicode license v3
icu|75|icu license|\bicu license
ijg|75|independent jpeg|independent jpeg group
freetype|80|freetype|freetype project license
imagemagick|80|imagemagick|imagemagick license
vim|80|vim license|\bvim license
tcl|75|tcl tk license|tcl tk license
sleepycat|80|sleepycat|sleepycat license
qpl-1.0|80|q public license|\bq public license
zpl-2.1|80|zope public|zope public license(?: version)? 2 1
zpl|50|zope public|zope public license
latex-1.3c|85|latex project|latex project public license
ppl|70|peer production|peer production license
hippocratic|80|hippocratic|hippocratic license
sspl-1.0|90|server side public|server side public license
sspl-1.0|80|sspl|\bsspl\b
busl-1.1|90|business source|business source license(?: 1 1)?
elastic-2.0|90|elastic license|elastic license(?: 2 0)?
commons-clause|90|commons clause|commons clause(?: license condition)?
polyform-nc|85|polyform|polyform noncommercial license
polyform-small|85|polyform|polyform small business license
prosperity|80|prosperity public|prosperity public license
parity|80|parity public|parity public license
blueoak-1.0.0|85|blue oak|blue oak model license
mulan-psl-2.0|85|mulan|mulan (?:psl|permissive software license)
openrail|85|openrail|\bopenrail(?: m)?\b
openrail|85|responsible ai license|responsible ai license
bigscience-rail|88|bigscience|bigscience rail license
json|85|good not evil|the software shall be used for good not evil
beerware|85|beerware|\bbeerware\b
beerware|85|buy me a beer|you can buy me a beer in return
gsfdl|60|free art license|\bfree art license
cern-ohl|80|cern open hardware|cern open hardware licen[cs]e
tapr-ohl|80|tapr open hardware|tapr open hardware license
solderpad|80|solderpad|solderpad hardware license
public-domain|70|public domain|(?:released|placed|dedicated|is) (?:in|into|to) the public domain
public-domain|35|public domain|\bpublic domain\b
all-rights-reserved|25|all rights reserved|\ball rights reserved\b
proprietary|50|proprietary|proprietary and confidential
proprietary|50|unauthorized copying|unauthorized copying of this (?:file|document|work)
proprietary|45|no part of this|no part of this (?:publication|work|book) may be reproduced
non-commercial|40|non commercial use|for non commercial use only
non-commercial|40|noncommercial use|for noncommercial use only
research-only|45|research purposes|for (?:academic )?research purposes only
"""


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    keyword: bytes
    pattern: re.Pattern
    order: int


def rules() -> list[Rule]:
    out = []
    for line in filter(None, map(str.strip, _TABLE.splitlines())):
        label, priority, keyword, pattern = line.split("|", 3)
        whole = rb"(?<![^ ])" + f"(?:{pattern})".encode() + rb"(?![^ ])"
        out.append(Rule(label, int(priority), keyword.encode(), re.compile(whole), len(out)))
    return out
