"""Language ID, quality rules, licence scan and digests against brute force on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest

from taintlake.llm import digest, langid, licenses, quality
from taintlake.llm.license_rules import BASE, rules as license_rules

from .helpers import documents, prose, rows

SPACE = "[^\x20\x09-\x0d]+"


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.predict(docs, langid.fit(docs, sample_docs=100)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(got) > 200
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    for r in got[:20]:
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1


def test_language_cases(spark):
    docs = documents(spark)
    model = langid.fit(docs)
    assert model.langs == ["en", "fr"]
    by = {}
    for r in langid.predict(docs, model).collect():
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.score == 0)
        by[r.doc_id] = r.lang_pred
    assert {k for k, v in by.items() if v == "und"} == {20, 21, 28}
    none = langid.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.predict(docs, none).collect()} == {"und"}
    kept = langid.keep_known(docs, model).collect()
    assert kept and all(r.text for r in kept)


def test_numerals_are_no_letters(spark):
    docs = documents(spark)
    odd = documents(spark, [(1, "\u00bd \u00b2 \u2167 \u2460 12 _", None, "a"), (2, "\u00bd cup", None, "a"), (3, "\u00aa", None, "a"), (None, "12", None, None)])
    got = {r.doc_id: r.lang_pred for r in langid.predict(odd, langid.fit(docs)).collect()}
    assert got[1] == got[None] == "und" and got[2] in ("en", "fr") and got[3] in ("en", "fr")
    assert langid.words_of("a\u00bdb \u2167 x2y") == ["a", "b", "x", "y"]
    assert langid.predict(documents(spark, []), langid.fit(documents(spark, []))).collect() == []


def mean_log_odds(train, text, model):
    """Scores spelt out from the definition, from counts of their own."""
    import math

    counts = {lang: {n: Counter() for n in range(6)} for lang in model.langs}
    word = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    grams = lambda w, n: [(f"<{w}>" if n > 1 else w)[i : i + n] for i in range(len(w) + (2 if n > 1 else 0) - n + 1)]
    for t, lang in train:
        for w in word(t):
            if len(w) <= 40:
                counts[lang][0][w] += 1
            for n in range(1, 6):
                counts[lang][n].update(grams(w[:40], n))
    total = {lang: {n: sum(c.values()) for n, c in by.items()} for lang, by in counts.items()}
    entries = {n: {k for by in counts.values() for k in by[n] if n or sum(b[0][k] for b in counts.values()) > 1} for n in range(6)}
    log = lambda lang, n, k: math.log((counts[lang][n][k] + 0.5) / (total[lang][n] + 0.5 * (len(entries[n]) + 1)))
    out = dict.fromkeys(model.langs, 0.0)
    for w in word(text):
        for n in (0, 5, 4, 3, 2, 1):
            known = [k for k in ([w] if n == 0 else grams(w, n)) if k in entries[n] and len(k) <= 40]
            if known:
                for lang in out:
                    out[lang] += sum(log(lang, n, k) for k in known) / len(known)
                break
    return {k: v / max(1, len(word(text))) for k, v in out.items()}


def test_language_against_scores_by_hand(spark):
    docs = documents(spark)
    data = {(d, t, k) for d, t, k, _ in rows() if d is not None and t}
    train = [(t, k) for d, t, k, _ in rows() if d is not None and t is not None and k and zlib.crc32(str(d).encode()) % 3 != 1]
    model = langid.fit(docs)
    texts = ["the cat sat", "house riverside", "日本語 テスト", "xylophone goes", "é ÄÖ"] + [t for _, t, _ in sorted(data, key=str)]
    got = langid.predict(documents(spark, [(i, t, None, "a") for i, t in enumerate(texts)]), model).collect()
    for r in got:
        want = mean_log_odds(train, texts[r.doc_id], model)
        if not any(c.isalpha() for c in texts[r.doc_id]):
            continue
        best = max(want.values())
        assert want[r.lang_pred] == pytest.approx(best), texts[r.doc_id][:40]


def test_known_words_go_before_grams():
    import numpy as np

    scores = {n: np.zeros((1, 2)) for n in (0, *langid.ORDERS)}
    scores[0][0] = [-1, -2]
    scores[2][0] = [-5, -3]
    model = langid.Model(["a", "b"], {0: {"word": 0}, 5: {}, 4: {}, 3: {}, 2: {"or": 0}, 1: {}}, scores)
    assert langid.word_scores(model, "word").tolist() == [-1, -2]
    assert langid.word_scores(model, "ordx").tolist() == [-5, -3]
    assert langid.word_scores(model, "zzz").tolist() == [0, 0]


def quality_by_hand(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover), n < 10 or 100 * len(cover) > 20 * n


ODD_TEXTS = [
    "a b c d e f a b c d e g h i j",
    "x\nx\n\n \n \nx\ny",
    "# * $ % & | < > ## é 日本",
    "same line here.\nsame line here.\nsame line here.",
    " a  b\x1cc\x85d　e",
    "w " * 500,
]


def test_quality_base(spark):
    data = rows() + [(100 + i, t, "en", "a") for i, t in enumerate(ODD_TEXTS)]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.quality(documents(spark, data)).collect())
    assert got == Counter((d, *quality_by_hand(t)) for d, t, *_ in data)
    assert quality.quality(documents(spark, [])).collect() == []


def test_quality_verdict(spark):
    good = "This is a line of plain prose that ends well.\nAnd here is another one, with a mark at its end."
    menu = "Home | News | Sport | Weather | Travel | Shop | More | Help"
    loud = " ".join(w.upper() + "!!" for w in "buy this now it is the best thing that ever was sold".split())
    decorated = " ".join(f"{w}%%%" for w in "one two three four five six seven eight nine ten eleven twelve".split())
    data = [(1, good, "en", "a"), (2, menu, "en", "a"), (3, loud, "en", "a"), (4, decorated, "en", "a"), (5, f"{good}\n{menu}", "en", "a"), (6, f"{good}\nAll rights reserved.", "en", "a")]
    got = {r.doc_id: r for r in quality.quality(documents(spark, data)).collect()}
    assert {k: r.kept for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True}
    assert got[5].clean_text == got[6].clean_text == good
    kept = {r.doc_id: r for r in quality.keep_good(documents(spark, data)).collect()}
    assert set(kept) == {1, 5, 6} and kept[5].text == good and kept[5].n_chars == len(good)


@pytest.mark.parametrize(
    "line, fault",
    [
        ("BUY THIS NOW IT IS THE BEST thing", "shouting"),
        ("Buy This Now It Is The Best thing", None),
        ("dota dota que que casa casa por por la la rua rua", "open"),
        ("dota dota que que casa casa por por la la rua rua.", None),
        ("a plain line of prose that is cut off before it came to its", None),
    ],
)
def test_faults_of_lines(line, fault):
    assert quality.line_fault(line.encode(), line.encode().split()) == fault


def licence_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        own = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += own
        labels |= {label} if own else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


LICENCES = [
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("GNU General Public License version 2 or (at your option) any later version", "gpl,gpl-2.0-or-later"),
    ("the GNU Lesser General Public License version 2.1", "lgpl-2.1"),
    ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc-4.0"),
    ("CC-BY-SA 4.0", "cc-by,cc-by-sa-4.0"),
    ("mit license, MIT-License. limit license", "mit"),
    ("Mozilla Public License 2.0 and SPDX-License-Identifier: ISC", "isc,mpl-2.0"),
    ("The Unlicense; this is free and unencumbered software released into the public domain", "unlicense"),
    ("nothing of the kind", ""),
]


def test_licences(spark):
    data = rows() + [(100 + i, t, "en", "a") for i, (t, _) in enumerate(LICENCES)]
    got = licenses.scan(documents(spark, data)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == Counter((d, *licence_base(t)) for d, t, *_ in data)
    for r in got:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id >= 100:
            assert r.labels == LICENCES[r.doc_id - 100][1]


def test_rules_are_many_and_their_keywords_can_match():
    """Each literal pattern, read as a sample of itself, is found through its own keyword."""
    own = license_rules()
    assert len(own) > 200
    for rule in own:
        body = rule.pattern.pattern.decode()[len("(?<![^ ])(?:") : -len(")(?![^ ])")].replace(r"\b", "")
        if not re.search(r"[][()?+*\\{}|.]", body):
            assert rule.pattern.search(body.encode()) and rule.keyword.decode() in body, rule


def expansions(parsed):
    """Texts that a parsed pattern matches: each branch and letter, each repeat at its least and at its most (2 at most)."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [chr(arg)]
        elif name == "SUBPATTERN":
            own = expansions(arg[-1])
        elif name == "BRANCH":
            own = [x for branch in arg[1] for x in expansions(branch)]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            own = [x * n for x in expansions(arg[2]) for n in sorted({arg[0], min(arg[1], max(arg[0], 2))})]
        elif name == "IN":
            own = [chr(v) if str(k) == "LITERAL" else {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "w"}[str(v)] for k, v in arg]
        elif name == "ANY":
            own = ["w"]
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
            continue
        out = [a + b for a in out for b in own]
    return out


def test_each_expansion_of_a_pattern_has_its_keyword():
    for rule in license_rules():
        body = rule.pattern.pattern.decode()[len("(?<![^ ])") : -len("(?![^ ])")]
        for text in expansions(re._parser.parse(body)):
            assert rule.keyword.decode() in text, (rule.keyword, text)


@pytest.mark.parametrize(
    "text, label",
    [
        ("Creative Commons Attribution-Share Alike 4.0", "cc-by-sa-4.0"),
        ("Creative Commons Attribution-Non-Commercial 3.0", "cc-by-nc-3.0"),
        ("Creative Commons Attribution-No Derivatives 4.0", "cc-by-nd-4.0"),
        ("Attribution-Non-Commercial-Share Alike 4.0", "cc-by-nc-sa-4.0"),
        ("Revised BSD", "bsd-3-clause"),
        ("Apache Software License", "apache"),
        ("Unicode, Inc. License Agreement - Data Files", "unicode-dfs"),
    ],
)
def test_spellings_of_licences(text, label):
    words = " ".join(re.findall("[a-z0-9]+", text.lower())).encode()
    assert label in licenses.scan_words(words)[4].split(",")


def test_digest_properties():
    a, b = prose(400, 3).encode(), prose(400, 8).encode()
    assert digest.digest(a) == digest.digest(bytes(a)) and digest.likeness(digest.digest(a), digest.digest(a)) == 1
    near = digest.likeness(digest.digest(a), digest.digest(a[:-40] + b"some other words at the end of it all."))
    assert 0 <= digest.likeness(digest.digest(b""), digest.digest(a)) < near < 1
    long = a * 900
    assert len(long) > 1 << 20 and digest.counts(long).sum() == sum(len(long) - j for _, j, _ in digest._TRIPLETS)


@pytest.mark.parametrize("data", [rows(), rows()[:1], []])
def test_digests_of_next(spark, data):
    got = digest.with_next(documents(spark, data)).collect()
    ordered = sorted(((r[0], r[1] or "") for r in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter()
    for (d, t), (_, after) in zip(ordered, ordered[1:] + ordered[:1]):
        half = len(t) // 2
        changed = (t[: len(t) - half] + after[:half]).encode()
        f, g, h = (digest.digest(x) for x in (t.encode(), changed, after.encode()))
        want[d, len(t), hashlib.sha256(changed).hexdigest(), f.hex(), g.hex(), digest.likeness(f, g), digest.likeness(f, h)] += 1
    assert Counter(map(tuple, got)) == want


def test_many_detections_are_swept():
    """Overlaps are resolved as by looking at all that is kept."""
    import random

    from taintlake.llm.license_rules import rules as all_rules

    random.seed(4)
    parts = ["gnu general public license version 3", "gpl", "apache license version 2 0", "mit license", "creative commons attribution share alike 4 0", "cc by sa 4 0", "bsd 3 clause license", "word"]
    words = " ".join(random.choices(parts, k=400)).encode()
    by_word = licenses._compiled()[0]
    found = [(m.start(), m.end(), rule) for keyword, own in by_word.items() if keyword in words for rule in own for m in rule.pattern.finditer(words)]
    found.sort(key=lambda x: (-x[2].priority, x[0] - x[1], x[0], x[2].order))
    kept = []
    for start, end, rule in found:
        if not any(s <= start and end <= e for s, e, _ in kept):
            kept.append((start, end, rule))
    got = licenses.detections(words)
    assert got == sorted(kept, key=lambda x: (x[0], x[1])) and len(all_rules()) >= 200 and len(found) > len(got) > 100
