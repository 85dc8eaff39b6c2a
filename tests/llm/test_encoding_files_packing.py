import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from taintlake.llm import packing, tokenbin
from taintlake.llm.encoding import Encoder
from taintlake.llm.wavelet import WaveletMatrix, build

from .helpers import documents, rows

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["  a  \n b ", "a\n\nb", "\n\n x  y ", "a\x1c b\x1c\n c", "it's we'll  DON'T", "日本語 テスト　全角", "é ́ x", "", " ", "\t", "½² Ⅷ x²", "<|endoftext|> hi", "İstanbul ΣΑΣ", "a\x85\n b", "a \n b"]


def ints(ids):
    return np.frombuffer(ids, "<u4").tolist()


def whole(path):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path, space", [(BYTE, True), (WORD, False)])
def test_ids_are_the_librarys(path, space):
    own, ref = Encoder(path, space), whole(path)
    texts = ODD + [r[1] or "" for r in rows()]
    for text, found in zip(texts, own.encode(texts)):
        assert ints(found) == ref(text), repr(text[:50])
    assert own.encode([]) == []


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab'ÉİßΣ.,1² \t\n \x0b\x1c　日", max_size=30))
def test_ids_of_any_text(text):
    for path, space in ((BYTE, True), (WORD, False)):
        if path not in _CACHE:
            _CACHE[path] = Encoder(path, space), whole(path)
        own, ref = _CACHE[path]
        assert ints(own.encode([text])[0]) == ref(text)


@pytest.mark.parametrize("path, space", [(BYTE, True), (WORD, False)])
def test_ids_of_each_latin_letter(path, space):
    """Capitals whose lower case lies outside the Latin blocks of the fast path, too."""
    own, ref = Encoder(path, space), whole(path)
    texts = ["ƏLAVƏ MƏLUMAT", "Ɔkasa"] + [f"{c}LA{c} x{c} 1{c}" for c in map(chr, range(0xC0, 0x250))]
    wrong = [t for t, found in zip(texts, own.encode(texts)) if ints(found) != ref(t)]
    assert not wrong, (len(wrong), wrong[:30])


def test_ids_with_small_bounds(monkeypatch):
    """What a worker keeps and how much it gathers at once change nothing."""
    from taintlake.llm import encoding

    monkeypatch.setattr(encoding, "KEEP", 3)
    monkeypatch.setattr(encoding, "STEP", 4)
    for path, space in ((BYTE, True), (WORD, False)):
        own, ref = Encoder(path, space), whole(path)
        texts = ODD + [r[1] or "" for r in rows()]
        assert list(map(ints, own.encode(texts))) == [ref(t) for t in texts]
        assert sum(map(len, own.kept)) <= 3 + max(len(t) for t in texts)


_CACHE: dict = {}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=700))
def test_wavelet_matrix(values):
    tokens = np.array(values, dtype=np.uint32)
    m = WaveletMatrix(build(tokens, [1, None], np.array([len(values) // 2, len(values)]), 9))
    assert m.tokens().tolist() == values
    assert m.documents()[0] == [1, None]
    if values:
        assert m.access(np.arange(len(values))).tolist() == values
        for v in {values[0], values[-1], 299}:
            places = [i for i, x in enumerate(values) if x == v]
            assert m.count(v) == len(places)
            assert m.rank(v, len(values) // 2) == sum(p < len(values) // 2 for p in places)
            assert m.occurrences(v) == places


def test_token_files(spark):
    got = tokenbin.token_files(documents(spark), BYTE, 2, shard_tokens=5000).collect()
    ref = whole(BYTE)
    want, at = [], 0
    for doc_id, text in sorted(((r[0], r[1] or "") for r in rows()), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array(ref(text) + [2], "<u4").tobytes()
        want.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    key = lambda r: (r[1], str(r[0]))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert tokenbin.token_files(documents(spark, []), BYTE, 2).collect() == []


def test_packing(spark):
    got = packing.pack_documents(documents(spark), WORD).collect()
    ref = whole(WORD)
    want = defaultdict(int)
    for doc_id, text, *_ in rows():
        ids = np.array(ref(text or "") + [1], "<u4")
        for piece, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[doc_id, piece, at, len(own), zlib.crc32(own.tobytes())] += 1
    have = defaultdict(int)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    _sound([(r.sequence_id, r.offset, r.length) for r in got], 4096)
    assert packing.pack_documents(documents(spark, []), WORD).collect() == []


def _sound(placed, room):
    by = defaultdict(list)
    for sequence, offset, length in placed:
        by[sequence].append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= room
    return len(by)


def test_packing_in_rounds(spark):
    items = spark.range(3000).selectExpr("id uid", "cast(pmod(hash(id), 60) + 1 as bigint) length", "id node", "1 fill")
    got = packing.pack(items.drop("node", "fill"), 64, per_group=300).collect()
    used = _sound([(r.sequence_id, r.offset, r.length) for r in got], 64)
    total = sum(r.length for r in got)
    assert len(got) == 3000 and used >= total / 64
    alone = len(packing.best_fit([r.length for r in got], 64)[2])
    assert used <= 1.05 * alone


@given(st.lists(st.integers(1, 32), max_size=200))
def test_best_fit(lengths):
    bins, offsets, full = packing.best_fit(lengths, 32)
    assert _sound(list(zip(bins, offsets, lengths)), 32) == len(full)
    assert sum(f <= 16 for f in full) <= 1


def test_workers_let_go_of_what_other_stages_kept():
    """An encoder stays for tasks that need it and goes before one that does not."""
    from taintlake.llm import common, encoding

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = encoding.encoder(path, True)
    common.let_go((path, True))
    assert encoding.encoder(path, True) is own
    common.let_go(None)
    assert not common.HELD
