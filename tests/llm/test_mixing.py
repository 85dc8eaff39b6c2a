from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taintlake.llm import mixing

from .helpers import documents, rows


def size(text):
    return len(text.encode().split()) if text else 0


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.integers(0, 9))
def test_permutation(n, key):
    p = mixing.Permutation(n, 5, key)
    x = np.arange(n)
    assert sorted(p(x).tolist()) == list(range(n))
    assert p.inverse(p(x)).tolist() == list(range(n))


@given(st.lists(st.integers(0, 1000), max_size=9))
def test_targets(sizes):
    want = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert all(t <= 3 * n + 1e-6 for t, n in zip(want, sizes))
    assert sum(want) == pytest.approx(sum(sizes))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), min_size=1, max_size=6), st.integers(0, 99))
def test_draws_come_out(sizes, seed):
    p = mixing.plan({f"s{i}": n for i, n in enumerate(sizes)}, block_words=16, shard_slots=20, seed=seed)
    taken, times = Counter(), Counter()
    for shard in range(p.shards):
        got = p.slots(shard)
        assert len(got[0]) == min(20, int(p.draws.sum()) - 20 * shard)
        for s, turn, block, words in zip(*(x.tolist() for x in got)):
            taken[s] += words
            times[s, turn, block] += 1
    assert all(n == 1 for n in times.values())
    assert {s: round(t) for s, t in enumerate(p.targets) if round(t)} == dict(+taken)


def test_mix_words(spark):
    got = [r.asDict() for r in mixing.mix_words(documents(spark), block_words=16, shard_slots=32).collect()]
    assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r[0], size(r[1]), r[3]) for r in rows())
    by = defaultdict(list)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by[r["source"]].append(r)
    for own in by.values():
        assert sum(r["taken"] for r in own) == round(own[0]["target"])
        assert sum(r["size"] for r in own) == own[0]["source_size"]
    again = mixing.mix_words(documents(spark), block_words=16, shard_slots=32).collect()
    assert Counter(map(tuple, again)) == Counter(tuple(r.values()) for r in got)
    assert mixing.mix_words(documents(spark, [])).collect() == []


def test_mix_as_documents_and_blocks(spark):
    docs = documents(spark, [r for r in rows() if r[0] not in (24,)])
    for name in ("uid", "passes", "ranges", "src", "_text", "c0"):  # what the operator calls its own columns
        docs = docs.withColumn(name, F.lit("x"))
    options = {"block_words": 16, "shard_slots": 32}
    words = {}
    for r in mixing.mix_words(docs, **options).collect():
        words[r.source] = words.get(r.source, 0) + r.taken
    out = mixing.mix_documents(docs, **options)
    assert out.columns == docs.columns
    have = defaultdict(int)
    known = {r[1] for r in rows()}
    whole = 0
    for r in out.collect():
        have[r.source] += size(r.text)
        whole += r.text in known
        assert r.n_chars == len(r.text) and r.uid == r.passes == r.size == "x"
    assert dict(have) == {s: n for s, n in words.items() if n} and whole
    blocks = defaultdict(int)
    for r in mixing.block_texts(mixing.Mix(docs, carry=True, **options)).collect():
        assert size(r.text) == r.words
        blocks[r.source] += r.words
    assert dict(blocks) == dict(have)


def test_draws_beyond_the_librarys_sampler():
    """Means and spreads of the law, on both sides of the library's limit of 1e9."""
    for good, bad, room in ((10, 999_999_000, 5_000_000), (600_000_000, 500_000_000, 1000), (3_000_000_000, 1_000_000_000, 3_999_999_000), (5, 2_000_000_000, 2_000_000_005), (40_000_000_000, 30_000_000_000, 35_000_000_000)):
        rng = np.random.default_rng(3)
        got = np.array([mixing._of_one_colour(rng, good, bad, room) for _ in range(2000)], dtype=float)
        whole = good + bad
        mean, var = room * good / whole, room * (good / whole) * (bad / whole) * (whole - room) / (whole - 1)
        assert max(0, room - bad) <= got.min() and got.max() <= min(good, room)
        assert abs(got.mean() - mean) <= 5 * (var / 2000) ** 0.5 + 1e-6 * max(1, mean)
        assert abs(got.var() - var) <= 0.2 * var + 0.05
    drawn = mixing._hypergeometric(np.random.default_rng(1), np.array([2_000_000_000, 3, 0, 5_000_000_000]), 4_000_000_000)
    assert drawn.sum() == 4_000_000_000 and (drawn <= [2_000_000_000, 3, 0, 5_000_000_000]).all()
