"""SimHash clusters, archives and the pipeline against brute force."""

import base64
import gzip
import hashlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taintlake.llm import simhash, warc

from .helpers import documents, prose, rows


def fp_by_hand(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", low)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(fps, most=3):
    """Smallest id reachable from each index; ids that are None name nothing, equal ids are one."""
    n, parent = len(fps), list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= most or (fps[i][0] is not None and fps[i][0] == fps[j][0]):
                parent[find(i)] = find(j)
    least = {}
    for i in range(n):
        if fps[i][0] is not None:
            r = find(i)
            least[r] = min(least.get(r, fps[i][0]), fps[i][0])
    return [least.get(find(i)) for i in range(n)]


def near_rows():
    base = prose(300, 11).split(" ")
    data = rows()
    for k in range(12):
        words = list(base)
        for e in range(k):
            words[(37 * e + 5) % len(words)] = f"edit{k}x{e}"
        data.append((200 + k, " ".join(words), "en", "a"))
    return data


@pytest.mark.parametrize("data", [near_rows(), [], [(None, "", "en", "a"), (5, None, "en", "a")]])
def test_components_of_documents(spark, data):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(documents(spark, data)).collect())
    fps = [(d, fp_by_hand(t)) for d, t, *_ in data]
    assert got == Counter((d, f"{fp:016x}", c) for (d, fp), c in zip(fps, groups_by_hand(fps)))


def test_every_pair_within_three_bits(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    points = set(base.tolist()) | {0, (1 << 64) - 1, 1 << 63}
    for x in base.tolist():
        for _ in range(20):
            y = x
            for b in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                y ^= 1 << b
            points.add(y)
    points = sorted(points)
    signed = [p - (1 << 64) if p >> 63 else p for p in points]
    frame = spark.createDataFrame(list(enumerate(signed)), "node bigint, fp bigint")
    got = {tuple(sorted(r)) for r in simhash.near_pairs(frame).collect()}
    want = {(i, j) for j in range(len(points)) for i in range(j) if (points[i] ^ points[j]).bit_count() <= 3}
    assert got == want and len(want) > 500


def test_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(200, 100), (100, 150), (7, 7)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 150: 100, 200: 100}


def test_equal_ids_are_one_document(spark):
    """(3, B) (5, B) (5, A) (4, A): document 5 holds both texts together; so does a document of three texts."""
    a, b, c = prose(90, 1), " ".join(f"z{i}" for i in range(90)), " ".join(f"q{i}" for i in range(90))
    data = [(3, b, "en", "a"), (5, b, "en", "a"), (5, a, "en", "a"), (4, a, "en", "a"), (9, a, "en", "a"), (9, c, "en", "a"), (9, b, "en", "a"), (8, c, "en", "a")]
    assert {r.component_id for r in simhash.near_duplicates(documents(spark, data)).collect()} == {3}
    assert [r.text for r in simhash.keep_one(documents(spark, data)).collect()] == [b]
    several = [(7, x, "en", "a") for x in (a, b, c, a)]
    kept = [simhash.keep_one(documents(spark, rows)).collect() for rows in (several, several[::-1])]
    assert [r.doc_id for r in kept[0]] == [7] and kept[0][0].text == kept[1][0].text


def test_edited_copies_are_similar(spark):
    """Copies that agree by 0.8 or more of their five-word shingles meet; unlike texts stay."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(3000)]
    unlike = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    data = [(i, t, "en", "a") for i, t in enumerate(unlike)]
    for i, t in enumerate(unlike[:15]):
        own = t.split()
        for e in range(6):
            own[int(rng.integers(len(own)))] = f"new{e}"
        data.append((100 + i, " ".join(own), "en", "a"))
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, data)).collect()}
    assert set(range(30)) <= kept and len(kept - set(range(30))) <= 1


def shingles_by_hand(text, width=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def alike_rows():
    """Copies with scattered edits and with a block added or taken away, on both sides of 0.8."""
    rng = np.random.default_rng(7)
    data = [r for r in rows() if r[0] not in (3, 24)]
    for i in range(12):
        own = [f"w{x}" for x in rng.integers(0, 3000, 200 + 20 * i)]
        n = len(own)
        edits = [own, own[: n - n // 6], own + [f"foot{i}x{x}" for x in range(n // 5)], own + [f"far{i}x{x}" for x in range(n // 3)], own[n // 8 :]]
        for e in (2, 4, 5, 6, 8, 10):
            other = list(own)
            for at in rng.choice(n, max(1, e * n // 200), replace=False):
                other[at] = f"e{i}x{e}x{at}"
            edits.append(other)
        data += [(1000 + 20 * i + k, " ".join(x), "en", "a") for k, x in enumerate(edits)]
    line = " ".join(f"common{i}" for i in range(40))
    return data + [(2000 + i, f"{line} {' '.join(f'own{i}x{k}' for k in range(30))}", "en", "a") for i in range(40)]


def test_groups_by_exact_shingles(spark):
    """Against brute force over all pairs; candidates were lost where edits are scattered or a block is added."""
    data = alike_rows()
    sets, parent = [shingles_by_hand(t) for _, t, *_ in data], list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                linked += 1
                x, y = find(i), find(j)
                parent[x] = y
    least = {}
    for i, r in enumerate(data):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    kept = simhash.keep_one(documents(spark, data)).collect()
    assert linked > 60
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(least.values())
    assert sum(r.doc_id is None for r in kept) == len({find(i) for i in range(len(data))} - set(least))


def test_texts_under_the_bound_stay(spark):
    """Few bits apart but under 0.8: not one of a chain of links is taken on the word of the bits."""
    data, want = [], set()
    for i in range(40):
        own = prose(60 + i, 3 + i).split()
        own = [f"{w}{i}x{k}" for k, w in enumerate(own)]
        for c in range(3):
            other = list(own)
            for e in range(c * 2):
                other[(17 * e + 11 * c) % len(other)] = f"edit{i}x{c}x{e}"
            data.append((10 * i + c, " ".join(other), "en", "a"))
    docs = documents(spark, data)
    sets = {d: shingles_by_hand(t) for d, t, *_ in data}
    alike = [(a, b) for a in sets for b in sets if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))]
    want = set(sets) - {b for _, b in alike}
    kept = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert want <= kept, sorted(want - kept)


def test_groups_with_small_bounds(spark, monkeypatch):
    """Salted shingles and texts of very many pairs give the same groups as unsalted ones."""
    rng = np.random.default_rng(9)
    own = [f"w{x}" for x in range(300)]
    data = [(0, " ".join(own), "en", "a")]
    for i in range(1, 60):
        other = list(own)
        for at in rng.choice(300, 4, replace=False):
            other[at] = f"e{i}x{at}"
        data.append((i, " ".join(other), "en", "a"))
    data += [(100 + i, " ".join(f"v{i}x{k}" for k in range(200)), "en", "a") for i in range(20)] + [(100 + i, " ".join(f"v{i}x{k}" for k in range(180)), "en", "a") for i in range(10)]
    want = sorted(r.doc_id for r in simhash.keep_one(documents(spark, data)).collect())
    for name, value in (("SAMPLE", 1), ("PER_SALT", 7)):
        monkeypatch.setattr(simhash, name, value)
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, data)).collect()) == want == [0, *range(100, 120)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 1), st.integers(0, 5)), max_size=40), st.integers(1, 9))
def test_meeting_in_batches(data, size):
    """Runs may be cut anywhere between batches."""
    import pyarrow as pa

    rows = sorted((t, s, n) for t, s, n in data)
    full = [(t, s, n, 10 * n, 0, n + 100) for t, s, n in rows]  # token, salt, node, n, rare, pos
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*full[i : i + size]), kinds)], names=list("tsnmrp")) for i in range(0, len(full), size)]
    got = sorted(tuple(r.values()) for b in simhash._meet(iter(batches)) for r in b.to_pylist())
    runs = {}
    for row in full:
        runs.setdefault(row[:2], []).append(row)
    want = []
    for own in runs.values():
        nodes = sorted(set(own), key=lambda r: r[2])
        if len(nodes) > 1 or nodes[0][1]:
            first = nodes[0]
            want += [(*r, first[2], first[3], first[5], first[4]) for r in nodes]
    assert got == sorted(want)

def test_one_document_by_the_popcount_grid(spark, monkeypatch):
    """The stage's first candidates are fingerprints that meet on the grid; what these miss comes by first shingles."""
    data, met = alike_rows(), []
    grid = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda points: met.append(points.count()) or grid(points))
    kept = simhash.keep_one(documents(spark, data)).count()
    assert met and met[0] > 100
    monkeypatch.setattr(simhash, "near_pairs", lambda points: grid(points).where("false"))
    assert simhash.keep_one(documents(spark, data)).count() == kept


def test_parities_never_part_alike_sets(spark):
    """9 * (cells of odd count that differ) <= n + m holds for every two sets that agree by 0.8, and fails for unlike ones."""
    rng = np.random.default_rng(2)
    data = []
    for n in (1, 4, 9, 45, 90, 400, 3000):
        own = rng.integers(-(1 << 63), 1 << 63, n)
        for more in (n // 4, n // 9):
            data.append((own, np.concatenate([own, rng.integers(-(1 << 63), 1 << 63, more)]), True))
            data.append((own, np.concatenate([own[more:], rng.integers(-(1 << 63), 1 << 63, n // 9 - more if more < n // 9 else 0)]), 5 * (n - more) >= 4 * n))
        if 40 < n < 500:
            data.append((own, rng.integers(-(1 << 63), 1 << 63, n), False))
    frame = spark.createDataFrame([(len(a), len(b), simhash.parities(a).tolist(), simhash.parities(b).tolist(), alike) for a, b, alike in data], "n bigint, m bigint, x array<bigint>, y array<bigint>, alike boolean")
    got = [(r.alike, r.can) for r in frame.select("alike", simhash.can_be_alike(F.col("n"), F.col("x"), F.col("m"), F.col("y")).alias("can")).collect()]
    assert all(can for alike, can in got if alike) and not any(can for (a, b, alike), (_, can) in zip(data, got) if not alike and 40 < len(a) < 500 and not np.isin(a, b).any())


def test_long_texts_are_told_apart_by_parities(spark, monkeypatch):
    """texts of thousands of words that share a passage went to the comparison of whole sets, megabytes of them; of 512 cells, half were odd."""
    passage, sent = [f"p{k}" for k in range(900)], []
    data = [(i, " ".join([*passage, *(f"own{i}x{k}" for k in range(3000 + 100 * i))]), "en", "a") for i in range(6)]
    data += [(50, data[2][1] + " more", "en", "a"), (51, " ".join(data[3][1].split()[500:]), "en", "a")]
    agreeing = simhash._agreeing
    monkeypatch.setattr(simhash, "_agreeing", lambda rows, agree: sent.append(rows.where("second").count()) or agreeing(rows, agree))
    assert sorted(r.doc_id for r in simhash.keep_one(documents(spark, data)).collect()) == [*range(6)]
    assert 2 <= sum(sent) <= 4


def test_fine_parities_never_part_alike_sets(spark):
    """Also across a power of two; sets that agree by half are parted at any size."""
    rng = np.random.default_rng(4)
    data = []
    for n in (1, 9, 500, 512, 513, 1000, 1030, 5000, 40_000):
        own = rng.integers(-(1 << 63), 1 << 63, n)
        for m in {n // 4, n // 9, n // 20}:
            data += [(own, np.concatenate([own, rng.integers(-(1 << 63), 1 << 63, m)]), True), (own[m:], own, 5 * (n - m) >= 4 * n)]
        if n > 400:
            data.append((own, np.concatenate([own[n // 3 :], rng.integers(-(1 << 63), 1 << 63, n // 3)]), False))
    assert all((simhash.folded(simhash.fine_parities(x)) == simhash.parities(x)).all() for x, _, _ in data)
    frame = spark.createDataFrame([(len(a), len(b), simhash.fine_parities(a).tolist(), simhash.fine_parities(b).tolist(), alike) for a, b, alike in data], "n bigint, m bigint, x array<bigint>, y array<bigint>, alike boolean")
    for n, x, m, y in (("n", "x", "m", "y"), ("m", "y", "n", "x")):
        assert [r.can for r in frame.select(simhash.can_be_alike_finely(F.col(n), F.col(x), F.col(m), F.col(y)).alias("can")).collect()] == [alike for _, _, alike in data]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 1)), max_size=40), st.integers(1, 9))
def test_widths_in_batches(data, size):
    """Runs of over two rows and those with a salt, wherever batches are cut."""
    import pyarrow as pa

    rows = [(t, s, *range(8 * i, 8 * i + 8)) for i, (t, s) in enumerate(sorted(data))]
    kinds = [{"bigint": pa.int64(), "int": pa.int32()}[x.split()[1]] for x in simhash._MEMBER.split(", ")]
    names = [x.split()[0] for x in simhash._MEMBER.split(", ")]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + size]), kinds)], names=names) for i in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in simhash._widths(iter(batches)) for r in b.to_pylist()]
    counts = Counter(r[:2] for r in rows)
    assert got == [(*r, counts[r[:2]] > 2 or r[1] > 0) for r in rows]


def test_shingles_are_told_by_their_words():
    """As many different hashes as different shingles, in whatever order or number the words come."""
    texts = ["a b c d e f", "f e d c b a", "a a a a a a", "a a a a", "a a a", "a", "b", "a b", "b a", "A b  C\nd e f", "ab c d e f g", "a bc d e f g"]
    texts += [prose(300, k) for k in range(20)]
    sets = [simhash.shingle_set(t.encode()) for t in texts]
    by_hand = [shingles_by_hand(t) for t in texts]
    assert [len(x) for x in sets] == [len(x) for x in by_hand]
    assert len(set().union(*(x.tolist() for x in sets))) == len(set().union(*by_hand))
    assert len(sets[0]) == 2 and (sets[0] == sets[9]).all() and len(simhash.shingle_set(b" \n")) == 0


PAGES = [(1, "http://a.example/x y", "<p>one</p>"), (2, "http://b.example", "<p>one</p>"), (3, None, None), (4, "u", ""), (5, "http://c.example/é", "日本\r\n\r\nWARC/1.1\n" * 9), (None, "n", "<p>one</p>"), (None, "m", "only here"), (7, "big", "x" * 300_000), (-9, "neg", "minus"), (8, "t", "minus"), (1, "http://a.example/again", "<p>one</p>")]


def test_pages_through_archives(spark):
    frame = spark.createDataFrame([(*p, "q") for p in PAGES], "page_id bigint, url string, html string, digest string").repartition(2)
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.pages_through_warc(frame, file_bytes=2000).collect())
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    counts = Counter(html or "" for _, _, html in PAGES)
    want = Counter()
    for i, _, html in PAGES:
        data = (html or "").encode()
        to = first.get(html or "") if counts[html or ""] > 1 else None
        to = None if to == i else to
        want[i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if to is not None else "response", to] += 1
    assert got == want
    assert warc.pages_through_warc(frame.where("false")).collect() == []


def test_small_payloads_are_never_revisits(spark):
    frame = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    kinds = {(r.page_id, r.payload_bytes): r.record_type for r in warc.pages_through_warc(frame, min_bytes=6).collect()}
    assert kinds[8, 5] == "response" and kinds[2, 10] == "revisit"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.binary(max_size=60)), max_size=6), st.sampled_from([1, 2]))
def test_arc_round_trip(records, version):
    data = warc.write_arc(records, version, "20010203040506")
    back = list(warc.read_arc(data))
    assert [(r.header["url"], r.content) for r in back] == [(warc.arc_url(u), c) for u, c in records]
    for r, k in zip(back, range(-2, 9)):
        headers, block = next(warc.read_warc(warc.to_warc(r, k)))
        assert block == r.content and headers["warc-date"] == "2001-02-03T04:05:06Z" and warc.id_key(headers["warc-record-id"]) == k


def test_bad_archives():
    good = warc.write_arc([("http://a", b"body")], 1)
    for bad in (b"", b"filedesc://x", good[:-3], good.replace(b"1 0 tain", b"9 0 tain"), good.replace(b"text/html 4", b"text/html x"), good.replace(b"http://a 0.0.0.0", b"http://a")):
        with pytest.raises(warc.ArcError):
            list(warc.read_arc(bad))
    assert [r.content for r in warc.read_arc(warc.write_arc([("u", b"x"), ("v", b"")], 2).replace(b"\nu ", b"\n\r\n\nu "))] == [b"x", b""]
    assert gzip.decompress(warc.to_warc(next(warc.read_arc(good)))).startswith(b"WARC/1.1\r\nWARC-Type: resource")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data = [r for r in near_rows() if r[0] is not None] + [(300 + i, prose(80 + i, 30 + i), "en", "s") for i in range(30)]
    docs = documents(spark, data).drop("size", "node", "part")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    columns, before = docs.columns, None
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        now = {r.doc_id for r in at.select("doc_id").collect()}
        assert before is None or now <= before
        before = now
    mixed = at.agg(F.count("*")).first()[0]
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.where("piece = 0").count() == mixed
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
