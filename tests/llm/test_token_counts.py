import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taintlake.llm import tokencount

from .helpers import documents, rows

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(pieces: dict[str, float], unknown: float, word: str) -> int:
    """Pieces of the best segmentation, by looking at all of them from the left."""
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            score = pieces.get(word[start:end])
            if score is None:
                if end - start > 1:
                    continue
                score, add = unknown, len(word[start].encode())
            else:
                add = 1
            new = best[start][0] + score
            if best[end] is None or new > best[end][0]:
                best[end] = (new, best[start][1] + add)
    return best[-1][1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcé▁", min_size=1, max_size=12), max_size=20))
def test_shared_prefixes_change_nothing(words):
    pieces = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -6.0, "bc": -3.0, "▁": -2.0, "▁a": -2.0, "▁ab": -4.0}
    model = tokencount.Unigram(pieces)
    assert model.counts(words) == {w: brute(pieces, model.unknown, w) for w in words}


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcé▁", min_size=1, max_size=40))
def test_long_pretokens_have_the_same_counts(word):
    pieces = {"a": -1.0, "b": -2.0, "ab": -2.5, "abc": -6.0, "bc": -3.0, "▁": -2.0, "▁a": -2.0, "▁ab": -4.0}
    model = tokencount.Unigram(pieces)
    assert model.count(word) == brute(pieces, model.unknown, word)


def test_a_very_long_pretoken():
    model = tokencount._model(PATH)
    for part in ("ab", "日本", "word"):
        word = tokencount.BLANK + part * 2000
        short = tokencount.BLANK + part * 200
        assert model.counts([word, short]) == {word: model.count(word), short: model.count(short)}
        assert model.counts([short])[short] == brute(tokencount.read_pieces(PATH), model.unknown, short)


def test_counts_of_the_vocabulary():
    pieces = tokencount.read_pieces(PATH)
    model = tokencount._model(PATH)
    for text in (r[1] for r in rows() if r[1] and len(r[1]) < 600):
        words = tokencount.pretokens(text)
        counts = model.counts(set(words))
        assert counts == {w: brute(pieces, model.unknown, w) for w in set(words)}


def test_query_rows(spark):
    got = {(r.doc_id, r.n_tokens, r.n_chars) for r in tokencount.token_counts(documents(spark), PATH).collect()}
    model = tokencount._model(PATH)
    want = set()
    for doc_id, text, *_ in rows():
        words = tokencount.pretokens(text or "")
        counts = model.counts(set(words))
        want.add((doc_id, sum(counts[w] for w in words), len(text or "")))
    assert got == want
    assert tokencount.token_counts(documents(spark, []), PATH).count() == 0


def test_pieces_across_blanks_are_refused():
    with pytest.raises(ValueError):
        tokencount.Unigram({"a▁b": 0.0})
