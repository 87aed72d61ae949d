import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm.tokens import Transducer, load_pieces, token_counts

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PIECES = load_pieces(PATH)
MACHINE = Transducer(PIECES)


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("aab  \n\t▁éthe<s>0😀\x00，的"), st.characters(exclude_categories=["Cs"])), max_size=80))
def test_counts_as_the_library(text):
    assert MACHINE.count(text) == len(LIBRARY.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.text("ab  the\n▁é0", max_size=200), st.integers(1, 40))
def test_chunks_compose(text, chunk):
    assert MACHINE.count(text, chunk) == MACHINE.count(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab the\n", min_size=1, max_size=12), min_size=3, max_size=3))
def test_composition_is_associative(parts):
    one, two, three = (MACHINE.chunk_map(part, False) for part in parts)
    left = MACHINE.compose(MACHINE.compose(one, two), three)
    right = MACHINE.compose(one, MACHINE.compose(two, three))
    assert left[:2] == right[:2]
    assert left[2] is right[2]


def test_memory_bound_does_not_change_counts():
    small = Transducer(PIECES, max_states=50)
    text = "The quick brown fox jumps over the lazy dog, again and again. " * 5 + "a" * 300
    assert small.count(text, 64) == len(LIBRARY.encode(text))
    assert len(small.states) <= 52


def test_another_kind_of_vocabulary():
    machine = Transducer([("a", 0.0), ("b", 0.0), ("ab", -1.0), ("ba", -2.0), ("abab", -3.0)])
    assert [machine.count(t) for t in ("abab", "baba", "aba")] == [1 + 3, 3 + 3, 2 + 3]  # the blank put first is 3 bytes
    with pytest.raises(ValueError, match="without a piece"):
        Transducer([("ab", 0.0)])


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for row in token_counts(docs, PIECES, limit=500).collect():
        n = len(LIBRARY.encode(texts[row.doc_id]))
        assert (row.n_bytes, row.n_tokens, row.over_limit) == (len(texts[row.doc_id].encode()), n, n > 500)


def test_odd_rows(odd, odd_rows, empty):
    found = sorted(token_counts(odd, PIECES).collect(), key=repr)
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or "")), len(LIBRARY.encode(t or "")) > 4096) for i, t in odd_rows]
    assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
    assert token_counts(empty, PIECES).collect() == []
