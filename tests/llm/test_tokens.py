import os

import pytest
from hypothesis import given, settings, strategies as st

from codequarry.llm import tokens
from codequarry.llm.lexicon import Lexicon, compile_words, to_bytes

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.RANKS_FILE), reason="no vocabulary")

TEXTS = ["", None, " ", "Hello world's  end\n\n  x", "naïve café — größe 日本語", "<|endoftext|> 12345 a_b", "\x1c\x85\u2003 tab\t", "a" * 20_000, "hello hello hello", "hello hello hello", "x\r\n\r\n"]


@pytest.fixture(scope="module")
def merger():
    return tokens.Merger(tokens.RANKS_FILE)


def reference(merger, text):
    return list(merger._encoding.encode_ordinary(text or ""))


def test_corpus(spark, merger):
    rows = [(i, t, "other") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode(docs).collect()}
    assert got == {i: reference(merger, t) for i, t in enumerate(TEXTS)}
    counts = {r["doc_id"]: r["tokens"] for r in tokens.token_counts(docs, words=2).collect()}
    assert counts == {i: len(ids) for i, ids in got.items()}
    assert tokens.encode(docs.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_split_joins_and_agrees(text):
    merger, split = tokens.Merger.__new__(tokens.Merger), tokens.Splitter()
    words = split(text)
    assert "".join(words) == text
    global _CACHED
    merger = _CACHED = globals().get("_CACHED") or tokens.Merger(tokens.RANKS_FILE)
    assert [i for w in words for i in merger(w)] == reference(merger, text)


@given(st.dictionaries(st.binary(min_size=1, max_size=6), st.lists(st.integers(0, 99), min_size=1, max_size=3), max_size=40), st.lists(st.binary(max_size=7), max_size=20))
def test_transducer(words, others):
    import tempfile

    with tempfile.NamedTemporaryFile() as file:
        file.write(to_bytes(compile_words([(w, v) for w, v in words.items()])))
        file.flush()
        lexicon = Lexicon.mapped(file.name)
        asked = [*words, *others]
        ranks = lexicon.ranks(asked)
        assert [list(i) for i in lexicon.ids(ranks[ranks >= 0])] == [words[w] for w in asked if w in words]
        for word, rank in zip(asked, ranks.tolist(), strict=True):
            assert (rank >= 0) == (word in words)


def test_suffixes_are_shared():
    alone = compile_words([(b"walking", [1])])
    both = compile_words([(b"talking", [2]), (b"walking", [1])])
    assert len(both["final"]) == len(alone["final"])
