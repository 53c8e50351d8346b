import math

import pytest
from hypothesis import given, strategies as st

from codequarry.functions import textquery as q
from codequarry.operators import search

CHUNKS = "chunk_id long, file_id long, kind string, ident string, signature string, doc_comment string, content string, start_line int, end_line int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(1, "alpha only"), (2, "beta only"), (3, "alpha and beta"), (4, "one big red house"), (5, "one house big red"), (6, None)]
    return spark.createDataFrame([(i, i % 2, "fn", f"f{i}", None, None, t, 1, 2) for i, t in rows], CHUNKS).cache()


def hits(corpus, text, **more):
    return [r["chunk_id"] for r in search.search(corpus, text, **more).orderBy("score", "chunk_id").collect()]


def test_query_forms(corpus):
    assert hits(corpus, "alpha beta") == [3]
    assert sorted(hits(corpus, "alpha OR beta")) == [1, 2, 3]
    assert hits(corpus, '"big red house"') == [4]
    assert hits(corpus, 'alpha "') and hits(corpus, "alpha; beta!") == [3]
    assert sorted(hits(corpus, "hou*")) == [4, 5] and hits(corpus, "hou") == []
    assert hits(corpus, "* OR") == hits(corpus, "") == []
    assert hits(corpus, "big_red") == [4, 5]
    assert "content" not in search.search(corpus, "alpha", fields="minimal").columns
    assert len(hits(corpus, "only OR one", limit=2)) == 2
    with pytest.raises(ValueError):
        search.search(corpus, "alpha", fields="some")


def test_score_is_bm25(corpus):
    row = search.search(corpus, "house").orderBy("chunk_id").first()
    lengths = [1 + n for n in (2, 2, 3, 4, 4, 0)]
    idf = math.log((6 - 2 + 0.5) / (2 + 0.5))
    expected = -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / (sum(lengths) / 6)))
    assert row["score"] == pytest.approx(expected, abs=1e-8)


def test_summary(corpus):
    assert tuple(search.search_summary(corpus, "alpha").first()) == (2, 1, 2 + (len("alpha only") + len("alpha and beta")) // 4)


@given(st.text(max_size=60))
def test_sanitising_is_idempotent(text):
    once = q.sanitise(text)
    assert q.sanitise(once) == once
    assert once.count('"') % 2 == 0
    assert all(g for g in q.parse(text))
