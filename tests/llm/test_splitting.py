import pytest
from hypothesis import given, settings, strategies as st

from codequarry.llm import splitting
from codequarry.llm.splitting import LIMIT, split_bytes

LINE = st.text(alphabet="ab {}é#-\t", max_size=120)


def check(data, limit=LIMIT, markup=False):
    pieces = split_bytes(data, markup, limit)
    at = 0
    for k, (a, b) in enumerate(pieces):
        assert b - a <= limit and a < b
        assert a <= at <= b and (k == 0 or b > at)
        data[a:b].decode("utf-8")
        at = b
    assert at == len(data) and pieces[0][0] == 0
    return pieces


@settings(max_examples=80, deadline=None)
@given(st.lists(LINE, min_size=60, max_size=200), st.booleans(), st.sampled_from(["\n", "\r\n", "\n\n"]))
def test_pieces_cover_the_text(lines, markup, end):
    data = end.join(lines).encode()
    if len(data) > LIMIT:
        check(data, markup=markup)


def test_overlap_is_two_lines():
    data = "".join(f"line {i} of the text\n" for i in range(900)).encode()
    pieces = check(data)
    for (a, b), (c, _) in zip(pieces, pieces[1:], strict=False):
        assert data[c:b] == b"".join(data[a:b].splitlines(keepends=True)[-2:])


def test_one_long_line():
    data = ("word é " * 3000).encode()
    pieces = check(data)
    for (_, b), (c, _) in zip(pieces, pieces[1:], strict=False):
        assert 120 <= b - c <= 128
    check(b"x" * 10_000)
    check("€".encode() * 5_000)


def test_cuts_at_blocks():
    block = "def f{0}(x):\n" + "    y = x\n" * 150 + "\n"
    data = "".join(block.format(i) for i in range(6)).encode()
    pieces = check(data)
    assert all(data[:b].endswith(b"\n\n") for _, b in pieces)


def test_cuts_at_headings():
    data = "".join(f"# Part {i}\n\n" + "some words here.\n" * 100 for i in range(8)).encode()
    for _, b in check(data, markup=True)[:-1]:
        assert data[b:].startswith(b"# Part")


@pytest.mark.parametrize("size, pieces", [(4096, 0), (4097, 2)])
def test_on_spark(spark, size, pieces):
    rows = [(1, "a" * size, 7, "fn", "x"), (1, "a" * size, 7, "fn", "x"), (2, None, 1, "fn", "x"), (3, "", None, "fn", "x")]
    got = splitting.split_oversized(spark.createDataFrame(rows, "chunk_id long, content string, start_line int, kind string, piece string")).orderBy("piece").collect()
    assert len(got) == pieces
    if got:
        assert (got[0]["piece"], got[0]["start_line"], got[1]["end_line"], got[0]["overlap_bytes"]) == (1, 7, 7, 0)
        assert got[0]["content"] + got[1]["content"][got[1]["overlap_bytes"] :] == "a" * size


def test_rows_that_differ(spark):
    """Rows of one key and first line are one only if kind and content are the same too."""
    rows = [(1, "a" * 5000, 7, "fn"), (1, "a" * 5000, 7, "fn"), (1, "b" * 5000, 7, "fn"), (1, "a" * 5000, 7, "section"), (1, "a" * 5000, 8, "fn")]
    got = splitting.split_oversized(spark.createDataFrame(rows, "chunk_id long, content string, start_line int, kind string")).where("piece = 1").collect()
    assert sorted((r["start_line"], r["content"][0]) for r in got) == [(7, "a"), (7, "a"), (7, "b"), (8, "a")]


def test_deep_and_small_limits():
    check("".join(" " * k + f"x{k}\n" for k in range(1500)).encode())
    check("".join("\t" * (k % 400) + "y\n\n" for k in range(4000)).encode())
    data = "".join(f"def f{k}():\n    return {k}\n\n" for k in range(400)).encode()
    for limit in (128, 300, 1000):
        check(data, limit=limit)
        check(b"z" * 3000, limit=limit)
