import random

import pytest

from codequarry.llm import spans

SCHEMA = "chunk_id long, file_id long, content string, digest string"


def longest(a, b, n=spans.SPAN):
    grams = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in grams for i in range(len(b) - n + 1))


def brute(rows):
    out = set()
    for i, f, t, _ in rows:
        for j, g, u, _ in rows:
            if i < j and None not in (f, g, t, u) and f != g and longest(t, u):
                out.add((i, j))
    return out


def corpus(seed, lines=(5, 60), n=24):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    line = lambda: " ".join(word() for _ in range(rng.randint(*lines) // 5 + 1))
    text = lambda: "\n".join(line() for _ in range(rng.randint(5, 30)))
    shared = [text() + "\n" + text() for _ in range(3)]
    rows = []
    for i in range(n):
        body = text()
        if i % 3:
            s = rng.choice(shared)
            size = rng.choice([280, 299, 300, 301, 330, 600])
            at = rng.randrange(max(1, len(s) - size))
            body = body[: len(body) // 2] + s[at : at + size] + body[len(body) // 2 :]
        rows.append((i, rng.randint(1, 12), body, "z"))
    return rows


@pytest.mark.parametrize("seed, lines", [(1, (5, 60)), (2, (5, 60)), (3, (600, 3000)), (4, (150, 400))])
def test_like_brute_force(spark, seed, lines, monkeypatch):
    rows = corpus(seed, lines)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == brute(rows)
    monkeypatch.setattr(spans, "SMALL_GROUP", 1)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == brute(rows)


def test_a_piece_that_many_share(spark, monkeypatch):
    """A header of 200 characters in every record makes no pairs; spans that hold it do."""
    monkeypatch.setattr(spans, "SMALL_GROUP", 3)
    rng = random.Random(9)
    own = lambda n: "".join(rng.choice("qwertyuiop\n ") for _ in range(n))
    header = own(100) + "\n" + own(99)
    rows = [(i, i, own(50) + header + own(200), "z") for i in range(40)]
    tail, head = own(110), own(60)
    rows += [(100 + i, 100 + i, own(20) + head + header + tail[: 39 + i] + own(90), "z") for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in spans.shared_pairs(df).collect()}
    assert got == brute(rows) and len(got) >= 10


def test_cases(spark):
    same = "x = 1\n" * 60
    rule = "=" * 400
    rows = [(1, 1, same, "z"), (1, 1, same, "z"), (2, 2, same, "z"), (3, 2, same, "z"), (4, None, same, "z"), (5, 5, None, "z"), (6, 6, "", "z"), (7, 7, rule, "z"), (8, 8, "y" + "=" * 310, "z"), (9, 9, "=" * 299, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in spans.shared_pairs(df).collect()} == {(1, 2), (1, 3), (7, 8)}
    shares = {r["chunk_id"]: (r["shared_chars"], r["share"], r["origin"]) for r in spans.shared_shares(df).collect()}
    assert shares[1][:2] == (360, 1.0) and shares[2] == (360, 1.0, 1) and shares[5] == shares[6] == (0, 0.0, None) and shares[9][0] == 0
    assert shares[8][0] >= 300 and len(shares) == 9
    assert spans.shared_pairs(df.limit(0)).count() == 0


def test_share_is_exact(spark):
    rng = random.Random(5)
    own = lambda n: "".join(rng.choice("qwertyuiop\n ") for _ in range(n))
    common = own(900)
    df = spark.createDataFrame([(1, 1, own(500) + "A" + common + "B" + own(77), "z"), (2, 2, "C" + common + "D" + own(300), "z")], SCHEMA)
    assert {r["chunk_id"]: r["shared_chars"] for r in spans.shared_shares(df).collect()} == {1: 900, 2: 900}


def test_share_of_repeated_spans(spark, monkeypatch):
    """Every copy of a block that many chunks hold counts, and the whole of a long run of one character."""
    rng = random.Random(3)
    own = lambda n: "".join(rng.choice("qwertyuiop\n ") for _ in range(n))
    block = own(420)
    rows = [(i, i, own(40) + chr(65 + i) + block + chr(75 + i) + own(40), "z") for i in range(8)] + [(50, 50, "W" + block + "X" + own(90) + "Y" + block + "Z", "z")]
    rows += [(60, 60, "=" * 1500, "z"), (61, 61, "y" + "=" * 1100 + "y", "z")]
    for small in (48, 3):
        monkeypatch.setattr(spans, "SMALL_GROUP", small)
        shares = {r["chunk_id"]: r["shared_chars"] for r in spans.shared_shares(spark.createDataFrame(rows, SCHEMA)).collect()}
        assert shares == dict.fromkeys(range(8), 420) | {50: 840, 60: 1500, 61: 1100}


def test_later_occurrences_are_removed(spark):
    """The least holder of another file stays, though the least of all lies in the same file."""
    rng = random.Random(4)
    block = "".join(rng.choice("qwertyuiop\n ") for _ in range(400))
    rows = [(3, 1, block, "z"), (7, 1, block, "z"), (8, 2, block, "z"), (9, 3, "<" + block + ">", "z"), (10, 4, None, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["chunk_id"]: (r["kept"], [tuple(s) for s in r["removed"]]) for r in spans.without_shared(df).collect()}
    assert got[3] == got[7] == (block, []) and got[10] == (None, [])
    assert got[8] == ("", [(0, 400, 3)]) and got[9] == ("<>", [(1, 401, 3)])
    assert {r["chunk_id"]: r["origin"] for r in spans.shared_shares(df).collect()} == {3: 8, 7: 8, 8: 3, 9: 3, 10: None}


def test_links_and_hot_digests(spark, monkeypatch):
    """Links are between classes and linear in the copies of a text; with every digest hot, or none, the pairs are the same."""
    from codequarry.llm import hot

    rows = corpus(6)
    text = "\n".join(f"The licence says in line {k} what may be done with it." for k in range(12))
    rows += [(100 + i, i, text, "z") for i in range(30)] + [(200, 99, text + " And more.", "z"), (201, 98, text.upper(), "z"), (202, None, text, "z"), (203, 1, None, "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    for share in (1, 10_000, 10**9):
        monkeypatch.setattr(hot, "HOT_SHARE", share)
        assert {tuple(r) for r in spans.shared_pairs(df).collect()} == want
    got = {(r["chunk_id"], r["file_id"]): (r["copies"], r["links"]) for r in spans.linked_chunks(df).collect()}
    assert all(got[100 + i, i] == (29, 1) for i in range(30)) and got[200, 99] == (0, 1) and got[201, 98] == (0, 0)
    assert not {202, 203} & {k for k, _ in got} and spans.linked_chunks(df.limit(0)).count() == 0


def test_normalised_units():
    points = spans.code_points("Ab\tÉz")
    assert spans.normalised(points).tolist() == spans.code_points("ab Éz").tolist()


def test_runs_of_either_case(spark):
    """Runs of one letter in changing case are no runs of one character."""
    rng = random.Random(4)
    letters = "".join(rng.choice("aA") for _ in range(900))
    rows = [(1, 1, "x" + letters, "z"), (2, 2, "yy" + letters[300:], "z"), (3, 3, letters.lower(), "z"), (4, 4, letters[:299], "z"), (5, 5, "a" * 700, "z")]
    assert {tuple(r) for r in spans.shared_pairs(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)
