import numpy as np
from hypothesis import given, strategies as st

from codequarry.llm import packing


@given(st.lists(st.integers(0, 50), max_size=80))
def test_limits_hold(sizes):
    sizes = np.array(sizes, np.int64)
    got = packing.pack(sizes, np.maximum(sizes - 1, 0), capacity=50, segments=7)
    for c in set(got.tolist()):
        inside = sizes[got == c]
        assert inside.sum() <= 50 and len(inside) <= 7


@given(st.lists(st.tuples(st.integers(0, 130), st.integers(0, 130)), max_size=40), st.integers(5, 60))
def test_pieces(items, loss_capacity):
    for tokens, loss in items:
        pieces = packing.pieces_of(tokens, 50, loss, loss_capacity)
        assert sum(n for n, _ in pieces) == tokens and sum(b for _, b in pieces) == min(loss, tokens) and all(n <= 50 and b <= min(n, loss_capacity) for n, b in pieces)
        assert (len(pieces) == 1) == (tokens <= 50 and min(loss, tokens) <= loss_capacity)


def test_empty_items_are_segments():
    sizes = np.array([0] * 1001 + [5])
    got = packing.pack(sizes, np.zeros(1002, np.int64), capacity=10, segments=256)
    assert np.bincount(got).max() <= 256


def test_every_limit_closes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(n), int(n * share)) for i, (n, share) in enumerate(zip(rng.integers(1, 700, 600), rng.choice([0.05, 0.5, 1.0], 600), strict=True))] + [(1000 + i, 2, 1) for i in range(900)] + [(None, 3000, 2500)] * 3
    got = packing.fill(spark.createDataFrame(rows, "doc_id long, tokens long, answer long"), segments=8, loss="answer", loss_capacity=1000)
    held: dict = {}
    for r in got.collect():
        held.setdefault(r["container"], []).append((r["tokens"], r["loss"]))
    assert all(sum(n for n, _ in c) <= 2048 and sum(b for _, b in c) <= 1000 and len(c) <= 8 for c in held.values())
    assert sum(n for c in held.values() for n, _ in c) == sum(n for _, n, _ in rows)
    report = packing.pack_report(got, segments=8, loss_capacity=1000).first()
    assert report["full_segments"] > 0 and report["full_loss"] > 0 and report["containers"] == len(held)


def test_loss_limit():
    sizes, loss = np.array([10, 10, 10, 10]), np.array([10, 10, 0, 0])
    got = packing.pack(sizes, loss, capacity=20, segments=9, loss_capacity=10)
    assert got[0] != got[1]


def test_little_room_is_lost():
    sizes = np.random.default_rng(1).integers(1, 900, 4000)
    got = packing.pack(sizes, sizes - 1)
    assert packing.unused(sizes.tolist(), got.max() + 1) < 0.01


def test_fill(spark):
    rows = [(1, 5000), (2, 0), (3, None), (4, 2048), (5, 2049), (6, 10), (6, 10), (7, 4096)]
    got = packing.fill(spark.createDataFrame([(k, n, 9) for k, n in rows], "doc_id long, tokens long, piece int")).collect()
    use: dict = {}
    for r in got:
        use[r["container"]] = use.get(r["container"], 0) + r["tokens"]
    assert max(use.values()) <= 2048
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["piece"], r["tokens"]))
    assert sorted(by[1]) == [(0, 2048), (1, 2048), (2, 904)] and sorted(by[7]) == [(0, 2048), (1, 2048)] and sorted(by[5]) == [(0, 2048), (1, 1)]
    assert by[2] == by[3] == [(0, 0)] and by[4] == [(0, 2048)] and len(by[6]) == 2
    assert packing.fill(spark.createDataFrame([], "doc_id long, tokens long")).count() == 0


def test_report(spark):
    row = packing.pack_report(packing.fill(spark.createDataFrame([(i, 512) for i in range(8)], "doc_id long, tokens long"))).first()
    assert tuple(row)[:4] == (2, 4096, 0.0, 2)
