from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from codequarry.operators import changes

RUNS = "run_id long, repo string, started_at timestamp, finished_at timestamp, status string, walk_had_errors boolean"
SCANS = "scan_id long, run_id long, path string, hash string, size_bytes long, mtime_nanos long, scanned_at timestamp"
T0 = datetime(2025, 1, 1)


def at(n):
    return T0 + timedelta(minutes=n)


def brute(runs, scans):
    """The definition, run by run."""
    out, record = set(), {}
    for run_id, repo, _, _, status, errors in sorted(set(runs), key=lambda r: (r[2], r[0])):
        if status != "ok":
            continue
        rows = [s for s in set(scans) if s[1] == run_id]
        seen = {s[2] for s in rows}
        known = record.setdefault(repo, {})
        last = {}
        for s in sorted(rows, key=lambda s: (s[6], s[0])):
            if s[3] is not None:
                last[s[2]] = s[3]
        out |= {(run_id, p) for p, h in last.items() if known.get(p) != h}
        known.update(last)
        if not errors:
            for p in set(known) - seen:
                del known[p]
    return out


def run(spark, runs, scans):
    _, found = changes.replay(spark.createDataFrame(runs, RUNS), spark.createDataFrame(scans, SCANS))
    return {tuple(r) for r in found.collect()}


def test_history(spark):
    runs = [(1, "a", at(0), None, "ok", None), (2, "a", at(9), None, "failed", False), (3, "a", at(5), None, "ok", True), (4, "a", at(20), None, "ok", False), (5, "a", at(30), None, "ok", False), (6, "b", at(1), None, None, None)]
    scans = [
        (1, 1, "a/x", "h1", 1, 0, at(1)), (1, 1, "a/x", "h1", 1, 0, at(1)), (2, 1, "a/y", None, 1, 0, at(1)), (3, 3, "a/x", "h2", 1, 0, at(6)), (4, 3, "a/x", "h1", 1, 0, at(7)),
        (5, 2, "a/x", "h9", 1, 0, at(9)), (6, 4, "a/y", "k", 1, 0, at(2)), (7, 5, "a/x", "h1", 1, 0, at(31)), (8, 6, "b/z", "q", 1, 0, at(1)), (9, 77, "a/u", "q", 1, 0, at(1)),
    ]
    assert run(spark, runs, scans) == brute(runs, scans) == {(1, "a/x"), (4, "a/y"), (5, "a/x")}


def test_empty_tables(spark):
    assert run(spark, [], []) == set()
    assert run(spark, [(1, "a", at(0), None, "ok", False)], []) == set()


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_like_the_definition(spark, data):
    runs = [(i, data.draw(st.sampled_from("ab")), at(data.draw(st.integers(0, 50))), None, data.draw(st.sampled_from(["ok", "ok", "failed", None])), data.draw(st.sampled_from([True, False, None]))) for i in range(8)]
    scans = [(i, data.draw(st.integers(0, 8)), data.draw(st.sampled_from(["p", "q", "r"])), data.draw(st.sampled_from(["1", "2", None])), 1, 0, at(data.draw(st.integers(0, 60)))) for i in range(30)]
    assert run(spark, runs, scans) == brute(runs, scans)


def test_a_run_is_applied_once_and_a_crash_leaves_no_trace(spark, tmp_path):
    tracker = changes.ChangeTracker(spark, f"file://{tmp_path}/t")
    scopes = spark.createDataFrame([("s", True, 1)], "scope string, complete boolean, tag long")
    rows = spark.createDataFrame([("s", "k", "h")], "scope string, key string, hash string")
    assert tracker.apply(rows, scopes, "one") == 1
    assert tracker.apply(rows, scopes, "one") == 1
    assert tracker.changes(1).count() == 1
    # a run that died before its commit: its folder is there, the commit is not
    changes.compared(tracker.state(), rows.withColumn("hash", rows.key), scopes).write.parquet(f"file://{tmp_path}/t/data/000000002-dead")
    assert [tuple(r) for r in tracker.state().collect()] == [("s", "k", "h")]
    assert tracker.apply(rows, scopes, "two") == 2
    assert tracker.changes(2).count() == 0
    tracker.forget_before(2)
    assert tracker.state().count() == 1


def test_old_tokens_and_compaction(spark, tmp_path, monkeypatch):
    """A run older than many commits is not applied again; after every few runs the state is one table; old tables go."""
    monkeypatch.setattr(changes, "COMPACT", 3)
    tracker = changes.ChangeTracker(spark, f"file://{tmp_path}/t")
    one = lambda scope, key, hash_: spark.createDataFrame([(scope, key, hash_)], "scope string, key string, hash string")
    scope = lambda name, complete=True: spark.createDataFrame([(name, complete, 7)], "scope string, complete boolean, tag long")
    for k in range(7):
        assert tracker.apply(one("ab"[k % 2], f"k{k}", "h"), scope("ab"[k % 2], False), f"run-{k}") == k + 1
    assert tracker.apply(one("a", "k0", "other"), scope("a"), "run-0") == 1
    assert {tuple(r)[1] for r in tracker.state().collect()} == {f"k{k}" for k in range(7)}
    assert tracker.pointer()["version"] == 7 and len(tracker.pointer()["deltas"]) == 1
    # a commit whose pointer and token were not written any more is found all the same
    tracker._files.replace_text("CURRENT", "5")
    assert tracker.pointer()["version"] == 7 and tracker.committed("run-6") == 7
    before = len(list((tmp_path / "t" / "data").iterdir()))
    tracker.forget_before(7)
    assert len(list((tmp_path / "t" / "data").iterdir())) < before and tracker.state().count() == 7
    # the keys of a complete run of one scope are struck, the other scope stays
    assert tracker.apply(one("a", "k0", "h"), scope("a"), "last") == 8
    assert {tuple(r)[1] for r in tracker.state().collect()} == {"k0", "k1", "k3", "k5"} and tracker.changes(8).count() == 0


def test_two_writers(spark, tmp_path):
    """Two runs that start from the same version are both on record."""
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/t"

    def run_one(k):
        rows = spark.createDataFrame([(f"s{k}", "k", f"h{k}")], "scope string, key string, hash string")
        return changes.ChangeTracker(spark, root).apply(rows, spark.createDataFrame([(f"s{k}", True, k)], "scope string, complete boolean, tag long"), f"run-{k}")

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(run_one, range(4)))
    tracker = changes.ChangeTracker(spark, root)
    assert sorted(versions) == [1, 2, 3, 4] and {r["scope"] for r in tracker.state().collect()} == {"s0", "s1", "s2", "s3"}
    assert tracker.changes(1, 4).count() == 4


def test_content_hash_tells_null_from_empty(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None)], "x string, y string")
    assert df.select(changes.content_hash("x", "y").alias("h")).distinct().count() == 3


def test_unknown_match_is_refused(spark):
    from codequarry.operators import orphans

    with pytest.raises(ValueError):
        orphans.orphans(spark.range(1), spark.range(1), ["id"], match="none")
