from datetime import datetime

from codequarry import schema
from codequarry.operators import quality, refresh, savings


def ledger(spark, *rows):
    full = [(c, o, a, 1, i, j, k, m, datetime(2025, 1, 1)) for c, o, a, i, j, k, m in rows]
    return spark.createDataFrame(full, schema.SAVINGS)


def test_entry(spark):
    row = savings.with_totals(ledger(spark, ("x", 10, 1500, 80, 165, 1, 3))).first()
    assert (row["total_engine"], row["total_alternative"], row["saved"]) == (120, 1755, 1635)


def test_report(spark):
    rows = ledger(spark, ("one", 50, 2000, 0, 5, 1, 1), ("two", 100, 100, 9, 0, 1, 1), ("one", 60, 1500, 0, 0, 1, 2))
    row = savings.report(rows).first()
    assert (row["operations"], row["output_tokens"], row["alternative_tokens"], row["total_saved"], row["input_saved"], row["calls_saved"]) == (3, 210, 3600, 3390, 5, 1)
    assert savings.report(rows, "2099-01-01").first()["operations"] == 0
    assert savings.report(rows, "2000-01-01").first()["operations"] == 3
    assert [r["saved"] for r in savings.report_lines(rows).collect()] == [3390, 0]


def test_annotate_first_pattern_wins(spark):
    issues = spark.createDataFrame([("t", "f", "java", "e", 1, "a record here", False, None), ("t", "f", "go", "e", 1, "record", False, None), ("t", "f", "java", "e", None, None, None, "kept")], schema.ISSUES)
    patterns = spark.createDataFrame([(2, "java", "a", "late"), (1, "java", "record", "early")], "position int, lang string, needle string, test string")
    got = {(r["lang"], r["line"]): (r["known"], r["test"]) for r in quality.annotate(issues, patterns).collect()}
    assert got == {("java", 1): (True, "early"), ("go", 1): (False, None), ("java", None): (False, "kept")}
    assert quality.unknown(issues).count() == 3
    assert {(r["grouping"], r["name"]): r["total"] for r in quality.summary(issues).collect()}[("lang", "java")] == 2


def test_log(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"ts":"1","file":"a","lang":"x","issue":"i"}\n\nnot json\n')
    assert quality.read_log(spark, f"file://{path}").count() == 1
    assert quality.read_log(spark, f"file://{tmp_path}/none.jsonl").count() == 0


def test_classify(spark):
    s = "path string, hash string, mtime_nanos long"
    disk = spark.createDataFrame([("same", "h", 5), ("touched", "h", 6), ("edited", "n", 6), ("new", "h", 1), ("blind", None, 9), ("zero", "h", 0)], s)
    index = spark.createDataFrame([("same", "other", 5), ("touched", "h", 5), ("edited", "h", 5), ("gone", "h", 5), ("blind", "h", 1), ("zero", "h", 0)], s)
    expected = {"same": "clean", "touched": "touched", "edited": "modified", "new": "added", "gone": "deleted", "blind": "failed", "zero": "clean"}
    assert {r["path"]: r["state"] for r in refresh.classify(disk, index).collect()} == expected
    assert {r["path"]: r["state"] for r in refresh.classify(disk, index, True).collect()} == expected | {"gone": "kept"}


def test_verify_and_repair(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, path string")
    chunks = spark.createDataFrame([(1, 1), (2, 9), (3, None)], "chunk_id long, file_id long")
    refs = spark.createDataFrame([(1, 1), (2, 77), (3, None), (4, 2)], "ref_id long, chunk_id long")
    disk = spark.createDataFrame([("a",)], "path string")
    assert tuple(quality.verify(files, chunks, refs, disk).first()) == (1, 1, 1)
    assert [d.count() for d in quality.repaired(files, chunks, refs, disk)] == [1, 1, 1]


def test_purge_and_key_changes(spark):
    files = spark.createDataFrame([(1, "a"), (2, "b")], "file_id long, path string")
    chunks = spark.createDataFrame([(1, 1, "fn", "x", None), (2, 2, "fn", "y", None)], "chunk_id long, file_id long, kind string, ident string, parent string")
    refs = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "ref_id long, chunk_id long")
    f, c, r = refresh.purged(files, chunks, refs, spark.createDataFrame([("a",)], "path string"))
    assert ([x["file_id"] for x in f.collect()], [x["chunk_id"] for x in c.collect()], sorted(x["ref_id"] for x in r.collect())) == ([2], [2], [2, 3])
    assert {tuple(x)[:3] for x in refresh.key_changes(chunks, c).collect()} == {("removed", "fn", "x")}
