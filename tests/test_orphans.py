from datetime import datetime

from pyspark.sql import functions as F

from codequarry.operators import orphans

CHILD = "id long, a string, b string, extra string"


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_matches(spark):
    child = spark.createDataFrame([(1, "x", "y", "e"), (2, "x", "z", "e"), (3, "x", None, "e"), (4, "q", None, "e"), (5, None, None, "e"), (6, None, "y", "e"), (6, None, "y", "e")], CHILD)
    parent = spark.createDataFrame([("x", "y", 1), ("x", "y", 1), ("w", None, 2)], "a string, b string, extra int")
    assert ids(orphans.orphans(child, parent, ["a", "b"])) == [2]
    assert ids(orphans.orphans(child, parent, ["a", "b"], "partial")) == [2, 4]
    assert ids(orphans.orphans(child, parent, ["a", "b"], "full")) == [2, 3, 4, 6, 6]


def test_empty_sides(spark):
    child = spark.createDataFrame([(1, "x", "y", "e")], CHILD)
    assert ids(orphans.orphans(child, child.limit(0), ["a"])) == [1]
    assert ids(orphans.orphans(child.limit(0), child, ["a"])) == []


def test_hot_keys_take_the_broadcast_way(spark):
    child = spark.range(40_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN 'gone' ELSE 'k' || id END AS a")
    parent = spark.createDataFrame([("hot",), ("k2",)], "a string")
    assert set(orphans.hot_keys(child, F.col("a"))) == {"hot", "gone"}
    found = orphans.orphans(child, parent, ["a"])
    assert found.count() == child.where("a <> 'hot' AND a <> 'k2'").count()
    pairs = child.withColumn("b", F.when(F.col("id") % 5 > 0, F.lit("x")))
    both = parent.withColumn("b", F.lit("x"))
    assert len(orphans.hot_keys(pairs, F.xxhash64("a", "b"))) >= 2
    assert orphans.orphans(pairs, both, ["a", "b"], "partial").count() == found.count()


def test_purges(spark):
    def d(n):
        return datetime(2025, 1, n)

    files = spark.createDataFrame([(1, d(1)), (2, d(5)), (3, d(1))], "file_id long, indexed_at timestamp")
    chunks = spark.createDataFrame([(10, 1, d(2)), (11, 2, d(2)), (12, 9, d(3)), (13, None, d(3)), (14, 3, d(9)), (14, 3, d(9))], "chunk_id long, file_id long, indexed_at timestamp")
    refs = spark.createDataFrame([(100, 10, d(2)), (101, 99, d(2)), (102, None, d(2)), (103, 11, d(4))], "ref_id long, chunk_id long, indexed_at timestamp")
    purges = spark.createDataFrame([("files", 1, d(1)), ("files", 2, d(4)), ("chunks", 11, d(3)), ("chunks", 11, d(3)), ("files", None, d(9))], "rel string, row_id long, purged_at timestamp")
    found = orphans.index_orphans(files, chunks, refs, purges)
    assert {tuple(r) for r in found.select("rel", "row_id").collect()} == {("chunks", 10), ("chunks", 12), ("refs", 101), ("refs", 103)}
    report = {(r["rel"], r["day"].day): r["orphans"] for r in orphans.orphan_report(found).collect()}
    assert report == {("chunks", 2): 1, ("chunks", 3): 1, ("refs", 2): 1, ("refs", 4): 1}
