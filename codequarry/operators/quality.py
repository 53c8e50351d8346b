"""The quality log: known patterns, summaries, integrity of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from codequarry import schema


def read_log(spark, path: str) -> DataFrame:
    """A JSON-lines log; blank and malformed lines are skipped, a missing file is empty."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema.ISSUES).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], schema.ISSUES)


def clear_log(spark, path: str) -> bool:
    """Delete the log; whether there was one."""
    from codequarry.plans.workspace import FileStore

    folder, _, name = path.rpartition("/")
    store = FileStore(spark, folder)
    existed = store.read_text(name) is not None
    if existed:
        store.remove(name)
    return existed


def annotate(issues: DataFrame, patterns: DataFrame) -> DataFrame:
    """Issues with ``known`` and ``test`` set by the first pattern (position, lang, needle, test) of their language in their context.

    ``patterns`` is a fixed table of the library's user; the patterns of a language are one row, and of several matches the least
    position wins.
    """
    hit = F.struct("position", "test", "needle")
    by_lang = patterns.groupBy(F.col("lang").alias("_lang")).agg(F.sort_array(F.collect_list(hit)).alias("_patterns"))
    met = issues.join(by_lang, F.col("lang") == F.col("_lang"), "left")
    first = F.get(F.filter("_patterns", lambda p: F.coalesce(F.contains(F.col("context"), p["needle"]), F.lit(False))), F.lit(0))
    out = met.withColumn("_hit", first)
    return out.withColumns({"known": F.col("_hit").isNotNull() | F.coalesce("known", F.lit(False)), "test": F.coalesce("_hit.test", "test")}).select(*issues.columns)


def unknown(issues: DataFrame) -> DataFrame:
    return issues.where(~F.coalesce("known", F.lit(False)))


def summary(issues: DataFrame) -> DataFrame:
    """(grouping, name, total, known): counts over all issues, by language and by kind of issue."""
    known = F.count_if(F.coalesce("known", F.lit(False)))
    all_ = issues.agg(F.count("*").alias("total"), known.alias("known")).select(F.lit("all").alias("grouping"), F.lit("").alias("name"), "total", "known")
    out = all_
    for column in ("lang", "issue"):
        out = out.unionByName(issues.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("total"), known.alias("known")).select(F.lit(column).alias("grouping"), "name", "total", "known"))
    return out


def verify(files: DataFrame, chunks: DataFrame, refs: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(orphan_chunks, orphan_refs, missing_files): rows without a parent, and indexed paths that are not on disk.

    A null parent is no orphan.  The three counts are joined as single rows.
    """
    bad_chunks = chunks.where("file_id IS NOT NULL").select("file_id").join(files.select("file_id"), "file_id", "left_anti").agg(F.count("*").alias("orphan_chunks"))
    bad_refs = refs.where("chunk_id IS NOT NULL").select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("orphan_refs"))
    missing = files.select("path").join(on_disk.select("path"), "path", "left_anti").agg(F.count("*").alias("missing_files"))
    return bad_chunks.join(bad_refs).join(missing)


def repaired(files: DataFrame, chunks: DataFrame, refs: DataFrame, on_disk: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without missing files, orphan chunks and the references of either (cascading)."""
    kept_files = files.join(on_disk.select("path"), "path", "left_semi").select(*files.columns)
    kept_chunks = chunks.join(kept_files.select("file_id"), "file_id", "left_semi").select(*chunks.columns)
    kept_refs = refs.join(kept_chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select(*refs.columns)
    return kept_files, kept_chunks, kept_refs


def latest(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key by ``order``."""
    window = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")
