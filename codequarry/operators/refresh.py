"""Keeping an index fresh: what changed on disk, and the tables after the change."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

SKIP_VARIABLE = "CODEQUARRY_SKIP_REFRESH"


def skipped() -> bool:
    """Whether the environment turns refreshing off."""
    return bool(os.environ.get(SKIP_VARIABLE))


def classify(disk: DataFrame, index: DataFrame, walk_had_errors: bool = False) -> DataFrame:
    """(path, state): added, modified, touched (same text, other time), clean, failed (seen, but without a hash), deleted or kept.

    disk: (path, hash, mtime_nanos), index: the same columns.  Equal times that are both known settle a file without its hash; an
    indexed path that was not seen is deleted only if the walk had no errors.
    """
    now = disk.select("path", F.col("hash").alias("new_hash"), F.col("mtime_nanos").alias("new_time"), F.lit(True).alias("seen"))
    old = index.select("path", F.col("hash").alias("old_hash"), F.col("mtime_nanos").alias("old_time"), F.lit(True).alias("indexed"))
    both = now.join(old, "path", "full_outer")
    same_time = (F.col("new_time") == F.col("old_time")) & (F.col("new_time") != 0)
    state = (
        F.when(F.col("seen").isNull(), F.lit("kept" if walk_had_errors else "deleted"))
        .when(same_time & F.col("indexed").isNotNull(), "clean")
        .when(F.col("new_hash").isNull(), "failed")
        .when(F.col("indexed").isNull(), "added")
        .when(F.col("new_hash") != F.col("old_hash"), "modified")
        .when(~F.coalesce(F.col("new_time") == F.col("old_time"), F.lit(False)), "touched")
        .otherwise("clean")
    )
    return both.select("path", state.alias("state"))


def candidates(disk: DataFrame, index: DataFrame) -> DataFrame:
    """(path): the supported files of a walk whose text has to be read: not indexed, or with another or an unknown time."""
    old = index.select("path", F.col("mtime_nanos").alias("old_time"))
    same = (F.col("mtime_nanos") == F.col("old_time")) & (F.col("mtime_nanos") != 0)
    return disk.where("supported").join(old, "path", "left").where(~F.coalesce(same, F.lit(False))).select("path")


def upsert_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files after writing ``changed`` (path, hash, lang, size_bytes, mtime_nanos, indexed_at); known paths keep their id.

    The parse quality of a changed file is 'complete' until its parser says otherwise.  New ids are a hash of the path.
    """
    new = changed.select("path", *[F.col(c).alias(f"_{c}") for c in ("hash", "lang", "size_bytes", "mtime_nanos", "indexed_at")], F.lit(True).alias("_new"))
    both = files.join(new, "path", "full_outer")
    is_new = F.col("_new").isNotNull()
    values = {c: F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("hash", "lang", "size_bytes", "mtime_nanos", "indexed_at")}
    values["file_id"] = F.coalesce("file_id", F.xxhash64("path"))
    values["parse_quality"] = F.when(is_new, F.lit("complete")).otherwise(F.col("parse_quality"))
    return both.withColumns(values).select(*files.columns)


def touched_files(files: DataFrame, times: DataFrame) -> DataFrame:
    """Files with the times of ``times`` (path, mtime_nanos) where it has their path."""
    new = times.select("path", F.col("mtime_nanos").alias("_t"))
    return files.join(new, "path", "left").withColumn("mtime_nanos", F.coalesce("_t", "mtime_nanos")).select(*files.columns)


def replaced_chunks(chunks: DataFrame, changed_files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Chunks after re-parsing: those of changed or deleted files (file_id) give way to ``parsed``."""
    return chunks.join(changed_files.select("file_id"), "file_id", "left_anti").select(*chunks.columns).unionByName(parsed.select(*chunks.columns))


def purged(files: DataFrame, chunks: DataFrame, refs: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the files of ``paths`` (path), their chunks and their references."""
    gone = files.join(paths.select("path"), "path", "left_semi").select("file_id")
    lost = chunks.join(gone, "file_id", "left_semi").select("chunk_id")
    return files.join(paths.select("path"), "path", "left_anti").select(*files.columns), chunks.join(gone, "file_id", "left_anti").select(*chunks.columns), refs.join(lost, "chunk_id", "left_anti").select(*refs.columns)


def counters(states: DataFrame) -> DataFrame:
    """(state, files) of a classification."""
    return states.groupBy("state").agg(F.count("*").alias("files"))


def key_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(change, kind, ident, parent): symbols that appear or vanish between two versions of the chunks."""
    keys = ["kind", "ident", "parent"]
    a, b = (d.select(*keys).distinct() for d in (before, after))
    return b.subtract(a).select(F.lit("added").alias("change"), *keys).unionByName(a.subtract(b).select(F.lit("removed").alias("change"), *keys))
