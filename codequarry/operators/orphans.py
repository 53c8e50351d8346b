"""References to records that do not exist.

Keys may be composite and partly null.  The references are grouped by their null mask, and each mask is anti-joined
on its non-null columns, as the declared match says (the three matches of the SQL standard):

* ``simple``: a reference with any null column is satisfied;
* ``partial``: the non-null columns must agree with some parent; all null is satisfied;
* ``full``: all null is satisfied; a mix of null and non-null is an orphan at once.

A key that holds a large part of the references would put all of them into one task of a shuffled join.  The heaviest
keys are therefore found by a top-k sketch over all rows (map-side, a few KB of shuffle) and settled by a broadcast of at
most ``HOT_KEYS`` parent keys; all other references go through the shuffled anti-join.  The sketch only chooses the way
a row is settled, never its result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: The most keys that are settled by broadcast; their size is bounded by this number.
HOT_KEYS = 64
_SKETCH = 4096


def hot_keys(df: DataFrame, key: Column, most: int = HOT_KEYS) -> list:
    """Values of ``key`` that hold at least a thousandth of the non-null rows by the sketch's estimate; at most ``most``."""
    rows = df.select(key.alias("_key")).where("_key IS NOT NULL")
    row = rows.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(_key, {most}, {_SKETCH})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] * 1000 >= row["n"] and x["count"] > 10_000]


def _anti(child: DataFrame, parent: DataFrame, columns: list[str], spread: bool) -> DataFrame:
    """Rows of child without a parent that agrees on ``columns`` (all non-null).

    Composite keys are weighed by their hash; the join is on the columns themselves, so a collision costs nothing but its way.
    """
    parent = parent.select(*columns)
    key = F.col(columns[0]) if len(columns) == 1 else F.xxhash64(*columns)
    hot = hot_keys(child, key) if spread else []
    if not hot:
        return child.join(parent, columns, "left_anti")
    is_hot = key.isin(hot)
    few = F.broadcast(parent.where(is_hot).distinct())
    return child.where(is_hot).join(few, columns, "left_anti").unionByName(child.where(~is_hot).join(parent.where(~is_hot), columns, "left_anti"))


def orphans(child: DataFrame, parent: DataFrame, columns: list[str], match: str = "simple", spread: bool = True) -> DataFrame:
    """The rows of ``child`` whose key ``columns`` name no row of ``parent`` (same column names there).

    Parents with a null in a needed column never match.  Empty parents make every checked reference an orphan; an empty
    child gives an empty result; repeated parents count once, repeated references stay repeated.
    """
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match: {match}")
    parts = []
    for mask in range(1, 2 ** len(columns)):  # the all-null mask (0) is satisfied under every match
        present = [c for i, c in enumerate(columns) if mask >> i & 1]
        if match == "simple" and len(present) < len(columns):
            continue
        rows = child.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() if c in present else F.col(c).isNull() for c in columns]))
        if match == "full" and len(present) < len(columns):
            parts.append(rows)
            continue
        usable = parent.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in present]))
        parts.append(_anti(rows, usable, present, spread).select(*child.columns))
    return reduce(DataFrame.unionByName, parts) if parts else child.limit(0)


def live(rows: DataFrame, purges: DataFrame, rel: str, id_column: str) -> DataFrame:
    """The ids of ``rows`` that no purge of ``rel`` at or after their ``indexed_at`` removed (any surviving row keeps an id).

    A null ``indexed_at`` is older than every purge; a null ``purged_at`` or ``row_id`` purges nothing.
    """
    last = purges.where(F.col("rel") == rel).groupBy(F.col("row_id").alias(id_column)).agg(F.max("purged_at").alias("purged_at"))
    kept = rows.select(id_column, "indexed_at").where(F.col(id_column).isNotNull()).join(last, id_column, "left")
    return kept.where(F.col("purged_at").isNull() | (F.col("indexed_at") > F.col("purged_at"))).select(id_column)


def index_orphans(files: DataFrame, chunks: DataFrame, refs: DataFrame, purges: DataFrame) -> DataFrame:
    """(rel, row_id, indexed_at): dangling chunks and refs of a code index, as they stand in the tables."""
    bad_chunks = orphans(chunks.select("chunk_id", "file_id", "indexed_at"), live(files, purges, "files", "file_id"), ["file_id"])
    bad_refs = orphans(refs.select("ref_id", "chunk_id", "indexed_at"), live(chunks, purges, "chunks", "chunk_id"), ["chunk_id"])
    return bad_chunks.select(F.lit("chunks").alias("rel"), F.col("chunk_id").alias("row_id"), "indexed_at").unionByName(
        bad_refs.select(F.lit("refs").alias("rel"), F.col("ref_id").alias("row_id"), "indexed_at")
    )


def parent_orphans(chunks: DataFrame, match: str = "partial") -> DataFrame:
    """(chunk_id, named): chunks whose (file_id, parent) names no chunk by (file_id, ident); ``named`` tells which of the two are not null.

    Both columns may be null: a parent without a file may lie in any, a file without a parent only has to have chunks.
    """
    rows = chunks.select("chunk_id", "file_id", "parent").distinct()
    held = chunks.select("file_id", F.col("ident").alias("parent")).distinct()
    named = F.when(F.col("file_id").isNull(), "parent").when(F.col("parent").isNull(), "file").otherwise("file, parent")
    return orphans(rows, held, ["file_id", "parent"], match).select("chunk_id", named.alias("named")).distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """(rel, day, orphans): distinct dangling rows per table and day of ``indexed_at``."""
    return found.select("rel", "row_id", F.to_date("indexed_at").alias("day")).distinct().groupBy("rel", "day").agg(F.count("*").alias("orphans"))
