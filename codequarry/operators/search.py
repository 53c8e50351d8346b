"""Ranked full-text search over chunks: postings with positions, BM25, top k.

An index is two tables, written once: postings, sorted by term over ranges of (term, key) so that a frequent word is many files and a
query reads its own words' row groups only, and the number of words of each chunk.  A query never reads a text but those of the chunks it
shows.  All units of a query are matched in one pass and combined by a bit mask per chunk, so the number of shuffles does not depend on the
query.  Without a written index the postings of the query's words are made from the texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codequarry.functions import textquery
from codequarry.functions.textquery import Unit

COLUMNS = ["ident", "signature", "doc_comment", "content"]
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(chunks: DataFrame, key: str = "chunk_id", columns: list[str] = COLUMNS, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """(term, key, field, pos): every word with the column it stands in and its place there.

    ``keep`` picks words within the row, before anything is exploded: a query without written postings makes rows of its own
    words only.
    """

    def placed(number: int, column: str) -> Column:
        all_ = F.transform(words(F.col(column)), lambda w, k: F.struct(F.lit(number).alias("field"), k.alias("pos"), w.alias("term")))
        return F.filter(all_, lambda s: keep(s["term"])) if keep else all_

    fields = [placed(i, c) for i, c in enumerate(columns)]
    each = chunks.select(F.col(key), F.explode(F.concat(*fields)).alias("p"))
    return each.select(key, "p.field", "p.pos", "p.term")


def _wanted(units: list[Unit]) -> Callable[[Column], Column]:
    """Whether a word is part of some unit."""
    whole = {w for u in units for w in (u.words[:-1] if u.prefix else u.words)}
    starts = {u.words[-1] for u in units if u.prefix}
    return lambda term: reduce(Column.__or__, [term.isin(sorted(whole)), *[term.startswith(p) for p in sorted(starts)]])


class SearchIndex:
    """(term, key, field, pos) and (key, n) of a corpus."""

    def __init__(self, postings: DataFrame, lengths: DataFrame):
        self.postings, self.lengths = postings, lengths


#: Answers of up to so many rows are broadcast to the chunks they show.
SMALL_ANSWER = 10_000


def write_index(chunks: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Write postings and lengths below ``path``; the number of files follows the shuffle setting of the session."""
    rows = postings(chunks, key)
    rows.repartitionByRange("term", key).sortWithinPartitions("term", key).write.parquet(f"{path}/postings")
    lengths(chunks, key).write.parquet(f"{path}/lengths")


def read_index(spark: SparkSession, path: str) -> SearchIndex:
    return SearchIndex(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def lengths(chunks: DataFrame, key: str = "chunk_id", columns: list[str] = COLUMNS) -> DataFrame:
    """(key, n): words of a chunk over all columns."""
    return chunks.select(F.col(key), reduce(Column.__add__, [F.size(words(F.col(c))) for c in columns]).alias("n"))


def _hits(index: DataFrame, units: list[Unit], key: str) -> DataFrame:
    """(unit, key, tf) of every unit, in one pass over the postings.

    Each posting goes to the places of units that its word fits; a unit stands where all its places are filled.  Rows are partitioned by
    chunk, which serves all the groupings.
    """
    places, wanted = [], {}
    for number, unit in enumerate(units):
        for i, word in enumerate(unit.words):
            fits = F.col("term").startswith(word) if unit.prefix and i == len(unit.words) - 1 else F.col("term") == word
            places.append(F.when(fits, F.struct(F.lit(number).alias("unit"), F.lit(i).alias("i"), F.lit(len(unit.words)).alias("size"))))
            wanted[str(fits)] = fits
    rows = index.where(reduce(Column.__or__, wanted.values())).repartition(key)
    each = rows.select(key, "field", "pos", F.explode(F.filter(F.array(*places), lambda p: p.isNotNull())).alias("p"))
    starts = each.select(key, "field", "p.unit", "p.i", "p.size", (F.col("pos") - F.col("p.i")).alias("start"))
    whole = starts.groupBy(key, "unit", "size", "field", "start").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("m")).where("m = shiftleft(1L, size) - 1")
    return whole.groupBy(key, "unit").agg(F.count("*").alias("tf")).select("unit", key, "tf")


def ranked(index: DataFrame, sizes: DataFrame, query: str, key: str = "chunk_id") -> DataFrame | None:
    """(key, score) of all matches, lower scores first in rank; None if the query asks nothing."""
    groups = textquery.parse(query)
    if not groups:
        return None
    units = list(dict.fromkeys(u for g in groups for u in g))
    hits = _hits(index, units, key)
    total = sizes.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    df = hits.groupBy("unit").agg(F.count("*").alias("df"))
    facts = F.broadcast(df.join(F.broadcast(total)))  # one row per unit of the query
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(0.0))
    idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    scored = hits.join(facts, "unit").join(sizes, key).groupBy(key)
    scored = scored.agg(F.sum(-weight).alias("score"), F.bit_or(F.expr("shiftleft(1L, unit)")).alias("mask"))
    masks = [sum(1 << units.index(u) for u in set(g)) for g in groups]
    return scored.where(reduce(Column.__or__, [F.col("mask").bitwiseAND(F.lit(m)) == m for m in masks])).select(key, "score")


def search(chunks: DataFrame, query: str, limit: int = 20, fields: str = "full", index: SearchIndex | None = None) -> DataFrame:
    """(chunk_id, file_id, kind, ident, start_line, end_line, score[, content]) of the best ``limit`` chunks, best first.

    ``fields`` is full or minimal (without content).  A query that asks nothing finds nothing.  Equal scores rank by chunk_id.
    """
    if fields not in ("full", "minimal"):
        raise ValueError(f"unknown fields mode: {fields}")
    shown = ["chunk_id", "file_id", "kind", "ident", "start_line", "end_line"] + ["content"] * (fields == "full")
    if index is None:
        index = SearchIndex(postings(chunks, keep=_wanted([u for g in textquery.parse(query) for u in g])), lengths(chunks))
    best = ranked(index.postings, index.lengths, query)
    if best is None:
        return chunks.select(*shown).withColumn("score", F.lit(0.0)).limit(0)
    score = F.round("score", 9)
    top = best.select("chunk_id", score.alias("score")).orderBy("score", "chunk_id").limit(limit)
    return (F.broadcast(top) if limit <= SMALL_ANSWER else top).join(chunks.select(*shown), "chunk_id").select(*shown, "score")


def search_summary(chunks: DataFrame, query: str, limit: int = 20, fields: str = "full", index: SearchIndex | None = None) -> DataFrame:
    """(hits, file_count, tokens) of a search's answer."""
    found = search(chunks, query, limit, fields, index)
    size = F.octet_length("content") if fields == "full" else F.lit(0)
    asked = -(-len(query.encode()) // 4)
    return found.agg(F.count("*").alias("hits"), F.countDistinct("file_id").alias("file_count"), (F.lit(asked) + F.floor(F.coalesce(F.sum(size), F.lit(0)) / 4)).cast("long").alias("tokens"))
