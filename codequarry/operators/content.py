"""Texts of files: partitions, sections, pages, comparison with the index."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from codequarry.functions import columns as C

DEFAULT_LINES = 50


def numbered_lines(sources: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, i, line): lines from 0; texts without a line have no row."""
    return sources.select(F.col(key), F.posexplode(C.lines(text)).alias("i", "line"))


def _joined(ordered: Column) -> Column:
    return F.array_join(F.transform(F.sort_array(ordered), lambda s: s["line"]), "\n")


def partition_uniform(sources: DataFrame, size: int, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, index, start_line, end_line, content, tokens): every ``size`` lines; no text, no partitions.

    The lines are cut within the row, so nothing is shuffled and each row carries its own lines only.
    """
    if size < 1:
        raise ValueError("a partition needs at least one line")
    lines = sources.select(F.col(key), C.lines(text).alias("lines")).where(F.size("lines") > 0)
    count = F.floor((F.size("lines") - 1) / size).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), count), lambda i: F.struct(i.alias("index"), F.slice("lines", i * size + 1, F.lit(size)).alias("cut")))
    out = lines.select(key, F.explode(cuts).alias("p")).select(key, "p.index", (F.col("p.index") * size + 1).alias("start_line"), "p.cut")
    content = F.array_join("cut", "\n")
    return out.select(key, "index", "start_line", (F.col("start_line") + F.size("cut") - 1).alias("end_line"), content.alias("content"), C.text_tokens(F.octet_length(content)).alias("tokens"))


def partition_keyword(sources: DataFrame, pattern: str, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, index, start_line, end_line, content, tokens): each matching line alone, the runs between them together."""
    re.compile(pattern)
    rows = numbered_lines(sources, key, text).withColumn("hit", F.col("line").rlike(pattern))
    order = Window.partitionBy(key).orderBy("i")
    starts = (F.col("hit") | F.coalesce(F.lag("hit").over(order), F.lit(False))).cast("int")
    island = F.sum(F.when(F.col("i") == 0, 0).otherwise(starts)).over(order)
    grouped = rows.select(key, "i", "line", island.alias("index")).groupBy(key, "index")
    out = grouped.agg((F.min("i") + 1).alias("start_line"), (F.max("i") + 1).alias("end_line"), _joined(F.collect_list(F.struct("i", "line"))).alias("content"))
    return out.select(key, F.col("index").cast("int").alias("index"), "start_line", "end_line", "content", C.text_tokens(F.octet_length("content")).alias("tokens"))


def partition_semantic(files: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, index, start_line, end_line, tokens): the indexed chunks of each file, else uniform partitions."""
    order = Window.partitionBy("file_id").orderBy("start_line", "end_line", "chunk_id")
    own = chunks.select("file_id", "chunk_id", "start_line", "end_line", C.text_tokens(F.octet_length("content")).alias("tokens")).join(files.select("file_id"), "file_id", "left_semi")
    own = own.withColumn("index", F.row_number().over(order) - 1).select("file_id", "index", "start_line", "end_line", "tokens")
    bare = sources.join(files.select("file_id"), "file_id", "left_semi").join(chunks.select("file_id"), "file_id", "left_anti")
    return own.unionByName(partition_uniform(bare, DEFAULT_LINES).select("file_id", "index", "start_line", "end_line", "tokens"))


def partition(strategy: str, files: DataFrame, chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """By a strategy's name: semantic, uniform:N or keyword:PATTERN."""
    name, _, argument = strategy.partition(":")
    if name == "semantic" and not argument:
        return partition_semantic(files, chunks, sources)
    if name == "uniform" and argument.isdigit():
        return partition_uniform(sources, int(argument))
    if name == "keyword" and argument:
        return partition_keyword(sources, argument)
    raise ValueError(f"unknown partition strategy: {strategy}")


def markdown_sections(sources: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, ident, level, start_line, end_line, parent): one row per heading line, up to the line before the next heading.

    A line whose first non-blank character is ``#`` and that has a text is a heading, in code blocks too.  The parent is the nearest
    earlier heading of a lower level.  A text without headings is one section ``(document)``; blank texts have none.
    """
    split = sources.select(F.col(key), C.lines(text).alias("lines"), F.length(F.trim(F.regexp_replace(text, r"\s", ""))).alias("ink"))
    line = F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), F.length(F.regexp_extract(F.trim(x), "^(#*)", 1)).alias("level"), F.trim(F.regexp_replace(F.trim(x), "^#+", "")).alias("ident")))
    heads = F.filter(line, lambda s: (s["level"] > 0) & (s["ident"] != ""))
    marked = split.select(key, "ink", F.size("lines").alias("n"), heads.alias("heads"))
    # ends and parents are found within the row, so an exploded row carries its own heading only
    def placed(h: Column, k: Column) -> Column:
        above = F.filter(F.slice("heads", F.lit(1), k), lambda s: s["level"] < h["level"])
        end = F.coalesce(F.get("heads", k + 1)["at"] - 1, F.col("n"))
        return F.struct(h["ident"].alias("ident"), h["level"].alias("level"), h["at"].alias("start_line"), end.alias("end_line"), F.try_element_at(above, F.lit(-1))["ident"].alias("parent"))

    out = marked.select(key, F.explode(F.transform("heads", placed)).alias("h")).select(key, "h.*")
    whole = marked.where((F.size("heads") == 0) & (F.col("ink") > 0)).select(key, F.lit("(document)").alias("ident"), F.lit(0).alias("level"), F.lit(1).alias("start_line"), F.col("n").alias("end_line"), F.lit(None).cast("string").alias("parent"))
    return out.unionByName(whole)


def pages(texts: DataFrame, key: str, text: str, separator: str = "\f") -> DataFrame:
    """(key, ident, number, start_char, content): the non-blank pages of a text; blank ones are counted but left out."""
    parts = F.split(text, re.escape(separator))
    # offsets are summed up once in the row; an exploded row carries its own page only
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = F.aggregate(parts, nothing, lambda a, p: F.struct((a["at"] + F.length(p) + len(separator)).alias("at"), F.array_append(a["starts"], a["at"]).alias("starts")), lambda a: a["starts"])
    each = texts.select(F.col(key), F.posexplode(F.arrays_zip(parts.alias("content"), step.alias("before"))).alias("k", "p")).select(key, "k", "p.content", "p.before")
    before = F.col("before")
    out = each.select(key, F.concat(F.lit("Page "), (F.col("k") + 1).cast("string")).alias("ident"), (F.col("k") + 1).alias("number"), before.alias("start_char"), "content")
    return out.where(F.length(F.trim(F.regexp_replace("content", r"\s", ""))) > 0)


def document_chunks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ident, end_line): a plain text as one section; blank texts have none."""
    full = texts.where(F.length(F.trim(F.regexp_replace(text, r"\s", ""))) > 0)
    return full.select(key, F.lit("(document)").alias("ident"), F.size(C.lines(text)).alias("end_line"))


def json_entries(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, value): the top-level entries of a JSON object; other texts have none."""
    names = F.json_object_keys(F.col(text))
    each = rows.select(F.col(key), F.col(text).alias("_t"), F.explode(names).alias("path"))
    parsed = F.from_json("_t", "map<string,string>")
    return each.select(key, "path", F.element_at(parsed, F.col("path")).alias("value"))


def diff_files(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(path, changed): whether the text at hand differs from the indexed hash; a text that is not indexed is changed."""
    now = sources.select("file_id", C.file_hash("content").alias("now"))
    return files.select("file_id", "path", "hash").join(now, "file_id", "left").select("path", (~F.coalesce(F.col("now") == F.col("hash"), F.lit(False))).alias("changed"))


def diff_symbols(chunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(chunk_id, changed): whether the same lines of the file's text, trimmed, still hold the indexed content."""
    was = C.file_hash(F.trim(F.regexp_replace("content", "\r\n", "\n")))
    spans = chunks.where("content IS NOT NULL").select("file_id", F.struct("chunk_id", "start_line", "end_line", was.alias("was")).alias("c"))
    per_file = spans.groupBy("file_id").agg(F.collect_list("c").alias("chunks"))  # so each text is sent once, not once a chunk
    each = per_file.join(sources.select("file_id", C.lines("content").alias("lines")), "file_id").select("lines", F.explode("chunks").alias("c"))
    cut = F.slice("lines", F.greatest(F.col("c.start_line"), F.lit(1)), F.greatest(F.col("c.end_line") - F.col("c.start_line") + 1, F.lit(0)))
    now = C.file_hash(F.trim(F.array_join(cut, "\n")))
    return each.select("c.chunk_id", (now != F.col("c.was")).alias("changed"))


def preview(text: str, line: int | None = None, count: int = 10) -> str:
    """At most ``count`` lines of a text around a line (from 1), or its last ones."""
    lines = text.splitlines()
    start = max(0, len(lines) - count) if line is None else max(0, min(line - 1 - count // 2, len(lines) - count))
    return "\n".join(lines[start : start + count])
