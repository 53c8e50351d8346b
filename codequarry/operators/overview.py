"""Overviews of an index: statistics, per-file summaries, the directory tree.  None of them reads chunk contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from codequarry.functions import columns as C


def stats(files: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(files, chunks, refs, total_bytes), one row."""
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    return a.join(chunks.agg(F.count("*").alias("chunks"))).join(refs.agg(F.count("*").alias("refs"))).select("files", "chunks", "refs", "total_bytes")


def by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("lang").agg(F.count("*").alias("files"))


def time_range(files: DataFrame) -> DataFrame:
    return files.agg(F.min("indexed_at").alias("oldest"), F.max("indexed_at").alias("newest"))


def incomplete(files: DataFrame) -> DataFrame:
    return files.where("parse_quality <> 'complete'").select("path", "lang", "parse_quality")


def scoped(files: DataFrame, prefix: str | None = None) -> DataFrame:
    """Rows whose path starts with ``prefix`` (case-sensitive; no wildcards); all rows without one."""
    return files if prefix is None else files.where(F.col("path").startswith(prefix))


def scoped_size(files: DataFrame, prefix: str | None = None) -> DataFrame:
    return scoped(files, prefix).agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def _symbols(shown: Column) -> Column:
    ordered = F.sort_array(F.collect_list(F.when(shown, F.struct("start_line", "kind", "ident"))))
    return F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["ident"], s["start_line"].cast("string")))


def peek(files: DataFrame, chunks: DataFrame, prefix: str | None = None) -> DataFrame:
    """(path, lang, line_count, symbols): every file with its symbols as kind:ident:line in order of lines."""
    per_file = chunks.groupBy("file_id").agg(F.max("end_line").alias("last"), _symbols(F.lit(True)).alias("symbols"))
    return scoped(files, prefix).join(per_file, "file_id", "left").select("path", "lang", F.coalesce("last", F.lit(0)).alias("line_count"), F.coalesce("symbols", F.array()).alias("symbols"))


def kind_histogram(chunks: DataFrame) -> DataFrame:
    """(file_id, kinds): 'n kind' of each kind, joined by commas, in order of kinds."""
    counted = chunks.groupBy("file_id", "kind").agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("kind", "n")))
    return counted.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda s: F.concat_ws(" ", s["n"].cast("string"), s["kind"])), ", ").alias("kinds"))


def map_overview(files: DataFrame, chunks: DataFrame, prefix: str | None = None) -> DataFrame:
    """(path, lang, line_count, public, kinds)."""
    public = _symbols(C.is_public("visibility"))
    per_file = chunks.groupBy("file_id").agg(F.max("end_line").alias("last"), public.alias("public"))
    joined = scoped(files, prefix).join(per_file, "file_id", "left").join(kind_histogram(chunks), "file_id", "left")
    return joined.select("path", "lang", F.coalesce("last", F.lit(0)).alias("line_count"), F.coalesce("public", F.array()).alias("public"), F.coalesce("kinds", F.lit("")).alias("kinds"))


def tree(files: DataFrame, prefix: str | None = None) -> DataFrame:
    """(path, parent, depth, name, is_dir): the nodes of the directory tree, as a flat adjacency table."""
    parts = F.split("path", "/")
    rows = scoped(files, prefix).select("path", parts.alias("parts"))
    nodes = rows.select("parts", F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("depth"))
    return nodes.select(
        F.array_join(F.slice("parts", 1, F.col("depth")), "/").alias("path"),
        F.when(F.col("depth") > 1, F.array_join(F.slice("parts", 1, F.col("depth") - 1), "/")).alias("parent"),
        "depth", F.element_at("parts", F.col("depth")).alias("name"), (F.col("depth") < F.size("parts")).alias("is_dir"),
    ).distinct()


def summarise(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, lang, line_count, symbols, public, description): what a file holds, in a sentence."""
    public = F.count_if(C.is_public("visibility"))
    per_file = chunks.groupBy("file_id").agg(F.max("end_line").alias("last"), F.count("*").alias("symbols"), public.alias("public"))
    joined = files.join(per_file, "file_id", "left").join(kind_histogram(chunks), "file_id", "left")
    n, p = F.coalesce("symbols", F.lit(0)), F.coalesce("public", F.lit(0))
    text = F.concat(F.col("lang"), F.lit(" file with "), F.coalesce("kinds", F.lit("no symbols")), F.lit("; "), p.cast("string"), F.lit(" public"))
    return joined.select("path", "lang", F.coalesce("last", F.lit(0)).alias("line_count"), n.alias("symbols"), p.alias("public"), text.alias("description"))


def render_tree(nodes: list[tuple[str, str | None, int, str, bool]]) -> str:
    """An indented listing of rows of ``tree``; folders end in a slash."""
    children: dict[str | None, list] = {}
    for node in nodes:
        children.setdefault(node[1], []).append(node)

    def render(parent: str | None) -> list[str]:
        out = []
        for path, _, depth, name, is_dir in sorted(children.get(parent, []), key=lambda n: n[3]):
            out += ["  " * (depth - 1) + name + "/" * is_dir, *render(path)]
        return out

    return "\n".join(render(None))
