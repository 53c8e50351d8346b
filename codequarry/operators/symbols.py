"""Symbols and references: who refers to what, from where, and what it is."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from codequarry.functions import columns as C


def refs_in_context(files: DataFrame, chunks: DataFrame, refs: DataFrame, symbol: str | None = None) -> DataFrame:
    """(target_ident, path, in_symbol, ref_kind, line, col): references with the symbol and file they stand in.

    Only key and name columns of the three tables are read; the filter on the target reaches the scan.
    """
    wanted = refs if symbol is None else refs.where(F.col("target_ident") == symbol)
    inner = wanted.select("chunk_id", "target_ident", "ref_kind", "line", "col").join(chunks.select("chunk_id", "file_id", F.col("ident").alias("in_symbol")), "chunk_id")
    return inner.join(files.select("file_id", "path"), "file_id").select("target_ident", "path", "in_symbol", C.ref_kind("ref_kind").alias("ref_kind"), "line", "col")


def impact(files: DataFrame, chunks: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(file, in_symbol, line, ref_kind): one hop of everything that refers to ``symbol``."""
    return refs_in_context(files, chunks, refs, symbol).select(F.col("path").alias("file"), "in_symbol", "line", "ref_kind")


def callers(files: DataFrame, chunks: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(caller, path, line): containing symbols of all references, repeated as often as they refer."""
    return refs_in_context(files, chunks, refs, symbol).select(F.col("in_symbol").alias("caller"), "path", "line")


def callees(chunks: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(callee): distinct call targets of all chunks named ``symbol``."""
    own = chunks.where(F.col("ident") == symbol).select("chunk_id")
    return refs.where(C.ref_kind("ref_kind") == "call").join(own, "chunk_id", "left_semi").select(F.col("target_ident").alias("callee")).distinct()


def context(chunks: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(symbol, signatures, caller_count, callees, file_count), one row."""
    own = chunks.where(F.col("ident") == symbol)
    facts = own.agg(F.sort_array(F.collect_set("signature")).alias("signatures"), F.countDistinct("file_id").alias("file_count"))
    count = refs.where(F.col("target_ident") == symbol).agg(F.count("*").alias("caller_count"))
    called = callees(chunks, refs, symbol).agg(F.sort_array(F.collect_set("callee")).alias("callees"))
    return facts.join(count).join(called).select(F.lit(symbol).alias("symbol"), "signatures", "caller_count", "callees", "file_count")


def signatures(chunks: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(chunk_id, signature, ref_count)."""
    count = refs.where(F.col("target_ident") == symbol).agg(F.count("*").alias("ref_count"))
    return chunks.where((F.col("ident") == symbol) & F.col("signature").isNotNull()).select("chunk_id", "signature").join(count)


def dependencies(files: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(path, imports): the distinct imports of every file that has any, sorted."""
    imports = refs.where("ref_kind = 'import'").select("chunk_id", "target_ident").join(chunks.select("chunk_id", "file_id"), "chunk_id")
    per_file = imports.groupBy("file_id").agg(F.sort_array(F.collect_set("target_ident")).alias("imports"))
    return per_file.join(files.select("file_id", "path"), "file_id").select("path", "imports")


def definitions(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ident, chunk_id, file_id, start_line): of several definitions of a name, the one to show.

    Files below src/ come first, then others, then tests and fixtures, then unknown files; ties go to the least file and line.
    """
    path = F.col("path")
    rank = F.when(path.startswith("src/"), 0).when(path.contains("fixtures") | path.contains("test"), 2).when(path.isNotNull(), 1).otherwise(3)
    ranked = chunks.select("ident", "chunk_id", "file_id", "start_line").join(files.select("file_id", "path"), "file_id", "left")
    best = F.min(F.struct(rank.alias("rank"), "file_id", "start_line", "chunk_id"))
    return ranked.groupBy("ident").agg(best.alias("b")).select("ident", "b.chunk_id", "b.file_id", "b.start_line")


def read_symbol(files: DataFrame, chunks: DataFrame, symbol: str, path: str | None = None, parent: str | None = None) -> DataFrame:
    """The chunks named ``symbol``: those in ``path`` and ``parent`` if any, else those with that parent anywhere, else all of that name."""
    named = chunks.where(F.col("ident") == symbol)
    placed = named
    if path is not None:
        placed = named.join(files.where(F.col("path") == path).select("file_id"), "file_id", "left_semi").select(*chunks.columns)
    if parent is not None:
        placed = placed.where(F.col("parent") == parent)
    if not placed.isEmpty():
        return placed
    elsewhere = named if parent is None else named.where(F.col("parent") == parent)
    if elsewhere.isEmpty():
        raise LookupError(f"symbol not found: {symbol}")
    return elsewhere


def sections(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, first, total): per file the first ten headings in order, and how many there are."""
    heads = chunks.where(F.col("kind").isin("section", "page")).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start_line", "ident"))).alias("all"))
    return heads.join(files.select("file_id", "path"), "file_id").select("path", F.transform(F.slice("all", 1, 10), lambda s: s["ident"]).alias("first"), F.size("all").alias("total"))


def scope(files: DataFrame, chunks: DataFrame, line: int) -> DataFrame:
    """(path, containing, visible): per file the symbols around ``line`` and those begun by it, in order."""
    begun = chunks.where(F.col("start_line") <= line).select("file_id", "start_line", "end_line", "kind", "ident")
    order = F.struct("start_line", "kind", "ident")
    around = F.sort_array(F.collect_list(F.when(F.col("end_line") >= line, order)))
    per_file = begun.groupBy("file_id").agg(around.alias("a"), F.sort_array(F.collect_list(order)).alias("v"))
    out = per_file.join(files.select("file_id", "path"), "file_id")
    return out.select("path", F.transform("a", lambda s: s["ident"]).alias("containing"), F.transform("v", lambda s: F.concat_ws(":", s["kind"], s["ident"])).alias("visible"))


def similar(chunks: DataFrame, target: str, file_id: int | None = None, distance: int = 3, limit: int = 5) -> DataFrame:
    """(symbol, distance): names of functions within an edit distance of ``target``, nearest first; its own name and file are left out.

    Lengths are compared before distances, and names are made distinct before either.
    """
    rows = chunks.where(F.col("kind").isin("fn", "method") & (F.col("ident") != target) & (F.abs(F.length("ident") - len(target)) <= distance))
    if file_id is not None:
        rows = rows.where(F.col("file_id") != file_id)
    names = rows.select(F.col("ident").alias("symbol")).distinct().select("symbol", F.levenshtein("symbol", F.lit(target), distance).alias("distance"))
    return names.where("distance >= 0").orderBy("distance", "symbol").limit(limit)


def file_sizes(files: DataFrame, chunks: DataFrame, refs: DataFrame, symbol: str) -> DataFrame:
    """(files, total_bytes): the distinct files that define or refer to ``symbol``."""
    defining = chunks.where(F.col("ident") == symbol).select("file_id")
    referring = refs.where(F.col("target_ident") == symbol).select("chunk_id").join(chunks.select("chunk_id", "file_id"), "chunk_id").select("file_id")
    return files.join(defining.union(referring).distinct(), "file_id", "left_semi").agg(F.count("*").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


#: Lines of a file that are joined as one.
STRETCH = 128


def innermost(chunks: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``places`` (file_id, line, ...) with ``chunk_id`` of the innermost chunk around their line; rows in no chunk are dropped.

    Joined on the file and the stretch of ``STRETCH`` lines, with the interval as a filter, so a place of a large file meets the chunks of
    its stretch only; of several chunks the latest start wins, then the greatest chunk_id.  The winner is taken by a partial aggregate, not by
    sorting the candidates.
    """
    stretches = F.sequence(F.floor(F.col("start_line") / STRETCH).cast("int"), F.floor(F.col("end_line") / STRETCH).cast("int"))
    spans = chunks.where("end_line >= start_line").select("file_id", "start_line", "end_line", "chunk_id").distinct().withColumn("_stretch", F.explode(stretches))
    keyed = places.withColumn("_row", F.struct(*places.columns)).withColumn("_stretch", F.floor(F.col("line") / STRETCH).cast("int"))
    met = keyed.join(spans, ["file_id", "_stretch"]).where("line BETWEEN start_line AND end_line")
    best = met.groupBy("_row").agg(F.max(F.struct("start_line", "chunk_id"))["chunk_id"].alias("chunk_id"))
    return best.select("_row.*", "chunk_id")
