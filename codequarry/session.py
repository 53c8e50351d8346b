"""The programmatic interface: an index of files, chunks and references in a folder, and one method per command.

Every version of the three tables lies in a folder of its own attempt; a commit is a file named by the next number, put in place only if
that number is free, so a reader never sees half a refresh and of two writers one starts over.  Operations on symbols and files append
their token costs to the ledger; a failing ledger never fails them.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry import schema
from codequarry.functions import columns as C
from codequarry.operators import content, graph, overview, quality, refresh, savings, search, symbols
from codequarry.plans.workspace import FileStore, materialised, ship
from codequarry.sources import parsers, scan

#: Raised when a parser changes what it yields: every file is then parsed anew.
PARSER_VERSION = 1
_LEDGER = ["output_tokens", "alternative_tokens", "files_touched", "engine_input_tokens", "alt_input_tokens", "engine_calls", "alt_calls"]
_TABLES = {"files": schema.FILES, "chunks": schema.CHUNKS, "refs": schema.REFS}


class Conflict(RuntimeError):
    """Another writer has committed since this one read the index."""


class Index:
    """Tables below ``root`` (shared storage): ``<folder>/files|chunks|refs``, ``commits/<number>.json``, ``savings``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._store = spark, root.rstrip("/"), FileStore(spark, root)
        ship(spark)

    # ---- storage ----

    def pointer(self) -> dict:
        """The last commit; the file CURRENT is a hint where to look, commits behind it are found by their number."""
        found = self._commit_of(int(self._store.read_text("CURRENT") or 0))
        while later := self._commit_of((found["version"] if found else 0) + 1):
            found = later
        return found or {"version": 0, "folder": None, "schema": schema.SCHEMA_VERSION, "parser": PARSER_VERSION}

    def _commit_of(self, number: int) -> dict | None:
        text = self._store.read_text(f"commits/{number:09d}.json") if number else None
        return json.loads(text) if text else None

    def _table(self, name: str) -> DataFrame:
        folder = self.pointer()["folder"]
        if not folder:
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.root}/{folder}/{name}")

    files = property(lambda self: self._table("files"))
    chunks = property(lambda self: self._table("chunks"))
    refs = property(lambda self: self._table("refs"))

    def commit(self, files: DataFrame, chunks: DataFrame, refs: DataFrame, based_on: int | None = None) -> int:
        """Write a version and make it the valid one; ``Conflict`` if the index is not at ``based_on`` (where given) any more."""
        at = self.pointer()
        version = (at["version"] if based_on is None else based_on) + 1
        folder = f"v{version:06d}-{uuid.uuid4().hex}"
        for name, df in (("files", files), ("chunks", chunks), ("refs", refs)):
            names = [part.split()[0] for part in _TABLES[name].split(", ")]
            df.select(*names).write.parquet(f"{self.root}/{folder}/{name}")
        if not self._store.create_text(f"commits/{version:09d}.json", json.dumps(at | {"version": version, "folder": folder, "parser": PARSER_VERSION})):
            self._store.remove(folder)
            raise Conflict(f"version {version} has been committed by another writer")
        self._store.replace_text("CURRENT", str(version))
        return version

    # ---- writing ----

    def index(self, source: str, walk_had_errors: bool = False, progress: Callable[[str, int], None] | None = None) -> DataFrame:
        """Bring the index up to the tree at ``source``; (state, files).

        The tree is listed by ignore rules without reading it; only files that are new or have another time are read, and only those with
        another text are parsed.  Files that are there but too large or not UTF-8 count as 'failed' and keep their record.  ``progress`` is
        called with a stage and its number of files.
        """
        if refresh.skipped():
            return self.spark.createDataFrame([], "state string, files long")
        say = progress or (lambda stage, files: None)
        at, known = self.pointer(), self.files
        listed, failed = scan.tree(self.spark, source)
        disk = materialised(listed, "walk")
        say("listed", disk.count())
        if at["parser"] != PARSER_VERSION:
            known = known.withColumns({"hash": F.lit(""), "mtime_nanos": F.lit(0).cast("long")})
        texts = materialised(scan.contents(self.spark, source, refresh.candidates(disk, known)).drop("mtime_nanos").join(disk.select("path", "mtime_nanos"), "path"), "texts")
        say("read", texts.count())
        seen = disk.join(known.select("path", F.lit(True).alias("_known")), "path", "left").where(F.col("supported") | F.col("_known")).select("path", "mtime_nanos")
        states = materialised(refresh.classify(seen.join(texts.select("path", "hash"), "path", "left"), known, walk_had_errors or failed), "states")
        counts = materialised(refresh.counters(states), "counters")
        self._refresh(at["version"], states, texts, say)
        return counts

    def _refresh(self, based_on: int, states: DataFrame, texts: DataFrame, say: Callable[[str, int], None]) -> DataFrame:
        """Commit what the states of paths say; the parsed files."""
        work = texts.join(states.where("state IN ('added', 'modified')"), "path", "left_semi")
        touched = texts.join(states.where("state = 'touched'"), "path", "left_semi")
        files, chunks, refs = refresh.purged(self.files, self.chunks, self.refs, states.where("state = 'deleted'").select("path"))
        files = refresh.touched_files(files, touched)
        files = refresh.upsert_files(files, work.withColumn("indexed_at", F.current_timestamp()))
        parsed = materialised(parsers.parse_sources(work.join(files.select("path", "file_id"), "path").select("file_id", "lang", "content")), "parsed")
        say("parsed", parsed.count())
        quality_of = parsed.select("file_id", F.col("parse_quality").alias("_q"))
        files = files.join(quality_of, "file_id", "left").withColumn("parse_quality", F.coalesce("_q", "parse_quality")).drop("_q")
        changed = parsed.select("file_id")
        new = parsers.chunk_rows(parsed).withColumnRenamed("ui_ctx", "_ctx").join(files.select("file_id", C.ui_context("path").alias("_path_ctx")), "file_id")
        new = new.withColumn("ui_ctx", F.coalesce("_path_ctx", F.col("_ctx").cast("string"))).drop("_ctx", "_path_ctx")
        old_refs = refs.join(chunks.join(changed, "file_id", "left_semi").select("chunk_id"), "chunk_id", "left_anti").select(*refs.columns)
        self.commit(files, refresh.replaced_chunks(chunks, changed, new), old_refs.unionByName(parsers.ref_rows(parsed)), based_on)
        say("committed", parsed.count())
        return parsed

    def reindex_file(self, source: str, path: str, preview: bool = False, symbol: str | None = None) -> dict:
        """Index one file anew, whatever its time; {path, state, chunks, refs, parse_quality, symbols, preview}.

        The preview is up to ten lines around ``symbol``, or the last ones.  With ``preview`` nothing is committed.
        """
        at = self.pointer()
        known = self.files.where(F.col("path") == path).withColumn("mtime_nanos", F.lit(0).cast("long"))
        texts = materialised(scan.contents(self.spark, source, self.spark.createDataFrame([(path,)], "path string")), "texts")
        states = materialised(refresh.classify(texts.select("path", "hash", "mtime_nanos"), known), "states")
        row = states.first()
        if row is None:
            raise LookupError(f"no file {path} below {source}")
        if preview or row["state"] == "touched":
            rows = texts.join(self.files.select("path", "file_id"), "path", "left").select(F.coalesce("file_id", F.lit(0)).alias("file_id"), "lang", "content")
            parsed = materialised(parsers.parse_sources(rows), "parsed")
        else:
            parsed = self._refresh(at["version"], states, texts, lambda stage, files: None)
        chunks = parsers.chunk_rows(parsed).select("kind", "ident", "start_line").orderBy("start_line").collect()  # one file
        quality_of = parsed.select("parse_quality").first()
        return {
            "path": path, "state": row["state"], "chunks": len(chunks), "refs": parsers.ref_rows(parsed).count(),
            "parse_quality": quality_of[0] if quality_of else None, "symbols": [c["ident"] for c in chunks],
            "preview": content.preview(text[0], next((c["start_line"] for c in chunks if c["ident"] == symbol), None)) if (text := texts.select("content").first()) else None,
        }

    def verify(self, source: str, fix: bool = False) -> DataFrame:
        on_disk = scan.tree(self.spark, source)[0].where("supported").select("path")
        found = quality.verify(self.files, self.chunks, self.refs, on_disk)
        if fix:
            self.commit(*quality.repaired(self.files, self.chunks, self.refs, on_disk))
        return found

    def build_postings(self) -> None:
        """Write the search index of the valid version; searches read it from then on."""
        at = self.pointer()
        folder = f"{self.root}/search-{uuid.uuid4().hex}"
        search.write_index(self.chunks, folder)
        self._store.replace_text(f"search/{at['version']:09d}", folder)

    # ---- reading ----

    def search(self, query: str, limit: int = 20, fields: str = "full") -> DataFrame:
        folder = self._store.read_text(f"search/{self.pointer()['version']:09d}")
        return search.search(self.chunks, query, limit, fields, search.read_index(self.spark, folder) if folder else None)

    def overview(self, detail: str = "standard", path: str | None = None) -> DataFrame:
        if detail == "minimal":
            return overview.peek(self.files, self.chunks, path)
        if detail == "standard":
            return overview.map_overview(self.files, self.chunks, path)
        if detail == "tree":
            return overview.tree(self.files, path)
        raise ValueError(f"unknown detail: {detail}")

    def read(self, path: str | None = None, symbol: str | None = None, parent: str | None = None, section: str | None = None) -> DataFrame:
        if symbol is not None:
            return symbols.read_symbol(self.files, self.chunks, symbol, path, parent)
        if section is None:
            raise ValueError("a symbol or a section is needed")
        own = self.files.where(F.col("path") == path).select("file_id")
        heads = self.chunks.where(F.col("kind").isin("section", "page")).join(own, "file_id", "left_semi")
        found = heads.where(F.col("ident") == section).orderBy("start_line").limit(1)
        if found.isEmpty():
            known = [r["ident"] for r in heads.orderBy("start_line").limit(10).select("ident").collect()]
            raise LookupError(f"no section {section} in {path}; there are: {', '.join(known)}")
        return found

    def refs_to(self, symbol: str) -> DataFrame:
        return symbols.impact(self.files, self.chunks, self.refs, symbol)

    def context(self, symbol: str, graph: bool = False) -> DataFrame:
        bodies = self.chunks.where(F.col("ident") == symbol).agg(F.sort_array(F.collect_set(F.struct("file_id", "start_line", "kind", "content"))).alias("bodies"))
        found = symbols.context(self.chunks, self.refs, symbol).join(bodies)
        if not graph:
            return found
        callers = symbols.callers(self.files, self.chunks, self.refs, symbol)
        return found.join(callers.agg(F.sort_array(F.collect_list("caller")).alias("callers")))

    def metadata(self, symbol: str) -> DataFrame:
        """(ident, path, kind, signature, content, ref_count) of the definition to show."""
        best = symbols.definitions(self.files, self.chunks.where(F.col("ident") == symbol)).select("chunk_id")
        count = self.refs.where(F.col("target_ident") == symbol).agg(F.count("*").alias("ref_count"))
        return self.chunks.join(best, "chunk_id", "left_semi").join(self.files.select("file_id", "path"), "file_id").join(count).select("ident", "path", "kind", "signature", "content", "ref_count")

    def deps(self, path: str) -> DataFrame:
        own = self.files.where(F.col("path") == path)
        if own.isEmpty():
            raise LookupError(f"no file {path} in the index")
        return symbols.dependencies(own, self.chunks, self.refs)

    def scope(self, path: str, line: int) -> DataFrame:
        return symbols.scope(self.files.where(F.col("path") == path), self.chunks, line)

    def summarize(self, path: str) -> DataFrame:
        return overview.summarise(self.files.where(F.col("path") == path), self.chunks)

    def stats(self) -> DataFrame:
        return overview.stats(self.files, self.chunks, self.refs)

    def partition(self, source: str, path: str, strategy: str = "semantic") -> DataFrame:
        files = self.files.where(F.col("path") == path)
        texts = scan.contents(self.spark, source, files.select("path")).join(files.select("path", "file_id"), "path").select("file_id", "content")
        return content.partition(strategy, files, self.chunks.join(files.select("file_id"), "file_id", "left_semi"), texts)

    def diff(self, source: str, path: str | None = None, symbol: str | None = None) -> DataFrame:
        """(path, changed) of the indexed files, or (chunk_id, changed) of a symbol's chunks in a file."""
        if symbol is not None:
            own = self.files.where(F.col("path") == path)
            rows = self.chunks.where(F.col("ident") == symbol).join(own.select("file_id"), "file_id", "left_semi")
            if rows.isEmpty():
                raise LookupError(f"no symbol {symbol} in {path}")
            texts = scan.contents(self.spark, source, own.select("path")).join(own.select("path", "file_id"), "path").select("file_id", "content")
            return content.diff_symbols(rows, texts)
        texts = scan.contents(self.spark, source).join(self.files.select("path", "file_id"), "path").select("file_id", "content")
        return content.diff_files(self.files, texts)

    def test_impact(self, symbol: str, path: str) -> DataFrame:
        edges = materialised(graph.edges(self.files, self.chunks, self.refs), "edges")
        row = self.files.where(F.col("path") == path).select("lang").first()
        direct = graph.direct_tests(edges, symbol, path)
        transitive = graph.transitive_callers(edges, symbol).where("is_test")
        return graph.merge_tests(direct, transitive, graph.naming_tests(self.files, self.chunks, path, row["lang"] if row else ""))

    def analyse_tests(self, source: str, symbol: str, path: str) -> dict:
        """{tests, confirmed, warning, runner, command, similar}: what to run after a change of ``symbol`` in ``path``.

        ``confirmed`` counts the tests that refer to the symbol, directly or through others; the runner is told by the files at the root of
        a local tree; ``similar`` names up to five functions whose name is within three edits.
        """
        found = [r.asDict() for r in self.test_impact(symbol, path).orderBy("path", "symbol").limit(1000).collect()]
        confirmed = sum(r["strategy"] != "naming" for r in found)
        root = source.removeprefix("file://")
        names = {f"{folder}{n}" for folder in ("", ".config/") if "://" not in root and os.path.isdir(f"{root}/{folder}") for n in os.listdir(f"{root}/{folder}")}
        runner = graph.runner(names)
        similar = [r["symbol"] for r in symbols.similar(self.chunks, symbol, distance=3, limit=5).collect()]
        return {
            "tests": found, "confirmed": confirmed, "warning": graph.warning(confirmed, len(found) - confirmed), "runner": runner,
            "command": graph.command(runner, [(r["symbol"], r["path"]) for r in found]) if runner and found else None, "similar": similar,
        }

    # ---- ledger ----

    def record(self, command: str, output: int, alternative: int, files: int, own_input: int, other_input: int, own_calls: int, other_calls: int) -> None:
        """Append one row to the ledger."""
        row = self.spark.range(1).select(F.lit(command).alias("command"), *[F.lit(int(v)).cast("long").alias(n) for n, v in zip(_LEDGER, (output, alternative, files, own_input, other_input, own_calls, other_calls), strict=True)])
        row.withColumn("created_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/savings")

    def charge(self, command: str, output_bytes: int, path: str | None = None, symbol: str | None = None, fixed: int | None = None) -> None:
        """Record an operation by the cost rules of its kind: ``fixed`` as it is, else of a symbol, a file, or all files below a path."""
        try:
            own = F.lit(-(-output_bytes // 2))
            one = self.spark.range(1)
            size = self.files.where(F.col("path") == path).agg(F.max(C.read_cost(F.col("size_bytes"))).alias("cost"))
            if fixed is not None:
                row = one.select(F.lit(fixed).alias("tokens"), F.lit(1).alias("calls"), F.lit(0).alias("files"))
            elif command == "read" and symbol is not None:
                row = size.select(savings.read_symbol_cost(F.col("cost"), own).alias("tokens"), F.lit(2).alias("calls"), F.lit(1).alias("files"))
            elif symbol is not None:
                sizes = symbols.file_sizes(self.files, self.chunks, self.refs, symbol)
                row = savings.symbol_cost(sizes).withColumn("files", F.col("calls") - 1)
            elif path is not None and command not in ("overview", "files"):
                row = size.select(savings.file_or_own(F.col("cost"), own).alias("tokens"), F.lit(1).alias("calls"), F.lit(1).alias("files"))
            else:
                row = savings.scoped_cost(overview.scoped_size(self.files, path)).withColumn("files", F.col("calls") - 1)
                row = row.withColumn("tokens", savings.at_least(F.col("tokens"), own)) if command == "search" else row
            at = row.select(F.col("tokens").cast("long"), F.col("calls").cast("long"), F.col("files").cast("long"), own.cast("long").alias("own")).first()
            self.record(command, at["own"], at["tokens"], at["files"], 0, 0, 1, at["calls"])
        except Exception:  # noqa: BLE001 - a failing ledger must not fail the operation
            return

    def charge_edit(self, kind: str, size: int, old: int, new: int, output_bytes: int) -> None:
        """Record an edit of a file that has ``size`` bytes after it, by the bytes taken out and put in."""
        try:
            inputs, outputs, calls = savings.write_cost(kind, F.lit(size), F.lit(old), F.lit(new))
            at = self.spark.range(1).select(inputs.cast("long").alias("i"), outputs.cast("long").alias("o"), calls.cast("long").alias("c")).first()
            self.record(kind, -(-output_bytes // 2), at["o"], 1, -(-new // 4), at["i"], 1, at["c"])
        except Exception:  # noqa: BLE001 - a failing ledger must not fail the operation
            return

    def savings(self, since: str | None = None) -> DataFrame:
        return savings.report(self.spark.read.schema(schema.SAVINGS).parquet(f"{self.root}/savings"), since)
