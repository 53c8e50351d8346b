"""Queries of the code-index operators over the test tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry.functions import columns as C
from codequarry.operators import content, graph, overview, quality, refresh, savings, search, symbols
from codequarry.plans.workspace import FileStore, materialised, new_folder, spread
from codequarry.sources import parsers
from codequarry.streaming import refresh as streaming

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """The tables of a folder, read on demand."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def target(self) -> str:
        """The name with the most references (ties: the least name)."""
        row = self.refs.groupBy("target_ident").count().orderBy(F.desc("count"), "target_ident").first()
        return row[0] if row else ""

    def owner(self) -> str:
        """The name of the chunk that refers most (ties: the least chunk)."""
        counted = self.refs.where("chunk_id IS NOT NULL").groupBy("chunk_id").count().join(self.chunks.select("chunk_id", "ident"), "chunk_id")
        row = counted.orderBy(F.desc("count"), "chunk_id").first()
        return row["ident"] if row else ""


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = lambda spark, folder: function(Tables(spark, folder))
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


_TARGET = "(SELECT target_ident FROM refs GROUP BY target_ident ORDER BY count(*) DESC, target_ident LIMIT 1)"
_OWNER = """(SELECT ident FROM chunks JOIN (SELECT chunk_id, count(*) AS n FROM refs WHERE chunk_id IS NOT NULL GROUP BY chunk_id) USING (chunk_id) ORDER BY n DESC, chunk_id LIMIT 1)"""
_LINES = """CASE WHEN split({0}, chr(10))[-1] = '' THEN split({0}, chr(10))[:-2] ELSE split({0}, chr(10)) END"""


def _lines(column: str) -> str:
    return _LINES.format(f"replace({column}, chr(13) || chr(10), chr(10))")


# ---- scans ----


@query("SELECT file_id, sha256(content) AS hash, strlen(content) AS size_bytes FROM sources")
def scan_files_hash(t: Tables) -> DataFrame:
    return t.sources.select("file_id", C.file_hash("content").alias("hash"), F.octet_length("content").alias("size_bytes"))


@query("""SELECT path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, coalesce(m.lang, 'unknown') AS mapped FROM files f
LEFT JOIN lang_map m ON m.ext = lower(regexp_extract(path, '\\.([^./]+)$', 1))""")
def lang_map(t: Tables) -> DataFrame:
    return t.files.select("path", C.extension("path").alias("ext"), C.language("path").alias("mapped"))


@query("""SELECT path, CASE WHEN contains(lower(path), '/pages/') OR contains(lower(path), '/app/') THEN 'page'
 WHEN contains(lower(path), '/components/') THEN 'component' WHEN contains(lower(path), '/screens/') THEN 'screen'
 WHEN contains(lower(path), '/layouts/') THEN 'layout' WHEN regexp_matches(lower(path), '\\.(tsx|jsx|vue)$') THEN 'ui' END AS ui FROM files""")
def ui_context(t: Tables) -> DataFrame:
    return t.files.select("path", C.ui_context("path").alias("ui"))


@query("""SELECT count(*) AS total, count(*) FILTER (lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN ('rs','go','java','py','pyi','js','jsx','ts','tsx','md')) AS indexed,
 count(*) FILTER (lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('rs','go','java','py','pyi','js','jsx','ts','tsx','md')) AS skipped
 FROM (SELECT DISTINCT path FROM scans)""")
def files_summary(t: Tables) -> DataFrame:
    ok = C.supported("path")
    return t.scans.select("path").distinct().agg(F.count("*").alias("total"), F.count_if(ok).alias("indexed"), F.count_if(~ok).alias("skipped"))


@query("SELECT path, size_bytes FROM files WHERE starts_with(path, 's') ")
def files_filter_prefix(t: Tables) -> DataFrame:
    return overview.scoped(t.files, "s").select("path", "size_bytes")


# ---- statistics ----


@query("SELECT (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM refs) AS refs, (SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) FROM files) AS total_bytes")
def stats_counts(t: Tables) -> DataFrame:
    return overview.stats(t.files, t.chunks, t.refs)


@query("SELECT lang, count(*) AS files FROM files GROUP BY lang")
def stats_by_lang(t: Tables) -> DataFrame:
    return overview.by_language(t.files)


@query("SELECT min(indexed_at) AS oldest, max(indexed_at) AS newest FROM files")
def stats_time_range(t: Tables) -> DataFrame:
    return overview.time_range(t.files)


@query("SELECT path, lang, parse_quality FROM files WHERE parse_quality <> 'complete'")
def files_incomplete(t: Tables) -> DataFrame:
    return overview.incomplete(t.files)


@query("SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM files WHERE starts_with(path, 'stale')")
def scoped_file_stats(t: Tables) -> DataFrame:
    return overview.scoped_size(t.files, "stale")


@query(f"""SELECT count(*) AS files, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes FROM files WHERE file_id IN (
 SELECT file_id FROM chunks WHERE ident = {_TARGET} UNION SELECT c.file_id FROM refs r JOIN chunks c USING (chunk_id) WHERE r.target_ident = {_TARGET})""")
def symbol_file_sizes(t: Tables) -> DataFrame:
    return symbols.file_sizes(t.files, t.chunks, t.refs, t.target())


# ---- references ----

_KIND = "CASE WHEN ref_kind IN ('call','import','type_use','field_access') THEN ref_kind ELSE 'call' END"


@query(f"""SELECT r.target_ident, f.path, c.ident AS in_symbol, {_KIND} AS ref_kind, r.line, r.col
FROM refs r JOIN chunks c USING (chunk_id) JOIN files f USING (file_id)""")
def refs_with_context_join(t: Tables) -> DataFrame:
    return symbols.refs_in_context(t.files, t.chunks, t.refs)


@query(f"""SELECT f.path AS file, c.ident AS in_symbol, r.line, {_KIND} AS ref_kind FROM refs r JOIN chunks c USING (chunk_id) JOIN files f USING (file_id)
WHERE r.target_ident = {_TARGET}""")
def refs_impact(t: Tables) -> DataFrame:
    return symbols.impact(t.files, t.chunks, t.refs, t.target())


@query(f"""SELECT c.ident AS caller, f.path, r.line FROM refs r JOIN chunks c USING (chunk_id) JOIN files f USING (file_id) WHERE r.target_ident = {_TARGET}""")
def callgraph_callers(t: Tables) -> DataFrame:
    return symbols.callers(t.files, t.chunks, t.refs, t.target())


@query(f"""SELECT DISTINCT target_ident AS callee FROM refs WHERE {_KIND} = 'call' AND chunk_id IN (SELECT chunk_id FROM chunks WHERE ident = {_OWNER})""")
def callgraph_callees(t: Tables) -> DataFrame:
    return symbols.callees(t.chunks, t.refs, t.owner())


@query(f"""SELECT {_OWNER} AS symbol, (SELECT coalesce(list_sort(list_distinct(list(signature) FILTER (signature IS NOT NULL))), []) FROM chunks WHERE ident = {_OWNER}) AS signatures,
 (SELECT count(*) FROM refs WHERE target_ident = {_OWNER}) AS caller_count,
 (SELECT coalesce(list_sort(list_distinct(list(target_ident))), []) FROM refs WHERE {_KIND} = 'call' AND chunk_id IN (SELECT chunk_id FROM chunks WHERE ident = {_OWNER})) AS callees,
 (SELECT count(DISTINCT file_id) FROM chunks WHERE ident = {_OWNER}) AS file_count""")
def context(t: Tables) -> DataFrame:
    return symbols.context(t.chunks, t.refs, t.owner())


@query(f"""SELECT chunk_id, signature, (SELECT count(*) FROM refs WHERE target_ident = {_OWNER}) AS ref_count FROM chunks WHERE ident = {_OWNER} AND signature IS NOT NULL""")
def signature(t: Tables) -> DataFrame:
    return symbols.signatures(t.chunks, t.refs, t.owner())


@query("""SELECT f.path, list_sort(list_distinct(list(r.target_ident))) AS imports FROM refs r JOIN chunks c USING (chunk_id) JOIN files f USING (file_id)
WHERE r.ref_kind = 'import' GROUP BY f.path""")
def deps_imports(t: Tables) -> DataFrame:
    return symbols.dependencies(t.files, t.chunks, t.refs)


@query("""SELECT ident, chunk_id, file_id, start_line FROM (SELECT c.ident, c.chunk_id, c.file_id, c.start_line, row_number() OVER (PARTITION BY c.ident ORDER BY
 CASE WHEN starts_with(path, 'src/') THEN 0 WHEN contains(path, 'fixtures') OR contains(path, 'test') THEN 2 WHEN path IS NOT NULL THEN 1 ELSE 3 END,
 c.file_id NULLS FIRST, c.start_line, c.chunk_id) AS k FROM chunks c LEFT JOIN files f USING (file_id)) WHERE k = 1""")
def type_info_pick(t: Tables) -> DataFrame:
    return symbols.definitions(t.files, t.chunks)


@query(f"SELECT chunk_id, file_id, ident, start_line FROM chunks WHERE ident = {_OWNER}")
def read_symbol(t: Tables) -> DataFrame:
    return symbols.read_symbol(t.files, t.chunks, t.owner(), path="no/such/file.rs").select("chunk_id", "file_id", "ident", "start_line")


@query("""SELECT f.path, list_transform((list({'l': start_line, 'i': ident} ORDER BY start_line, ident))[1:10], lambda s: s.i) AS first, CAST(count(*) AS INTEGER) AS total
FROM chunks c JOIN files f USING (file_id) WHERE kind IN ('section', 'page') GROUP BY f.path""")
def read_sections(t: Tables) -> DataFrame:
    return symbols.sections(t.files, t.chunks)


@query("""SELECT f.path, coalesce(list(ident ORDER BY start_line, kind, ident) FILTER (end_line >= 20), []) AS containing,
 list(kind || ':' || ident ORDER BY start_line, kind, ident) AS visible
FROM chunks c JOIN files f USING (file_id) WHERE start_line <= 20 GROUP BY f.path""")
def scope_at_line(t: Tables) -> DataFrame:
    return symbols.scope(t.files, t.chunks, 20)


@query("""WITH rows AS (SELECT r.ref_id, c.file_id, r.line FROM refs r JOIN chunks c USING (chunk_id) WHERE c.file_id IS NOT NULL)
SELECT DISTINCT file_id, line, ref_id, chunk_id FROM (SELECT x.file_id, x.line, x.ref_id, c.chunk_id, row_number() OVER (PARTITION BY x.file_id, x.line, x.ref_id ORDER BY c.start_line DESC, c.chunk_id DESC) AS k
 FROM rows x JOIN chunks c ON c.file_id = x.file_id AND x.line BETWEEN c.start_line AND c.end_line) WHERE k = 1""")
def ref_chunk_interval_join(t: Tables) -> DataFrame:
    places = t.refs.select("ref_id", "chunk_id", "line").join(t.chunks.select("chunk_id", "file_id"), "chunk_id").where("file_id IS NOT NULL").select("file_id", "line", "ref_id")
    return symbols.innermost(t.chunks, places)


@query(f"""SELECT ident AS symbol, levenshtein(ident, {_OWNER}) AS distance FROM (SELECT DISTINCT ident FROM chunks WHERE kind IN ('fn', 'method'))
WHERE ident <> {_OWNER} AND levenshtein(ident, {_OWNER}) <= 9 ORDER BY 2, 1 LIMIT 5""")
def similar_symbols(t: Tables) -> DataFrame:
    return symbols.similar(t.chunks, t.owner(), distance=9)


# ---- overviews ----


@query("""SELECT path, lang, coalesce(last, 0) AS line_count, coalesce(symbols, []) AS symbols FROM files LEFT JOIN (SELECT file_id, max(end_line) AS last,
 list(kind || ':' || ident || ':' || start_line ORDER BY start_line, kind, ident) AS symbols FROM chunks GROUP BY file_id) USING (file_id)""")
def overview_peek(t: Tables) -> DataFrame:
    return overview.peek(t.files, t.chunks)


_KINDS = "(SELECT file_id, string_agg(n || ' ' || kind, ', ' ORDER BY kind) AS kinds FROM (SELECT file_id, kind, count(*) AS n FROM chunks GROUP BY ALL) GROUP BY file_id)"


@query(f"""SELECT path, lang, coalesce(last, 0) AS line_count, coalesce(public, []) AS public, coalesce(kinds, '') AS kinds FROM files LEFT JOIN (SELECT file_id, max(end_line) AS last,
 list(kind || ':' || ident || ':' || start_line ORDER BY start_line, kind, ident) FILTER (visibility IN ('pub', 'public')) AS public FROM chunks GROUP BY file_id) USING (file_id)
LEFT JOIN {_KINDS} USING (file_id)""")
def overview_map(t: Tables) -> DataFrame:
    return overview.map_overview(t.files, t.chunks)


@query("""WITH p AS (SELECT split(path, '/') AS parts FROM files), n AS (SELECT parts, unnest(range(1, len(parts) + 1)) AS depth FROM p)
SELECT DISTINCT array_to_string(parts[1:depth], '/') AS path, CASE WHEN depth > 1 THEN array_to_string(parts[1:depth - 1], '/') END AS parent,
 CAST(depth AS INTEGER) AS depth, parts[depth] AS name, depth < len(parts) AS is_dir FROM n""")
def overview_tree(t: Tables) -> DataFrame:
    return overview.tree(t.files)


@query(f"""SELECT path, lang, coalesce(last, 0) AS line_count, coalesce(n, 0) AS symbols, coalesce(p, 0) AS public,
 lang || ' file with ' || coalesce(kinds, 'no symbols') || '; ' || coalesce(p, 0) || ' public' AS description
FROM files LEFT JOIN (SELECT file_id, max(end_line) AS last, count(*) AS n, count(*) FILTER (visibility IN ('pub', 'public')) AS p FROM chunks GROUP BY file_id) USING (file_id)
LEFT JOIN {_KINDS} USING (file_id)""")
def summarize(t: Tables) -> DataFrame:
    return overview.summarise(t.files, t.chunks)


# ---- contents ----


@query(f"""WITH l AS (SELECT file_id, {_lines('content')} AS ls FROM sources), p AS (SELECT file_id, ls, unnest(range(0, (len(ls) + 49) // 50)) AS i FROM l WHERE len(ls) > 0)
SELECT file_id, CAST(i AS INTEGER) AS index, CAST(i * 50 + 1 AS INTEGER) AS start_line, CAST(least(i * 50 + 50, len(ls)) AS INTEGER) AS end_line,
 array_to_string(ls[i * 50 + 1:i * 50 + 50], chr(10)) AS content, CAST(ceil(strlen(array_to_string(ls[i * 50 + 1:i * 50 + 50], chr(10))) / 4.0) AS BIGINT) AS tokens FROM p""")
def partition_uniform(t: Tables) -> DataFrame:
    return content.partition_uniform(t.sources, 50)


@query(f"""WITH l AS (SELECT file_id, unnest({_lines('content')}) AS line, generate_subscripts({_lines('content')}, 1) - 1 AS i FROM sources),
h AS (SELECT *, regexp_matches(line, 'TODO|FIXME') AS hit FROM l),
g AS (SELECT *, CASE WHEN i = 0 THEN 0 WHEN hit OR coalesce(lag(hit) OVER (PARTITION BY file_id ORDER BY i), false) THEN 1 ELSE 0 END AS cut FROM h),
s AS (SELECT *, sum(cut) OVER (PARTITION BY file_id ORDER BY i) AS index FROM g)
SELECT file_id, CAST(index AS INTEGER) AS index, CAST(min(i) + 1 AS INTEGER) AS start_line, CAST(max(i) + 1 AS INTEGER) AS end_line, string_agg(line, chr(10) ORDER BY i) AS content,
 CAST(ceil(strlen(string_agg(line, chr(10) ORDER BY i)) / 4.0) AS BIGINT) AS tokens FROM s GROUP BY file_id, index""")
def partition_keyword(t: Tables) -> DataFrame:
    return content.partition_keyword(t.sources, "TODO|FIXME")


@query(f"""WITH own AS (SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY start_line, end_line, chunk_id) - 1 AS INTEGER) AS index, start_line, end_line,
 CAST(ceil(strlen(content) / 4.0) AS BIGINT) AS tokens FROM chunks WHERE file_id IN (SELECT file_id FROM files)),
l AS (SELECT file_id, {_lines('content')} AS ls FROM sources WHERE file_id IN (SELECT file_id FROM files) AND file_id NOT IN (SELECT file_id FROM chunks WHERE file_id IS NOT NULL)),
p AS (SELECT file_id, ls, unnest(range(0, (len(ls) + 49) // 50)) AS i FROM l WHERE len(ls) > 0)
SELECT * FROM own UNION ALL SELECT file_id, CAST(i AS INTEGER), CAST(i * 50 + 1 AS INTEGER), CAST(least(i * 50 + 50, len(ls)) AS INTEGER),
 CAST(ceil(strlen(array_to_string(ls[i * 50 + 1:i * 50 + 50], chr(10))) / 4.0) AS BIGINT) FROM p""")
def partition_semantic(t: Tables) -> DataFrame:
    return content.partition_semantic(t.files, t.chunks, t.sources)


@query(f"""WITH m AS (SELECT file_id, content, {_lines('content')} AS ls FROM sources WHERE file_id IN (SELECT file_id FROM files WHERE lang = 'markdown')),
l AS (SELECT file_id, len(ls) AS n, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m),
h AS (SELECT file_id, n, i, length(regexp_extract(trim(line), '^(#*)', 1)) AS level, trim(regexp_replace(trim(line), '^#+', '')) AS ident FROM l),
k AS (SELECT *, lead(i) OVER (PARTITION BY file_id ORDER BY i) AS nxt FROM h WHERE level > 0 AND ident <> '')
SELECT k.file_id, k.ident, CAST(k.level AS INTEGER) AS level, CAST(k.i AS INTEGER) AS start_line, CAST(coalesce(k.nxt - 1, k.n) AS INTEGER) AS end_line,
 (SELECT arg_max(p.ident, p.i) FROM k p WHERE p.file_id = k.file_id AND p.i < k.i AND p.level < k.level) AS parent FROM k
UNION ALL SELECT file_id, '(document)', 0, 1, CAST(len(ls) AS INTEGER), NULL FROM m WHERE file_id NOT IN (SELECT file_id FROM k) AND regexp_matches(content, '\\S')""")
def markdown_sections(t: Tables) -> DataFrame:
    return content.markdown_sections(t.sources.join(t.files.where("lang = 'markdown'").select("file_id"), "file_id", "left_semi"))


@query(f"""SELECT doc_id, '(document)' AS ident, CAST(len({_lines('text')}) AS INTEGER) AS end_line FROM documents WHERE regexp_matches(text, '\\S')""")
def plaintext_chunks(t: Tables) -> DataFrame:
    return content.document_chunks(t.documents, "doc_id", "text")


@query("""WITH p AS (SELECT doc_id, split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM p)
SELECT doc_id, 'Page ' || k AS ident, CAST(k AS INTEGER) AS number, CAST(coalesce(list_sum(list_transform(parts[1:k - 1], lambda x: length(x) + 2)), 0) AS INTEGER) AS start_char, parts[k] AS content
FROM n WHERE regexp_matches(parts[k], '\\S')""")
def pdf_pages(t: Tables) -> DataFrame:
    return content.pages(t.documents, "doc_id", "text", "\n\n")


@query("SELECT event_id, unnest(json_keys(props)) AS path, json_extract_string(props, '$.' || unnest(json_keys(props))) AS value FROM events")
def json_chunks(t: Tables) -> DataFrame:
    return content.json_entries(t.events, "event_id", "props")


@query("SELECT path, coalesce(sha256(s.content), '') <> f.hash AS changed FROM files f LEFT JOIN sources s USING (file_id)")
def diff_files(t: Tables) -> DataFrame:
    return content.diff_files(t.files, t.sources)


@query(f"""SELECT c.chunk_id, trim(array_to_string(({_lines('s.content')})[greatest(c.start_line, 1):greatest(c.start_line, 1) + greatest(c.end_line - c.start_line + 1, 0) - 1], chr(10)))
 <> trim(replace(c.content, chr(13) || chr(10), chr(10))) AS changed FROM chunks c JOIN sources s USING (file_id)""")
def diff_symbols(t: Tables) -> DataFrame:
    return content.diff_symbols(t.chunks, t.sources)


# ---- freshness and integrity ----

_DISK = """(SELECT path, arg_max(hash, (scanned_at, scan_id)) AS hash, arg_max(mtime_nanos, (scanned_at, scan_id)) AS mtime_nanos FROM scans WHERE hash IS NOT NULL GROUP BY path)"""


def _disk(t: Tables) -> DataFrame:
    """The last readable state of every path that any run saw."""
    last = F.max(F.struct("scanned_at", "scan_id", "hash", "mtime_nanos"))
    return t.scans.where("hash IS NOT NULL").groupBy("path").agg(last.alias("s")).select("path", "s.hash", "s.mtime_nanos")


_STATES = f"""SELECT coalesce(d.path, f.path) AS path, CASE WHEN d.path IS NULL THEN 'deleted' WHEN f.path IS NULL THEN 'added'
 WHEN d.mtime_nanos = f.mtime_nanos AND d.mtime_nanos <> 0 THEN 'clean' WHEN d.hash <> f.hash THEN 'modified'
 WHEN d.mtime_nanos = f.mtime_nanos THEN 'clean' ELSE 'touched' END AS state FROM {_DISK} d FULL JOIN files f ON d.path = f.path"""


@query(_STATES)
def staleness_classify(t: Tables) -> DataFrame:
    return refresh.classify(_disk(t), t.files)


@query(f"SELECT state, count(*) AS files FROM ({_STATES}) GROUP BY state")
def index_counters(t: Tables) -> DataFrame:
    return refresh.counters(refresh.classify(_disk(t), t.files))


@query(f"""WITH gone AS (SELECT file_id FROM files WHERE path NOT IN (SELECT path FROM {_DISK} WHERE hash <> '') OR file_id % 7 = 0)
SELECT (SELECT count(*) FROM files WHERE file_id NOT IN (SELECT file_id FROM gone)) AS files,
 (SELECT count(*) FROM chunks WHERE file_id IS NULL OR file_id NOT IN (SELECT file_id FROM gone)) AS chunks,
 (SELECT count(*) FROM refs WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE file_id IN (SELECT file_id FROM gone))) AS refs""")
def purge_deleted(t: Tables) -> DataFrame:
    paths = t.files.select("path").join(_disk(t).select("path"), "path", "left_anti").union(t.files.where("file_id % 7 = 0").select("path")).distinct()
    files, chunks, refs = refresh.purged(t.files, t.chunks, t.refs, paths)
    return overview.stats(files, chunks, refs).select("files", "chunks", "refs")


@query(f"""SELECT f.file_id, f.path, coalesce(d.hash, f.hash) AS hash, coalesce(d.mtime_nanos, f.mtime_nanos) AS mtime_nanos FROM files f LEFT JOIN {_DISK} d USING (path)
UNION ALL SELECT NULL, path, hash, mtime_nanos FROM {_DISK} WHERE path NOT IN (SELECT path FROM files)""")
def upsert_files(t: Tables) -> DataFrame:
    known = t.files.select("path", F.lit(True).alias("known"))
    changed = _disk(t).withColumns({"lang": C.language("path"), "size_bytes": F.lit(0).cast("long"), "indexed_at": F.lit(None).cast("timestamp")})
    out = refresh.upsert_files(t.files, changed).join(known, "path", "left")
    return out.select(F.when(F.col("known"), F.col("file_id")).alias("file_id"), "path", "hash", "mtime_nanos")


@query("""WITH a AS (SELECT DISTINCT kind, ident, parent FROM chunks WHERE indexed_at < (SELECT max(indexed_at) - INTERVAL 10 DAY FROM chunks)),
b AS (SELECT DISTINCT kind, ident, parent FROM chunks) SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def chunk_key_changes(t: Tables) -> DataFrame:
    last = t.chunks.agg(F.max("indexed_at").alias("m")).first()["m"]
    return refresh.key_changes(t.chunks.where(F.col("indexed_at") < F.lit(last) - F.expr("INTERVAL 10 DAYS")), t.chunks)


@query("""SELECT (SELECT count(*) FROM chunks WHERE file_id IS NOT NULL AND file_id NOT IN (SELECT file_id FROM files)) AS orphan_chunks,
 (SELECT count(*) FROM refs WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM chunks)) AS orphan_refs,
 (SELECT count(*) FROM files WHERE path NOT IN (SELECT path FROM scans)) AS missing_files""")
def verify(t: Tables) -> DataFrame:
    return quality.verify(t.files, t.chunks, t.refs, t.scans.select("path").distinct())


@query("""WITH f AS (SELECT * FROM files WHERE path IN (SELECT path FROM scans)), c AS (SELECT * FROM chunks WHERE file_id IN (SELECT file_id FROM f))
SELECT (SELECT count(*) FROM f) AS files, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM refs WHERE chunk_id IN (SELECT chunk_id FROM c)) AS refs""")
def verify_fix(t: Tables) -> DataFrame:
    return overview.stats(*quality.repaired(t.files, t.chunks, t.refs, t.scans.select("path").distinct())).select("files", "chunks", "refs")


# ---- quality log ----

# The patterns the query annotates with.
_PATTERNS = [(1, "java", "record", "known_record"), (2, "python", "match", "known_match"), (3, "javascript", "}", "known_brace"), (4, "rust", "}", "known_rust_brace"), (5, "javascript", "x", "known_x")]


@query(f"""WITH p(position, lang, needle, test) AS (VALUES {', '.join(map(str, _PATTERNS))})
SELECT i.ts, i.file, i.issue, i.line, coalesce(i.known, false) OR h.test IS NOT NULL AS known, coalesce(h.test, i.test) AS test
FROM (SELECT *, row_number() OVER () AS id FROM issues) i LEFT JOIN (SELECT j.id, arg_min(p.test, p.position) AS test FROM (SELECT *, row_number() OVER () AS id FROM issues) j
 JOIN p ON p.lang = j.lang AND contains(j.context, p.needle) GROUP BY j.id) h USING (id)""")
def known_issue_annotate(t: Tables) -> DataFrame:
    patterns = t.spark.createDataFrame(_PATTERNS, "position int, lang string, needle string, test string")
    return quality.annotate(t.issues, patterns).select("ts", "file", "issue", "line", "known", "test")


@query("""SELECT 'all' AS grouping, '' AS name, count(*) AS total, count(*) FILTER (known) AS known FROM issues
UNION ALL SELECT 'lang', lang, count(*), count(*) FILTER (known) FROM issues GROUP BY lang UNION ALL SELECT 'issue', issue, count(*), count(*) FILTER (known) FROM issues GROUP BY issue""")
def quality_summary(t: Tables) -> DataFrame:
    return quality.summary(t.issues)


@query("SELECT ts, file, lang, issue FROM issues WHERE NOT coalesce(known, false)")
def quality_unknown(t: Tables) -> DataFrame:
    return quality.unknown(t.issues).select("ts", "file", "lang", "issue")


# ---- ledger ----

_LEDGER = """(SELECT event_type AS command, CAST(floor(value) AS BIGINT) AS output_tokens, CAST(floor(value) AS BIGINT) * (1 + user_id % 5) AS alternative_tokens, user_id % 4 AS files_touched,
 event_id % 50 AS engine_input_tokens, event_id % 90 AS alt_input_tokens, 1 AS engine_calls, 1 + event_id % 3 AS alt_calls, ts AS created_at FROM events)"""


def _ledger(t: Tables) -> DataFrame:
    value = F.floor("value").cast("long")
    return t.events.select(
        F.col("event_type").alias("command"), value.alias("output_tokens"), (value * (1 + F.col("user_id") % 5)).alias("alternative_tokens"), (F.col("user_id") % 4).alias("files_touched"),
        (F.col("event_id") % 50).alias("engine_input_tokens"), (F.col("event_id") % 90).alias("alt_input_tokens"), F.lit(1).cast("long").alias("engine_calls"), (1 + F.col("event_id") % 3).alias("alt_calls"), F.col("ts").alias("created_at"),
    )


_SUMS = "count(*) AS operations, " + ", ".join(f"CAST(coalesce(sum({c}), 0) AS BIGINT) AS {c}" for c in ("output_tokens", "alternative_tokens", "files_touched", "engine_input_tokens", "alt_input_tokens", "engine_calls", "alt_calls"))


@query(f"SELECT command, {_SUMS} FROM {_LEDGER} GROUP BY command")
def savings_by_command(t: Tables) -> DataFrame:
    return savings.by_command(_ledger(t))


_SINCE = "2024-01-10 00:00:00"


@query(f"SELECT command, {_SUMS} FROM {_LEDGER} WHERE created_at >= TIMESTAMP '{_SINCE}' GROUP BY command")
def savings_since(t: Tables) -> DataFrame:
    return savings.by_command(_ledger(t), _SINCE)


@query(f"""SELECT command, operations, output_tokens, alternative_tokens, greatest(alternative_tokens - output_tokens, 0) AS saved,
 round(CASE WHEN alternative_tokens = 0 THEN 0 ELSE greatest(alternative_tokens - output_tokens, 0) / alternative_tokens * 100 END, 6) AS percent FROM (SELECT command, {_SUMS} FROM {_LEDGER} GROUP BY command)""")
def savings_lines(t: Tables) -> DataFrame:
    return savings.report_lines(_ledger(t))


@query(f"""SELECT CAST(sum(operations) AS BIGINT) AS operations, CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(alternative_tokens) AS BIGINT) AS alternative_tokens,
 CAST(greatest(sum(alternative_tokens) - sum(output_tokens), 0) AS BIGINT) AS total_saved, CAST(sum(greatest(alt_input_tokens - engine_input_tokens, 0)) AS BIGINT) AS input_saved,
 CAST(sum(greatest(alt_calls - engine_calls, 0)) AS BIGINT) AS calls_saved, round(greatest(sum(alternative_tokens) - sum(output_tokens), 0) / sum(alternative_tokens) * 100, 6) AS percent
FROM (SELECT command, {_SUMS} FROM {_LEDGER} GROUP BY command)""")
def savings_report(t: Tables) -> DataFrame:
    return savings.report(_ledger(t))


@query(f"""SELECT command, CAST(sum(engine_input_tokens + output_tokens + 30 * engine_calls) AS BIGINT) AS total_engine, CAST(sum(alt_input_tokens + alternative_tokens + 30 * alt_calls) AS BIGINT) AS total_alternative,
 CAST(sum(greatest(alt_input_tokens + alternative_tokens + 30 * alt_calls - engine_input_tokens - output_tokens - 30 * engine_calls, 0)) AS BIGINT) AS saved FROM {_LEDGER} GROUP BY command""")
def savings_entry_cost(t: Tables) -> DataFrame:
    return savings.with_totals(_ledger(t)).groupBy("command").agg(*[F.sum(c).alias(c) for c in ("total_engine", "total_alternative", "saved")])


@query("SELECT path, CAST(ceil(size_bytes / 4.0) AS BIGINT) + CAST(ceil(size_bytes / 4.0) AS BIGINT) // 10 AS tokens FROM files")
def file_read_cost(t: Tables) -> DataFrame:
    return savings.file_cost(t.files)


@query(f"""WITH s AS (SELECT count(*) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS b FROM files WHERE file_id IN (
 SELECT file_id FROM chunks WHERE ident = {_TARGET} UNION SELECT c.file_id FROM refs r JOIN chunks c USING (chunk_id) WHERE r.target_ident = {_TARGET}))
SELECT CAST(ceil(b / 4.0) AS BIGINT) + CAST(ceil(b / 4.0) AS BIGINT) // 10 + 200 AS tokens, 1 + n AS calls FROM s""")
def symbol_op_cost(t: Tables) -> DataFrame:
    return savings.symbol_cost(symbols.file_sizes(t.files, t.chunks, t.refs, t.target()))


@query("SELECT chunk_id, CAST(ceil(strlen(content) / 4.0) AS BIGINT) AS text_tokens, CAST(ceil(strlen(content) / 2.0) AS BIGINT) AS json_tokens FROM chunks")
def token_estimate(t: Tables) -> DataFrame:
    size = F.octet_length("content")
    return t.chunks.select("chunk_id", C.text_tokens(size).alias("text_tokens"), C.json_tokens(size).alias("json_tokens"))


@query(f"""SELECT date_trunc('day', created_at) AS start, command, count(*) AS operations, CAST(sum(greatest(alternative_tokens - output_tokens, 0)) AS BIGINT) AS saved FROM {_LEDGER} GROUP BY ALL""")
def savings_by_window(t: Tables) -> DataFrame:
    return streaming.savings_by_window(_ledger(t), "1 day")


# ---- parsers ----


@query()
def parse_sources(t: Tables) -> DataFrame:
    """(lang, kind, chunks) of all sources parsed anew."""
    rows = spread(t.sources, "file_id").join(spread(t.files.select("file_id", "lang"), "file_id"), "file_id")
    parsed = parsers.parse_sources(rows)
    return parsed.join(t.files.select("file_id", "lang"), "file_id").select("lang", F.explode("chunks.kind").alias("kind")).groupBy("lang", "kind").agg(F.count("*").alias("chunks"))


@query()
def parse_references(t: Tables) -> DataFrame:
    """(ref_kind, refs, targets) of all sources parsed anew."""
    rows = spread(t.sources, "file_id").join(spread(t.files.select("file_id", "lang"), "file_id"), "file_id")
    refs = parsers.ref_rows(parsers.parse_sources(rows))
    return refs.groupBy("ref_kind").agg(F.count("*").alias("refs"), F.countDistinct("target_ident").alias("targets"))


@query(
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"('{ext}', '{lang}', '{parser}')"
        for exts, lang, parser in [
            ("rs", "rust", "code"), ("go", "go", "code"), ("java", "java", "code"), ("cs", "csharp", "code"), ("py pyi", "python", "code"), ("php", "php", "code"), ("js jsx", "javascript", "code"),
            ("ts", "typescript", "code"), ("tsx", "tsx", "code"), ("html", "html", "code"), ("css", "css", "code"), ("md markdown", "markdown", "markdown"), ("pdf", "pdf", "pdf"), ("yaml yml", "yaml", "yaml"),
            ("toml", "toml", "toml"), ("json", "json", "json"), ("sh bash", "bash", "plaintext"), ("sql", "sql", "plaintext"), ("xml csproj fsproj vbproj props targets", "xml", "plaintext"), ("c h", "c", "plaintext"), ("cpp hpp", "cpp", "plaintext"),
            ("txt rst ini cfg properties proto graphql gql tf hcl sln gradle kts", "plaintext", "plaintext"),
        ]
        for ext in exts.split()
    )
    + ") AS t(ext, lang, parser)"
)
def supported_extensions(t: Tables) -> DataFrame:
    return parsers.supported_extensions(t.spark)


# ---- graph and tests ----

_TESTFILE = """CASE lang WHEN 'rust' THEN starts_with(p, 'tests/') OR ends_with(p, '_tests.rs') OR ends_with(p, '_test.rs') WHEN 'java' THEN starts_with(p, 'src/test/') OR regexp_matches(n, '^.+Tests?\\.java$')
 WHEN 'python' THEN starts_with(p, 'tests/') OR ends_with(p, '_test.py') OR regexp_matches(n, '^test_.*\\.py$')
 WHEN 'javascript' THEN starts_with(p, '__tests__/') OR contains(p, '/__tests__/') OR contains(n, '.test.') OR contains(n, '.spec.')
 WHEN 'typescript' THEN starts_with(p, '__tests__/') OR contains(p, '/__tests__/') OR contains(n, '.test.') OR contains(n, '.spec.')
 WHEN 'go' THEN ends_with(p, '_test.go') ELSE false END"""


@query(f"""SELECT lang, count(*) AS files, count(*) FILTER ({_TESTFILE}) AS tests FROM (SELECT lang, path[length(split_part(path, '/', 1)) + 2:] AS p, split_part(path, '/', -1) AS n FROM files) GROUP BY lang""")
def test_file_flags(t: Tables) -> DataFrame:
    relative = F.expr("substring(path, length(substring_index(path, '/', 1)) + 2)")
    return t.files.groupBy("lang").agg(F.count("*").alias("files"), F.count_if(C.is_test_file(relative, "lang")).alias("tests"))


_TESTCHUNK = """CASE lang WHEN 'rust' THEN contains(coalesce(attributes, ''), '#[test]') WHEN 'java' THEN contains(coalesce(attributes, ''), '@Test')
 WHEN 'python' THEN starts_with(ident, 'test_') OR contains(coalesce(attributes, ''), '@pytest') OR contains(coalesce(attributes, ''), '@unittest') WHEN 'go' THEN starts_with(ident, 'Test') ELSE false END"""


@query(f"SELECT lang, count(*) AS chunks, count(*) FILTER ({_TESTCHUNK}) AS tests FROM chunks JOIN files USING (file_id) GROUP BY lang")
def test_chunk_flags(t: Tables) -> DataFrame:
    rows = t.chunks.select("file_id", "ident", "attributes").join(t.files.select("file_id", "lang"), "file_id")
    return rows.groupBy("lang").agg(F.count("*").alias("chunks"), F.count_if(C.is_test_chunk("lang", "ident", "attributes")).alias("tests"))


_EDGES = "e AS (SELECT DISTINCT c.ident AS caller, f.path, r.target_ident AS target FROM refs r JOIN chunks c USING (chunk_id) JOIN files f USING (file_id))"


#: The test tables have no tests; functions whose name ends in 'a' are taken as some, by attributes put in here.
_MARK = "#[test] @Test @pytest"
_GRAPH = f"""WITH e AS (SELECT DISTINCT c.ident AS caller, f.path, f.lang, r.target_ident AS target, CASE WHEN ends_with(c.ident, 'a') THEN '{_MARK}' END AS attributes
  FROM refs r JOIN chunks c USING (chunk_id) JOIN files f USING (file_id)),
g AS (SELECT caller, path, target, ({_TESTCHUNK.replace("ident", "caller")}) OR ({_TESTFILE}) AS is_test FROM (SELECT *, path AS p, split_part(path, '/', -1) AS n FROM e)),
a AS (SELECT DISTINCT caller, path, is_test FROM g WHERE target = {_TARGET}),
n1 AS (SELECT DISTINCT caller FROM a WHERE NOT is_test AND caller <> {_TARGET}),
b AS (SELECT DISTINCT caller, path, is_test FROM g WHERE target IN (SELECT caller FROM n1)),
n2 AS (SELECT DISTINCT caller FROM b WHERE NOT is_test AND caller <> {_TARGET} AND caller NOT IN (SELECT caller FROM n1)),
c AS (SELECT DISTINCT caller, path, is_test FROM g WHERE target IN (SELECT caller FROM n2)),
reached AS (SELECT caller AS symbol, path, min(d) AS depth, bool_or(is_test) AS is_test FROM (SELECT *, 1 AS d FROM a UNION ALL SELECT *, 2 FROM b UNION ALL SELECT *, 3 FROM c) GROUP BY ALL)
"""


def _marked(t: Tables) -> DataFrame:
    return t.chunks.withColumn("attributes", F.when(F.col("ident").endswith("a"), _MARK))


@query(_GRAPH + "SELECT symbol, path, depth, is_test FROM reached")
def transitive_callers(t: Tables) -> DataFrame:
    edges = materialised(graph.edges(t.files, _marked(t), t.refs), "edges")
    return graph.transitive_callers(edges, t.target())


_COVERS = """(s = t AND s <> '') OR (s <> '' AND length(t) > length(s) AND (
  (starts_with(t, s) AND (t[length(s) + 1:length(s) + 1] IN ('_', '.') OR (regexp_matches(s[-1:], '[a-z]') AND regexp_matches(t[length(s) + 1:length(s) + 1], '[A-Z]'))))
  OR (ends_with(t, s) AND (t[length(t) - length(s):length(t) - length(s)] IN ('_', '.') OR (regexp_matches(t[length(t) - length(s):length(t) - length(s)], '[a-z]') AND regexp_matches(s[1:1], '[A-Z]'))))))"""


@query(
    f"""WITH every AS (SELECT path, lang FROM files UNION ALL SELECT split_part(path, '/', 1) || '/tests/test_' || regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') || '.py', lang FROM files WHERE lang = 'python'),
r AS (SELECT path, lang, split_part(path, '/', 1) AS repo, path[length(split_part(path, '/', 1)) + 2:] AS p, split_part(path, '/', -1) AS n, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') AS stem FROM every),
f AS (SELECT *, {_TESTFILE} AS is_test FROM r)
SELECT DISTINCT a.path AS source, b.path AS test FROM (SELECT *, stem AS s FROM f WHERE NOT is_test) a JOIN (SELECT *, stem AS t FROM f WHERE is_test) b USING (repo, lang) WHERE {_COVERS}"""
)
def tests_by_naming(t: Tables) -> DataFrame:
    """A test file by the conventions of Python is put beside every Python file; the test tables have none of their own."""
    test = F.concat(F.substring_index("path", "/", 1), F.lit("/tests/test_"), C.stem("path"), F.lit(".py"))
    return graph.tests_of_file(t.files.unionByName(t.files.where("lang = 'python'").withColumn("path", test)), t.chunks, t.refs)


@query(
    _GRAPH
    + f""", home AS (SELECT f.path FROM ({ORACLE["type_info_pick"]}) d JOIN files f USING (file_id) WHERE d.ident = {_TARGET}),
found AS (SELECT caller AS symbol, path, 0 AS k FROM g WHERE target = {_TARGET} AND is_test AND path IN (SELECT path FROM home) UNION ALL SELECT symbol, path, 1 FROM reached WHERE is_test)
SELECT symbol, path, CASE min(k) WHEN 0 THEN 'direct' ELSE 'transitive' END AS strategy FROM found GROUP BY symbol, path"""
)
def tests_impact(t: Tables) -> DataFrame:
    edges, symbol = materialised(graph.edges(t.files, _marked(t), t.refs), "edges"), t.target()
    home = symbols.definitions(t.files, t.chunks).where(F.col("ident") == symbol).join(t.files, "file_id").select("path", "lang").first()
    path, lang = (home["path"], home["lang"]) if home else ("", "")
    found = graph.transitive_callers(edges, symbol).where("is_test")
    return graph.merge_tests(graph.direct_tests(edges, symbol, path), found, graph.naming_tests(t.files, t.chunks, path, lang))


# ---- full text ----

_WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
_FTS = f"""WITH d AS (SELECT chunk_id, {', '.join(f"{_WORDS.format(c)} AS f{i}" for i, c in enumerate(search.COLUMNS))} FROM chunks),
n AS (SELECT chunk_id, len(f0) + len(f1) + len(f2) + len(f3) AS n FROM d), total AS (SELECT count(*) AS docs, avg(n) AS mean FROM n),
"""


def _count(test: str) -> str:
    return " + ".join(f"len(list_filter(f{i}, lambda w: {test}))" for i in range(4))


def _ranked(units: list[str], condition: str, limit: int = 20) -> str:
    """Top chunks for units given as SQL expressions of their frequency in a row of d."""
    tf = "t AS (SELECT chunk_id, " + ", ".join(f"{u} AS t{k}" for k, u in enumerate(units)) + " FROM d), h AS (SELECT t.*, n.n FROM t JOIN n USING (chunk_id)), "
    idf = "i AS (SELECT " + ", ".join(f"(SELECT count(*) FROM t WHERE t{k} > 0) AS df{k}" for k in range(len(units))) + "), "
    parts = []
    for k in range(len(units)):
        log = f"ln((docs - df{k} + 0.5) / (df{k} + 0.5))"
        parts.append(f"CASE WHEN {log} <= 0 THEN 1e-6 ELSE {log} END * t{k} * 2.2 / (t{k} + 1.2 * (0.25 + 0.75 * n / mean))")
    score = " + ".join(f"CASE WHEN t{k} > 0 THEN {p} ELSE 0 END" for k, p in enumerate(parts))
    return _FTS + tf + idf + f"s AS (SELECT chunk_id, round(-({score}), 9) AS score FROM h, i, total WHERE {condition}) SELECT s.chunk_id, c.file_id, c.ident, s.score FROM (SELECT * FROM s ORDER BY score, chunk_id LIMIT {limit}) s JOIN (SELECT DISTINCT chunk_id, file_id, ident FROM chunks) c USING (chunk_id)"


#: The search indexes written by this process, by session and folder of tables.
_WRITTEN: dict[tuple[str, str], str] = {}


def _indexed(t: Tables) -> tuple[DataFrame, search.SearchIndex]:
    """The chunks, each once, and their search index, which is written by the first query that asks for it."""
    rows = t.chunks.dropDuplicates(["chunk_id"])
    key = (t.spark.sparkContext.applicationId, t.folder)
    path = _WRITTEN.get(key)
    if path is None or not FileStore(t.spark, path).exists(""):
        path = _WRITTEN[key] = new_folder(t.spark, "search")
        search.write_index(rows, path)
    return rows, search.read_index(t.spark, path)


def _search(t: Tables, text: str) -> DataFrame:
    rows, index = _indexed(t)
    return search.search(rows, text, fields="minimal", index=index).select("chunk_id", "file_id", "ident", "score")


_ONCE = ("FROM chunks)", "FROM (SELECT DISTINCT chunk_id, ident, signature, doc_comment, content FROM chunks))")


def _fts(units: list[str], condition: str) -> str:
    return _ranked(units, condition).replace(*_ONCE, 1)


@query(_fts([_count("w = 'ticket'"), _count("w = 'quiet'")], "t0 > 0 AND t1 > 0"))
def fts_and(t: Tables) -> DataFrame:
    return _search(t, "ticket quiet")


@query(_fts([_count("w = 'ticket'"), _count("w = 'frozen'")], "t0 > 0 OR t1 > 0"))
def fts_or(t: Tables) -> DataFrame:
    return _search(t, "ticket OR frozen")


@query(_fts([" + ".join(f"len(list_filter(range(1, len(f{i})), lambda k: f{i}[k] = 'somebody' AND f{i}[k + 1] = 'else'))" for i in range(4))], "t0 > 0"))
def fts_phrase(t: Tables) -> DataFrame:
    return _search(t, '"somebody else"')


@query(_fts([_count("starts_with(w, 'tick')")], "t0 > 0"))
def fts_prefix(t: Tables) -> DataFrame:
    return _search(t, "tick*")


@query(
    f"""WITH top AS ({_fts([_count("w = 'ticket'"), _count("w = 'frozen'")], "t0 > 0 OR t1 > 0")}), shown AS (SELECT DISTINCT t.chunk_id, t.file_id, strlen(c.content) AS size FROM top t JOIN chunks c USING (chunk_id))
SELECT count(*) AS hits, count(DISTINCT file_id) AS file_count, CAST(4 + coalesce(sum(size), 0) // 4 AS BIGINT) AS tokens FROM shown"""
)
def fts_summary(t: Tables) -> DataFrame:
    rows, index = _indexed(t)
    return search.search_summary(rows, "ticket OR frozen", index=index)


@query("""SELECT term, count(*) AS n, count(DISTINCT chunk_id) AS chunks FROM (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(doc_comment, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM chunks) GROUP BY term""")
def fts_vocabulary(t: Tables) -> DataFrame:
    terms = search.postings(t.chunks, columns=["doc_comment"])
    return terms.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("chunks"))
