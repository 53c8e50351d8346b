import pytest

from codequarry.functions import columns as C
from codequarry.operators import graph, symbols

FILES = "file_id long, path string, lang string, size_bytes long"
CHUNKS = "chunk_id long, file_id long, start_line int, end_line int, kind string, ident string, parent string, signature string, attributes string"


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([(1, "src/a.rs", "rust", 10), (2, "tests/a_tests.rs", "rust", 20), (3, "lib/b.rs", "rust", 30)], FILES)
    chunks = spark.createDataFrame(
        [(1, 1, 1, 9, "fn", "target", None, "fn target()", None), (2, 1, 2, 5, "fn", "middle", "X", "fn middle()", None), (3, 2, 1, 9, "fn", "test_it", None, None, "#[test]"), (4, 3, 1, 9, "fn", "far", None, None, None), (5, 3, 3, 4, "fn", "target", "Y", None, None)], CHUNKS,
    )
    refs = spark.createDataFrame([(1, 2, "target", "call", 3, 1), (2, 3, "middle", "call", 2, 1), (3, 4, "middle", "odd", 2, 1), (4, 4, "dep", "import", 1, 1), (5, 4, "dep", "import", 1, 1)], "ref_id long, chunk_id long, target_ident string, ref_kind string, line int, col int")
    return files, chunks, refs


def test_references(index):
    files, chunks, refs = index
    assert [tuple(r) for r in symbols.impact(files, chunks, refs, "target").collect()] == [("src/a.rs", "middle", 3, "call")]
    assert {r["callee"] for r in symbols.callees(chunks, refs, "far").collect()} == {"middle"}
    assert symbols.dependencies(files, chunks, refs).first()["imports"] == ["dep"]
    row = symbols.context(chunks, refs, "target").first()
    assert (row["signatures"], row["caller_count"], row["file_count"], row["callees"]) == (["fn target()"], 1, 2, [])


def test_definition_prefers_source(index):
    files, chunks, _ = index
    assert {r["ident"]: r["chunk_id"] for r in symbols.definitions(files, chunks).collect()}["target"] == 1


def test_read_symbol_falls_back(index):
    files, chunks, _ = index
    read = lambda **k: {r["chunk_id"] for r in symbols.read_symbol(files, chunks, "target", **k).collect()}
    assert read() == {1, 5} and read(path="lib/b.rs") == {5} and read(path="none") == {1, 5} and read(path="none", parent="Y") == {5}
    with pytest.raises(LookupError):
        symbols.read_symbol(files, chunks, "nothing")
    with pytest.raises(LookupError):
        symbols.read_symbol(files, chunks, "target", parent="Z")


def test_innermost(spark, index):
    places = spark.createDataFrame([(1, 3), (1, 7), (1, 99), (3, 3)], "file_id long, line int")
    assert {(r["file_id"], r["line"]): r["chunk_id"] for r in symbols.innermost(index[1], places).collect()} == {(1, 3): 2, (1, 7): 1, (3, 3): 5}


def test_similar(spark):
    chunks = spark.createDataFrame([(i, 1, "fn", n) for i, n in enumerate(["größe", "grosse", "gro", "other", "größe"])], "chunk_id long, file_id long, kind string, ident string")
    assert [tuple(r) for r in symbols.similar(chunks, "größe").collect()] == [("gro", 3), ("grosse", 3)]


def test_graph(spark, index):
    edges = graph.edges(*index).cache()
    got = {(r["symbol"], r["depth"], r["is_test"]) for r in graph.transitive_callers(edges, "target").collect()}
    assert got == {("middle", 1, False), ("test_it", 2, True), ("far", 2, False)}
    naming = graph.naming_tests(index[0], index[1], "src/a.rs", "rust")
    assert [tuple(r) for r in naming.collect()] == [("test_it", "tests/a_tests.rs")]
    merged = graph.merge_tests(naming.limit(0), graph.transitive_callers(edges, "target").where("is_test"), naming)
    assert [tuple(r) for r in merged.collect()] == [("test_it", "tests/a_tests.rs", "transitive")]
    assert graph.runner({"go.mod", "package.json"}) == "go test" and graph.runner(set()) is None
    assert graph.command("go test", [("TestB", "p/b_test.go"), ("TestA", "p/a_test.go")]) == "go test ./p -run '^(TestA|TestB)$'"
    assert graph.warning(1, 0) is None and graph.warning(0, 1) != graph.warning(0, 0)


def test_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "f", "rust", None, "b"), ("b", "f", "rust", None, "a")], "caller string, path string, lang string, attributes string, target string")
    assert {r["symbol"] for r in graph.transitive_callers(edges, "a").collect()} == {"a", "b"}


def test_stems_and_test_files(spark):
    pairs = [("cache", "cache", True), ("cache", "cache_tests", True), ("cache", "CacheTest", False), ("Cache", "CacheTest", True), ("cache", "test_cache", True), ("ache", "cache", False), ("", "x", False)]
    df = spark.createDataFrame(pairs, "s string, t string, e boolean").select("e", C.stem_covers("s", "t").alias("g"))
    assert all(r["e"] == r["g"] for r in df.collect())
    cases = [("tests/x.rs", "rust", True), ("src/x_test.rs", "rust", True), ("src/test/A.java", "java", True), ("Test.java", "java", False), ("a/ATest.java", "java", True), ("a/test_x.py", "python", True), ("a/x.spec.ts", "typescript", True), ("a/x_test.go", "go", True), ("a/x.md", "markdown", False)]
    df = spark.createDataFrame(cases, "p string, l string, e boolean").select("p", "e", C.is_test_file("p", "l").alias("g"))
    assert all(r["e"] == r["g"] for r in df.collect())
