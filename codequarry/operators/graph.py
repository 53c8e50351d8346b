"""The call graph and the tests a change can affect."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from codequarry.functions import columns as C
from codequarry.plans.workspace import materialised

DEPTH = 3

# Marker files of the test runners, in order of precedence, with the command of each.
RUNNERS = [
    (".config/nextest.toml", "cargo nextest run"), ("Cargo.toml", "cargo test"), ("go.mod", "go test"), ("pom.xml", "mvn test"), ("build.gradle", "gradle test"), ("build.gradle.kts", "gradle test"),
    ("pyproject.toml", "pytest"), ("pytest.ini", "pytest"), ("setup.cfg", "pytest"), ("vitest.config.ts", "vitest run"), ("vitest.config.js", "vitest run"), ("jest.config.js", "jest"), ("jest.config.ts", "jest"),
    ("package.json", "jest"), ("phpunit.xml", "phpunit"), ("phpunit.xml.dist", "phpunit"), ("*.sln", "dotnet test"), ("*.csproj", "dotnet test"), ("global.json", "dotnet test"),
]


def edges(files: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(caller, path, lang, attributes, target): distinct references between a symbol in a file and a name."""
    nodes = chunks.select("chunk_id", "file_id", F.col("ident").alias("caller"), "attributes").join(files.select("file_id", "path", "lang"), "file_id")
    return refs.select("chunk_id", F.col("target_ident").alias("target")).join(nodes, "chunk_id").select("caller", "path", "lang", "attributes", "target").distinct()


def with_test_flag(graph: DataFrame) -> DataFrame:
    return graph.withColumn("is_test", C.is_test_chunk("lang", "caller", "attributes") | C.is_test_file("path", "lang"))


def transitive_callers(graph: DataFrame, symbol: str, depth: int = DEPTH) -> DataFrame:
    """(symbol, path, depth, is_test): callers of ``symbol`` within ``depth`` hops, each once at its least depth.

    A bounded loop of joins: the frontier meets the edges on the target, names already seen leave it, tests are not followed.  ``graph``
    should be a written table; the callers of each level are written too, so that no level is computed again by the next.
    """
    flagged = with_test_flag(graph)
    frontier = flagged.sparkSession.createDataFrame([(symbol,)], "name string")
    seen, found = frontier, []
    for level in range(1, depth + 1):
        hits = flagged.join(frontier, flagged.target == frontier.name, "left_semi").select(F.col("caller").alias("symbol"), "path", "is_test", F.lit(level).alias("depth")).distinct()
        hits = materialised(hits, "callers")
        found.append(hits)
        frontier = hits.where("NOT is_test").select(F.col("symbol").alias("name")).distinct().join(seen, "name", "left_anti")
        seen = seen.union(frontier)
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("symbol", "path").agg(F.min("depth").alias("depth"), F.max("is_test").alias("is_test"))


def direct_tests(graph: DataFrame, symbol: str, path: str) -> DataFrame:
    """(symbol, path): tests in ``path`` that refer to ``symbol``."""
    return with_test_flag(graph).where((F.col("target") == symbol) & (F.col("path") == path) & F.col("is_test")).select(F.col("caller").alias("symbol"), "path").distinct()


def naming_tests(files: DataFrame, chunks: DataFrame, path: str, lang: str) -> DataFrame:
    """(symbol, path): test chunks of test files of the language whose stem covers the changed file's."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    tests = files.where((F.col("lang") == lang) & C.is_test_file("path", "lang") & C.stem_covers(F.lit(stem), C.stem("path")))
    inside = chunks.select("file_id", "ident", "attributes", "kind").join(tests.select("file_id", "path", "lang"), "file_id")
    return inside.where(C.is_test_chunk("lang", "ident", "attributes")).select(F.col("ident").alias("symbol"), "path").distinct()


def merge_tests(direct: DataFrame, transitive: DataFrame, naming: DataFrame) -> DataFrame:
    """(symbol, path, strategy): every test once, under the first strategy that finds it."""
    ranked = [d.select("symbol", "path", F.lit(k).alias("rank"), F.lit(name).alias("strategy")) for k, (name, d) in enumerate((("direct", direct), ("transitive", transitive), ("naming", naming)))]
    first = Window.partitionBy("symbol", "path").orderBy("rank")
    return reduce(DataFrame.unionByName, ranked).withColumn("k", F.row_number().over(first)).where("k = 1").select("symbol", "path", "strategy")


def tests_of_file(files: DataFrame, chunks: DataFrame, refs: DataFrame) -> DataFrame:
    """(source, test, tests): every source file with the test files of its repository and language that its stem names.

    Joined on repository, language and the first word of the stem, so the fuzzy comparison meets few candidates.
    """
    rows = files.select("file_id", "path", "lang", F.split("path", "/")[0].alias("repo"), F.substring_index("path", "/", -1).alias("name"))
    relative = F.expr("substring(path, length(repo) + 2)")
    rows = rows.withColumns({"is_test": C.is_test_file(relative, "lang"), "stem": C.stem("path")})
    words = F.array_distinct(F.filter(F.split("stem", r"[_.\-]|(?<=[a-z])(?=[A-Z])"), lambda w: w != ""))
    source = rows.where("NOT is_test").select("repo", "lang", F.col("path").alias("source"), F.col("stem").alias("source_stem"), F.try_element_at(words, F.lit(1)).alias("word"))
    test = rows.where("is_test").select("repo", "lang", F.col("path").alias("test"), F.col("stem").alias("test_stem"), F.explode(words).alias("word"))
    return source.join(test, ["repo", "lang", "word"]).where(C.stem_covers("source_stem", "test_stem")).select("source", "test").distinct()


def runner(paths: set[str]) -> str | None:
    """The test command of a project with these files at its root."""
    return next((command for marker, command in RUNNERS if any(fnmatch.fnmatchcase(p, marker) for p in paths)), None)


def command(runner_command: str, tests: list[tuple[str, str]]) -> str:
    """A command line that runs the given (symbol, path) tests."""
    if runner_command.startswith("cargo "):
        return f"{runner_command} " + " ".join(sorted({s for s, _ in tests}))
    if runner_command == "go test":
        packages = sorted({"./" + p.rpartition("/")[0] for _, p in tests})
        return "go test " + " ".join(packages) + " -run '^(" + "|".join(sorted({s for s, _ in tests})) + ")$'"
    if runner_command == "pytest":
        return "pytest " + " ".join(sorted({f"{p}::{s}" for s, p in tests}))
    if runner_command in ("mvn test", "gradle test", "dotnet test"):
        flag = {"mvn test": "-Dtest=", "gradle test": "--tests ", "dotnet test": "--filter "}[runner_command]
        return f"{runner_command} {flag}" + ",".join(sorted({s for s, _ in tests}))
    return runner_command + " " + " ".join(sorted({p for _, p in tests}))


def warning(confirmed: int, by_name: int) -> str | None:
    """What to say when no test is known to reach a change."""
    if confirmed:
        return None
    return "only tests of a matching name were found; none refers to the symbol" if by_name else "no test refers to the symbol"
