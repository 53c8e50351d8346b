import os
import shutil

import pytest

from codequarry import output
from codequarry.operators import edit
from codequarry.operators.changes import ChangeTracker
from codequarry.session import Index
from codequarry.sources import scan
from codequarry.streaming import refresh as streaming

RUST = "use std::fmt;\n\n/// Adds.\npub fn add(a: u32) -> u32 {\n    helper(a)\n}\n\nfn helper(a: u32) -> u32 { a }\n"


@pytest.fixture()
def project(tmp_path):
    root = tmp_path / "p"
    (root / "src").mkdir(parents=True)
    (root / "src/lib.rs").write_text(RUST)
    (root / "readme.md").write_text("# Title\ntext\n## Part\n")
    (root / "data.bin").write_bytes(b"\x00")
    (root / "node_modules").mkdir()
    (root / "node_modules/x.js").write_text("x")
    (root / ".gitignore").write_text("*.log\n!keep.log\n/only.py\n")
    (root / "a.log").write_text("")
    (root / "only.py").write_text("")
    return str(root)


def test_walk(spark, project):
    rows, failed = scan.walk_rows(project)
    assert not failed and {(r[0], r[5]) for r in rows} == {("src/lib.rs", None), ("readme.md", None), ("data.bin", "unsupported_extension")}
    rows, _ = scan.walk_rows(project, max_mb=1e-5)
    assert {r[5] for r in rows} == {"too_large", "unsupported_extension", None} - {None} or ("data.bin", "unsupported_extension") in {(r[0], r[5]) for r in rows}
    assert scan.walk(spark, project)[0].count() == 3
    assert scan.walk_rows(project + "/none")[1]


def test_index_and_refresh(spark, project, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    states = {r["state"]: r["files"] for r in index.index(project).collect()}
    assert states["added"] >= 2
    assert {r["ident"] for r in index.chunks.where("kind = 'fn'").collect()} == {"add", "helper"}
    assert [tuple(r)[:2] for r in index.refs_to("helper").collect()] == [("src/lib.rs", "add")]
    assert index.read(symbol="add").first()["doc_comment"] == "/// Adds."
    assert index.read("readme.md", section="Part").count() == 1
    with pytest.raises(LookupError, match="Title"):
        index.read("readme.md", section="None")
    plain = [tuple(r) for r in index.search("helper").collect()]
    index.build_postings()
    assert plain and plain == [tuple(r) for r in index.search("helper").collect()]
    assert index.search("help*").count() >= 1 and index.search('"helper a"').count() >= 1
    assert index.deps("src/lib.rs").first()["imports"] == ["std::fmt"]
    assert index.overview("tree").count() >= 3 and index.overview("minimal").count() == index.overview().count()
    assert {r["changed"] for r in index.diff(project).collect()} == {False}
    with open(os.path.join(project, "src/lib.rs"), "a") as file:
        file.write("fn third() {}\n")
    os.unlink(os.path.join(project, "readme.md"))
    states = {r["state"]: r["files"] for r in index.index(project).collect()}
    assert (states["modified"], states["deleted"]) == (1, 1)
    assert {r["ident"] for r in index.chunks.where("kind = 'fn'").collect()} == {"add", "helper", "third"}
    shutil.rmtree(os.path.join(project, "src"))
    assert index.verify(project, fix=True).first()["missing_files"] == 1
    assert index.files.where("path = 'src/lib.rs'").count() == 0


def test_command_line(spark, project, tmp_path, capsys):
    from codequarry.__main__ import main

    def run(*words):
        assert main(["--index", f"file://{tmp_path}/cli", "--source", project, *words], spark) == 0
        return capsys.readouterr().out

    assert "added" in run("index")
    assert "helper" in run("search", "helper") and "content" not in run("search", "helper", "--fields", "minimal")
    assert '"in_symbol":"add"' in run("refs", "helper")
    assert "readme.md" in run("overview") and "src/" in run("overview", "--detail", "tree")
    assert run("--format", "table", "supported").startswith("results[")
    assert "a + 2" in run("replace", "src/lib.rs", "helper", "fn helper(a: u32) -> u32 { a + 2 }", "--preview")
    run("replace", "src/lib.rs", "helper", "fn helper(a: u32) -> u32 { a + 2 }")
    assert "a + 2" in open(os.path.join(project, "src/lib.rs")).read() and "a + 2" in run("read", "src/lib.rs", "--symbol", "helper")
    assert "orphan_chunks" in run("verify") and "files" in run("stats") and "std::fmt" in run("deps", "src/lib.rs")
    assert '"callers":["add"]' in run("context", "helper", "--graph") and '"ref_count":1' in run("read", "src/lib.rs", "--symbol", "helper", "--metadata")
    (tmp_path / "log").write_text('{"ts":"1","file":"a","lang":"x","issue":"i"}\n')
    assert '"issue":"i"' in run("quality", f"file://{tmp_path}/log") and "true" in run("quality", f"file://{tmp_path}/log", "--clear")
    assert "containing" in run("scope", "src/lib.rs", "5") and "tokens" in run("partition", "src/lib.rs", "uniform:3")
    assert main(["--index", f"file://{tmp_path}/cli", "--source", project, "read", "src/lib.rs", "--symbol", "nothing"], spark) == 1


def test_edits(spark, project, tmp_path):
    index = Index(spark, f"file://{tmp_path}/index")
    index.index(project)
    chunk = edit.find_symbol(index.files, index.chunks, "src/lib.rs", "helper")
    assert edit.preview_replace(project, "src/lib.rs", chunk, "x").old_lines == (8, 8)
    edit.replace(project, "src/lib.rs", chunk, "fn helper(a: u32) -> u32 { a + 1 }")
    with pytest.raises(edit.EditError) as error:
        edit.replace(project, "src/lib.rs", chunk, "again")
    assert error.value.kind == "conflict"
    add = edit.find_symbol(index.files, index.chunks, "src/lib.rs", "add")
    assert edit.extract(project, "src/lib.rs", [add], "src/new.rs")["dest_created"]
    assert "/// Adds." in open(os.path.join(project, "src/new.rs")).read() and "add" not in open(os.path.join(project, "src/lib.rs")).read()
    edit.insert(project, "src/lib.rs", "// end", "bottom")
    edit.insert(project, "src/lib.rs", "// two", "after:1")
    assert open(os.path.join(project, "src/lib.rs")).read().split("\n")[1] == "// two"
    for bad in ("before:99", "middle", "after:x"):
        with pytest.raises(edit.EditError):
            edit.insert(project, "src/lib.rs", "x", bad)
    for path in ("/etc/passwd", "../x", "src/../../x"):
        with pytest.raises(edit.EditError):
            edit.safe_path(project, path)
    with pytest.raises(edit.EditError) as error:
        edit.find_symbol(index.files, index.chunks, "src/lib.rs", "none")
    assert error.value.kind == "symbol_not_found"
    with open(os.path.join(project, "m.py"), "w") as file:
        file.write("x = 1\n")
    with pytest.raises(edit.EditError) as error:
        edit.insert(project, "m.py", "def f(:", "bottom")
    assert error.value.kind == "syntax_guard"


def test_output():
    rows = [{"a": 1, "b": "x,y"}, {"a": None, "b": "z"}]
    assert output.to_table("t", rows) == 't[2]{a,b}:\n  1,"x,y"\n  ,z'
    assert output.to_json({"a": None, "b": [1]}) == '{"b":[1]}'
    assert "truncated" in output.truncated("x" * 60_000) and output.truncated("x") == "x"
    text, n = output.output_tokens(lambda n: f'{{"tokens":{n}}}')
    assert n == -(-len(text) // 2)


def test_stream_of_scans(spark, tmp_path):
    scans = spark.createDataFrame([(1, 1, "r/a", "h", 1, 0, None), (2, 1, "r/b", None, 1, 0, None)], streaming.SCANS)
    scans.write.parquet(f"{tmp_path}/in")
    tracker = ChangeTracker(spark, f"file://{tmp_path}/state")
    for _ in range(2):
        query = streaming.track_changes(spark, f"{tmp_path}/in", tracker, f"{tmp_path}/checkpoint")
        query.awaitTermination()
    assert [tuple(r) for r in tracker.state().collect()] == [("r", "r/a", "h")] and tracker.pointer()["version"] == 1


def test_scan_states(spark, project, tmp_path, monkeypatch):
    """Unchanged files are not read, ignored ones not indexed, and files that are too large or not UTF-8 keep their record."""
    index = Index(spark, f"file://{tmp_path}/index")
    said = []
    states = lambda: {r["state"]: r["files"] for r in index.index(project, progress=lambda stage, n: said.append((stage, n))).collect()}
    assert states() == {"added": 2} and ("read", 2) in said and {r["path"] for r in index.files.collect()} == {"src/lib.rs", "readme.md"}
    said.clear()
    assert states() == {"clean": 2} and ("read", 0) in said
    os.utime(os.path.join(project, "readme.md"), (1, 1))
    assert states() == {"clean": 1, "touched": 1} and states() == {"clean": 2}
    with open(os.path.join(project, "readme.md"), "wb") as file:
        file.write(b"\xff\xfe# x")
    assert states() == {"clean": 1, "failed": 1} and index.files.count() == 2
    monkeypatch.setattr(scan.schema, "MAX_FILE_MB", 1e-5)
    rows, _ = scan.walk_rows(project, 1e-5)
    assert {r[5] for r in rows if r[0] == "src/lib.rs"} == {"too_large"}
    os.unlink(os.path.join(project, "readme.md"))
    assert {r["state"] for r in index.index(project, walk_had_errors=True).collect()} == {"clean", "kept"}
    assert {r["state"] for r in index.index(project).collect()} == {"clean", "deleted"}


def test_shared_tree_follows_the_same_rules(spark, project):
    rules = scan.IgnoreRules.of_files({"": "*.log\n!keep.log\n/only.py\n", "src": "gen/\n"})
    paths = {"a.log": True, "keep.log": False, "only.py": True, "src/only.py": False, "src/gen/x.rs": True, "gen/x.rs": False, "node_modules/x.js": True, ".hidden/x.rs": True, "src/.x.rs": True, "src/lib.rs": False, "build": False}
    assert {p: rules.passes_over(p) for p in paths} == paths
    some = spark.createDataFrame([("src/lib.rs",), ("data.bin",)], "path string")
    assert [r["path"] for r in scan.contents(spark, project, some).collect()] == ["src/lib.rs"]
    assert scan.contents(spark, project, some.limit(0)).count() == 0


def test_reindex_and_conflict(spark, project, tmp_path):
    from codequarry.session import Conflict

    index = Index(spark, f"file://{tmp_path}/index")
    index.index(project)
    with open(os.path.join(project, "src/lib.rs"), "a") as file:
        file.write("fn third() {}\n")
    seen = index.reindex_file(project, "src/lib.rs", preview=True, symbol="third")
    assert (seen["state"], seen["chunks"] >= 3, "fn third" in seen["preview"]) == ("modified", True, True) and index.chunks.where("ident = 'third'").count() == 0
    assert index.reindex_file(project, "src/lib.rs")["symbols"].count("third") == 1 and index.chunks.where("ident = 'third'").count() == 1
    version = index.pointer()["version"]
    assert index.commit(index.files, index.chunks, index.refs, version) == version + 1
    with pytest.raises(Conflict):
        index.commit(index.files, index.chunks, index.refs, version)
    with pytest.raises(LookupError):
        index.reindex_file(project, "src/none.rs")
    with pytest.raises(LookupError):
        index.deps("src/none.rs")
    assert [r["content"] for r in index.context("helper").first()["bodies"]] == ["fn helper(a: u32) -> u32 { a }"]
    assert {r["changed"] for r in index.diff(project, "src/lib.rs", "helper").collect()} == {False}


def test_impact_and_ledger(spark, tmp_path):
    root = tmp_path / "q"
    (root / "src").mkdir(parents=True)
    (root / "Cargo.toml").write_text("[package]\n")
    (root / "src/lib.rs").write_text("pub fn add(a: u32) -> u32 { a }\n\nfn adds() { add(1); }\n\n#[test]\nfn checks() { adds(); }\n")
    index = Index(spark, f"file://{tmp_path}/index")
    index.index(str(root))
    found = index.analyse_tests(str(root), "add", "src/lib.rs")
    assert [(r["symbol"], r["strategy"]) for r in found["tests"]] == [("checks", "transitive")]
    assert (found["confirmed"], found["warning"], found["command"], found["similar"]) == (1, None, "cargo test checks", ["adds"])
    index.charge("read", 40, "src/lib.rs", "add")
    index.charge("refs", 40, symbol="add")
    index.charge("overview", 40)
    index.charge("verify", 40, fixed=7)
    index.charge_edit("insert", 4000, 0, 200, 40)
    rows = {r["command"]: r for r in spark.read.parquet(f"file://{tmp_path}/index/savings").collect()}
    assert rows["verify"]["alternative_tokens"] == 7 and rows["read"]["alt_calls"] == 2 and rows["insert"]["alternative_tokens"] == 1095 and rows["refs"]["files_touched"] == 1
    assert index.savings().first()["operations"] == 5
