import pytest
from hypothesis import given, settings, strategies as st

from codequarry.functions import columns as C
from codequarry.sources import parsers

SAMPLES = {
    "rust": ("use a::b;\n#[derive(X)]\npub struct Shape { r: f64 }\nimpl Shape {\n    /// Area.\n    pub fn area(&self) -> f64 { calc(self.r) }\n}\nenum Kind { One, Two(u8) }\nconst MAX: u32 = 3;\n", {("struct", "Shape"), ("impl", "Shape"), ("method", "area"), ("enum", "Kind"), ("enum_variant", "One"), ("enum_variant", "Two"), ("const", "MAX"), ("imports", "_imports")}),
    "go": ('package p\n\nimport "fmt"\n\ntype T struct {\n\tx int\n}\n\nfunc New() *T { return nil }\n\nfunc (t *T) Run(a int) {\n\tfmt.Println(a)\n}\n', {("struct", "T"), ("fn", "New"), ("method", "Run"), ("imports", "_imports")}),
    "java": ("import java.util.List;\n\npublic class A {\n    /** Doc. */\n    @Override\n    public int run(int x) { return go(x); }\n    enum E { X }\n}\ninterface B {}\n", {("class", "A"), ("method", "run"), ("enum", "E"), ("interface", "B"), ("imports", "_imports")}),
    "csharp": ("using System;\nnamespace N {\n  public class A {\n    public int Run(int x) { return Go(x); }\n  }\n}\n", {("mod", "N"), ("class", "A"), ("method", "Run"), ("imports", "_imports")}),
    "php": ("<?php\nclass A {\n  public function run($x) { return go($x); }\n}\nfunction free() {}\n", {("class", "A"), ("method", "run"), ("fn", "free")}),
    "javascript": ('import { a } from "m";\nexport function f(x) { return g(x); }\nconst h = (y) => g(y);\nclass K {\n  run(z) { return z; }\n}\n', {("fn", "f"), ("fn", "h"), ("class", "K"), ("method", "run"), ("imports", "_imports")}),
    "typescript": ('import { a } from "m";\nexport interface I { x: number; }\nexport type T = I;\nexport class K {\n  run(z: number): number { return z; }\n}\nfunction f(x: I) { return g(x); }\n', {("interface", "I"), ("type_alias", "T"), ("class", "K"), ("method", "run"), ("fn", "f"), ("imports", "_imports")}),
    "python": ('import os\n\nclass A:\n    """Doc."""\n    def run(self, x: int):\n        return go(x)\n\ndef _free():\n    pass\n', {("class", "A"), ("method", "run"), ("fn", "_free"), ("imports", "_imports")}),
    "markdown": ("pre\n# A\ntext\n## B\n", {("section", "A"), ("section", "B")}),
    "css": ("@import 'x';\n.a, .b { color: red }\n@media (x) { .c { d: e } }\n", {("rule", ".a"), ("rule", ".c"), ("media", "@media (x)"), ("imports", "_imports")}),
    "html": ('<!DOCTYPE html><div id="m" class="a b"><a href="/x">t</a></div><script>x()</script>', {("section", "_doctype"), ("section", "m"), ("section", "_script")}),
    "json": ('{"name": "x", "scripts": {"run": "y"}, "list": [{"name": 1}]}', {("string", "name"), ("object", "scripts"), ("string", "scripts.run"), ("array", "list"), ("number", "list[0].name")}),
    "toml": ('name = "x"\n[deps]\nversion = 1\n', {("string", "name"), ("object", "deps"), ("number", "deps.version")}),
    "pdf": ("one\f\ftwo", {("page", "Page 1"), ("page", "Page 3")}),
    "sql": ("select 1", {("section", "(document)")}),
}


@pytest.mark.parametrize("lang", SAMPLES)
def test_kinds_and_names(lang):
    text, expected = SAMPLES[lang]
    chunks, refs, quality = parsers.rows_of(text, lang)
    assert {(c["kind"], c["ident"]) for c in chunks} == expected
    assert quality == "complete"
    data = text.encode()
    for c in chunks:
        assert c["ident"] == "_imports" or data[c["start_byte"] : c["end_byte"]].decode() == c["content"]
    for r in refs:
        assert any(c["start_line"] <= r["line"] <= c["end_line"] for c in chunks)


@pytest.mark.parametrize("lang", SAMPLES)
def test_odd_inputs(lang):
    text = SAMPLES[lang][0]
    assert parsers.rows_of("", lang)[0] == []
    parsers.rows_of(text.replace("\n", "\r\n"), lang)
    parsers.rows_of(text[:50], lang)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from(sorted(SAMPLES)), st.text(alphabet='{}()[];"\'\n# aé/*=<>', max_size=80))
def test_never_fails(lang, text):
    chunks, _, _ = parsers.rows_of(text, lang)
    data = text.encode()
    for c in chunks:
        assert c["ident"] == "_imports" or data[c["start_byte"] : c["end_byte"]].decode() == c["content"]


def test_details():
    chunks, refs, _ = parsers.rows_of(SAMPLES["rust"][0], "rust")
    area = next(c for c in chunks if c["ident"] == "area")
    assert (area["parent"], area["visibility"], area["doc_comment"], area["signature"]) == ("Shape", "pub", "/// Area.", "pub fn area(&self) -> f64")
    assert ("calc", "call") in {(r["target_ident"], r["ref_kind"]) for r in refs}
    chunks, _, _ = parsers.rows_of(SAMPLES["go"][0], "go")
    assert {c["ident"]: c["visibility"] for c in chunks if c["kind"] in ("fn", "method")} == {"New": "pub", "Run": "pub"}
    assert parsers.rows_of("fn a( {", "rust")[2] == "partial" and parsers.rows_of("def f(:", "python")[2] == "partial"


def test_on_spark(spark):
    rows = spark.createDataFrame([(1, "rust", SAMPLES["rust"][0]), (2, "python", None)], "file_id long, lang string, content string")
    parsed = parsers.parse_sources(rows)
    assert parsers.chunk_rows(parsed).count() == 8 and parsers.chunk_rows(parsed).select("chunk_id").distinct().count() == 8
    assert parsers.ref_rows(parsed).count() > 0
    assert parsers.supported_extensions(spark).count() > 40


def test_added_parser(spark, monkeypatch):
    from codequarry import schema

    for name in ("LANGUAGES", "EXTENSIONS", "PARSERS"):
        monkeypatch.setattr(schema, name, dict(getattr(schema, name)))
    monkeypatch.setattr(schema, "SUPPORTED", list(schema.SUPPORTED))
    monkeypatch.setattr(parsers, "_ADDED", {})
    parsers.register("notes", lambda text: parsers.Parsed([parsers.Chunk("section", text.split()[0], 0, len(text))]), ["note"])
    rows = spark.createDataFrame([(1, "notes", "hello there"), (2, "notes", "")], "file_id long, lang string, content string")
    parsed = parsers.parse_sources(rows)
    assert [(r["ident"], r["content"]) for r in parsers.chunk_rows(parsed).collect()] == [("hello", "hello there")]
    assert {r["file_id"]: r["parse_quality"] for r in parsed.collect()} == {1: "complete", 2: "failed"}
    assert spark.createDataFrame([("a/b.note",)], "path string").select(C.language("path"), C.supported("path")).first()[:] == ("notes", True)


def test_value_previews():
    assert [parsers.value_preview(v) for v in ({"a": 1}, [1, 2], "x", None, 1.5)] == ["{1 keys}", "[2 items]", '"x"', "null", "1.5"] and len(parsers.value_preview("y" * 99)) == 40
