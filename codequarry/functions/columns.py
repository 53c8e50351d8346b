"""Scalar functions of the engine as Spark column expressions; all stay inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from codequarry import schema


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extension(path: str | Column) -> Column:
    """Lower-case extension of a path, '' if it has none."""
    return F.lower(F.regexp_extract(col(path), r"\.([^./]+)$", 1))


def language(path: str | Column) -> Column:
    """Language by extension, 'unknown' otherwise."""
    ext = extension(path)
    known = reduce(lambda c, lang: c.when(ext.isin(schema.LANGUAGES[lang]), lang), schema.LANGUAGES, F.when(F.lit(False), ""))
    return known.otherwise("unknown")


def supported(path: str | Column) -> Column:
    return extension(path).isin(schema.SUPPORTED)


def ui_context(path: str | Column) -> Column:
    """Where in a user interface a file belongs, by its path; the first matching rule decides, null if none does."""
    p = F.lower(col(path))
    return (
        F.when(p.contains("/pages/") | p.contains("/app/"), "page")
        .when(p.contains("/components/"), "component")
        .when(p.contains("/screens/"), "screen")
        .when(p.contains("/layouts/"), "layout")
        .when(p.rlike(r"\.(tsx|jsx|vue)$"), "ui")
    )


def file_hash(content: str | Column) -> Column:
    return F.sha2(F.encode(col(content), "UTF-8"), 256)


def text_tokens(size: Column) -> Column:
    """Tokens of a text of ``size`` bytes."""
    return F.ceil(size / 4)


def json_tokens(size: Column) -> Column:
    return F.ceil(size / 2)


def with_line_overhead(tokens: Column) -> Column:
    return tokens + F.floor(tokens / 10)


def read_cost(size: Column) -> Column:
    """Tokens that reading a whole file of ``size`` bytes costs."""
    return with_line_overhead(text_tokens(size))


def percentage(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)


def lines(text: str | Column) -> Column:
    """The lines of a text, LF or CRLF, without a trailing empty one; the empty text has none."""
    parts = F.split(F.regexp_replace(col(text), "\r\n", "\n"), "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def ref_kind(kind: str | Column) -> Column:
    """Unknown kinds of references count as calls."""
    return F.when(col(kind).isin(schema.REF_KINDS), col(kind)).otherwise("call")


def is_public(visibility: str | Column) -> Column:
    return F.coalesce(col(visibility).isin("pub", "public"), F.lit(False))


def line_count(start: str | Column, end: str | Column) -> Column:
    return F.greatest(col(end) - col(start), F.lit(0)) + 1


def file_name(path: str | Column) -> Column:
    return F.substring_index(col(path), "/", -1)


def stem(path: str | Column) -> Column:
    """The file name up to its last dot."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def is_test_file(path: str | Column, lang: str | Column) -> Column:
    """Whether a path is a test file by the conventions of its language; paths are relative to the project."""
    p, n, lang = col(path), file_name(path), col(lang)
    return F.coalesce(
        F.when(lang == "rust", p.startswith("tests/") | p.endswith("_tests.rs") | p.endswith("_test.rs"))
        .when(lang == "java", p.startswith("src/test/") | n.rlike(r"^.+Tests?\.java$"))
        .when(lang == "python", p.startswith("tests/") | p.endswith("_test.py") | n.rlike(r"^test_.*\.py$"))
        .when(lang.isin("javascript", "typescript"), p.startswith("__tests__/") | p.contains("/__tests__/") | n.contains(".test.") | n.contains(".spec."))
        .when(lang == "go", p.endswith("_test.go"))
        .when(lang == "csharp", n.rlike(r"^.+Tests\.cs$") | (n.contains(".Test.") & n.endswith(".cs")))
        .when(lang == "php", n.rlike(r"^.+Test\.php$")),
        F.lit(False),
    )


def is_test_chunk(lang: str | Column, ident: str | Column, attributes: str | Column) -> Column:
    lang, ident, attributes = col(lang), col(ident), F.coalesce(col(attributes), F.lit(""))
    return F.coalesce(
        F.when(lang == "rust", attributes.contains("#[test]"))
        .when(lang == "java", attributes.contains("@Test"))
        .when(lang == "python", ident.startswith("test_") | attributes.contains("@pytest") | attributes.contains("@unittest"))
        .when(lang == "go", ident.startswith("Test"))
        .when(lang == "csharp", attributes.rlike(r"\[(Fact|Theory|Test|TestMethod)\]"))
        .when(lang == "php", ident.startswith("test_") | attributes.contains("#[Test]")),
        F.lit(False),
    )


def stem_covers(source: str | Column, test: str | Column) -> Column:
    """Whether a test file's stem names a source file's: equal, or with the source as a word at its start or end."""
    s, t = col(source), col(test)
    n = F.length(s)
    after, before = F.substr(t, n + 1, F.lit(1)), F.substr(t, F.length(t) - n, F.lit(1))
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    head = F.startswith(t, s) & (after.isin("_", ".") | (last.rlike("[a-z]") & after.rlike("[A-Z]")))
    tail = F.endswith(t, s) & (before.isin("_", ".") | (before.rlike("[a-z]") & first.rlike("[A-Z]")))
    return F.coalesce((s == t) & (n > 0) | (n > 0) & (F.length(t) > n) & (head | tail), F.lit(False))
