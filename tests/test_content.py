import pytest

from codequarry.operators import content


def df(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, content string")


def rows(d, *columns):
    return sorted(tuple(r[c] for c in columns) for r in d.collect())


def test_uniform(spark):
    got = rows(content.partition_uniform(df(spark, "1\n2\n3\n4\n5\n", "", None, "a\r\nb"), 2), "file_id", "index", "start_line", "end_line", "content")
    assert got == [(0, 0, 1, 2, "1\n2"), (0, 1, 3, 4, "3\n4"), (0, 2, 5, 5, "5"), (3, 0, 1, 2, "a\nb")]
    with pytest.raises(ValueError):
        content.partition_uniform(df(spark, "x"), 0)


def test_keyword(spark):
    got = rows(content.partition_keyword(df(spark, "K\nK\na\nb\nK\nc"), "^K"), "index", "start_line", "end_line")
    assert got == [(0, 1, 1), (1, 2, 2), (2, 3, 4), (3, 5, 5), (4, 6, 6)]


def test_sections(spark):
    got = rows(content.markdown_sections(df(spark, "x\n# A\nt\n## B\n# C\n#\n", "plain", " \n", "")), "file_id", "ident", "start_line", "end_line", "parent")
    assert got == [(0, "A", 2, 3, None), (0, "B", 4, 4, "A"), (0, "C", 5, 6, None), (1, "(document)", 1, 1, None)]


def test_pages(spark):
    got = rows(content.pages(df(spark, "one\f \ftwo"), "file_id", "content"), "ident", "start_char", "content")
    assert got == [("Page 1", 0, "one"), ("Page 3", 6, "two")]


def test_strategies(spark):
    with pytest.raises(ValueError):
        content.partition("uniform:x", None, None, None)
    with pytest.raises(ValueError):
        content.partition("other", None, None, None)


def test_json_entries(spark):
    got = rows(content.json_entries(df(spark, '{"a": 1, "b": "x"}', "[1]", "no", None), "file_id", "content"), "file_id", "path", "value")
    assert got == [(0, "a", "1"), (0, "b", "x")]
