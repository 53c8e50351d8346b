import pytest

from codequarry.llm import truncation as t

DOCS = "doc_id long, text string, source string, n_chars long, kind string, state string"


@pytest.mark.parametrize(
    "text, kind, state",
    [
        (None, None, ""), ("  \n", None, ""), ("All is well.", "issue", "ended"), ("All is well. LGTM", "review", "word"), ("The end is not the", "issue", "sentence"), ("A `code", "issue", "structure"), ("Text.\n\n```\ncode();\n", "note", "structure"),
        ("Text.\n\n```\ncode();\n```", "note", "ended"), ("Also, ```go\nx()\n```\n\nDone.", "note", "ended"), ("Broken \ufffd", "note", "broken"), ("We saw it (truncated)", "note", "marked"), ("To be continued…", "note", "dots"), ("# A Title Of It", "title", "title"),
        ("Some words here and ", "note", "space"), ("fn f() {\n    g();\n}\n", "code", "ended"), ("fn f() {\n    g(", "code", "structure"), ("fn f() {\n    g(\"abc", "code", "structure"), ("def f(x):\n    y = 1\n    return y", "code", "line"), ("- drop support for x", "changelog", "word"),
        ("Note: drop support for it", "commit", "word"), ("FYI, move it into its own loom", "commit", "word"), ("The parts are", "issue", "sentence"), ("The parts,", "issue", "structure"), ("x = 1\n" * 400 + "def f(x):\n    y = {\n        1: 2,\n    }\n    return y", "code", "line"),
    ],
)
def test_states(text, kind, state):
    assert t.examine(text, kind)[0] == state


def test_corpus(spark):
    rows = []

    def add(text, source, n=None, kind="note"):
        rows.append((len(rows), text, source, len(text) if n is None and text is not None else n, kind, "z"))
        return len(rows) - 1

    for i in range(60):
        add(f"The store number {i} keeps a list of all its open parts for the next reader of it." + " More of it." * i, "wide")
        add(f"- drop support for part {i ** 3}\n- faster reads on start\n- move list into its own store", "wide", kind="changelog")
        add(f"The store number {i} keeps a list of all its open parts. " * 3, "bytes", n=len(f"The store number {i} keeps a list of all its open parts. " * 3) + 1)
    limited = [add(("The parts of it are many and each one has its own name and list. " * 4)[i : i + 200], "narrow") for i in range(8)]
    whole = add("x" * 10 + " is short.", "narrow")
    claim = add("- drop support for part 3\n- faster reads on start", "wide", n=400, kind="changelog")
    phrase = add("- drop support for part 3\n- drop support for", "wide", kind="changelog")
    blank = [add(None, "wide"), add("", "wide"), add(" ", "wide")]
    df = spark.createDataFrame(rows + rows[-1:], DOCS)
    got = {r["doc_id"]: r["reason"] for r in t.truncated(df).collect()}
    assert set(limited) - {i for i in limited if rows[i][1].rstrip().endswith(".")} <= set(got)
    assert got[claim] == "claim" and got[phrase] == "phrase" and whole not in got and not set(blank) & set(got)
    assert set(got) <= {*limited, claim, phrase}
    rates = {r["source"]: (r["documents"], r["truncated"]) for r in t.truncation_rates(df).collect()}
    assert rates["bytes"] == (60, 0) and rates["wide"] == (122, 2)
    assert t.truncated(df.limit(0)).count() == 0
    assert t.truncated(df.drop("kind").where("doc_id < 3")).count() == 0


def test_cut_texts_do_not_witness_for_common_words(spark):
    """Cut texts that end in a common word raise its count of line ends; the rule holds by share, at every size."""
    rows = [(i, f"- drop support for part{i} of it\n" * (20 + i) + "- faster reads", "wide", None, "changelog", "z") for i in range(60)]
    cut = [(1000 + i, f"- drop support\n- rename piece{i} of", "wide", None, "changelog", "z") for i in range(4)]
    got = {r["doc_id"]: r["reason"] for r in t.truncated(spark.createDataFrame(rows + cut, DOCS)).collect()}
    assert got == dict.fromkeys((r[0] for r in cut), "phrase")


def test_sources_without_terminators(spark):
    """Where texts of a source and kind hardly ever end with a terminator, a missing one says nothing."""
    rows = [(i, f"Rename part{i} of the list into store{i % 3}", "free", None, "commit", "z") for i in range(40)]
    rows += [(100 + i, f"Rename part{i} of the list into store{i % 3}.", "strict", None, "commit", "z") for i in range(40)]
    rows += [(200, "Rename part200 of the list into store1", "strict", None, "commit", "z"), (201, "Rename part201 of the list into store1", None, None, None, "z")]
    rows += [(300 + i, "Keeps store0\nKeeps store1\nKeeps store2\n" * 3 + "Done with it all.", "free", None, "note", "z") for i in range(9)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["reason"] for r in t.truncated(df).collect()}
    assert got.get(200) == "sentence" and not set(got) & set(range(40)) and not set(got) & set(range(100, 140))
