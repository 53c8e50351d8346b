import numpy as np
import pytest

from codequarry.llm import handwritten as h
from codequarry.llm.forest import Forest


def test_forest_separates_held_out():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 6))
    y = ((x[:, 1] > 0.3) | (x[:, 4] < -1)).astype(int)
    forest = Forest.fit(x[:600], y[:600])
    assert ((forest.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.93


@pytest.mark.parametrize(
    "header, kind",
    [
        ("// Code generated by x; DO NOT EDIT.", "generated"), ("# Autogenerated with y 0.1", "generated"), ("// Output of z, run `make` to refresh. Manual changes will be lost.", "generated"), ("# Erzeugt von q, nicht von Hand bearbeiten.", "generated"),
        ("// lib v1.2.3 | MIT-style terms | lib authors", "third-party"), ("// Copied from upstream lib 3.1, local changes will be overwritten.", "third-party"), ("/*! tool */", "third-party"),
        ("// Part of the app project, see NOTICE for terms.", None), ("/// Auto-generated method stub", None), ("", None),
    ],
)
def test_notices(header, kind):
    assert h.notice_of(header)[0] == kind


def test_notice_is_hidden_from_features():
    body = "fn f() {\n    go(1);\n}\n"
    text = "// Code generated by x; DO NOT EDIT.\n\n" + body
    assert text[len(h.header_of(text)) :] == body
    assert h.header_of("#[test]\nfn f() {}") == "" and h.header_of('"""Doc."""\nx = 1\n') == '"""Doc."""\n'
    assert len(h.text_features("")) == len(h.text_features(body)) == len(h.FEATURES) - 3


def test_files(spark):
    def code(seed, repo):
        words = "alpha beta gamma delta epsilon zeta eta theta".split()
        return "".join(f"/// Does {words[(seed + k) % 8]} for {repo} number {seed * 31 + k}.\npub fn {words[k % 8]}_{repo}_{seed}_{k}(x: u32) -> u32 {{\n    let total = x + {seed * 7 + k};\n    total\n}}\n\n" for k in range(6))

    files, sources = [], []

    def add(path, text, lang="rust"):
        files.append((len(files) + 1, path, lang, 0, "clash"))
        sources.append((len(files), text, "clash"))
        return len(files)

    own = [add(f"r{i % 3}/src/m{i}.rs", f"// Part of the r{i % 3} project, see NOTICE for terms.\n" + code(i * 41 % 997, f"r{i % 3}")) for i in range(40)]
    plain = [add(f"r{i % 3}/src/p{i}.rs", code(100 + i, f"r{i % 3}")) for i in range(9)]
    vendored = [add(f"r{i}/lib/v.rs", code(500, "v")) for i in range(3)] + [add(f"r{i}/lib/w.rs", "// lib v1.0 | free terms | lib authors\n" + code(600, "w")) for i in range(3)]
    table = [add(f"r0/src/t{i}.rs", "pub static T: &[u32] = &[\n" + ", ".join(str(k * 37 % 991) for k in range(900)) + "\n];\n") for i in range(3)]
    noticed = [add("r0/src/g.rs", "// Code generated by q; DO NOT EDIT.\n" + code(700, "g")), add("r1/src/x.generated.rs", code(701, "g"))]
    empty = add("r0/src/e.rs", None)
    add("r0/readme.md", "# x", "markdown")
    got = {r["file_id"]: r["written_by_hand"] for r in h.scored(spark.createDataFrame(files, "file_id long, path string, lang string, size_bytes long, score string"), spark.createDataFrame(sources + sources[:1], "file_id long, content string, score string")).collect()}
    assert len(got) == len(files) - 1
    assert [i for i in own + plain + [empty] if not got[i]] == []
    assert not any(got[i] for i in vendored + table + noticed)
    report = {r["witness"]: (r["files"], r["flagged"]) for r in h.held_out(spark.createDataFrame(files, "file_id long, path string, lang string, size_bytes long, score string"), spark.createDataFrame(sources, "file_id long, content string, score string")).collect()}
    assert report["own"] == (40, 0)


def test_no_labels(spark):
    files = spark.createDataFrame([(1, "r/a.rs", "rust", 1)], "file_id long, path string, lang string, size_bytes long")
    sources = spark.createDataFrame([(1, "fn a() {}")], "file_id long, content string")
    assert h.not_handwritten(files, sources).count() == 0
    assert h.not_handwritten(files.limit(0), sources.limit(0)).count() == 0
    assert h.held_out(files, sources).count() == 0
