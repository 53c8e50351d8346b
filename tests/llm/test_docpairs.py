import pytest

from codequarry.llm import docpairs as d


@pytest.mark.parametrize(
    "doc, name, expected",
    [
        ("/// Adds two numbers.", "add", True), ("/// TODO", "add", False), ("/**\n * TODO: document\n */", "add", False), ("// ----------", "add", False), ("///", "add", False), ("", "add", False), (None, "add", False),
        ("/** {@inheritDoc} */", "add", False), ("# N/A", "add", False), ("See above.", "add", False), ("Idempotent.", "add", True), ("x", "f", False), ("ok", "f", False), ("Sum", "f", True), ("/// addNumber", "addNumber", False), ("/// Add number.", "addNumber", False), ("The add number function.", "add_number", False),
        ("/**\n * @param x\n * @return\n */", "f", False), ("/**\n * @param x the count\n */", "f", True), (":param x:\n:return:", "f", False), (":param x: how many", "f", True), ("/// total_sum = totalSum(a, 2)", "f", False), ("TODO later: cover big inputs as well", "f", True),
        ('"""Auto-generated method stub"""', "f", False), ('"""', "f", False), ("Liefert den ersten Wert.", "f", True), ("```\n```", "f", False), ("/// return x;", "f", False),
    ],
)
def test_says_something(doc, name, expected):
    assert d.says_something(doc, name) is expected


def test_description():
    assert d.description("/**\n * Adds.\n * ----\n * @param x\n * @param y the rest\n */") == "Adds.\n@param y the rest"


def test_nodes():
    text = "@deco\ndef f(a: int) -> int:\n    '''Doc é.'''\n    return a\n"
    node = d.parse_function(text)
    assert (node.name, node.doc, text[node.body_start : node.body_end]) == ("f", "Doc é.", "'''Doc é.'''\n    return a")
    broken = d.parse_function('def f(a, b=(1, 2)):\n    """Doc."""\n    return (\n')
    assert (broken.name, broken.doc, broken.body_end) == ("f", "Doc.", len('def f(a, b=(1, 2)):\n    """Doc."""\n    return (\n'))
    text = "    @deco(1)\n    def f(self):\n        'One.'\n        return 1\n\n    def g(self):\n        'Two.'\n"
    assert [(n.name, n.doc) for n in d.parse_functions(text)] == [("f", "One."), ("g", "Two.")] and d.parse_function(text, "python", "g").doc == "Two."
    assert text[d.parse_function(text).body_start : d.parse_function(text).body_end] == "'One.'\n        return 1"


@pytest.mark.parametrize(
    "lang, text, name, signature, body",
    [
        ("rust", "pub fn g(x: &'a str) -> String {\n    let s = \"}\"; // }\n    s\n}\n", "g", "pub fn g(x: &'a str) -> String", "{\n    let s = \"}\"; // }\n    s\n}"),
        ("rust", "#[inline]\nfn a<T: Into<X>>(x: T) -> Result<(), E> where T: Fn(u8) -> u8 { b('}'); }\nfn b() {}\n", "a", "fn a<T: Into<X>>(x: T) -> Result<(), E> where T: Fn(u8) -> u8", "{ b('}'); }"),
        ("java", "@Override\n@Named(a = \"(\")\npublic int getX(int a) throws E {\n    return a > 1 ? f(b) : g(\"}\");\n}\n", "getX", "public int getX(int a) throws E", "{\n    return a > 1 ? f(b) : g(\"}\");\n}"),
        (None, "@Override int f() { return 1; }", "f", "int f()", "{ return 1; }"),
        ("java", "public <T> List<T> of(T... xs) { return null; }", "of", "public <T> List<T> of(T... xs)", "{ return null; }"),
        ("typescript", "@Input({a: 1})\nasync load<T extends {a: 1}>(x: T, cb: (y: number) => void): Promise<{ a: number }> {\n  return /}\\//.test(x) ? `a${`}`}` : 1;\n}\n", "load", "async load<T extends {a: 1}>(x: T, cb: (y: number) => void): Promise<{ a: number }>", "{\n  return /}\\//.test(x) ? `a${`}`}` : 1;\n}"),
        ("typescript", "abstract m(a: number): void;", "m", "abstract m(a: number): void", ""),
        ("go", "func (s *T) Get(k string) (map[string]interface{}, error) {\n\treturn nil, nil\n}\n", "Get", "func (s *T) Get(k string) (map[string]interface{}, error)", "{\n\treturn nil, nil\n}"),
        ("go", "func Mk() interface{} {\n\treturn 1\n}\n", "Mk", "func Mk() interface{}", "{\n\treturn 1\n}"),
        ("javascript", "export const add = async (a, b = {x: 1}) => {\n  return a + b;\n};\n", "add", "export const add = async (a, b = {x: 1}) =>", "{\n  return a + b;\n}"),
        ("javascript", "export default function ({ a }) { if (a) { b(); } }", None, "export default function ({ a })", "{ if (a) { b(); } }"),
        ("javascript", "const inc = x => x + 1;\n", "inc", "const inc = x =>", "x + 1"),
    ],
)
def test_brace_nodes(lang, text, name, signature, body):
    for shape in (text, text.replace("\n", "\r\n")):
        node = d.parse_function(shape, lang)
        got = (node.name, shape[node.start : node.signature_end].strip(), shape[node.body_start : node.body_end])
        assert tuple(x and x.replace("\r\n", "\n") for x in got) == (name, signature, body)


def test_two_functions():
    text = "fn a() { b() }\nfn b() { a() }\n"
    assert [n.name for n in d.parse_functions(text, "rust")] == ["a", "b"]
    node = d.parse_function(text, "rust", "b")
    assert text[node.body_start : node.body_end] == "{ a() }" and d.parse_function(text, "rust", "zz").name == "a"
    for odd in ("", "}", "((", "fn", "@", "#[", "fn f(", "x" * 300_000, "{" * 5000):
        for lang in ("rust", "java", "python", None):
            assert d.parse_function(odd, lang) is not None


def test_pairs(spark):
    rows = [
        (1, "fn", "f", None, "/// Says a thing.", "fn f() { 1 }", "z"), (1, "fn", "f", None, "/// Says a thing.", "fn f() { 1 }", "z"), (2, "method", "g", "def g(x)", None, 'def g(x):\n    """Real words."""\n', "z"), (3, "fn", "h", None, None, "fn h() {}", "z"),
        (4, "class", "K", None, "/// Says a thing.", "class K {}", "z"), (5, "fn", None, None, "/// Words.", None, "z"), (6, "fn", "f", None, "", 'def f():\n    """Real words."""\n', "z"), (7, "fn", "q", None, None, None, "z"),
    ]
    df = spark.createDataFrame(rows, "chunk_id long, kind string, ident string, signature string, doc_comment string, content string, description string")
    got = {r["chunk_id"]: r for r in d.function_pairs(df).collect()}
    assert set(got) == {1, 2, 5} and d.function_pairs(df).count() == 3
    assert (got[1]["signature"], got[1]["description"], got[2]["doc_source"], got[2]["description"]) == ("fn f()", "Says a thing.", "docstring", "Real words.")
    assert {r["chunk_id"] for r in d.documented_functions(df).collect()} == {1, 2, 5}
    assert d.function_pairs(df.limit(0)).count() == 0
    files = spark.createDataFrame([(1, "java", "z"), (1, "java", "z"), (2, "python", "z"), (None, "rust", "z")], "file_id long, lang string, content string")
    rows = [(1, 1, "method", "f", None, "Says it.", "@Override\nint f() { return a ? b : c; }"), (2, 2, "fn", "f", None, None, "@deco\ndef f():\n    'Says it.'\n"), (3, 1, "fn", "f", None, None, "def f():\n    'Says it.'\n"), (4, 9, "fn", "f", None, None, "def f():\n    'Says it.'\n"), (5, None, "fn", "f", None, "Says it.", "fn f() {}")]
    df = spark.createDataFrame(rows, "chunk_id long, file_id long, kind string, ident string, signature string, doc_comment string, content string")
    got = {r["chunk_id"]: r["signature"] for r in d.function_pairs(df, files).collect()}
    assert got == {1: "int f()", 2: "def f():", 4: "def f():", 5: "fn f()"}
