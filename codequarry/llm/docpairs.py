"""Functions paired with their documentation.

Every function chunk is parsed, in the language of its file, to function nodes: Python by its abstract syntax tree, the other languages
by a header and body parser over tokens that knows annotations, receivers, type parameters, results and arrows.  All nodes of a chunk
are visited; the one that bears the chunk's name is its function.  The node gives the exact source ranges of signature and body, and where
Python keeps the documentation.  A description counts if it has at least ``LEAST_LETTERS`` letters and, beyond marks and empty tags,
anything is left that is no placeholder, no commented-out code and not just the words of the function's own name.

A chunk whose file is not known is Python if it starts like a Python function.
"""

from __future__ import annotations

import ast
import itertools
import re
import textwrap
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.batches import slices

#: Descriptions with fewer letters are too short to say anything.
LEAST_LETTERS = 3

# Phrases that stand where documentation should be.
PLACEHOLDERS = frozenset(
    [
        "todo", "fixme", "xxx", "tbd", "tba", "n/a", "na", "none", "nothing", "wip", "hack", "todo document", "todo document this",
        "fixme document", "todo doc", "todo docs", "todo add docs", "todo write docs", "todo describe", "todo description", "document me", "to do",
        "to be documented", "to be done", "undocumented", "not documented", "no documentation", "missing documentation",
        "missing docs", "auto generated method stub", "autogenerated method stub", "todo auto generated method stub", "generated method stub", "method stub", "stub",
        "auto generated", "autogenerated", "generated", "inheritdoc", "inherit doc", "see above", "see below", "as above",
        "same as above", "ditto", "placeholder", "description", "description here", "documentation", "doc", "docs", "comment", "summary", "no description",
    ]
)
#: Words that add nothing to a function's own name.
_EMPTY_WORDS = frozenset("the a an this that function method func fn procedure routine helper of for to and is it its".split())
#: Section headings without text of their own.
_HEADINGS = frozenset("args arguments parameters params param returns return yields raises throws errors panics safety example examples note notes see usage attributes".split())

_MARKS = re.compile(r"^[ \t]*(?:/\*+!?|///?!?|//!|\*+/|\*(?!\*)|#+!?|--+(?=\s)|<!--|\"\"\"|''')?[ \t]?|[ \t]*(?:\*+/|-->)[ \t]*$", re.M)
_RULE = re.compile(r"^[\W_]*$")
_TAG = re.compile(r"^(?:[@\\](?P<tag>\w+)|:(?P<field>\w+)(?P<arg>[^:]*):)(?P<rest>.*)$", re.S)
_NAMED_TAGS = frozenset("param parameter arg argument throws throw exception raises raise tparam type property prop key keyword".split())
_CODE = re.compile(
    r"""^(?:
      [\w.$\[\]]+\s*(?:[-+*/|&]?=|:=)\s*\S.*          # assignment
    | (?:let|const|var|final|int|auto|mut)\s+[\w<>\[\]$]+.*(?:=|;)\s*.*
    | (?:await\s+|return\s+|throw\s+|new\s+)?[\w.$:]+\(.*\)\s*[;{]?  # call
    | return\b[^.]*;
    | (?:if|for|while|switch|match|else|try|catch|func|fn|def|class|import|from|use)\b.*(?:[{;:]|\)\s*)
    | [{}()\[\];,]+
    )$""",
    re.X,
)
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


def name_words(name: str | None) -> set[str]:
    """Lower-case words of an identifier, and the identifier whole."""
    if not name:
        return set()
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", name)
    return {w.lower() for w in _WORDS.findall(spaced.replace("_", " "))} | {name.lower()}


def plain_lines(doc: str) -> list[str]:
    """The lines of a documentation text without comment and string marks."""
    text = doc.strip().replace("\r\n", "\n").replace("\r", "\n")
    if len(text) >= 6 and (quotes := re.fullmatch(r"[rRbBuUfF]{0,2}(\"\"\"|''')(.*)\1", text, re.S)):
        text = quotes[2]
    elif quotes := re.fullmatch(r"[rRbBuUfF]{0,2}([\"'])([^\n]*)\1", text):
        text = quotes[2]
    return [_MARKS.sub("", line).strip() for line in text.split("\n")]


def description(doc: str | None) -> str:
    """The documentation without marks, ruled lines and tags without text."""
    out = []
    for line in plain_lines(doc or ""):
        tag = _TAG.match(line)
        if tag:
            rest = re.sub(r"^\s*\{[^}]*\}", "", tag["rest"]).strip()
            if (tag["tag"] or tag["field"] or "").lower() in _NAMED_TAGS and tag["tag"]:
                rest = rest.partition(" ")[2].strip()
            if not _WORDS.search(rest):
                continue
        if line and not (_RULE.match(line) and not re.search(r"\d", line)):
            out.append(line)
    return "\n".join(out).strip()


def _says(line: str, own: set[str]) -> bool:
    tag = _TAG.match(line)
    bare = re.sub(r"[{}@*_`\"'.!:;,()\[\]<>-]+", " ", line).strip().lower()
    bare = re.sub(r"\s+", " ", bare)
    if not bare or bare in PLACEHOLDERS or bare in _HEADINGS:
        return False
    if not tag and _CODE.match(line) and not re.search(r"[.!?]$", line):
        return False
    words = {w.lower() for w in _WORDS.findall(line.replace("_", " "))} | {w.lower() for w in re.findall(r"\w+", line)}
    words = {w for w in words if not w.isdigit() and "_" not in w or w in own}
    spread = {w.lower() for w in _WORDS.findall(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", line).replace("_", " "))}
    return bool((words & spread or spread) - own - _EMPTY_WORDS)


def says_something(doc: str | None, name: str | None, least_letters: int = LEAST_LETTERS) -> bool:
    """Whether a documentation text describes the function ``name`` at all; null, blank and too short ones say nothing."""
    own = name_words(name)
    if sum(map(str.isalpha, description(doc))) < least_letters:
        return False
    return any(_says(line, own) for line in description(doc).split("\n") if line)


@dataclass
class FunctionNode:
    """Offsets are characters of the parsed text; ``start`` is behind annotations of a brace language."""

    name: str | None
    start: int
    signature_end: int
    body_start: int
    body_end: int
    doc: str | None = None


_PYTHON = re.compile(r"\s*(?:@[^\n]*\n\s*)*(?:async[ \t]+)?def[ \t]")


#: The end of a header: its colon and the comments behind it.
_COLON = re.compile(r":[^\S\n]*(?:#[^\n]*)?(?:\n\s*(?:#[^\n]*)?)*\Z")


def _python_nodes(text: str) -> list[FunctionNode]:
    """All function nodes of a text that parses, outer ones first."""
    margin = len(text) - len(text.lstrip(" \t"))
    shifted = textwrap.dedent(text) if margin else text
    lines = shifted.split("\n")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(shifted)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    own = text.split("\n")
    cuts = [len(a) - len(b) for a, b in zip(own, lines, strict=False)]
    starts = list(itertools.accumulate((len(x) + 1 for x in own), initial=0))

    def offset(line: int, column: int) -> int:
        return starts[line - 1] + cuts[line - 1] + len(lines[line - 1].encode("utf-8", "surrogatepass")[:column].decode("utf-8", "ignore"))

    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            first, last = node.body[0], node.body[-1]
            start = offset(first.lineno, first.col_offset)
            begin = offset(node.lineno, node.col_offset)
            colon = _COLON.search(text, begin, start)
            out.append(FunctionNode(node.name, begin, colon.start() + 1 if colon else start, start, offset(last.end_lineno, last.end_col_offset), ast.get_docstring(node, clean=False)))
    return out


_HEAD_DOC = re.compile(r"(?:\s*@[^\n]*\n)*\s*(?:async\s+)?def\s+(\w+)\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)[^:\n]*:")
_DOC = re.compile(r"[^\S\n]*(?:#[^\n]*)?\n?\s*[rRuU]?(\"\"\"|'''|\"|')(.*?)\1", re.S)


def _broken_python(text: str) -> FunctionNode:
    """A Python function that does not parse: its end is open, its docstring is sought at its head."""
    head = _HEAD_DOC.match(text)
    if not head:
        name = re.search(r"def\s+(\w+)", text)
        return FunctionNode(name[1] if name else None, 0, len(text), len(text), len(text))
    doc = _DOC.match(text, head.end())
    return FunctionNode(head[1], 0, head.end(), head.end(), len(text), doc[2] if doc else None)


_TOKEN = re.compile(
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(#+)\"[\s\S]*?\"\1|\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\]|\\[\s\S])*\"|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`]|`(?:[^`\\]|\\[\s\S])*`|\{[^{}]*\})*\})*`"
    r"|'(?:[^'\\\n]|\\[^\n])'|'[^\W\d]\w*(?!')|'(?:[^'\\\n]|\\.)*'|[^\W\d][\w$]*|\$[\w$]*|=>|->|::|\d[\w.]*|[^\s\w]"
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_CLOSE = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Words that are followed by brackets but name no function.
_CONTROL = frozenset("if for while switch catch return throw new typeof in match loop else do await super this assert synchronized delete void with where impl async".split())


def _tokens(text: str) -> list[tuple[int, int, str]]:
    """(start, end, text) of the tokens but comments."""
    out: list[tuple[int, int, str]] = []
    at = 0
    while match := _TOKEN.search(text, at):
        token = match[0]
        if token == "/" and (not out or out[-1][2] in "(,=:[!&|?{};=>" or out[-1][2] in ("return", "=>", "case", "typeof")) and (regex := _REGEX.match(text, match.start())):
            match, token = regex, regex[0]
        at = match.end()
        if not token.startswith(("//", "/*")):
            out.append((match.start(), at, token))
    return out


class _Braces:
    """Function nodes of one text of a brace language."""

    def __init__(self, text: str):
        self.text, self.tokens = text, _tokens(text)

    def word(self, k: int) -> str:
        return self.tokens[k][2] if 0 <= k < len(self.tokens) else ""

    def behind(self, k: int) -> int:
        """The place behind the group that opens at ``k``; the end of the text if it is not closed."""
        opener, depth = self.word(k), 0
        while k < len(self.tokens):
            word = self.word(k)
            if word == opener:
                depth += 1
            elif word == _CLOSE[opener]:
                depth -= 1
                if not depth:
                    return k + 1
            elif opener == "<" and word in ("(", "[", "{"):
                k = self.behind(k)
                continue
            elif opener == "<" and word in (")", "]", "}", ";"):
                return k
            k += 1
        return k

    def annotations(self, k: int) -> int:
        """The place behind annotations, decorators and attributes."""
        while True:
            word = self.word(k)
            if word == "@" and self.word(k + 1) != "interface":
                k += 2
                while self.word(k) == ".":
                    k += 2
                k = self.behind(k) if self.word(k) == "(" else k
            elif word == "#" and self.word(k + 1) in ("[", "!"):
                k = self.behind(k + 1 + (self.word(k + 1) == "!"))
            elif word == "[" and k == 0:
                k = self.behind(k)
            else:
                return k

    def nodes(self) -> list[FunctionNode]:
        out, k = [], 0
        while k < len(self.tokens):
            start = self.annotations(k)
            node, k = self.node(start)
            if node:
                out.append(node)
        return out

    def node(self, k: int) -> tuple[FunctionNode | None, int]:
        """The next function at or behind ``k`` and the place behind it."""
        first = k
        bound: str | None = None  # the name a function value is bound to
        while k < len(self.tokens):
            word = self.word(k)
            name, params = None, -1
            if word in ("fn", "func", "function"):
                after = k + 1
                if word == "func" and self.word(after) == "(":
                    after = self.behind(after)
                after += self.word(after) == "*"
                name = self.word(after) if re.match(r"[^\W\d]|\$", self.word(after)) else bound
                after += name is not None and name == self.word(after)
                after = self.behind(after) if self.word(after) in ("<", "[") else after
                params = after if self.word(after) == "(" else -1
            elif re.match(r"[^\W\d]|\$", word) and word not in _CONTROL:
                after = k + 1
                if self.word(after) == "<":
                    after = self.behind(after)
                if self.word(after) == "(" and self.word(k - 1) not in (".", "new", "@"):
                    name, params = word, after
                elif self.word(k + 1) in ("=", ":"):
                    bound = word
            elif word == "(" and bound is not None:
                name, params = bound, k
            elif word == "=>" and bound is not None and k:
                return self.arrow(first, bound, k)
            if params >= 0:
                end = self.behind(params)
                body = self.body(end)
                if self.word(body) == "=>":
                    return self.arrow(first, name, body)
                if self.word(body) == "{" and (name is not bound or word in ("fn", "func", "function")):
                    return self.closed(first, name, body)
                if word in ("fn", "func", "function") or self.word(body) in (";", ""):
                    at = self.tokens[body][0] if body < len(self.tokens) else len(self.text)
                    return FunctionNode(name, self.tokens[first][0], at, at, at), body + 1
                k = end
                continue
            if word in ("{", ";", "}"):
                return None, k + 1
            k += 1
        return None, k

    def closed(self, first: int, name: str | None, body: int) -> tuple[FunctionNode, int]:
        behind = self.behind(body)
        at = self.tokens[body][0]
        return FunctionNode(name, self.tokens[first][0], at, at, self.tokens[behind - 1][1] if self.word(behind - 1) == "}" else len(self.text)), behind

    def arrow(self, first: int, name: str | None, at: int) -> tuple[FunctionNode, int]:
        """A function whose body follows an arrow: a block, or an expression up to a semicolon."""
        if self.word(at + 1) == "{":
            return self.closed(first, name, at + 1)
        k = at + 1
        while k < len(self.tokens) and self.word(k) != ";":
            k = self.behind(k) if self.word(k) in ("(", "[", "{") else k + 1
        begin = self.tokens[at + 1][0] if at + 1 < len(self.tokens) else len(self.text)
        return FunctionNode(name, self.tokens[first][0], self.tokens[at][1], begin, self.tokens[k - 1][1]), k + 1

    def body(self, k: int) -> int:
        """Where the result type behind the parameters ends: at the body, an arrow, a semicolon or the end."""
        while k < len(self.tokens):
            word = self.word(k)
            if word in (";", "=>"):
                return k
            if word == "{":
                if self.word(k - 1) not in (":", "|", "&", ",", "struct", "interface", "->"):
                    return k
                k = self.behind(k)
            elif word in ("(", "["):
                k = self.behind(k)
            elif word == "<":
                k = self.behind(k)
            elif word in (")", "]", "}", "=", ".") or word == "?":
                return k if word != "." else self.body(k + 1)
            else:
                k += 1
        return k


def is_python(text: str | None) -> bool:
    """Whether a text starts like a Python function; an annotation alone tells nothing."""
    return bool(text and _PYTHON.match(text))


def parse_functions(text: str, lang: str | None = None) -> list[FunctionNode]:
    """All function nodes of a text in a language; an unknown one is told by the first line behind annotations."""
    if lang == "python" or (lang is None and is_python(text)):
        return _python_nodes(text) or [_broken_python(text)]
    return _Braces(text).nodes() or [FunctionNode(None, 0, len(text), len(text), len(text))]


def parse_function(text: str, lang: str | None = None, name: str | None = None) -> FunctionNode:
    """The function node that bears ``name``, else the first one; a text that does not parse has an open end."""
    nodes = parse_functions(text, lang)
    return next((n for n in nodes if name is not None and n.name == name), nodes[0])


_NAMES = ["chunk_id", "name", "signature", "description", "doc_source", "body_start", "body_end"]
_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
_SCHEMA = "chunk_id long, name string, signature string, description string, doc_source string, body_start int, body_end int"


def _pairs(least_letters: int, with_content: bool):
    """Parses every row (chunk_id, ident, signature, doc_comment, content, lang) and keeps those whose documentation says something."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4):
            out: list[tuple] = []
            kept: list[int] = []
            columns = (batch.column(k).to_pylist() for k in range(6))
            for row, (key, ident, signature, doc, content, lang) in enumerate(zip(*columns, strict=True)):
                content = content or ""
                node = parse_function(content, lang, ident)
                source = "doc_comment" if doc is not None else "docstring"
                doc = doc if doc is not None else node.doc
                if says_something(doc, ident or node.name, least_letters):
                    signature = signature or content[node.start : node.signature_end].strip()
                    out.append((key, ident or node.name, signature, description(doc), source, node.body_start, node.body_end))
                    kept.append(row)
            columns_out = list(zip(*out, strict=True)) or [[]] * len(_TYPES)
            arrays = [pa.array(c, t) for c, t in zip(columns_out, _TYPES, strict=True)]
            content = [batch.column(4).take(pa.array(kept, pa.int64()))] if with_content else []
            yield pa.RecordBatch.from_arrays(arrays + content, _NAMES + ["content"] * with_content)

    return run


def _parsed(chunks: DataFrame, files: DataFrame | None, least_letters: int, with_content: bool) -> DataFrame:
    rows = chunks.where(F.col("kind").isin("fn", "method") & F.col("chunk_id").isNotNull())
    rows = rows.select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("file_id").cast("long").alias("file_id") if files is not None else F.lit(None).cast("long").alias("file_id"), "ident", "signature", "doc_comment", "content")
    if files is None:
        known = rows.withColumn("lang", F.lit(None).cast("string"))
    else:
        langs = files.where("file_id IS NOT NULL").groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.min("lang").alias("lang"))
        known = rows.join(langs, "file_id", "left")
    # of rows without a comment only Python's can have documentation
    python = (F.col("lang") == "python") | (F.col("lang").isNull() & F.col("content").rlike(r"^\s*(@[^\n]*\n\s*)*(async[ \t]+)?def[ \t]"))
    known = known.where(F.col("doc_comment").isNotNull() | python)
    schema = _SCHEMA + (", content string" if with_content else "")
    return known.select("chunk_id", "ident", "signature", "doc_comment", "content", "lang").mapInArrow(_pairs(least_letters, with_content), schema)


def documented_functions(chunks: DataFrame, files: DataFrame | None = None, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(chunk_id): the functions of ``function_pairs``, without their texts."""
    return _parsed(chunks, files, least_letters, False).select("chunk_id").distinct()


def function_pairs(chunks: DataFrame, files: DataFrame | None = None, least_letters: int = LEAST_LETTERS) -> DataFrame:
    """(chunk_id, name, signature, description, doc_source, body_start, body_end, content) of the functions with real documentation.

    ``files`` (file_id, lang) tells the language of a chunk's file.  Rows of other kinds and repeated rows are dropped; rows of one key
    that differ all come out; a null or empty description, ident or content never fails.  Where ``doc_comment`` is null only Python has
    documentation, its docstring.  Body offsets are characters of the content; a function without a body has an empty range.
    """
    return _parsed(chunks, files, least_letters, True).distinct()
