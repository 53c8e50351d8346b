"""Parsers: a file's text -> its chunks and references.

Code is parsed by declarations and bracket matching over the text with comments and strings blanked out, Python by its syntax
tree; configuration files by their own loaders, then one walker over the tree of values; markup by headings or elements.  Offsets are
bytes, lines count from 1, and a chunk's content is exactly its bytes.  All imports of a file are one chunk ``_imports``.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codequarry import schema

_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_STRINGS = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"


@dataclass
class Chunk:
    kind: str
    ident: str
    start: int  # characters; turned into bytes and lines at the end
    end: int
    parent: str | None = None
    signature: str | None = None
    visibility: str | None = None
    doc_comment: str | None = None
    attributes: str | None = None
    content: str | None = None


@dataclass
class Parsed:
    chunks: list[Chunk] = field(default_factory=list)
    refs: list[tuple[str, str, int]] = field(default_factory=list)  # (target, kind, place)
    quality: str = "complete"


@dataclass(frozen=True)
class Braces:
    """How a brace language declares things: (kind, pattern with the group name) and the rest of its habits."""

    declarations: tuple[tuple[str, str], ...]
    imports: str
    holders: tuple[str, ...] = ()
    types: str = r"\b[A-Z]\w*"
    default: str | None = None
    marks: tuple[str, ...] = ()
    strings: str = _STRINGS
    comments: str = _COMMENTS


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|override|virtual|async|readonly|partial|synchronized|native|default)\s+)*"
_BRACE_LANGUAGES = {
    "rust": Braces(
        (
            ("fn", r"(?:pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+(?:\"[^\"]*\"\s+)?)*fn\s+(?P<name>\w+)"), ("struct", r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)"),
            ("enum", r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)"), ("trait", r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)"),
            ("impl", r"(?:unsafe\s+)?impl\b(?:\s*<[^{]*?>)?\s+(?:[^{;]*?\bfor\s+)?(?P<name>\w+)"), ("const", r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>[A-Z_]\w*)\s*:"),
            ("mod", r"(?:pub(?:\([^)]*\))?\s+)?mod\s+(?P<name>\w+)"), ("macro", r"macro_rules!\s*(?P<name>\w+)"), ("type_alias", r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)"),
        ),
        r"(?:pub(?:\([^)]*\))?\s+)?use\s+[^;]+;", ("impl", "trait"), default="private", marks=("pub(crate)", "pub(super)", "pub"),
        strings=r"b?r(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[^\n][^'\n]*)'",
    ),
    "go": Braces((("method", r"func\s+\([^)]*\)\s*(?P<name>\w+)"), ("fn", r"func\s+(?P<name>\w+)"), ("struct", r"type\s+(?P<name>\w+)")), r"import\s+(?:\([^)]*\)|(?:[\w.]+\s+)?\"[^\"\n]*\")", default="case"),
    "java": Braces(
        (("class", _MODS + r"(?:class|record)\s+(?P<name>\w+)"), ("interface", _MODS + r"@?interface\s+(?P<name>\w+)"), ("enum", _MODS + r"enum\s+(?P<name>\w+)"),
         ("method", _MODS + r"(?:<[^>]+>\s+)?(?:[\w.$]+(?:<[^<>{}();]*>)?(?:\[\])*\s+)?(?P<name>(?!(?:if|for|while|switch|catch|synchronized|return|new|throw|else|try)\b)\w+)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?=\{)")),
        r"import\s+(?:static\s+)?[\w.*]+;", ("class", "interface", "enum"), default="package", marks=("public", "private", "protected"),
    ),
    "csharp": Braces(
        (("class", _MODS + r"(?:class|record)\s+(?P<name>\w+)"), ("interface", _MODS + r"interface\s+(?P<name>\w+)"), ("enum", _MODS + r"enum\s+(?P<name>\w+)"), ("struct", _MODS + r"struct\s+(?P<name>\w+)"), ("mod", r"namespace\s+(?P<name>[\w.]+)"),
         ("method", _MODS + r"(?:[\w.]+(?:<[^<>{}();]*>)?(?:\[\])*\??\s+)?(?P<name>(?!(?:if|for|foreach|while|switch|catch|lock|using|return|new|throw|else)\b)\w+)\s*\([^;{}()]*\)\s*(?:=>[^;]*;|(?=\{))")),
        r"using\s+[\w.=\s]+;", ("class", "interface", "struct"), default="private", marks=("public", "private", "protected", "internal"),
    ),
    "php": Braces(
        (("class", r"(?:abstract\s+|final\s+)*class\s+(?P<name>\w+)"), ("interface", r"interface\s+(?P<name>\w+)"), ("trait", r"trait\s+(?P<name>\w+)"), ("fn", r"(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(?P<name>\w+)")),
        r"use\s+[\w\\,\s{}]+;", ("class", "interface", "trait"), default="public", marks=("public", "private", "protected"), comments=_COMMENTS + r"|#(?!\[)[^\n]*",
    ),
    "javascript": Braces(
        (("class", r"(?:export\s+(?:default\s+)?)?class\s+(?P<name>[\w$]+)"), ("fn", r"(?:export\s+(?:default\s+)?)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"), ("fn", r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s+)?(?:\([^()]*\)|[\w$]+)\s*=>"),
         ("method", r"(?:static\s+|async\s+|get\s+|set\s+)*(?P<name>(?!(?:if|for|while|switch|catch|function|return|new|throw|else|with)\b)[#\w$]+)\s*\([^(){};]*\)\s*(?=\{)")),
        r"import\b[^;\n]*?(?:from\s*)?[\"'][^\"'\n]*[\"'];?|(?:const|let|var)\s+[^=;\n]+=\s*require\([^)]*\);?", ("class",), marks=("export default", "export"),
    ),
}
_TS = _BRACE_LANGUAGES["javascript"]
_BRACE_LANGUAGES["typescript"] = Braces(
    (("class", r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:abstract\s+)?class\s+(?P<name>[\w$]+)"), ("interface", r"(?:export\s+)?(?:declare\s+)?interface\s+(?P<name>[\w$]+)"), ("type_alias", r"(?:export\s+)?type\s+(?P<name>[\w$]+)\b[^=\n]*="),
     ("enum", r"(?:export\s+)?(?:const\s+)?enum\s+(?P<name>[\w$]+)"), ("mod", r"(?:export\s+)?(?:declare\s+)?namespace\s+(?P<name>[\w$.]+)"), ("fn", r"(?:export\s+(?:default\s+)?)?(?:declare\s+)?(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"),
     ("method", r"(?:(?:public|private|protected|readonly|static|async|abstract|override|get|set)\s+)*(?P<name>(?!(?:if|for|while|switch|catch|function|return|new|throw|else|with)\b)[#\w$]+)\s*(?:<[^<>()]*>)?\([^(){};]*\)\s*(?::\s*[^{};=]+)?(?=\{)")),
    _TS.imports, ("class", "interface"), marks=("export default", "export", "public", "private", "protected"),
)
_BRACE_LANGUAGES["tsx"] = _BRACE_LANGUAGES["typescript"]
_NOT_CALLED = frozenset("if for while switch catch return match function func fn class new throw else in of typeof sizeof with synchronized super this def lambda and or not elif except print".split()) - {"print"}


def blanked(text: str, strings: str, comments: str) -> str:
    """The text with comments and strings replaced by spaces, newlines kept."""
    return re.sub(f"(?:{strings})|{comments}" if r"\1" in strings else f"{comments}|{strings}", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


_MARKS = re.compile(r"[(){}\[\];\n]")
_GOES_ON = re.compile(r"\s*(?:\{|where\b|throws\b|[:.,=|&+)]|extends\b|implements\b)")
_COMPLETE = re.compile(r"[\w)>\]}\"'`][ \t\r]*$")


def _body_end(blank: str, at: int) -> tuple[int, bool]:
    """End of the declaration whose head ends at ``at``: after its block or semicolon; whether its block is closed."""
    depth = rounds = 0
    for mark in _MARKS.finditer(blank, at):
        c, k = mark[0], mark.start()
        if c == "\n":
            if depth == 0 and rounds <= 0 and not _GOES_ON.match(blank, k) and _COMPLETE.search(blank, max(at, blank.rfind("\n", at, k) + 1), k):
                return k, True
        elif c in "([":
            rounds += 1
        elif c in ")]":
            rounds -= 1
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth <= 0:
                return k + (depth == 0), depth == 0
        elif depth == 0 and rounds <= 0:
            return k + 1, True
    return len(blank), False


def _sidecar(text: str, start: int, lang: str) -> tuple[str | None, str | None]:
    """(doc comment, attributes) on the lines right above a declaration."""
    below = text.rfind("\n", 0, start) + 1
    docs: list[str] = []
    marks: list[str] = []
    block = False
    while below > 0:
        above = text.rfind("\n", 0, below - 1) + 1
        line, below = text[above : below - 1].strip(), above
        if block:
            docs.append(line)
            block = not line.startswith("/*")
        elif line.endswith("*/"):
            docs.append(line)
            block = not line.startswith("/*")
        elif line.startswith("//") or (lang == "php" and line.startswith("#") and not line.startswith("#[")):
            docs.append(line)
        elif (line.startswith("#[") or (line.startswith("[") and line.endswith("]") and lang == "csharp") or line.startswith("@")) and not docs:
            marks.append(line)
        else:
            break
    inline = re.match(r"[^\n]*?((?:@\w+(?:\([^)]*\))?\s+)+)", text[text.rfind("\n", 0, start) + 1 : start + 200])
    if inline and lang == "java" and inline[1].strip() and not marks:
        marks.append(inline[1].strip())
    return "\n".join(reversed(docs)) or None, "\n".join(reversed(marks)) or None


def parse_braces(text: str, lang: str) -> Parsed:
    rules, out = _BRACE_LANGUAGES[lang], Parsed()
    blank = blanked(text, rules.strings, rules.comments)
    heads = re.compile("|".join(rf"(?P<k{i}>(?<![\w$.]){p.replace('(?P<name>', f'(?P<n{i}>')})" for i, (_, p) in enumerate(rules.declarations)))
    taken: set[int] = set()
    opened = False
    for match in heads.finditer(blank):
        i = int(match.lastgroup[1:]) if match.lastgroup and match.lastgroup[0] == "k" else next(k for k in range(len(rules.declarations)) if match[f"k{k}"] is not None)
        kind, start = rules.declarations[i][0], match.start() + len(match[0]) - len(match[0].lstrip())
        if start in taken:
            continue
        taken.add(start)
        end, closed = _body_end(blank, match.end())
        opened |= not closed
        head = text[start:end]
        brace = blank.find("{", match.end() - 1, end)
        signature = text[start:brace].strip() if brace >= 0 else head.split(";")[0].split("\n")[0].strip()
        shown = next((m for m in rules.marks if head.startswith(m)), None)
        if rules.default == "case":
            shown = "pub" if match[f"n{i}"][:1].isupper() else "private"
        doc, marks = _sidecar(text, start, lang)
        out.chunks.append(Chunk(kind, match[f"n{i}"], start, end, None, signature.split("\nwhere")[0].strip(), shown or rules.default, doc, marks))
    holders = [c for c in out.chunks if c.kind in rules.holders]
    for chunk in out.chunks:
        around = [h for h in holders if h is not chunk and h.start <= chunk.start and chunk.end <= h.end]
        if around and chunk.kind in ("fn", "method"):
            chunk.kind, chunk.parent = "method", around[-1].ident
    if lang in ("java", "csharp", "javascript", "typescript", "tsx"):
        out.chunks = [c for c in out.chunks if c.kind != "method" or c.parent]
    if lang == "rust":
        for chunk in [c for c in out.chunks if c.kind == "enum"]:
            body = blank.find("{", chunk.start, chunk.end)
            flat = re.sub(r"\([^()]*\)|\{[^{}]*\}", lambda m: " " * len(m[0]), blank[body + 1 : chunk.end - 1])
            for variant in re.finditer(r"(?<![\w\]#])([A-Z]\w*)\s*(?:=[^,]*)?(?:,|\s*$)", flat):
                at = body + 1 + variant.start(1)
                out.chunks.append(Chunk("enum_variant", variant[1], at, at + len(variant[1]), chunk.ident))
    imports = list(re.finditer(rules.imports, text))
    imports = [m for m in imports if blank[m.start() : m.start() + 3].strip()]
    if imports:
        whole = Chunk("imports", "_imports", imports[0].start(), imports[-1].end())
        whole.content = "\n".join(m[0] for m in imports)
        out.chunks.append(whole)
        for m in imports:
            if lang == "go":
                out.refs += [(s[0], "import", m.start() + s.start()) for s in re.finditer(r"\"[^\"]*\"", m[0])]
            elif lang in ("javascript", "typescript", "tsx"):
                out.refs += [(s[1], "import", m.start() + s.start()) for s in list(re.finditer(r"[\"']([^\"']*)[\"']", m[0]))[-1:]]
            else:
                name = re.sub(r"^(?:pub\S*\s+)?(?:use|import|using)\s+(?:static\s+)?|;$", "", m[0]).strip()
                out.refs.append((name, "import", m.start()))
    starts, ends = [m.start() for m in imports], [m.end() for m in imports]

    def imported(at: int) -> bool:
        k = bisect_right(starts, at) - 1
        return k >= 0 and at < ends[k]

    heads_at = {c.start + (c.signature or "").find(c.ident) for c in out.chunks}
    for m in re.finditer(r"([A-Za-z_$][\w$]*)!?\s*(?:::<[^<>()]*>)?\(", blank):
        if m[1] not in _NOT_CALLED and m.start() not in heads_at and not imported(m.start()) and not re.search(r"\b(?:fn|func|function)\s+(?:\([^)]*\)\s*)?$", blank[max(0, m.start() - 80) : m.start()]):
            out.refs.append((m[1], "call", m.start()))
    for m in re.finditer(rules.types, blank):
        if not imported(m.start()) and not re.match(r"\s*\(", blank[m.end() : m.end() + 2]):
            out.refs.append((m[0], "type_use", m.start()))
    if opened or sum(blank.count(c) for c in "([{") != sum(blank.count(c) for c in ")]}"):
        out.quality = "partial"
    return out


def parse_python(text: str) -> Parsed:
    out = Parsed()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        out.quality = "partial"
        for m in re.finditer(r"^([ \t]*)(?:async\s+)?(def|class)\s+(\w+)[^\n]*\n(?:(?:\1[ \t]+[^\n]*|[ \t]*)(?:\n|\Z))*", text, re.M):
            out.chunks.append(Chunk("class" if m[2] == "class" else "method" if m[1] else "fn", m[3], m.start() + len(m[1]), m.start() + len(m[0].rstrip()), None, m[0].strip().split(":")[0], "private" if m[3].startswith("_") else "public"))
        return out
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)

    def place(line: int, column: int) -> int:
        return starts[line - 1] + len(lines[line - 1].encode()[:column].decode(errors="ignore"))

    imports: list[tuple[int, int]] = []

    def visit(node: ast.AST, parent: str | None, inside_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                start, end = place(child.lineno, child.col_offset), place(child.end_lineno, child.end_col_offset)
                shown = "dunder" if re.fullmatch(r"__\w+__", child.name) else "private" if child.name.startswith("_") else "public"
                doc = ast.get_docstring(child, clean=False)
                if doc is None:
                    above = []
                    k = child.lineno - 2 - len(child.decorator_list)
                    while k >= 0 and lines[k].strip().startswith("#"):
                        above.append(lines[k].strip())
                        k -= 1
                    doc = "\n".join(reversed(above)) or None
                marks = "\n".join("@" + ast.unparse(d) for d in child.decorator_list) or None
                kind = "class" if is_class else "method" if inside_class else "fn"
                out.chunks.append(Chunk(kind, child.name, start, end, parent if inside_class else None, text[start:end].split(":")[0].strip(), shown, doc, marks))
                visit(child, child.name if is_class else parent, is_class)
                continue
            if isinstance(child, ast.Import | ast.ImportFrom):
                start = place(child.lineno, child.col_offset)
                imports.append((start, place(child.end_lineno, child.end_col_offset)))
                names = [a.name for a in child.names] if isinstance(child, ast.Import) else [child.module or "."]
                out.refs += [(n, "import", start) for n in names]
            elif isinstance(child, ast.Call):
                target = child.func
                name = target.id if isinstance(target, ast.Name) else target.attr if isinstance(target, ast.Attribute) else None
                if name:
                    out.refs.append((name, "call", place(child.lineno, child.col_offset)))
            if isinstance(child, ast.arg | ast.AnnAssign) and child.annotation is not None:
                out.refs += [(n.id, "type_use", place(n.lineno, n.col_offset)) for n in ast.walk(child.annotation) if isinstance(n, ast.Name)]
            visit(child, parent, inside_class and not isinstance(child, ast.stmt))

    visit(tree, None, False)
    if imports:
        whole = Chunk("imports", "_imports", imports[0][0], imports[-1][1])
        whole.content = "\n".join(text[a:b] for a, b in imports)
        out.chunks.append(whole)
    return out


def parse_markdown(text: str) -> Parsed:
    out = Parsed()
    heads = [(m.start(), len(m[1]), m[2].strip()) for m in re.finditer(r"^[ \t]*(#+)([^\n]*)$", text, re.M) if m[2].strip()]
    if not heads:
        return parse_plain(text)
    for k, (start, level, ident) in enumerate(heads):
        end = heads[k + 1][0] - 1 if k + 1 < len(heads) else len(text.rstrip("\n")) if text.endswith("\n") else len(text)
        parent = next((i for _, lv, i in reversed(heads[:k]) if lv < level), None)
        out.chunks.append(Chunk("section", ident, start, max(start, end), parent, "#" * level + " " + ident))
    return out


def parse_plain(text: str) -> Parsed:
    return Parsed([Chunk("section", "(document)", 0, len(text))] if text.strip() else [])


def parse_pages(text: str) -> Parsed:
    out, at = Parsed(), 0
    for number, page in enumerate(text.split("\f"), 1):
        if page.strip():
            out.chunks.append(Chunk("page", f"Page {number}", at, at + len(page)))
        at += len(page) + 1
    return out


#: Deepest level of configuration trees, and the keys that are shown below the second.
_DEPTH = 3
_IMPORTANT = frozenset("name version dependencies scripts main type description image ports environment services jobs steps run on script stage kind metadata spec".split())


def _value_type(value: object) -> str:
    return {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}.get(type(value), "string")


def value_preview(value: object, most: int = 40) -> str:
    """A value in a few signs: containers by their size, texts up to ``most`` characters."""
    if isinstance(value, dict):
        return f"{{{len(value)} keys}}"
    if isinstance(value, list):
        return f"[{len(value)} items]"
    text = json.dumps(value, ensure_ascii=False, default=str)
    return text if len(text) <= most else text[: most - 1] + "…"


def parse_tree(text: str, value: object, form: str) -> Parsed:
    """Entries of a tree of values as chunks; every path once, containers and upper or important keys only."""
    out = Parsed()
    if not isinstance(value, dict):
        return Parsed([Chunk("const", "_root", 0, len(text))] if text.strip() else [])

    def find(key: str, after: int) -> tuple[int, int]:
        shape = rf'"{re.escape(key)}"\s*:' if form == "json" else rf"^[ \t\-]*[\"']?{re.escape(key)}[\"']?\s*[:=]|^\[+[^\]\n]*\b{re.escape(key)}\]"
        match = re.compile(shape, re.M).search(text, after)
        if not match:
            return after, after
        if form == "json":
            end, _ = _body_end(blanked(text, _STRINGS, r"(?!)").replace("[", "{").replace("]", "}"), match.end()) if re.match(r"\s*[\[{]", text[match.end() :]) else (text.find("\n", match.end()), True)
            return match.start(), len(text) if end < 0 else end
        start = text.rfind("\n", 0, match.start() + 1) + 1 if text[match.start()] == "\n" else match.start()
        indent = len(text[start:]) - len(text[start:].lstrip(" "))
        stop = re.compile(rf"^(?! {{{indent + 1},}})(?=\S| {{0,{indent}}}\S)", re.M).search(text, match.end()) if form == "yaml" else re.compile(r"^\[|^[\w\"'-]+\s*=" if text[start] != "[" else r"^\[", re.M).search(text, match.end())
        return start, stop.start() if stop else len(text)

    def walk(node: dict, path: str, depth: int, after: int) -> None:
        for key, child in node.items():
            key = str(key)
            here = f"{path}.{key}" if path else key
            start, end = find(key, after)
            if isinstance(child, dict | list) or depth < 2 or key in _IMPORTANT:
                out.chunks.append(Chunk(_value_type(child), here, start, max(start, end), path or None, f'"{key}": {value_preview(child)}' if form == "json" else f"{key} {'=' if form == 'toml' else ':'} {value_preview(child)}"))
            if depth < _DEPTH:
                if isinstance(child, dict):
                    walk(child, here, depth + 1, start)
                elif isinstance(child, list):
                    for i, item in enumerate(child):
                        if isinstance(item, dict):
                            walk(item, f"{here}[{i}]", depth + 1, start)

    walk(value, "", 1, 0)
    return out


def _loaded(text: str, form: str) -> Parsed:
    try:
        if form == "json":
            value = json.loads(text)
        elif form == "toml":
            value = tomllib.loads(text)
        else:
            try:
                import yaml
            except ImportError:
                return parse_plain(text)
            value = yaml.safe_load(text)
    except Exception:  # noqa: BLE001 - a file that its loader rejects is one chunk, whatever the loader raises
        whole = Parsed([Chunk("const", "_root", 0, len(text))] if text.strip() else [])
        whole.quality = "partial"
        return whole
    return parse_tree(text, value, form)


class _Elements(HTMLParser):
    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self._starts = [0]
        for line in text.split("\n"):
            self._starts.append(self._starts[-1] + len(line) + 1)
        self.out, self._open = Parsed(), []

    def _at(self) -> int:
        line, column = self.getpos()
        return self._starts[line - 1] + column

    def handle_decl(self, decl: str) -> None:
        if decl.lower().startswith("doctype"):
            self.out.chunks.append(Chunk("section", "_doctype", self._at(), self._at() + len(decl) + 3))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        at = self._at()
        self.out.refs += [(c, "type_use", at) for c in values.get("class", "").split()]
        self.out.refs += [(values[k], "import", at) for k in ("href", "src") if values.get(k)]
        if "id" in values or tag in ("script", "style"):
            chunk = Chunk("section", values.get("id") or f"_{tag}", at, at + len(self.get_starttag_text() or ""), None, f'<{tag} id="{values["id"]}">' if "id" in values else None)
            self.out.chunks.append(chunk)
            self._open.append((tag, chunk))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self._open) - 1, -1, -1):
            if self._open[k][0] == tag:
                self._open.pop(k)[1].end = self._at() + len(tag) + 3
                break


def parse_html(text: str) -> Parsed:
    parser = _Elements(text)
    parser.feed(text)
    parser.close()
    return parser.out


def parse_css(text: str) -> Parsed:
    out = Parsed()
    blank = blanked(text, _STRINGS, r"/\*.*?(?:\*/|\Z)")
    imports = list(re.finditer(r"@import\s+[^;]+;", text))
    if imports:
        whole = Chunk("imports", "_imports", imports[0].start(), imports[-1].end())
        whole.content = "\n".join(m[0] for m in imports)
    for m in re.finditer(r"([^{};@]+|@(?:media|keyframes|supports)[^{;]*)\{", blank):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        end, _ = _body_end(blank, m.end() - 1)
        head = text[start : m.end() - 1].strip()
        kind = "media" if head.startswith("@media") else "keyframes" if head.startswith("@keyframes") else "rule"
        out.chunks.append(Chunk(kind, head if kind == "media" else head.split()[-1] if kind == "keyframes" else head.split(",")[0].strip(), start, end, None, head))
        if kind == "rule":
            out.refs += [(s[1], "type_use", start) for s in re.finditer(r"[.#]([A-Za-z_][\w-]*)", head)]
    if imports:
        out.chunks.append(whole)
    return out


#: Parsers that users of the library have added, by language; they are sent to the executors with the work.
_ADDED: dict[str, Callable[[str], Parsed]] = {}


def register(lang: str, parser: Callable[[str], Parsed], extensions: Iterable[str] = ()) -> None:
    """Have the texts of a language parsed by ``parser``, and files of these extensions taken as texts of it."""
    _ADDED[lang] = parser
    for ext in extensions:
        schema.EXTENSIONS[ext] = lang
        schema.LANGUAGES.setdefault(lang, []).append(ext)
        schema.SUPPORTED.append(ext)
    schema.PARSERS[lang] = "added"


def parse(text: str, lang: str, added: dict[str, Callable[[str], Parsed]] | None = None) -> Parsed:
    """Chunks and references of a text by its language; languages without a parser are plain text."""
    own = (_ADDED if added is None else added).get(lang)
    if own is not None:
        return own(text)
    if lang in _BRACE_LANGUAGES:
        return parse_braces(text, lang)
    if lang == "python":
        return parse_python(text)
    if lang == "markdown":
        return parse_markdown(text)
    if lang == "pdf":
        return parse_pages(text)
    if lang in ("json", "toml", "yaml"):
        return _loaded(text, lang)
    if lang == "html":
        return parse_html(text)
    if lang == "css":
        return parse_css(text)
    return parse_plain(text)


def valid(text: str, lang: str) -> bool:
    """Whether a text has no syntax error that its parser can see; languages that are no code are always valid."""
    return lang not in schema.CODE_LANGUAGES or parse(text, lang).quality == "complete"


def rows_of(text: str, lang: str, added: dict[str, Callable[[str], Parsed]] | None = None) -> tuple[list[dict], list[dict], str]:
    """(chunk rows, reference rows, quality) with byte offsets, lines and, for references, the position of their innermost chunk."""
    parsed = parse(text, lang, added)
    breaks = [m.start() for m in re.finditer("\n", text)]
    ascii_ = text.isascii()

    def offset(at: int) -> int:
        return at if ascii_ else len(text[:at].encode("utf-8", "replace"))

    chunks = []
    for c in parsed.chunks:
        row = asdict(c)
        start, end = row.pop("start"), row.pop("end")
        row["content"] = c.content if c.content is not None else text[start:end]
        row |= {"start_byte": offset(start), "end_byte": offset(end), "start_line": bisect_right(breaks, start - 1) + 1, "end_line": bisect_right(breaks, max(start, end - 1) - 1) + 1}
        chunks.append(row)
    refs = []
    inner: dict[int, tuple | None] = {}
    for target, kind, at in parsed.refs:
        line = bisect_right(breaks, at - 1) + 1
        if line not in inner:
            inner[line] = max(((c["start_line"], k) for k, c in enumerate(chunks) if c["start_line"] <= line <= c["end_line"]), default=None)
        if inner[line]:
            refs.append({"target_ident": target, "ref_kind": kind, "line": line, "col": at - (breaks[line - 2] + 1 if line > 1 else 0) + 1, "chunk": inner[line][1]})
    return chunks, refs, parsed.quality


_COLUMNS = ["start_line", "end_line", "start_byte", "end_byte", "kind", "ident", "parent", "signature", "visibility", "doc_comment", "attributes", "content"]


def parse_sources(sources: DataFrame) -> DataFrame:
    """One row per file (file_id, lang, content): its quality, chunks and references as arrays; a failing file is one row 'failed'."""
    chunk = "struct<seq:int,start_line:int,end_line:int,start_byte:int,end_byte:int,kind:string,ident:string,parent:string,signature:string,visibility:string,doc_comment:string,attributes:string,content:string>"
    ref = "struct<chunk:int,target_ident:string,ref_kind:string,line:int,col:int>"

    added = dict(_ADDED)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for key, lang, text in part.itertuples(index=False):
                try:
                    chunks, refs, quality = rows_of(text or "", lang, added)
                except Exception:  # noqa: BLE001 - one file must not stop the others
                    chunks, refs, quality = [], [], "failed"
                rows.append((key, quality, [{"seq": i} | {c: r[c] for c in _COLUMNS} for i, r in enumerate(chunks)], refs))
            yield pd.DataFrame(rows, columns=["file_id", "parse_quality", "chunks", "refs"])

    return sources.select("file_id", "lang", "content").mapInPandas(run, f"file_id long, parse_quality string, chunks array<{chunk}>, refs array<{ref}>")


def chunk_rows(parsed: DataFrame) -> DataFrame:
    """Rows of ``parse_sources`` as the chunks table; a chunk's id is a hash of its file and place in it."""
    each = parsed.select("file_id", F.explode("chunks").alias("c"))
    return each.select(F.xxhash64("file_id", "c.seq").alias("chunk_id"), "file_id", *[F.col(f"c.{c}").alias(c) for c in _COLUMNS[:8]], F.col("c.visibility").alias("visibility"), F.lit(None).cast("string").alias("ui_ctx"), *[F.col(f"c.{c}").alias(c) for c in _COLUMNS[9:]])


def ref_rows(parsed: DataFrame) -> DataFrame:
    """Rows of ``parse_sources`` as the refs table."""
    each = parsed.select("file_id", F.posexplode("refs").alias("i", "r"))
    return each.select(F.xxhash64("file_id", F.lit("ref"), "i").alias("ref_id"), F.xxhash64("file_id", "r.chunk").alias("chunk_id"), "r.target_ident", "r.ref_kind", "r.line", "r.col")


def supported_extensions(spark) -> DataFrame:
    """(ext, lang, parser), the static table of what can be indexed."""
    return spark.createDataFrame([(e, schema.EXTENSIONS[e], schema.PARSERS[schema.EXTENSIONS[e]]) for e in sorted(schema.SUPPORTED)], "ext string, lang string, parser string")
