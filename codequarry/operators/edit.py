"""Guarded edits of single files, on the driver: locate a symbol in the index, splice bytes, check, write atomically."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, Row, functions as F

from codequarry import schema
from codequarry.sources import parsers


class EditError(Exception):
    """An edit that was refused; ``kind`` is one of the engine's error kinds."""

    def __init__(self, kind: str, message: str, candidates: list | None = None):
        super().__init__(message)
        self.kind, self.candidates = kind, candidates or []


def safe_path(root: str, path: str) -> str:
    """The absolute place of a relative path; absolute paths, '..' and links out of the root are refused."""
    pure = PurePosixPath(path)
    if pure.is_absolute() or ".." in pure.parts:
        raise EditError("path_traversal", f"not a path within the project: {path}")
    full = os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([full, os.path.realpath(root)]) != os.path.realpath(root):
        raise EditError("path_traversal", f"leads out of the project: {path}")
    return full


def write_atomic(path: str, data: bytes) -> None:
    """Write beside the file, then rename over it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    handle, fresh = tempfile.mkstemp(dir=os.path.dirname(path) or ".", prefix=".edit-")
    try:
        with os.fdopen(handle, "wb") as file:
            file.write(data)
            file.flush()
            os.fsync(file.fileno())
        os.replace(fresh, path)
    except BaseException:
        if os.path.exists(fresh):
            os.unlink(fresh)
        raise


def find_symbol(files: DataFrame, chunks: DataFrame, path: str, symbol: str, parent: str | None = None) -> Row:
    """The one chunk of that name in a file; none and several are errors, the latter with its candidates."""
    own = files.where(F.col("path") == path).select("file_id")
    found = chunks.where(F.col("ident") == symbol).join(own, "file_id", "left_semi")
    if parent is not None:
        found = found.where(F.col("parent") == parent)
    rows = found.orderBy("start_line").collect()
    if not rows:
        raise EditError("symbol_not_found", f"no symbol {symbol} in {path}")
    if len(rows) > 1:
        raise EditError("ambiguous", f"{len(rows)} symbols {symbol} in {path}", [(r["kind"], r["parent"], r["start_line"]) for r in rows])
    return rows[0]


def guarded(path: str, data: bytes, validate: Callable[[str], bool] | None) -> None:
    """Refuse an edit after which the file's text would not parse, by ``validate`` or the parser of its language."""
    text = data.decode("utf-8", "replace")
    lang = schema.EXTENSIONS.get(path.rpartition(".")[2].lower(), "unknown")
    if not (validate(text) if validate else parsers.valid(text, lang)):
        raise EditError("syntax_guard", f"the edit would break the syntax of {path}")


def _spliced(data: bytes, chunk: Row, new: bytes) -> bytes:
    a, b = chunk["start_byte"], chunk["end_byte"]
    if data[a:b] != chunk["content"].encode():
        raise EditError("conflict", "the file has changed since it was indexed")
    return data[:a] + new + data[b:]


@dataclass
class Preview:
    file: str
    symbol: str
    old_code: str
    new_code: str
    old_lines: tuple[int, int]


def preview_replace(root: str, path: str, chunk: Row, code: str) -> Preview:
    with open(safe_path(root, path), "rb") as file:
        _spliced(file.read(), chunk, code.encode())
    return Preview(path, chunk["ident"], chunk["content"], code, (chunk["start_line"], chunk["end_line"]))


def replace(root: str, path: str, chunk: Row, code: str, validate: Callable[[str], bool] | None = None) -> None:
    full = safe_path(root, path)
    with open(full, "rb") as file:
        data = _spliced(file.read(), chunk, code.encode())
    guarded(path, data, validate)
    write_atomic(full, data)


def sidecar_start(data: bytes, start: int) -> int:
    """Where the comment and attribute lines right above ``start`` begin."""
    at = data.rfind(b"\n", 0, start) + 1
    block = False
    while at > 0:
        above = data.rfind(b"\n", 0, at - 1) + 1
        line = data[above : at - 1].strip()
        if block:
            block = not line.startswith(b"/*")
        elif line.endswith(b"*/"):
            block = not line.startswith(b"/*")
        elif not line.startswith((b"//", b"#", b"@", b"///")):
            break
        at = above
    return at


def delete(root: str, path: str, chunk: Row, keep_docs: bool = False, validate: Callable[[str], bool] | None = None) -> int:
    """Delete a symbol with its comment and attribute lines unless kept, and one newline after it; the number of such lines."""
    full = safe_path(root, path)
    with open(full, "rb") as file:
        data = file.read()
    _spliced(data, chunk, b"")
    start = chunk["start_byte"] if keep_docs else sidecar_start(data, chunk["start_byte"])
    end = chunk["end_byte"] + data[chunk["end_byte"] :].startswith(b"\n")
    out = data[:start] + data[end:]
    guarded(path, out, validate)
    write_atomic(full, out)
    return data.count(b"\n", start, chunk["start_byte"])


def insert(root: str, path: str, code: str, position: str = "bottom", validate: Callable[[str], bool] | None = None) -> None:
    """Insert at top, bottom, before:N or after:N (lines from 1)."""
    full = safe_path(root, path)
    with open(full, "rb") as file:
        data = file.read()
    lines = data.splitlines(keepends=True)
    name, _, number = position.partition(":")
    if name == "top" and not number:
        at = 0
    elif name == "bottom" and not number:
        at = len(lines)
    elif name in ("before", "after") and number.isdigit():
        n = int(number)
        if not 1 <= n <= len(lines):
            raise EditError("invalid_position", f"line {n} is not in 1 to {len(lines)}")
        at = n - 1 if name == "before" else n
    else:
        raise EditError("invalid_position", f"unknown position {position}")
    if at and lines and not lines[at - 1].endswith(b"\n"):
        lines[at - 1] += b"\n"
    text = code.encode()
    out = b"".join(lines[:at]) + text + (b"" if text.endswith(b"\n") else b"\n") + b"".join(lines[at:])
    guarded(path, out, validate)
    write_atomic(full, out)


def extract(root: str, path: str, chunks: list[Row], to: str, validate: Callable[[str], bool] | None = None) -> dict:
    """Move symbols to another file: the destination is written first, then the source without them; both are checked before either."""
    source, target = safe_path(root, path), safe_path(root, to)
    if source == target:
        raise EditError("invalid_position", "source and destination are one file")
    with open(source, "rb") as file:
        data = file.read()
    created = not os.path.exists(target)
    before = b""
    if not created:
        with open(target, "rb") as file:
            before = file.read()
    plan = sorted(chunks, key=lambda c: c["start_byte"])
    moved, kept, at = [], b"", 0
    out = before.rstrip(b"\n") + (b"\n\n" if before.strip() else b"")
    for chunk in plan:
        _spliced(data, chunk, b"")
        start, end = sidecar_start(data, chunk["start_byte"]), chunk["end_byte"]
        first = out.count(b"\n") + 1
        out += data[start:end] + b"\n\n"
        moved.append({"symbol": chunk["ident"], "from_lines": (chunk["start_line"], chunk["end_line"]), "to_lines": (first, out.count(b"\n") - 1)})
        kept += data[at:start]
        at = end + data[end:].startswith(b"\n")
    kept += data[at:]
    out = out.rstrip(b"\n") + b"\n"
    guarded(to, out, validate)
    guarded(path, kept, validate)
    write_atomic(target, out)
    write_atomic(source, kept)
    return {"moved": moved, "dest_created": created, "bytes_moved": len(data) - len(kept)}
