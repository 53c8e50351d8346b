"""Splitting oversized items at natural boundaries by packing a structure tree.

A text is parsed into a tree whose leaves are its lines: Markdown by headings, then blank lines and lists (a fenced block is
one node); code by blank lines and indentation, a closing line belonging to the block it closes.  Sibling subtrees are merged
from the left as long as they fit a piece; a subtree that does not fit a piece of its own is opened and its children are merged;
a line that does not fit is cut at its last white space, else between characters.

Every piece after the first repeats the end of the one before: its last two lines, or its last 128 bytes (whole characters)
where it has no line end or where two lines would take more than half a piece.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LIMIT = 4096
OVERLAP_LINES = 2
OVERLAP_BYTES = 128
#: Levels of indentation that become levels of the tree.
DEEPEST = 100

_LINE = re.compile(rb"[^\n]*\n|[^\n]+\Z")
_HEADING = re.compile(rb" {0,3}(#{1,6})(?:[ \t]|\r?\n|\Z)")
_FENCE = re.compile(rb" {0,3}(```+|~~~+)")
_ITEM = re.compile(rb"[ \t]*(?:[-*+]|\d+[.)])[ \t]")


@dataclass
class Node:
    """Lines ``first`` to ``last`` (exclusive); no children: one line, or a run that may be cut between any lines."""

    first: int
    last: int
    children: list[Node] = field(default_factory=list)


def _indent(line: bytes) -> int:
    blanks = line[: len(line) - len(line.lstrip(b" \t"))]
    return len(blanks) + 3 * blanks.count(b"\t")


def _blocks(lines: list[bytes], first: int, last: int) -> list[Node]:
    """Runs of lines that end with their blank lines."""
    out, start, blank = [], first, False
    for i in range(first, last):
        if not lines[i].strip():
            blank = True
        elif blank:
            out.append(Node(start, i))
            start, blank = i, False
    out.append(Node(start, last))
    return out


def _by_indent(indents: list[int], closes: list[bool], offsets: list[int], least: int, first: int, last: int, depth: int = 0) -> list[Node]:
    """Each line with the deeper-indented lines below it; a closing bracket belongs to its opener.  Beyond DEEPEST levels lines are a run.

    ``indents`` are those of all lines, -1 for blank ones; ``closes`` tells which lines start with a closing bracket.  Nodes of up to
    ``least`` bytes are never opened, so they get no children.
    """
    if last - first == 1 or depth > DEEPEST:
        return [Node(first, last)]
    shallow = min((indents[i] for i in range(first, last) if indents[i] >= 0 and not closes[i]), default=0)
    starts = [first, *(i for i in range(first + 1, last) if 0 <= indents[i] <= shallow and not closes[i])]
    out = [Node(a, b) for a, b in zip(starts, [*starts[1:], last], strict=True)]
    if len(out) == 1 and not any(indents[i] > shallow and not closes[i] for i in range(first, last)):
        return [Node(i, i + 1) for i in range(first, last)]
    for node in out:
        if node.last - node.first > 1 and offsets[node.last] - offsets[node.first] > least:
            node.children = [Node(node.first, node.first + 1), *_by_indent(indents, closes, offsets, least, node.first + 1, node.last, depth + 1)]
    return out


def _code_tree(lines: list[bytes], offsets: list[int], least: int) -> list[Node]:
    """The nodes by indentation, grouped by the blocks between blank lines in one merged pass."""
    indents = [_indent(x) if x.strip() else -1 for x in lines]
    nodes, grouped, at = _by_indent(indents, [x.lstrip()[:1] in (b"}", b"]", b")") for x in lines], offsets, least, 0, len(lines)), [], 0
    for block in _blocks(lines, 0, len(lines)):
        goes_on = at > 0 and nodes[at - 1].last > block.first  # a blank line within one node: its group goes on
        stop = at
        while stop < len(nodes) and nodes[stop].first < block.last:
            stop += 1
        if goes_on:
            grouped[-1].children += nodes[at:stop]
            grouped[-1].last = max(grouped[-1].last, nodes[stop - 1].last)
        elif stop > at:
            grouped.append(Node(nodes[at].first, nodes[stop - 1].last, nodes[at:stop]))
        at = stop
    return grouped


def _markdown_tree(lines: list[bytes]) -> list[Node]:
    levels, fence = [0] * len(lines), None
    inside = [False] * len(lines)
    for i, line in enumerate(lines):
        mark = _FENCE.match(line)
        if fence:
            inside[i] = True
            if mark and mark[1].startswith(fence):
                fence = None
        elif mark:
            fence = mark[1][:3]
        elif heading := _HEADING.match(line):
            levels[i] = len(heading[1])

    def paragraphs(first: int, last: int) -> list[Node]:
        out, start, blank = [], first, False
        for i in range(first, last):
            cut = blank and not inside[i] and lines[i].strip()
            if cut or (i > start and not inside[i] and _ITEM.match(lines[i]) and _indent(lines[i]) == 0 and not _ITEM.match(lines[start])):
                out.append(Node(start, i))
                start = i
            blank = not lines[i].strip()
        out.append(Node(start, last))
        for node in out:
            node.children = [Node(i, i + 1) for i in range(node.first, node.last)] if node.last - node.first > 1 else []
        return out

    def sections(first: int, last: int, above: int) -> list[Node]:
        own = sorted({levels[i] for i in range(first, last) if levels[i] > above})
        if not own:
            return paragraphs(first, last) if first < last else []
        starts = [i for i in range(first, last) if levels[i] == own[0]]
        out = sections(first, starts[0], own[0]) if starts[0] > first else []
        for a, b in zip(starts, [*starts[1:], last], strict=True):
            out.append(Node(a, b, [Node(a, a + 1), *sections(a + 1, b, own[0])] if b - a > 1 else []))
        return out

    return sections(0, len(lines), 0)


def _tail(piece: bytes, limit: int) -> int:
    """How many bytes of the end of ``piece`` the next one repeats."""
    ends = piece.rstrip(b"\n").count(b"\n")
    if b"\n" in piece:
        at = len(piece) - piece.endswith(b"\n")
        for _ in range(OVERLAP_LINES):
            at = piece.rfind(b"\n", 0, at)
            if at < 0:
                break
        size = len(piece) - at - 1
        if size <= limit // 2 and (ends or size < len(piece)):
            return size
        if size == len(piece) <= limit // 2:
            return size
    at = max(0, len(piece) - min(OVERLAP_BYTES, limit // 4))
    while at < len(piece) and piece[at] & 0xC0 == 0x80:
        at += 1
    return len(piece) - at


def _cut_line(line: bytes, room: int) -> int:
    """Where to cut a line that exceeds ``room`` bytes."""
    space = max(line.rfind(b" ", room // 2, room), line.rfind(b"\t", room // 2, room))
    if space >= 0:
        return space + 1
    at = room
    while at > 0 and line[at] & 0xC0 == 0x80:
        at -= 1
    if at > 1 and line[at - 1 : at + 1] == b"\r\n":
        at -= 1
    return at or room


def split_bytes(data: bytes, markup: bool = False, limit: int = LIMIT) -> list[tuple[int, int]]:
    """(start, end) offsets of the pieces; the first starts at 0, the last ends at the end, each starts within or at the end of the one before."""
    if len(data) <= limit:
        return [(0, len(data))]
    lines = _LINE.findall(data)
    offsets = [0]
    for line in lines:
        offsets.append(offsets[-1] + len(line))
    tree = _markdown_tree(lines) if markup else _code_tree(lines, offsets, limit // 2)
    pieces: list[tuple[int, int]] = []
    start = done = 0  # of the open piece: its start with the overlap, and up to where it is filled

    def close() -> None:
        nonlocal start
        pieces.append((start, done))
        start = done - _tail(data[start:done], limit)

    def put(node: Node) -> None:
        nonlocal done
        end = offsets[node.last]
        if end - start <= limit:
            done = end
            return
        filled = done > (pieces[-1][1] if pieces else 0)
        alone = end - offsets[node.first] + (len(data[start:done]) - (done - start) if not filled else _tail(data[start:done], limit))
        if filled and alone <= limit:
            close()
            done = end
        elif node.children:
            for child in node.children:
                put(child)
        elif node.last - node.first > 1:
            for i in range(node.first, node.last):
                put(Node(i, i + 1))
        else:
            if filled:
                close()
            while end - start > limit:
                done += _cut_line(data[done:end], limit - (done - start))
                close()
            done = end

    for node in tree:
        put(node)
    pieces.append((start, done))
    return pieces


def split_batches(key: str, limit: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            keys, contents, firsts, kinds = (batch.column(i).to_pylist() for i in range(4))
            for name, content, first, kind in zip(keys, contents, firsts, kinds, strict=True):
                data = content.encode("utf-8", "surrogatepass")
                before = 0
                for number, (a, b) in enumerate(split_bytes(data, kind in ("section", "page"), limit), 1):
                    line = None if first is None else first + data.count(b"\n", 0, a)
                    last = None if first is None else first + data.count(b"\n", 0, max(a, b - 1))
                    for column, value in zip(out, (name, number, line, last, a, before - a if number > 1 else 0, data[a:b].decode("utf-8", "surrogatepass")), strict=True):
                        column.append(value)
                    before = b
            kinds_out = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds_out, strict=True)], [key, "piece", "start_line", "end_line", "start_offset", "overlap_bytes", "content"])

    return run


def split_oversized(chunks: DataFrame, key: str = "chunk_id", limit: int = LIMIT) -> DataFrame:
    """(key, piece, start_line, end_line, start_offset, overlap_bytes, content): the pieces of rows over ``limit`` bytes.

    Pieces count from 1; offsets are bytes within the row's content.  Null contents and rows within the limit have no pieces;
    rows equal in key, first line, kind and content count once, rows that differ in one of them come out each; lines are null where
    ``start_line`` is.  Only oversized rows leave the JVM.
    """
    large = chunks.where(F.octet_length("content") > limit).select(key, "content", "start_line", "kind").distinct()
    kind = chunks.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start_line int, end_line int, start_offset int, overlap_bytes int, content string"
    return large.mapInArrow(split_batches(key, limit), schema)
