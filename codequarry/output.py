"""Answers as text: minified or pretty JSON, and a tabular form for flat lists that names each field once."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame

#: Longest answer of the remote interface, in bytes.
MAX_RESPONSE = 50_000


def without_nulls(value):
    """The value without null fields."""
    if isinstance(value, dict):
        return {k: without_nulls(v) for k, v in value.items() if v is not None}
    if isinstance(value, list | tuple):
        return [without_nulls(v) for v in value]
    return value


def to_json(value, pretty: bool = False) -> str:
    return json.dumps(without_nulls(value), default=str, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"))


def _cell(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return str(value).lower()
    text = value if isinstance(value, str) else json.dumps(value, default=str, ensure_ascii=False, separators=(",", ":"))
    return json.dumps(text, ensure_ascii=False) if isinstance(value, str) and (text == "" or any(c in text for c in ',"\n\r')) or text != text.strip() else text


def to_table(name: str, rows: Sequence[dict]) -> str:
    """``name[n]{fields}:`` and one indented line per row."""
    fields = list(dict.fromkeys(k for r in rows for k in r))
    return "\n".join([f"{name}[{len(rows)}]{{{','.join(fields)}}}:", *("  " + ",".join(_cell(r.get(f)) for f in fields) for r in rows)])


def answer(df: DataFrame, form: str = "json", name: str = "results") -> str:
    """The rows of a result as text; rows beyond the longest answer, which could not be sent, are not fetched (a row takes 2 bytes at least)."""
    rows = [r.asDict(recursive=True) for r in df.limit(MAX_RESPONSE // 2).collect()]
    if form == "table":
        return to_table(name, rows)
    return to_json({name: rows}, form == "pretty")


def truncated(text: str) -> str:
    """A notice in place of an answer that is too long to send."""
    return text if len(text.encode()) <= MAX_RESPONSE else to_json({"truncated": True, "bytes": len(text.encode()), "limit": MAX_RESPONSE})


def output_tokens(render) -> tuple[str, int]:
    """The text of ``render(n)`` and the tokens n it states about itself: repeated until the number is that of the text."""
    n = 0
    for _ in range(5):
        text = render(n)
        size = -(-len(text.encode()) // 2)
        if size == n:
            break
        n = size
    return render(n), n
