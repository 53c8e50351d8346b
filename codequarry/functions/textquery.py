"""The full-text query language: terms are all required, ``OR`` separates alternatives, ``"..."`` is a phrase, ``x*`` a prefix.

Everything but letters, digits and ``_ - " *`` separates terms; an odd last quote is dropped; stray stars and leading,
trailing or repeated ORs vanish.  AND, NOT and NEAR are ordinary terms.  A term with ``_`` or ``-`` is the phrase of its parts, because
the index splits there.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_PART = re.compile(r"[^\W_]+")
_UNIT = re.compile(r'"([^"]*)"(\*?)|(\S+)')


@dataclass(frozen=True)
class Unit:
    """A term (one word), a phrase (several), or a prefix of its last word."""

    words: tuple[str, ...]
    prefix: bool = False


def sanitise(query: str) -> str:
    """The query with everything the language does not know removed."""
    kept = "".join(c if c.isalnum() or c in '_-"*' else " " for c in query)
    if kept.count('"') % 2:
        last = kept.rindex('"')
        kept = kept[:last] + kept[last + 1 :]
    parts: list[str] = []
    for match in _UNIT.finditer(kept):
        part = match[0]
        if part.strip("*") == "" or (part == "OR" and (not parts or parts[-1] == "OR")):
            continue
        parts.append(part)
    while parts and parts[-1] == "OR":
        parts.pop()
    return " ".join(parts)


def parse(query: str) -> list[list[Unit]]:
    """Alternatives, each a list of required units; [] if nothing is asked."""
    groups: list[list[Unit]] = [[]]
    for match in _UNIT.finditer(sanitise(query)):
        if match[0] == "OR":
            groups.append([])
            continue
        text = match[1] if match[1] is not None else match[3]
        star = match[0].endswith("*")
        words = tuple(w.lower() for w in _PART.findall(text))
        if words:
            groups[-1].append(Unit(words, star))
    return [g for g in groups if g]
