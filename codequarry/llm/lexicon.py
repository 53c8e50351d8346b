"""A minimal acyclic transducer from words to token ids.

The words are compiled into the smallest deterministic acyclic automaton (equal suffixes are one state).  Each
transition carries the number of words that sort before it within its state, so the sum along a path is the word's rank,
and the rank addresses the word's ids.  The arrays lie in one file that is memory-mapped: the workers of one
machine share the pages.
"""

from __future__ import annotations

import json

import numpy as np


def compile_words(pairs: list[tuple[bytes, list[int]]]) -> dict[str, np.ndarray]:
    """Arrays of the automaton for (word, ids); words are unique and not empty."""
    pairs = sorted(pairs)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple]] = []

    def close(node: list) -> int:
        """The number of the registered state equal to ``node`` (final, {label: state})."""
        key = (node[0], tuple(node[1].items()))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    path: list[list] = [[False, {}]]
    previous = b""

    def fold(to: int) -> None:
        while len(path) > to + 1:
            node = path.pop()
            path[-1][1][previous[len(path) - 1]] = close(node)

    for word, _ in pairs:
        common = 0
        while common < min(len(word), len(previous)) and word[common] == previous[common]:
            common += 1
        fold(common)
        path.extend([False, {}] for _ in word[common:])
        path[-1][0] = True
        previous = word
    fold(0)
    root = close(path[0])
    words = [0] * len(states)
    for number, (final, arcs) in enumerate(states):  # targets are closed before their sources
        words[number] = final + sum(words[to] for _, to in arcs)
    keys, targets, before = [], [], []
    for number, (final, arcs) in enumerate(states):
        seen = int(final)
        for label, to in arcs:
            keys.append(number * 256 + label)
            targets.append(to)
            before.append(seen)
            seen += words[to]
    lengths = [len(ids) for _, ids in pairs]
    return {
        "keys": np.array(keys, np.int64), "targets": np.array(targets, np.int32), "before": np.array(before, np.int32),
        "final": np.array([f for f, _ in states], np.bool_), "starts": np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32),
        "ids": np.array([i for _, ids in pairs for i in ids] or [], np.int32), "root": np.array([root], np.int32),
    }


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file image: a line of JSON that places each array, then the arrays, each at a multiple of 64 bytes."""
    places, body = {}, bytearray()
    for name, array in arrays.items():
        body += bytes(-len(body) % 64)
        places[name] = [array.dtype.str, len(body), len(array)]
        body += array.tobytes()
    head = json.dumps(places).encode() + b"\n"
    return len(head).to_bytes(8, "little") + head + bytes(-(8 + len(head)) % 64) + bytes(body)


class Lexicon:
    """Look many words up at once: all words advance one byte per step."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.arrays, self.root = arrays, int(arrays["root"][0])

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """Memory-map a file that holds ``to_bytes``."""
        whole = np.memmap(path, np.uint8, "r")
        size = int.from_bytes(whole[:8].tobytes(), "little")
        places = json.loads(whole[8 : 8 + size].tobytes())
        base = 8 + size + -(8 + size) % 64
        return cls({name: whole[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, at, n) in places.items()})

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where it is not in the lexicon."""
        keys, targets, before, final = (self.arrays[k] for k in ("keys", "targets", "before", "final"))
        if not words or not len(keys):
            return np.full(len(words), -1, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        rank, out = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        width = min(int(lengths.max()), 64)
        active = np.flatnonzero((lengths > 0) & (lengths <= width))
        flat = np.frombuffer(b"".join(words), np.uint8)
        places = (np.cumsum(lengths) - lengths)[:, None] + np.arange(width)
        table = flat[np.minimum(places, max(len(flat) - 1, 0))] if len(flat) else np.zeros((len(words), width), np.uint8)
        state = np.full(len(words), self.root, np.int64)
        for step in range(width):
            wanted = state[active] * 256 + table[active, step]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            hit = keys[at] == wanted
            active, at = active[hit], at[hit]
            rank[active] += before[at]
            state[active] = targets[at]
            ended = lengths[active] == step + 1
            done = active[ended]
            done = done[final[state[done]]]
            out[done] = rank[done]
            active = active[~ended]
            if not len(active):
                break
        return out

    def ids(self, ranks: np.ndarray) -> list[tuple[int, ...]]:
        """The ids of the words of these ranks, read from the map."""
        starts, ids = self.arrays["starts"], self.arrays["ids"]
        low, high = starts[ranks], starts[ranks + 1]
        return [tuple(ids[a:b].tolist()) for a, b in zip(low.tolist(), high.tolist(), strict=True)]
