"""Encoding of a whole corpus with a byte-level BPE vocabulary.

Two passes over the texts.  The first counts the pre-tokens ("words") of *all* texts; the most frequent ones (at most
``LEXICON_WORDS``, each of at most 64 bytes, so the lexicon has a fixed size bound) are compiled into a minimal acyclic
transducer with id outputs, which every worker memory-maps.  The second pass splits each text, finds its distinct words in the
transducer, merges the words it does not hold exactly as the vocabulary says, and joins the ids.

Defined cases: an empty or null text has the empty list of ids; the strings of special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.batches import slices
from codequarry.llm.lexicon import Lexicon, compile_words, to_bytes
from codequarry.plans.workspace import FileStore, materialised, new_folder

#: Size bound of the lexicon.
LEXICON_WORDS = 65_536
_LONGEST = 64
#: A worker forgets its memo of words beyond this many, or this many bytes of words and ids.
_MEMO_WORDS = 400_000
_MEMO_BYTES = 64_000_000
#: What a word of the memo takes beside its characters (string, tuple, entry), and what an id takes, in bytes.
_WORD_BYTES, _ID_BYTES = 200, 40
RANKS_FILE = os.environ.get("CODEQUARRY_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: how the vocabulary's public description splits a text into words before any merge.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters of common scripts, all of Unicode's category L, beside the ASCII ones.
_LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f\u4e00-\u9fa5"
#: Texts of ASCII, these letters, and signs that are neither letters, numbers nor white space.
_PLAIN = re.compile(f"[\x00-\x7f{_LETTERS}\u00a1-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u2190-\u23ff\u2600-\u26ff\u2794-\u27bf\ufffd\U0001f300-\U0001faff]*")
#: The language of SPLIT over such texts, for the standard library's faster matcher.
_FAST = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\t-\r {_LETTERS}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")


class Splitter:
    """Splits texts into words; the split of a text joins to the text."""

    def __init__(self):
        import regex

        self._any = regex.compile(SPLIT.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s+(?!\S)", r"\p{White_Space}+(?!\P{White_Space})").replace(r"|\s+", r"|\p{White_Space}+"))

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        return _FAST.findall(text) if text.isascii() or _PLAIN.fullmatch(text) else self._any.findall(text)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class Merger:
    """Exact byte-pair merges of one word at a time."""

    def __init__(self, path: str):
        import tiktoken

        self._encoding = tiktoken.Encoding(os.path.basename(path), pat_str=SPLIT, mergeable_ranks=read_ranks(path), special_tokens={})

    def __call__(self, word: str) -> tuple[int, ...]:
        return tuple(self._encoding.encode_ordinary(word))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split, counts = Splitter(), Counter()

    def flush() -> pa.RecordBatch:
        words = [w for w in counts if len(w) <= _LONGEST]
        batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[w] for w in words], pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in slices(batches, 0):
        for text in batch.column(0).to_pylist():
            counts.update(split(text))
        if len(counts) > _MEMO_WORDS:
            yield flush()
    yield flush()


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) over all texts, without words of more than 64 characters; counts are summed per worker before the shuffle."""
    return docs.select(F.col(text)).mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str = "text", ranks: str = RANKS_FILE, words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Count the corpus, compile its most frequent words, hand lexicon and vocabulary to all executors; the names they are found under.

    Only the driver reads ``ranks`` where it lies; the executors get copies.
    """
    spark = docs.sparkSession
    counts = materialised(word_counts(docs, text).where("n > 1"), "word-counts")
    least, kept = 2, 0
    for row in counts.groupBy("n").count().orderBy(F.desc("n")).toLocalIterator():
        kept += row["count"]
        if kept > words:
            least = row["n"] + 1
            break
    frequent = [r["word"] for r in counts.where(F.col("n") >= least).select("word").collect()]
    merge = Merger(ranks)
    pairs = [(w.encode(), list(merge(w))) for w in frequent]
    root, _, name = new_folder(spark, "lexicon").rpartition("/")
    image = to_bytes(compile_words([p for p in pairs if 0 < len(p[0]) <= _LONGEST]))
    store = FileStore(spark, root)
    spark.sparkContext.addFile(store.write_bytes(name, image))
    with open(ranks, "rb") as file:
        data = file.read()
    vocabulary = f"ranks-{hashlib.sha256(data).hexdigest()[:32]}"
    if vocabulary not in (shipped := spark.sparkContext.__dict__.setdefault("_codequarry_files", set())):  # once per context
        spark.sparkContext.addFile(store.write_bytes(vocabulary, data))
        shipped.add(vocabulary)
    return name, vocabulary


class Encoder:
    """Encodes texts on a worker."""

    def __init__(self, name: str, ranks: str):
        self._lexicon = Lexicon.mapped(SparkFiles.get(name))
        self.split, self._merge, self._ranks = Splitter(), None, ranks
        self._memo: dict[str, tuple[int, ...]] = {}
        self._bytes = 0

    def _learn(self, words: list[str]) -> None:
        memo, ranks = self._memo, self._lexicon.ranks([w.encode() for w in words])
        held = np.flatnonzero(ranks >= 0)
        memo.update(zip([words[k] for k in held.tolist()], self._lexicon.ids(ranks[held]), strict=True))
        unseen = [words[k] for k in np.flatnonzero(ranks < 0).tolist()]
        if unseen:
            self._merge = self._merge or Merger(SparkFiles.get(self._ranks))
            memo.update(zip(unseen, map(self._merge, unseen), strict=True))
        self._bytes += sum(_WORD_BYTES + len(w) + _ID_BYTES * len(memo[w]) for w in words)

    def __call__(self, texts: list[str | None]) -> list[list[tuple[int, ...]]]:
        """Per text the ids of each of its words."""
        return self.encoded([self.split(t) for t in texts])

    def encoded(self, split: list[list[str]]) -> list[list[tuple[int, ...]]]:
        if len(self._memo) > _MEMO_WORDS or self._bytes > _MEMO_BYTES:
            self._memo, self._bytes = {}, 0
        fresh = set(itertools.chain.from_iterable(split)).difference(self._memo)
        self._learn(list(fresh))
        of = self._memo.__getitem__
        return [list(map(of, words)) for words in split]


def _id_list(encoded: list[list[tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of all texts."""
    flat = itertools.chain.from_iterable
    lengths = [sum(map(len, words)) for words in encoded]
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32), np.fromiter(flat(flat(encoded)), np.int32, sum(lengths))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS_FILE, words: int = LEXICON_WORDS) -> DataFrame:
    """(key, ids): the token ids of every row's text."""
    name, vocabulary = build_lexicon(docs, text, ranks, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, 1):
            encoder = encoder or Encoder(name, vocabulary)
            offsets, ids = _id_list(encoder(batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def _behind_first_line(text: str | None, words: list[tuple[int, ...]], split: list[str]) -> int:
    """The number of ids of the words that begin behind the first line; of all words where there is one line only."""
    first = (text or "").find("\n") + 1
    if not first:
        return sum(map(len, words))
    at = total = 0
    for word, ids in zip(split, words, strict=True):
        total += len(ids) if at >= first else 0
        at += len(word)
    return total


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = RANKS_FILE, words: int = LEXICON_WORDS) -> DataFrame:
    """(key, tokens, answer): the number of token ids of every row's text, and of those behind its first line (all, if it has one only)."""
    name, vocabulary = build_lexicon(docs, text, ranks, words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in slices(batches, 1):
            encoder = encoder or Encoder(name, vocabulary)
            texts = batch.column(1).to_pylist()
            split = [encoder.split(t) for t in texts]
            encoded = encoder.encoded(split)
            sizes = [sum(map(len, words)) for words in encoded]
            answers = list(map(_behind_first_line, texts, encoded, split))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(answers, pa.int64())], [key, "tokens", "answer"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, tokens long, answer long")
