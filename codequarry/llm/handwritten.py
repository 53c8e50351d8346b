"""Generated, minified or vendored source files, told apart from hand-written ones.

A random forest over features of a file's text and path: compression ratio, token entropy, identifier lengths, comment density, line
lengths, the share of its blocks that also stand in other projects, and whether folder or name are of a kind where foreign or generated code
lies.  Its labels come from header notices (generated-by lines, third-party banners, the project's own terms), which are cut off before any
feature is taken, and from tables that are one literal, told by a measure that is no feature; so the forest cannot see what it was
labelled by, and has to carry the label over to files without it.

A notice stands for its own file, and so does a file name reserved for generated code; all other files are judged by the forest alone.  ``held_out`` measures the forest alone, on the labelled files of projects it was not fitted on.

The forest is fitted on at most ``SAMPLE`` labelled rows of each class, chosen by a hash of their key; everything else covers all
rows.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codequarry.llm.batches import slices
from codequarry.llm.forest import Forest
from codequarry.llm.hot import attach
from codequarry.plans.workspace import materialised

#: Most labelled rows of each class that the forest is fitted on.
SAMPLE = 6000
THRESHOLD = 0.6
#: Shorter blocks are too common to tell where a file comes from.
BLOCK_CHARS = 80
#: Of a literal table, letters outside literals are at most this share of all characters.
LITERAL_REST = 0.08

# Conventional notices of generated code, of third-party code and of a project's own terms.
_GENERATED = re.compile(
    r"@generated\b|\bcode generated by\b|\b(?:automatically|auto)[ -]?generated\b(?! (?:method|function|constructor|stub))"
    r"|\bgenerated (?:automatically )?(?:by|from|with|using) \S|\bdo not (?:edit|modify)\b|\bmachine[ -]generated\b|<auto-generated"
    r"|\bproduced by (?:the )?\S+ (?:compiler|generator|tool)\b"
    r"|\b(?:changes|edits?) (?:will be|is|are|get) (?:lost|overwritten|discarded)\b"
    r"|\berzeugt von\b|\bnicht (?:von Hand )?(?:bearbeiten|ändern)\b|\bgénéré\w* (?:par|automatiquement)\b|\bne pas modifier\b"
    r"|\bgenerad[oa] (?:por|automáticamente)\b|\bno (?:editar|modificar)\b",
    re.I,
)
_THIRD_PARTY = re.compile(r"\b(?:copied|imported|vendored|taken) from upstream\b|\bv?\d+\.\d+(?:\.\d+)?\b[^\n]*\b(?:terms|licen[cs]ed?|copyright|authors)\b|^\s*/\*!|@license\b|@preserve\b|\bcopyright (?:\(c\)|©|\d{4})", re.I | re.M)
_OWN_TERMS = re.compile(r"\bpart of the (?P<name>[\w.-]+) project\b", re.I)
#: File names and folders reserved for generated code by convention.
GENERATED_PATH = r"(?i)(\.(generated|gen|g|pb|pb\.gw|designer)\.\w+$|_pb2(_grpc)?\.pyi?$|(^|[./_-])min(\.[0-9a-f]{4,})?\.(js|css)$|\.bundle\.js$|(^|/)(generated|gen|__generated__)/)"

#: Folders where third-party or generated code lies by convention.
FOREIGN_FOLDER = r"(?i)(^|/)(vendor|vendored|third[_-]?party|external|deps|node_modules|dist|build|out|generated|gen|__generated__)/"

_HEADER = re.compile(r"\A(?:﻿)?(?:[ \t\r]*\n|#![^\n]*\n|[ \t]*(?://|#(?!\[|!\[))[^\n]*(?:\n|\Z)|[ \t]*/\*.*?\*/[ \t\r]*\n?|\s*(?:\"\"\".*?\"\"\"|'''.*?''')[ \t\r]*\n)+", re.S)
_TOKEN = re.compile(r"[^\W\d]\w*|\d[\w.]*|[^\w\s]")
_LITERAL = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|\b\d[\w.]*|[\s\[\](){},:;=+-]")
_COMMENT = re.compile(r"^[ \t]*(?://|#(?!\[)|/\*|\*)", re.M)

FEATURES = [
    "compression", "entropy", "name_length", "names_distinct", "names_short", "comments", "line_mean", "line_max", "digits",
    "marks", "blanks", "size", "lines_distinct", "shared", "reserved", "folder",
]
_OUT = "file_id long, notice string, own string, literal boolean, blocks array<struct<hash:long,size:int>>, f array<double>"


def header_of(text: str) -> str:
    """The comments and blank lines before the first line of code."""
    head = _HEADER.match(text)
    return head[0] if head else ""


def notice_of(header: str) -> tuple[str | None, str | None]:
    """(kind of notice, name of the project whose own terms it states; '' if it names none)."""
    own = _OWN_TERMS.search(header)
    kind = "third-party" if _THIRD_PARTY.search(header) else "generated" if _GENERATED.search(header) else None
    return kind, (own["name"] or "") if own else None


def text_features(body: str) -> list[float]:
    """All features but the last three, of a text without its header."""
    size = len(body) or 1
    tokens = _TOKEN.findall(body)
    counts = Counter(tokens)
    total = len(tokens) or 1
    entropy = -sum(n / total * math.log2(n / total) for n in counts.values())
    names = [(t, n) for t, n in counts.items() if t[0].isalpha() or t[0] == "_"]
    uses = sum(n for _, n in names) or 1
    lines = [x for x in map(str.strip, body.split("\n")) if x]
    count = len(lines) or 1
    digits = sum(map(body.count, "0123456789"))
    blanks = body.count(" ") + body.count("\n") + body.count("\t") + body.count("\r")
    return [
        len(zlib.compress(body.encode("utf-8", "replace"), 1)) / size, entropy, sum(len(t) * n for t, n in names) / uses, len(names) / uses,
        sum(n for t, n in names if len(t) < 3) / uses, len(_COMMENT.findall(body)) / count, len(body) / count, math.log1p(max(map(len, lines), default=0)),
        digits / size, 1 - (sum(len(t) * n for t, n in names) + digits + blanks) / size, blanks / size, math.log1p(len(body)), len(set(lines)) / count,
    ]


def is_literal(body: str) -> bool:
    """Whether a text is one table of literals: hardly a letter stands outside them."""
    return len(body) > 400 and len(_LITERAL.sub("", body)) <= LITERAL_REST * len(body)


def block_hashes(body: str) -> list[tuple[int, int]]:
    """(hash, size) of the blocks between blank lines."""
    out = []
    for block in re.split(r"\n[ \t\r]*\n", body):
        block = block.strip().replace("\r\n", "\n")
        if len(block) >= BLOCK_CHARS:
            out.append((int.from_bytes(hashlib.blake2b(block.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), len(block)))
    return out


def _features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32())])), pa.list_(pa.float64())]
    for batch in slices(batches, 1):
        out: list[list] = [[] for _ in kinds]
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            header = header_of(text)
            body = text[len(header) :]
            features, literal = text_features(body), is_literal(body)
            blocks = [{"hash": h, "size": n} for h, n in block_hashes(body)]
            for column, value in zip(out, (key, *notice_of(header), literal, blocks, features), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["file_id", "notice", "own", "literal", "blocks", "f"])


def described(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, path, repo, witness, label, settled, x): features and labels of every row of files.

    ``label`` is 1 (machine-made or foreign), 0 (the project's own) or null, by the ``witness`` 'notice', 'literal' or 'own'; ``settled`` is
    what notice or path say by themselves, 1 or 0, null if they say nothing.  A file without a row in sources or with a null text counts as empty.  Markdown has no label and no features.
    """
    rows = files.where("file_id IS NOT NULL AND lang <> 'markdown'").select(F.col("file_id").cast("long").alias("file_id"), F.coalesce("path", F.lit("")).alias("path")).dropDuplicates(["file_id"])
    rows = rows.withColumn("repo", F.split("path", "/")[0])
    seen = materialised(sources.where("file_id IS NOT NULL").select(F.col("file_id").cast("long").alias("file_id"), "content").mapInArrow(_features, _OUT).dropDuplicates(["file_id"]), "features")
    known = rows.join(seen, "file_id", "left")
    blocks = known.select("file_id", "repo", F.explode("blocks").alias("b")).select("file_id", "repo", "b.hash", "b.size")
    foreign = blocks.groupBy("hash").agg(F.count("*").alias("n"), F.min("repo").alias("low"), F.max("repo").alias("high")).where("low <> high").select("hash", "n")
    total = known.agg(F.sum(F.size(F.coalesce("blocks", F.expr("array()"))))).first()[0] or 0
    shared = attach(blocks, materialised(foreign, "foreign-blocks"), "hash", total).groupBy("file_id").agg(F.sum("size").alias("shared"))
    size = F.aggregate(F.coalesce("blocks", F.expr("array()")), F.lit(0), lambda a, b: a + b["size"])
    known = known.join(shared, "file_id", "left").withColumn("share", F.when(size > 0, F.coalesce("shared", F.lit(0)) / size).otherwise(0.0))
    reserved = F.col("path").rlike(GENERATED_PATH)
    own = F.coalesce(F.col("own").isNotNull() & ((F.col("own") == "") | (F.col("own") == F.col("repo"))), F.lit(False))
    machine = F.coalesce((F.col("notice") == "generated") | ((F.col("notice") == "third-party") & ~own), F.lit(False))
    witness = F.when(machine, "notice").when(F.coalesce("literal", F.lit(False)), "literal").when(own & ~reserved, "own")
    path = [F.when(F.col("path").rlike(p), 1.0).otherwise(0.0) for p in (GENERATED_PATH, FOREIGN_FOLDER)]
    x = F.concat(F.coalesce("f", F.array_repeat(F.lit(0.0), len(FEATURES) - 3)), F.array(F.col("share"), *path))
    label = F.when(witness.isin("notice", "literal"), 1).when(witness == "own", 0)
    return known.select("file_id", "path", "repo", witness.alias("witness"), label.alias("label"), F.when(machine | reserved, 1).when(witness == "own", 0).alias("settled"), x.alias("x"))


def fit(table: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """A forest over a bounded sample of the labelled rows; None where a class has no row."""
    order = F.xxhash64("file_id")
    rows = [table.where(F.col("label") == y).orderBy(order, "file_id").limit(sample).select("x").collect() for y in (0, 1)]
    if not all(rows):
        return None
    x = np.array([r["x"] for part in rows for r in part], np.float64)
    return Forest.fit(x, np.repeat([0, 1], [len(rows[0]), len(rows[1])]))


def scored(files: DataFrame, sources: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(file_id, path, score, decisive, written_by_hand) for every file in a programming language."""
    table = materialised(described(files, sources), "described")
    forest = fit(table, sample)

    out = table.mapInPandas(_predict(forest), "file_id long, path string, settled int, score double")
    by_hand = F.when(F.col("settled").isNotNull(), F.col("settled") == 0).otherwise(F.col("score") < THRESHOLD)
    return out.select("file_id", "path", F.round("score", 6).alias("score"), F.col("settled").isNotNull().alias("decisive"), by_hand.alias("written_by_hand"))


def _predict(forest: Forest | None, *more: str):
    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            x = np.array(part["x"].tolist(), np.float64).reshape(len(part), len(FEATURES))
            score = forest.predict(x) if forest and len(part) else np.where(part["label"].fillna(0) == 1, 1.0, 0.0)
            score = np.where(x[:, FEATURES.index("size")] == 0, 0.0, score)  # there is nothing to judge in an empty file
            yield part[["file_id", "path", "settled", *more]].assign(score=score)

    return run


def held_out(files: DataFrame, sources: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(witness, files, flagged, share): what the forest alone says of labelled files of projects that it was not fitted on.

    Projects are halved by a hash of their name; each half is judged by a forest fitted on the other.  'notice' and 'literal' should be
    flagged, 'own' should not.  A half without a label of each kind is judged by nothing and left out.
    """
    table = materialised(described(files, sources), "described")
    half = F.pmod(F.xxhash64("repo"), F.lit(2))
    out = None
    for k in (0, 1):
        forest = fit(table.where(half != k), sample)
        if forest:
            rows = table.where((half == k) & F.col("witness").isNotNull()).mapInPandas(_predict(forest, "witness"), "file_id long, path string, settled int, witness string, score double")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        return files.sparkSession.createDataFrame([], "witness string, files long, flagged long, share double")
    grouped = out.groupBy("witness").agg(F.count("*").alias("files"), F.count_if(F.col("score") >= THRESHOLD).alias("flagged"))
    return grouped.select("witness", "files", "flagged", F.round(F.col("flagged") / F.col("files"), 6).alias("share"))


def not_handwritten(files: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id): the files no member of the project wrote by hand."""
    return scored(files, sources).where("NOT written_by_hand").select("file_id")
