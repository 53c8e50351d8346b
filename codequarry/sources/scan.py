"""Scanning directories into tables.

A tree on the driver's machine is walked there, with ignore rules; a tree in shared storage is listed by Spark's binary file source, whose
columns are pruned, so a listing reads no bytes, and the same rules are applied by the executors.  Contents are read and hashed for the
paths that are asked for only.
"""

from __future__ import annotations

import fnmatch
import os

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from codequarry import schema
from codequarry.functions import columns as C
from codequarry.plans.workspace import FileStore

#: Up to so many paths are named to the reader one by one; beyond that the whole tree is read and joined with them.
NAMED_PATHS = 10_000
#: A tree in shared storage may have so many files of ignore rules at most; they are sent to all executors.
RULE_FILES = 10_000
_WALK = "path string, extension string, size_bytes long, mtime_nanos long, supported boolean, reason string"


class IgnoreRules:
    """The patterns of the .gitignore files seen on the way down; the last one that matches decides."""

    def __init__(self, rules: tuple[tuple[str, str, bool, bool], ...] = ()):
        self._rules = rules

    def below(self, folder: str, lines: list[str]) -> IgnoreRules:
        new = []
        for line in lines:
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            pattern = line[keep:]
            new.append((folder, pattern.rstrip("/"), pattern.endswith("/"), keep))
        return IgnoreRules((*self._rules, *new))

    @classmethod
    def of_files(cls, texts: dict[str, str]) -> IgnoreRules:
        """The rules of all rule files of a tree (folder -> text), those of outer folders first."""
        rules = cls()
        for folder in sorted(texts, key=lambda f: (f.count("/") + bool(f), f)):
            rules = rules.below(folder, texts[folder].split("\n"))
        return rules

    def passes_over(self, path: str) -> bool:
        """Whether a file or one of the folders above it is hidden, skipped or ignored."""
        parts = path.split("/")
        if any(p.startswith(".") for p in parts) or any(p in schema.SKIPPED_FOLDERS for p in parts[:-1]):
            return True
        return any(self.ignores("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1))

    def ignores(self, path: str, is_dir: bool) -> bool:
        verdict = False
        for folder, pattern, only_dirs, keep in self._rules:
            if folder and not path.startswith(folder + "/"):
                continue
            inside = path[len(folder) + 1 :] if folder else path
            anchored = "/" in pattern
            target = inside if anchored else inside.rsplit("/", 1)[-1]
            if (not only_dirs or is_dir) and fnmatch.fnmatchcase(target, pattern.lstrip("/")):
                verdict = not keep
        return verdict


def walk_rows(root: str, max_mb: float = schema.MAX_FILE_MB) -> tuple[list[tuple], bool]:
    """Rows of every regular file below ``root``, with why it is not supported, and whether a folder could not be read.

    Hidden entries, links and the folders of ``SKIPPED_FOLDERS`` are passed over; too large comes before an unknown extension.
    """
    rows: list[tuple] = []
    failed = False
    stack = [("", IgnoreRules())]
    while stack:
        folder, rules = stack.pop()
        try:
            entries = sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name)
        except OSError:
            failed = True
            continue
        if any(e.name == ".gitignore" for e in entries):
            with open(os.path.join(root, folder, ".gitignore"), encoding="utf-8", errors="replace") as file:
                rules = rules.below(folder, file.read().split("\n"))
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.name.startswith(".") or entry.is_symlink() or rules.ignores(path, entry.is_dir()):
                continue
            if entry.is_dir():
                if entry.name not in schema.SKIPPED_FOLDERS:
                    stack.append((path, rules))
            elif entry.is_file():
                at = entry.stat()
                ext = entry.name.rpartition(".")[2].lower() if "." in entry.name else ""
                reason = "too_large" if max_mb and at.st_size > max_mb * 2**20 else None if ext in schema.SUPPORTED else "unsupported_extension"
                rows.append((path, ext, at.st_size, at.st_mtime_ns, reason is None, reason))
    return rows, failed


def walk(spark: SparkSession, root: str, max_mb: float = schema.MAX_FILE_MB) -> tuple[DataFrame, bool]:
    """(path, extension, size_bytes, mtime_nanos, supported, reason) of a local tree, and whether the walk had errors."""
    rows, failed = walk_rows(root, max_mb)
    return spark.createDataFrame(rows, _WALK), failed


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, extension, size_bytes, mtime_nanos, supported) of a tree in shared storage, without reading contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^.*?" + _quoted(root) + "/*", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_nanos"))
    return rows.select("path", C.extension("path").alias("extension"), "size_bytes", "mtime_nanos", C.supported("path").alias("supported"))


def _reason(max_mb: float):
    too_large = F.col("size_bytes") > int(max_mb * 2**20) if max_mb else F.lit(False)
    return F.when(too_large, "too_large").when(~C.supported("path"), "unsupported_extension")


def tree(spark: SparkSession, root: str, max_mb: float = schema.MAX_FILE_MB) -> tuple[DataFrame, bool]:
    """(path, extension, size_bytes, mtime_nanos, supported, reason) of a tree anywhere, by ignore rules, and whether the walk had errors.

    No contents are read.  In shared storage a folder that cannot be listed is an error of the listing.
    """
    local = root.removeprefix("file://")
    if "://" not in local:
        return walk(spark, local, max_mb)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", ".gitignore").load(root).limit(RULE_FILES + 1).select("path", F.col("content").cast("string").alias("text")).collect()
    if len(found) > RULE_FILES:
        raise ValueError(f"more than {RULE_FILES} files of ignore rules below {root}")
    inside = root.split("://", 1)[-1].rstrip("/")
    rules = IgnoreRules.of_files({r["path"].split(inside, 1)[-1].strip("/").rpartition("/")[0]: r["text"] or "" for r in found})

    def kept(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[[not rules.passes_over(p) for p in part["path"]]]

    rows = listing(spark, root).drop("supported").mapInPandas(kept, "path string, extension string, size_bytes long, mtime_nanos long")
    reason = _reason(max_mb)
    return rows.select("*", reason.isNull().alias("supported"), reason.alias("reason")), False


def contents(spark: SparkSession, root: str, paths: DataFrame | None = None) -> DataFrame:
    """(path, lang, size_bytes, mtime_nanos, hash, content): the texts of supported files below ``root``; no UTF-8, no row.

    ``paths`` (path) names the files to read.  Up to NAMED_PATHS are read one by one; for more the whole tree is read and joined with them.
    """
    source = spark.read.format("binaryFile")
    few = None if paths is None else [r["path"] for r in paths.select("path").distinct().limit(NAMED_PATHS + 1).collect()]
    if few is not None and len(few) <= NAMED_PATHS:
        if not few:
            return spark.createDataFrame([], "path string, lang string, size_bytes long, mtime_nanos long, hash string, content string")
        escape = str.maketrans({c: "\\" + c for c in "\\[]{}*?"})
        try:
            files = source.load([f"{root.rstrip('/')}/{p}".translate(escape) for p in few])
        except AnalysisException:  # some are gone since they were listed
            store = FileStore(spark, root if "://" in root else f"file://{root}")
            return contents(spark, root, paths.where(F.col("path").isin([p for p in few if store.exists(p)])))
    else:
        files = source.option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace("path", r"^.*?" + _quoted(root) + "/*", "")
    rows = files.select(path.alias("path"), F.col("length").alias("size_bytes"), (F.unix_micros("modificationTime") * 1000).alias("mtime_nanos"), F.sha2("content", 256).alias("hash"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))
    rows = rows.where(C.supported("path") & F.col("content").isNotNull()).select("path", C.language("path").alias("lang"), "size_bytes", "mtime_nanos", "hash", "content")
    return rows if few is not None and len(few) <= NAMED_PATHS or paths is None else rows.join(paths.select("path"), "path", "left_semi")


def _quoted(root: str) -> str:
    import re

    return re.escape(root.split("://", 1)[-1].rstrip("/"))
