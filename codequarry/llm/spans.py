"""Long exact spans shared between records.

Line and paragraph hashing.  The units of a text are the paragraphs of ``UNIT`` characters that start where a line starts; in
lines longer than ``LONG_LINE`` also where a rolling hash has its least value among ``REACH`` places, which depends on the text
around that place only.  Units are normalised sign by sign (capitals, tabs) before they are hashed, so offsets stay as they are, and
digests are grouped globally; only units that stand in different files go on.  What is shared is then checked verbatim.  Of a shared
span the earliest ranked occurrence is kept; ``without_shared`` removes the others and gives their original offsets.

Why no shared span of ``SPAN`` characters is missed: if its first ``SPAN - UNIT`` characters hold a line start, the unit there
lies in the span, in both records.  If not, they lie within one long line in both records, and hold a least place of their own,
again the same in both.

The exact check extends every match of two units to both sides over the ``SPAN - UNIT`` characters around it.  Groups of up to
``SMALL_GROUP`` units are compared pairwise; in larger ones the window around the unit grows in three steps to a whole span, each step splitting the
group by the hash of the longer window, so that many records that share a short piece (a licence, say) never meet in pairs.

Digests that hold a large part of all rows, of which there cannot be many, are joined by broadcast (``hot``), so that a digest of a third of all rows is no task of its own.  Links are between classes of equal texts (``class_links`` with
``class_members``); only ``shared_pairs`` writes them out for all copies.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codequarry.llm.batches import slices
from codequarry.llm.hot import attach
from codequarry.plans.workspace import materialised

SPAN = 300
UNIT = 100
AROUND = SPAN - UNIT
LONG_LINE = 200
GRAM, REACH = 8, 128
SMALL_GROUP = 48
#: Normalising of units, sign by sign.
_NORMAL = np.arange(128, dtype=np.uint32)
_NORMAL[ord("A") : ord("Z") + 1] += 32
_NORMAL[ord("\t")] = ord(" ")

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


class Hashes:
    """Rolling hashes (mod 2**64) of any window of one array of code points."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]))
            self._back = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, _INVERSE)]))
            mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            self._sums = np.concatenate([[np.uint64(0)], np.cumsum((mixed ^ (mixed >> np.uint64(29))) * powers[:n], dtype=np.uint64)])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (self._sums[starts + length] - self._sums[starts]) * self._back[starts]
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(32))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def normalised(points: np.ndarray) -> np.ndarray:
    """ASCII capitals as small letters and tabs as blanks; all other signs as they are."""
    return np.where(points < 128, _NORMAL[np.minimum(points, 127)], points)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over every window of ``width`` (a power of 2) values."""
    step = 1
    while step < width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return values


def _least_places(hashes: Hashes, start: int, end: int) -> np.ndarray:
    """Places in [start, end) whose gram is the least of some window of REACH places."""
    count = end - start - GRAM + 1
    if count < REACH:
        return np.zeros(0, np.int64)
    grams = hashes.of(np.arange(start, start + count), GRAM)
    least = _sliding(grams, REACH, np.minimum)
    padded = np.concatenate([np.zeros(REACH - 1, np.uint64), least, np.zeros(REACH - 1, np.uint64)])
    return start + np.flatnonzero(_sliding(padded, REACH, np.maximum) == grams)


def anchors(points: np.ndarray, hashes: Hashes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, digest) of the units of the texts that lie end to end in ``points``; ``bounds``: their starts and the last end."""
    breaks = np.flatnonzero(points == 10) + 1
    lines = np.union1d(breaks[breaks < len(points)], bounds[:-1])
    ends = np.append(lines[1:], len(points))
    long = np.flatnonzero(ends - lines > LONG_LINE)
    extra = [_least_places(hashes, int(lines[i]), int(ends[i])) for i in long]
    places = np.union1d(lines, np.concatenate(extra)) if extra else lines
    limit = bounds[np.searchsorted(bounds, places, "right")]
    places = places[places + UNIT <= limit]
    digests = hashes.of(places, UNIT)
    if len(places) > 2:  # a run of units of one repeated character at adjacent places is known by its two ends
        alike = np.concatenate([[0], np.cumsum(points[1:] == points[:-1])])
        one = alike[np.minimum(places[:-1] + UNIT, len(points) - 1)] - alike[places[:-1]] == UNIT
        same = (digests[1:] == digests[:-1]) & (np.diff(places) == 1) & one
        inner = np.concatenate([[False], same[:-1] & same[1:], [False]])
        places, digests = places[~inner], digests[~inner]
    return places, digests


def _anchor_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        parts = [code_points(t) for t in batch.column(2).to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        points = np.concatenate(parts)
        places, digests = anchors(points, Hashes(normalised(points)), bounds)
        text = np.searchsorted(bounds, places, "right") - 1
        take = pa.array(text)
        offsets = pa.array((places - bounds[text]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(digests.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), offsets], ["digest", "class", "file_id", "at"])


def _extent(a: str, i: int, b: str, j: int) -> tuple[int, int]:
    """(left, right): how far texts equal at [i, i + UNIT) and [j, j + UNIT) go on, up to AROUND."""

    def common(x: str, y: str) -> int:
        if x == y:
            return len(x)
        low, high = 0, min(len(x), len(y))
        while low < high:
            middle = (low + high + 1) // 2
            if x[:middle] == y[:middle]:
                low = middle
            else:
                high = middle - 1
        return low

    right = common(a[i + UNIT : i + SPAN], b[j + UNIT : j + SPAN])
    left = common(a[max(0, i - AROUND) : i][::-1], b[max(0, j - AROUND) : j][::-1])
    return left, right


_MATCH = "a string, b string, a_start int, a_end int, b_start int, b_end int"


def _small_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairwise over the members (class, at, before, slice) of each digest."""
    for batch in batches:
        out: list[tuple] = []
        for members in batch.column(0).to_pylist():
            members.sort(key=lambda m: (m["class"], m["at"]))
            for x in range(len(members)):
                p = members[x]
                for y in range(x + 1, len(members)):
                    q = members[y]
                    if p["class"] == q["class"]:
                        continue
                    i, j = p["before"], q["before"]
                    if p["slice"][i : i + UNIT] != q["slice"][j : j + UNIT]:
                        continue
                    left, right = _extent(p["slice"], i, q["slice"], j)
                    if left + UNIT + right >= SPAN:
                        out.append((p["class"], q["class"], p["at"] - left, p["at"] + UNIT + right, q["at"] - left, q["at"] + UNIT + right))
        columns = list(zip(*out, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int32()) for k, c in enumerate(columns)], ["a", "b", "a_start", "a_end", "b_start", "b_end"])


#: How windows grow around a unit of a large group: from, to, step.  A span that holds a window of the first length holds one of
#: the second that starts a whole number of steps, at most (SPAN - from) / step, before it; the last windows are whole spans.
_GROWTH = ((UNIT, 250, 50), (250, 290, 10), (290, SPAN, 1))


def _grown(length: int, to: int, step: int):
    """(key, class, at, before, slice, window) of every longer window around the window of each row; windows are places in the slice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            for name, at, before, piece, window in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                points = code_points(piece)
                starts = np.array([w for j in range((SPAN - length) // step + 1) if (w := window - j * step) >= 0 and w + to <= len(points)], np.int64)
                for start, key in zip(starts.tolist(), Hashes(points).of(starts, to).view(np.int64).tolist(), strict=True):
                    out.append((key, name, at, before, piece, start))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "class", "at", "before", "slice", "window"])

    return run


def _pairwise(rows: DataFrame, key: str) -> DataFrame:
    groups = rows.groupBy(key).agg(F.collect_list(F.struct("class", "at", "before", "slice")).alias("members"))
    return groups.select("members").mapInArrow(_small_groups, _MATCH)


def _large_groups(rows: DataFrame) -> tuple[list[DataFrame], DataFrame | None]:
    """(matches, whole spans) of units whose groups are too large for pairs: windows grow until groups are small or windows are whole spans.

    Whole spans are (key, text, class, at), every place of each; classes that hold the same text meet by it, not in pairs.
    """
    rows = rows.select("class", "at", "before", "slice", F.col("before").alias("window"))
    parts = []
    for length, to, step in _GROWTH:
        schema = "key long, class string, at int, before int, slice string, window int"
        grown = materialised(rows.mapInArrow(_grown(length, to, step), schema), "windows")
        if to == SPAN:
            span = F.substring("slice", F.col("window") + 1, F.lit(SPAN))
            return parts, grown.select("key", span.alias("text"), "class", (F.col("at") - F.col("before") + F.col("window")).alias("at")).distinct()
        sizes = grown.groupBy("key").agg(F.count("*").alias("n"), (F.min("class") != F.max("class")).alias("mixed")).where("mixed")
        sizes = materialised(sizes.select("key", "n"), "window-sizes")
        grown = materialised(attach(grown, sizes, "key", grown.count()), "sized-windows")
        parts.append(_pairwise(grown.where(F.col("n") <= SMALL_GROUP), "key"))
        rows = grown.where(F.col("n") > SMALL_GROUP).select("class", "at", "before", "slice", "window")
        if rows.isEmpty():
            break
    return parts, None


def _classes(chunks: DataFrame) -> DataFrame:
    """(class, chunk_id, file_id, content): rows that can share a span; equal texts are one class."""
    rows = chunks.where((F.length("content") >= SPAN) & F.col("chunk_id").isNotNull() & F.col("file_id").isNotNull())
    return rows.select(F.md5("content").alias("class"), F.col("chunk_id").cast("long").alias("chunk_id"), F.col("file_id").cast("long").alias("file_id"), "content")


def matches(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """((a, b, a_start, a_end, b_start, b_end), (key, text, class, at)): spans of at least SPAN characters common to two classes.

    The first are spans of pairs, a < b, the second whole spans of large groups, null where there are none; offsets in characters.
    Spans may overlap; together with ``runs`` they cover every shared span whole, at every place.
    """
    units = rows.select("class", "file_id", "content").mapInArrow(_anchor_rows, "digest long, class string, file_id long, at int")
    units = materialised(units, "units")
    shared = units.groupBy("digest").agg(F.count("*").alias("n"), F.min("file_id").alias("low"), F.max("file_id").alias("high"), F.min("class").alias("first"), F.max("class").alias("last"))
    shared = materialised(shared.where("low <> high AND first <> last").select("digest", "n"), "shared-digests")
    kept = materialised(attach(units, shared, "digest", units.count()).select("digest", "class", "at").distinct(), "shared-units")
    sizes = materialised(kept.groupBy("digest").agg(F.count("*").alias("n")), "digest-sizes")
    placed = attach(kept, sizes, "digest", kept.count()).groupBy("class").agg(F.collect_list(F.struct("digest", "at", "n")).alias("units"))
    texts = rows.select("class", "content").join(placed.select("class"), "class", "left_semi").dropDuplicates(["class"])
    cut = texts.join(placed, "class").select("class", "content", F.explode("units").alias("u"))
    before = F.least(F.col("u.at"), F.lit(AROUND))
    sliced = cut.select(F.col("u.digest").alias("digest"), F.col("u.n").alias("n"), "class", F.col("u.at").alias("at"), before.alias("before"), F.substring("content", F.col("u.at") - before + 1, before + F.lit(SPAN)).alias("slice"))
    sliced = materialised(sliced, "slices")
    found = _pairwise(sliced.where(F.col("n") <= SMALL_GROUP), "digest")
    large = sliced.where(F.col("n") > SMALL_GROUP)
    if large.isEmpty():
        return found, None
    parts, whole = _large_groups(large)
    for part in parts:
        found = found.unionByName(part)
    return found, whole


def _run_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            points = code_points(text)
            bounds = np.concatenate([[0], np.flatnonzero(points[1:] != points[:-1]) + 1, [len(points)]])
            for k in np.flatnonzero(np.diff(bounds) >= SPAN).tolist():
                out.append((text[bounds[k]], name, bounds[k], bounds[k + 1]))
        columns = list(zip(*out, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k < 2 else pa.int32()) for k, c in enumerate(columns)], ["text", "class", "start", "stop"])


def runs(rows: DataFrame) -> DataFrame:
    """(text, class, start, stop): runs of one character of at least SPAN; any two runs of it share every span of the shorter.

    Of such a run only the ends are units, so what lies further inside than AROUND is covered by these alone.
    """
    return rows.select("class", "content").dropDuplicates(["class"]).mapInArrow(_run_rows, "text string, class string, start int, stop int")


def _earliest(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, first, second) over rows with ``first`` and ``second`` (chunk_id, file_id): the least, and the least of another file."""
    first = rows.groupBy(*by).agg(F.min("first").alias("_first"))
    elsewhere = F.when(F.col("first.file_id") != F.col("_first.file_id"), F.col("first")).otherwise(F.col("second"))
    return rows.join(first, by).groupBy(*by).agg(F.min("_first").alias("first"), F.min(elsewhere).alias("second"))


def _held_spans(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, class, start, stop, origin): every span of a chunk that another file holds, once for each group of holders.

    ``origin`` is the holders' least chunk_id in another file; null if that file has the same chunk_id only.  Spans may overlap.
    """
    rows = _classes(chunks)
    members = rows.select("class", "chunk_id", "file_id").distinct()
    place = F.struct("chunk_id", "file_id")
    holders = materialised(_earliest(members.select("class", place.alias("first"), F.lit(None).cast("struct<chunk_id:bigint,file_id:bigint>").alias("second")), ["class"]), "holders")
    found, whole = matches(rows)
    found = materialised(found, "spans")
    both = found.selectExpr("a AS class", "b AS other", "a_start AS start", "a_end AS stop").unionByName(found.selectExpr("b AS class", "a AS other", "b_start AS start", "b_end AS stop"))
    copies = rows.select("class", F.length("content").alias("stop")).distinct().join(holders.where("second IS NOT NULL").select("class"), "class", "left_semi").selectExpr("class", "class AS other", "0 AS start", "stop")
    both = both.unionByName(copies).distinct().join(holders.withColumnRenamed("class", "other"), "other").select("class", "start", "stop", "first", "second")
    many = runs(rows).select(F.lit(0).cast("long").alias("key"), "text", "class", "start", "stop")
    if whole is not None:
        many = many.unionByName(whole.select("key", "text", "class", F.col("at").alias("start"), (F.col("at") + SPAN).alias("stop")))
    many = materialised(many, "whole-spans")
    held = _earliest(many.select("key", "text", "class").distinct().join(holders, "class"), ["key", "text"]).where("second IS NOT NULL")
    both = both.unionByName(many.join(held, ["key", "text"]).select("class", "start", "stop", "first", "second"))
    by = Window.partitionBy("class", "first", "second").orderBy("start", "stop")
    # spans of the same holders that touch are one
    opens = F.coalesce(F.col("start") > F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    numbered = both.withColumn("opens", opens.cast("int")).withColumn("part", F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    joined = numbered.groupBy("class", "first", "second", "part").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    placed = members.join(joined, "class")
    away = [F.col(f"{c}.file_id") != F.col("file_id") for c in ("first", "second")]
    other = [F.when(away[k] & (F.col(f"{c}.chunk_id") != F.col("chunk_id")), F.col(f"{c}.chunk_id")) for k, c in enumerate(("first", "second"))]
    placed = placed.where(away[0] | away[1])
    return placed.select("chunk_id", "file_id", "class", "start", "stop", F.coalesce(*other).alias("origin"))


def class_members(chunks: DataFrame) -> DataFrame:
    """(class, chunk_id, file_id): the classes of equal texts that can share a span; a row of each chunk in each of its files."""
    return _classes(chunks).select("class", "chunk_id", "file_id").distinct()


def class_links(chunks: DataFrame) -> DataFrame:
    """(a, b), a < b: classes of different texts with a span of at least SPAN characters in common, in whatever files."""
    found, whole = matches(_classes(chunks))
    pairs = found.select("a", "b")
    if whole is not None:
        left, right = (whole.select("key", "text", F.col("class").alias(c)).distinct() for c in ("a", "b"))
        pairs = pairs.unionByName(left.join(right, ["key", "text"]).where("a < b").select("a", "b"))
    return pairs.distinct()


def linked_chunks(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, class, copies, links): one row for each chunk in each of its files.

    ``copies`` counts the other members of its class, ``links`` the classes of other texts that share a span with it.  Null contents, keys
    or files and texts shorter than SPAN are in no class and have no row.
    """
    members = class_members(chunks)
    pairs = materialised(class_links(chunks), "links")
    links = pairs.selectExpr("a AS class").unionByName(pairs.selectExpr("b AS class")).groupBy("class").agg(F.count("*").alias("links"))
    sizes = members.groupBy("class").agg((F.count("*") - 1).alias("copies"))
    known = sizes.join(links, "class", "left")
    return members.join(known, "class").select("chunk_id", "file_id", "class", "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def shared_pairs(chunks: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: chunks of different files with a span of at least SPAN characters in common.

    ``class_links`` written out for all members.  Null contents, keys or files and shorter texts have no partners; repeated rows count
    once; a key may lie in several files.
    """
    members = class_members(chunks)
    copies = members.groupBy("class").agg(F.count("*").alias("n"), F.min("file_id").alias("low"), F.max("file_id").alias("high")).where("n > 1 AND low <> high")
    pairs = class_links(chunks).unionByName(copies.select(F.col("class").alias("a"), F.col("class").alias("b")))
    left, right = (members.select(F.col("class").alias(c), F.col("chunk_id").alias(f"chunk_{c}"), F.col("file_id").alias(f"file_{c}")) for c in ("a", "b"))
    both = pairs.join(left, "a").join(right, "b").where("file_a <> file_b AND chunk_a <> chunk_b AND (a <> b OR chunk_a < chunk_b)")
    return both.select(F.least("chunk_a", "chunk_b").alias("chunk_a"), F.greatest("chunk_a", "chunk_b").alias("chunk_b")).distinct()


def shared_shares(chunks: DataFrame) -> DataFrame:
    """(chunk_id, chars, shared_chars, share, origin): how much of each chunk's content also stands in another file.

    ``origin`` is the least chunk_id that holds some of it in another file, the occurrence to keep when the rest is removed; null
    where nothing is shared.  Every chunk comes out once; a null or empty content has share 0.
    """
    spans_of = _held_spans(chunks).groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"), F.min("origin").alias("origin"))
    step = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["sum"] + F.greatest(F.lit(0), s["stop"] - F.greatest(s["start"], acc["end"]))).alias("sum"), F.greatest(acc["end"], s["stop"]).alias("end")),
        lambda acc: acc["sum"],
    )
    every = chunks.where("chunk_id IS NOT NULL").groupBy(F.col("chunk_id").cast("long").alias("chunk_id")).agg(F.max(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))
    out = every.join(spans_of.select("chunk_id", step.alias("shared"), "origin"), "chunk_id", "left")
    n = F.coalesce("shared", F.lit(0))
    return out.select("chunk_id", "chars", n.alias("shared_chars"), F.round(F.when(F.col("chars") > 0, n / F.col("chars")).otherwise(0.0), 6).alias("share"), "origin")


def without_shared(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_id, removed, kept): each chunk's text without the spans that an earlier chunk of another file holds.

    ``removed`` are the spans (start, stop, origin) in offsets of the whole content, origin being the chunk_id of the earliest
    holder; they may overlap.  The earliest occurrence of a span stays, ranked by chunk_id.  A null content is kept null.
    """
    later = _held_spans(chunks).where("origin < chunk_id").groupBy("chunk_id", "file_id", "class").agg(F.sort_array(F.collect_set(F.struct("start", "stop", "origin"))).alias("removed"))
    every = chunks.where("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("file_id").cast("long").alias("file_id"), "content", F.md5("content").alias("class")).dropDuplicates(["chunk_id", "file_id", "class"])
    joined = every.join(later, ["chunk_id", "file_id", "class"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<struct<start:int,stop:int,origin:bigint>>")))

    def part(end, start):
        return F.substring("content", end + 1, F.greatest(start - end, F.lit(0)))

    kept = F.aggregate(
        "removed",
        F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("end")),
        lambda acc, s: F.struct(F.concat(acc["parts"], F.array(part(acc["end"], s["start"]))).alias("parts"), F.greatest(acc["end"], s["stop"]).alias("end")),
        lambda acc: F.concat(F.array_join(acc["parts"], ""), part(acc["end"], F.length("content"))),
    )
    return joined.select("chunk_id", "file_id", "removed", kept.alias("kept"))
