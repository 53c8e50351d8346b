"""Filling fixed-capacity containers: vector bin packing by the dot-product heuristic.

An item has a size in every limited dimension: its tokens, one segment, and its loss-bearing tokens, which are its last ones (an answer
behind its prompt; by default all but the first token, which nothing predicts).  Containers are filled one after the other: among the
items that still fit, the one whose sizes have the largest dot product with the room left goes in, each dimension weighted by how
scarce it is overall.  Items of equal sizes are interchangeable, so a step looks at distinct sizes, not at items.

Items are spread over groups of about ``GROUP_ITEMS`` by a hash of their row; a group fills containers of its own.  The group
size is a constant, so a task's memory does not grow with the corpus, and the room lost to the one half-filled last container
of a group stays below a thousandth.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codequarry.plans.workspace import materialised, spread

CAPACITY = 2048
#: Most pieces in one container; bounds the attention mask's segments.
SEGMENTS = 256
GROUP_ITEMS = 8192


def pieces_of(tokens: int, capacity: int, loss: int | None = None, loss_capacity: int | None = None) -> list[tuple[int, int]]:
    """(tokens, loss-bearing tokens) of the pieces of one item, each as large as the limits allow.

    Only an item that exceeds a limit by itself has more than one piece; an item without tokens is one piece of 0.
    """
    loss = max(tokens - 1, 0) if loss is None else min(loss, tokens)
    loss_capacity = capacity if loss_capacity is None else loss_capacity
    out: list[tuple[int, int]] = []
    free = tokens - loss  # tokens before the first that bears loss
    while tokens > capacity or loss > loss_capacity:
        size = min(capacity, free + loss_capacity)
        bears = max(0, size - free)
        out.append((size, bears))
        tokens, loss, free = tokens - size, loss - bears, max(0, free - size)
    return [*out, (tokens, loss)] if tokens or not out else out


def pack(sizes: np.ndarray, loss: np.ndarray, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None) -> np.ndarray:
    """The container number (from 0) of each piece.

    Every piece is a segment, those without tokens too.  No container exceeds any limit.
    """
    loss_capacity = capacity if loss_capacity is None else loss_capacity
    out = np.zeros(len(sizes), np.int64)
    kinds: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i, kind in enumerate(zip(sizes.tolist(), loss.tolist(), strict=True)):
        kinds[kind].append(i)
    if not kinds:
        return out
    types = np.array(sorted(kinds, reverse=True), np.int64)
    left = np.array([len(kinds[tuple(t)]) for t in types.tolist()], np.int64)
    limits = np.array([capacity, segments, loss_capacity], np.float64)
    vectors = np.column_stack([types[:, 0], np.ones(len(types), np.int64), types[:, 1]])
    scarce = (vectors * left[:, None]).sum(0) / limits  # containers needed for this dimension alone
    weight = scarce / scarce.sum() / limits**2
    room, container, fresh = limits.copy(), 0, True
    alive = np.arange(len(types))
    while len(alive):
        fits = alive[(vectors[alive] <= room).all(1)]
        if not len(fits):
            if fresh:
                raise ValueError("a piece exceeds a limit on its own")
            room, container, fresh = limits.copy(), container + 1, True
            continue
        best = fits[np.argmax((vectors[fits] * (room * weight)).sum(1))]
        out[kinds[tuple(types[best].tolist())].pop()] = container
        room -= vectors[best]
        fresh = False
        left[best] -= 1
        if not left[best]:
            alive = alive[alive != best]
        if len(alive) and (room[1] < 1 or (room[0] < 1 and types[alive[-1], 0] > 0)):
            room, container, fresh = limits.copy(), container + 1, True
    return out


def fill(
    items: DataFrame, key: str = "doc_id", tokens: str = "tokens", capacity: int = CAPACITY, segments: int = SEGMENTS, group_items: int = GROUP_ITEMS,
    loss: str | None = None, loss_capacity: int | None = None,
) -> DataFrame:
    """(container, key, piece, tokens, loss): every item in a container, in pieces (from 0) only if it exceeds a limit by itself.

    ``loss`` names the column of loss-bearing tokens; without it all tokens but an item's first bear loss.  A container is named by
    group and number.  Pieces that fill a container with tokens are containers of their own and never enter a group.  Null sizes count
    as 0, a loss above the size as the size.  Repeated and null keys are separate items.
    """
    kind = items.schema[key].dataType.simpleString()
    size = F.coalesce(F.col(tokens), F.lit(0)).cast("long")
    bears = F.greatest(size - 1, F.lit(0)) if loss is None else F.least(F.coalesce(F.col(loss), F.lit(0)).cast("long"), size)
    # the rows are numbered in a written table, so that a task that is run again gives a row the same number
    rows = materialised(items.select(F.col(key), size.alias("_size"), bears.cast("long").alias("_loss")), "items").withColumn("_row", F.monotonically_increasing_id())
    groups = max(1, round(rows.count() / group_items))
    most = capacity if loss_capacity is None else loss_capacity

    def cut(parts: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for part in parts:
            found = [pieces_of(n, capacity, b, most) for n, b in zip(part["_size"].tolist(), part["_loss"].tolist(), strict=True)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            out = part.loc[part.index.repeat(counts), ["_row", key]].reset_index(drop=True)
            out["piece"] = np.concatenate([np.arange(n) for n in counts]) if len(counts) else np.zeros(0, np.int64)
            out["tokens"] = [n for pieces in found for n, _ in pieces]
            out["loss"] = [b for pieces in found for _, b in pieces]
            yield out

    whole = (F.col("_size") <= capacity) & (F.col("_loss") <= most)
    single = rows.where(whole).select("_row", key, F.lit(0).alias("piece"), F.col("_size").alias("tokens"), F.col("_loss").alias("loss"))
    pieces = single.unionByName(rows.where(~whole).mapInPandas(cut, f"_row long, `{key}` {kind}, piece int, tokens long, loss long"))
    alone = F.col("tokens") == capacity
    full = pieces.where(alone).select(F.concat(F.lit("f-"), F.col("_row").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"), key, "piece", "tokens", "loss")
    loose = pieces.where(~alone).withColumn("_group", F.pmod(F.xxhash64("_row", "piece"), F.lit(groups)).cast("int"))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_row", "piece"], kind="stable")
        number = pack(rows["tokens"].to_numpy(np.int64), rows["loss"].to_numpy(np.int64), capacity, segments, most)
        name = rows["_group"].astype(str) + "-" + pd.Series(number, rows.index).astype(str)
        return pd.DataFrame({"container": name, key: rows[key], "piece": rows["piece"], "tokens": rows["tokens"], "loss": rows["loss"]})

    packed = spread(loose, "_group").groupBy("_group").applyInPandas(group, f"container string, `{key}` {kind}, piece int, tokens long, loss long")
    return full.unionByName(packed)


def unused(sizes: Iterable[int], containers: int, capacity: int = CAPACITY) -> float:
    """The share of all containers' room that no token fills."""
    return 1 - sum(sizes) / (containers * capacity) if containers else 0.0


def pack_report(packed: DataFrame, capacity: int = CAPACITY, segments: int = SEGMENTS, loss_capacity: int | None = None) -> DataFrame:
    """(containers, tokens, unused_share, full_tokens, full_segments, full_loss) of a result of ``fill``.

    The last three count the containers that a limit has closed: no further token, segment or loss-bearing token fits.
    """
    most = capacity if loss_capacity is None else loss_capacity
    each = packed.groupBy("container").agg(F.sum("tokens").alias("t"), F.count("*").alias("s"), F.sum("loss").alias("b"))
    n = F.count("*")
    return each.agg(
        n.alias("containers"), F.sum("t").alias("tokens"), F.round(1 - F.sum("t") / (n * capacity), 6).alias("unused_share"),
        F.count_if(F.col("t") >= capacity).alias("full_tokens"), F.count_if(F.col("s") >= segments).alias("full_segments"), F.count_if(F.col("b") >= most).alias("full_loss"),
    )
