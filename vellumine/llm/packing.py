"""Problem 7: fill containers of fixed capacity, tier by tier.

Documents are routed to context-size tiers (an eighth, a quarter, a half and the whole of the
capacity). From the longest tier down, a tier's items first fill the gaps of the longer windows,
best fit first, then open windows of their own size; windows are laid into containers in falling
size, so none crosses a container's end. Containers are dealt to step groups back and forth, so that no
group gets the fuller one of every turn.

Only the histogram of sizes (at most ``capacity`` rows) reaches the driver. The plan it makes has a
size bounded by the capacity, not by the data; each item finds its window from its rank within its
size.

Defined results: null and empty texts take no space and have no placement; a document larger than
the capacity is cut into full containers and one rest, any other document is whole; repeated
``doc_id`` values are packed once for each row; extra columns aren't read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumine.session import global_index

CAPACITY = 4096
STEP_CONTAINERS = 64


def tiers(capacity: int) -> list[int]:
    """Window sizes, longest first; each divides the one before."""
    out = [capacity]
    while len(out) < 4 and out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple], dict[int, int], list[tuple]]:
    """From size counts: slots, windows of each tier, and (tier, base, count, free) of the patterns.

    A slot ``(size, rank_from, rank_to, tier, window, copies, offset)`` says that the items of
    that size with these ranks go, ``copies`` to a window, into windows from ``window`` on.
    """
    levels = tiers(capacity)
    # an open pattern: [tier, first window, number of windows, free space]
    free: dict[int, list[list[int]]] = {}
    spaces: list[int] = []  # sorted keys of free
    windows = dict.fromkeys(levels, 0)
    slots: list[tuple] = []
    closed: list[list[int]] = []

    def put(pattern: list[int]) -> None:
        room = pattern[3]
        if room <= 0:
            closed.append(pattern)
        elif room in free:
            free[room].append(pattern)
        else:
            free[room] = [pattern]
            bisect.insort(spaces, room)

    def take(room: int) -> list[int]:
        pattern = free[room].pop()
        if not free[room]:
            del free[room]
            spaces.pop(bisect.bisect_left(spaces, room))
        return pattern

    for level, tier in enumerate(levels):
        low = levels[level + 1] if level + 1 < len(levels) else 0
        for size in range(tier, low, -1):
            left, rank = histogram.get(size, 0), 0
            while left:
                k = bisect.bisect_left(spaces, size)
                if k < len(spaces):  # the smallest gap that holds it
                    t, base, count, room = take(spaces[k])
                    copies = min(room // size, max(1, left // count))
                    used = min(count, left // copies)
                    if used < count:
                        put([t, base + used, count - used, room])
                else:
                    t, room = tier, tier
                    copies = min(room // size, left)
                    used = left // copies
                    base = windows[t]
                    windows[t] += used
                slots.append((size, rank, rank + used * copies, t, base, copies, t - room))
                put([t, base, used, room - copies * size])
                rank += used * copies
                left -= used * copies
    for patterns in free.values():
        closed.extend(patterns)
    return slots, windows, [tuple(p) for p in closed]


def sized(documents: DataFrame) -> DataFrame:
    """``(doc_id, size)`` in tokens of the byte-level tokenizer: one token per UTF-8 byte."""
    return documents.select("doc_id", F.octet_length("text").cast("long").alias("size"))


def pack(documents: DataFrame, capacity: int = CAPACITY, step_containers: int = STEP_CONTAINERS) -> DataFrame:
    """Placements ``(doc_id, piece, doc_offset, size, container, container_offset, tier, step)``.

    ``documents`` has ``doc_id`` and ``size``.
    """
    spark = documents.sparkSession
    whole = documents.select("doc_id", "size").where("size > 0")
    parts = whole.select(
        "doc_id",
        F.posexplode(F.sequence(F.lit(0).cast("long"), F.expr(f"(size - 1) div {capacity}"))).alias("piece", "_k"),
        F.col("size").alias("_all"),
    ).select(
        "doc_id", "piece",
        (F.col("_k") * capacity).alias("doc_offset"),
        F.least(F.lit(capacity).cast("long"), F.col("_all") - F.col("_k") * capacity).cast("int").alias("size"),
    )
    ranked = global_index(parts, ["size", "doc_id", "piece", "doc_offset"], "rank")
    histogram = {r["size"]: r["n"] for r in ranked.groupBy("size").agg(F.count("*").alias("n")).collect()}
    slots, windows, _ = plan(histogram, capacity)
    starts, at = {}, 0
    for size in sorted(histogram):
        starts[size] = at
        at += histogram[size]
    bases, tokens = {}, 0
    for tier in tiers(capacity):  # falling sizes: no window crosses a container's end
        bases[tier] = tokens
        tokens += windows[tier] * tier
    steps = max(1, -(-(-(-tokens // capacity)) // step_containers))
    # slots in the order of the global rank, which they cover without gaps
    rows = sorted((starts[s] + a, bases[t] + w * t, c, o, t) for s, a, b, t, w, c, o in slots)
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(table)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each item's slot by binary search: no join multiplies a size that very many items share."""
        plan_ = shared.value
        for pdf in batches:
            rank = pdf.pop("rank").to_numpy()
            at = plan_[np.searchsorted(plan_[:, 0], rank, side="right") - 1]
            k = rank - at[:, 0]
            token = at[:, 1] + k // at[:, 2] * at[:, 4] + at[:, 3] + k % at[:, 2] * pdf["size"].to_numpy()
            turn, place_ = np.divmod(token // capacity, steps)  # containers lie in falling fill: back and forth over the steps
            step = np.where(turn % 2 == 0, place_, steps - 1 - place_)
            yield pdf.assign(container=token // capacity, container_offset=token % capacity, tier=at[:, 4], step=step)

    schema = "doc_id long, piece int, doc_offset long, size int, container long, container_offset int, tier int, step long"
    return ranked.select("doc_id", "piece", "doc_offset", "size", "rank").mapInPandas(place, schema)


def found(placements: DataFrame) -> DataFrame:
    """Documents that had to be cut: those with a second piece."""
    return placements.where("piece = 1").select("doc_id")


def containers(placements: DataFrame) -> DataFrame:
    """Fill of each container."""
    return placements.groupBy("container", "step").agg(
        F.count("*").alias("items"), F.sum("size").alias("used"))


def fill_report(placements: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, fill and the balance of the step groups, as one row."""
    steps = placements.groupBy("step").agg(F.sum("size").alias("tokens"), F.countDistinct("container").alias("n"))
    return steps.agg(
        F.sum("n").alias("containers"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (F.sum("n") * capacity), 6).alias("fill"),
        F.count("*").alias("steps"), F.max("tokens").alias("largest_step"), F.min("tokens").alias("smallest_step"))
