"""Problem 8: mix sources to target shares.

A source's goal is its share of the total size. Whole copies come first, the rest of the goal is a
prefix of the source in a hash order, whose end is found by radix descent on the hash: each level
collects at most 4,096 counts a source. The document at the end that doesn't fit is left out where that
is nearer, and up to ``CLOSING_PASSES`` documents beyond the end, of the sizes nearest to what is
missing, close the rest. Every (source, copy) is a set of hash blocks; a multivariate-hypergeometric splitting tree
divides the exact block quotas of all sources among the output shards, permuted blocks are drawn
without overlap, the heavier first to the shard that lacks most tokens, and each shard is written in
the order of a hash.

The number of shards follows from the size of the mix. Up to ``MOST_GROUPS`` shards the tree is drawn in
the driver; beyond it the driver's tree ends in groups of shards, and each group's task draws the tree
of its own shards over its own blocks.

``outcome`` is told from the mix that was drawn: from the size reached and the most copies of a
document; ``unreached`` says that a mix misses its goal though its source would suffice.

Defined results: sources compare without letter case and outer blanks; documents with null source
are left out; a null text has size 0; a target without documents is ``capped`` (its share can't be
reached) unless its goal is 0; a null share counts as 0, null ``max_repeats`` as 1; documents of
sources without target count in the total only; an empty table gives every goal 0 and ``reduced``;
rows repeated under one ``doc_id`` count each.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.session import materialise

LEVEL_BITS = 12
#: Blocks a shard has on average.
BLOCKS = 256
#: Least shards, and the tokens of a shard beyond which there are more.
SHARDS = 16
SHARD_TOKENS = 1 << 27
MOST_GROUPS = 512
#: Documents beyond the end of a partial copy that may close its rest.
CLOSING_PASSES = 4


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"^\s+|\s+$", ""))


def sized(documents: DataFrame) -> DataFrame:
    """``(doc_id, source, size)``, stored: the texts are read once; sizes in tokens of the byte-level tokenizer."""
    return materialise(documents.where("source IS NOT NULL").select(
        "doc_id", source_key(F.col("source")).alias("source"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")))


def quotas(sizes: DataFrame, targets: DataFrame) -> list[dict]:
    """One entry per target row: goal, outcome, whole copies and the size of the partial copy."""
    want = [(r["source"], float(r["target_share"] or 0.0), int(r["max_repeats"] if r["max_repeats"] is not None else 1))
            for r in targets.select("source", "target_share", "max_repeats").collect()]
    have = sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs"), F.max("size").alias("largest"))
    keys = sorted({(s or "").strip().lower() for s, _, _ in want})
    total = have.agg(F.sum("size")).first()[0] or 0
    known = {r["source"]: (r["size"], r["docs"], r["largest"]) for r in have.where(F.col("source").isin(keys)).collect()}
    out = []
    for source, share, repeats in want:
        key = (source or "").strip().lower()
        size, docs, largest = known.get(key, (0, 0, 0))
        goal = share * total
        outcome = "reduced" if goal <= size else "repeated" if goal <= repeats * size else "capped"
        whole = min(repeats, int(goal // size)) if size else 0
        rest = 0 if outcome == "capped" or not size else goal - whole * size
        out.append({"source": source, "key": key, "share": share, "repeats": repeats, "size": size, "docs": docs, "largest": largest,
                    "total": total, "goal": goal, "outcome": outcome, "whole": whole, "rest": rest if whole < repeats else 0})
    return out


def _hash(seed: int) -> Column:
    """A 48-bit hash of document and source that orders each source at random."""
    return F.xxhash64(F.lit(seed), "source", "doc_id").bitwiseAND(F.lit((1 << 48) - 1))


def cutoffs(sizes: DataFrame, plan: list[dict], seed: int) -> tuple[dict[str, int], dict[str, float]]:
    """For each source the hash below which documents join the partial copy, and the size still missing there."""
    low, left = {}, {}
    for q in plan:
        if q["rest"] > 0:
            low[q["key"]], left[q["key"]] = 0, q["rest"]
    shift = 48
    spark = sizes.sparkSession
    while low and shift > 0:
        shift -= LEVEL_BITS
        at = spark.createDataFrame([(k, v) for k, v in low.items()], "source string, _low long")
        span = 1 << (shift + LEVEL_BITS)
        counts = (sizes.join(F.broadcast(at), "source").withColumn("h", _hash(seed))
                  .where(F.expr(f"h >= _low AND h < _low + {span}"))
                  .groupBy("source", F.shiftright(F.col("h") - F.col("_low"), shift).alias("cell"))
                  .agg(F.sum("size").alias("size")).collect())
        cells: dict[str, list[tuple[int, int]]] = {}
        for r in counts:
            cells.setdefault(r["source"], []).append((r["cell"], r["size"]))
        for key in list(low):
            cell = 0
            for cell, size in sorted(cells.get(key, [])):
                if size > left[key]:
                    break
                left[key] -= size
            else:
                cell += 1
            low[key] += cell << shift
    return low, left


def closing(sizes: DataFrame, edge: dict[str, int], left: dict[str, float], seed: int) -> dict[str, list[int]]:
    """For each source the hashes of documents at or beyond the edge that close what is missing.

    Each pass takes the document whose size is nearest to the rest, unless taking none comes nearer.
    """
    out: dict[str, list[int]] = {k: [] for k in edge}
    open_ = dict(left)
    for _ in range(CLOSING_PASSES):
        if not open_:
            break
        at = sizes.sparkSession.createDataFrame([(k, edge[k], float(v), out[k]) for k, v in open_.items()], "source string, _edge long, _left double, _taken array<long>")
        one = (sizes.join(F.broadcast(at), "source").where("size > 0").withColumn("_h", _hash(seed)).where("_h >= _edge AND NOT array_contains(_taken, _h)")
               .groupBy("source", "_h").agg(F.sum("size").alias("size"), F.first("_left").alias("_left"))
               .groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_left")).alias("off"), F.col("_h").alias("h"), "size")).alias("m")))
        best = {r["source"]: r["m"] for r in one.collect()}
        still = {}
        for key, rest in open_.items():
            m = best.get(key)
            if m is not None and m["off"] < rest:
                out[key].append(m["h"])
                if rest > m["size"]:
                    still[key] = rest - m["size"]
        open_ = still
    return out


def hypergeometric_tree(blocks: list[int], slots: list[int], rng: np.random.Generator) -> np.ndarray:
    """Quota of blocks for each (shard, source): exact row and column sums.

    Recursive halving: the left half's share of each source is one draw without replacement.
    """
    colors = np.array(blocks, dtype=np.int64)
    if len(slots) == 1:
        return colors[None, :]
    mid = len(slots) // 2
    take = int(sum(slots[:mid]))
    left = rng.multivariate_hypergeometric(colors, take, method="marginals") if colors.sum() else colors
    return np.vstack((hypergeometric_tree(left.tolist(), slots[:mid], rng),
                      hypergeometric_tree((colors - left).tolist(), slots[mid:], rng)))


def deal(weights: list[np.ndarray], shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """The shard of every block of every stream: quotas from the tree, permuted blocks, heavy ones first.

    The tree fixes how many blocks of a stream each shard gets; which of the stream's blocks these are is
    open, so the blocks go in falling weight to the shard that lacks most tokens and has quota left.
    """
    counts = [len(w) for w in weights]
    every = sum(counts)
    slots = [every // shards + (k < every % shards) for k in range(shards)]
    quota = hypergeometric_tree(counts, slots, rng) if every else np.zeros((shards, len(counts)), dtype=np.int64)
    out = [np.zeros(c, dtype=np.int64) for c in counts]
    blocks = [(float(w[b]), c, b) for c, w in enumerate(weights) for b in rng.permutation(len(w))]
    blocks.sort(key=lambda x: -x[0])
    load = np.zeros(shards)
    for weight, c, b in blocks:
        shard = int(np.argmin(np.where(quota[:, c] > 0, load, np.inf)))
        out[c][b] = shard
        quota[shard, c] -= 1
        load[shard] += weight
    return out


def mix(sizes: DataFrame, plan: list[dict], seed: int = 17, shards: int | None = None, blocks: int = BLOCKS, most_groups: int = MOST_GROUPS) -> DataFrame:
    """Rows of the mix: ``(doc_id, source, copy, size, shard, shuffle_key)``, partitioned and sorted by shard and key.

    The driver holds one number for each block of a group: at most ``most_groups`` x ``blocks`` and
    one more for each copy of a source.
    """
    spark = sizes.sparkSession
    rng = np.random.default_rng(seed)
    edge, left = cutoffs(sizes, plan, seed)
    last = closing(sizes, edge, left, seed)
    sources = list({q["key"]: q for q in plan}.values())
    tokens = sum(x["whole"] * x["size"] + x["rest"] for x in sources)
    if shards is None:
        shards = max(SHARDS, -(-int(tokens) // SHARD_TOKENS))
    groups, each = (shards, 1) if shards <= most_groups else (most_groups, -(-shards // most_groups))
    copies = []
    for q in sources:
        for copy in range(q["whole"] + (q["rest"] > 0)):
            full = copy < q["whole"]
            weight = q["size"] if full else q["rest"]
            count = min(max(1, round(blocks * groups * weight / max(1, tokens))), blocks * groups)
            copies.append((q["key"], copy, 1 << 48 if full else edge[q["key"]], [] if full else last[q["key"]], count))
    # bounded by sources x repeats
    table = spark.createDataFrame(copies, "source string, copy int, _upto long, _last array<long>, _blocks long")
    place = F.try_divide(F.col("_h").cast("double"), F.col("_upto").cast("double")) * F.col("_blocks")
    rows = (sizes.withColumn("_h", _hash(seed)).join(F.broadcast(table), "source").where("_h < _upto OR array_contains(_last, _h)")
            .withColumn("_block", F.least(F.coalesce(F.floor(place), F.lit(0)), F.col("_blocks") - 1).cast("long")))
    heavy = {(r["source"], r["copy"], r["_block"]): r["w"] for r in rows.groupBy("source", "copy", "_block").agg(F.sum("size").alias("w")).collect()}
    weights = [np.array([heavy.get((key, copy, b), 0) for b in range(count)], dtype=float) for key, copy, _, _, count in copies]
    dealt = deal(weights, groups, rng)
    where = [(key, copy, b, int(g)) for (key, copy, *_), own in zip(copies, dealt, strict=True) for b, g in enumerate(own)]
    drawn = spark.createDataFrame(where, "source string, copy int, _block long, shard int")
    rows = rows.join(F.broadcast(drawn), ["source", "copy", "_block"])
    if each > 1:
        rows = _within_groups(rows, each, seed)
    rows = rows.select("doc_id", "source", "copy", "size", "shard", F.xxhash64(F.lit(seed + 1), "doc_id", "copy").alias("shuffle_key"))
    return rows.repartition("shard").sortWithinPartitions("shard", "shuffle_key", "doc_id")


def _within_groups(rows: DataFrame, each: int, seed: int) -> DataFrame:
    """Split each group's blocks among the ``each`` shards of the group: the same draw, in each group's own task.

    Blocks are divided ``each``-fold first, so a task deals about as many blocks a shard as the driver does.
    """
    keys = ["source", "copy", "_block", "_fine"]
    fine = rows.withColumn("_fine", F.pmod(F.xxhash64(F.lit(seed + 2), "source", "doc_id", "copy"), F.lit(each)).cast("long"))
    sums = fine.groupBy("shard", *keys).agg(F.sum("size").alias("w"))

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        group = int(pdf["shard"].iloc[0])
        pdf = pdf.sort_values(keys, ignore_index=True)
        streams = [g.index.to_numpy() for _, g in pdf.groupby(["source", "copy"], sort=True)]
        weights, out = pdf["w"].to_numpy(dtype=float), np.zeros(len(pdf), dtype=np.int64)
        for index, got in zip(streams, deal([weights[i] for i in streams], each, np.random.default_rng([seed, group])), strict=True):
            out[index] = got
        return pdf[["shard", *keys]].assign(_to=(group * each + out).astype("int32"))

    to = sums.groupBy("shard").applyInPandas(split, "shard int, source string, copy int, _block long, _fine long, _to int")
    return fine.join(to, ["shard", *keys]).drop("shard").withColumnRenamed("_to", "shard")


def report(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """One row per target: goal, the size and share reached, the most copies of a document and the outcome.

    The outcome is told from the mix: one that used every document ``max_repeats`` times and stays below
    the goal is capped; one that holds more than the source, or all of it and wants more, is repeated; any
    other is reduced. A mix may miss its goal by its source's largest document, else it is ``unreached``.
    """
    spark = mixed.sparkSession
    rows = [(q["source"], q["key"], q["share"], q["repeats"], q["size"], q["goal"], q["largest"]) for q in plan]
    want = spark.createDataFrame(rows, "source string, _key string, target_share double, max_repeats int, source_size long, goal double, _largest long")
    got = mixed.groupBy(F.col("source").alias("_key")).agg(F.sum("size").alias("reached"), (F.max("copy") + 1).alias("most_copies"))
    out = want.join(got, "_key", "left").fillna({"reached": 0, "most_copies": 0})
    full = F.col("source_size") * F.col("max_repeats")
    near = F.abs(F.col("reached") - F.col("goal")) <= F.col("_largest")
    outcome = (F.when((F.col("reached") == full) & (F.col("goal") > full), "capped").when(~near, "unreached")
               .when((F.col("reached") > F.col("source_size")) | (F.col("goal") > F.col("source_size")), "repeated").otherwise("reduced"))
    # one row per target: the window is as small as the list of targets; a source listed twice counts once
    first = F.row_number().over(Window.partitionBy("_key").orderBy("source")) == 1
    out = out.withColumn("outcome", outcome).withColumn("_one", F.when(first, F.col("reached")).otherwise(0))
    mix_size = F.sum("_one").over(Window.partitionBy())
    return out.withColumn("actual_share", F.round(F.try_divide(F.col("reached").cast("double"), mix_size.cast("double")), 6)).drop("_one", "_key", "_largest")


def stored_report(mixed: DataFrame, plan: list[dict]) -> DataFrame:
    """The report on a mix that is written shard by shard in its shuffled order, so no part of it is left out."""
    return report(materialise(mixed), plan)


def found(reported: DataFrame) -> DataFrame:
    return reported.select("source", "outcome")
