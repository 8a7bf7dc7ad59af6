"""Mixing of sources to target weights, with exact block quotas for every output shard."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from foliant.llm.scratch import Scratch

#: A mix over more sources than this is refused: one row of seven numbers for each lies on the driver and in a broadcast.
MAX_SOURCES = 1_000_000
#: Text bytes of a shard, blocks that it is dealt, and shards that a task writes where there are many.
SHARD_BYTES, SHARD_BLOCKS, TASK_SHARDS = 32 << 20, 16, 8
#: Up to this many dealt blocks (some 50 bytes each) are broadcast; more are joined by source and block.
BROADCAST_BLOCKS = 200_000
#: Nodes of the splitting tree down to which the driver descends; executors go on from there.
DRIVER_NODES = 256
#: Bits of a place that each step towards a source's stop looks at, and steps.
_STEP_BITS, _STEPS = 8, 3
#: Bits of a place from which its block comes.
_BLOCK_BITS = 31


def source_targets(sizes: Sequence[int], weights: Sequence[float], cap: float = 3.0) -> list[float]:
    """Targets that share sum(sizes) by weight, none above cap times its own size.

    Sources reach their cap in the order of cap * size / weight. What they
    leave is shared by weight among the others, so one sort tells which
    sources are at their cap.
    """
    size, weight = np.asarray(sizes, float), np.asarray(weights, float)
    if not len(size):
        return []
    level = cap * size / weight
    order = np.argsort(level, kind="stable")
    capped = np.concatenate([[0.0], np.cumsum(cap * size[order])])
    used = np.concatenate([[0.0], np.cumsum(weight[order])])
    with np.errstate(divide="ignore", invalid="ignore"):
        share = (size.sum() - capped[:-1]) / (weight.sum() - used[:-1])  # words for a unit of weight after k caps
    fits = np.flatnonzero(share <= level[order])
    targets = cap * size
    if len(fits):
        free = order[fits[0] :]
        targets[free] = share[fits[0]] * weight[free]
    return targets.tolist()


def descend(first: int, last: int, node: int, sources: np.ndarray, counts: np.ndarray, starts: np.ndarray, width: int, seed: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """The nodes of at most ``width`` shards below a node of the splitting tree over shards first to last - 1.

    A node holds ``counts`` blocks of each of ``sources``, numbered from
    ``starts`` on in the source's order of draws. Its left part gets a
    multivariate hypergeometric draw of them, in proportion to its shards, so
    every shard gets what dealing from one well-shuffled deck would give it,
    and the parts' blocks are disjoint. Only sources with blocks are carried.
    """
    stack = [(first, last, node, sources, counts, starts)]
    while stack:
        lo, hi, node, sources, counts, starts = stack.pop()
        if hi - lo <= width:
            yield lo, hi, node, sources, counts, starts
            continue
        mid = (lo + hi) // 2
        want = int(counts.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.Generator(np.random.PCG64([seed, node]))
        left = rng.multivariate_hypergeometric(counts, want, method="marginals") if len(counts) else counts
        right = counts - left
        stack.append((lo, mid, 2 * node, sources[left > 0], left[left > 0], starts[left > 0]))
        stack.append((mid, hi, 2 * node + 1, sources[right > 0], right[right > 0], (starts + left)[right > 0]))


def _deal(seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Goes on from the driver's nodes to single shards; a row for each dealt block."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples():
                keys, blocks, quotas, stops = (np.asarray(x, np.int64) for x in (r.keys, r.blocks, r.quotas, r.stops))
                own = np.arange(len(keys))
                for shard, _, _, which, counts, starts in descend(r.first, r.last, r.node, own, np.asarray(r.counts, np.int64), np.asarray(r.starts, np.int64), 1, seed):
                    source = np.repeat(which, counts)
                    draw = np.arange(len(source)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
                    final = (draw == quotas[source] - 1) & (stops[source] >= 0)
                    yield pd.DataFrame({"skey": keys[source], "block": draw % blocks[source], "epoch": draw // blocks[source], "shard": shard, "stop": np.where(final, stops[source], np.iinfo(np.int64).max)})

    return run


def dealt_blocks(spark: SparkSession, plan: pd.DataFrame, shards: int, seed: int) -> DataFrame:
    """(skey, block, epoch, shard, stop), one row for each block that a shard is dealt; of a source's last block only places up to stop count.

    plan: a row for each source with skey, blocks, quota (blocks to deal) and
    stop (-1: the last block is dealt whole). Draw j of a source is block
    j % blocks in epoch j // blocks.
    """
    own = plan[plan["quota"] > 0]
    keys, blocks, quotas, stops = (own[c].to_numpy(np.int64) for c in ("skey", "blocks", "quota", "stop"))
    rows = []
    for first, last, node, which, counts, starts in descend(0, shards, 1, np.arange(len(own)), quotas, np.zeros(len(own), np.int64), -(-shards // DRIVER_NODES), seed):
        if len(which):
            rows.append((first, last, node, *(x.tolist() for x in (keys[which], blocks[which], quotas[which], stops[which], counts, starts))))
    schema = "first long, last long, node long, " + ", ".join(f"{c} array<long>" for c in ("keys", "blocks", "quotas", "stops", "counts", "starts"))
    nodes = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 64)), "node")
    return nodes.mapInPandas(_deal(seed), "skey long, block long, epoch long, shard long, stop long")


def _plan(df: DataFrame, weights: Sequence[float], cap: float, shards: int | None, blocks: int | None, seed: int, id_col: str, text_col: str, source_col: str, carry: list[str] | None) -> tuple[DataFrame, int]:
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    extra = [F.struct(*carry).alias("row")] if carry else []
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    place = F.xxhash64(F.lit(seed), F.col(id_col), text).bitwiseAND(F.lit(2**63 - 1))
    # A null source has a key of its own, told apart from every text by its second argument.
    skey = F.xxhash64(F.lit(seed), F.col(source_col).isNull(), F.coalesce(F.col(source_col), F.lit("")))
    work = df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), skey.alias("skey"), size.alias("size"), place.alias("place"), F.octet_length(text).alias("bytes"), *extra)
    kept = scratch.save(work.drop("row"))  # the texts' only reading, but for carry's

    found = kept.groupBy("skey", "source").agg(F.sum("size").alias("size"), F.sum("bytes").alias("bytes")).limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if len({r.skey for r in found}) < len(found):
        raise ValueError("two sources share a 64-bit key; choose another seed")
    found = sorted(found, key=lambda r: (r.source is None, r.source or ""))
    sizes = np.array([r.size for r in found], np.int64)
    total = int(sizes.sum())
    shards = shards or max(1, math.ceil(sum(r.bytes for r in found) / SHARD_BYTES))
    blocks = blocks or shards * SHARD_BLOCKS
    plan = pd.DataFrame({"skey": np.array([r.skey for r in found], np.int64), "size": sizes})
    plan["target"] = np.array(source_targets(sizes.tolist(), [weights[i % len(weights)] for i in range(len(found))], cap), float)
    some = np.maximum(sizes, 1)
    plan["full"] = np.where(sizes > 0, np.floor(plan["target"] / some + 1e-12), 0).astype(np.int64)
    plan["rest"] = np.where(sizes > 0, np.maximum(plan["target"] - plan["full"] * sizes, 0.0), 0.0)
    plan["blocks"] = np.maximum(1, np.round(blocks * (sizes / max(total, 1)))).astype(np.int64)
    stops = _stops(spark, kept, plan, scratch)
    plan["stop"] = [stops.get(k, -1) for k in plan["skey"].tolist()]
    partial = (plan["stop"].to_numpy() >= 0).astype(np.int64)
    last = ((plan["stop"].clip(lower=0) // 2 ** (63 - _BLOCK_BITS)) * plan["blocks"]) // 2**_BLOCK_BITS
    plan["quota"] = np.where(sizes > 0, plan["full"] * plan["blocks"] + partial * (last + 1), 0)

    dealt = scratch.save(dealt_blocks(spark, plan, shards, seed).groupBy("skey", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard", "stop"))).alias("deals")))  # cap at most
    table = spark.createDataFrame(plan[["skey", "size", "target", "blocks"]].rename(columns={"size": "source_size"}), "skey long, source_size long, target double, blocks long")
    joined = (work if carry else kept).join(F.broadcast(table), "skey").withColumn("block", _block(F.col("place"), F.col("blocks")))
    small = int(plan["quota"].sum()) <= BROADCAST_BLOCKS
    joined = joined.join(F.broadcast(dealt) if small else dealt, ["skey", "block"], "left")
    drawn = F.filter(F.coalesce("deals", F.expr("CAST(array() AS array<struct<epoch: bigint, shard: bigint, stop: bigint>>)")), lambda d: (F.col("size") > 0) & (F.col("place") <= d["stop"]))
    drawn = F.transform(drawn, lambda d: F.struct(d["epoch"].alias("epoch"), d["shard"].alias("shard"), F.xxhash64(F.lit(seed), d["epoch"], F.col("place")).alias("place")))
    joined = joined.withColumn("draws", drawn)
    taken = (F.col("size") * F.size("draws")).alias("taken")
    return joined.select("doc_id", "source", "size", "source_size", "target", taken, "draws", "place", "block", *(["row"] if carry else [])), shards


def _block(place: Column, blocks: Column) -> Column:
    """The block of a place, by its high bits."""
    return F.shiftright(F.shiftright(place, 63 - _BLOCK_BITS) * blocks, _BLOCK_BITS)


def _stops(spark: SparkSession, kept: DataFrame, plan: pd.DataFrame, scratch: Scratch) -> dict[int, int]:
    """For each source that gives part of its words once more (rest): the last place of that part, nearest to rest.

    Places are cut into 2 ** _STEP_BITS ranges; sums over them tell in which
    the stop lies, and the next step cuts that one. So a window sees at most
    that many rows of a source, whatever its share, and the last step the rows
    of one range of 2 ** (_STEP_BITS * _STEPS).
    """
    open_ = plan[plan["rest"] > 0]
    if not len(open_):
        return {}
    at = spark.createDataFrame(pd.DataFrame({"skey": open_["skey"], "rest": open_["rest"], "base": 0.0, "range": 0}), "skey long, rest double, base double, range long")
    for step in range(_STEPS):
        inner = _high("place", _STEP_BITS * (step + 1))
        some = kept.join(F.broadcast(at), "skey").where(_high("place", _STEP_BITS * step) == F.col("range"))
        some = some.groupBy("skey", "rest", "base", inner.alias("inner")).agg(F.sum("size").alias("n")).where("n > 0")
        some = some.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("skey").orderBy("inner")))
        some = some.where("upto - n <= rest AND rest < upto")
        at = scratch.save(some.select("skey", "rest", (F.col("upto") - F.col("n")).alias("base"), F.col("inner").alias("range")))
    rows = kept.join(F.broadcast(at), "skey").where(_high("place", _STEP_BITS * _STEPS) == F.col("range"))
    rows = rows.groupBy("skey", "rest", "base", "range", "place").agg(F.sum("size").alias("n"))
    rows = rows.withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("skey").orderBy("place")))
    before = F.first(F.shiftleft("range", 63 - _STEP_BITS * _STEPS)) - 1
    nearest = F.max(F.when(F.col("upto") - F.col("n") / 2.0 <= F.col("rest"), F.col("place")))
    return {r.skey: r.stop for r in rows.groupBy("skey").agg(F.coalesce(nearest, before).alias("stop")).collect()}


def _high(column: str, bits: int) -> Column:
    return F.shiftright(column, 63 - bits) if bits else F.lit(0).cast("long")


def plan_mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, shards: int | None = None, blocks: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, draws (epoch, shard, place), place and block.

    Sources in order of code points, null last, take the weights in turn.
    Every source's rows are permuted by a seeded hash and cut into blocks of
    about the same number of words. A source whose target is r times its size
    gives all its blocks floor(r) times and then those at the front of the
    permutation, up to the row that brings the words nearest to the target.
    A splitting tree deals these block quotas out to the shards, exactly and
    disjoint within an epoch; a row is drawn once for every shard that was
    dealt its block, and ``taken`` counts just these draws. By default there
    is a shard for each SHARD_BYTES of text and SHARD_BLOCKS blocks for each
    shard; no number of epochs is fixed.

    Rows aren't moved. A source of any share costs no more than its rows: its
    stop comes from sums over hash ranges, its blocks are spread by the hash,
    and the tree is split between the driver (its top, DRIVER_NODES nodes) and
    executors. The driver and a broadcast hold a row of numbers for each
    source, MAX_SOURCES at most; dealt blocks are broadcast up to
    BROADCAST_BLOCKS and joined by source and block above.

    Repeated rows (same id, source and text) are drawn together. A null or
    empty text has size 0 and takes 0; a source without words has target 0; a
    null id is an id like others. ``carry`` names columns to return in the
    struct ``row``; others aren't read. An empty table gives no rows. Reruns
    give the same draws.
    """
    return _plan(df, weights, cap, shards, blocks, seed, id_col, text_col, source_col, carry)[0]


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, shards: int | None = None, blocks: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: list[str] | None = None) -> DataFrame:
    """The mix itself: each drawn row once per draw, with doc_id, epoch, shard and ``row``; shards lie together, shuffled within.

    Options, nulls, repeats and empty tables are as in plan_mix; rows without
    words aren't drawn. Each drawn row is moved once, to its shard's task; a
    task holds TASK_SHARDS shards or, with few, less.
    """
    planned, shards = _plan(df, weights, cap, shards, blocks, seed, id_col, text_col, source_col, carry or df.columns)
    drawn = planned.select("doc_id", F.explode("draws").alias("draw"), "row")
    drawn = drawn.select("doc_id", F.col("draw.epoch").alias("epoch"), F.col("draw.shard").alias("shard"), F.col("draw.place").alias("place"), "row")
    tasks = max(-(-shards // TASK_SHARDS), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return drawn.repartition(tasks, "shard").sortWithinPartitions("shard", "place").drop("place")
