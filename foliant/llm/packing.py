"""Packing of token sequences into windows, with certified bin counts."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm import kernels
from foliant.llm.scratch import Scratch, release, small_batches
from foliant.llm.token_counts import vocabulary

#: Members of the rounding family that lower_bound tries.
ROUNDINGS = 32
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Cutter:
    """Cuts the ids of one text after another into pieces, holding less than one piece."""

    def __init__(self, window: int, end_id: int):
        self.window, self.end_id = window, end_id
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.open(-1)

    def open(self, text: int) -> None:
        self.text, self.piece, self.start = text, 0, 0
        self.held = np.zeros(0, np.uint32)

    def put(self, ids: np.ndarray) -> None:
        ids = np.concatenate([self.held, ids]) if len(self.held) else ids
        while len(ids) > self.window:
            self.emit(ids[: self.window])
            ids = ids[self.window :]
        self.held = ids

    def emit(self, ids: np.ndarray) -> None:
        self.rows.append((self.text, self.piece, self.start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())))
        self.piece += 1
        self.start += len(ids)

    def close(self) -> None:
        self.put(np.array([self.end_id], np.uint32))
        self.emit(self.held)

    def take(self) -> list[np.ndarray]:
        columns = np.array(self.rows, np.int64).reshape(-1, 5).T
        self.rows = []
        return list(columns)


def _pieces(path: str, window: int, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        vocab = vocabulary(path, ids=True)
        for batch in batches:
            buf, offsets = kernels.buffers(batch.column(1))
            cutter, done = _Cutter(window, end_id), 0

            def move(text: int) -> None:
                """Close the open text, and every empty one before ``text``."""
                nonlocal done
                while done < text:
                    if cutter.text != done:
                        cutter.open(done)
                    cutter.close()
                    done += 1

            if vocab.splits:
                for starts, ends, texts in kernels.parts(buf, offsets):
                    n, at = vocab.look_up(buf, starts, ends)
                    out = np.cumsum(n)
                    ids = vocab.pool[np.repeat(at - (out - n), n) + np.arange(out[-1] if len(out) else 0)].astype(np.uint32)
                    heads = np.flatnonzero(np.diff(texts, prepend=-1))
                    bounds = np.append((out - n)[heads], len(ids)).tolist()
                    for k, text in enumerate(texts[heads].tolist()):
                        move(text)
                        if cutter.text != text:
                            cutter.open(text)
                        cutter.put(ids[bounds[k] : bounds[k + 1]])
            else:
                for text in range(batch.num_rows):
                    move(text)
                    cutter.open(text)
                    cutter.put(np.array(vocab.whole([buf[offsets[text] : offsets[text + 1]].tobytes().decode("utf-8", "replace")])[0], np.uint32))
            move(batch.num_rows)
            text, piece, start, length, crc = cutter.take()
            out = pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(text)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"]
            )
            del buf, offsets, cutter, move, batch
            release()
            yield out

    return cut


def lower_bound(lengths: np.ndarray, window: int) -> int:
    """Bins that any packing needs: the best of a family of dual-feasible functions.

    For a threshold t up to half the window the function gives 1 to lengths
    over window - t, length / window to those from t on, and 0 below; its sum,
    rounded up, bounds the bins from below. A second family rounds: for k it
    gives length / window where k + 1 of them fill whole windows, and else the
    whole windows that k + 1 of them fill, over k.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=window + 1).astype(np.int64)
    t = np.arange(window // 2 + 1)
    number = np.cumsum(count)
    mass = np.cumsum(count * np.arange(window + 1))
    large = number[window] - number[window - t]
    middle = mass[window - t] - np.where(t > 0, mass[np.maximum(t - 1, 0)], 0)
    sizes = np.arange(window + 1)
    best = int(np.max(large + -(-middle // window)))
    for k in range(1, ROUNDINGS + 1):
        whole, rest = np.divmod((k + 1) * sizes, window)
        best = max(best, -(-int(count @ np.where(rest == 0, k * sizes, window * whole)) // (k * window)))
    return best


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset in it, room left in each bin): each length goes to the fullest bin that holds it.

    Bins lie in stacks by the room left, and a bit mask over the stacks finds
    the least room that is enough, so a length costs the same however many bins.
    """
    n = len(lengths)
    place, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    stacks: list[list[int]] = [[] for _ in range(window + 1)]
    mask, room = 0, []
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        above = mask >> size
        if above:
            left = size + ((above & -above).bit_length() - 1)
            b = stacks[left].pop()
            if not stacks[left]:
                mask ^= 1 << left
        else:
            left, b = window, len(room)
            room.append(window)
        place[i], offset[i] = b, window - left
        left -= size
        room[b] = left
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(b)
    return place, offset, np.array(room, np.int64)


def _pack(window: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs a partition. One above its bound gives the looser half of its bins with room free, unless this is the last round."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        lengths = part["length"].to_numpy()
        place, offset, room = best_fit_decreasing(lengths, window)
        if part["came"].notna().all():
            _, held = np.unique(part["came"].to_numpy(), return_inverse=True)
            if len(room) > held.max():
                place, offset = held, part["offset"].to_numpy()
                room = window - np.bincount(held, lengths).astype(np.int64)
        least = lower_bound(lengths, window)
        give = np.zeros(len(room), bool)
        if len(room) > least and not last:
            give[np.argsort(-room, kind="stable")[: -(-np.count_nonzero(room) // 2)]] = True
        loose = give[place]
        return part.assign(bin=place, offset=offset, settled=~loose, bins=np.int64(len(room)), bound=np.int64(least))

    return run


def pack(df: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", per_partition: int = 20_000, rounds: int = 3) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and the partition's bins and bound.

    Each text's ids are those of the tokenizers file at ``tokenizer``, without
    special tokens, then ``end_id``. Only texts over ``window`` ids are cut.
    Pieces are dealt at random into partitions of about ``per_partition``;
    each packs its own by best-fit decreasing and compares its bins with a
    lower bound. A partition at its bound is settled for good. One above it
    gives the looser half of its bins with room free to an exchange and settles
    the others: whole bins are dealt anew among fewer partitions and their
    pieces packed again, ``rounds`` times at most. Where that takes as many bins as came or more, the bins stay
    as they came, so an exchange never costs a bin. A partition alone has none
    to exchange with. A partition's memory follows per_partition.

    A null or empty text is the end_id alone. Null ids stay null and repeated
    rows are packed each by itself; ties go by the order of arrival. Columns
    that aren't named aren't read. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "pack")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = rows.mapInArrow(_pieces(tokenizer, window, end_id), PIECES).withColumn("row", F.monotonically_increasing_id())
    # pandas holds whole numbers among nulls as doubles, so an id goes there as a number and a flag.
    cut = cut.withColumn("known", F.col("doc_id").isNotNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0)))
    with small_batches(df.sparkSession):
        open_rows = scratch.save(cut.withColumn("came", F.lit(None).cast("long")).withColumn("offset", F.lit(None).cast("long")))
    schema = f"{PIECES}, row long, known boolean, came long, offset long, part long, bin long, settled boolean, bins long, bound long"
    settled = None
    for k in range(rounds):
        n = open_rows.count()
        if not n:
            break
        parts = max(1, math.ceil(n / per_partition))
        last = k == rounds - 1 or parts == 1
        dealt = open_rows.withColumn("part", F.pmod(F.xxhash64(F.coalesce("came", "row"), F.lit(k)), F.lit(parts)))
        packed = scratch.save(dealt.groupBy("part").applyInPandas(_pack(window, last), schema))
        done = packed.where("settled").withColumn("sequence_id", F.lit(k) * F.lit(2**56) + F.col("part") * F.lit(2**28) + F.col("bin"))
        done = done.select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", F.lit(k).alias("round"), "part", "bins", "bound")
        settled = done if settled is None else settled.unionByName(done)
        if last:
            break
        came = F.col("part") * F.lit(2**28) + F.col("bin")
        open_rows = packed.where(~F.col("settled")).withColumn("came", came).select(*open_rows.columns)
    if settled is None:
        empty = f"{PIECES}, sequence_id long, offset long, round int, part long, bins long, bound long"
        return df.sparkSession.createDataFrame([], empty)
    return settled
