"""Exact deduplication by a content sort, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

#: Characters of a text that lead its sort key; its 64-bit hash comes next, so equal texts have equal keys.
PREFIX = 16
#: Bytes of equal texts that may lie in one task; a larger group is salted into parts of this size.
PART_BYTES = 64 << 20
#: Groups that are salted, the largest ones: their table is broadcast, some 20 bytes each.
MAX_HOT = 100_000


def exact_dedup(df: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, normalise=lambda text: text, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256 (and struct ``row`` of the columns in ``carry``).

    Splitters sampled from short keys (a prefix of the normalised text, then
    its hash) range-partition the rows: the driver sees keys of some 50 bytes
    and never a text. An external sort by key and then whole text puts equal
    texts next to each other, and a window closes a run where the whole text
    differs from its neighbour's; texts that only share a key stay apart.
    ``keep`` is "smallest" or "largest": which identifier stays.

    A group of equal texts of more than ``part_bytes`` in all is dealt by id
    over as many parts of the range as it has such pieces, and the parts'
    results, one row for each task after partial sums, are merged. So a task
    holds no more of a group than that, however large the table; beyond
    MAX_HOT such groups (over 6 TB of copies) the smaller of them stay whole.

    A null text counts as empty. A null id stays only if its group has no
    other; of repeated rows with the same id and text exactly one stays. Very
    long texts are sorted like others and spill. Columns that aren't named
    aren't read, so clashing names don't matter. An empty table gives no rows.
    """
    largest = {"smallest": False, "largest": True}[keep]
    best, order = (F.max, F.col("doc_id").desc_nulls_last()) if largest else (F.min, F.col("doc_id").asc_nulls_last())
    text: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    extra = [F.struct(*carry).alias("row")] if carry else []
    work = df.select(F.col(id_col).alias("doc_id"), text.alias("text"), *extra).withColumn("h", F.xxhash64("text"))

    # Hashes and lengths alone are shuffled for the sizes of groups; few are above part_bytes.
    sizes = work.select("h", F.octet_length("text").cast("long").alias("b")).groupBy("h").agg(F.sum("b").alias("bytes"), F.count(F.lit(1)).alias("n"))
    sizes = sizes.where((F.col("n") > 1) & ((F.col("bytes") > part_bytes) | (F.col("n") * 100 > part_bytes)))  # a row counts for 100 bytes at least
    sizes = sizes.select("h", F.ceil(F.greatest(F.col("bytes"), F.col("n") * 100) / part_bytes).cast("long").alias("salts"))
    hot = Scratch(df.sparkSession, "exact").save(sizes.orderBy(F.desc("salts"), "h").limit(MAX_HOT))
    some = not hot.isEmpty()

    keyed, key = work.withColumn("prefix", F.left("text", F.lit(PREFIX))), ["prefix", "h"]
    if some:  # a constant salt would be folded out of the window's key, and the rows shuffled again for it
        keyed = keyed.join(F.broadcast(hot), "h", "left").withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("doc_id"), "salts")).otherwise(0))
        key += ["salt"]
    ranged = keyed.repartitionByRange(*key)
    run = Window.partitionBy(*key, "text").orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = ranged.select(
        "doc_id", *(["row"] if carry else []), F.sha2("text", 256).alias("text_sha256"),
        F.row_number().over(run).alias("rank"), best("doc_id").over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"),
    )
    if some:
        totals = work.join(F.broadcast(hot), "h", "left_semi").groupBy("text").agg(best("doc_id").alias("all_keep"), F.count(F.lit(1)).alias("all_size"))
        totals = totals.where(F.col("all_size") > 1).select(F.sha2("text", 256).alias("text_sha256"), "all_keep", "all_size")
        rows = rows.join(F.broadcast(totals), "text_sha256", "left")  # MAX_HOT rows, but for texts that share a hash
        rows = rows.withColumn("keep_id", F.coalesce("all_keep", "keep_id")).withColumn("group_size", F.coalesce("all_size", "group_size"))
    kept = (F.col("rank") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", *(["row"] if carry else []))
