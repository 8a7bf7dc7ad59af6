"""Glossaries: runs of rows that read as "acronym, expansion"."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T


def glossary_pairs(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, kind, acronym, expansion) of blocks that read as a pair."""
    return blocks.withColumn("p", T.gloss_pair(F.col("text"))).where("p IS NOT NULL").select("doc_id", "ord", "kind", "p.acronym", "p.expansion")


def glossary_runs(blocks: DataFrame, min_run: int = 4) -> DataFrame:
    """(doc_id, run, n_rows, need): maximal runs of pairs that are long enough, numbered by their first block's place.

    Two rows do after a glossary title within three blocks, three if all are
    table rows, else min_run.
    """
    return _runs(blocks, min_run).groupBy("doc_id", "run").agg(F.count(F.lit(1)).alias("n_rows"), F.max("need").alias("need"))


def _runs(blocks: DataFrame, min_run: int) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("ord")
    b = blocks.select("doc_id", "ord", "kind", T.gloss_pair(F.col("text")).alias("p"), T.is_glossary_title(F.col("text")).alias("title"))
    b = b.withColumn("at", F.row_number().over(order)).withColumn("titled", F.max(F.col("title").cast("int")).over(order.rowsBetween(-3, -1)))
    b = b.where("p IS NOT NULL").withColumn("island", F.col("at") - F.row_number().over(order))
    run = Window.partitionBy("doc_id", "island")
    b = b.withColumn("run", F.min("at").over(run)).withColumn("n", F.count(F.lit(1)).over(run)).withColumn("tables", F.min((F.col("kind") == "table").cast("int")).over(run))
    b = b.withColumn("led", F.coalesce(F.max(F.when(F.col("at") == F.col("run"), F.col("titled"))).over(run), F.lit(0)))
    b = b.withColumn("need", F.when(F.col("led") == 1, 2).when(F.col("tables") == 1, 3).otherwise(min_run))
    return b.where("n >= need").select("doc_id", (F.col("run") - 1).cast("long").alias("run"), "at", "p", "need", "ord")


def glossary(blocks: DataFrame, tagged: DataFrame | None = None, house: DataFrame | None = None, min_run: int = 4) -> DataFrame:
    """(doc_id, acronym, expansion, origin): tagged entries (the last wins), then harvested rows (the first wins), then house entries."""
    rows = _runs(blocks, min_run).select("doc_id", "p.acronym", "p.expansion", F.lit(1).alias("prio"), F.col("ord").alias("place"), F.lit("harvested").alias("origin"))
    if tagged is not None:
        rows = rows.unionByName(tagged.select("doc_id", "acronym", "expansion", F.lit(0).alias("prio"), (-F.col("ord")).alias("place"), F.lit("tag").alias("origin")))
    if house is not None:
        rows = rows.unionByName(house.select("doc_id", "acronym", "expansion", F.lit(2).alias("prio"), F.lit(0).cast("long").alias("place"), F.lit("house").alias("origin")))
    first = Window.partitionBy("doc_id", "acronym").orderBy("prio", "place")
    return rows.withColumn("k", F.row_number().over(first)).where("k = 1").select("doc_id", "acronym", "expansion", "origin")
