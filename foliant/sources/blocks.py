"""The block model: rows of text in document order, which every pass reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions.text import ws

BLOCKS = "doc_id string, ord long, text string, path string, kind string, page string"
GLOSSARY = "doc_id string, acronym string, expansion string, ord long"


def blocks_from_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A block for each line with text; doc_id keeps its type. ord is the line's number."""
    lines = df.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("ord", "line"))
    lines = lines.select("doc_id", F.col("ord").cast("long").alias("ord"), ws(F.col("line")).alias("text")).where("text <> ''")
    return lines.select("doc_id", "ord", "text", F.concat(F.lit("body/p["), "ord", F.lit("]")).alias("path"), F.lit("body").alias("kind"), F.lit(None).cast("string").alias("page"))


def document_text(blocks: DataFrame) -> DataFrame:
    """(doc_id, text): a document's blocks joined by line feeds in order."""
    held = blocks.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("b"))
    return held.select("doc_id", F.array_join(F.transform("b", lambda x: x["text"]), "\n").alias("text"))


def reference_acronyms(spark: SparkSession, path: str) -> DataFrame:
    """(acronym, definition) of a house list in CSV; of an acronym's rows the first counts."""
    raw = spark.read.csv(path, schema="acronym string, definition string", encoding="UTF-8", mode="PERMISSIVE")
    rows = raw.withColumn("at", F.monotonically_increasing_id())
    rows = rows.select(F.trim(F.regexp_replace("acronym", "^\\uFEFF", "")).alias("acronym"), F.trim("definition").alias("definition"), "at")
    rows = rows.where("acronym <> '' AND definition <> '' AND lower(acronym) NOT IN ('acronym', 'abbreviation')")
    first = Window.partitionBy("acronym").orderBy("at")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("acronym", "definition")


def extra_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case words of a list with # comments."""
    words = spark.read.text(path).select(F.lower(F.trim(F.element_at(F.split("value", "#"), 1))).alias("word"))
    return words.where("word <> ''").distinct()
