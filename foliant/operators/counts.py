"""Exact counts of acronyms and phrases in whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.plans.tables import dealt

_META = r"([\\.^$|?*+()\[\]{}/&'-])"


def _quoted(text: Column) -> Column:
    return F.regexp_replace(text, _META, r"\\$1")


def acronym_pattern(acronym: Column) -> Column:
    return F.concat(F.lit("(?<![A-Za-z0-9])"), _quoted(acronym), F.lit("(?![A-Za-z0-9])"))


def phrase_pattern(phrase: Column) -> Column:
    body = F.array_join(F.transform(F.filter(F.split(F.trim(phrase), r"\s+"), lambda w: w != ""), _quoted), r"\s+")
    return F.concat(F.lit("(?iu)(?<![A-Za-z0-9])"), body, F.lit("(?![A-Za-z0-9])"))


def count_acronym(text: Column, acronym: Column) -> Column:
    """Uses as a token of its own, case kept; 0 for an empty acronym."""
    return F.when(F.coalesce(acronym, F.lit("")) == "", F.lit(0)).otherwise(F.regexp_count(F.coalesce(text, F.lit("")), acronym_pattern(acronym))).cast("long")


def count_phrase(text: Column, phrase: Column) -> Column:
    """Uses in any case and with any white space between words, over line feeds too; 0 for an empty phrase."""
    blank = F.trim(F.coalesce(phrase, F.lit(""))) == ""
    return F.when(blank, F.lit(0)).otherwise(F.regexp_count(F.coalesce(text, F.lit("")), phrase_pattern(phrase))).cast("long")


def annotate_counts(table: DataFrame, texts: DataFrame) -> DataFrame:
    """A table (doc_id, acronym, expansion, ...) with acronym_count and expansion_count from texts (doc_id, text).

    A document's acronyms and expansions come to its text as two arrays, so
    every text is joined once, whatever the table's rows. Its acronyms are
    counted in one scan with a longest-first alternation, so one inside
    another at a mark gives way to the longer one. Each distinct expansion is
    counted once, by itself. A null or empty acronym or expansion counts 0.
    """
    norm = F.lower(F.regexp_replace(F.trim(F.coalesce("expansion", F.lit(""))), r"\s+", " "))
    table = table.withColumn("_norm", norm)
    wanted = table.groupBy("doc_id").agg(F.collect_set(F.when(F.col("acronym") != "", F.col("acronym"))).alias("a"), F.collect_set("_norm").alias("e"))
    longest = F.array_sort("a", lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0))
    pattern = F.concat(F.lit("(?<![A-Za-z0-9])("), F.array_join(F.transform(longest, _quoted), "|"), F.lit(")(?![A-Za-z0-9])"))
    hits = F.when(F.size("a") > 0, F.regexp_extract_all("text", pattern, F.lit(1))).otherwise(F.array().cast("array<string>"))
    found = texts.select("doc_id", "text").join(dealt(wanted), "doc_id").select("doc_id", hits.alias("hits"), F.transform("e", lambda e: F.struct(e.alias("key"), count_phrase(F.col("text"), e).alias("n"))).alias("uses"))
    both = F.concat(F.transform("hits", lambda h: F.struct(F.lit("a").alias("kind"), h.alias("key"), F.lit(1).cast("long").alias("n"))), F.transform("uses", lambda u: F.struct(F.lit("e").alias("kind"), u["key"], u["n"])))
    counted = found.select("doc_id", F.explode(both).alias("x")).groupBy("doc_id", "x.kind", "x.key").agg(F.sum("x.n").alias("n"))

    def of(kind: str, key: str, name: str) -> DataFrame:
        return counted.where(F.col("kind") == kind).select("doc_id", F.col("key").alias(key), F.col("n").alias(name))

    out = table.join(dealt(of("a", "acronym", "acronym_count")), ["doc_id", "acronym"], "left").join(dealt(of("e", "_norm", "expansion_count")), ["doc_id", "_norm"], "left").drop("_norm")
    return out.fillna(0, ["acronym_count", "expansion_count"])


def drop_phantoms(table: DataFrame) -> DataFrame:
    """Without proposed rows for which the text has neither acronym nor expansion."""
    return table.where("status <> 'proposed' OR acronym_count > 0 OR expansion_count > 0")
