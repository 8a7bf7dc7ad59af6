"""Acronym definitions in running text, their consistency, and house lists."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans.tables import dealt

# Definition and use patterns. Word boundaries are Unicode's.
DEF_FORWARD = r"([A-Z][A-Za-z0-9&./'\-]*(?:\s+[A-Za-z0-9&./'\-]+){1,6})\s*\(\s*([A-Z][A-Za-z0-9&./\-]{1,9})\s*\)"
DEF_REVERSE = r"(?U)\b([A-Z][A-Z0-9&./\-]{1,9})\s*\(\s*([A-Z][A-Za-z0-9&./'\-]+(?:\s+[A-Za-z0-9&./'\-]+){1,6})\s*\)"
USE = r"(?U)\b([A-Z]{2,6}s?)\b"


def _pairs(blocks: DataFrame, pattern: str, acronym: int, expansion: int, direction: str) -> DataFrame:
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(pattern), F.lit(acronym)).alias("a"), F.regexp_extract_all("text", F.lit(pattern), F.lit(expansion)).alias("e"))
    found = blocks.select("doc_id", "ord", "path", F.posexplode(both).alias("pos", "d")).select("doc_id", "ord", "path", "pos", F.trim("d.a").alias("acr"), F.trim("d.e").alias("exp"))
    found = found.withColumn("exp", F.regexp_replace("exp", r"(?i)^(?:the|a|an)\s+", ""))
    repeated = F.col("exp").startswith(F.concat("acr", F.lit(" ")))
    found = found.withColumn("exp", F.when(repeated, F.ltrim(F.expr("substr(exp, length(acr) + 1)"))).otherwise(F.col("exp")))
    found = found.where(T.defines(F.col("acr"), F.col("exp")))
    return found.select("doc_id", "ord", "path", "pos", F.rtrim("acr", F.lit("s")).alias("acronym"), F.col("exp").alias("expansion"), F.lit(direction).alias("direction"))


def forward_definitions(blocks: DataFrame) -> DataFrame:
    """Long Name (LN): doc_id, ord, path, pos, acronym, expansion, direction."""
    return _pairs(blocks, DEF_FORWARD, 2, 1, "forward")


def reverse_definitions(blocks: DataFrame) -> DataFrame:
    """LN (Long Name)."""
    return _pairs(blocks, DEF_REVERSE, 1, 2, "reverse")


def definitions(blocks: DataFrame) -> DataFrame:
    return forward_definitions(blocks).unionByName(reverse_definitions(blocks))


def definition_sets(blocks: DataFrame, glossary: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, acronym, expansion) distinct, from text and from a glossary (doc_id, acronym, expansion); found: the text's definitions, if at hand."""
    out = (definitions(blocks) if found is None else found).select("doc_id", "acronym", "expansion")
    if glossary is not None:
        out = out.unionByName(glossary.select("doc_id", F.rtrim("acronym", F.lit("s")).alias("acronym"), "expansion"))
    return out.distinct()


def existing_acronyms(sets: DataFrame) -> DataFrame:
    return sets.groupBy("doc_id", "acronym").agg(F.sort_array(F.collect_set("expansion")).alias("expansions"))


def conflicting_expansions(sets: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(doc_id, acronym, n_expansions, detail[, locations]): acronyms with several expansions that differ beyond case and spacing."""
    norm = sets.groupBy("doc_id", "acronym", T.norm_expansion(F.col("expansion")).alias("norm")).agg(F.min("expansion").alias("expansion"))
    out = norm.groupBy("doc_id", "acronym").agg(F.count(F.lit(1)).alias("n_expansions"), F.array_join(F.sort_array(F.collect_list("expansion")), "; ").alias("detail")).where("n_expansions > 1")
    if found is not None:
        from pyspark.sql import Window

        early = Window.partitionBy("doc_id", "acronym").orderBy("ord", "direction", "pos")
        places = found.withColumn("k", F.row_number().over(early)).where("k <= 5").groupBy("doc_id", "acronym")
        places = places.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("locations"))
        out = out.join(dealt(places), ["doc_id", "acronym"], "left").withColumn("locations", F.coalesce("locations", F.array().cast("array<string>")))
    return out


def multiple_acronyms(sets: DataFrame) -> DataFrame:
    """(doc_id, acronyms, expansion): one expansion under several acronyms, joined by /."""
    out = sets.groupBy("doc_id", T.norm_expansion(F.col("expansion")).alias("expansion")).agg(F.sort_array(F.collect_set("acronym")).alias("a")).where("size(a) > 1")
    return out.select("doc_id", F.array_join("a", "/").alias("acronyms"), "expansion")


def acronym_uses(blocks: DataFrame) -> DataFrame:
    """(doc_id, acronym, uses): capitals of two to six, a plural s taken off."""
    used = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(USE), F.lit(1))).alias("a"))
    return used.select("doc_id", F.rtrim("a", F.lit("s")).alias("acronym")).groupBy("doc_id", "acronym").agg(F.count(F.lit(1)).alias("uses"))


def used_not_defined(blocks: DataFrame, sets: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc_id, acronym, uses): uses without a definition that are neither common acronyms nor dictionary words (column word)."""
    used = acronym_uses(blocks).where(~F.col("acronym").isin(*T.COMMON_ACRONYMS))
    used = used.join(sets.select("doc_id", "acronym").distinct(), ["doc_id", "acronym"], "left_anti")
    return used.withColumn("word", F.lower("acronym")).join(dictionary.select("word").distinct(), "word", "left_anti").select("doc_id", "acronym", "uses")


def alternation(keys: list[str]) -> str:
    """A pattern for any of the keys, longest first, between non-alphanumerics."""
    return r"(?<![A-Za-z0-9])(" + "|".join(re.escape(k) for k in sorted(keys, key=lambda k: (-len(k), k))) + r")(?![A-Za-z0-9])"


def house_hits(blocks: DataFrame, house: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, acronym, hits) of house acronyms in the documents, one longest-first scan.

    The list is a curated table on the driver (a few hundred rows), so it
    becomes one pattern. Acronyms don't cross line feeds, so blocks are scanned
    one by one and counts summed.
    """
    if not house:
        return blocks.select("doc_id", F.lit("").alias("acronym"), F.lit(0).cast("long").alias("hits")).where("false")
    hits = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(alternation([k for k, _ in house])), F.lit(1))).alias("acronym"))
    return hits.groupBy("doc_id", "acronym").agg(F.count(F.lit(1)).alias("hits"))


def house_merge(blocks: DataFrame, glossary: DataFrame, house: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, acronym, expansion): house acronyms that occur in a document which doesn't define them itself."""
    hits = house_hits(blocks, house).select("doc_id", "acronym").join(dealt(glossary.select("doc_id", "acronym").distinct()), ["doc_id", "acronym"], "left_anti")
    meaning: Column = F.create_map(*[F.lit(x) for pair in house for x in pair]) if house else F.map_from_arrays(F.array(F.lit("")), F.array(F.lit("")))
    return hits.select("doc_id", "acronym", meaning[F.col("acronym")].alias("expansion"))
