"""Organisation names: how each is written, and which don't belong."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

# Name endings that mark an organisation, and the pattern of a name.
SUFFIXES = (
    "Inc", "Inc.", "LLC", "Corp", "Corp.", "Corporation", "Company", "Co", "Co.", "Ltd", "Ltd.", "GmbH", "PLC", "LP", "LLP", "Technologies", "Systems", "Industries", "Defense", "Aerospace",
    "Group", "International", "Solutions", "Holdings", "Enterprises",
)
_ENDING = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
ORG = rf"(?U)\b([A-Z][A-Za-z0-9&.\-]+(?:\s+(?:&|of)?\s*[A-Z][A-Za-z0-9&.\-]+){{0,5}},?\s+(?:{_ENDING}))\b"


def org_mentions(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, k, surface, key, text)."""
    found = blocks.select("doc_id", "ord", "text", F.posexplode(F.regexp_extract_all("text", F.lit(ORG), F.lit(1))).alias("k", "s"))
    found = found.withColumn("surface", T.ws(F.col("s"))).withColumn("key", T.org_key(F.col("surface")))
    return found.select("doc_id", "ord", "k", "surface", "key", "text")


def org_surfaces(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, surface, count, first): each way a name is written, with its first place."""
    return org_mentions(blocks).groupBy("doc_id", "key", "surface").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("ord", "k")).alias("first"))


def org_contexts(blocks: DataFrame) -> DataFrame:
    """(doc_id, surface, k, context): the first three surroundings of each way."""
    early = Window.partitionBy("doc_id", "surface").orderBy("ord", "k")
    m = org_mentions(blocks).withColumn("n", F.row_number().over(early)).where("n <= 3")
    return m.select("doc_id", "surface", F.col("n").alias("k"), T.snippet(F.col("text"), F.col("surface")).alias("context"))


def org_clusters(blocks: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, n_surfaces, mentions, top): top is the most frequent way, the first seen among equals. Here and below, surfaces are those of ``org_surfaces``, if at hand."""
    s = org_surfaces(blocks) if surfaces is None else surfaces
    best = F.max(F.struct(F.col("count"), (-F.col("first.ord")).alias("o"), (-F.col("first.k")).alias("k"), F.col("surface")))
    return s.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n_surfaces"), F.sum("count").alias("mentions"), best.alias("b")).select("doc_id", "key", "n_surfaces", "mentions", F.col("b.surface").alias("top"))


def inconsistent_forms(blocks: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, n_surfaces, forms): names written in more than one way."""
    s = (org_surfaces(blocks) if surfaces is None else surfaces).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("surface", "count"))).alias("f")).where("size(f) > 1")
    return s.select("doc_id", "key", F.size("f").cast("long").alias("n_surfaces"), F.array_join(F.transform("f", lambda x: F.concat(x["surface"], F.lit(" x"), x["count"].cast("string"))), "; ").alias("forms"))


def wrong_customers(blocks: DataFrame, expected: str, surfaces: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, top): organisations other than the expected one."""
    return org_clusters(blocks, surfaces).where((F.col("key") != "") & (F.col("key") != T.org_key(F.lit(expected)))).select("doc_id", "key", "top")


def primary_customer(blocks: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    """(doc_id, primary): the top form of the cluster with most mentions; equal ones by key."""
    best = F.max_by("top", F.struct("mentions", F.expr("transform(split(key, ''), c -> -ascii(c))")))
    return org_clusters(blocks, surfaces).groupBy("doc_id").agg(best.alias("primary"))
