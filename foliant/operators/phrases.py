"""Recurring multi-word phrases, and the suppression of those that only occur inside longer ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans.tables import dealt

MAX_LEN = 6


def gram_occurrences(blocks: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, ord, n, i, phrase, path): every candidate n-gram within a block, in order of (ord, n, i).

    Token classes form a string with a letter for each token, so the rules on a
    window are string tests on a few letters, applied before anything explodes.
    """
    b = blocks.select("doc_id", "ord", "path", T.tokens(F.col("text")).alias("t")).where("size(t) >= 2")
    b = b.withColumn("kinds", T.classes(F.col("t")))
    starts = F.expr(
        f"filter(sequence(1, length(kinds) - 1), i -> substr(kinds, i, 1) IN ('C', 's', 'n') AND length(split_part(substr(kinds, i, {max_len}), 'x', 1)) >= 2"
        f" AND substr(kinds, i, {max_len}) LIKE '%C%C%')"
    )
    # Windows are cut before they explode: a row carries six tokens and not its whole block.
    windows = F.transform(starts, lambda i: F.struct(i.alias("i"), F.slice("t", i, max_len).alias("t"), F.substring("kinds", i, F.lit(max_len)).alias("kinds")))
    b = b.select("doc_id", "ord", "path", F.explode(windows).alias("w")).select("doc_id", "ord", "path", "w.*")
    b = b.select("doc_id", "ord", "path", "t", "kinds", "i", F.explode(F.expr("sequence(2, length(kinds))")).alias("n"))
    b = b.where(T.gram_ok(F.substring("kinds", F.lit(1), F.col("n"))))
    return b.select("doc_id", "ord", "path", "n", (F.col("i") - 1).alias("i"), F.array_join(F.slice("t", F.lit(1), F.col("n")), " ").alias("phrase"))


def phrase_counts(blocks: DataFrame, floor: int = 2, max_len: int = MAX_LEN) -> DataFrame:
    """(doc_id, phrase, count, first): counts of phrases that occur floor times or more, with the first place.

    Counted from packed strings alone: partial sums leave each task before the shuffle.
    """
    counted = gram_occurrences(blocks, max_len).groupBy("doc_id", "phrase").agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("ord", "n", "i")).alias("first"))
    return counted.where(F.col("count") >= floor)


def suppress(counts: DataFrame, min_count: int = 3, max_len: int = MAX_LEN) -> DataFrame:
    """Drops a phrase that outside its most frequent container occurs fewer than min_count times.

    Containment is an equality join: each phrase gives its proper runs of
    tokens (14 at most for six), grouped to the best container's count.
    """
    runs = counts.withColumn("t", F.split("phrase", " ")).where("size(t) > 1")
    subs = F.expr(
        "array_distinct(flatten(transform(sequence(1, size(t) - 1), m -> transform(sequence(1, size(t) - m + 1), s -> array_join(slice(t, s, m), ' ')))))"
    )
    best = runs.select("doc_id", F.explode(subs).alias("phrase"), "count").groupBy("doc_id", "phrase").agg(F.max("count").alias("best"))
    kept = counts.join(dealt(best), ["doc_id", "phrase"], "left")
    return kept.where(F.col("best").isNull() | (F.col("count") - F.col("best") >= min_count)).drop("best")


def recurring_phrases(blocks: DataFrame, min_count: int = 3, max_len: int = MAX_LEN, locations: bool = False) -> DataFrame:
    """(doc_id, rank, phrase, count, proposed): phrases by falling count, falling length, first place; with the first five paths if asked."""
    kept = suppress(phrase_counts(blocks, 2, max_len), min_count, max_len).where(F.col("count") >= min_count)
    order = Window.partitionBy("doc_id").orderBy(F.desc("count"), F.desc(F.length("phrase")), "first")
    out = kept.select("doc_id", F.row_number().over(order).alias("rank"), "phrase", "count", T.propose_acronym(F.col("phrase")).alias("proposed"))
    if locations:
        places = gram_occurrences(blocks, max_len).join(dealt(out.select("doc_id", "phrase")), ["doc_id", "phrase"])
        early = Window.partitionBy("doc_id", "phrase").orderBy("ord", "n", "i")
        places = places.withColumn("k", F.row_number().over(early)).where("k <= 5")
        places = places.groupBy("doc_id", "phrase").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "path"))), lambda x: x["path"]).alias("locations"))
        out = out.join(dealt(places), ["doc_id", "phrase"]).select("doc_id", "rank", "phrase", "count", "proposed", "locations")
    return out
