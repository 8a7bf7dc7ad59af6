"""Spelling candidates against a dictionary of words and frequencies, and each document's own allowed words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.plans.tables import dealt, saved

# Prefixes that may stand before a hyphen.
PREFIXES = ("non", "co", "re", "pre", "post", "anti", "multi", "sub", "self", "cross", "inter", "intra", "over", "under", "semi", "mid", "bi", "tri", "de")
MAX_FINDINGS = 200
#: Known words are broadcast up to so many, counted, and met by a shuffle beyond.
BROADCAST_WORDS = 500_000


def allowlist(*sources: DataFrame) -> DataFrame:
    """(doc_id, word): distinct lower-case words of sources (doc_id, text)."""
    found = [s.select("doc_id", F.explode(T.words(F.col("text"))).alias("w")) for s in sources]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", F.lower("w").alias("word")).distinct()


def deletions(word: Column) -> Column:
    """The word itself and each form with one letter less."""
    return F.array_distinct(F.concat(F.array(word), F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether two words differ by one insertion, deletion, replacement, or swap of neighbours."""
    same = F.length(a) == F.length(b)
    spots = F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    first = F.get(spots, F.lit(0))
    swap = same & (F.size(spots) == 2) & (F.get(spots, F.lit(1)) == first + 1)
    swap = swap & (F.substring(a, first, F.lit(1)) == F.substring(b, first + 1, F.lit(1))) & (F.substring(a, first + 1, F.lit(1)) == F.substring(b, first, F.lit(1)))
    return (F.levenshtein(a, b) == 1) | swap


def corrections(unknown: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, suggestion): for each distinct word the most frequent dictionary word one edit away, the first by name among equals.

    Words within one edit share a deletion form, so candidates come from an
    equality join on those and are then verified.
    """
    left = unknown.select("word").distinct().select("word", F.explode(deletions(F.col("word"))).alias("form"))
    right = dictionary.select(F.col("word").alias("known"), "freq").select("known", "freq", F.explode(deletions(F.col("known"))).alias("form"))
    near = left.join(dealt(right), "form").where(F.col("word") != F.col("known")).select("word", "known", "freq").where(one_edit(F.col("word"), F.col("known")))
    return near.groupBy("word").agg(F.min(F.struct((-F.col("freq")).alias("f"), "known")).alias("b")).select("word", F.col("b.known").alias("suggestion"))


def _first_places(words: DataFrame, *more: str) -> DataFrame:
    """(doc_id, low, ord, pos, raw, and what else is equal for a word): each document's first place of a word."""
    return words.groupBy("doc_id", "low").agg(F.min(F.struct("ord", "pos", "raw", *more)).alias("f")).select("doc_id", "low", "f.*")


def spelling_words(blocks: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None, extra: DataFrame | None = None, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """(doc_id, ord, pos, word, suggestion): ``spelling_candidates`` without their surroundings.

    Known words leave each task before anything is dealt out, and rows carry
    places and never texts. Whether a word is known and what is suggested for
    it is found once for each distinct word, or by document where documents
    allow words of their own.
    """
    known = dictionary.groupBy("word").agg(F.max("freq").alias("freq"))
    if extra is not None:
        known = known.unionByName(extra.select("word").distinct().withColumn("freq", F.lit(1).cast("long"))).groupBy("word").agg(F.max("freq").alias("freq"))
    known = saved(known)
    small = known.count() <= BROADCAST_WORDS
    words = blocks.select("doc_id", "ord", F.posexplode(T.words(F.col("text"))).alias("pos", "raw")).withColumn("low", F.lower("raw"))
    words = words.where((F.length("raw") > 3) & (F.upper("raw") != F.col("raw")))
    lows = known.select(F.col("word").alias("low"))
    words = words.join(F.broadcast(lows), "low", "left_anti") if small else _first_places(words).join(dealt(lows), "low", "left_anti")
    words = saved(words.select("doc_id", "ord", "pos", "raw")).withColumn("low", F.lower("raw"))
    keys = ["low"] if allowed is None else ["doc_id", "low"]
    own = allowed.select("doc_id", F.col("word").alias("low")).distinct() if allowed is not None else None

    # What must not be known: the word, its singular, and for hyphened ones a known prefix with a known tail or all parts.
    parts = F.filter(F.split("low", "-"), lambda p: p != "")
    tail = F.array_join(F.slice(parts, 2, F.size(parts)), "-")
    asked = F.array(F.struct(F.lit("word").alias("why"), F.col("low").alias("w")))
    asked = F.concat(asked, F.when(F.col("low").endswith("s"), F.array(F.struct(F.lit("singular").alias("why"), F.expr("left(low, length(low) - 1)").alias("w")))).otherwise(F.array().cast("array<struct<why:string,w:string>>")))
    hyphen = F.col("low").contains("-")
    asked = F.concat(asked, F.when(hyphen, F.concat(F.array(F.struct(F.lit("tail").alias("why"), tail.alias("w"))), F.transform(parts, lambda p: F.struct(F.lit("part").alias("why"), p.alias("w"))))).otherwise(F.array().cast("array<struct<why:string,w:string>>")))
    asks = words.select(*keys).distinct().select(*keys, F.explode(F.array_distinct(asked)).alias("q")).select(*keys, "q.why", "q.w")
    common = known.select(F.col("word").alias("w"), F.lit(1).alias("in_known"))
    asks = asks.join(F.broadcast(common) if small else dealt(common), "w", "left")
    if own is not None:
        asks = asks.join(dealt(own.select("doc_id", F.col("low").alias("w"), F.lit(1).alias("in_own"))), ["doc_id", "w"], "left").withColumn("in_known", F.coalesce("in_known", "in_own"))
    asks = asks.withColumn("yes", F.coalesce("in_known", F.lit(0)))
    told = asks.groupBy(*keys).agg(
        F.max(F.when(F.col("why").isin("word", "singular"), F.col("yes")).otherwise(0)).alias("known"), F.max(F.when(F.col("why") == "tail", F.col("yes")).otherwise(0)).alias("tail_known"),
        F.min(F.when(F.col("why") == "part", F.col("yes")).otherwise(1)).alias("parts_known"),
    )
    told = told.where("known = 0").where(~(hyphen & (((F.get(parts, F.lit(0))).isin(*PREFIXES) & (F.col("tail_known") == 1)) | (F.col("parts_known") == 1))))
    unknown = saved(told.select(*keys))

    common = corrections(unknown.select(F.col("low").alias("word")), known).select(F.col("word").alias("low"), F.col("suggestion").alias("s1"))
    if own is None:
        out = unknown.join(dealt(common), "low").withColumnRenamed("s1", "suggestion")
    else:
        mine = own.select("doc_id", F.col("low").alias("known"), F.explode(deletions(F.col("low"))).alias("form"))
        near = unknown.select("doc_id", "low", F.explode(deletions(F.col("low"))).alias("form")).join(dealt(mine), ["doc_id", "form"]).where(F.col("low") != F.col("known")).where(one_edit(F.col("low"), F.col("known")))
        near = near.groupBy("doc_id", "low").agg(F.min("known").alias("s2"))
        out = unknown.join(dealt(common), "low", "left").join(dealt(near), keys, "left").select(*keys, F.coalesce("s1", "s2").alias("suggestion"))
    out = out.where(F.col("suggestion").isNotNull() & ~(hyphen & (F.col("suggestion") == F.replace("low", F.lit("-"), F.lit("")))))
    out = _first_places(words.join(dealt(out), keys), "suggestion")
    stem = F.when(F.col("low").endswith("es"), F.expr("left(raw, length(raw) - 2)")).when(F.col("low").endswith("s"), F.expr("left(raw, length(raw) - 1)")).otherwise(F.col("raw"))
    out = out.withColumn("stem", stem).where(~((F.length("stem") >= 2) & (F.upper("stem") == F.col("stem")) & F.col("stem").rlike("[A-Za-z]")))
    order = Window.partitionBy("doc_id").orderBy("ord", "pos")
    out = out.withColumn("k", F.row_number().over(order)).where(F.col("k") <= max_findings)
    return out.select("doc_id", "ord", "pos", F.col("raw").alias("word"), "suggestion")


def spelling_candidates(blocks: DataFrame, dictionary: DataFrame, allowed: DataFrame | None = None, extra: DataFrame | None = None, max_findings: int = MAX_FINDINGS) -> DataFrame:
    """(doc_id, ord, pos, word, suggestion, path, context): in document order, max_findings a document.

    dictionary (word, freq) is common to all; allowed (doc_id, word) are a
    document's own words, which count as known and can be suggested there;
    extra (word) are allowed everywhere. Only blocks with findings are joined.
    """
    out = spelling_words(blocks, dictionary, allowed, extra, max_findings)
    out = out.join(dealt(blocks.select("doc_id", "ord", "path", "text")), ["doc_id", "ord"]).where(F.get(T.words(F.col("text")), F.col("pos")) == F.col("word"))
    # Where several blocks have the same place, as ids may repeat, the first by path and text counts.
    out = out.groupBy("doc_id", "ord", "pos", "word", "suggestion").agg(F.min(F.struct("path", "text")).alias("b"))
    return out.select("doc_id", "ord", "pos", "word", "suggestion", "b.path", T.snippet(F.col("b.text"), F.col("word")).alias("context"))
