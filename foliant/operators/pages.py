"""Page markers, cross references and tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.tables import dealt

# Patterns of markers, references and entries. Word boundaries are Unicode's.
PAGE_OF = r"(?iU)\bPage\s+([0-9]+)\s+of\s+([0-9]+)\b"
XREF = r"(?iU)\b(?:see|refer to|shown on|listed on|on|per)\s+page\s+([0-9]+)\b"
TOC_ENTRY = r"^(.*?\S)[.\s]{2,}([0-9]+)\s*$"
CONTENTS = ("table of contents", "contents")
#: Where a synthetic marker stands that carries only a total.
PAGINATION = "sections/pagination"


def page_sequence(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, sub, n, path): page numbers in document order; sub 0 is a block's own page attribute."""
    own = blocks.where("kind = 'page'").select("doc_id", "ord", F.lit(0).alias("sub"), F.regexp_extract("page", "([0-9]+)", 1).alias("n"), "path").where("n <> ''")
    marks = blocks.where(F.col("path").isNull() | (F.col("path") != PAGINATION)).select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(PAGE_OF), F.lit(1))).alias("k", "n"), "path")
    marks = marks.select("doc_id", "ord", (F.col("k") + 1).alias("sub"), "n", "path")
    return own.unionByName(marks).withColumn("n", F.col("n").cast("long"))


def page_totals(blocks: DataFrame) -> DataFrame:
    """(doc_id, total, totals): the largest Y of "Page X of Y", and all of them sorted."""
    found = blocks.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(PAGE_OF), F.lit(2))).alias("y")).select("doc_id", F.col("y").cast("long").alias("y"))
    return found.groupBy("doc_id").agg(F.max("y").alias("total"), F.sort_array(F.collect_set("y")).alias("totals"))


def inconsistent_totals(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_totals, totals): documents with more than one total."""
    return page_totals(blocks).where("size(totals) > 1").select("doc_id", F.size("totals").cast("long").alias("n_totals"), F.array_join("totals", ", ").alias("totals"))


def sequence_issues(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, sub, problem, n, prev, path): duplicates, gaps and steps back; a number may have several."""
    order = Window.partitionBy("doc_id").orderBy("ord", "sub")
    s = page_sequence(blocks).withColumn("prev", F.lag("n").over(order))
    s = s.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "n").orderBy("ord", "sub")) > 1)
    problems = F.array_compact(
        F.array(
            F.when(F.col("again"), F.lit("duplicate_page_number")), F.when(F.col("n") > F.col("prev") + 1, F.lit("page_gap")), F.when(F.col("n") < F.col("prev"), F.lit("out_of_order_page"))
        )
    )
    return s.select("doc_id", "ord", "sub", F.explode(problems).alias("problem"), "n", "prev", "path")


def xref_issues(blocks: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, k, n, total, path): references to pages that the document doesn't have; silent without a total. Here and below, totals and entries are those of ``page_totals`` and ``toc_entries``, if at hand."""
    totals = page_totals(blocks) if totals is None else totals
    refs = blocks.select("doc_id", "ord", F.posexplode(F.regexp_extract_all("text", F.lit(XREF), F.lit(1))).alias("k", "n"), "path").withColumn("n", F.col("n").cast("long"))
    return refs.join(dealt(totals.where("total > 0").select("doc_id", "total")), "doc_id").where((F.col("n") < 1) | (F.col("n") > F.col("total")))


def toc_entries(blocks: DataFrame) -> DataFrame:
    """(doc_id, ord, title, n, path): entries after a contents heading, up to a heading that is no entry."""
    starts = (F.col("kind") == "toc") | F.lower("text").isin(*CONTENTS)
    entry = F.col("text").rlike(TOC_ENTRY)
    state = F.when(starts, 1).when((F.col("kind") == "heading") & ~entry, 0)
    before = Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    b = blocks.withColumn("inside", F.last(state, ignorenulls=True).over(before)).where(~starts & entry & (F.col("inside") == 1))
    return b.select("doc_id", "ord", F.trim(F.regexp_extract("text", TOC_ENTRY, 1)).alias("title"), F.regexp_extract("text", TOC_ENTRY, 2).cast("long").alias("n"), "path")


def toc_issues(blocks: DataFrame, totals: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(doc_id, ord, title, n, total, path): entries beyond the total."""
    totals, entries = page_totals(blocks) if totals is None else totals, toc_entries(blocks) if entries is None else entries
    return entries.join(dealt(totals.select("doc_id", "total")), "doc_id").where(F.col("n") > F.col("total"))


def page_issues(blocks: DataFrame, totals: DataFrame | None = None, entries: DataFrame | None = None) -> DataFrame:
    """(doc_id, problem, detail, location, stage, ord, sub): all page findings, to be read in order of stage, ord, sub."""
    totals = page_totals(blocks) if totals is None else totals
    several = totals.where("size(totals) > 1")
    detail = F.concat(F.lit("'Page X of Y' uses multiple totals: ["), F.array_join("totals", ", "), F.lit("]"))
    out = several.select("doc_id", F.lit("inconsistent_total").alias("problem"), detail.alias("detail"), F.lit("").alias("location"), F.lit(0).alias("stage"), F.lit(0).cast("long").alias("ord"), F.lit(0).alias("sub"))
    s = sequence_issues(blocks)
    rank = F.when(F.col("problem") == "duplicate_page_number", 0).when(F.col("problem") == "page_gap", 1).otherwise(2)
    detail = F.when(F.col("problem") == "duplicate_page_number", F.format_string("page %d labeled more than once", "n")).when(F.col("problem") == "page_gap", F.format_string("jumps from %d to %d", "prev", "n"))
    s = s.select("doc_id", "problem", detail.otherwise(F.format_string("%d follows %d", "n", "prev")).alias("detail"), F.col("path").alias("location"), F.lit(1).alias("stage"), "ord", (F.col("sub") * 3 + rank).alias("sub"))
    x = xref_issues(blocks, totals).select("doc_id", F.lit("xref_out_of_range").alias("problem"), F.format_string("reference to page %d (document has %d)", "n", "total").alias("detail"), F.col("path").alias("location"), F.lit(2).alias("stage"), "ord", F.col("k").alias("sub"))
    t = toc_issues(blocks, totals, entries).select("doc_id", F.lit("toc_page_out_of_range").alias("problem"), F.format_string("TOC lists '%s' on page %d (> %d)", "title", "n", "total").alias("detail"), F.col("path").alias("location"), F.lit(3).alias("stage"), "ord", F.lit(0).alias("sub"))
    return out.unionByName(s).unionByName(x).unionByName(t)
