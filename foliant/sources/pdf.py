"""PDF sources from words with geometry: lines, running headers, paragraphs and table rows as blocks.

Reading the binary format is left to a plug-in that fills pdf_words, pdf_pages
and pdf_table_rows; everything after that is done here on whole corpora.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ws
from foliant.operators.pages import CONTENTS

PAGE_OF = r"(?iU)\bPage\s+\d+\s+of\s+\d+\b"


def words_outside_tables(words: DataFrame, tables: DataFrame) -> DataFrame:
    """Words that lie in no table box (doc_id, page_no, x0, top, x1, bottom), a point's slack on each side."""
    w, t = words.alias("w"), tables.select("doc_id", "page_no", "x0", "top", "x1", "bottom").distinct().alias("t")
    inside = (F.col("w.x0") >= F.col("t.x0") - 1) & (F.col("w.x1") <= F.col("t.x1") + 1) & (F.col("w.top") >= F.col("t.top") - 1) & (F.col("w.bottom") <= F.col("t.bottom") + 1)
    return w.join(t, (F.col("w.doc_id") == F.col("t.doc_id")) & (F.col("w.page_no") == F.col("t.page_no")) & inside, "left_anti")


def lines(words: DataFrame, slack: float = 3.0) -> DataFrame:
    """(doc_id, page_no, line, text, size, top): words from top to bottom, a new line when one lies over ``slack`` below the line's first.

    Each line is anchored at its own first word, so the fold runs over a page's
    words in order; a page bounds it.
    """
    order = F.struct(F.round("top", 1).alias("r"), "x0", "top", "size", "text")
    page = words.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(order)).alias("w"))
    start = F.expr("named_struct('line', -1, 'anchor', CAST(0 AS DOUBLE), 'at', CAST(array() AS array<int>))")
    step = (
        "(s, w) -> CASE WHEN s.line < 0 OR abs(w.top - s.anchor) > {0} THEN named_struct('line', s.line + 1, 'anchor', w.top, 'at', array_append(s.at, s.line + 1))"
        " ELSE named_struct('line', s.line, 'anchor', s.anchor, 'at', array_append(s.at, s.line)) END"
    ).format(f"CAST({slack} AS DOUBLE)")
    folded = page.withColumn("start", start).withColumn("at", F.expr(f"aggregate(w, start, {step}).at"))
    each = folded.select("doc_id", "page_no", F.explode(F.arrays_zip("w", "at")).alias("z")).select("doc_id", "page_no", F.col("z.at").alias("line"), "z.w.*")
    out = each.groupBy("doc_id", "page_no", "line").agg(F.sort_array(F.collect_list(F.struct("x0", "r", "text"))).alias("w"), F.max(F.coalesce("size", F.lit(0.0))).alias("size"), F.min("top").alias("top"))
    return out.select("doc_id", "page_no", "line", ws(F.array_join(F.transform("w", lambda x: x["text"]), " ")).alias("text"), "size", "top").where("text <> ''")


def body_size(line_rows: DataFrame) -> DataFrame:
    """(doc_id, body): the upper median of the lines' sizes, zeros left out."""
    order = Window.partitionBy("doc_id").orderBy("size", "page_no", "line")
    s = line_rows.where("size > 0").withColumn("k", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return s.where("k = n div 2 + 1").select("doc_id", F.col("size").alias("body"))


def boilerplate(line_rows: DataFrame, pages: DataFrame, band: float = 0.12, share: float = 0.6, least: int = 4) -> DataFrame:
    """(doc_id, norm, n_pages): lines in the top or bottom band of most pages; documents of fewer than ``least`` pages have none."""
    n = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    edge = line_rows.join(pages, ["doc_id", "page_no"]).where((F.col("top") <= F.col("height") * band) | (F.col("top") >= F.col("height") * (1 - band)))
    found = edge.where(~F.col("text").rlike(PAGE_OF)).groupBy("doc_id", F.lower(ws(F.col("text"))).alias("norm")).agg(F.count_distinct("page_no").alias("n_pages"))
    found = found.join(n.where(F.col("n") >= least), "doc_id")
    return found.where(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(F.col("n") * share))).select("doc_id", "norm", "n_pages")


def is_heading(text: Column, size: Column, body: Column) -> Column:
    short = F.size(F.split(F.trim(text), r"\s+")) <= 14
    large = (F.coalesce(body, F.lit(0.0)) > 0) & (size >= body * 1.15)
    numbered = text.rlike(r"^\d+(?:\.\d+){0,4}\.?\s+\S") & (F.length(text) <= 90)
    shouted = (F.upper(text) == text) & (F.lower(text) != text) & F.length(text).between(2, 60)
    return short & (large | numbered | shouted)


def reflow(line_rows: DataFrame, bodies: DataFrame, gap: float = 1.7) -> DataFrame:
    """(doc_id, page_no, para, text, kind): lines joined to paragraphs; a heading stands alone, words cut by a hyphen are mended."""
    order = Window.partitionBy("doc_id", "page_no").orderBy("line")
    b = line_rows.join(bodies, "doc_id", "left").withColumn("head", is_heading(F.col("text"), F.col("size"), F.col("body")))
    height = F.when(F.coalesce("body", F.lit(0.0)) > 0, F.col("body")).otherwise(10.0) * 1.2
    far = F.coalesce(F.col("top") - F.lag("top").over(order) > height * gap, F.lit(False))
    after = F.coalesce(F.lag("head").over(order), F.lit(False))
    b = b.withColumn("new", (F.col("head") | far | after).cast("int")).withColumn("island", F.sum("new").over(order))
    p = b.groupBy("doc_id", "page_no", "island").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("l"), F.max("head").alias("head"))
    joined = F.array_join(F.transform("l", lambda x: x["text"]), "\u0001")
    text = ws(F.replace(F.regexp_replace(joined, "-\u0001(?=\\p{Ll})", ""), F.lit("\u0001"), F.lit(" ")))
    p = p.select("doc_id", "page_no", "island", text.alias("text"), "head").where("text <> ''")
    p = p.withColumn("para", F.row_number().over(Window.partitionBy("doc_id", "page_no").orderBy("island")) - 1)
    kind = F.when(F.lower("text").isin(*CONTENTS), "toc").when(F.col("head"), "heading").otherwise("body")
    return p.select("doc_id", "page_no", "para", "text", kind.alias("kind"))


def pdf_blocks(words: DataFrame, pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks of PDF documents: paragraphs, then table rows, then a folio for each page if no "Page X of Y" stands anywhere.

    tables: doc_id, page_no, tbl, row, cells, x0, top, x1, bottom. Documents
    without any text give folios alone; ``scanned`` lists them.
    """
    rows = lines(words_outside_tables(words, tables))
    drop = boilerplate(rows, pages).select("doc_id", "norm")
    kept = rows.withColumn("norm", F.lower(ws(F.col("text")))).join(drop, ["doc_id", "norm"], "left_anti")
    paras = reflow(kept, body_size(rows))
    out = paras.select("doc_id", "page_no", F.lit(0).alias("part"), F.col("para").cast("long").alias("k"), "text", F.format_string("page[%d]/p[%d]", "page_no", "para").alias("path"), "kind", F.lit(None).cast("string").alias("page"))
    cells = F.filter(F.transform("cells", lambda c: ws(c)), lambda c: c != "")
    t = tables.withColumn("text", F.array_join(cells, " | ")).where("text <> ''")
    out = out.unionByName(t.select("doc_id", "page_no", F.lit(1).alias("part"), (F.col("tbl") * 1_000_000 + F.col("row")).cast("long").alias("k"), "text", F.format_string("page[%d]/tbl[%d]/tr[%d]", "page_no", "tbl", "row").alias("path"), F.lit("table").alias("kind"), F.lit(None).cast("string").alias("page")))
    marked = rows.where(F.col("text").rlike(PAGE_OF)).select("doc_id").distinct()
    number = F.col("page_no").cast("string")
    folio = pages.join(marked, "doc_id", "left_anti")
    out = out.unionByName(folio.select("doc_id", "page_no", F.lit(2).alias("part"), F.lit(0).cast("long").alias("k"), number.alias("text"), F.format_string("page[%d]/folio", "page_no").alias("path"), F.lit("page").alias("kind"), number.alias("page")))
    order = Window.partitionBy("doc_id").orderBy("page_no", "part", "k")
    return out.select("doc_id", (F.row_number().over(order) - 1).cast("long").alias("ord"), "text", "path", "kind", "page")


def scanned(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """Documents without extractable text: likely scans, to be read by OCR first."""
    return pages.select("doc_id").distinct().join(blocks.where("kind <> 'page'").select("doc_id").distinct(), "doc_id", "left_anti")
