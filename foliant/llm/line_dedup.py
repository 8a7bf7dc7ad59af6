"""Deduplication of passages by content-defined chunks of lines, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.scratch import Scratch

#: Chunks of fewer lines or characters than this aren't compared.
LEAST_LINES, LEAST_CHARS = 2, 40
#: A line of so many characters, some 50 words, is a passage of its own: chunks end before and after it, and it is compared alone.
LONG_LINE = 300
#: Tables of up to this many repeated chunks (some 100 bytes each) are broadcast, as counted.
BROADCAST_CHUNKS = 200_000
#: Stands before the letter that marks a chunk's end; one in a text is marked itself.
_MARK = "\u0001"
#: In place of the hash of a long line; above every hash.
_LONG = "~"


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed_chunks, n_removed_lines, clean_text.

    A window of three line hashes rolls over a text; a chunk ends after the
    line whose hash is the least of its window, and around lines of LONG_LINE
    characters. So a passage is cut alike wherever it stands, but for its first
    and last lines, and no chunk of short lines has only one of them inside a
    text. Chunks of LEAST_LINES lines and LEAST_CHARS characters, and long
    lines, that stand more than once in the whole table are removed but for
    the first place: the smallest doc_id, then the earliest chunk.

    The texts are cut once and the chunks saved with their 128-bit hashes.
    Hashes alone are counted over the table, after partial sums; only chunks
    whose hash repeats are compared byte by byte, grouped by hash and whole
    text, so a chunk in a third of all rows is a few rows in the shuffle. A
    hash that two different chunks share removes nothing. Places then join the
    repeated chunks by hash: by broadcast where these are counted few, else by
    shuffle, where adaptive execution splits a hot one.

    A null or empty text is one empty line and stays empty. Null ids come
    first and are told apart by text; rows that repeat id and text share one
    decision. Very long texts are rows like others. Columns that aren't named
    aren't read. An empty table gives no rows.
    """
    scratch = Scratch(df.sparkSession, "lines")
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = rows.select("doc_id", F.md5("text").alias("text_hash"), F.posexplode(_chunks("text")).alias("k", "bytes"))
    compared = ((_lines("bytes") >= LEAST_LINES) & (F.length("bytes") >= LEAST_CHARS)) | (F.length("bytes") >= LONG_LINE)
    parts = scratch.save(parts.where(compared).withColumn("chunk_hash", F.md5("bytes")))

    often = scratch.save(parts.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("chunk_hash"))
    near = F.broadcast if often.count() <= BROADCAST_CHUNKS else lambda x: x
    again = parts.join(near(often), "chunk_hash")
    place = F.struct("doc_id", "text_hash", "k")
    same = again.groupBy("chunk_hash", "bytes").agg(F.min(place).alias("first"))
    same = same.groupBy("chunk_hash").agg(F.count(F.lit(1)).alias("texts"), F.first("first").alias("stays"))
    repeated = scratch.save(same.where("texts = 1").select("chunk_hash", "stays"))
    gone = parts.select("doc_id", "text_hash", "k", "chunk_hash").join(near(repeated), "chunk_hash").where(~place.eqNullSafe(F.col("stays")))
    gone = scratch.save(gone.groupBy("doc_id", "text_hash").agg(F.collect_set("k").alias("gone")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "gone"))
    scratch.keep_only(gone)

    # Always by a merge, so that the plan is the same at every size.
    out = rows.withColumn("text_hash", F.md5("text")).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    # Only texts that lose something are cut again.
    out = out.withColumn("chunks", F.when(F.col("gone").isNotNull(), _chunks("text")))
    removed = F.expr("filter(chunks, (c, k) -> array_contains(gone, k))")
    stays = F.expr("filter(chunks, (c, k) -> NOT array_contains(gone, k))")
    return out.select(
        "doc_id", _lines("text").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_chunks"),
        F.when(F.col("gone").isNotNull(), _lines(F.array_join(removed, "\n"))).otherwise(F.lit(0)).cast("long").alias("n_removed_lines"),
        F.when(F.col("gone").isNotNull(), F.array_join(stays, "\n")).otherwise(F.col("text")).alias("clean_text"),
    )


def _chunks(text: str) -> Column:
    """The chunks of a text. All steps over lines are linear string and array operations: none looks up another computed array by place."""
    lines = F.split(F.replace(text, F.lit(_MARK), F.lit(_MARK + "a")), "\n")
    hashes = F.transform(F.split(text, "\n"), lambda line: F.when(F.length(line) >= LONG_LINE, F.lit(_LONG)).otherwise(F.md5(line)))
    around = F.zip_with(F.concat(F.array(F.lit("")), hashes), F.concat(F.slice(hashes, 2, 1 << 30), F.array(F.lit(""))), lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    ends = F.zip_with(hashes, around, lambda h, x: (h == _LONG) | (x["a"] == _LONG) | ((h < x["b"]) & (h < x["a"])))
    marked = F.zip_with(lines, ends, lambda line, end: F.concat(line, F.when(end, F.lit(_MARK + "b")).otherwise(F.lit(""))))
    joined = F.regexp_replace(F.array_join(F.filter(marked, lambda m: m.isNotNull()), "\n"), f"{_MARK}b\\z", "")
    return F.transform(F.split(joined, f"{_MARK}b\n"), lambda c: F.replace(c, F.lit(_MARK + "a"), F.lit(_MARK)))


def _lines(text: str | Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


ORACLE = f"""
WITH rows_ AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines_ AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM rows_),
hashed AS (SELECT *, CASE WHEN length(line) >= {LONG_LINE} THEN '{_LONG}' ELSE md5(line) END AS h FROM lines_),
cut AS (SELECT *, h = '{_LONG}' OR coalesce(lead(h) OVER w = '{_LONG}', false) OR (h < coalesce(lag(h) OVER w, '') AND h < coalesce(lead(h) OVER w, '')) AS ends FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM cut),
chunks AS (SELECT doc_id, any_value(n) AS n_lines, k, count(*) AS size, string_agg(line, chr(10) ORDER BY i) AS bytes FROM numbered GROUP BY doc_id, k),
judged AS (SELECT *, (size >= {LEAST_LINES} AND length(bytes) >= {LEAST_CHARS}) OR length(bytes) >= {LONG_LINE} AS compared FROM chunks),
ranked AS (SELECT *, row_number() OVER (PARTITION BY bytes, compared ORDER BY doc_id, k) AS place FROM judged),
decided AS (SELECT *, compared AND place > 1 AS gone FROM ranked)
SELECT doc_id, any_value(n_lines)::BIGINT AS n_lines, count(*) FILTER (gone) AS n_removed_chunks, coalesce(sum(size) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  coalesce(string_agg(bytes, chr(10) ORDER BY k) FILTER (NOT gone), '') AS clean_text
FROM decided GROUP BY doc_id
"""
