"""Views of the star-schema tables as blocks of documents, so every pass has rows to work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.blocks import blocks_from_text

#: A small house list, as a caller would supply (fixed values).
HOUSE = [("AN", "Army Navy"), ("ER", "Engineering Report"), ("IN", "Interface Note"), ("IT", "Integration Test"), ("OF", "Operational Fit"), ("ON", "Order Number"), ("TH", "Threshold"), ("THE", "Test Handling Equipment"), ("TO", "Technical Order")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks_from_text(table(spark, sf_dir, "documents"), "doc_id", "text")


def _rows(df: DataFrame, doc: str, ord_: str, text: str, kind: str = "'body'") -> DataFrame:
    return df.select(F.expr(doc).alias("doc_id"), F.expr(ord_).cast("long").alias("ord"), F.expr(text).alias("text"), F.expr(f"concat('row[', {ord_}, ']')").alias("path"), F.expr(kind).alias("kind"), F.lit(None).cast("string").alias("page"))


_LONG = "initcap(p_name)"
_SHORT = "upper(array_join(transform(split(p_name, ' '), w -> left(w, 1)), ''))"


def part_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand as a document; each part defines its name's acronym, even sizes with an X."""
    return _rows(table(spark, sf_dir, "part"), "p_brand", "p_partkey", f"concat('The ', {_LONG}, ' (', {_SHORT}, IF(p_size % 2 = 0, 'X', ''), ') is listed.')")


def part_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(table(spark, sf_dir, "part"), "p_brand", "p_partkey", f"concat('Use ', {_SHORT}, ' (', {_LONG}, ') here.')")


def part_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brand as a document: mostly glossary rows, with prose where the size is a multiple of four."""
    return _rows(table(spark, sf_dir, "part"), "p_brand", "p_partkey", f"IF(p_size % 4 = 0, concat({_LONG}, ' assembly'), concat({_SHORT}, ' | ', {_LONG}))", "IF(p_size % 3 = 0, 'table', 'body')")


def event_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user as a document, an event as a page marker."""
    return _rows(table(spark, sf_dir, "events"), "user_id", "event_id", "concat('Page ', get_json_object(props, '$.k'), ' of ', 100 + IF(event_id % 50 = 0, 1, 0))")


def event_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user as a document of 60 pages, an event as a reference to one."""
    events = table(spark, sf_dir, "events")
    totals = events.select("user_id").distinct()
    return _rows(events, "user_id", "event_id", "concat('Details: see page ', get_json_object(props, '$.k'), '.')").unionByName(_rows(totals, "user_id", "-1", "'Page 1 of 60'"))


def lineitem_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a document with a table of contents, closed by a heading at its third line."""
    items = table(spark, sf_dir, "lineitem")
    orders = items.select("l_orderkey").distinct()
    out = _rows(items, "l_orderkey", "l_linenumber * 100000 + l_suppkey", "IF(l_linenumber = 3, 'Introduction', concat('Part ', l_suppkey, ' ..... ', l_partkey))", "IF(l_linenumber = 3, 'heading', 'body')")
    return out.unionByName(_rows(orders, "l_orderkey", "-2", "'Page 1 of 1000'")).unionByName(_rows(orders, "l_orderkey", "-1", "'Contents'"))


def customer_orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation as a document, a customer as a sentence with an organisation in one of three forms."""
    return _rows(table(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", "concat('Supplied by ', initcap(c_mktsegment), ' Systems', element_at(array(', Inc.', ' Inc', ' LLC'), CAST(c_custkey % 3 + 1 AS INT)), ' today')")


def order_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a job, a customer as a session."""
    status = "CASE o_orderstatus WHEN 'O' THEN 'awaiting_model' WHEN 'P' THEN IF(o_orderkey % 2 = 0, 'judging', 'queued') ELSE IF(o_orderkey % 7 = 0, 'error', 'done') END"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("session"), F.expr(status).alias("status"), F.expr("unix_timestamp(o_orderdate)").alias("created"),
        F.expr("unix_timestamp(o_orderdate) + o_orderkey % 1000").alias("enqueued_at"), F.expr("o_orderpriority LIKE '5%'").alias("canceled"), F.expr("CAST(o_totalprice AS BIGINT)").alias("latency_ms"),
    )


def sessions_served(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session"), F.expr("c_custkey * 7919 % 1009").alias("seq"))
