"""The registered queries over the driver's tables, and their SQL counterparts for DuckDB."""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import acronyms, counts, glossary, jobs, judgment, orgs, pages, phrases, spelling
from foliant.plans import adapters as A
from foliant.plans import findings as plans
from foliant.plans import report
from foliant.plans.tables import shared_folder
from foliant.sources import markup, pdf
from foliant.streaming import intake

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


_BLOCKS = r"""b AS (SELECT doc_id, ord, text FROM (
  SELECT doc_id, i AS ord, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)) WHERE text <> '')"""
_TOKENS = _BLOCKS + r""", t AS (SELECT doc_id, ord, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9&./''\-]*') AS t FROM b)"""
_STOP = _in(T.STOPWORDS)
_SIG = rf"(lower(w) NOT IN ({_STOP}) AND regexp_matches(w, '[A-Za-z]'))"
_SPEC = r"((regexp_matches(w, '[0-9]') AND regexp_matches(w, '[A-Za-z]')) OR regexp_matches(w, '^[-/.,()]*[A-Za-z][-/.,()]*$'))"
def _lead(column: str, k: int) -> str:
    return f"lead({column}, {k}) OVER w"


def _gram(n: int) -> str:
    """Rows of n tokens: w0.. are the tokens, x spec, p stopword, s significant, c capitalised and significant."""
    every = range(n)
    sig, caps = " + ".join(f"s{k}" for k in every), " + ".join(f"c{k}" for k in every)
    bad = " OR ".join(f"x{k}" for k in every)
    return (
        f"SELECT doc_id, ord, {n} AS n, i, concat_ws(' ', {', '.join(f'w{k}' for k in every)}) AS phrase FROM l WHERE w{n - 1} IS NOT NULL AND NOT ({bad}) AND NOT p0 AND NOT p{n - 1}"
        f" AND {sig} >= 2 AND {caps} >= greatest(2, ({sig} + 1) // 2)"
    )


_GRAMS = _TOKENS + rf""",
f AS (SELECT doc_id, ord, i, w, {_SPEC} AS x, lower(w) IN ({_STOP}) AS p, {_SIG}::INT AS s, ({_SIG} AND regexp_matches(w, '^[A-Z]'))::INT AS c
  FROM (SELECT doc_id, ord, unnest(t) AS w, unnest(range(len(t))) AS i FROM t)),
l AS (SELECT doc_id, ord, i, {', '.join(f'{_lead(c, k)} AS {c}{k}' for k in range(6) for c in 'wxpsc')} FROM f WINDOW w AS (PARTITION BY doc_id, ord ORDER BY i)),
o AS ({' UNION ALL '.join(_gram(n) for n in range(2, 7))}),
c AS (SELECT doc_id, phrase, count(*) AS n, min((ord, n, i)) AS first FROM o GROUP BY doc_id, phrase HAVING count(*) >= 2)"""
_KEPT = _GRAMS + """,
best AS (SELECT s.doc_id, s.phrase, max(b.n) AS best FROM c s JOIN c b ON s.doc_id = b.doc_id AND len(string_split(b.phrase, ' ')) > len(string_split(s.phrase, ' '))
  AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') GROUP BY s.doc_id, s.phrase),
v AS (SELECT c.*, best.best IS NOT NULL AND c.n - best.best < 3 AS dropped FROM c LEFT JOIN best USING (doc_id, phrase))"""


def _propose(phrase: str) -> str:
    return (
        f"list_aggregate(list_transform(list_filter(flatten(list_transform(list_filter(string_split({phrase}, ' '), lambda w: {_SIG}), lambda w: regexp_split_to_array(w, '[-/]'))),"
        " lambda p: regexp_matches(p, '^[A-Za-z]')), lambda p: upper(p[1])), 'string_agg', '')"
    )


@query(f"WITH {_BLOCKS} SELECT doc_id, ord, text FROM b")
def doc_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.document_blocks(spark, sf_dir).select("doc_id", "ord", "text")


@query(f"WITH {_TOKENS} SELECT doc_id, sum(len(t))::BIGINT AS n_tokens FROM t GROUP BY doc_id")
def tokens_per_doc(spark, sf_dir):
    return A.document_blocks(spark, sf_dir).groupBy("doc_id").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("n_tokens"))


@query(f"WITH {_GRAMS} SELECT doc_id, phrase, n AS uses FROM c")
def ngram_counts(spark, sf_dir):
    return phrases.phrase_counts(A.document_blocks(spark, sf_dir)).select("doc_id", "phrase", F.col("count").alias("uses"))


@query(f"WITH {_KEPT} SELECT doc_id, phrase, n AS uses FROM v WHERE dropped")
def suppressed_phrases(spark, sf_dir):
    c = phrases.phrase_counts(A.document_blocks(spark, sf_dir))
    kept = phrases.suppress(c).select("doc_id", "phrase")
    return c.join(kept, ["doc_id", "phrase"], "left_anti").select("doc_id", "phrase", F.col("count").alias("uses"))


@query(f"WITH {_KEPT} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, length(phrase) DESC, first)::INT AS rank, phrase, n AS uses, {_propose('phrase')} AS proposed FROM v WHERE NOT dropped AND n >= 3")
def recurring_phrases(spark, sf_dir):
    return phrases.recurring_phrases(A.document_blocks(spark, sf_dir)).withColumnRenamed("count", "uses")


@query(f"SELECT DISTINCT p_name, {_propose('p_name')} AS proposed FROM part")
def propose_acronym(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select("p_name").distinct().select("p_name", T.propose_acronym(F.col("p_name")).alias("proposed"))


# Letters beyond ASCII become an ASCII one, so that RE2's \b sees the words that Unicode's does.
_USES = _BLOCKS + r""", u AS (SELECT doc_id, rtrim(a, 's') AS acronym FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[^\x00-\x7F\P{L}]', 'x', 'g'), '\b([A-Z]{2,6}s?)\b', 1)) AS a FROM b))"""


@query(f"WITH {_USES} SELECT doc_id, acronym, count(*) AS uses FROM u GROUP BY doc_id, acronym")
def acronym_usage(spark, sf_dir):
    return acronyms.acronym_uses(A.document_blocks(spark, sf_dir))


_FREQ = r"d AS (SELECT lower(w) AS word, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+(?:[''\-][A-Za-z]+)*')) AS w FROM b) GROUP BY 1 HAVING count(*) >= 50)"


def _dictionary(blocks: DataFrame, least: int = 50) -> DataFrame:
    words = blocks.select(F.explode(T.words(F.col("text"))).alias("w")).groupBy(F.lower("w").alias("word"))
    return words.agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= least)


@query(f"WITH {_USES}, {_FREQ} SELECT doc_id, acronym, count(*) AS uses FROM u WHERE acronym NOT IN ({_in(T.COMMON_ACRONYMS)}) AND lower(acronym) NOT IN (SELECT word FROM d) GROUP BY doc_id, acronym")
def used_not_defined(spark, sf_dir):
    b = A.document_blocks(spark, sf_dir)
    return acronyms.used_not_defined(b, acronyms.definition_sets(b), _dictionary(b))


_LONG = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
_SHORT = "upper(array_to_string(list_transform(string_split(p_name, ' '), lambda w: w[1]), ''))"
_DEFS = f"e AS (SELECT p_brand AS doc_id, p_partkey AS ord, {_SHORT} || CASE WHEN p_size % 2 = 0 THEN 'X' ELSE '' END AS acronym, {_LONG} AS expansion FROM part)"


@query(f"WITH {_DEFS} SELECT doc_id, ord, acronym, expansion FROM e")
def definitions(spark, sf_dir):
    return acronyms.definitions(A.part_definitions(spark, sf_dir)).select("doc_id", "ord", "acronym", "expansion")


@query(f"SELECT p_brand AS doc_id, p_partkey AS ord, {_SHORT} AS acronym, {_LONG} AS expansion FROM part")
def reverse_definitions(spark, sf_dir):
    return acronyms.reverse_definitions(A.part_reverse(spark, sf_dir)).select("doc_id", "ord", "acronym", "expansion")


@query(f"WITH {_DEFS} SELECT doc_id, acronym, count(DISTINCT lower(expansion)) AS n_expansions, string_agg(DISTINCT expansion, '; ' ORDER BY expansion) AS detail FROM e GROUP BY doc_id, acronym HAVING count(DISTINCT lower(expansion)) > 1")
def conflicting_expansions(spark, sf_dir):
    return acronyms.conflicting_expansions(acronyms.definition_sets(A.part_definitions(spark, sf_dir)))


@query(f"WITH {_DEFS} SELECT doc_id, string_agg(DISTINCT acronym, '/' ORDER BY acronym) AS acronyms, lower(expansion) AS expansion FROM e GROUP BY doc_id, lower(expansion) HAVING count(DISTINCT acronym) > 1")
def multi_acronym_term(spark, sf_dir):
    return acronyms.multiple_acronyms(acronyms.definition_sets(A.part_definitions(spark, sf_dir)))


_PAIRS = f"p AS (SELECT p_brand AS doc_id, p_partkey AS ord, p_size % 4 <> 0 AS pair, p_size % 3 = 0 AS tab, {_SHORT} AS acronym, {_LONG} AS expansion FROM part)"
_RUNS = _PAIRS + """, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS pos FROM p),
r AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS island FROM q WHERE pair),
z AS (SELECT doc_id, island, min(pos) - 1 AS run, count(*) AS n_rows, CASE WHEN bool_and(tab) THEN 3 ELSE 4 END AS need FROM r GROUP BY doc_id, island)"""


@query(f"WITH {_PAIRS} SELECT doc_id, ord, acronym, expansion FROM p WHERE pair")
def glossary_pairs(spark, sf_dir):
    return glossary.glossary_pairs(A.part_glossary(spark, sf_dir)).select("doc_id", "ord", "acronym", "expansion")


@query(f"WITH {_RUNS} SELECT doc_id, run, n_rows, need FROM z WHERE n_rows >= need")
def glossary_runs(spark, sf_dir):
    return glossary.glossary_runs(A.part_glossary(spark, sf_dir))


@query(f"WITH {_RUNS} SELECT doc_id, acronym, arg_min(expansion, ord) AS expansion, 'harvested' AS origin FROM r JOIN z USING (doc_id, island) WHERE n_rows >= need GROUP BY doc_id, acronym")
def glossary_table(spark, sf_dir):
    return glossary.glossary(A.part_glossary(spark, sf_dir))


def _boundary(key: str) -> str:
    """RE2 has no lookaround: each mark is doubled, so that neighbouring hits don't share one."""
    return f"(^|[^A-Za-z0-9])({key})([^A-Za-z0-9]|$)"


_DOUBLE = "regexp_replace(text, '([^A-Za-z0-9])', '\\1\\1', 'g')"
_HITS = _BLOCKS + f""", h AS (SELECT doc_id, unnest(regexp_extract_all({_DOUBLE}, '{_boundary("|".join(sorted((k for k, _ in A.HOUSE), key=lambda k: (-len(k), k))))}', 2)) AS acronym FROM b)"""


@query(f"WITH {_HITS}, m(acronym, expansion) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)})' for k, v in A.HOUSE)}) SELECT DISTINCT doc_id, acronym, expansion FROM h JOIN m USING (acronym)")
def house_acronym_merge(spark, sf_dir):
    b = A.document_blocks(spark, sf_dir)
    return acronyms.house_merge(b, glossary.glossary(b.limit(0)), A.HOUSE)


@query(rf"SELECT doc_id, len(regexp_extract_all({_DOUBLE}, '{_boundary('THE')}', 2))::BIGINT AS the_count, len(regexp_extract_all({_DOUBLE}, '{_boundary('In')}', 2))::BIGINT AS in_count FROM documents")
def count_acronym(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", counts.count_acronym(F.col("text"), F.lit("THE")).alias("the_count"), counts.count_acronym(F.col("text"), F.lit("In")).alias("in_count"))


_SPACES = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '([^A-Za-z0-9 ]| )', '\1\1', 'g')"


@query(rf"SELECT doc_id, len(regexp_extract_all({_SPACES}, '(?i){_boundary('of  the')}', 2))::BIGINT AS uses FROM documents")
def count_phrase(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", counts.count_phrase(F.col("text"), F.lit("of the")).alias("uses"))


_TABLE = "x(acronym, expansion) AS (VALUES ('THE', 'of the'), ('IN', 'in the'), ('ON', 'on the'))"


@query(
    rf"""WITH {_TABLE}, s AS (SELECT doc_id, {_DOUBLE} AS d, {_SPACES} AS p FROM documents),
h AS (SELECT doc_id, unnest(regexp_extract_all(d, '{_boundary('THE|IN|ON')}', 2)) AS acronym FROM s), k AS (SELECT doc_id, acronym, count(*) AS n FROM h GROUP BY ALL),
e AS (SELECT doc_id, acronym, expansion, CASE acronym WHEN 'THE' THEN len(regexp_extract_all(p, '(?i){_boundary('of  the')}', 2)) WHEN 'IN' THEN len(regexp_extract_all(p, '(?i){_boundary('in  the')}', 2))
  ELSE len(regexp_extract_all(p, '(?i){_boundary('on  the')}', 2)) END AS expansion_count FROM s, x)
SELECT doc_id, acronym, expansion, coalesce(n, 0) AS acronym_count, expansion_count::BIGINT AS expansion_count FROM e LEFT JOIN k USING (doc_id, acronym)"""
)
def acronym_table_counts(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = F.array(*[F.struct(F.lit(a).alias("acronym"), F.lit(e).alias("expansion")) for a, e in (("THE", "of the"), ("IN", "in the"), ("ON", "on the"))])
    return counts.annotate_counts(d.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*"), d)


_PAGES = "s AS (SELECT user_id AS doc_id, event_id AS ord, CAST(json_extract_string(props, '$.k') AS BIGINT) AS n, 100 + CASE WHEN event_id % 50 = 0 THEN 1 ELSE 0 END AS y FROM events)"
_STEPS = _PAGES + ", w AS (SELECT *, lag(n) OVER (PARTITION BY doc_id ORDER BY ord) AS prev, row_number() OVER (PARTITION BY doc_id, n ORDER BY ord) > 1 AS again FROM s)"


@query(f"WITH {_PAGES} SELECT doc_id, ord, n FROM s")
def page_sequence(spark, sf_dir):
    return pages.page_sequence(A.event_pages(spark, sf_dir)).select("doc_id", "ord", "n")


def _issues(spark, sf_dir, problem):
    return pages.sequence_issues(A.event_pages(spark, sf_dir)).where(F.col("problem") == problem).select("doc_id", "ord", "n", "prev")


@query(f"WITH {_STEPS} SELECT doc_id, ord, n, prev FROM w WHERE again")
def page_duplicates(spark, sf_dir):
    return _issues(spark, sf_dir, "duplicate_page_number")


@query(f"WITH {_STEPS} SELECT doc_id, ord, n, prev FROM w WHERE n > prev + 1")
def page_gaps(spark, sf_dir):
    return _issues(spark, sf_dir, "page_gap")


@query(f"WITH {_STEPS} SELECT doc_id, ord, n, prev FROM w WHERE n < prev")
def page_out_of_order(spark, sf_dir):
    return _issues(spark, sf_dir, "out_of_order_page")


@query(f"WITH {_PAGES} SELECT doc_id, count(DISTINCT y) AS n_totals, string_agg(DISTINCT y::VARCHAR, ', ' ORDER BY y::VARCHAR) AS totals FROM s GROUP BY doc_id HAVING count(DISTINCT y) > 1")
def inconsistent_total(spark, sf_dir):
    return pages.inconsistent_totals(A.event_pages(spark, sf_dir))


@query(f"WITH {_PAGES} SELECT doc_id, ord, n, 60::BIGINT AS total FROM s WHERE n < 1 OR n > 60")
def xref_out_of_range(spark, sf_dir):
    return pages.xref_issues(A.event_references(spark, sf_dir)).select("doc_id", "ord", "n", "total")


_TOC = "l AS (SELECT l_orderkey AS doc_id, l_linenumber * 100000 + l_suppkey AS ord, l_linenumber, l_suppkey, l_partkey FROM lineitem), h AS (SELECT doc_id, min(ord) AS ends FROM l WHERE l_linenumber = 3 GROUP BY doc_id), y AS (SELECT l.* FROM l LEFT JOIN h USING (doc_id) WHERE l_linenumber <> 3 AND (ends IS NULL OR ord < ends))"


@query(f"WITH {_TOC} SELECT doc_id, ord, 'Part ' || l_suppkey AS title, l_partkey AS n FROM y")
def toc_region(spark, sf_dir):
    return pages.toc_entries(A.lineitem_contents(spark, sf_dir)).select("doc_id", "ord", "title", "n")


@query(f"WITH {_TOC} SELECT doc_id, ord, 'Part ' || l_suppkey AS title, l_partkey AS n, 1000::BIGINT AS total FROM y WHERE l_partkey > 1000")
def toc_out_of_range(spark, sf_dir):
    return pages.toc_issues(A.lineitem_contents(spark, sf_dir)).select("doc_id", "ord", "title", "n", "total")


_ORGS = """m AS (SELECT c_nationkey AS doc_id, c_custkey AS ord, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Systems' || [', Inc', ' Inc', ' LLC'][c_custkey % 3 + 1] AS surface,
  lower(c_mktsegment) || ' systems' AS key FROM customer), s AS (SELECT doc_id, key, surface, count(*) AS n, min(ord) AS first FROM m GROUP BY ALL)"""


@query(f"WITH {_ORGS} SELECT doc_id, key, surface, n AS mentions FROM s")
def org_surfaces(spark, sf_dir):
    return orgs.org_surfaces(A.customer_orgs(spark, sf_dir)).select("doc_id", "key", "surface", F.col("count").alias("mentions"))


@query(f"WITH {_ORGS} SELECT doc_id, key, count(*) AS n_surfaces, sum(n)::BIGINT AS mentions, arg_max(surface, (n, -first)) AS top FROM s GROUP BY doc_id, key")
def org_clusters(spark, sf_dir):
    return orgs.org_clusters(A.customer_orgs(spark, sf_dir))


@query(f"WITH {_ORGS} SELECT doc_id, key, count(*) AS n_surfaces, string_agg(surface || ' x' || n, '; ' ORDER BY surface) AS forms FROM s GROUP BY doc_id, key HAVING count(*) > 1")
def inconsistent_org_form(spark, sf_dir):
    return orgs.inconsistent_forms(A.customer_orgs(spark, sf_dir))


@query(f"WITH {_ORGS} SELECT doc_id, key, arg_max(surface, (n, -first)) AS top FROM s WHERE key <> 'machinery systems' GROUP BY doc_id, key")
def wrong_customer(spark, sf_dir):
    return orgs.wrong_customers(A.customer_orgs(spark, sf_dir), "Machinery Systems, Inc.")


_WORD_SQL = r"'[A-Za-z]+(?:[''\-][A-Za-z]+)*'"
_ALLOW = rf"a AS (SELECT DISTINCT doc_id, lower(w) AS word FROM (SELECT doc_id, unnest(regexp_extract_all(phrase, {_WORD_SQL})) AS w FROM v WHERE NOT dropped AND n >= 3))"


@query(f"WITH {_KEPT}, {_ALLOW} SELECT doc_id, word FROM a")
def allowlist(spark, sf_dir):
    found = phrases.recurring_phrases(A.document_blocks(spark, sf_dir)).select("doc_id", F.col("phrase").alias("text"))
    return spelling.allowlist(found)


# The same rules as a plain comparison of every first word with every dictionary word.
_SPELL = (
    rf"""{_FREQ},
w AS (SELECT doc_id, ord, raw, pos, lower(raw) AS low FROM (SELECT doc_id, ord, unnest(l) AS raw, unnest(range(len(l))) AS pos FROM (SELECT doc_id, ord, regexp_extract_all(text, {_WORD_SQL}) AS l FROM b)) WHERE length(raw) > 3 AND upper(raw) <> raw),
f AS (SELECT doc_id, low, arg_min(raw, (ord, pos)) AS raw, min((ord, pos)) AS spot FROM w GROUP BY doc_id, low),
e AS (SELECT *, CASE WHEN low LIKE '%es' THEN raw[:-3] WHEN low LIKE '%s' THEN raw[:-2] ELSE raw END AS stem FROM f),
u AS (SELECT * FROM e WHERE NOT (length(stem) >= 2 AND upper(stem) = stem AND regexp_matches(stem, '[A-Za-z]')) AND low NOT IN (SELECT word FROM d)
  AND NOT (low LIKE '%s' AND low[:-2] IN (SELECT word FROM d))),
p AS (SELECT *, list_filter(string_split(low, '-'), lambda x: x <> '') AS parts FROM u),
k AS (SELECT DISTINCT low FROM p), dw AS (SELECT word, freq, length(word) AS len FROM d),
c AS (SELECT low, arg_min(word, (-freq, word)) AS suggestion FROM k JOIN dw ON len BETWEEN length(low) - 1 AND length(low) + 1 WHERE damerau_levenshtein(low, word) = 1 GROUP BY low),
q AS (SELECT doc_id, spot, raw, suggestion, low, parts, list_contains([{_in(spelling.PREFIXES)}], parts[1]) AND array_to_string(parts[2:], '-') IN (SELECT word FROM d) AS prefixed,
  len(list_filter(parts, lambda x: NOT list_contains(known, x))) = 0 AS compound FROM p JOIN c USING (low), (SELECT list(word) AS known FROM d)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY spot) AS k FROM q WHERE NOT (contains(low, '-') AND (prefixed OR compound OR suggestion = replace(low, '-', ''))))"""
)


@query(f"WITH {_BLOCKS}, {_SPELL} SELECT doc_id, raw AS word, suggestion FROM r WHERE k <= 200")
def spelling_candidates(spark, sf_dir):
    b = A.document_blocks(spark, sf_dir)
    return spelling.spelling_words(b, _dictionary(b)).select("doc_id", "word", "suggestion")


_JOBS = """j AS (SELECT o_orderkey AS job_id, o_custkey AS session, CASE o_orderstatus WHEN 'O' THEN 'awaiting_model' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'judging' ELSE 'queued' END
  ELSE CASE WHEN o_orderkey % 7 = 0 THEN 'error' ELSE 'done' END END AS status, CAST(epoch(o_orderdate) AS BIGINT) AS created, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 1000 AS enqueued_at,
  o_orderpriority LIKE '5%' AS canceled, CAST(trunc(o_totalprice) AS BIGINT) AS latency_ms FROM orders)"""
_FAIR = _JOBS + ", q AS (SELECT job_id, session, row_number() OVER (ORDER BY coalesce(c_custkey * 7919 % 1009, 0), enqueued_at, job_id) - 1 AS position FROM j LEFT JOIN customer ON session = c_custkey WHERE status = 'awaiting_model' AND NOT canceled)"
_AVG = "l AS (SELECT job_id, created AS finished, avg(latency_ms) OVER (ORDER BY created, job_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg_ms FROM j WHERE status = 'done')"


@query(f"WITH {_FAIR} SELECT job_id, session, position FROM q")
def fair_order(spark, sf_dir):
    return jobs.fair_order(A.order_jobs(spark, sf_dir), A.sessions_served(spark, sf_dir))


@query(f"WITH {_JOBS}, {_AVG} SELECT job_id, finished, round(avg_ms, 6) AS avg_ms FROM l")
def rolling_latency(spark, sf_dir):
    done = A.order_jobs(spark, sf_dir).where("status = 'done'").withColumnRenamed("created", "finished")
    return jobs.rolling_latency(done).withColumn("avg_ms", F.round("avg_ms", 6))


@query(f"WITH {_FAIR}, {_AVG}, a AS (SELECT avg_ms FROM l ORDER BY finished DESC, job_id DESC LIMIT 1), n AS (SELECT count(*) AS judging FROM j WHERE status = 'judging') SELECT job_id, position, CAST(trunc(((position + judging) // 2) * avg_ms + avg_ms) AS BIGINT) AS eta_ms FROM q, a, n")
def queue_position_eta(spark, sf_dir):
    j = A.order_jobs(spark, sf_dir)
    avg = jobs.rolling_latency(j.where("status = 'done'").withColumnRenamed("created", "finished")).orderBy(F.desc("finished"), F.desc("job_id")).limit(1)
    return jobs.positions_and_waits(j, A.sessions_served(spark, sf_dir), avg, lanes=2)


@query(f"WITH {_JOBS} SELECT session, count(*) FILTER (status IN ({_in(jobs.ACTIVE)})) AS active, count(*) FILTER (status = 'awaiting_model') AS waiting, count(*) FILTER (status = 'judging') AS judging FROM j GROUP BY session")
def active_caps(spark, sf_dir):
    return jobs.active_counts(A.order_jobs(spark, sf_dir))


@query(f"WITH {_JOBS}, t AS (SELECT job_id, row_number() OVER (ORDER BY created, job_id) AS age FROM j WHERE status IN ({_in(jobs.TERMINAL)})) SELECT job_id FROM t WHERE age <= (SELECT count(*) FROM j) - 10000")
def prune_jobs(spark, sf_dir):
    return jobs.pruned(A.order_jobs(spark, sf_dir), 10_000)


@query(f"WITH {_JOBS} SELECT job_id FROM j WHERE 1000000000 - created > 43200 AND status NOT IN ({_in(jobs.ACTIVE)})")
def reap_expired(spark, sf_dir):
    j = A.order_jobs(spark, sf_dir)
    return jobs.expired(j.select("job_id", F.col("created").alias("modified")), j, 1_000_000_000)


def _word_geometry(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Documents as pages of 40 lines of text with a running header and a folio, each word with a place."""
    b = A.document_blocks(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "text"), "ord")
    b = b.select("doc_id", (F.col("ord").cast("int") * 1000 + F.expr("pos div 12")).alias("row"), F.expr("pos % 12").alias("col"), "text")
    words = b.select("doc_id", F.expr("1 + (row div 1000) div 4").cast("int").alias("page_no"), (F.col("col") * 40.0).alias("x0"), (F.col("col") * 40.0 + 38).alias("x1"), (100 + F.expr("(row div 1000) % 4") * 150.0 + F.expr("row % 1000") * 12.0 + F.expr("col % 3")).alias("top"), F.lit(10.0).alias("size"), "text")
    words = words.withColumn("bottom", F.col("top") + 10)
    pages_ = words.select("doc_id", "page_no").distinct().withColumn("height", F.lit(800.0))
    header = pages_.select("doc_id", "page_no", F.posexplode(F.array(F.lit("Running"), F.lit("Header"))).alias("p", "text")).select("doc_id", "page_no", (F.col("p") * 60.0).alias("x0"), (F.col("p") * 60.0 + 50).alias("x1"), F.lit(20.0).alias("top"), F.lit(8.0).alias("size"), "text", F.lit(30.0).alias("bottom"))
    return words.unionByName(header), pages_


_PDF = _BLOCKS + """,
pw AS (SELECT doc_id, 1 + (row // 1000) // 4 AS page_no, col, (100 + ((row // 1000) % 4) * 150 + (row % 1000) * 12)::DOUBLE AS base, w
  FROM (SELECT doc_id, ord * 1000 + pos // 12 AS row, pos % 12 AS col, w FROM (SELECT doc_id, ord, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM b))),
pl AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY top) - 1)::INT AS line FROM (
  SELECT doc_id, page_no::INT AS page_no, base AS top, 10.0::DOUBLE AS size, string_agg(w, ' ' ORDER BY col, base + col % 3, w) AS text FROM pw GROUP BY doc_id, page_no, base
  UNION ALL SELECT DISTINCT doc_id, page_no::INT, 20.0, 8.0, 'Running Header' FROM pw)),
pb AS (SELECT doc_id, list_sort(list(size))[count(*) // 2 + 1] AS body FROM pl GROUP BY doc_id)"""


@query(f"WITH {_PDF} SELECT doc_id, page_no, line, text, size, top FROM pl")
def pdf_lines(spark, sf_dir):
    return pdf.lines(_word_geometry(spark, sf_dir)[0])


@query(f"WITH {_PDF} SELECT doc_id, body FROM pb")
def pdf_body_size(spark, sf_dir):
    return pdf.body_size(pdf.lines(_word_geometry(spark, sf_dir)[0]))


@query(
    rf"""WITH {_PDF}, n AS (SELECT doc_id, count(DISTINCT page_no) AS n FROM pl GROUP BY doc_id HAVING count(DISTINCT page_no) >= 4)
SELECT doc_id, lower(text) AS norm, count(DISTINCT page_no) AS n_pages FROM pl JOIN n USING (doc_id) WHERE (top <= 96 OR top >= 704) AND NOT regexp_matches(text, '(?i)\bPage\s+\d+\s+of\s+\d+\b')
GROUP BY doc_id, lower(text), n HAVING count(DISTINCT page_no) >= greatest(4, floor(n * 0.6))"""
)
def pdf_boilerplate(spark, sf_dir):
    words, pages_ = _word_geometry(spark, sf_dir)
    return pdf.boilerplate(pdf.lines(words), pages_)


@query(
    rf"""WITH {_PDF}, h AS (SELECT *, len(string_split(text, ' ')) <= 14 AND (size >= body * 1.15 OR (regexp_matches(text, '^\d+(?:\.\d+){{0,4}}\.?\s+\S') AND length(text) <= 90)
    OR (upper(text) = text AND lower(text) <> text AND length(text) BETWEEN 2 AND 60)) AS head FROM pl JOIN pb USING (doc_id)),
s AS (SELECT *, (head OR coalesce(top - lag(top) OVER w > body * 1.2 * 1.7, false) OR coalesce(lag(head) OVER w, false))::INT AS new FROM h WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY line)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_no ORDER BY line) AS island FROM s),
p AS (SELECT doc_id, page_no, island, replace(regexp_replace(string_agg(text, chr(1) ORDER BY line), '-\x01(\p{{Ll}})', '\1', 'g'), chr(1), ' ') AS text, bool_or(head) AS head FROM i GROUP BY ALL)
SELECT doc_id, page_no, (row_number() OVER (PARTITION BY doc_id, page_no ORDER BY island) - 1)::INT AS para, text, CASE WHEN lower(text) IN ('table of contents', 'contents') THEN 'toc' WHEN head THEN 'heading' ELSE 'body' END AS kind FROM p"""
)
def pdf_reflow(spark, sf_dir):
    rows = pdf.lines(_word_geometry(spark, sf_dir)[0])
    return pdf.reflow(rows, pdf.body_size(rows))


_XML_LINES = r"""l AS (SELECT doc_id, i, n, trim(regexp_replace(line, '\s+', ' ', 'g')) AS text FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS n FROM documents))"""


@query(
    f"""WITH {_XML_LINES}, r AS (SELECT doc_id, 0 AS i, 'Document ' || doc_id AS text, 'title' AS path, 'heading' AS kind, NULL AS page FROM documents
  UNION ALL SELECT doc_id, i, text, CASE WHEN n > 1 THEN 'section/p[' || i || ']' ELSE 'section/p' END, 'body', NULL FROM l WHERE text <> ''
  UNION ALL SELECT doc_id, 1000000, (doc_id % 90)::VARCHAR, 'section/pageno', 'page', (doc_id % 90)::VARCHAR FROM documents)
SELECT doc_id || '.xml' AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, text, path, kind, page FROM r"""
)
def xml_walk(spark, sf_dir):
    """Documents as XML files, in turn in UTF-8, in UTF-16 and in ASCII with character references."""
    d = A.table(spark, sf_dir, "documents").select("doc_id", "text")
    body = F.concat(F.lit("<manual><title>Document "), "doc_id", F.lit("</title><section>"), F.array_join(F.transform(F.split(_escaped("text"), "\n"), lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), ""), F.lit("<pageno>"), F.col("doc_id") % 90, F.lit("</pageno></section></manual>"))
    wide = F.encode(F.concat(F.lit('<?xml version="1.0" encoding="UTF-16"?>'), body), "UTF-16")
    latin = F.encode(F.concat(F.lit('<?xml version="1.0" encoding="ISO-8859-1"?>'), body), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, body.cast("binary")).when((F.col("doc_id") % 3 == 1) | body.rlike(r"[^\x00-\xFF]"), wide).otherwise(latin)
    return markup.parse_files(d.select(F.concat("doc_id", F.lit(".xml")).alias("path"), content.alias("content")))[0]


def _escaped(column: str):
    return F.replace(F.replace(F.replace(F.col(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def _as_docx(frames):
    """Files of doc_id and text in the docx format: a heading, a paragraph or a table row for each line, and a footer with a page total."""
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    run = "<w:r><w:t xml:space='preserve'>{}</w:t></w:r>".format
    for frame in frames:
        out = []
        for doc, text in zip(frame["doc_id"], frame["text"]):
            lines = [escape(line) for line in text.split("\n")]
            head = f"<w:p><w:pPr><w:pStyle w:val='H1'/></w:pPr>{run(f'Document {doc}')}</w:p>"
            body = "".join(f"<w:p>{run(x)}</w:p>" for x in lines[:-1])
            last = f"<w:tbl><w:tr><w:tc><w:p>{run('Last')}</w:p></w:tc><w:tc><w:p>{run(lines[-1])}</w:p></w:tc></w:tr></w:tbl>"
            parts = {
                "word/document.xml": f"<w:document {space}><w:body>{head}{body}{last}<w:sectPr><w:footerReference w:type='default' r:id='f'/></w:sectPr></w:body></w:document>",
                "word/styles.xml": f"<w:styles {space}><w:style w:styleId='H1'><w:name w:val='heading 1'/></w:style></w:styles>",
                "word/footer1.xml": f"<w:ftr {space}><w:p>{run(f'Page 1 of {doc % 90 + 1}')}</w:p></w:ftr>",
                "word/_rels/document.xml.rels": "<Relationships><Relationship Id='f' Type='http://x/footer' Target='footer1.xml'/></Relationships>",
            }
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w") as archive:
                for name, content in parts.items():
                    archive.writestr(name, content)
            out.append((f"{doc}.docx", held.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query(
    f"""WITH {_XML_LINES}, r AS (SELECT doc_id, 0 AS i, 'Document ' || doc_id AS text, 'body/p[0]' AS path, 'heading' AS kind FROM documents
  UNION ALL SELECT doc_id, i, text, 'body/p[' || i || ']', CASE WHEN lower(text) IN ('table of contents', 'contents') THEN 'toc' ELSE 'body' END FROM l WHERE text <> '' AND i < n
  UNION ALL SELECT doc_id, i, 'Last' || CASE WHEN text <> '' THEN ' | ' || text ELSE '' END, 'body/tbl[' || i || ']/tr[0]', 'table' FROM l WHERE i = n
  UNION ALL SELECT doc_id, 1000000, 'Page 1 of ' || (doc_id % 90 + 1), 'sections/pagination', 'page' FROM documents)
SELECT doc_id || '.docx' AS doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord, text, path, kind FROM r"""
)
def docx_blocks(spark, sf_dir):
    """Documents written as docx files and read again."""
    files = A.table(spark, sf_dir, "documents").select("doc_id", "text").mapInPandas(_as_docx, "path string, content binary")
    return markup.parse_files(files)[0].drop("page")


_SUFFIXES = (".xml", ".DOCX", ".pdf", ".txt", "")


@query(
    f"""SELECT p_partkey || s AS path, CASE WHEN lower(s) NOT IN ('.xml', '.docx', '.pdf') THEN 'unsupported file type' WHEN p_size % 7 = 0 THEN 'empty file' WHEN p_size % 11 = 0 THEN 'file too large' END AS reason
FROM (SELECT *, [{_in(_SUFFIXES)}][p_partkey % 5 + 1] AS s FROM part)"""
)
def intake_checks(spark, sf_dir):
    """Parts as files that come in, some of a kind or size that is refused."""
    suffix = F.element_at(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("p_partkey") % 5 + 1).cast("int"))
    size = F.when(F.col("p_size") % 7 == 0, 0).when(F.col("p_size") % 11 == 0, markup.MAX_UPLOAD + 1).otherwise(100).cast("long")
    files = A.table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), suffix).alias("path"), size.alias("length"))
    return intake.admissible(files).select("path", "reason")


def _part_findings(spark, sf_dir):
    b = A.part_definitions(spark, sf_dir)
    words = A.table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).groupBy(F.lower("w").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
    return b, plans.gather(b, words, A.HOUSE)


# The same passes over the parts' definitions.
_PART = (
    _KEPT.replace(_BLOCKS, f"b AS (SELECT p_brand AS doc_id, p_partkey AS ord, 'The ' || {_LONG} || ' (' || {_SHORT} || CASE WHEN p_size % 2 = 0 THEN 'X' ELSE '' END || ') is listed.' AS text FROM part)")
    + f""", {_DEFS},
x AS (SELECT doc_id, acronym, list_sort(list(DISTINCT expansion)) AS expansions, count(*) AS uses FROM e GROUP BY doc_id, acronym),
ex AS (SELECT doc_id, string_agg(acronym || '=' || array_to_string(expansions, '/'), '; ' ORDER BY acronym) AS existing, count(*) AS n_existing FROM x GROUP BY doc_id),
iss AS (SELECT doc_id, 'conflicting_expansions' AS problem, acronym, array_to_string(expansions, '; ') AS detail FROM x WHERE len(expansions) > 1
  UNION ALL SELECT doc_id, 'multiple_acronyms_one_term', string_agg(DISTINCT acronym, '/' ORDER BY acronym), lower(expansion) FROM e GROUP BY doc_id, lower(expansion) HAVING count(DISTINCT acronym) > 1),
isj AS (SELECT doc_id, string_agg(problem || ' ' || acronym || ': ' || detail, ' & ' ORDER BY problem, acronym, detail) AS issues, count(*) AS n_issues FROM iss GROUP BY doc_id),
ph AS (SELECT doc_id, string_agg(phrase || ' x' || n, ' & ' ORDER BY n DESC, length(phrase) DESC, first) AS phrases FROM v WHERE NOT dropped AND n >= 3 GROUP BY doc_id),
dd AS (SELECT DISTINCT doc_id FROM e)"""
)
_FOUND = "recurring_phrases array<struct<phrase string, count long>>, acronym_issues array<struct<acronym string, problem string, detail string>>, existing_acronyms map<string, array<string>>"


@query(f"WITH {_PART} SELECT doc_id, coalesce(existing, '') AS existing, coalesce(issues, '') AS issues, coalesce(phrases, '') AS phrases FROM dd LEFT JOIN ex USING (doc_id) LEFT JOIN isj USING (doc_id) LEFT JOIN ph USING (doc_id)")
def findings(spark, sf_dir):
    """What the findings' JSON holds, read back from it."""
    told = report.findings_json(*_part_findings(spark, sf_dir)).select("doc_id", F.from_json("json", _FOUND).alias("f")).select("doc_id", "f.*")
    entries = F.array_sort(F.transform(F.map_entries("existing_acronyms"), lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["value"], "/"))))
    issues = F.transform("acronym_issues", lambda x: F.concat(x["problem"], F.lit(" "), x["acronym"], F.lit(": "), x["detail"]))
    found = F.transform("recurring_phrases", lambda x: F.concat(x["phrase"], F.lit(" x"), x["count"]))
    return told.select("doc_id", *[F.coalesce(F.array_join(c, sep), F.lit("")).alias(name) for c, sep, name in ((entries, "; ", "existing"), (issues, " & ", "issues"), (found, " & ", "phrases"))])


_REPORT = (
    f"WITH {_PART}"
    + f""", u AS (SELECT x.doc_id, x.acronym, expansions, uses, (SELECT count(*) FROM e WHERE e.doc_id = x.doc_id AND lower(e.expansion) = lower(x.expansions[1])) AS spelt FROM x),
tb AS (SELECT doc_id, string_agg('| ' || concat_ws(' | ', acronym, expansions[1], 'existing', uses, spelt, CASE WHEN len(expansions) > 1 THEN 'also: ' || array_to_string(expansions[2:], '; ') ELSE '' END) || ' |', chr(10) ORDER BY acronym) AS rows_ FROM u GROUP BY doc_id),
il AS (SELECT doc_id, string_agg('- `' || acronym || '` — ' || problem || ': ' || detail, chr(10) ORDER BY upper(acronym), problem, acronym, detail) AS lines FROM iss GROUP BY doc_id)
SELECT doc_id, replace('# Proofreading report@@{report.SKIPPED}@@## Acronym table  _(deterministic; uses are exact counts from the document)_@@', '@', chr(10)) || replace('{report.TABLE_HEAD}', '\\n', chr(10)) || rows_ || repeat(chr(10), 2)
  || coalesce(replace('## Acronym issues@@', '@', chr(10)) || lines || repeat(chr(10), 2), '') || '> {plans.NOTE.replace("'", "''")}' || replace('@@## Customer name@@@@## Analysis provenance@@- Model pass skipped.@', '@', chr(10)) AS report
FROM tb LEFT JOIN il USING (doc_id)"""
)


@query(_REPORT)
def markdown_report(spark, sf_dir):
    return report.render(*_part_findings(spark, sf_dir))


def _stand_in():
    """A model without a network: it answers from the payload; by the number of acronyms, its first answer is whole, cut off, unreadable or of the wrong shape."""

    def call(messages, tokens):
        found = json.loads(messages[1]["content"].partition("Findings:\n")[2])
        table = [{"acronym": a, "expansion": e[0], "status": "existing"} for a, e in sorted((found.get("existing_acronyms") or {}).items())]
        whole = {"acronym_table": table, "acronym_issues": found.get("acronym_issues") or [], "misspellings": [], "customer": {"primary": "Acme"}}
        first = len(messages) == 2 and tokens == judgment.MAX_TOKENS
        fault = len(table) % 4 if first else 0
        said = {0: json.dumps(whole), 1: json.dumps(whole)[:-9], 2: "I can't say.", 3: json.dumps({**whole, "customer": "Acme"})}[fault]
        return said, "length" if fault == 1 else "stop", {"completion_tokens": 1}, "stand-in", "none"

    return call


@query(
    f"""WITH {_PART} SELECT doc_id, n_existing AS n_rows, coalesce(n_issues, 0) AS n_issues, ['', 'truncation', 'repair', 'validation'][n_existing % 4 + 1] AS second_try, CASE WHEN n_existing % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS calls
FROM ex LEFT JOIN isj USING (doc_id)"""
)
def judgments(spark, sf_dir):
    """Findings judged by a stand-in, its faults mended by a second try."""
    b, found = _part_findings(spark, sf_dir)
    judged = judgment.judge_documents(plans.assemble(b, found), _stand_in, "Judge.")
    j = F.from_json("judgment", "acronym_table array<struct<acronym string>>, acronym_issues array<struct<problem string>>, _meta struct<usage struct<completion_tokens long>, retries map<string, struct<recovered boolean>>>")
    told = judged.select("doc_id", j.alias("j")).select("doc_id", "j.*")
    mended = F.coalesce(F.array_join(F.transform(F.filter(F.map_entries("_meta.retries"), lambda x: x["value"]["recovered"]), lambda x: x["key"]), ","), F.lit(""))
    return told.select("doc_id", F.size("acronym_table").cast("long").alias("n_rows"), F.size("acronym_issues").cast("long").alias("n_issues"), mended.alias("second_try"), F.col("_meta.usage.completion_tokens").alias("calls"))


@query(ORACLES["recurring_phrases"])
def stream_intake(spark, sf_dir):
    """The same phrases from a file stream of documents, run until nothing is left."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = A.table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")
    intake.phrase_stream(stream, f"{base}/out", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch").withColumnRenamed("count", "uses")
