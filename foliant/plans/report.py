"""Markdown reports, one text per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import md_cell
from foliant.operators.counts import annotate_counts, drop_phantoms
from foliant.plans.findings import NOTE, acronym_table, assemble
from foliant.plans.tables import dealt

SHOWN_MISSPELLINGS = 60
_COLUMNS = ("acronym", "expansion", "status", "acronym_count", "expansion_count", "note")
#: What a report reads of a judgment; parts of another shape are null and count as absent.
JUDGMENT = (
    "_error string, _parse_error string, _meta struct<model_requested string, model_reported string, base_url string, finish_reason string, latency_ms long, "
    "usage struct<prompt_tokens long, completion_tokens long, total_tokens long>, findings_shrunk struct<original_chars long, sent_chars long, steps array<string>>, "
    "retries struct<truncation struct<tokens array<long>, recovered boolean>, repair struct<recovered boolean>, validation struct<attempted boolean, recovered boolean>>>, "
    "acronym_table array<struct<acronym string, expansion string, status string, note string>>, acronym_issues array<struct<acronym string, problem string, detail string, note string>>, "
    "misspellings array<struct<word string, suggestion string, context string>>, customer struct<primary string, normalize array<string>, suspected_wrong array<string>>"
)
# The report's own wording.
SKIPPED = "_Model pass skipped — findings below are deterministic only._"
FAILED = "_Model pass FAILED ({}). Findings below are deterministic only._"
UNREADABLE = "_Model **responded** but its output was not valid JSON, so deterministic findings are shown.{}_"
GENERATED = "_Generated by model `{}`{}._"
UNAVAILABLE, EMPTY_TABLE = "deterministic — model pass unavailable", "deterministic — model returned an empty table"
TABLE_HEAD = "| Acronym | Expansion | Status | Acronym uses | Expansion uses | Note |\n|---|---|---|---|---|---|\n"


def _told(template: str, *values: Column | str) -> Column:
    """A text with values in place of {}; a null value counts as nothing."""
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:]):
        out += [F.coalesce((F.lit(value) if isinstance(value, str) else value).cast("string"), F.lit("")), F.lit(part)]
    return F.concat(*out)


def provenance(j: Column) -> Column:
    """A line on where findings come from: no model, a failed one, an unreadable answer, or a model with its counts and second tries."""
    meta = j["_meta"]
    who, tokens, latency = F.coalesce(meta["model_reported"], meta["model_requested"], F.lit("model")), meta["usage"]["completion_tokens"], meta["latency_ms"]
    unread = F.when(tokens.isNotNull(), _told(" (model `{}`, {} completion tokens, {} ms)", who, tokens, latency))
    extra = F.concat_ws("", F.when(tokens.isNotNull(), _told(", {} completion tokens", tokens)), F.when(latency.isNotNull(), _told(", {} ms", latency)))
    shrunk, tries = meta["findings_shrunk"], meta["retries"]
    room = tries["truncation"]["tokens"]
    notes = F.filter(
        F.array(
            F.when(shrunk.isNotNull(), _told("findings over the budget were cut from {} to {} characters ({})", shrunk["original_chars"], shrunk["sent_chars"], F.array_join(shrunk["steps"], "; "))),
            F.when(tries["truncation"]["recovered"], _told("an answer that was cut off came whole with {} tokens in place of {}", F.get(room, F.lit(1)), F.get(room, F.lit(0)))),
            F.when(tries["repair"]["recovered"], F.lit("an unreadable answer was repaired by one more call")),
            F.when(tries["validation"]["recovered"], F.lit("an answer of the wrong shape was repaired by one more call")).when(tries["validation"]["attempted"], F.lit("a repair of the answer's shape failed and the first answer stays")),
        ),
        lambda n: n.isNotNull(),
    )
    tail = F.when(F.size(notes) > 0, _told(" _Note: {}._", F.array_join(notes, "; ")))
    return F.when(j.isNull(), F.lit(SKIPPED)).when(j["_error"].isNotNull(), _told(FAILED, j["_error"])).when(j["_parse_error"].isNotNull(), _told(UNREADABLE, unread)).otherwise(F.concat(_told(GENERATED, who, extra), F.coalesce(tail, F.lit(""))))


def _none(kind: str = "string") -> Column:
    return F.array().cast(f"array<{kind}>")


def _section(title: str, rows: Column) -> Column:
    """A heading and its lines, or nothing without lines."""
    return F.when(F.size(F.coalesce(rows, _none())) > 0, F.concat(F.lit(f"## {title}\n\n"), F.array_join(rows, "\n"), F.lit("\n\n"))).otherwise("")


def _by_acronym(rows: Column) -> Column:
    key = lambda x: F.upper(F.coalesce(x["acronym"], F.lit("")))
    return F.array_sort(rows, lambda x, y: F.when(key(x) < key(y), -1).when(key(x) > key(y), 1).otherwise(0))


def render(blocks: DataFrame, found: dict[str, DataFrame], judgments: DataFrame | None = None) -> DataFrame:
    """(doc_id, report): the acronym table with exact counts, then issues, misspellings, page problems and the customer.

    ``judgments`` (doc_id, judgment as JSON) come from ``judge_documents``. A
    document with a readable one shows the model's table (with counts from the
    text, and without proposed rows that the text doesn't bear out), issues,
    misspellings and customer; one without, or with a failed or unreadable
    one, the findings alone, and says so.
    """
    a = assemble(blocks, found)
    if judgments is None:
        a = a.withColumn("j", F.from_json(F.lit(None).cast("string"), JUDGMENT))
    else:
        a = a.join(dealt(judgments.select("doc_id", F.from_json("judgment", JUDGMENT).alias("j"))), "doc_id", "left")
    j = F.col("j")
    clean = j.isNotNull() & j["_error"].isNull() & j["_parse_error"].isNull()
    tabled = F.coalesce(clean & (F.size(j["acronym_table"]) > 0), F.lit(False))

    def rows_of(table: DataFrame, order: Column) -> DataFrame:
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(md_cell(F.col(c).cast("string")), F.lit("")) for c in _COLUMNS]), F.lit(" |"))
        listed = table.select("doc_id", F.struct(order.alias("s"), F.coalesce("acronym", F.lit("")).alias("acronym"), cells.alias("row")).alias("r"))
        return listed.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["row"]).alias("table"))

    table = rows_of(acronym_table(found), F.col("status") != "existing").withColumnRenamed("table", "plain")
    a = a.join(dealt(table), "doc_id", "left").withColumn("judged", _none())
    if judgments is not None:
        model = a.where(tabled).select("doc_id", F.explode("j.acronym_table").alias("r")).select("doc_id", "r.*")
        model = rows_of(drop_phantoms(annotate_counts(model, found["texts"])), F.upper(F.coalesce("acronym", F.lit(""))))
        a = a.drop("judged").join(dealt(model.withColumnRenamed("table", "judged")), "doc_id", "left")
    source = F.when(j.isNull(), F.lit("deterministic")).when(~clean, F.lit(UNAVAILABLE)).when(tabled, _told("generated by {}", F.coalesce(j["_meta"]["model_reported"], j["_meta"]["model_requested"], F.lit("model")))).otherwise(F.lit(EMPTY_TABLE))
    head = F.concat(_told("## Acronym table  _({}; uses are exact counts from the document)_\n\n", source), F.lit(TABLE_HEAD))

    line = lambda x, detail: F.concat(F.lit("- `"), F.coalesce(x["acronym"], F.lit("")), F.lit("` — "), F.coalesce(x["problem"], F.lit("")), F.lit(": "), F.coalesce(detail, F.lit("")))
    issues = F.when(clean, F.transform(_by_acronym(j["acronym_issues"]), lambda x: line(x, F.coalesce(x["detail"], x["note"])))).otherwise(F.transform(_by_acronym(F.col("acronym_issues")), lambda x: line(x, x["detail"])))
    words = lambda rows: F.transform(F.slice(rows, 1, SHOWN_MISSPELLINGS), lambda s: F.concat(F.lit("- **"), s["word"], F.lit("** → "), F.coalesce(s["suggestion"], F.lit("")), F.lit("  _"), F.coalesce(s["context"], F.lit("")), F.lit("_")))
    spelling = F.when(clean & j["misspellings"].isNotNull(), words(j["misspellings"])).otherwise(words(F.col("spelling_candidates")))
    page = F.transform("page_issues", lambda i: F.concat(F.lit("- "), i["problem"], F.lit(": "), i["detail"], F.lit(" ("), i["location"], F.lit(")")))

    primary = F.when(F.col("primary").isNotNull(), F.array(_told("- Primary (deterministic): **{}**", F.col("primary")))).otherwise(_none())
    customer = F.concat(primary, F.coalesce(F.transform("organization_issues", lambda i: F.concat(i["problem"], F.lit(": "), i["detail"])), _none()))
    named = lambda xs: F.array_join(F.filter(xs, lambda x: x != ""), ", ")
    said = F.filter(
        F.array(
            _told("- Primary: **{}**", F.coalesce(j["customer"]["primary"], F.lit("?"))), F.when(named(j["customer"]["normalize"]) != "", _told("- Normalize variants: {}", named(j["customer"]["normalize"]))),
            F.when(named(j["customer"]["suspected_wrong"]) != "", _told("- ⚠ Suspected wrong/leftover: {}", named(j["customer"]["suspected_wrong"]))),
        ),
        lambda x: x.isNotNull(),
    )
    customer = F.when(clean & j["customer"].isNotNull(), said).otherwise(customer)
    meta, known = j["_meta"], lambda x: F.coalesce(x.cast("string"), F.lit("?"))
    told = _told(
        "- Model requested: `{}`\n- Model reported by server: `{}`\n- Endpoint: `{}`\n- Tokens — prompt {}, completion {}, total {}\n- Latency: {} ms · finish: `{}`\n",
        *[known(x) for x in (meta["model_requested"], meta["model_reported"], meta["base_url"], meta["usage"]["prompt_tokens"], meta["usage"]["completion_tokens"], meta["usage"]["total_tokens"], meta["latency_ms"], meta["finish_reason"])],
    )
    closing = F.when(j.isNull(), F.lit("\n\n## Analysis provenance\n\n- Model pass skipped.\n")).when(meta.isNotNull(), F.concat(F.lit("\n\n## Analysis provenance\n\n"), told)).otherwise(F.lit("\n"))
    rows = F.when(tabled, F.col("judged")).otherwise(F.col("plain"))
    text = F.concat(
        F.lit("# Proofreading report\n\n"), provenance(j), F.lit("\n\n"), head, F.coalesce(F.array_join(rows, "\n"), F.lit("")), F.lit("\n\n"), _section("Acronym issues", issues), _section("Possible misspellings", spelling),
        _section("Page-number issues", page), F.lit(f"> {NOTE}\n\n"), F.lit("## Customer name\n\n"), F.array_join(customer, "\n"), closing,
    )
    return a.select("doc_id", text.alias("report"))


def findings_json(blocks: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, json): a document's findings as one JSON object, ready for write.text or partitioned files."""
    a = assemble(blocks, found)
    return a.select("doc_id", F.to_json(F.struct(*[c for c in a.columns if c != "doc_id"])).alias("json"))
