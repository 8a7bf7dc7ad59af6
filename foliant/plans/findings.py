"""All passes over a corpus of blocks, and their findings by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import acronyms, glossary, orgs, pages, phrases, spelling
from foliant.plans.tables import dealt, saved
from foliant.sources.blocks import document_text

NOTE = "Page checks cover explicit page markers, 'Page X of Y' footers, and cross-reference ranges; whether a target lands on its page needs a paginated rendering."


def gather(blocks: DataFrame, dictionary: DataFrame, house: list[tuple[str, str]] = (), tagged: DataFrame | None = None, extra: DataFrame | None = None, expected_customer: str | None = None, min_count: int = 3) -> dict[str, DataFrame]:
    """The passes' tables by name. Phrases are counted before the house list is merged, organisations before spelling is checked.

    Each pass's table is saved as it is made, so that no plan holds more than
    one pass: together they are too much for a small driver, whatever the
    rows. Only the texts, which repeat the blocks, are left as a plan.
    """
    blocks = saved(blocks)
    found = saved(phrases.recurring_phrases(blocks, min_count, locations=True))
    own, defined = saved(glossary.glossary(blocks, tagged)), saved(acronyms.definitions(blocks))
    terms = own.select("doc_id", "acronym", "expansion").unionByName(acronyms.house_merge(blocks, own, list(house)))
    sets = saved(acronyms.definition_sets(blocks, terms, defined))
    mentions = saved(orgs.org_surfaces(blocks))
    allowed = [found.select("doc_id", F.col("phrase").alias("text")), sets.select("doc_id", F.col("expansion").alias("text")), mentions.select("doc_id", F.col("surface").alias("text"))]
    if expected_customer:
        allowed.append(blocks.select("doc_id").distinct().withColumn("text", F.lit(expected_customer)))
    allow = saved(spelling.allowlist(*allowed).unionByName(sets.select("doc_id", F.lower("acronym").alias("word"))).distinct())
    conflicts = acronyms.conflicting_expansions(sets, defined).select("doc_id", "acronym", F.lit("conflicting_expansions").alias("problem"), "detail", "locations")
    several = acronyms.multiple_acronyms(sets).select("doc_id", F.col("acronyms").alias("acronym"), F.lit("multiple_acronyms_one_term").alias("problem"), F.col("expansion").alias("detail"), F.array().cast("array<string>").alias("locations"))
    forms = orgs.inconsistent_forms(blocks, mentions).select("doc_id", F.lit("inconsistent_org_form").alias("problem"), F.concat(F.lit("same entity written multiple ways: "), "forms").alias("detail"))
    if expected_customer:
        wrong = orgs.wrong_customers(blocks, expected_customer, mentions)
        detail = F.concat(F.lit("unexpected organization '"), "top", F.lit(f"' (expected primary customer '{expected_customer}')"))
        forms = forms.unionByName(wrong.select("doc_id", F.lit("possible_wrong_customer").alias("problem"), detail.alias("detail")))
    totals, entries = saved(pages.page_totals(blocks)), saved(pages.toc_entries(blocks))
    return {
        "recurring_phrases": found, "existing_acronyms": saved(acronyms.existing_acronyms(sets)), "acronym_issues": saved(conflicts.unionByName(several)),
        "spelling_candidates": saved(spelling.spelling_candidates(blocks, dictionary, allow, extra)), "page_issues": saved(pages.page_issues(blocks, totals, entries)), "toc_entries": entries,
        "page_totals": totals, "organizations": mentions, "organization_issues": saved(forms), "primary_customer": saved(orgs.primary_customer(blocks, mentions)), "texts": document_text(blocks),
    }


def assemble(blocks: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """One row per document with all findings nested; the document's text isn't among them."""

    def listed(name: str, order: list, fields: list[str]) -> DataFrame:
        rows = found[name].groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))).alias("x"))
        return rows.select("doc_id", F.transform("x", lambda x: x["v"]).alias(name))

    out = blocks.select("doc_id").distinct()
    for part in (
        listed("recurring_phrases", ["rank"], ["phrase", "count", "proposed", "locations"]), listed("acronym_issues", ["problem", "acronym", "detail"], ["acronym", "problem", "detail", "locations"]),
        listed("spelling_candidates", ["ord", "pos"], ["word", "suggestion", "path", "context"]), listed("page_issues", ["stage", "ord", "sub"], ["problem", "detail", "location"]),
        listed("toc_entries", ["ord"], ["title", "n", "path"]), found["page_totals"].select("doc_id", F.col("total").alias("total_pages")), listed("organization_issues", ["problem", "detail"], ["problem", "detail"]),
        found["existing_acronyms"].groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("acronym", "expansions")))).alias("existing_acronyms")),
        found["organizations"].groupBy("doc_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("surface", "count")))).alias("organizations")), found["primary_customer"],
    ):
        out = out.join(dealt(part), "doc_id", "left")
    return out


def acronym_table(found: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, acronym, expansion, status, note, acronym_count, expansion_count): existing acronyms, then phrases whose proposal isn't taken, without phantoms."""
    from pyspark.sql import Window

    from foliant.operators.counts import annotate_counts, drop_phantoms

    have = found["existing_acronyms"].select("doc_id", "acronym", F.get("expansions", F.lit(0)).alias("expansion"), F.lit("existing").alias("status"), F.when(F.size("expansions") > 1, F.concat(F.lit("also: "), F.array_join(F.expr("slice(expansions, 2, size(expansions))"), "; "))).otherwise("").alias("note"))
    first = Window.partitionBy("doc_id", "proposed").orderBy("rank")
    new = found["recurring_phrases"].where("proposed <> ''").withColumn("k", F.row_number().over(first)).where("k = 1")
    new = new.join(dealt(have.select("doc_id", F.col("acronym").alias("proposed"))), ["doc_id", "proposed"], "left_anti")
    rows = have.unionByName(new.select("doc_id", F.col("proposed").alias("acronym"), F.col("phrase").alias("expansion"), F.lit("proposed").alias("status"), F.lit("").alias("note")))
    return drop_phantoms(annotate_counts(rows, found["texts"]))
