"""The passes against hand-made cases and plain versions of their rules."""

import gc
import io
import json
import random
import re
import time
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import acronyms, counts, glossary, jobs, judgment, orgs, pages, phrases, spelling, transports
from foliant.plans import findings as plans
from foliant.plans import report
from foliant.plans.tables import saved
from foliant.sources import blocks as B
from foliant.sources import markup, pdf

BLOCKS = "doc_id string, ord long, text string, path string, kind string, page string"


def blocks(spark, texts, kinds=None, paths=None):
    rows = [("d", i, t, (paths or {}).get(i, f"p[{i}]"), (kinds or {}).get(i, "body"), t if (kinds or {}).get(i) == "page" else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, BLOCKS)


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "gram, keep",
    [
        ("Corrective Action", True), ("Failure Mode", True), ("MARK II", True), ("Level 3 Maintenance", True), ("Block 2 Upgrade", True), ("Class A Mishap", False), ("Voltage V", False), ("L3 Insight", False),
        ("ST2-611-A1 Voltage V 50V 60 68", False), ("the Corrective Action", False), ("corrective action", False), ("Corrective", False),
    ],
)
def test_gram_rule(spark, gram, keep):
    assert value(spark, T.candidate_gram(F.split(F.lit(gram), " "))) is keep


def test_small_functions(spark):
    assert value(spark, T.ws(F.lit(" a \t b\n"))) == "a b" and value(spark, T.ws(F.lit(None).cast("string"))) == ""
    assert value(spark, T.propose_acronym(F.lit("Built-In Test Equipment"))) == "BITE"
    assert value(spark, T.defines(F.lit("RCM"), F.lit("Reliability Centered Maintenance"))) and not value(spark, T.defines(F.lit("RCM"), F.lit("Maintenance of Things")))
    assert value(spark, T.org_key(F.lit("Acme Defense, Inc."))) == "acme defense" and value(spark, T.org_key(F.lit("Acme Systems LLC"))) == "acme systems"
    assert value(spark, T.snippet(F.lit("a" * 60 + " word " + "b" * 60), F.lit("word"))) == "…" + "a" * 39 + " word " + "b" * 39 + "…"
    assert value(spark, T.md_cell(F.lit("a|b"))) == "a\\|b"
    for text, want in (("CA | Corrective Action", ("CA", "Corrective Action")), ("SD-18 Specification Document", ("SD-18", "Specification Document")), ("Acronym | Definition", None), ("Failure of a part", None), ("CA | CA", None)):
        got = value(spark, T.gloss_pair(F.lit(text)))
        assert (got and tuple(got)) == want


@pytest.mark.parametrize("table", [{"Line Replaceable Unit": 5, "Replaceable Unit": 6, "Line Replaceable": 5, "Unit": 9}, {"A B C": 3, "B C": 10, "A B": 4, "C D E": 3, "D E": 3}, {"foo bar": 2, "foo bar baz": 2, "bar baz qux": 5, "bar baz": 7}, None])
@pytest.mark.parametrize("least", [2, 3, 4])
def test_suppression_is_containment(spark, table, least):
    if table is None:
        rng = random.Random(least)
        table = {" ".join(rng.choice("ABC") for _ in range(rng.randint(1, 6))): rng.randint(2, 9) for _ in range(60)}
    want = set()
    for s, n in table.items():
        best = max((m for l, m in table.items() if len(l.split()) > len(s.split()) and f" {s} " in f" {l} "), default=0)
        if not best or n - best >= least:
            want.add(s)
    df = spark.createDataFrame([("d", p, n) for p, n in table.items()], "doc_id string, phrase string, count long")
    assert {r.phrase for r in phrases.suppress(df, least).collect()} == want


MANUAL = """<manual><title>Field Maintenance Manual</title>
<customer>Prepared for Acme Defense Systems, Inc. under contract.</customer><section><title>Introduction</title>
<para>The Line Replaceable Unit is tested by Built-In Test Equipment here. A Line Replaceable Unit is small.</para>
<para>Built-In Test Equipment checks the Line Replaceable Unit often. Use Built-In Test Equipment.</para>
<para>Reliability Centered Maintenance (RCM) matters. RCM (Routine Component Maintenance) differs.</para>
<para>See page 42 for the maintenence plan. Refer to page 7.</para><para>Globex Corporation was named. Acme Defense Systems Inc was too.</para></section>
<pagenum>1</pagenum><pagenum>2</pagenum><pagenum>2</pagenum><pagenum>5</pagenum><para>Page 3 of 12 and Page 4 of 12</para></manual>"""


@pytest.fixture(scope="module")
def manual(spark):
    parsed = markup.parse_xml(MANUAL.encode())
    return spark.createDataFrame([("m", i, *b) for i, b in enumerate(parsed.blocks)], BLOCKS).cache()


def test_manual_end_to_end(spark, manual):
    words = "the maintenance plan section introduction prepared under contract tested small checks matters differs named line unit test routine component use".split()
    dictionary = spark.createDataFrame([(w, 10) for w in words], "word string, freq long")
    found = plans.gather(manual, dictionary, expected_customer="Acme Defense Systems, Inc.", min_count=2)
    assert {(r.phrase, r["count"], r.proposed) for r in found["recurring_phrases"].collect()} >= {("Line Replaceable Unit", 3, "LRU"), ("Built-In Test Equipment", 2, "BITE")}
    assert [(r.acronym, r.detail) for r in found["acronym_issues"].collect()] == [("RCM", "Reliability Centered Maintenance; Routine Component Maintenance")]
    assert ("maintenence", "maintenance") in {(r.word, r.suggestion) for r in found["spelling_candidates"].collect()}
    problems = {(r.problem, r.detail) for r in found["page_issues"].collect()}
    assert {("duplicate_page_number", "page 2 labeled more than once"), ("page_gap", "jumps from 2 to 5"), ("out_of_order_page", "3 follows 5"), ("xref_out_of_range", "reference to page 42 (document has 12)")} <= problems
    assert {r.problem for r in found["organization_issues"].collect()} == {"inconsistent_org_form", "possible_wrong_customer"}
    text = report.render(manual, found).first().report
    assert "| LRU | Line Replaceable Unit | proposed | 0 | 3 |" in text and "maintenence** → maintenance" in text and "- page_gap: jumps from 2 to 5" in text
    nested = json.loads(report.findings_json(manual, found).first().json)
    assert nested["total_pages"] == 12 and "texts" not in nested


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_report_plan_reads_each_pass_once(spark, manual):
    """A plan that holds all passes fills the driver's memory, whatever the rows."""
    found = plans.gather(manual, spark.createDataFrame([("plan", 9)], "word string, freq long"), [("RCM", "Reliability")], expected_customer="Acme")
    assert {k: scans(t) for k, t in found.items() if k != "texts"} == {k: 1 for k in found if k != "texts"}
    assert scans(report.render(manual, found)) <= 30
    assert scans(report.findings_json(manual, found)) <= 10
    assert scans(judgment.judge_documents(plans.assemble(manual, found), lambda: None, "Judge.")) == 1


def joins_by_broadcast(df):
    return re.findall(r"Broadcast\w*Join\w*", df._jdf.queryExecution().executedPlan().toString())


def test_passes_deal_out_what_their_files_make_look_small(spark, manual, monkeypatch):
    """Repeated rows take little room in files, so a broadcast chosen by that would bring millions to the driver; only words that were counted may be broadcast."""
    seen = []
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 0)
    for module in (plans, spelling):
        monkeypatch.setattr(module, "saved", lambda df: seen.append(joins_by_broadcast(df)) or saved(df))
    found = plans.gather(manual, spark.createDataFrame([("plan", 9)], "word string, freq long"), [("RCM", "Reliability")], expected_customer="Acme")
    assert len(seen) > 10 and not any(seen)
    assert not joins_by_broadcast(report.findings_json(manual, found))


FOUND = {
    "recurring_phrases": ("rank int, phrase string, count long, proposed string, locations array<string>", (1, "Alpha Beta", 3, "AB", ["p"])), "acronym_issues": ("acronym string, problem string, detail string, locations array<string>", ("AB", "x", "y", ["p"])),
    "spelling_candidates": ("ord long, pos int, word string, suggestion string, path string, context string", (0, 0, "wrd", "word", "p", "a wrd")),
    "page_issues": ("problem string, detail string, location string, stage int, ord long, sub int", ("x", "y", "p", 0, 0, 0)), "toc_entries": ("ord long, title string, n long, path string", (0, "One", 1, "p")), "page_totals": ("total long", (9,)),
    "organization_issues": ("problem string, detail string", ("x", "y")), "existing_acronyms": ("acronym string, expansions array<string>", ("CD", ["Gamma Delta"])), "organizations": ("surface string, count long", ("Acme Inc", 1)),
    "primary_customer": ("primary string", ("Acme Inc",)), "texts": ("text string", ("Alpha Beta CD",)),
}


@pytest.fixture
def found(spark):
    return {name: saved(spark.createDataFrame([("m", *row)], f"doc_id string, {fields}")) for name, (fields, row) in FOUND.items()}


def test_judgments_deal_out_what_their_files_make_look_small(spark, manual, found, monkeypatch):
    seen = []
    monkeypatch.setattr(judgment, "saved", lambda df: seen.append(joins_by_broadcast(df)) or saved(df))
    assert not joins_by_broadcast(judgment.judge_documents(plans.assemble(manual, found), lambda: None, "Judge."))
    assert seen == [[]]


def test_reports_deal_out_what_their_files_make_look_small(spark, manual, found):
    said = saved(spark.createDataFrame([("m", json.dumps({"acronym_table": [{"acronym": "CD", "expansion": "Gamma Delta", "status": "existing"}]}))], "doc_id string, judgment string"))
    for judgments in (None, said):
        assert not joins_by_broadcast(report.render(manual, found, judgments))


def test_saved_table_gives_freed_memory_back(spark):
    """What the driver's JVM frees outside its heap stays with it otherwise, pass after pass (buffers that stay keep the rest from going by itself)."""
    jvm = spark._jvm

    def held():
        return sum(int(x) for x in re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/smaps_rollup").read_text())) / 1024

    one = spark.range(1).cache()
    one.count()
    buffers = [jvm.java.nio.ByteBuffer.allocateDirect(60_000) for _ in range(4000)]
    stay = buffers[::40]
    del buffers
    for _ in range(5):
        gc.collect()
        jvm.System.gc()
        time.sleep(0.3)
    before = held()
    assert saved(one).count() == 1
    assert before - held() > 100 and stay


def test_spelling_plan_carries_no_texts(spark):
    from foliant.queries import spelling_candidates

    assert "text#" not in spelling_candidates(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


def test_spelling_by_broadcast_and_by_shuffle(spark, monkeypatch):
    """Known words met by a shuffle give the same rows; of blocks with the same place one counts."""
    rows = [("d", 0, "The maintenence of a zorgon and pre-maintenence", "p0"), ("d", 1, "Maintenence zorgom extrra", "p1"), ("d", 1, "Maintenence zorgom extrra", "p2"), ("e", 0, "zorgom maintenance extrras", "p0")]
    b = spark.createDataFrame([(*r, "body", None) for r in rows], BLOCKS)
    dictionary = spark.createDataFrame([("the", 9), ("maintenance", 9)], "word string, freq long")
    allowed, extra = spark.createDataFrame([("d", "zorgon")], "doc_id string, word string"), spark.createDataFrame([("extra",)], "word string")
    seen = []
    for most in (spelling.BROADCAST_WORDS, 0):
        monkeypatch.setattr(spelling, "BROADCAST_WORDS", most)
        seen.append([sorted(spelling.spelling_candidates(b, dictionary, *more).select("doc_id", "ord", "word", "suggestion", "path").collect()) for more in ((), (allowed, extra))])
    assert seen[0] == seen[1]
    assert seen[0][0] == [("d", 0, "maintenence", "maintenance", "p0")]
    assert seen[0][1] == [("d", 0, "maintenence", "maintenance", "p0"), ("d", 1, "extrra", "extra", "p1"), ("d", 1, "zorgom", "zorgon", "p1")]


def test_row_order_does_not_matter(spark, manual):
    a = phrases.recurring_phrases(manual, 2).collect()
    b = phrases.recurring_phrases(manual.repartition(7).orderBy(F.rand(1)), 2).collect()
    assert sorted(a) == sorted(b)


def test_counts(spark):
    text = "The Corrective Action (CA) plan. CA runs. Built In Test (BIT). BIT and BIT. I/O then I/O. CAT corrective\naction"
    assert value(spark, counts.count_acronym(F.lit(text), F.lit("CA"))) == 2 and value(spark, counts.count_acronym(F.lit(text), F.lit("I/O"))) == 2
    assert value(spark, counts.count_phrase(F.lit(text), F.lit("corrective action"))) == 2
    table = spark.createDataFrame([("d", "I/O", ""), ("d", "O", ""), ("d", "BIT", "Built In Test")], "doc_id string, acronym string, expansion string")
    got = counts.annotate_counts(table, spark.createDataFrame([("d", text + " O")], "doc_id string, text string"))
    assert {(r.acronym, r.acronym_count, r.expansion_count) for r in got.collect()} == {("I/O", 2, 0), ("O", 1, 0), ("BIT", 3, 1)}


def test_glossary_needs_a_run(spark):
    rows = ["Acronyms and Abbreviations", "RCM Reliability Centered Maintenance", "LRU Line Replaceable Unit", "prose here", "CA | Corrective Action", "PS | Power Supply", "prose", "CI | Configuration Item", "DR | Deficiency Report", "IO | Input Output"]
    kinds = {0: "heading", **{i: "table" for i in (4, 5, 7, 8, 9)}}
    b = blocks(spark, rows, kinds)
    assert {r.acronym for r in glossary.glossary(b).collect()} == {"RCM", "LRU", "CI", "DR", "IO"}
    tagged = spark.createDataFrame([("d", "CI", "Tagged", 1), ("d", "CI", "Tagged Last", 2)], "doc_id string, acronym string, expansion string, ord long")
    house = spark.createDataFrame([("d", "CI", "House"), ("d", "ZZ", "House Only")], "doc_id string, acronym string, expansion string")
    got = {r.acronym: r.expansion for r in glossary.glossary(b, tagged, house).collect()}
    assert got["CI"] == "Tagged Last" and got["ZZ"] == "House Only"


def test_house_list(spark, tmp_path):
    (tmp_path / "ref.csv").write_text("﻿acronym,definition\nATP,Acceptance Test Procedure\nATP,Other\nAGS,Unused\nCDR,Critical Design Review\n,blank\n", encoding="utf-8")
    house = [(r.acronym, r.definition) for r in B.reference_acronyms(spark, str(tmp_path / "ref.csv")).collect()]
    assert dict(house)["ATP"] == "Acceptance Test Procedure" and len(house) == 3
    b = blocks(spark, ["The ATP and CDR schedule; XCDR no."])
    own = spark.createDataFrame([("d", "ATP", "Own Meaning")], "doc_id string, acronym string, expansion string")
    assert [(r.acronym, r.expansion) for r in acronyms.house_merge(b, own, house).collect()] == [("CDR", "Critical Design Review")]


def test_pages(spark):
    b = blocks(spark, ["Page 2 of 10", "Page 3 of 10", "Page 1 of 10"], paths={2: "sections/pagination"})
    assert pages.sequence_issues(b).count() == 0 and pages.page_totals(b).first().total == 10
    assert [r.problem for r in pages.sequence_issues(blocks(spark, ["Page 2 of 10", "Page 7 of 10"])).collect()] == ["page_gap"]
    b = blocks(spark, ["Contents", "Intro ..... 5", "Intro 5", "text", "Late .... 99", "Chapter", "After .... 77", "Page 1 of 10"], {5: "heading"})
    assert [(r.title, r.n) for r in pages.toc_issues(b).collect()] == [("Late", 99)]


def test_orgs_do_not_bridge_and(spark):
    found = orgs.org_surfaces(blocks(spark, ["Lockheed Martin and General Dynamics Corporation. Acme Systems, LLC here; Acme Systems LLC there."])).collect()
    assert not any(" and " in r.surface for r in found)
    assert orgs.inconsistent_forms(blocks(spark, ["Acme Systems, LLC here; Acme Systems LLC there."])).count() == 1


def test_spelling(spark):
    d = spark.createDataFrame([("receive", 9), ("relieve", 2), ("inspection", 5), ("happened", 5), ("test", 3), ("via", 2)], "word string, freq long")
    got = spelling.spelling_candidates(blocks(spark, ["The recieve inspection happened. Pre-test vias FBDs recieve SHOUT."]), d).collect()
    assert [(r.word, r.suggestion) for r in got] == [("recieve", "receive")]
    allowed = spark.createDataFrame([("d", "recieve")], "doc_id string, word string")
    assert spelling.spelling_candidates(blocks(spark, ["The recieve inspection"]), d, allowed).count() == 0


def docx(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_docx():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'

    def p(t):
        return f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"

    cell = "<w:tc>{}</w:tc>"
    table = f"<w:tbl><w:tr>{cell.format(p('A'))}{cell.format(p('B'))}</w:tr><w:tr><w:tc><w:tcPr><w:vMerge/></w:tcPr>{p('A')}</w:tc><w:tc>{p('Z')}<w:tbl><w:tr>{cell.format(p('in'))}</w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    box = f"<w:p><mc:AlternateContent><mc:Choice><w:txbxContent>{p('box')}</w:txbxContent></mc:Choice><mc:Fallback><w:txbxContent>{p('box')}</w:txbxContent></mc:Fallback></mc:AlternateContent></w:p>"
    body = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p>{table}{box}<w:sectPr><w:footerReference r:id="f"/></w:sectPr>'
    rels = '<R><x Id="f" Type="t/footer" Target="footer1.xml"/><x Id="n" Type="t/footnotes" Target="footnotes.xml"/></R>'
    notes = f'<w:footnotes {w}><w:footnote w:id="0" w:type="separator">{p("-")}</w:footnote><w:footnote w:id="2">{p("a note")}</w:footnote></w:footnotes>'
    raw = docx(word__document_xml="", **{"word/document.xml": f"<w:document {w}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels, "word/footnotes.xml": notes, "word/footer1.xml": f"<w:ftr {w}>{p('ACME Page 3 of 42')}</w:ftr>"})
    got = [(text, kind) for text, _, kind, _ in markup.parse_docx(raw).blocks]
    assert got == [("Head", "heading"), ("A | B", "table"), ("Z", "table"), ("in", "table"), ("box", "textbox"), ("a note", "footnote"), ("ACME", "footer"), ("Page 1 of 42", "page")]


def test_files_that_fail_are_rejected(spark):
    files = spark.createDataFrame([("a.xml", bytearray(b"<a><p>one</p><p>two")), ("b.docx", bytearray(b"no zip")), ("c.txt", bytearray(b"x")), ("d.xml", bytearray(b""))], "path string, content binary")
    good, _, bad = markup.parse_files(files)
    assert [r.text for r in good.orderBy("ord").collect()] == ["one", "two"]
    assert {r.doc_id for r in bad.collect()} == {"b.docx", "c.txt", "d.xml"}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-16-le", "ISO-8859-1", "windows-1252"])
def test_xml_encodings(encoding):
    """Declared encodings and byte order marks are heeded, in whole and in broken markup, and names keep their case."""
    head = f'<?xml version="1.0" encoding="{encoding}"?><!DOCTYPE Doc [<!ELEMENT Doc ANY>]>'
    whole = f"{head}<Doc><SecA><p>Café Unit</p><p>zwei</p></SecA></Doc>"
    for text in (whole, whole.replace("<p>zwei</p>", "<p>zwei")):
        assert [b[:2] for b in markup.parse_xml(text.encode(encoding)).blocks] == [("Café Unit", "SecA/p[1]"), ("zwei", "SecA/p[2]")]
    assert [b[0] for b in markup.parse_xml(b"<d><p>a &amp; b &#233;</p></d>").blocks] == ["a & b é"]


def test_entities_are_not_read():
    bomb = b'<!DOCTYPE d [<!ENTITY a "aaaa"><!ENTITY b "&a;&a;"><!ENTITY x SYSTEM "file:///etc/hostname">]><d><p>one &b; &x;</p></d>'
    text = " ".join(b[0] for b in markup.parse_xml(bomb).blocks)
    assert text.startswith("one") and "aaaa" not in text


def test_xml_glossary_and_mixed_content():
    parsed = markup.parse_xml(b"<doc>lead <b>bold</b><para>one <unknown>two</unknown></para>tail<glossentry><glossterm>RCM</glossterm><glossdef>Reliability</glossdef></glossentry></doc>")
    assert [b[0] for b in parsed.blocks][:3] == ["lead bold", "one two", "tail"] and parsed.glossary == [("RCM", "Reliability")]


def test_pdf(spark):
    rows = []
    for page in range(1, 5):
        for top, size, text in ((20.0, 8.0, "Running header"), (100.0, 16.0, "Big Title"), (130.0, 10.0, "Correc-"), (141.0, 10.0, "tive action on the Line"), (152.0, 10.0, "Unit"), (780.0, 8.0, f"Page {page} of 4")):
            for k, word in enumerate(text.split()):
                rows.append(("d", page, 50.0 * k, 50.0 * k + 40, top + 0.5 * (k % 2), top + 8, size, word))
    words = spark.createDataFrame(rows, "doc_id string, page_no int, x0 double, x1 double, top double, bottom double, size double, text string")
    sheets = spark.createDataFrame([("d", p, 792.0) for p in range(1, 5)], "doc_id string, page_no int, height double")
    tables = spark.createDataFrame([("d", 1, 0, 0, ["CA", "Corrective Action"], 600.0, 600.0, 700.0, 700.0)], "doc_id string, page_no int, tbl int, row int, cells array<string>, x0 double, top double, x1 double, bottom double")
    got = [(r.text, r.kind) for r in pdf.pdf_blocks(words, sheets, tables).orderBy("ord").collect()]
    assert got[:4] == [("Big Title", "heading"), ("Corrective action on the Line Unit", "body"), ("Page 1 of 4", "body"), ("CA | Corrective Action", "table")]
    assert not any("Running" in t for t, _ in got) and not any(k == "page" for _, k in got)


def test_jobs(spark):
    rows = [("a1", "A", "awaiting_model", 1, 1, False), ("b1", "B", "awaiting_model", 2, 2, False), ("a2", "A", "judging", 0, 0, False), ("c1", "C", "done", 0, 0, False), ("x", "X", "awaiting_model", 0, 0, True)]
    j = spark.createDataFrame(rows, "job_id string, session string, status string, created long, enqueued_at long, canceled boolean")
    served = spark.createDataFrame([("A", 5), ("B", 1)], "session string, seq long")
    assert [r.job_id for r in jobs.fair_order(j, served).orderBy("position").collect()] == ["b1", "a1"]
    assert [r.job_id for r in jobs.pick_next(j, served).collect()] == ["b1"]
    waits = jobs.positions_and_waits(j, served, spark.createDataFrame([(1000.0,)], "avg_ms double"))
    assert {(r.job_id, r.eta_ms) for r in waits.collect()} == {("b1", 2000), ("a1", 3000)}
    asked = spark.createDataFrame([(i, "A") for i in range(3)], "request_id long, session string")
    assert [r.admitted for r in jobs.admitted(asked, j, per_session=3).orderBy("request_id").collect()] == [True, False, False]
    assert [r.job_id for r in jobs.pruned(j, 4).collect()] == ["c1"]


GOOD = {"acronym_table": [{"acronym": "CA", "expansion": "Corrective Action", "status": "existing"}], "acronym_issues": [], "misspellings": [], "customer": {"primary": "Acme"}}


def transport(*replies):
    left = list(replies)

    def call(messages, tokens):
        call.asked.append((messages, tokens))
        content, finish = left.pop(0)
        return content, finish, {"completion_tokens": 5}, "model", "place"

    call.asked = []
    return call


def test_judgment():
    good = json.dumps(GOOD)
    bad = json.dumps({**GOOD, "acronym_table": [{"acronym": "CA", "expansion": "", "status": "bogus"}]})
    t = transport((f"<think></think>```{good}```", "stop"))
    assert judgment.judge("{}", t, "s")["customer"]["primary"] == "Acme" and len(t.asked) == 1
    t = transport((good[:40], "length"), (good, "stop"))
    assert judgment.judge("{}", t, "s", max_tokens=100)["_meta"]["retries"]["truncation"]["recovered"] and t.asked[1][1] == 200
    t = transport(("no JSON", "stop"), (good, "stop"))
    assert judgment.judge("{}", t, "s", context="c" * 9000)["_meta"]["retries"]["repair"]["recovered"] and len(t.asked[1][0]) == 4
    t = transport((bad, "stop"), (bad, "stop"))
    kept = judgment.judge("{}", t, "s")
    assert kept["acronym_table"][0]["status"] == "bogus" and kept["_meta"]["usage"]["completion_tokens"] == 10
    t = transport((bad, "stop"), (good, "stop"))
    assert judgment.judge("{}", t, "s")["_meta"]["retries"]["validation"]["recovered"]
    assert "_parse_error" in judgment.judge("{}", transport(("[1]", "stop")), "s", retry=False)
    cut = judgment.judge("{}", transport((good[:40], "length"), (good[:50], "length")), "s")
    assert "cut off" in cut["_parse_error"] and "recovered" not in cut["_meta"]["retries"]["truncation"]


def test_shapes():
    assert judgment.shape_errors(GOOD) == [] and len(judgment.shape_errors([])) == 1
    assert len(judgment.shape_errors({})) == 4
    rows = [{"acronym": " ", "expansion": None, "status": "maybe"}, 5] * 9
    assert len(judgment.shape_errors({**GOOD, "acronym_table": rows})) == judgment.MAX_ERRORS
    assert judgment.shape_errors({**GOOD, "customer": {}}) == [] and judgment.shape_errors({**GOOD, "customer": {"primary": ""}}) == [] and judgment.shape_errors({**GOOD, "customer": {"primary": 3}})


def test_payloads_fit_the_budget(spark):
    schema = "doc_id string, recurring_phrases array<struct<phrase: string, count: long, locations: array<string>>>, spelling_candidates array<struct<word: string, context: string>>, existing_acronyms map<string, array<string>>, _text string"
    phrases_ = [(f"Phrase {i}", i, ["x" * 50] * 40) for i in range(300)]
    rows = [("big", phrases_, [("w", "c" * 200)] * 20, {"CA": ["Corrective Action"]}, "secret"), ("small", phrases_[:1], None, None, None), ("none", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    for budget, steps, n in ((10**6, None, 300), (60_000, ["places"], 300), (14_000, ["places", "contexts"], 300), (5_000, None, 60), (10, None, 10)):
        got = {r.doc_id: r for r in judgment.payloads(df, budget).collect()}
        sent = json.loads(got["big"].payload)
        assert (len(got["big"].payload) <= budget or n == 10) and len(sent["recurring_phrases"]) == n and sent["existing_acronyms"] == {"CA": ["Corrective Action"]} and "_text" not in sent
        told = json.loads(got["big"].cut) if got["big"].cut else None
        assert (told is None) == (budget == 10**6) and (steps is None or told["steps"] == steps)
        if n < 300:
            assert sent["recurring_phrases"][0]["count"] == 299 and told["original_chars"] > told["sent_chars"] == len(got["big"].payload)
        assert got["none"].payload == "{}"


def test_transports():
    """A local server in place of a model: both addresses, the fallback and the probe."""
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    asked = []

    class Server(BaseHTTPRequestHandler):
        def answer(self, code, body):
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def do_GET(self):
            self.answer(200, {"data": [{"id": "m1"}]})

        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            if self.path == "/api/chat":
                native = {"message": {"content": "{}"}, "done_reason": "stop", "prompt_eval_count": 7, "eval_count": 2, "model": "m1"}
                self.answer(*((200, native) if asked[-1][1]["model"] == "m1" else (500, {})))
            else:
                self.answer(200, {"choices": [{"message": {"content": "pong"}, "finish_reason": "stop"}], "usage": {"total_tokens": 3}, "model": "m2"})

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    try:
        say = [{"role": "user", "content": "x" * 60_000}]
        assert transports.native(base, "m1")(say, 100) == ("{}", "stop", {"prompt_tokens": 7, "completion_tokens": 2, "total_tokens": 9}, "m1", base[:-3] + "/api/chat")
        assert asked[-1][1]["options"]["num_ctx"] == 20_000 + 100 + 1024 and asked[-1][1]["think"] is False
        call = transports.with_fallback(transports.native(base, "other"), transports.compatible(base, "other"))
        assert call(say, 5)[0] == "pong" and call(say, 5)[3] == "m2" and [p for p, _ in asked[1:]] == ["/api/chat", "/v1/chat/completions", "/v1/chat/completions"]
        seen = transports.probe(base, "m1")
        assert seen["reachable"] and seen["models_available"] == ["m1"] and seen["chat_ok"] and seen["sample_reply"] == "pong"
    finally:
        server.shutdown()
        server.server_close()
    assert transports.probe(base, "m1", timeout=1)["reachable"] is False


def test_report_with_judgments(spark):
    """One document of each kind: judged, judged after a repair, failed, unreadable, and without a judgment."""
    rows = [(d, "The Corrective Action (CA) is done. CA again. A corrective action too.") for d in ("good", "mended", "failed", "unread", "none", "empty")]
    b = B.blocks_from_text(spark.createDataFrame(rows, "doc_id string, text string"), "doc_id", "text")
    found = plans.gather(b, spark.createDataFrame([("action", 9)], "word string, freq long"))
    meta = {"model_reported": "m|1", "usage": {"completion_tokens": 7}, "latency_ms": 5}
    told = {**GOOD, "acronym_table": [*GOOD["acronym_table"], {"acronym": "ZZ", "expansion": "Zig Zag", "status": "proposed"}], "acronym_issues": [{"acronym": "CA", "problem": "odd", "note": "see"}], "misspellings": [{"word": "teh", "suggestion": "the"}], "_meta": meta}
    answers = {"good": told, "mended": {**told, "customer": {"primary": "B", "normalize": ["x", "y"], "suspected_wrong": ["z"]}, "_meta": {**meta, "retries": {"repair": {"recovered": True}}, "findings_shrunk": {"original_chars": 9, "sent_chars": 5, "steps": ["places"]}}}, "failed": {"_error": "OSError: gone"}, "unread": {"_parse_error": "x", "_meta": meta}, "empty": {**GOOD, "acronym_table": [], "_meta": meta}}
    judged = spark.createDataFrame([(k, json.dumps(v)) for k, v in answers.items()], "doc_id string, judgment string")
    got = {r.doc_id: r.report for r in report.render(b, found, judged).collect()}
    assert "_Generated by model `m|1`, 7 completion tokens, 5 ms._" in got["good"] and "(generated by m|1; uses are exact" in got["good"]
    assert "| CA | Corrective Action | existing | 2 | 2 |  |" in got["good"] and "ZZ" not in got["good"]  # a proposed row that the text doesn't bear out
    assert "- `CA` — odd: see" in got["good"] and "- **teh** → the  __" in got["good"] and "- Primary: **Acme**" in got["good"]
    assert "repaired by one more call" in got["mended"] and "cut from 9 to 5" in got["mended"] and "- Normalize variants: x, y" in got["mended"] and "leftover: z" in got["mended"]
    assert "_Model pass FAILED (OSError: gone)." in got["failed"] and report.UNAVAILABLE in got["failed"]
    assert "**responded**" in got["unread"] and "(model `m|1`, 7 completion tokens, 5 ms)" in got["unread"] and report.SKIPPED in got["none"] and report.EMPTY_TABLE in got["empty"]
    for name in ("failed", "unread", "none", "empty"):
        assert "| CA | Corrective Action | existing | 2 | 2 |  |" in got[name]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() > 0
