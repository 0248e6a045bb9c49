"""Operators on small rows: golden facts, folds against plain loops, streams against batches."""

from __future__ import annotations

import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from plumbline.operators import batching, classify, extract, ingest, layout, retrieve, review, tuning, verify, workflow
from plumbline.sources import files, providers
from plumbline.streaming import events as ev
from plumbline.streaming import pages

TABLE_TEXT = "Metric | Value\nRevenue (current period) | $112M\nRevenue (prior period) | $100M"

REPORT = [
    ("heading", "Q3 Business Report"), ("heading", "Executive Summary"), ("paragraph", "We did well."), ("heading", "Financial Highlights"),
    ("paragraph", "Revenue grew 12% YoY, and costs fell."), ("table", TABLE_TEXT), ("heading", "Outlook"), ("paragraph", "It looks good."),
]


def elements(spark, rows=REPORT, doc="d"):
    return spark.createDataFrame([(doc, i, t, x, i // 3) for i, (t, x) in enumerate(rows)], "document_id string, element_index int, type string, text string, page_number int")


def documents(spark, doc="d", name="q3.docx"):
    return spark.createDataFrame([(doc, name)], "document_id string, filename string")


def test_report_structure(spark):
    e = elements(spark)
    assert ingest.document_titles(e, documents(spark)).first().title == "Q3 Business Report"
    assert ingest.document_titles(elements(spark, [("heading", ""), ("paragraph", "x")]), documents(spark)).first().title == "q3.docx"
    assert ingest.page_estimate(e).first().page_count == 1
    body = ingest.with_heading(e)
    capsules = [r[0] for r in body.orderBy("element_index").select(ingest.capsule(F.lit("Q3 Business Report"), F.col("section_title"))).collect()]
    assert len(capsules) == 4 and capsules[2] == "Q3 Business Report > Financial Highlights"
    sections = [(r.title, r.start_index, r.end_index) for r in ingest.headed_sections(e).orderBy("order_index").collect()]
    assert sections == [("Q3 Business Report", 1, 1), ("Executive Summary", 2, 3), ("Financial Highlights", 4, 6), ("Outlook", 7, 8)]
    assigned = {r.element_index: r.order_index for r in ingest.assign_sections(e, ingest.headed_sections(e)).collect()}
    assert assigned == {0: None, 1: None, 2: 1, 3: None, 4: 2, 5: 2, 6: None, 7: 3}
    out = ingest.run_ingestion(e, documents(spark))
    done = out["documents"].first()
    assert (done.status, done.page_count, done.has_structural_index) == ("ingested", 1, False) and out["sections"].count() == 0 and out["chunks"].count() >= 4


@pytest.mark.parametrize(("words", "pages"), [(1000, 2), (600, 2), (100, 1)])
def test_page_estimate_rounds_half_to_even(spark, words, pages):
    assert ingest.page_estimate(elements(spark, [("paragraph", "w " * words)])).first().page_count == pages


def test_window_starts(spark):
    for n in [*range(25), 98, 99]:
        starts, at = [], 0
        while n:
            starts.append(at)
            if at + 10 >= n:
                break
            at += 8
        rows = spark.createDataFrame([([f"s{i}" for i in range(n)],)], "s array<string>")
        got = [(w.start_sentence, w.end_sentence, w.chunk_text) for w in rows.select(ingest.windows(F.col("s")).alias("w")).first().w]
        assert got == [(a, min(a + 10, n) - 1, " ".join(f"s{i}" for i in range(a, min(a + 10, n)))) for a in starts]
    with pytest.raises(ValueError):
        ingest.windows(F.col("s"), 5, 5)


def test_topic_sections(spark):
    rows = [("table", "t"), ("paragraph", "apple pear plum"), ("paragraph", "apple pear fig"), ("table", "t"), ("paragraph", "motor wheel"), ("paragraph", "motor wheel brake")]
    got = [(r.start_index, r.end_index) for r in ingest.topic_sections(elements(spark, rows)).orderBy("order_index").collect()]
    assert got == [(1, 4), (4, 6)]


def test_relink_last_wins(spark):
    chunks = spark.createDataFrame([("d", 1, 2), ("d", 2, None), ("d", 3, 9)], "document_id string, chunk_id int, page_number int")
    sections = spark.createDataFrame([("d", 0, 1, 3), ("d", 1, 2, 4), ("d", 2, None, 1)], "document_id string, order_index int, page_start int, page_end int")
    assert {r.chunk_id: r.order_index for r in ingest.relink_by_page(chunks, sections).collect()} == {1: 1, 2: None, 3: None}


CLAIM = "claim_id string, document_id string, section_id string, claim_text string, domain string, claim_type string, scope string, requires array<string>"


def claims(spark, *rows):
    base = {"claim_id": "c", "document_id": "d", "section_id": None, "claim_text": "Revenue grew 12% year-over-year", "domain": "financial", "claim_type": "statistical", "scope": "internal", "requires": ["current period revenue", "prior period revenue"]}
    return spark.createDataFrame([tuple((base | r).values()) for r in rows or ({},)], CLAIM)


def candidates(spark, text=TABLE_TEXT, section="s2"):
    rows = [("t1", "d", section, "internal_table", text, 1, "Financial Highlights", 0), ("k1", "d", "s1", "internal_chunk", "Nothing here", 1, "Executive Summary", 1), ("t2", "x", section, "internal_table", text, 1, None, 0)]
    return spark.createDataFrame(rows, "candidate_id string, document_id string, section_id string, source_type string, content string, page_number int, section_title string, ordinal int")


def test_internal_lookup(spark):
    got = retrieve.internal_lookup(claims(spark), candidates(spark)).collect()
    assert [(r.source_type, r.source_ref, r.authority_score) for r in got] == [("internal_table", "extracted_table:t1 page 1 section 'Financial Highlights'", 1.0)]
    assert retrieve.internal_lookup(claims(spark, {"requires": ["cost breakdown by department"]}), candidates(spark)).count() == 0
    assert retrieve.internal_lookup(claims(spark, {"section_id": "s1"}), candidates(spark)).count() == 0


def test_dispatch_by_scope(spark):
    sections = spark.createDataFrame([("s2", "d", "Financial Highlights", "current and prior period revenue")], "section_id string, document_id string, title string, summary string")
    rows = claims(spark, {"claim_id": "hit"}, {"claim_id": "miss", "section_id": "s1"}, {"claim_id": "out", "scope": "external"}, {"claim_id": "both", "scope": "both"})
    got = retrieve.dispatch(rows, candidates(spark), lambda missed: retrieve.pick_section(missed, sections)).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.claim_id, []).append(r.source_type)
    assert {k: sorted(v) for k, v in kinds.items()} == {"hit": ["internal_table"], "miss": ["internal_table"], "out": ["external"], "both": ["external", "internal_table"]}


@pytest.mark.parametrize(("text", "want"), [("Revenue grew 12% year-over-year", "supported"), ("Revenue grew 40% year-over-year", "contradicted"), ("Revenue grew", "insufficient")])
def test_verify(spark, text, want):
    reviews = spark.createDataFrame([], "claim_id string, verifier_verdict string, verifier_confidence double, challenger_verdict string, challenger_confidence double")
    got = verify.verify(claims(spark, {"claim_text": text}), candidates(spark), reviews).first()
    assert (got.final_verdict, got.resolved_by) == (want, "deterministic")
    unrelated = verify.verify(claims(spark, {"claim_text": text}), candidates(spark, "Headcount | 5"), reviews).first()
    assert unrelated.final_verdict == "insufficient"


def test_reconcile(spark):
    rows = spark.createDataFrame([("a", "legal", "supported", 0.9, "supported", 0.7), ("b", "legal", "supported", 0.9, "contradicted", 0.7)], "claim_id string, domain string, verifier_verdict string, verifier_confidence double, challenger_verdict string, challenger_confidence double")
    got = {r.claim_id: (r.final_verdict, r.final_confidence, r.severity) for r in verify.reconcile(rows).collect()}
    assert got == {"a": ("supported", 0.7, "info"), "b": ("disputed", 0.0, "major")}


def test_cascade(spark):
    points = spark.createDataFrame([("financial", [1.0, 0.0]), ("general", [0.0, 1.0])], "label string, centroid array<double>")
    rows = spark.createDataFrame(
        [("a", "x", "Financial Highlights", [0.0, 1.0]), ("b", "Our approach complies with GDPR.", None, [1.0, 0.0]), ("c", "We celebrated.", "Outlook", [0.1, 1.0])],
        "claim_id string, claim_text string, section_title string, embedding array<double>",
    )
    got = {r.claim_id: (r.domain, r.domain_confidence, r.domain_source) for r in classify.classify(rows, points).collect()}
    assert got == {"a": ("financial", 0.95, "structural"), "b": ("legal", 0.85, "terminology"), "c": ("general", 0.6, "semantic")}


def test_extraction_waits_for_a_decomposer(spark):
    chunks = spark.createDataFrame([("d", "k", "paragraph", "Revenue grew 12%. Sales rose and costs fell."), ("d", "t", "table", "a | 1")], "document_id string, chunk_id string, chunk_type string, chunk_text string")
    assert [r.claim_text for r in extract.extract_claims(chunks).collect()] == ["Revenue grew 12%."]
    both = extract.extract_claims(chunks, lambda s: s.select("*", F.explode(F.split("sentence", " and ")).alias("part")).select(*s.columns, F.col("part").alias("claim_text"), F.col("sentence").alias("source_span"), F.lit("causal").alias("claim_type"), F.lit("internal").alias("scope"), F.array(F.lit("x")).alias("requires")))
    assert both.count() == 3


def pack_by_hand(sizes, most, items=None):
    out, batch, used, n = [], 0, 0, 0
    for s in sizes:
        if n and (used + s > most or (items and n >= items)):
            batch, used, n = batch + 1, 0, 0
        out.append(batch)
        used, n = used + s, n + 1
    return out


def test_packing(spark):
    rng = random.Random(0)
    rows = [(i, [rng.randrange(60) for _ in range(rng.randrange(30))]) for i in range(60)] + [(99, [100]), (98, [30] * 4)]
    frame = spark.createDataFrame(rows, "id int, s array<bigint>")
    for items in (None, 3):
        got = {r.id: r.b for r in frame.select("id", batching.pack(F.col("s"), most=50, items=items).alias("b")).collect()}
        assert got == {i: pack_by_hand(s, 50, items) for i, s in rows}


def test_hierarchical_summaries(spark):
    chunks = spark.createDataFrame([("long", i, f"w{i} " * 40) for i in range(12)] + [("short", 0, "one two")], "section_id string, ordinal int, text string")
    got = {r.section_id: r.calls for r in batching.summarize_sections(chunks, lambda t: t.select("section_id", "batch", "calls", F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("summary")), direct=100).collect()}
    assert got == {"long": 7, "short": 1}


def test_snapshots(spark, tmp_path):
    text = {"claim_text": "Revenue grew 12.6% year-over-year"}
    reviews = spark.createDataFrame([], "claim_id string, verifier_verdict string, verifier_confidence double, challenger_verdict string, challenger_confidence double")
    for tolerance in (0.5, 1.0):
        rows = verify.verify(claims(spark, text, {"claim_id": "same"}), candidates(spark), reviews, tolerance)
        tuning.write_snapshot(rows.withColumns({"document_id": F.lit("d"), "domain": F.lit("financial"), "scope": F.lit("internal")}), str(tmp_path), f"h{tolerance}")
    a, b = (tuning.read_snapshot(spark, str(tmp_path), "d", f"h{t}") for t in (0.5, 1.0))
    assert [tuple(r) for r in tuning.diff(a, b).collect()] == [("c", "final_verdict", "contradicted", "supported")]
    with pytest.raises(FileNotFoundError):
        tuning.read_snapshot(spark, str(tmp_path), "d", "other")


def lines_by_hand(words):
    out = []
    for w in sorted(words, key=lambda w: (round(w[3]), w[2], w[3], w[1], w[4])):
        if out and abs(out[-1]["top"] - w[3]) < 3:
            out[-1]["w"].append(w)
        else:
            out.append({"top": w[3], "w": [w]})
    return [(x["top"], " ".join(w[1] for w in x["w"]), sum(w[4] for w in x["w"]) / len(x["w"])) for x in out]


def blocks_by_hand(lines, threshold):
    out = []
    for top, text, size in lines:
        kind = "heading" if size >= threshold else "paragraph"
        b = out[-1] if out else None
        if b and kind == b["type"] and abs(size - b["size"]) < 0.5 and top - b["last"] < b["size"] * 1.9:
            b["texts"].append(text)
            b["last"] = top
        else:
            out.append({"type": kind, "texts": [text], "top": top, "last": top, "size": size})
    return [(b["type"], b["top"], " ".join(b["texts"])) for b in out]


def test_layout_folds(spark):
    import statistics

    rng = random.Random(4)
    words = [(d, f"w{i}", float(rng.randrange(400)), rng.randrange(600) / 2, rng.choice([11.0, 11.3, 16.0])) for d in range(8) for i in range(rng.randrange(1, 90))]
    frame = spark.createDataFrame([(str(d), 1, t, x, y, s) for d, t, x, y, s in words], "document_id string, page_number int, text string, x0 double, top double, size double")
    got_lines = layout.lines(frame)
    got_blocks = layout.blocks(got_lines, layout.heading_threshold(frame)).collect()
    for d in {w[0] for w in words}:
        mine = [w for w in words if w[0] == d]
        want = lines_by_hand(mine)
        got = [(r.top, r.text, r.size) for r in got_lines.where(F.col("document_id") == str(d)).orderBy("line_index").collect()]
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))
        threshold = statistics.median(w[4] for w in mine) * 1.15
        assert [(r.type, r.top, r.text) for r in sorted((b for b in got_blocks if b.document_id == str(d)), key=lambda b: b.block_index)] == blocks_by_hand(want, threshold)


def test_page_elements_and_ocr(spark):
    words = spark.createDataFrame([("d", 1, "Title", 10.0, 10.0, 16.0), ("d", 1, "in", 60.0, 60.0, 11.0), ("d", 1, "body", 10.0, 200.0, 11.0), ("d", 1, "text", 40.0, 200.5, 11.0)], "document_id string, page_number int, text string, x0 double, top double, size double")
    boxes = spark.createDataFrame([("d", 1, 50.0, 50.0, 100.0, 100.0, [["a"]])], "document_id string, page_number int, x0 double, top double, x1 double, bottom double, data array<array<string>>")
    assert [(r.type, r.text) for r in layout.page_elements(words, boxes).orderBy("element_index").collect()] == [("heading", "Title"), ("table", None), ("paragraph", "body text")]
    ocr = spark.createDataFrame([("d", 2, 0, "GDPR", 90.0), ("d", 2, 1, " ", -1.0), ("d", 2, 2, "rules", 70.0), ("d", 3, 0, " ", -1.0)], "document_id string, page_number int, ordinal int, text string, conf double")
    assert {r.page_number: (r.text, r.ocr_confidence) for r in layout.ocr_pages(ocr).collect()} == {2: ("GDPR rules", 0.8), 3: ("", 0.0)}
    pages = spark.createDataFrame([(1, "x" * 21), (2, "x" * 20), (3, None)], "p int, text string")
    assert [r.source for r in layout.native_pages(pages).orderBy("p").collect()] == ["native", "ocr", "ocr"]


DOCUMENT = (
    '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'
    '<w:p><w:pPr><w:pStyle w:val="Title"/></w:pPr><w:r><w:t>Q3 Business Report</w:t></w:r></w:p>'
    '<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Summary</w:t></w:r></w:p><w:p><w:r><w:t>  </w:t></w:r></w:p>'
    "<w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text.</w:t></w:r></w:p>"
    "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>Metric</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>Value</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"
)


def test_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", DOCUMENT)
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "C.PDF").write_text("x")
    good, bad = files.uploads(spark, str(tmp_path))
    assert sorted(r.file_type for r in good.collect()) == ["docx", "pdf"] and [r.reason for r in bad.collect()] == ["unsupported file type"]
    assert files.uploads(spark, str(tmp_path), max_mb=0)[0].count() == 0
    assert files.by_kind(good)["docx"].count() == 1
    with pytest.raises(Exception, match="unsupported"):
        files.by_kind(bad)["docx"].collect()
    got = [(r.element_index, r.type, r.level, r.text, r.data) for r in files.read_docx(spark, str(tmp_path)).orderBy("element_index").collect()]
    assert got == [(0, "heading", 0, "Q3 Business Report", None), (1, "heading", 1, "Summary", None), (2, "paragraph", None, "Some text.", None), (3, "table", None, None, [["Metric", "Value"]])]
    (tmp_path / "terms.jsonl").write_text('{"label": "A", "pattern": "x"}\n')
    assert files.read_terms(spark, str(tmp_path / "terms.jsonl")).first().pattern == "x"
    files.persist({"documents": good}, str(tmp_path / "out"), good.limit(1))
    assert spark.read.parquet(str(tmp_path / "out/documents")).count() == 2


def test_heading_levels():
    assert [files.heading_level(s) for s in ("Title", "Heading 2", "Heading", "Normal", "Subtitle")] == [0, 2, 1, None, None]


def test_providers(spark):
    waits, calls = [], []

    def flaky(batch):
        calls.append(len(batch))
        if len(calls) < 3:
            raise OSError
        return [x + 1 for x in batch]

    assert providers.with_retry(flaky, sleep=waits.append)([1]) == [2] and waits == [1.0, 2.0]

    def barred(_):
        raise providers.MissingCredentials

    with pytest.raises(providers.MissingCredentials):
        providers.with_retry(barred, sleep=waits.append)([1])
    rows = spark.createDataFrame([("a b",), ("a b",), (None,)], "chunk_text string")
    got = [r.embedding for r in providers.embed(rows).collect()]
    assert got[0] == got[1] and sum(x * x for x in got[0]) == pytest.approx(1) and got[2] == [0.0] * 64
    asked = spark.createDataFrame([("p",)], "prompt string")
    assert providers.review(asked, lambda xs: [("supported", 0.9, "r") for _ in xs]).first().review.verdict == "supported"
    summary = providers.summarize(spark.createDataFrame([("x " * 400,)], "text string")).first().summary
    assert len(summary.split()) == 150


def test_history(spark):
    docs = spark.createDataFrame([(i, f"s{i % 2}", i) for i in range(6)], "document_id int, status string, created_at int")
    owned = spark.createDataFrame([(10, 5), (11, 5), (12, 1)], "claim_id int, document_id int")
    verdicts = spark.createDataFrame([(1, 10, "supported", 1), (2, 10, "disputed", 2), (3, 11, "supported", 1)], "verdict_id int, claim_id int, final_verdict string, resolved_at int")
    page = review.history_page(docs, owned, verdicts, limit=2).orderBy("document_id").collect()
    assert [(r.document_id, r.claim_summary) for r in page] == [(4, None), (5, {"disputed": 1, "supported": 2})]
    assert [r.document_id for r in review.history_page(docs, owned, verdicts, status="s0", limit=2, offset=1).orderBy("document_id").collect()] == [0, 2]
    assert {r.claim_id: r.final_verdict for r in verify.latest(verdicts).collect()} == {10: "disputed", 11: "supported"}


def test_event_stream_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"d{rng.randrange(3)}", i, rng.choice(["ingest_progress", "ingest_complete", "claim_extracted", "claim_verified"]), "{}") for i in range(60)] + [("d1", 60, "verification_complete", "{}")]
    for part in (rows[:30], rows[30:]):
        ev.append_events(spark.createDataFrame(part, "document_id string, seq bigint, event string, payload string"), str(tmp_path / "log"))
    stream = ev.fold(ev.event_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("folded").start()
    stream.processAllAvailable()
    stream.stop()
    batch = ev.fold(spark.read.parquet(str(tmp_path / "log")))
    assert sorted(map(tuple, spark.table("folded").collect())) == sorted(map(tuple, batch.collect()))
    assert {r.document_id: r.ended for r in batch.collect()}["d1"] is True
    pages = spark.range(1, 81).where(ev.reports_progress(F.col("id"), F.lit(80))).collect()
    assert [r.id for r in pages] == [*range(5, 81, 5)]


def test_whole_run(spark, tmp_path):
    one, none = REPORT, "empty"
    both = documents(spark).unionByName(documents(spark, none, "none.docx"))
    points = spark.createDataFrame([("financial", providers.hashed_vector(["revenue costs"])[0]), ("general", providers.hashed_vector(["weather"])[0])], "label string, centroid array<double>")

    def decompose(sentences):
        # stands in for a model: one claim a joined sentence, with what it requires
        claim = F.struct(
            F.col("sentence").alias("claim_text"), F.col("sentence").alias("source_span"), F.lit("statistical").alias("claim_type"), F.lit("both").alias("scope"),
            F.array(F.lit("current period revenue"), F.lit("prior period revenue")).alias("requires"),
        )
        return sentences.select("*", claim.alias("c")).select(*sentences.columns, "c.*")

    def reviews(found, evidence):
        return found.select("claim_id", F.lit("supported").alias("verifier_verdict"), F.lit(0.9).alias("verifier_confidence"), F.lit("supported").alias("challenger_verdict"), F.lit(0.7).alias("challenger_confidence"))

    out = workflow.process(elements(spark, one), both, str(tmp_path), points, reviews, resolved_at="2026-01-01 00:00:00", decompose=decompose)
    assert {r.document_id: r.status for r in out["documents"].collect()} == {"d": "complete", none: "failed"}
    found = out["claims"].where("claim_text like 'Revenue grew%'").collect()
    assert len(found) == 1 and (found[0].domain, found[0].domain_source) == ("financial", "structural")
    kinds = sorted(r.source_type for r in out["evidence"].where(F.col("claim_id") == found[0].claim_id).collect())
    assert kinds == ["external", "internal_table"]
    verdict = out["verdicts"].where(F.col("claim_id") == found[0].claim_id).first()
    assert (verdict.final_verdict, verdict.final_confidence, verdict.resolved_by) == ("supported", 1.0, "deterministic")
    assert out["verdicts"].count() == out["claims"].count()
    assert {r.document_id: r.stage for r in out["pipeline_runs"].collect()} == {"d": "ingest", none: "ingest"}
    agents = out["verdicts"].where("resolved_by = 'agent'").count()
    assert out["agent_traces"].count() == 2 * agents > 0 and out["verdicts"].where("verifier_reasoning is null and resolved_by = 'deterministic'").count() == 0
    assert [r.event for r in out["events"].where("document_id = 'd'").orderBy("seq").collect()][:2] == ["ingest_progress", "ingest_complete"]
    folded = {r.document_id: r for r in ev.fold(out["events"]).collect()}
    assert (folded["d"].stage, folded["d"].n_verified, folded["d"].ended) == ("verification_complete", out["claims"].count(), True)
    assert folded[none].last_event == "ingest_failed" and folded[none].ended
    again = workflow.reverify(out["claims"], spark.createDataFrame([(found[0].claim_id,)], "claim_id string"), out["candidates"], reviews(out["claims"], None), str(tmp_path), "2026-01-02 00:00:00")
    history = spark.read.parquet(str(tmp_path / "verdicts")).where(F.col("claim_id") == found[0].claim_id)
    assert again.count() == 1 and history.count() == 2 and verify.latest(history).first().verdict_id == again.first().verdict_id


def test_pages_as_a_stream_equal_the_batch(spark, tmp_path):
    rows = elements(spark)
    for page in range(3):
        rows.where(F.col("page_number") == page).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    stream = pages.carried(source).writeStream.format("memory").queryName("carried").start()
    stream.processAllAvailable()
    stream.stop()
    want = ingest.running_offsets(ingest.with_heading(rows)).select("element_index", "section_title", "char_start")
    got = spark.table("carried").select("element_index", "section_title", "char_start")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stages_from_the_command_line(spark, tmp_path, capsys):
    import json

    from plumbline.__main__ import main

    at = {n: str(tmp_path / n) for n in ("elements", "documents", "chunks", "snapshots")}
    elements(spark).withColumn("ocr_confidence", F.lit(0.4)).write.parquet(at["elements"])
    documents(spark).write.parquet(at["documents"])
    main(["ingest", "--elements", at["elements"], "--documents", at["documents"], "--ocr"], spark)
    shown = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert len(shown) >= 4 and all(r["low_confidence_ocr"] for r in shown)
    made = ingest.run_ingestion(elements(spark), documents(spark))["chunks"].withColumn("chunk_id", F.concat_ws("-", "element_index", "chunk_index"))
    made.write.parquet(at["chunks"])
    main(["extract", "--chunks", at["chunks"], "--out", str(tmp_path / "claims")], spark)
    assert {r.claim_text for r in spark.read.parquet(str(tmp_path / "claims")).collect()} >= {"We did well.", "It looks good."}


def test_lookup_queries_require_whole_texts(spark, sf_dir):
    """The registered lookup against pairs of whole texts, compared by hand."""
    from plumbline import config
    from plumbline.plans import claim_queries
    from plumbline.plans.bindings import table

    words = lambda text: {w for w in re.findall(r"[^\W_]+", text.lower()) if w not in config.STOPWORDS}
    wanted = [(r.item_id, words(r.text)) for r in table(spark, sf_dir, "benchmark").collect()]
    docs = [(r.doc_id, int(r.source[3:12]), words(r.text)) for r in table(spark, sf_dir, "documents").where("text is not null and source is not null").collect()]
    want = {(i, d) for i, w in wanted for d, source, ws in docs if w and i % 20 == source and 2 * len(w & ws) >= len(w)}
    got = claim_queries.internal_lookup(spark, sf_dir).collect()
    assert {(r.claim_id, r.candidate_id) for r in got} == want and len(got) == len(want) > 0


def test_providers_without_access_leave_rows_blocked(spark):
    asked = spark.createDataFrame([(i, f"t{i}") for i in range(7)], "id int, prompt string").coalesce(1)
    calls = spark.sparkContext.accumulator(0)

    def barred(batch):
        calls.add(1)
        raise providers.MissingCredentials

    got = providers.apply_provider(asked, "prompt", "answer", "string", barred, inputs=2, blocked="blocked").collect()
    assert [(r.answer, r.blocked) for r in got] == [(None, True)] * 7 and calls.value == 1
    chunks = spark.createDataFrame([("a", 0, "x " * 90), ("a", 1, "y " * 90), ("b", 0, "z")], "section_id string, ordinal int, text string")
    done = batching.summarize_sections(chunks, lambda t: providers.summarize(t, barred), direct=100).collect()
    assert sorted((r.section_id, r.summary) for r in done) == [("a", None), ("b", None)]
    rows = elements(spark).withColumn("data", F.lit(None).cast("array<array<string>>"))
    made = ingest.with_summaries(ingest.headed_sections(rows), rows, lambda t: providers.summarize(t, barred)).orderBy("order_index").collect()
    assert [(r.summary, r.summary_word_count, r.summary_method) for r in made] == [(None, None, None)] + [(None, None, "blocked_credentials")] * 3
    reviews = spark.createDataFrame([("c", None, None, None, None)], "claim_id string, verifier_verdict string, verifier_confidence double, challenger_verdict string, challenger_confidence double")
    pending = verify.verify(claims(spark, {"claim_type": "causal"}), candidates(spark), reviews)
    assert pending.count() == 0


def test_batches_keep_both_limits(spark):
    sizes = [4, 4, 3, 9, 12, 1, 1, 1, 1]
    assert list(providers.packed(sizes, 10, 3)) == [(0, 2), (2, 3), (3, 4), (4, 5), (5, 8), (8, 9)]
    assert list(providers.packed(sizes, None, 4)) == [(0, 4), (4, 8), (8, 9)] and list(providers.packed([], 5, 5)) == []
    seen = []
    frame = spark.createDataFrame([("w " * n,) for n in (3, 3, 30, 3)], "chunk_text string").coalesce(1)
    out = providers.apply_provider(frame, "chunk_text", "n", "int", lambda xs: seen.append(xs) or [len(xs)] * len(xs), tokens=8)
    assert [r.n for r in out.collect()] == [2, 2, 1, 1]
    long = frame.select(providers.guard_tokens(F.col("chunk_text"), 20).alias("t")).collect()
    assert [len(r.t.split()) for r in long] == [3, 3, 15, 3]


def test_verdicts_say_why(spark):
    found = verify.verify(claims(spark, {"claim_text": "Revenue grew 40% year-over-year"}), candidates(spark), spark.createDataFrame([], "claim_id string, verifier_verdict string, verifier_confidence double, challenger_verdict string, challenger_confidence double"))
    row = found.first()
    assert found.columns == list(verify.VERDICT) and row.verifier_verdict is None and "12.00%" in row.verifier_reasoning and "40.00%" in row.verifier_reasoning
    reviews = spark.createDataFrame([("c", "supported", 0.9, "good", "asked", "raw")], "claim_id string, verifier_verdict string, verifier_confidence double, verifier_reasoning string, verifier_prompt string, verifier_raw string")
    reviews = reviews.withColumns({"challenger_verdict": F.lit("disputed"), "challenger_confidence": F.lit(0.5)})
    traces = {r.agent_name: r for r in verify.traces(reviews, "h", "2026-01-01 00:00:00").collect()}
    assert (traces["verifier"].prompt_sent, traces["verifier"].raw_response) == ("asked", "raw")
    assert traces["challenger"].raw_response == '{"verdict":"disputed","confidence":0.5}' and len({t.trace_id for t in traces.values()}) == 2
    shown = review.trace_view(verify.traces(reviews, "h", "2026-01-01 00:00:00")).first()
    assert shown.created_at == "2026-01-01T00:00:00"


def test_portable_documents_through_a_reader(spark):
    """Bytes through a callable to the elements of native and scanned pages."""

    def reader(content):
        assert content == b"%PDF"
        words = [("Results", 10.0, 10.0, 20.0), ("We", 10.0, 60.0, 11.0), ("did", 30.0, 60.5, 11.0), ("inside", 60.0, 210.0, 11.0), ("well.", 10.0, 72.0, 11.0), ("and", 40.0, 72.0, 11.0), ("so", 60.0, 72.0, 11.0)]
        native = {"text": "Results We did well and more than twenty", "words": words, "boxes": [(50.0, 200.0, 300.0, 300.0, [["a", "b"]])]}
        return [native, {"text": " ", "read": [("Scanned", 80), ("", 50), ("page", 60), ("x", -1)]}, {"read": []}]

    rows = spark.createDataFrame([("p", "pdf", bytearray(b"%PDF"))], "document_id string, file_type string, content binary")
    got = [(r.element_index, r.page_number, r.type, r.text, r.data, r.ocr_confidence) for r in files.parse_documents(rows, reader).orderBy("element_index").collect()]
    assert got == [
        (0, 1, "heading", "Results", None, None),
        (1, 1, "paragraph", "We did well. and so", None, None),
        (2, 1, "table", None, [["a", "b"]], None),
        (3, 2, "paragraph", "Scanned page x", None, pytest.approx(0.19 / 0.3)),
    ]


def test_settings_files(spark, tmp_path):
    import importlib.util

    if importlib.util.find_spec("yaml") is None:
        pytest.skip("no yaml package")
    from plumbline import config

    (tmp_path / "registry.yaml").write_text("- {domain: a, claim_type: '*', verification_method: agent, confidence_ceiling: 0.6}\n- domain: b\n  claim_type: causal\n  verification_method: deterministic\n")
    assert config.load_registry(str(tmp_path / "registry.yaml")) == (("a", "*", "agent", 0.6), ("b", "causal", "deterministic", None))
    (tmp_path / "exemplars.yaml").write_text("a:\n  - One.\n  - Two.\nb:\n  - Three.\n")
    rows = config.load_exemplars(str(tmp_path / "exemplars.yaml"))
    assert rows == [("a", "One."), ("a", "Two."), ("b", "Three.")]
    vectors = providers.embed(spark.createDataFrame(rows, "label string, chunk_text string"))
    assert {r.label for r in classify.centroids(vectors).collect()} == {"a", "b"}


def test_structure_of_documents_that_came_by_pages(spark, tmp_path):
    rows = elements(spark).withColumn("data", F.lit(None).cast("array<array<string>>"))
    chunks = rows.where("type <> 'heading'").select("document_id", F.col("element_index").alias("chunk_id"), "page_number")
    made = ingest.finalize_structure(rows, chunks, spark.createDataFrame([("d", 80)], "document_id string, page_count int"), providers.summarize)
    assert made["documents"].first().has_structural_index and made["documents"].first().status == "ingested"
    sections = made["sections"].orderBy("order_index").collect()
    assert [(r.title, r.page_start, r.page_end, r.summary) for r in sections][1:3] == [("Executive Summary", 0, 0, "We did well."), ("Financial Highlights", 1, 1, "Revenue grew 12% YoY, and costs fell.")]
    short = ingest.finalize_structure(rows, chunks, spark.createDataFrame([("d", 5)], "document_id string, page_count int"))
    assert not short["documents"].first().has_structural_index and short["sections"].count() == 0 and all(r.order_index is None for r in short["chunks"].collect())


def test_vectors_are_searched_in_batches(spark):
    rng = random.Random(4)
    vectors = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(300)]
    vectors[5] = vectors[9] = vectors[2]
    odd = [(900, [1.0]), (901, [None] * 6), (902, [0.0] * 6), (903, None)]
    chunks = spark.createDataFrame(list(enumerate(vectors)) + odd, "chunk_id int, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([("a", vectors[2]), ("b", vectors[7]), ("none", [0.0] * 6)], "query_id string, vector array<double>")
    got = {}
    for r in retrieve.similar_many(chunks, asked, 4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.chunk_id))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    for name, q in (("a", vectors[2]), ("b", vectors[7])):
        best = sorted((-round(cosine(v, q), 12), i) for i, v in enumerate(vectors))[:4]
        assert sorted(got[name]) == [(k + 1, i) for k, (_, i) in enumerate(best)]
    assert sorted(got["none"]) == [(k + 1, k) for k in range(4)]
    pairs = spark.createDataFrame([(i % 3, i, v) for i, v in enumerate(vectors)], "document_id int, claim_id int, embedding array<double>")
    near = {r.claim_id: r.same_as for r in classify.near_claims(pairs, 0.9).collect()}
    want = {}
    for i, v in enumerate(vectors):
        same = [j for j in range(i) if j % 3 == i % 3 and cosine(v, vectors[j]) >= 0.9]
        if same:
            want[i] = same[0]
    assert near == want and near
