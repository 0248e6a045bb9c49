"""Expressions against golden values and plain-Python versions."""

from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline import config, schemas
from plumbline.functions import text as X
from plumbline.operators import verify

TABLE_A = [["Metric", "Value"], ["Revenue (current period)", "$112M"], ["Revenue (prior period)", "$100M"]]
SENTENCE_A = "Revenue grew 12% YoY, driven primarily by APAC expansion and improved cost discipline, positioning us ahead of our closest competitor."


def one(spark, expression, **values):
    kinds = {k: (spark.createDataFrame([(v,)], f"`{k}` {'string' if v is None or isinstance(v, str) else 'double'}").schema[0].dataType.simpleString() if not isinstance(v, list) else ("array<array<string>>" if v and isinstance(v[0], list) else "array<string>")) for k, v in values.items()}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items())).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("$112M", 112e6), ("Revenue (current period) | $112M", 112e6), ("$1.5B", 1.5e9), ("no number here", None), (",", None), ("Current (Q3) | $112M", 3.0), ("12 months", 12e6), ("1,234k", 1234e3), (None, None)],
)
def test_parse_money(spark, text, want):
    assert one(spark, X.parse_money(F.col("t")), t=text) == want


def test_parse_percent(spark):
    assert one(spark, X.parse_percent(F.col("t")), t="Revenue grew 12% year-over-year") == 12.0
    assert one(spark, X.parse_percent(F.col("t")), t="fell -3.5 %") == -3.5
    assert one(spark, X.parse_percent(F.col("t")), t="none") is None


def test_current_prior(spark):
    text = one(spark, X.table_text(F.col("t")), t=TABLE_A)
    assert text == "Metric | Value\nRevenue (current period) | $112M\nRevenue (prior period) | $100M"
    assert tuple(one(spark, X.current_prior(F.col("t")), t=text)) == (112e6, 100e6)
    assert tuple(one(spark, X.current_prior(F.col("t")), t="current none\ncurrent and prior 5\nprior 7")) == (5.0, 7.0)
    assert tuple(one(spark, X.current_prior(F.col("t")), t="both current and prior 5\nboth current and prior 6")) == (5.0, 6.0)


def fold_by_hand(text):
    import re

    current = prior = None
    for line in text.split("\n"):
        m = re.search(X.MONEY, line)
        figure = float(m[1].replace(",", "")) * {"K": 1e3, "M": 1e6, "B": 1e9}.get((m[2] or "").upper(), 1) if m and m[1].strip(",") else None
        if current is None and "current" in line.lower():
            current = figure
        elif prior is None and "prior" in line.lower():
            prior = figure
    return current, prior


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["current", "Prior", "$5", "1,000", "x", "7.5M", ","]), max_size=4).map(" ".join), max_size=6).map("\n".join))
def test_current_prior_fold(spark, text):
    assert tuple(one(spark, X.current_prior(F.col("t")), t=text)) == fold_by_hand(text)


@pytest.mark.parametrize(
    ("verdict", "domain", "want"),
    [
        ("contradicted", "financial", "critical"), ("contradicted", "legal", "major"), ("disputed", "financial", "major"), ("disputed", "legal", "major"),
        ("insufficient", "financial", "minor"), ("insufficient", None, "minor"), ("supported", "financial", "info"), ("supported", "general", "info"),
    ],
)
def test_severity(spark, verdict, domain, want):
    assert one(spark, X.severity(F.col("v"), F.col("d")), v=verdict, d=domain) == want


def test_unknown_verdict_is_an_error(spark):
    with pytest.raises(Exception, match="unknown verdict"):
        one(spark, X.severity(F.col("v"), F.lit("legal")), v="maybe")


def test_tokens_and_overlap(spark):
    words = one(spark, X.content_words(F.col("t")), t="The Revenue-growth of Q3, and the revenue été!")
    assert sorted(words) == sorted(["revenue", "growth", "q3", "été"])
    pair = spark.createDataFrame([(["a", "b"], ["b", "c", "d"]), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in pair.select(X.overlap(F.col("a"), F.col("b"))).collect()] == [0.5, 0.0]
    rows = spark.createDataFrame([("Revenue (current period) | $1", ["current period revenue"]), ("cost", ["cost breakdown by department"]), ("x", [])], "t string, r array<string>")
    assert [r[0] for r in rows.select(X.matches_requires(F.col("t"), F.col("r"))).collect()] == [True, False, False]


def test_sentences_claims_citations(spark):
    text = "Revenue grew 12%. The team celebrated. Next quarter looks strong."
    assert one(spark, X.sentences(F.col("t")), t=text) == ["Revenue grew 12%.", "The team celebrated.", "Next quarter looks strong."]
    claim = one(spark, X.direct_claim(F.col("t")), t="Revenue grew 12%.")
    assert (claim.claim_type, claim.scope, claim.requires) == ("statistical", "internal", [])
    assert one(spark, X.direct_claim(F.col("t")), t="The team grew.").claim_type == "definitional"
    assert one(spark, X.needs_decomposition(F.col("t")), t=SENTENCE_A) is True
    assert one(spark, X.needs_decomposition(F.col("t")), t="Revenue grew 12% year over year.") is False
    assert one(spark, X.citation_fidelity(F.col("a"), F.col("b")), a="Revenue (current period) | $112M", b="$112m") is True
    assert one(spark, X.citation_fidelity(F.col("a"), F.col("b")), a="Revenue (prior period) | $100M", b="$112M") is False
    assert one(spark, X.citation(F.lit("ref"), F.lit(3), F.col("t")), t="Notes") == "ref page 3 section 'Notes'"
    assert one(spark, X.citation(F.lit("ref"), F.lit(None).cast("int"), F.col("t")), t="") == "ref"


def test_domains(spark):
    for title, want in (("Financial Highlights", "financial"), ("Legal Disclosures", "legal"), ("Executive Summary", None), ("Outlook", None)):
        assert one(spark, X.title_hint(F.col("t")), t=title) == want
    for text, want in (("Our approach complies with GDPR.", "legal"), ("Our EBITDA improved this quarter.", "financial"), ("We celebrated.", None), ("ebitda", None), ("grew yOy", "financial"), ("revenues", None)):
        assert one(spark, X.gazetteer_domain(F.col("t")), t=text) == want


def test_registry(spark):
    for domain, kind, method, ceiling in (("financial", "statistical", "deterministic", None), ("financial", "causal", "agent", None), ("general", "opinion", "agent", 0.6), ("legal", "opinion", None, None)):
        assert one(spark, verify.method_of(F.col("d"), F.col("c")), d=domain, c=kind) == method
        assert one(spark, verify.ceiling_of(F.col("d")), d=domain) == ceiling


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in rows.select(X.cosine(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(2**-0.5), 0.0]


def test_config(tmp_path):
    (tmp_path / "a.yaml").write_text("tolerance: 0.5  # points\nname: x\n")
    before = config.config_hash(str(tmp_path))
    assert len(before) == 16 and config.config_hash(str(tmp_path)) == before
    assert config.load_settings(str(tmp_path / "a.yaml")) == {"tolerance": 0.5, "name": "x"}
    (tmp_path / "b.md").write_text("hello {x}")
    assert config.config_hash(str(tmp_path)) != before
    assert config.load_template(str(tmp_path), "b") == config.load_template(str(tmp_path), "b.md") == "hello {x}"
    assert config.settings_hash({"a": 1, "b": 2}) == config.settings_hash({"b": 2, "a": 1})


def test_schemas(spark):
    assert {len(schemas.schema(n).fields) > 3 for n in schemas.names()} == {True}
    rows = spark.createDataFrame([("a", "docx"), ("b", "txt")], "document_id string, file_type string")
    good, bad = schemas.split_valid(rows, "documents")
    assert [r.document_id for r in good.collect()] == ["a"] and [r.document_id for r in bad.collect()] == ["b"]


def test_gazetteer_over_phrases(spark):
    """The first term decides; the longest, where several start there."""
    phrases = {
        "strong EBITDA and liability": "financial", "GDPR liability before revenue": "legal", "nothing to see": None, "free cash flow rose YoY": "financial",
        "yoy growth": "financial", "antitrust case": "legal", "Revenue grew": None, "SEC filing": "legal",
    }
    rows = spark.createDataFrame([(p,) for p in phrases], "text string")
    assert {r.text: r.d for r in rows.select("text", X.gazetteer_domain(F.col("text")).alias("d")).collect()} == phrases
