"""Column expressions over texts: tokens, overlap, figures, sentences, citations, domains, verdict rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline import config

SENTENCE = r"[^.!?\n]+[.!?]*"
# How figures are written.
MONEY = r"\$?([\d,]+(?:\.\d+)?)\s*([MBKmbk])?"
PERCENT = r"(-?\d+(?:\.\d+)?)\s*%"


def content_words(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits that aren't stopwords."""
    parts = F.split(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", " ")), " +")
    return F.array_except(parts, F.array(*map(F.lit, ("", *config.STOPWORDS))))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two word arrays; 0 if either is empty."""
    empty = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(empty, 0.0).otherwise(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b))))


def matches_requires(text: Column, requires: Column) -> Column:
    """Whether at least half of any phrase's content words appear in the text."""
    words = content_words(text)

    def half(phrase: Column) -> Column:
        wanted = content_words(phrase)
        return (F.size(wanted) > 0) & (F.size(F.array_intersect(wanted, words)) * 2 >= F.size(wanted))

    return F.coalesce(F.exists(requires, half), F.lit(False))


def table_text(rows: Column) -> Column:
    """Cells joined by `` | `` (null as ``None``), rows by line feeds."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " | ", "None")), "\n")


def citation(ref: Column, page: Column, title: Column) -> Column:
    named = F.when(title != "", F.concat(F.lit("section '"), title, F.lit("'")))
    return F.concat_ws(" ", ref, F.when(page.isNotNull(), F.concat(F.lit("page "), page.cast("string"))), named)


def citation_fidelity(span: Column, content: Column) -> Column:
    """Whether the content stands in the span, whatever the case."""
    return F.contains(F.lower(span), F.lower(content))


def parse_money(text: Column) -> Column:
    """The first figure with its K, M or B; null without one (a lone comma as well)."""
    figure = F.regexp_replace(F.regexp_extract(text, MONEY, 1), ",", "").try_cast("double")
    unit = F.upper(F.regexp_extract(text, MONEY, 2))
    return figure * F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)


def parse_percent(text: Column) -> Column:
    """The first percentage as stated; its direction in words is ignored."""
    return F.regexp_extract(text, PERCENT, 1).try_cast("double")


def current_prior(text: Column) -> Column:
    """struct(current, prior): a line with "current" is read while current is missing, else a line with
    "prior" while that is missing; a line whose figure can't be read is used up."""
    start = F.struct(F.lit(None).cast("double").alias("current"), F.lit(None).cast("double").alias("prior"))

    def step(state: Column, line: Column) -> Column:
        low = F.lower(line)
        first = state["current"].isNull() & F.contains(low, F.lit("current"))
        second = ~first & state["prior"].isNull() & F.contains(low, F.lit("prior"))
        figure = parse_money(line)
        return F.struct(
            F.when(first, figure).otherwise(state["current"]).alias("current"), F.when(second, figure).otherwise(state["prior"]).alias("prior")
        )

    return F.aggregate(F.split(text, r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"), start, step)


def sentences(text: Column) -> Column:
    """Trimmed sentences that aren't blank (rule-based boundaries)."""
    found = F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.trim(s, F.lit(" \t\r"))), lambda s: s != "")


def word_count(text: Column) -> Column:
    """Words between runs of white space."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def title_hint(title: Column) -> Column:
    """The first domain with a keyword in the title, else null."""
    out = F.lit(None).cast("string")
    for domain, words in reversed(config.TITLE_KEYWORDS):
        out = F.when(F.lower(title).rlike("|".join(words)), F.lit(domain)).otherwise(out)
    return out


def gazetteer_pattern(gazetteer: dict = config.GAZETTEER) -> str:
    """One alternation over all terms, longest first, between word borders."""
    terms = sorted((t for ts in gazetteer.values() for t in ts), key=lambda t: (-len(t), t))
    return r"(?:^|[^\p{L}\p{N}])(" + "|".join(t if t.startswith("[") else re.escape(t).replace(r"\-", "-").replace(r"\ ", " ") for t in terms) + r")(?:[^\p{L}\p{N}]|$)"


def gazetteer_domain(text: Column, gazetteer: dict = config.GAZETTEER) -> Column:
    """The domain of the term that stands first in the text (the longest, where several start there), else null."""
    term = F.regexp_extract(text, gazetteer_pattern(gazetteer), 1)
    out = F.lit(None).cast("string")
    for domain, terms in gazetteer.items():
        plain = [t for t in terms if not t.startswith("[")]
        hit = term.isin(*plain)
        for t in terms:
            if t.startswith("["):
                hit = hit | term.rlike(f"^{t}$")
        out = F.when(hit, F.lit(domain)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def severity(verdict: Column, domain: Column) -> Column:
    return (
        F.when(verdict == "contradicted", F.when(domain == "financial", "critical").otherwise("major"))
        .when(verdict == "disputed", "major")
        .when(verdict == "insufficient", "minor")
        .when(verdict == "supported", "info")
        .otherwise(F.raise_error(F.concat(F.lit("unknown verdict "), F.coalesce(verdict, F.lit("null")))))
    )


def direct_claim(sentence: Column) -> Column:
    """The claim that a simple sentence is by itself."""
    return F.struct(
        sentence.alias("claim_text"),
        sentence.alias("source_span"),
        F.when(sentence.rlike(r"\d"), "statistical").otherwise("definitional").alias("claim_type"),
        F.lit("internal").alias("scope"),
        F.expr("cast(array() as array<string>)").alias("requires"),
    )


def needs_decomposition(sentence: Column) -> Column:
    """Whether a sentence likely joins clauses: a coordinating word, or a comma before a participle (an
    approximation of a dependency parse by closed word lists)."""
    return sentence.rlike(r"(?i)(^|\s)(and|but|or|nor|yet|because|while|although|whereas|which|that)\s|,\s+\w+(ing|ed)\s")


def evidence_line(kind: Column, ref: Column, snippet: Column) -> Column:
    return F.concat(F.lit("- ["), kind, F.lit("] "), ref, F.lit(": "), snippet)


def fill(template: Column, **values: Column) -> Column:
    """A template with its ``{name}`` places filled."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def route(cites: Column, entities: Column, opinion: Column, own: Column, score: Column) -> Column:
    """Where a claim is to be checked: in_document, external, both or unverifiable; the first rule that applies."""
    return (
        F.when(cites, F.when(score > 0.75, "both").otherwise("external"))
        .when(entities & ~own, "external")
        .when(own & (score > 0.7), "in_document")
        .when(opinion | (~entities & (score <= 0.0)), "unverifiable")
        .otherwise("external")
    )
