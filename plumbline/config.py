"""Vocabularies, thresholds and small reference tables, with the readers that replace them.

The values below are fixed values of the data model; every operator takes them as parameters.
"""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

CLAIM_TYPES = ("statistical", "causal", "comparative", "definitional", "forward_looking", "hedged", "opinion")
SCOPES = ("internal", "external", "both")
VERDICTS = ("supported", "contradicted", "insufficient", "disputed")
SEVERITIES = ("critical", "major", "minor", "info")
DOMAINS = ("financial", "legal", "general")
FILE_TYPES = ("docx", "pdf")
EVENTS = ("ingest_progress", "ingest_complete", "claim_extracted", "claim_verified", "verification_complete", "ingest_failed")

# Words that carry no content.
STOPWORDS = tuple(
    """
    the a an and or but of to in on for with as by at
    is are was were be been being this that these those it its
    we our their has have had will would can could than then
    into over under across each which who from not no so such
    more most much many any all some if while also just up out
    """.split()
)

# Domain, claim type (* for any), method, confidence ceiling; first match wins.
REGISTRY = (
    ("financial", "statistical", "deterministic", None),
    ("financial", "causal", "agent", None),
    ("legal", "definitional", "agent", None),
    ("general", "*", "agent", 0.6),
)

# Terms that decide a domain where they stand first in a text.
GAZETTEER = {
    "financial": (
        "EBITDA", "constant currency", "revenue", "gross margin", "[Yy][Oo][Yy]", "year-over-year", "quarter-over-quarter", "cost of goods sold",
        "operating income", "free cash flow", "working capital", "net income", "operating margin", "capital expenditure",
    ),
    "legal": (
        "GDPR", "material weakness", "indemnification", "force majeure", "regulatory compliance", "breach of contract",
        "intellectual property", "fiduciary duty", "non-disclosure agreement", "liability", "SEC filing", "antitrust",
    ),
}

# Title keywords of a domain, in order of precedence.
TITLE_KEYWORDS = (("financial", ("financial", "revenue", "earnings")), ("legal", ("legal", "compliance", "regulatory", "disclosures")))

# Thresholds.
THRESHOLDS = {
    "arithmetic_tolerance_pct": 0.5,
    "ocr_confidence": 0.6,
    "native_text_chars": 20,
    "short_document_pages": 5,
    "topic_shift_sensitivity": 0.35,
    "max_upload_mb": 200,
    "progress_every_pages": 5,
    "summary_words": 150,
    "summary_direct_words": 3000,
    "words_a_page": 400,
    "window_sentences": 10,
    "window_overlap": 2,
    "embed_inputs": 100,
    "embed_tokens": 250_000,
    "embed_text_tokens": 8_091,
    "claim_dedup": 0.92,
}


def config_hash(folder: str) -> str:
    """First 16 hex digits of SHA-256 over the folder's files: each relative path, then its bytes, by path."""
    digest = hashlib.sha256()
    root = Path(folder)
    for path in sorted(p for p in root.rglob("*") if p.is_file()):
        digest.update(path.relative_to(root).as_posix().encode())
        digest.update(path.read_bytes())
    return digest.hexdigest()[:16]


def settings_hash(settings: dict) -> str:
    """The same for settings held in memory: their JSON with sorted keys."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def load_settings(path: str) -> dict:
    """A flat ``key: value`` settings file (comments after #), values as JSON where they are."""
    out = {}
    for line in Path(path).read_text().splitlines():
        line = line.split("#")[0].strip()
        if ":" in line:
            key, _, value = line.partition(":")
            try:
                out[key.strip()] = json.loads(value)
            except ValueError:
                out[key.strip()] = value.strip()
    return out


def load_yaml(path: str):
    """A YAML file of any nesting; needs the yaml package."""
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("nested settings need the yaml package") from missing
    return yaml.safe_load(Path(path).read_text())


def load_registry(path: str) -> tuple[tuple, ...]:
    """The registry's rows (domain, claim type, method, ceiling) in the file's order, which is that of precedence."""
    return tuple((r["domain"], r["claim_type"], r["verification_method"], r.get("confidence_ceiling")) for r in load_yaml(path))


def load_exemplars(path: str) -> list[tuple[str, str]]:
    """(domain, sentence) of an exemplar file: sentences by domain."""
    return [(domain, sentence) for domain, sentences in load_yaml(path).items() for sentence in sentences]


def load_template(folder: str, name: str) -> str:
    """A prompt template by its base name, with or without ``.md``."""
    return (Path(folder) / (name if name.endswith(".md") else f"{name}.md")).read_text()
