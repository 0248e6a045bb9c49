"""Secret scans: three fixed patterns, and values in a credential's place that are costly to guess.

The guess cost of a value is the cheapest segmentation into dictionary words, dates, repeats,
keyboard walks and brute-force characters, found by dynamic programming over all spans of every
kind; costs are logarithms (base 10) of the guesses a segment takes. The dictionary is a short list of common
password words and the corpus's own words, from a counted aggregation: a word that makes up a share
p of all words takes 1 / p guesses. A value is reported when its cost is at least ``COSTLY`` and it
mixes character classes or a sign joins it to its keyword, so ordinary prose after a word such as
"token" stays.

Defined cases: null text: empty, nothing found. Texts are read whole, of any length. Offsets are
code points, ends exclusive. Repeated rows are scanned alike. An empty table or one without words: the
dictionary is the short list alone. Other columns, whatever their names, pass or aren't read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, small_batches

KINDS = ("assign", "access", "hex")
ADDED = "guess"
#: log10 of the guesses from which a value counts as a secret.
COSTLY = 9.0
REPLACEMENT = "[SECRET]"
#: A corpus word joins the dictionary if it is at least one in so many of all words; so no more words than that do.
WORD_SHARE = 50_000
#: Letters of a dictionary word; a repeat or walk is a segment up to so many characters, a longer one several.
WORD_LETTERS, SEGMENT = (3, 16), 256
#: Words that a task counts before it sends what it has.
MEMORY_WORDS = 300_000

_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that name a credential, then what may join it to its value, then the value.
_CONTEXT = re.compile(
    r"""(?ai:(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|bearer|authorization|(?:api|access|private|client|auth)[_\x20-]?(?:key|secret|token)))"""
    r"""["']?(?:\x20*(?:[:=]|=>|:=)\x20*|\x20+(?:is|was|Basic|Bearer)\x20+|\x20+)["'`]?([^\s"'`<>,;]{8,})"""
)

#: A sign, not blanks alone, between a keyword and its value.
_JOINED = re.compile(r"""[:=]>?\x20*["'`]?\Z""")

# Common password words, most common first (own short list).
WORDS = (
    "password pass admin root user login welcome master secret letmein dragon monkey shadow sunshine princess "
    "football baseball superman batman hello love summer winter spring autumn monday friday january december "
    "orange silver golden diamond computer internet service server access default guest test change company "
    "freedom charlie michael jordan thomas robert daniel jessica ashley hunter killer pepper ginger cookie "
    "flower purple yellow banana coffee chocolate soccer hockey tigger buster maggie secure token key the and "
    "for you with this that from have your what home work money family forever angel baby"
).split()
# Rows of the common keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "qazwsxedcrfvtgbyhnujmikolp", "abcdefghijklmnopqrstuvwxyz")
# Look-alike characters.
LOOKS = str.maketrans("4@301$57", "aaeolsst")

#: log10 of the guesses of a word of the short list.
COMMON = {w: math.log10(i + 2) for i, w in enumerate(WORDS)}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_PAIRS = {row[i : i + 2] for row in KEY_ROWS for i in range(len(row) - 1)} | {row[i + 1] + row[i] for row in KEY_ROWS for i in range(len(row) - 1)}
_UNIT = 8
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Any segment's choice of kind, in digits.
KIND_COST = 0.5
#: No segment costs less a character than a two-fold repeat of the cheapest unit, drawn out, or a word that every word is.
_LEAST_A_CHAR = min(KIND_COST / WORD_LETTERS[1], (1 + math.log10(2) + KIND_COST) / SEGMENT)


def _brute(char: str) -> float:
    """log10 of the alphabet that one brute-force character is drawn from."""
    if char.isdigit():
        return 1.0
    return math.log10(26) if char.isalpha() else math.log10(33)


def _date_cost(size: int) -> float:
    return math.log10(120 * (12 if size > 4 else 1) * (31 if size > 7 else 1))


def _runs(same: list[bool]) -> list[int]:
    """For every place, how many in a row hold from there on."""
    out, n = [0] * (len(same) + 1), len(same)
    for i in range(n - 1, -1, -1):
        out[i] = out[i + 1] + 1 if same[i] else 0
    return out


def guess_cost(value: str, words: dict[str, float] = COMMON) -> float:
    """log10 of the guesses of the cheapest segmentation; each segment but a brute-force character
    costs half a digit more for the choice of its kind, a word 0.3 more for capitals and for look-alikes.

    words: log10 of the guesses of every dictionary word."""
    n = len(value)
    low = value.translate(_LOW)
    plain = low.translate(LOOKS)
    brute = [_brute(c) for c in value]
    walks = _runs([low[i : i + 2] in _PAIRS for i in range(n - 1)])
    repeats = [_runs([value[i] == value[i + p] for i in range(n - p)]) for p in range(1, min(_UNIT, n // 2) + 1)]
    shortest, longest = WORD_LETTERS
    best = [0.0] + [math.inf] * n
    for i in range(n):
        here = best[i]
        best[i + 1] = min(best[i + 1], here + brute[i])
        here += KIND_COST
        for j in range(i + shortest, min(n, i + longest) + 1):
            cased = 0.3 * (value[i:j] != low[i:j])
            for form, looks in ((low[i:j], 0.0), (plain[i:j], 0.3)):
                cost = words.get(form)
                if cost is not None:
                    best[j] = min(best[j], here + cost + cased + looks)
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if _DATE.fullmatch(value, i, j):
                    best[j] = min(best[j], here + _date_cost(j - i))
        for size in range(3, min(walks[i] + 1 if i < n - 1 else 0, SEGMENT) + 1):
            best[i + size] = min(best[i + size], here + math.log10(60 * size))
        for p, run in enumerate(repeats, 1):
            if i >= len(run) or run[i] < p:
                continue
            unit = sum(brute[i : i + p])
            for k in range(2, min(run[i] // p + 1, SEGMENT // p) + 1):
                best[i + k * p] = min(best[i + k * p], here + unit + math.log10(k))
    return best[n]


def costly(value: str, words: dict[str, float] = COMMON) -> bool:
    """Whether the guess cost is COSTLY at least; a value too long to be cheap needs no search."""
    return len(value) * _LEAST_A_CHAR >= COSTLY or guess_cost(value, words) >= COSTLY


_COUNTED = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
_LETTERS = re.compile("[a-z]+")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter = Counter()

    def out() -> pa.RecordBatch:
        kept = {w: n for w, n in seen.items() if WORD_LETTERS[0] <= len(w) <= WORD_LETTERS[1]}
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=_COUNTED.names)

    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                seen.update(_LETTERS.findall(text.translate(_LOW)))
                if len(seen) > MEMORY_WORDS:
                    yield out()
                    seen.clear()
    yield out()


def corpus_words(docs: DataFrame) -> dict[str, float]:
    """log10 of the guesses of the dictionary's words: the short list's, and those of at least one in
    WORD_SHARE of the words in all texts of ``docs``."""
    small_batches(docs.sparkSession)
    counts = docs.select("text").mapInArrow(_count_words, _COUNTED).groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    # fewer than WORD_SHARE rows, whatever the corpus
    often = counts.where(F.col("n") * WORD_SHARE > total).collect()
    known = {r.word: math.log10(total / r.n) for r in often}
    return known | {w: min(c, known.get(w, c)) for w, c in COMMON.items()}


def _mixed(value: str) -> bool:
    kinds = [any(c.isdigit() for c in value), any(c.isupper() for c in value), any(c.islower() for c in value), any(not c.isalnum() for c in value)]
    return kinds[0] and sum(kinds) >= 2 or sum(kinds) >= 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns."""
    out = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def guessed_spans(text: str, base: list[tuple[int, int, str]], words: dict[str, float] = COMMON) -> list[tuple[int, int, str]]:
    """Costly values in a credential's place, but what one fixed pattern reports whole."""
    out, at, passed, covered = [], 0, 0, -1
    while m := _CONTEXT.search(text, at):
        # what ends a sentence isn't the value's, unless the value stands in quotes
        quoted = text[m.end() : m.end() + 1] in ('"', "'", "`") and text[m.start(1) - 1] == text[m.end()]
        value = m[1] if quoted else m[1].rstrip(".:!?)]}")
        start, end = m.start(1), m.start(1) + len(value)
        # a value that is dropped may hold the next keyword
        at = start
        if len(value) < 8 or not (_mixed(value) or _JOINED.search(text, m.start(), start)) or not costly(value, words):
            continue
        at = end
        # base spans come by their start, as values do
        while passed < len(base) and base[passed][0] <= start:
            covered = max(covered, base[passed][1])
            passed += 1
        if covered < end:
            out.append((start, end, ADDED))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(text: str, words: dict[str, float] = COMMON) -> tuple[list, list]:
    """Base spans; all spans by start, then kind."""
    base = base_spans(text)
    order = {k: i for i, k in enumerate((*KINDS, ADDED))}
    return base, sorted(base + guessed_spans(text, base, words), key=lambda x: (x[0], order[x[2]]))


_FOUND = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS]
    + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(corpus_words(docs))  # fewer than WORD_SHARE words and the short list

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base, spans = scan(text or "", shared.value)
                kinds = [k for _, _, k in base]
                rows.append([*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)])
            types = [pa.int64()] * len(KINDS) + [pa.string()] * 2
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=_FOUND.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(find, _FOUND)


def redact(text: str, words: dict[str, float] = COMMON) -> str:
    """The text with every found span replaced; overlapping spans become one replacement."""
    out, at = [], 0
    for start, end, _ in scan(text, words)[1]:
        if start >= at:
            out += [text[at:start], REPLACEMENT]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced (``n_chars``, where there is one, follows); no row goes."""
    shared = docs.sparkSession.sparkContext.broadcast(corpus_words(docs))
    counted = "n_chars" in docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            cleaned = [x if x is None else redact(x, shared.value) for x in texts]
            changed = {"text": cleaned}
            if counted:
                old = batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
                changed["n_chars"] = [n if a == b else len(b) for n, a, b in zip(old, texts, cleaned, strict=True)]
            for name, values in changed.items():
                i = batch.schema.get_field_index(name)
                batch = batch.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
            yield batch

    return docs.mapInArrow(clean, docs.schema)
