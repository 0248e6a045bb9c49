"""PII by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them.

Candidates are the fixed patterns' matches, what those patterns refuse (too long an address part, a
failing check digit, a wrong digit count) and looser shapes (local phone numbers, social security
shapes, account numbers, titled or introduced names, street addresses, spelled-out mail addresses). Five labelers (shape, check,
gazetteer, context before, context after) vote yes, no or nothing on each.

The votes are counted by kind and pattern over the whole corpus: at most 3^5 patterns a kind. Expectation-maximisation
over these counts gives every labeler's reliability for every kind (drawn toward its reliability over all kinds) and every
pattern's posterior. The final span classifier is a logistic regression over votes, the span's own shape and the words
around it, fitted to the posteriors on at most ``PER_PATTERN`` spans of each kind and pattern, weighted by the patterns'
counts. Spans it accepts are added; the fixed patterns' spans always stay.

Defined cases: null text: empty, nothing found. Whole texts of any length are read. Offsets are code
points, ends exclusive. Repeated rows are judged alike. No candidates, as in an empty table: nothing is added. An added
span doesn't overlap a fixed one; of added spans that overlap the first stays. Columns other than doc_id and text, whatever
their names, aren't read.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from plumbline.llm.common import cut, small_batches, unit_hash

BASE = ("email", "ip", "card", "phone")
LOOSE = ("local_phone", "ssn", "iban", "name", "address", "spelled_email")
KINDS = BASE + LOOSE
LABELERS = ("shape", "check", "gazetteer", "before", "after")
#: Spans are added from this probability of the final classifier.
ACCEPT = 0.9
EM_ROUNDS = 60
#: Votes that a kind's reliabilities are drawn toward those of all kinds with.
POOLED = 20.0
#: Spans of a kind and pattern that the classifier is fitted on, at most; those of the smallest hash.
PER_PATTERN = 40
#: Weights of the classifier; features are hashed into them.
SLOTS = 1 << 14

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that fails at its start fails at every later start too, so matches begin at runs.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOOSE = {
    "local_phone": re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)"),
    "name": re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Madame|Monsieur|Señora?)\.?|\b[Mm]y name is|\b[Nn]ame:)\x20([A-Z][a-zß-ÿ]+(?:\x20[A-Z][a-zß-ÿ]+){1,2})"),
    "address": re.compile(r"(?<![\w.])[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b"),
    "spelled_email": re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{2,63}(?:\x20?[\[(]dot[\])]\x20?|\.)[A-Za-z]{2,10}"),
}

# Given names and name-like words of the gazetteer (own short list).
GIVEN = frozenset(
    "james mary robert patricia john jennifer michael linda david elizabeth william barbara richard susan joseph jessica "
    "thomas sarah charles karen maria jose carlos ana luis carmen juan laura hans peter klaus anna jean marie pierre claire "
    "paul sophie daniel julia martin emma lucas mia".split()
)
# Top-level domains and country codes of the gazetteer.
ENDINGS = frozenset("com org net edu gov info io de fr es uk us eu".split())
COUNTRIES = frozenset("AT BE CH DE DK ES FR GB IE IT LU NL NO PL PT SE".split())
# Words that speak for a kind when they stand nearby.
NEARBY = {
    "email": "mail contact write reach address",
    "spelled_email": "mail contact write reach address",
    "ip": "ip host server address login client",
    "card": "card visa credit payment number account",
    "phone": "phone tel call mobile fax contact number",
    "local_phone": "phone tel call mobile fax contact number",
    "ssn": "ssn social security",
    "iban": "iban account bank",
    "name": "name contact regards dear signed",
    "address": "address lives street mail ship office",
}
_NEARBY = {k: re.compile("|".join(rf"\b{w}" for w in v.split()), re.I) for k, v in NEARBY.items()}
WINDOW = 40


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outward: the local part is the run before it, back to the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    return out


def candidates(text: str) -> list[tuple[int, int, str, bool]]:
    """(start, end, kind, whether the fixed rule accepts it), by start, then kind."""
    out = [(a, b, "email", True) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        out.append((m.start(), m.end(), "ip", _parts_fit(m[0])))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 12 <= len(digits) <= 22:
            out.append((m.start(), m.end(), "card", 14 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        out.append((m.start(), m.end(), "phone", 10 <= len(_digits(m[0])) <= 15))
    for kind, pattern in _LOOSE.items():
        group = 1 if kind == "name" else 0
        out += [(m.start(group), m.end(group), kind, False) for m in pattern.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def _parts_fit(address: str) -> bool:
    """Parts of at most 255, whatever their leading zeros."""
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in address.split("."))


def votes(text: str, start: int, end: int, kind: str, accepted: bool) -> list[int]:
    """1, -1 or 0 of every labeler."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    if kind in BASE:
        shape = 1 if accepted else -1
    elif kind == "name":
        shape = 1 if len(span.split()) == 2 else 0
    else:
        shape = 1
    check = 0
    if kind == "card":
        check = 1 if luhn(digits) else -1
    elif kind == "ip":
        check = 1 if _parts_fit(span) else -1
    elif kind == "ssn":
        check = -1 if span[:3] in ("000", "666") or span[0] == "9" or "-00-" in span or span.endswith("0000") else 1
    elif kind == "iban":
        plain = span.replace(" ", "")
        moved = plain[4:] + plain[:4]
        check = 1 if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1 else -1
    elif kind in ("phone", "local_phone"):
        check = -1 if len(set(digits)) <= 2 else (1 if 10 <= len(digits) <= 15 else -1)
    gazetteer = 0
    if kind in ("email", "spelled_email"):
        gazetteer = 1 if re.split(r"[.\x20)\]]", span)[-1].lower() in ENDINGS else 0
    elif kind == "name":
        gazetteer = 1 if span.split()[0].lower() in GIVEN else -1
    elif kind == "iban":
        gazetteer = 1 if span[:2] in COUNTRIES else -1
    elif kind == "address":
        gazetteer = 1
    near = 1 if _NEARBY[kind].search(before) else 0
    if not near and before[-1:].isalnum():
        near = -1
    follows = -1 if after[:1].isalnum() or after[:1] in ("%", "$") else (1 if _NEARBY[kind].search(after) else 0)
    return [shape, check, gazetteer, near, follows]


def pattern_of(given: list[int]) -> int:
    """The votes as one number, a base-3 digit each."""
    code = 0
    for v in given:
        code = code * 3 + v + 1
    return code


def votes_of(pattern: int) -> list[int]:
    out = []
    for _ in LABELERS:
        out.append(pattern % 3 - 1)
        pattern //= 3
    return out[::-1]


#: Pseudo-counts of the votes -1, 0 and 1 given the classes false and true: labelers are better than chance.
_PRIOR = np.array([[2.0, 1.0, 0.5], [0.5, 1.0, 2.0]])[:, None, :].repeat(len(LABELERS), axis=1)


def reliabilities(patterns: np.ndarray, counts: np.ndarray, prior: np.ndarray = _PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """Dawid-Skene on vote patterns: (posterior of every pattern, P(vote | class) by class, labeler and vote).

    prior: pseudo-counts by class, labeler and vote."""
    table = np.array([votes_of(int(p)) for p in patterns]) + 1
    share = (table - 1).sum(1)
    posterior = np.clip(0.5 + 0.15 * share, 0.05, 0.95)
    for _ in range(EM_ROUNDS):
        chance = np.empty((2, len(LABELERS), 3))
        for c, mass in enumerate((counts * (1 - posterior), counts * posterior)):
            for k in range(len(LABELERS)):
                seen = np.bincount(table[:, k], mass, 3) + prior[c, k]
                chance[c, k] = seen / seen.sum()
        common = (counts @ posterior + 1) / (counts.sum() + 2)
        logs = np.log(chance)[:, np.arange(len(LABELERS))[None, :], table].sum(2)
        odds = np.log(common / (1 - common)) + logs[1] - logs[0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return posterior, chance


def posteriors(kinds: np.ndarray, patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The posterior of every (kind, pattern): a labeler's reliability is a kind's own, drawn toward that over all kinds."""
    _, pooled = reliabilities(patterns, counts)
    out = np.zeros(len(patterns))
    for kind in np.unique(kinds):
        at = kinds == kind
        out[at] = reliabilities(patterns[at], counts[at], prior=_PRIOR + POOLED * pooled)[0]
    return out


_WORD = re.compile(r"\w+")
_SHAPES = str.maketrans("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "0" * 10 + "A" * 26 + "a" * 26)


def features(text: str, start: int, end: int, kind: str, given: list[int]) -> list[int]:
    """Slots of the classifier: the votes, alone and by kind, and by kind the span's shape, size and neighbours."""
    span = text[start:end]
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    named = ["bias", f"kind {kind}"]
    for labeler, vote in zip(LABELERS, given, strict=True):
        named += [f"{labeler} {vote}", f"{kind} {labeler} {vote}"]
    shape = re.sub(r"(.)\1+", r"\1+", span[:64].translate(_SHAPES))
    named += [f"{kind} shape {shape}", f"{kind} size {min(len(span), 40) // 4}"]
    named += [f"{kind} from {before[-1:]}", f"{kind} to {after[:1]}"]
    named += [f"{kind} before {w.lower()}" for w in _WORD.findall(before)[-3:]]
    named += [f"{kind} after {w.lower()}" for w in _WORD.findall(after)[:2]]
    return sorted({zlib.crc32(x.encode()) % SLOTS for x in named})


def fit_classifier(samples: list[tuple[list[int], float, float]]) -> np.ndarray:
    """Weights of a logistic regression on (slots, posterior, weight), by accelerated gradient steps with a ridge."""
    row = np.repeat(np.arange(len(samples)), [len(x[0]) for x in samples])
    slot = np.concatenate([np.array(x[0]) for x in samples])
    target, weight = np.array([x[1] for x in samples]), np.array([x[2] for x in samples])
    weight = weight / weight.sum()
    w = look = np.zeros(SLOTS)
    step = 4.0 / max(len(x[0]) for x in samples)
    for i in range(400):
        margin = np.bincount(row, look[slot], len(samples))
        off = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - target)
        new = look - step * (np.bincount(slot, off[row], SLOTS) + 1e-4 * look)
        w, look = new, new + i / (i + 3) * (new - w)
    return w


def probability(slots: list[int], weights: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[slots].sum(), -30, 30))))


_SPAN = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "end", "kind", "base", "pattern")] + [T.StructField("slots", T.ArrayType(T.IntegerType()))])
_READ = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("found", T.ArrayType(_SPAN))])
_SPAN_ARROW = pa.list_(pa.struct([(c, pa.int32()) for c in _SPAN.names[:-1]] + [("slots", pa.list_(pa.int32()))]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text in batch.column(1).to_pylist():
            text, spans = text or "", []
            for a, b, kind, ok in candidates(text):
                given = votes(text, a, b, kind, ok)
                spans.append({"start": a, "end": b, "kind": KINDS.index(kind), "base": int(ok), "pattern": pattern_of(given), "slots": features(text, a, b, kind, given)})
            found.append(spans)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, _SPAN_ARROW)], names=_READ.names)


def span_weights(read: DataFrame) -> np.ndarray | None:
    """Weights of the final classifier from a table of candidates; null where there are none."""
    spans = read.select("doc_id", F.explode("found").alias("s"))
    # at most len(KINDS) * 3 ** len(LABELERS) rows
    tally = spans.groupBy("s.kind", "s.pattern").count().orderBy("kind", "pattern").collect()
    if not tally:
        return None
    kinds, patterns, counts = (np.array([r[i] for r in tally]) for i in range(3))
    known = {(int(k), int(p)): (x, n) for k, p, n, x in zip(kinds, patterns, counts.tolist(), posteriors(kinds, patterns, counts.astype(float)), strict=True)}
    sizes = F.broadcast(read.sparkSession.createDataFrame(tally))
    place = unit_hash(F.col("doc_id"), F.col("s.start"), F.col("s.end"), F.col("s.kind"))
    flat = spans.select(place.alias("place"), "s.kind", "s.pattern", "s.slots").join(sizes, ["kind", "pattern"])
    # what lies below the bound is about four times the sample, so that no task orders all spans of a common pattern
    flat = flat.where(F.col("place") * F.col("count") <= 4 * PER_PATTERN)
    first = Window.partitionBy("kind", "pattern").orderBy("place", "slots")
    chosen = flat.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= PER_PATTERN)
    rows = sorted((r.kind, r.pattern, r.turn, r.slots) for r in chosen.select("kind", "pattern", "turn", "slots").collect())
    sampled: dict = {}
    for k, p, _, _ in rows:
        sampled[k, p] = sampled.get((k, p), 0) + 1
    return fit_classifier([(slots, known[k, p][0], np.log1p(known[k, p][1]) / sampled[k, p]) for k, p, _, slots in rows])


_OUT = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
    + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
)


def _chosen(found: list[dict], weights: np.ndarray | None) -> tuple[list, list]:
    """Fixed spans; all spans with those the classifier accepts. found: by start, then kind."""
    base = [(s["start"], s["end"], s["kind"]) for s in found if s["base"]]
    starts, reach = [a for a, _, _ in base], []
    for _, b, _ in base:
        reach.append(max(b, reach[-1] if reach else 0))
    added, last = [], 0
    for s in found:
        if s["base"] or s["start"] < last:
            continue
        # the fixed spans that start before this one ends: does any reach into it?
        before = bisect.bisect_left(starts, s["end"])
        if (before and reach[before - 1] > s["start"]) or probability(s["slots"], weights) < ACCEPT:
            continue
        added.append((s["start"], s["end"], s["kind"]))
        last = s["end"]
    return base, sorted(base + added, key=lambda x: (x[0], x[2]))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    spark = docs.sparkSession
    small_batches(spark)
    read = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_read, _READ), "candidates")
    shared = spark.sparkContext.broadcast(span_weights(read))  # SLOTS numbers

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def listed(found: list) -> str:
            return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)

        for batch in batches:
            rows = []
            for found in batch.column(1).to_pylist():
                base, chosen = _chosen(found, shared.value)
                of = [k for _, _, k in base]
                rows.append([*(of.count(i) for i in range(len(BASE))), hashlib.sha256(listed(base).encode()).hexdigest(), listed(chosen)])
            types = [pa.int64()] * len(BASE) + [pa.string()] * 2
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=_OUT.names)

    return read.mapInArrow(write, _OUT)
