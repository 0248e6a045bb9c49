"""SentencePiece encoding and decoding over a relational lattice.

A text is normalised the way the model file says for this vocabulary (a space in front, spaces as
the mark U+2581) and cut where no piece spans the two neighbouring characters; between such cuts lie the
*words* of the lattice. The distinct words' substrings, up to the longest piece, are exploded and
equi-joined to the piece table; the matches are grouped by word again as edges and folded with Spark's
higher-order ``aggregate``:

* ``viterbi``: the best-scoring path, for unigram piece tables;
* ``merges``: for byte-pair tables, whose library result isn't the best-scoring path, the fold picks the best
  merge of neighbours, as often as one exists, over the same edges.

Encoding a corpus folds the most frequent distinct words, at most ``DICTIONARY_WORDS``, of at most
``WORD_CHARS`` characters; that table has a fixed size bound and goes to the workers. A word outside it is
encoded where it is met, by the library, so results are whole at every size.

Defined cases: null text: no pieces (ids empty). Empty text: no pieces. Characters that no piece
covers become byte pieces. Repeated rows are encoded alike; null doc_ids too. Texts of any length are read whole. A mark
U+2581 that stands in the text itself is a space to the vocabulary, as to the library, and decodes to one. Of merges
that score alike the leftmost is made. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, small_batches, unit_hash

MODEL = "piece_bpe_32k.model"
MARK = "▁"
DICTIONARY_WORDS = 150_000
WORD_CHARS = 32
MEMORY_WORDS = 300_000
_GROUPS = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"


def piece_table(spark: SparkSession, model: str = MODEL) -> DataFrame:
    """(piece, id, score) of the vocabulary's ordinary pieces; its size is the file's."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
    rows = [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
    return spark.createDataFrame(rows, "piece string, id int, score double")


def lattice(words: DataFrame, pieces: DataFrame, longest: int) -> DataFrame:
    """(word) -> (word, edges): for every word its substrings that are pieces, with start, end (1-based,
    exclusive), id and score. Single characters that are no piece get an edge with a null id.

    Substrings meet pieces by a 64-bit digest, whose join table is the fastest, and are then compared whole."""
    at = words.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    room = F.least(F.lit(longest), F.length("word") - F.col("start") + 1)
    spans = at.select("word", "start", F.explode(F.sequence(F.lit(1), room)).alias("size"))
    spans = spans.withColumn("part", F.substring("word", F.col("start"), F.col("size"))).withColumn("key", F.xxhash64("part"))
    keyed = pieces.select(F.xxhash64("piece").alias("key"), "piece", "id", "score")
    same = F.col("piece") == F.col("part")
    met = spans.join(F.broadcast(keyed), "key", "left").select("word", "start", "size", F.when(same, F.col("id")).alias("id"), F.when(same, F.col("score")).alias("score"))
    edge = F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"), "id", "score")
    return met.where("id is not null or size = 1").groupBy("word").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def viterbi(edges: Column, length: Column, unknown: float = -1e6) -> Column:
    """Piece ids of the best-scoring path (null: an uncovered character). Ties: the edge that starts first."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.expr("cast(array() as array<int>)").alias("ids")))
    ordered = F.array_sort(edges, lambda a, b: F.coalesce(F.nullif(a["end"] - b["end"], F.lit(0)), a["start"] - b["start"]))

    def extend(best: Column, edge: Column) -> Column:
        # best[i] is the path over the first i characters; edges come by their end
        before = F.element_at(best, edge["start"])
        path = F.struct((before["score"] + F.coalesce(edge["score"], F.lit(unknown))).alias("score"), F.concat(before["ids"], F.array(edge["id"])).alias("ids"))
        grown = F.concat(best, F.array(path))
        better = F.when(path["score"] > F.element_at(best, -1)["score"], F.concat(F.slice(best, F.lit(1), F.size(best) - 1), F.array(path))).otherwise(best)
        return F.when(F.size(best) < edge["end"], grown).otherwise(better)

    return F.element_at(F.aggregate(ordered, start, extend), -1)["ids"]


def merges(edges: Column, length: Column) -> Column:
    """Piece ids by byte-pair merging: of the neighbours whose union is a piece the best-scoring pair
    merges (leftmost on ties), until none is left. For words of at most 61 characters: the bounds of the
    current symbols are the bits of a long, bit i for a symbol that starts at character i."""

    def bit(i: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), i)

    # an edge joins two neighbours if both its ends are bounds and there is one bound between them
    ranked = F.transform(
        F.filter(edges, lambda e: e["end"] - e["start"] > 1),
        lambda e: F.struct((-e["score"]).alias("rank"), e["start"].alias("start"), (bit(e["end"]) - bit(e["start"]) + bit(e["end"])).alias("span"), bit(e["end"]).bitwiseOR(bit(e["start"])).alias("ends")),
    )
    state = F.struct((bit(length + 1) - 2 + bit(length + 1)).alias("bounds"), F.sort_array(ranked).alias("live"))

    def step(state: Column, _: Column) -> Column:
        bounds = state["bounds"]
        whole = lambda e: e["ends"].bitwiseAND(bounds) == e["ends"]
        live = F.filter(state["live"], whole)
        best = F.get(F.filter(state["live"], lambda e: (F.bit_count(e["span"].bitwiseAND(bounds)) == 3) & whole(e)), F.lit(0))
        joined = F.coalesce(bounds.bitwiseAND(F.bitwise_not(best["span"].bitwiseXOR(best["ends"]))), bounds)
        return F.when(F.size(state["live"]) == 0, state).otherwise(F.struct(joined.alias("bounds"), live.alias("live")))

    def ids(state: Column) -> Column:
        at = F.filter(F.sequence(F.lit(1), length + 1), lambda i: bit(i).bitwiseAND(state["bounds"]) != 0)
        by_span = F.map_from_entries(F.transform(edges, lambda e: F.struct(e["start"] * 1000 + e["end"], e["id"])))

        def between(x: Column) -> Column:
            n = F.size(x["at"]) - 1
            return F.zip_with(F.slice(x["at"], F.lit(1), n), F.slice(x["at"], F.lit(2), n), lambda a, z: F.try_element_at(x["table"], a * 1000 + z))

        # an array of one, so that both are worked out once
        return F.element_at(F.transform(F.array(F.struct(at.alias("at"), by_span.alias("table"))), between), 1)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(length - 1, F.lit(1))), state, step, ids)


class Cutter:
    """Cuts a normalised text where no piece spans the two neighbouring characters.

    Cuts before a run of marks and around ASCII characters that no piece holds are found by a fast
    pattern; within what that leaves, further cuts matter only for words that would be too long, such
    as text without spaces.
    """

    def __init__(self, pieces: list[str]):
        self.bigrams = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        # pieces never hold a mark after another character, so words start at runs of marks
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece spans words")
        held = set("".join(pieces))
        alone = re.escape("".join(chr(i) for i in range(128) if chr(i) not in held))
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[{alone}]|[^{MARK}{alone}]+")

    def cut(self, text: str) -> list[str]:
        found = self.words.findall(text)
        if max(map(len, found), default=0) <= WORD_CHARS:
            return found
        out = []
        for word in found:
            if len(word) <= WORD_CHARS:
                out.append(word)
                continue
            start = 0
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in self.bigrams:
                    out.append(word[start:i])
                    start = i
            out.append(word[start:])
        return out


def normalised(text: str | None) -> str:
    """The vocabulary's normal form: identity but for spaces, with one in front of a text that isn't empty."""
    return MARK + text.replace(" ", MARK) if text else ""


_local: dict = {}


def _processor(model: str):
    if model not in _local:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))
        ordinary = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        _local[model] = (sp, Cutter(ordinary), sp.piece_to_id("<0x00>"), {})
    return _local[model]


def encode_word(word: str, model: str = MODEL) -> bytes:
    """Ids of one word by the library, as little-endian 32-bit integers. The library puts a mark in
    front of its input, so the word is given behind a line feed, whose two leading ids are dropped."""
    sp = _processor(model)[0]
    return np.array(sp.encode("\n" + word.replace(MARK, " "))[2:], "<i4").tobytes()


_WORDS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])


def _count_words(model: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        cutter, seen = _processor(model)[1], Counter()

        def out() -> pa.RecordBatch:
            short = {w: n for w, n in seen.items() if len(w) <= WORD_CHARS}
            return pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], names=_WORDS.names)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(cutter.cut(normalised(text)))
            if len(seen) > MEMORY_WORDS:
                yield out()
                seen.clear()
        yield out()

    return count


def word_dictionary(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(word, ids): the most frequent distinct words of the whole corpus, folded over the lattice.

    The words whose counts lie in the highest classes (64 for each doubling, so at most some 4,000 in all) that
    hold about DICTIONARY_WORDS together, of the lowest class a share; no task or driver sees more than the classes'
    sizes to find them."""
    spark = docs.sparkSession
    small_batches(spark)
    counts = docs.select("text").mapInArrow(_count_words(model), _WORDS).groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts.select("word", F.floor(F.log2("n") * 64).cast("int").alias("class")), "words")
    lowest, share, room = None, 0.0, DICTIONARY_WORDS
    for row in sorted(counts.groupBy("class").count().collect(), reverse=True):
        lowest, share = row["class"], min(1.0, room / row["count"])
        room -= row["count"]
        if room <= 0:
            break
    # of the lowest class, as many words as there is room for, by a hash
    fits = F.lit(False) if lowest is None else (F.col("class") > lowest) | ((F.col("class") == lowest) & (unit_hash(F.col("word")) < share))
    words = counts.where(fits).select("word")
    n = max(1, min(DICTIONARY_WORDS // 1000, spark.sparkContext.defaultParallelism * 4))
    pieces = piece_table(spark, model)
    longest = 16
    edges = lattice(words.repartition(n, "word"), pieces, longest)
    base = _processor(model)[2]
    pieces_of = merges(F.col("edges"), F.length("word"))
    folded = edges.select("word", pieces_of.alias("pieces"))
    # edges are grouped by hash, as a task has no more words than the dictionary; the setting is put back after the write
    before = spark.conf.get(_GROUPS)
    spark.conf.set(_GROUPS, str(DICTIONARY_WORDS))
    try:
        return cut(folded.select("word", _with_bytes(F.col("word"), F.col("pieces"), base).alias("ids")), "dictionary")
    finally:
        spark.conf.set(_GROUPS, before)


def _with_bytes(word: Column, pieces: Column, base: int) -> Column:
    """Ids with the uncovered characters (null ids) as byte pieces; only words that have one pay for it."""
    raw = F.hex(F.encode(word, "UTF-8"))
    byte_ids = F.transform(F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2)), lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("int") + base)
    # a word with an uncovered character: exact only as a whole if it is that one character
    return F.when(~F.exists(pieces, lambda p: p.isNull()), pieces).when(F.length(word) == 1, byte_ids)


_ENCODED = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _encode_text(text: str | None, known: dict, model: str) -> np.ndarray:
    _, cutter, _, memory = _processor(model)
    words = cutter.cut(normalised(text))
    found = list(map(known.get, words))
    if None in found:
        for i, ids in enumerate(found):
            if ids is None:
                word = words[i]
                ids = memory.get(word)
                if ids is None:
                    ids = encode_word(word, model)
                    if len(memory) > MEMORY_WORDS:
                        memory.clear()
                    if len(word) <= WORD_CHARS:
                        memory[word] = ids
                found[i] = ids
    return np.frombuffer(b"".join(found), "<i4")


def _as_bytes(rows: pa.Table) -> dict[str, bytes]:
    """Words and their ids as little-endian 32-bit integers."""
    if not rows.num_rows:
        return {}
    ids = pa.concat_arrays(rows["ids"].chunks)
    ends = np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False)) * 4
    raw = ids.flatten().to_numpy(zero_copy_only=False).astype("<i4").tobytes()
    return {word: raw[a:b] for word, a, b in zip(rows["word"].to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text), as the sentencepiece library encodes it."""
    spark = docs.sparkSession
    # at most DICTIONARY_WORDS rows of at most WORD_CHARS characters
    rows = word_dictionary(docs, model).where("ids is not null").toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(_as_bytes(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            ids = [_encode_text(x, known, model) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=_ENCODED.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _ENCODED)


def decode(ids: Column, model: str = MODEL) -> Column:
    """The text of an id array: a piece's bytes by its id, joined, the leading space dropped."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=public_tokenizers.path(model))

    def raw(i: int) -> str:
        if sp.is_byte(i):
            return sp.id_to_piece(i)[3:5]
        if sp.is_control(i):
            return ""
        return (" ⁇ " if sp.is_unknown(i) else sp.id_to_piece(i).replace(MARK, " ")).encode().hex()

    # one string literal, which the optimizer splits once; a literal of every piece would weigh on each plan
    table = F.split(F.lit(" ".join(raw(i) for i in range(sp.get_piece_size()))), " ")
    whole = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.element_at(table, i + 1)), "")), "UTF-8")
    return F.when(F.startswith(whole, F.lit(" ")), F.substring(whole, F.lit(2), F.length(whole))).otherwise(whole)
