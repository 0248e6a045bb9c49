"""Token ids and counts exactly as the ``tokenizers`` library gives them, with a memory of units.

A text is cut at single spaces and line feeds that stand between characters that aren't white
space, and before a full stop or comma that ends such a piece where the library's own normaliser and
pattern cut there too. No pre-token of the supported vocabularies crosses such a cut, so the text's ids
are its units' ids in a row. The library encodes a unit once per worker; the memory of units is emptied
when it holds ``MEMORY_UNITS`` of them, which bounds it and changes no result.

Defined cases: null and empty texts have no ids (token files then hold the end id alone). Texts of any
length are read whole. Repeated rows and null doc_ids are counted and written each; in token files rows
without an id stand first and repeated ids are ordered by their text's hash. Empty tables give empty
results. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import cut, fresh_path, skew_join, small_batches, unit_hash

MEMORY_UNITS = 1_500_000
#: Longer units go to the library each time.
LONGEST_KEPT = 40
LIMIT_TOKENS = 2048

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Letters up to U+024F: a word of them is one pre-token of a byte-level vocabulary.
_LETTERS = re.compile("[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")


def plain_words(text: str) -> list[str] | None:
    """The words, if all white space is one space or line feed between two words; else null."""
    words = text.split()
    gaps = len(words) - 1
    if sum(map(len, words)) + gaps == len(text) and text.count(" ") + text.count("\n") == gaps:
        return words
    return None


class UnitEncoder:
    """Ids (as bytes) or id counts of a text's units. Units not seen before are encoded in one call, as one text in which
    a special token stands between them: the library cuts at special tokens first and treats what lies
    between as texts of their own. For ids, a line feed does the same at less cost between units without white space."""

    SEPARATOR = "<|endoftext|>"
    ENDS = (".", ",")

    def __init__(self, tokenizer_file: str, counts: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.separator = self.tokenizer.token_to_id(self.SEPARATOR)
        self.counts = counts
        self.first: dict[str, object] = {}
        self.later: dict[str, object] = {}
        self.feed = self._alone("\n")
        self.ends = {x: self._alone(x) for x in self.ENDS}
        self.normalizer, self.pattern = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.breaks: dict[str, bool] = {}
        feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.feed_id = feed[0] if not counts and len(feed) == 1 else None
        self.model, self.alphabet = self.tokenizer.model, None
        if not counts and self._byte_level():
            # the library's own form of every character that a word of letters can hold
            form = ByteLevel(add_prefix_space=False, use_regex=False)
            self.alphabet = {i: form.pre_tokenize_str(chr(i))[0][0] for i in (0x20, *range(0x41, 0x250))}

    def _byte_level(self) -> bool:
        """Whether texts reach the model by nothing but the byte-level pattern."""
        import json

        parts = json.loads(self.tokenizer.to_str())
        step = parts["pre_tokenizer"] or {}
        return parts["normalizer"] is None and step.get("type") == "ByteLevel" and step.get("use_regex", True) and not step["add_prefix_space"]

    def _word(self, word: str) -> bytes:
        """The ids of one pre-token, straight from the library's model."""
        return array("I", [x.id for x in self.model.tokenize(word.translate(self.alphabet))]).tobytes()

    def _values(self, fresh: list[str], clean: bool) -> list:
        """Values of units without special strings; clean: and without line feeds."""
        by_feed = clean and self.feed_id is not None
        joined = ("\n" if by_feed else self.SEPARATOR).join(fresh)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == (self.feed_id if by_feed else self.separator)), len(ids))
        starts = np.append(0, ends[:-1] + 1)
        if self.counts:
            return (ends - starts).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist(), strict=True)]

    def _alone(self, unit: str):
        ids = self.tokenizer.encode(unit, add_special_tokens=False).ids
        return len(ids) if self.counts else np.array(ids, "<u4").tobytes()

    def _breaks(self, last: str, mark: str) -> bool:
        """Whether the library cuts between a letter or digit and a mark; its lower-casing may turn the
        letter into one followed by a combining character, which joins the mark."""
        known = self.breaks.get(last + mark)
        if known is None:
            text = "a" + last + mark
            if self.normalizer is not None:
                text = self.normalizer.normalize_str(text)
            known = last.isalnum() and self.pattern.pre_tokenize_str(text)[-1][0] == mark
            self.breaks[last + mark] = known
        return known

    def _learn(self, memory: dict, fresh: set[str], lead: str, clean: bool) -> dict:
        """Values of units not in memory; the short ones are kept."""
        values, ended, plain = {}, [], set()
        for x in fresh:
            if "<|" in x:
                values[x] = self._alone(lead + x)
            elif clean and x[-1] in self.ends and len(x) > 1 and self._breaks(x[-2], x[-1]):
                ended.append(x)
                if x[:-1] not in memory:
                    plain.add(x[:-1])
            else:
                plain.add(x)
        if self.alphabet is not None:
            words = {x for x in plain if _LETTERS.fullmatch(x)}
            values.update((x, self._word(lead + x)) for x in words)
            plain -= words
        if plain:
            plain = list(plain)
            values.update(zip(plain, self._values([lead + x for x in plain], clean), strict=True))
        for x in ended:
            value = values.get(x[:-1])
            values[x] = (memory[x[:-1]] if value is None else value) + self.ends[x[-1]]
        if len(memory) + len(values) > MEMORY_UNITS:
            memory.clear()
        memory.update((x, v) for x, v in values.items() if len(x) <= LONGEST_KEPT)
        return values

    def _look_up(self, memory: dict, units: list[str], lead: str, clean: bool) -> list:
        values = list(map(memory.get, units))
        if None in values:
            known = self._learn(memory, {x for x, v in zip(units, values, strict=True) if v is None}, lead, clean)
            values = [known[x] if v is None else v for x, v in zip(units, values, strict=True)]
        return values

    def encode(self, text: str) -> list:
        """The values of the text's units, in order."""
        if not text:
            return []
        words = plain_words(text)
        if words is None:
            parts = _CUT.split(text)
            return self._look_up(self.first, parts[:1], "", False) + self._look_up(self.later, parts[1:], " ", False)
        values = list(map(self.later.get, words))
        # the first word of a line has a line feed in front, not a space
        places, at = [], 0
        for line in text.split("\n"):
            places.append(at)
            at += line.count(" ") + 1
        heads = self._look_up(self.first, [words[i] for i in places], "", True)
        for i, head in zip(places, heads, strict=True):
            values[i] = self.feed + head
        values[0] = heads[0]
        if None in values:
            known = self._learn(self.later, {x for x, v in zip(words, values, strict=True) if v is None}, " ", True)
            values = [known[x] if v is None else v for x, v in zip(words, values, strict=True)]
        return values


_encoders: dict = {}


def _encoder(kind: str, tokenizer_file: str) -> UnitEncoder:
    """One encoder a worker process, so that tasks that follow find its memory."""
    key = (kind, tokenizer_file)
    if key not in _encoders:
        _encoders[key] = UnitEncoder(tokenizer_file, counts=kind == "count")
    return _encoders[key]


def count_tokens(text: str, tokenizer_file: str) -> int:
    return sum(_encoder("count", tokenizer_file).encode(text))


def encode_ids(text: str, tokenizer_file: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return b"".join(_encoder("ids", tokenizer_file).encode(text))


# --- token counts from a digest cache ------------------------------------------------------

_COUNTED = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def _with_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the normalised content (white-space runs as one space, none at the ends; the
    tokenizer drops white space, so counts stay) and its digest."""
    text = F.coalesce("text", F.lit(""))
    content = F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content"))
    return rows.withColumn("digest", F.unhex(F.sha2("content", 256)))


def tokenizer_version(tokenizer_file: str) -> str:
    """A digest of the vocabulary file; part of the cache's key."""
    import hashlib

    with open(tokenizer_file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", cache_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs`` (doc_id, text).

    ``cache_path`` is a Parquet table (digest, n_tokens), partitioned by tokenizer version, in a store that all executors
    see; counts found there aren't computed again and misses are appended. Without it the run
    starts an empty cache in the shared folder. Only one row of each distinct missing content is
    encoded. Null text: empty, 0 bytes, 0 tokens. Repeated rows and null ids are returned as they are.
    Runs that append to one cache at the same time may store a count twice; the counts are equal, so
    reading takes either.
    """
    spark = docs.sparkSession
    small_batches(spark)
    file = public_tokenizers.path(tokenizer)
    version = tokenizer_version(file)
    cache_path = cache_path or fresh_path(spark, "token-cache")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = public_tokenizers.path(tokenizer)
        for batch in batches:
            counts = [count_tokens(x, local) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=_COUNTED.names)

    rows = _with_digest(docs)
    heads = cut(rows.select("doc_id", "n_bytes", "digest"), "digests")
    wanted = rows.select("digest", "content").dropDuplicates(["digest"])
    cached = _read_cache(docs, cache_path, version)
    if cached is not None:
        wanted = wanted.join(cached, "digest", "left_anti")
    misses = wanted.mapInArrow(count, _COUNTED)
    misses.write.mode("append").option("compression", "zstd").parquet(f"{cache_path}/version={version}")
    counts = _read_cache(docs, cache_path, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return skew_join(heads, counts, "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT_TOKENS).alias("over_limit")
    )


def _read_cache(docs: DataFrame, cache_path: str, version: str) -> DataFrame | None:
    spark = docs.sparkSession
    path = f"{cache_path}/version={version}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    return spark.read.schema(_COUNTED).parquet(path)


# --- token ids in compressed files ---------------------------------------------------------

#: Documents whose id arrays train the shared dictionary, at most, and the longest of them in characters.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
DICTIONARY_BYTES = 1 << 15
#: A block row of the file closes at so many documents or bytes.
BLOCK_DOCS, BLOCK_BYTES = 1024, 1 << 22
LEVEL = 1

_BLOCK = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("dict_sha256", T.StringType()),
        T.StructField("first_doc_id", T.LongType()),
        T.StructField("last_doc_id", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
_READ = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("local_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
)


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int) -> bytes:
    """A zstandard dictionary of a bounded sample of serialised id arrays (those of the smallest id
    hash among texts of at most SAMPLE_CHARS); raw ids where the sample is too small to train on.

    Hashes are held below a bound that leaves about four times the sample of all rows, so that tasks send
    no more than that however many they are. Rows without an id aren't sampled."""
    import zstandard

    place = unit_hash(F.col("doc_id"))
    fits = docs.where(F.col("doc_id").isNotNull() & (place < 4 * SAMPLE_DOCS / max(1, docs.count()))).select("doc_id", "text")
    fits = fits.where(F.length("text").between(1, SAMPLE_CHARS))
    sample = fits.orderBy(place, "doc_id", F.xxhash64("text")).limit(SAMPLE_DOCS).collect()
    arrays = [encode_ids(r.text, public_tokenizers.path(tokenizer)) + end_id.to_bytes(4, "little") for r in sample]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[:DICTIONARY_BYTES]


def write_token_files(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> None:
    """Encode every text, append ``end_id``, compress each document by itself against the shared
    dictionary and write blocks in ascending order of doc_id (nulls first; repeated ids by content).

    ``path``/dictionary holds the dictionary, ``path``/blocks the blocks: Parquet rows with the
    dictionary's hash, the documents' ids, token counts, places in the shard's stream of ids and
    byte offsets in ``payload``, so a document is read by its block and offset alone.
    """
    import hashlib

    spark = docs.sparkSession
    small_batches(spark)
    dictionary = train_dictionary(docs, tokenizer, end_id)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(
        f"{path}/dictionary"
    )
    shared = spark.sparkContext.broadcast(dictionary)  # at most DICTIONARY_BYTES

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        local, end = public_tokenizers.path(tokenizer), end_id.to_bytes(4, "little")
        frames = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        shard, number, start, rows, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def block() -> pa.RecordBatch:
            ids, counts, starts, packed = zip(*rows, strict=True)
            known = [x for x in ids if x is not None]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in packed])])
            row = [shard, number, name, min(known, default=None), max(known, default=None), sum(counts)]
            row += [list(ids), list(counts), list(starts), offsets.tolist(), b"".join(packed)]
            schema = pa.schema(list(zip(_BLOCK.names, _BLOCK_ARROW, strict=True)))
            return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, row, strict=True))], schema)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode_ids(text or "", local) + end
                n = len(ids) // 4
                rows.append((doc_id, n, start, frames.compress(ids)))
                start, size = start + n, size + len(rows[-1][3])
                if len(rows) == BLOCK_DOCS or size >= BLOCK_BYTES:
                    yield block()
                    number, rows, size = number + 1, [], 0
        if rows:
            yield block()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # texts are ordered before they are encoded: ranges are found from a sample of the keys, and each text is encoded once
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    ordered = keyed.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    ordered.select("doc_id", "text").mapInArrow(pack, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


_BLOCK_ARROW = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 4, pa.binary()]


def read_token_files(spark, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Documents of token files: doc_id, start, n_tokens, ids_crc32 and (little-endian) ids.

    ``doc_ids`` reads these documents alone: blocks are chosen by their id range, and only the
    wanted documents' frames are decompressed.
    """
    small_batches(spark)
    stored = spark.read.schema("dict_sha256 string, dictionary binary").parquet(f"{path}/dictionary").collect()
    shared = spark.sparkContext.broadcast({r.dict_sha256: bytes(r.dictionary) for r in stored})
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("total").alias("total"))  # a row for each file written
    before = F.coalesce(F.sum("total").over(_upwards()), F.lit(0)).cast("long")
    bases = totals.select("shard", before.alias("base"))
    wanted = None if doc_ids is None else set(doc_ids)
    if wanted is not None:
        hit = F.lit(False)
        for x in wanted:
            hit = hit | F.lit(x).between(F.col("first_doc_id"), F.col("last_doc_id"))
        blocks = blocks.where(hit)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import zstandard

        readers: dict = {}
        for batch in batches:
            for row in batch.to_pylist():
                name = row["dict_sha256"]
                if name not in readers:
                    raw = shared.value[name]
                    readers[name] = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
                out = []
                for i, doc_id in enumerate(row["doc_ids"]):
                    if wanted is None or doc_id in wanted:
                        ids = readers[name].decompress(row["payload"][row["offsets"][i] : row["offsets"][i + 1]])
                        out.append((doc_id, row["shard"], row["starts"][i], len(ids) // 4, zlib.crc32(ids), ids if with_ids else None))
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=_READ.names)

    found = blocks.mapInArrow(unpack, _READ).join(bases, "shard")
    return found.select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "ids")


def _upwards():
    from pyspark.sql.window import Window

    return Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
