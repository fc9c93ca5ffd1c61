"""Token-id files: one zstandard dictionary for all documents, each document compressed by itself, an offset index, a dictionary hash.

A token file is a folder with two Parquet datasets:

- dictionary: one row (dict_hash, width, trained, data): the dictionary trained on serialized id arrays of a bounded sample, and its SHA-256;
- blocks: rows (part, block, dict_hash, doc_ids, n_tokens, offsets, frames). frames is the concatenation of the documents' zstandard frames and
  offsets their ends in it, so that a short document is read by cutting out and decompressing its own frame alone. Parts are ranges of doc_id in
  ascending order, of about PART_CHARS characters; within a part blocks, and in a block documents, ascend.

Spark's own writer makes them, so they may lie in any store that Spark reaches, and a lost task is simply written again.

Defined cases: a null text is encoded as an empty one; an empty document still has its end id; a null doc_id comes first; rows of one doc_id, which may
fill several parts, are in the order of a hash of their texts; extra columns are not read; an empty table makes a file without blocks; where zstandard
finds a sample too small to train on, the sample itself is the dictionary, and `trained` says so.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from entigraph.llm.common import new_path, table

END_ID = 1
#: The dictionary is fitted on the ids of about so many documents, those of the least hashes, and at most so many ids of each, from a place that a hash chooses.
SAMPLE_DOCS, SAMPLE_IDS, DICT_BYTES = 1000, 4000, 65536
#: Characters of text in a part, about; there are no fewer parts than shuffle partitions.
PART_CHARS = 64_000_000
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
CACHE = 800_000
BLOCKS = "part int, block int, dict_hash string, doc_ids array<long>, n_tokens array<int>, offsets array<long>, frames binary"


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """The tokenizers library's ids of whole texts, with the ids of pieces seen before at hand.

    Word tokenizers of this kind drop blanks and never join across pieces, so a text's ids are its pieces' ids in a row, and so are those of what stands
    between two blanks, a chunk. Texts are cut at blanks, and chunks not seen lately by the file's own pattern; new pieces go to the library many at once,
    with blanks between, and come back cut where a token ends a piece. Texts that its normalizer may change beyond lower case, or that may hold an added
    token, go to the library whole. The tables of pieces and chunks are emptied when they have grown past CACHE.
    """

    def __init__(self, file: str) -> None:
        import regex
        from tokenizers import Tokenizer

        spec = json.load(open(file, encoding="utf-8"))
        self.lib, self.pieces, self.chunks = Tokenizer.from_file(file), {}, {}
        self.lib.no_truncation()
        self.lib.no_padding()
        self.type = np.dtype("<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4")
        tail = spec["model"].get("end_of_word_suffix")
        (split,) = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.findall = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}")).findall
        self.last = np.zeros(self.lib.get_vocab_size() + 1, bool)
        self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(tail)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.type).tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            ids = np.array(self.lib.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.type)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                got = self._ids(part)
            else:
                raw, width = ids.tobytes(), self.type.itemsize
                got = [raw[a * width : b * width] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]
            self.pieces.update(zip(part, got, strict=True))

    def _new_chunks(self, new: list[str]) -> None:
        if len(self.pieces) > CACHE:
            self.pieces = {}
        cut = [self.findall(c) for c in new]
        self._new_pieces(list({p for pieces in cut for p in pieces if p not in self.pieces}))
        known = self.pieces
        self.chunks.update((c, b"".join([known[p] for p in pieces])) for c, pieces in zip(new, cut, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Serialized ids of each text, without an end id."""
        cut: list[list[str] | None] = []
        for t in texts:
            low = (t or "").lower()
            plain = low.isascii() or "\u03a3" not in t and is_normalized("NFC", t) and is_normalized("NFC", low)
            # blanks to split() but not to the pattern
            odd = "\x1c" in low or "\x1d" in low or "\x1e" in low or "\x1f" in low
            cut.append((self.findall(low) if odd else low.split()) if plain and "<|" not in low else None)
        if len(self.chunks) > CACHE:
            self.chunks = {}
        self._new_chunks(list({c for chunks in cut if chunks for c in chunks if c not in self.chunks}))
        known = self.chunks
        return [self._ids([t])[0] if chunks is None else b"".join([known[c] for c in chunks]) for t, chunks in zip(texts, cut, strict=True)]


@lru_cache(maxsize=2)
def word_encoder(file: str) -> WordEncoder:
    return WordEncoder(file)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def train_dictionary(docs: DataFrame, file: str, n_docs: int) -> tuple[bytes, bool]:
    """From SAMPLE_DOCS documents chosen by hash: a bounded sample that does not depend on the partitions. False: it is the sample, too small to train on."""
    rows = _plain(docs)
    part = min(1.0, 2 * SAMPLE_DOCS / max(1, n_docs))  # a coarse cut, so that few rows are sorted
    mixed = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    start = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - 8 * SAMPLE_IDS + 1, F.lit(1))).cast("int") + 1
    least = rows.where(mixed < part * 1_000_003).select(mixed.alias("h"), "doc_id", F.substring("text", start, F.lit(8 * SAMPLE_IDS)).alias("text"))
    rows = least.orderBy("h", "doc_id", "text").limit(SAMPLE_DOCS).select("text").collect()
    e = word_encoder(file)
    samples = sorted(b[: SAMPLE_IDS * e.type.itemsize] for b in e.encode([r.text for r in rows]) if len(b) >= 8)
    try:
        return zstandard.train_dictionary(max(256, min(DICT_BYTES, sum(map(len, samples)) // 8)), samples, level=3).as_bytes(), True
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICT_BYTES], False


def _place(bounds: list[int], d: Column, equal: bool) -> Column:
    """How many of the sorted bounds are less than d, or equal to it too: a binary search."""
    at, n = F.lit(bounds).cast("array<bigint>"), len(bounds)
    low = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

    def half(a: Column, _: Column) -> Column:
        mid = F.floor((a["lo"] + a["hi"]) / 2).cast("int")
        below = F.get(at, mid) <= d if equal else F.get(at, mid) < d
        go = (a["lo"] < a["hi"]) & below
        return F.struct(F.when(go, mid + 1).otherwise(a["lo"]).alias("lo"), F.when(go, a["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(n.bit_length())), low, half, lambda a: a["lo"])


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """docs (doc_id, text) with part and h, in parts of ascending doc_id, each in its order.

    Parts end at the quantiles of doc_id, which read that column alone and are the same whenever a task is run again. A doc_id that is several quantiles
    has several parts, dealt by h, a hash of the text."""
    key, h = F.coalesce("doc_id", F.lit(-(2**63))), F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    cuts = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 20 * parts))).first()[0] if parts > 1 else None
    part = F.lit(0)
    if cuts:
        first, behind = _place(cuts, key, False), _place(cuts, key, True)
        part = first + F.floor((behind - first) * F.col("h") / (1 << 20))
    out = docs.withColumn("h", h).withColumn("part", part.cast("int")).repartitionById(len(cuts or []) + 1, F.col("part"))
    return out.sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "h", "text")


def write_tokens(docs: DataFrame, path: str, file: str | None = None, end_id: int = END_ID, parts: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the token file at path, in ascending doc_id order."""
    spark, file = docs.sparkSession, file or default_file()
    docs = _plain(docs)
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    data, trained = train_dictionary(docs, file, size.n)
    e = word_encoder(file)
    name, width, end = hashlib.sha256(data).hexdigest(), e.type.itemsize, np.array([end_id], e.type).tobytes()
    spark.createDataFrame([(name, width, trained, bytearray(data))], "dict_hash string, width int, trained boolean, data binary").write.parquet(f"{path}/dictionary")
    dealt = _dealt(docs, parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), size.chars // PART_CHARS))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(file)
        press = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(data), write_checksum=False) if data else zstandard.ZstdCompressor(level=3)
        number: dict[int, int] = {}
        ids, counts, frames, filled, at = [], [], [], 0, None

        def block() -> pa.RecordBatch:
            k = number[at] = number.get(at, -1) + 1
            row = {"part": at, "block": k, "dict_hash": name, "doc_ids": ids, "n_tokens": counts, "offsets": np.cumsum([len(f) for f in frames]).tolist(), "frames": b"".join(frames)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("block", pa.int32()), ("dict_hash", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("frames", pa.binary())]))

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                cut = batch.slice(lo, 256)
                for p, d, b in zip(cut.column(2).to_pylist(), cut.column(0).to_pylist(), enc.encode(cut.column(1).to_pylist()), strict=True):
                    if ids and (p != at or len(ids) >= BLOCK_DOCS or filled >= BLOCK_BYTES):
                        yield block()
                        ids, counts, frames, filled = [], [], [], 0
                    at = p
                    ids.append(d)
                    counts.append((len(b) + width) // width)
                    frames.append(press.compress(b + end))
                    filled += len(frames[-1])
        if ids:
            yield block()

    dealt.select("doc_id", "text", "part").mapInArrow(blocks, BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def read_dictionary(spark: SparkSession, path: str) -> tuple[str, int, bytes]:
    """One row, of a size that write_tokens() bounds."""
    r = spark.read.parquet(f"{path}/dictionary").first()
    return r.dict_hash, r.width, bytes(r.data)


def _opener(name: str, data: bytes):
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError("the dictionary's bytes don't have its hash")
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)) if data else zstandard.ZstdDecompressor()


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, block, pos, doc_id, n_tokens long, crc32 long, ids binary): every document of the file; ids are its serialized ids, crc32 that of them as 32-bit ids."""
    name, width, data = read_dictionary(spark, path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _opener(name, data)
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(i)[r] for i, c in enumerate(batch.schema.names)}
                if row["dict_hash"].as_py() != name:
                    raise ValueError("a block was written with another dictionary")
                view, ends = memoryview(row["frames"].as_buffer()), row["offsets"].as_py()
                raw = [press.decompress(view[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in raw]
                n, k = len(raw), [len(x) // width for x in raw]
                yield pa.RecordBatch.from_arrays([pa.array([row["part"].as_py()] * n, pa.int32()), pa.array([row["block"].as_py()] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(k, pa.int64()), pa.array(crc, pa.int64()), pa.array(raw, pa.binary())], ["part", "block", "pos", "doc_id", "n_tokens", "crc32", "ids"])

    return read_blocks(spark, path).mapInArrow(read, "part int, block int, pos int, doc_id long, n_tokens long, crc32 long, ids binary")


def with_starts(spark: SparkSession, path: str, docs: DataFrame) -> DataFrame:
    """docs (part, block, pos, n_tokens, ...) with start: the ids of all documents before. Totals of blocks are a few numbers a part, summed part by part."""
    sizes = read_blocks(spark, path).select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    blocks = sizes.join(before, "part").select("part", "block", (F.col("part_start") + F.sum("n").over(Window.partitionBy("part").orderBy("block")) - F.col("n")).alias("block_start"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part", "block").orderBy("pos")) - F.col("n_tokens")
    return docs.join(blocks, ["part", "block"]).withColumn("start", F.col("block_start") + inside)


def read_one(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The ids of each row of one document, by the index: only its own frames are decompressed."""
    name, width, data = read_dictionary(spark, path)
    hit = read_blocks(spark, path).where(F.array_contains("doc_ids", F.lit(doc_id).cast("long"))).select("part", "block", F.posexplode("doc_ids").alias("i", "d"), "offsets", "frames").where(F.col("d") == doc_id)
    start = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.expr("offsets[i - 1]"))
    rows = hit.select("part", "block", "i", F.expr("offsets[i]").alias("b"), start.alias("a"), "frames").selectExpr("part", "block", "i", "substring(frames, cast(a + 1 as int), cast(b - a as int)) as frame").orderBy("part", "block", "i").collect()
    press = _opener(name, data)
    return [np.frombuffer(press.decompress(bytes(r.frame)), f"<u{width}").tolist() for r in rows]


def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-file")
    write_tokens(table(spark, sf_dir, "documents"), path)
    docs = read_tokens(spark, path).drop("ids")
    return with_starts(spark, path, docs).select("doc_id", "start", "n_tokens", F.col("crc32").alias("ids_crc32"))
