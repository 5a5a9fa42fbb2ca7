"""Token ids in compressed files with random access to short documents.

A store is a folder of two Parquet tables, so any file system Spark knows can
hold it and writing it survives lost executors:

* ``dictionary``: one row (dict_hash, dictionary), a zstandard dictionary
  trained on serialised id arrays;
* ``blocks``: rows of some hundred documents in doc_id order (shard, block,
  dict_hash, width, least_id, greatest_id, doc_ids, n_tokens, offsets, payload). Each document is a
  zstandard frame of its own in ``payload`` from ``offsets[i]`` to
  ``offsets[i + 1]``: its ids as little-endian integers of ``width`` bytes.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.bpe import byte_symbols
from lectern.llm.common import Memo, only, portions, remembers

#: The dictionary is trained on this many documents at most, by TRAIN_PIECES pieces of TRAIN_BYTES of each, dealt evenly over its ids.
TRAIN_DOCS, TRAIN_PIECES, TRAIN_BYTES, DICT_BYTES = 512, 4, 16_384, 65_536
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20
#: Chunks remembered at once.
MEMO_CHUNKS = 750_000


#: A word of Latin letters, with a comma or full stop after it at most. Such letters are whole characters in
#: NFC, and neither normalisation nor the tokenizer's split joins them to a mark that follows.
_plain = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)").fullmatch


class ChunkEncoder:
    """Ids of texts by a tokenizer that drops white space: each distinct chunk between white space is encoded once.

    A plain word is given to the tokenizer's model lower-cased; everything else
    goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.memo = Memo(self.one, MEMO_CHUNKS)
        symbols = {b: s for s, b in byte_symbols().items()}
        self.symbols = {b: symbols[b] for b in range(128, 256) if ord(symbols[b]) != b}
        # the model is asked directly only if that is what the tokenizer does
        probe = ["probe", "Word", "Éßÿ", "øÀé"]
        self.direct = self.whole(" ".join(probe)) == b"".join(map(self.word, probe))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        spelled = word.lower().encode().decode("latin-1").translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def one(self, chunk: bytes) -> bytes:
        if self.direct and chunk.isalpha():  # of bytes, ASCII letters only: spelled as they are
            return array("I", [t.id for t in self.model.tokenize(chunk.lower().decode())]).tobytes()
        text = chunk.decode("utf-8", "replace")
        found = _plain(text) if self.direct else None
        if not found:
            return self.whole(text)
        return self.memo[chunk[:-1]] + self.memo[chunk[-1:]] if found[2] else self.word(text)

    def ids(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.memo.__getitem__, (text or b"").split())), np.uint32)


@lru_cache(2)
def encoder(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


remembers("chunks", encoder.cache_clear)


def _pieces(path: str, end: int, batches):
    enc = encoder(path)
    for b in portions(batches):
        out = []
        for t in b.column("text").to_pylist():
            raw = np.append(enc.ids(t), np.uint32(end)).astype(f"<u{enc.width}").tobytes()
            starts = np.linspace(0, max(0, len(raw) - TRAIN_BYTES), min(TRAIN_PIECES, -(-len(raw) // TRAIN_BYTES))).astype(int)
            out += [raw[i : i + TRAIN_BYTES] for i in (starts - starts % enc.width).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["piece"])


def train_dictionary(docs: DataFrame, path: str, end: int) -> bytes:
    """A dictionary from the id arrays of TRAIN_DOCS documents at most, those of least hash.

    The driver gets TRAIN_DOCS * TRAIN_PIECES pieces of TRAIN_BYTES at most; they are cut where the ids are made.
    """
    ids = [r.doc_id for r in docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS).collect()]
    some = docs.where(F.col("doc_id").isin(ids)).select(F.col("text").cast("binary").alias("text"))
    most = TRAIN_DOCS * TRAIN_PIECES  # rows may repeat a doc_id
    pieces = sorted(some.mapInArrow(partial(_pieces, path, end), "piece binary").limit(most).toArrow().column("piece").to_pylist())
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples to train on: their bytes are the dictionary
        return b"".join(pieces)[:DICT_BYTES] or b"\0" * 8


_BLOCK = pa.schema(
    [
        ("shard", pa.int32()),
        ("block", pa.int64()),
        ("dict_hash", pa.string()),
        ("width", pa.int32()),
        ("least_id", pa.int64()),
        ("greatest_id", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("payload", pa.binary()),
    ]
)
BLOCK_DDL = "shard int, block long, dict_hash string, width int, least_id long, greatest_id long, doc_ids array<bigint>, n_tokens array<bigint>, offsets array<bigint>, payload binary"


def _blocks(path: str, end: int, dictionary: bytes, dict_hash: str, batches):
    only("chunks")
    enc, shard = encoder(path), TaskContext.get().partitionId()
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), level=3)
    ids, ns, frames, size, done = [], [], [], 0, 0

    def block():
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in frames])]).tolist()
        known = [i for i in ids if i is not None]
        ends = [min(known, default=None)], [max(known, default=None)]
        row = [[shard], [(shard << 32) + done], [dict_hash], [enc.width], *ends, [ids], [ns], [offsets], [b"".join(frames)]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _BLOCK)], schema=_BLOCK)

    for b in portions(batches):
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            raw = np.append(enc.ids(text), np.uint32(end)).astype(f"<u{enc.width}")
            frame = pack.compress(raw.tobytes())
            ids.append(doc)
            ns.append(len(raw))
            frames.append(frame)
            size += len(frame)
            if len(ids) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield block()
                ids, ns, frames, size, done = [], [], [], 0, done + 1
    if ids:
        yield block()


def write_store(docs: DataFrame, target: str, tokenizer_path: str, end: int = 1) -> None:
    """Encode every whole text (null: empty), append ``end``, and write the store at ``target`` in ascending doc_id order.

    A null doc_id comes first; rows that repeat a doc_id follow each other by
    text. A text of any length is one frame. Other columns are not read. An empty table makes a store without blocks.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path, end)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary").coalesce(1).write.parquet(f"{target}/dictionary")
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    dealt.mapInArrow(partial(_blocks, tokenizer_path, end, dictionary, dict_hash), BLOCK_DDL).write.parquet(f"{target}/blocks")


def _opener(dictionaries: dict[str, bytes]):
    open_ = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(v)) for k, v in dictionaries.items()}
    return lambda dict_hash, width, frame: np.frombuffer(open_[dict_hash].decompress(frame), f"<u{width}").astype("<u4")


def _documents(dictionaries, digest: bool, batches):
    unpack = _opener(dictionaries)
    names = ["doc_id", "block", "before", "n_tokens", "ids_crc32" if digest else "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary()]
    for b in batches:
        for r in b.to_pylist():
            before = np.concatenate([[0], np.cumsum(r["n_tokens"])[:-1]]).astype(np.int64)
            out = []
            for i in range(len(r["doc_ids"])):
                ids = unpack(r["dict_hash"], r["width"], r["payload"][r["offsets"][i] : r["offsets"][i + 1]])
                if len(ids) != r["n_tokens"][i]:
                    raise ValueError(f"block {r['block']} holds {len(ids)} ids of a document of {r['n_tokens'][i]}")
                out.append(zlib.crc32(ids.tobytes()) if digest else ids.tobytes())
            cols = [r["doc_ids"], [r["block"]] * len(out), before, r["n_tokens"], out]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)


def read_dictionaries(spark: SparkSession, source: str) -> dict[str, bytes]:
    return {r.dict_hash: bytes(r.dictionary) for r in spark.read.parquet(f"{source}/dictionary").collect()}


def read_store(spark: SparkSession, source: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids little-endian unsigned 32-bit, or with ``digest`` their ids_crc32.

    ``start`` counts the ids of all documents before. Totals of the blocks are
    summed within each shard, then over the shards, of which there are as many
    as the writer had partitions.
    """
    blocks = spark.read.parquet(f"{source}/blocks")
    total = F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    sums = blocks.select("shard", "block", total.alias("total"))
    shards = sums.groupBy("shard").agg(F.sum("total").alias("of_shard"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("of_shard").over(w), F.lit(0)).alias("shard_start"))
    w = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("in_shard", F.coalesce(F.sum("total").over(w), F.lit(0))).join(shards, "shard")
    starts = starts.select("block", (F.col("in_shard") + F.col("shard_start")).alias("block_start"))
    last = "ids_crc32" if digest else "ids"
    rows = blocks.mapInArrow(
        partial(_documents, read_dictionaries(spark, source), digest),
        f"doc_id long, block long, before long, n_tokens long, {last} {'long' if digest else 'binary'}",
    )
    return rows.join(starts, "block").select("doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", last)


def fetch(spark: SparkSession, source: str, doc_id: int) -> list[int] | None:
    """The ids of one document: Parquet prunes by the blocks' least and greatest doc_id, only its frame is decompressed."""
    near = F.lit(doc_id).between(F.col("least_id"), F.col("greatest_id"))
    rows = spark.read.parquet(f"{source}/blocks").where(near & F.array_contains("doc_ids", F.lit(doc_id))).limit(1).collect()
    if not rows:
        return None
    r = rows[0]
    i = r.doc_ids.index(doc_id)
    return _opener(read_dictionaries(spark, source))(r.dict_hash, r.width, bytes(r.payload[r.offsets[i] : r.offsets[i + 1]])).tolist()
