"""Word segmentation on a lattice: of all ways to cut a run into dictionary words and single characters, the likeliest by word frequencies.

The dictionary is a table of any size. Texts travel in compressed blocks, each with the words of the dictionary that occur in it,
as told by a bitmap of fixed size and then by an exact join; runs are cut in Python, where a block and its words meet.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Collection, Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.sources.scratch import written

#: The longest dictionary word that is looked up.
LONGEST_WORD = 8
#: Bytes of text in a block (a row at least), blocks in a file, and bits of the bitmap that tells which words a block asks for.
BLOCK_BYTES, FILE_BLOCKS, WORD_BITS = 8 << 20, 16, 1 << 26
#: Pieces whose cuts a task remembers.
MEMO_PIECES = 200_000


def word_dictionary(texts: DataFrame, column: str, run: str = "[一-鿿]{2,8}") -> DataFrame:
    """(word, n): what fully matches ``run`` among the parts of names and titles between other characters, and how often."""
    anything = run[: run.index("]") + 1]
    parts = texts.select(F.explode(F.regexp_extract_all(column, F.lit(f"{anything}+"), F.lit(0))).alias("word"))
    return parts.where(F.col("word").rlike(f"^{run}$")).groupBy("word").agg(F.count("*").alias("n"))


def unigram_costs(dictionary: DataFrame) -> DataFrame:
    """(word, cost): millionths of -ln of a word's share of all occurrences."""
    total = dictionary.agg(F.coalesce(F.sum("n"), F.lit(1)).alias("total"))
    millionths = lambda c: F.round(c * 1_000_000).cast("long")
    one = dictionary.groupBy("word").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total))  # one row
    return one.select("word", millionths(F.log("total") - F.log("n")).alias("cost"))


def _cheapest(text: str, costs: dict[str, int], alone: int, reach: dict[str, int]) -> list[str]:
    """The cheapest path; of equal cost the one of fewer words, then the one whose first difference is the longer word.

    ``reach``: the length of the longest word that begins with two characters.
    """
    n = len(text)
    cost, count, size = [0] * (n + 1), [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        low, few, best = costs.get(text[i], alone) + cost[i + 1], count[i + 1], 1
        for k in range(2, min(reach.get(text[i : i + 2], 0), n - i) + 1):
            known = costs.get(text[i : i + k])
            if known is not None:
                c = known + cost[i + k]
                if c < low or (c == low and count[i + k] <= few):
                    low, few, best = c, count[i + k], k
        cost[i], count[i], size[i] = low, few + 1, best
    words, i = [], 0
    while i < n:
        words.append(text[i : i + size[i]])
        i += size[i]
    return words


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _slots(columns: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The bits of words of 1, 2, 3... characters, given their first, second, third... characters."""
    h = np.uint64(0)
    for c in columns:
        h = (h[: len(c)] if isinstance(h, np.ndarray) else h) * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64) + np.uint64(1)
        x = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        yield (x >> np.uint64(38)).astype(np.int64)


@F.pandas_udf(T.LongType())
def _slot(word: pd.Series) -> pd.Series:
    out = np.zeros(len(word), np.int64)
    sizes = word.str.len().to_numpy()
    for k in set(sizes.tolist()):
        at = np.flatnonzero(sizes == k)
        *_, out[at] = _slots(iter(_codes("".join(word.iloc[at])).reshape(-1, k).T))
    return pd.Series(out)


def _word_bitmap(words: DataFrame) -> np.ndarray:
    """A bitmap that knows every word of the table, and few others."""
    at = words.select((_slot("word") + 1).alias("at"))
    held = at.groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bits = np.zeros((WORD_BITS // 8 // 4096, 4096), np.uint8)
    for r in held.toLocalIterator():  # 2048 rows at most
        bits[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return bits.reshape(-1)


def _words_asked(runs: Iterable[str], bits: np.ndarray, longest: int) -> list[str]:
    """The substrings of ``runs`` that the bitmap knows."""
    text = "\0".join(runs)
    codes, words = _codes(text), set()
    for k, slots in enumerate(_slots(codes[size:] for size in range(min(longest, len(codes)))), 1):
        hits = np.flatnonzero(bits[slots >> 3] >> (slots & 7).astype(np.uint8) & 1)
        _, first, of = np.unique(slots[hits], return_index=True, return_inverse=True)
        as_first = hits[first][of]
        other = np.zeros(len(hits), bool)  # words that have a bit in common with another
        for j in range(k):
            other |= codes[hits + j] != codes[as_first + j]
        words.update(text[i : i + k] for i in [*hits[first].tolist(), *hits[other].tolist()])
    return [w for w in words if "\0" not in w]


class _Cuts(dict):
    """piece -> make(piece), for up to ``limit`` pieces at once."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit = limit

    def __missing__(self, piece: str) -> list[str]:
        if len(self) >= self.limit:
            self.clear()
        self[piece] = words = self.make(piece)
        return words


def cut_texts(
    rows: DataFrame, column: str, dictionary: DataFrame, name: str, pieces: str | None = None, runs: str = "", longest: int = LONGEST_WORD,
    text: Column | None = None, least: int = 1, without: Collection[str] = (),
) -> DataFrame:
    """Adds ``name``: the words of a text column, an array. Of the parts that match ``pieces`` (the whole text, if it is not given) those that match ``runs`` are cut on their cheapest path.

    ``text``, if given, is cut instead of the column, and is never null. Words of under ``least`` characters and those in ``without`` are left out.
    Neither words nor their substrings are rows: a shuffle holds compressed blocks of rows, and for each block a row per dictionary word in it.
    """
    spark, without = rows.sparkSession, frozenset(without)
    held = written(dictionary.groupBy("word").agg(F.sum("n").alias("n")), "words")
    longest = held.where(F.length("word") <= longest).agg(F.max(F.length("word"))).first()[0] or 1
    alone = held.agg(F.round(F.log(F.coalesce(F.sum("n"), F.lit(1)).cast("double")) * 1_000_000).cast("long")).first()[0]
    costs = unigram_costs(held).where(F.length("word").between(1, longest))
    bits = spark.sparkContext.broadcast(_word_bitmap(costs))
    parts: Callable[[str], list[str]] = re.compile(pieces).findall if pieces else lambda x: [x]
    is_run = re.compile(runs).match
    cut = F.lit(None).cast("string") if text is None else F.when(text != F.coalesce(column, F.lit("")), text)  # a text is packed once
    packing = rows.withColumn("__text", cut)

    def texts(b: pa.RecordBatch | pa.Table):
        return pc.coalesce(b.column("__text"), b.column(column), pa.scalar("", b.column(column).type))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for b in batches:
            sizes = pc.coalesce(*[pc.binary_length(b.column(c)) for c in ("__text", column)], pa.scalar(0, pa.int32()))  # of the batch only sizes are copied
            ends = np.cumsum(sizes.to_numpy().astype(np.int64))
            at = 0
            while at < len(ends):
                to = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + BLOCK_BYTES, "right")))
                block, at = b.slice(at, to - at), to
                found = filter(is_run, set(chain.from_iterable(map(parts, texts(block).to_pylist()))))
                with pa.ipc.new_stream(out := pa.BufferOutputStream(), block.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_batch(block)
                words = pa.array([_words_asked(found, bits.value, longest)], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([out.getvalue().to_pybytes()], pa.binary()), words], ["block", "data", "words"])
                n += 1

    blocks = written(packing.mapInArrow(pack, "block long, data binary, words array<string>"), "blocks", maxRecordsPerFile=FILE_BLOCKS)
    asked = blocks.select("block", F.explode("words").alias("word")).join(costs, "word").select(F.col("block").alias("of"), "word", "cost")

    memos, limit = [], MEMO_PIECES  # one for a task

    def unpack(block: pa.Table, words: pa.Table) -> pa.Table:
        if not memos:
            memos.append(_Cuts(limit))
        memo = memos[0]
        known = dict(zip(words.column("word").to_pylist(), words.column("cost").to_pylist()))
        reach: dict[str, int] = {}
        for w in known:
            reach[w[:2]] = max(len(w), reach.get(w[:2], 0))
        cut = lambda piece: _cheapest(piece, known, alone, reach) if is_run(piece) else [piece]
        memo.make = lambda piece: [w for w in cut(piece) if len(w) >= least and w not in without]
        tables = []
        for data in block.column("data"):
            b = pa.ipc.open_stream(data.as_buffer()).read_all()
            flat, ends = [], [0]
            for t in texts(b).to_pylist():
                flat.extend(chain.from_iterable(map(memo.__getitem__, parts(t))))
                ends.append(len(flat))
            tables.append(b.drop_columns(["__text"]).append_column(name, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))))
        return pa.concat_tables(tables)

    schema = T.StructType([*rows.schema, T.StructField(name, T.ArrayType(T.StringType()))])
    return blocks.select("block", "data").groupBy("block").cogroup(asked.groupBy("of")).applyInArrow(unpack, schema)


def best_paths(runs: DataFrame, dictionary: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """(run, words): each distinct non-empty ``run`` cut on its cheapest path. ``dictionary``: (word, n).

    A character that no word covers stands alone, at the cost of a word seen once. Characters are those of the
    basic plane and beyond alike. An empty dictionary cuts runs into characters.
    """
    return cut_texts(runs.where(F.length("run") > 0).select("run").distinct(), "run", dictionary, "words", longest=longest)
