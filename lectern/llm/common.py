"""Helpers shared by the training-data operators.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; ``bytes.split()``
splits on exactly these six bytes, so texts travel to Python as binary and are
never decoded for word work.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.scratch import drop_written, scratch_folder, written

#: Keys that a memo holds, if it is not told otherwise.
MEMO_KEYS = 150_000

Batches = Iterator[pa.RecordBatch]
_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


#: Tables in the folder that the cluster shares.
scratch_path, materialise, drop_table = scratch_folder, written, drop_written


def text_rows(docs: DataFrame, *more: str, text: str = "text") -> DataFrame:
    """doc_id, the named columns and the text as binary."""
    return docs.select("doc_id", *more, F.col(text).cast("binary").alias("text"))


class Memo(dict):
    """key -> make(key), remembered for up to ``limit`` keys and those used since the last turn.

    At the limit the memo becomes the old generation, from which keys still in
    use come back, so frequent keys stay however many rare ones pass.
    """

    def __init__(self, make: Callable, limit: int = MEMO_KEYS):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.old = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; hashing anew is cheaper than looking up what is mostly rare."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


_forget: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    """Register what a module remembers in a worker, and how to let go of it."""
    _forget[name] = forget


def only(name: str) -> None:
    """Let go of what other operators remember in this worker, and give freed memory back; called as a task begins."""
    for other, forget in _forget.items():
        if other != name:
            forget()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its pages
        ctypes.CDLL(None).malloc_trim(0)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, by doubling: a run of 2n is made of two runs of n."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, run, size = None, 0, words, 1
    while True:
        if k & size:
            out = run if out is None else mixed(out[: len(out) - size] * _MUL + run[have:][: len(out) - size])
            have += size
        if have == k:
            return out[:n]
        m = len(run) - size
        run = mixed(run[:m] * _MUL + run[size : size + m])
        size *= 2


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


#: A key with more than this share of the rows is hot; so there are fewer than HOT_KEYS hot ones, whatever the input.
HOT_KEYS = 4_000


def repeated(rows: DataFrame, key: str, name: str, n: int | None = None) -> DataFrame:
    """The rows whose ``key`` occurs twice or more. ``rows`` (``n`` in number) come from a written table, rows with a null key go.

    Counts are combined before their shuffle. A hot key's rows go to as many
    tasks as its share asks for; the table of hot keys has under HOT_KEYS rows.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("__c")).where("__c > 1")
    counts = materialise(counts, name)
    share = max((rows.count() if n is None else n) // HOT_KEYS, 1000)
    parts = F.ceil(F.col("__c") / share).cast("int")
    hot = counts.where(F.col("__c") > share).select(key, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), key, "left")
    part = F.when(F.col("__parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")).cast("int"))
    often = counts.select(key, F.explode(F.sequence(F.lit(0), F.when(F.col("__c") > share, parts - 1).otherwise(0))).alias("__part"))
    return dealt.withColumn("__part", part).join(often, [key, "__part"]).select(rows.columns)


#: Bits of a membership filter: its size is fixed, whatever it holds.
FILTER_BITS = 1 << 25


def slot(column: str, uniform: bool = False):
    """The bit of a long column's value; ``uniform`` values are hashes already."""
    c = F.col(column)
    return F.pmod(c if uniform else F.xxhash64(c), F.lit(FILTER_BITS))


def held(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 6] >> (slots & 63)) & 1).astype(bool)


def membership(ids: DataFrame, column: str, uniform: bool = False):
    """A broadcast bitmap that knows every value of a long column, and few others.

    It only narrows what a second read of the texts sends on; an exact join
    follows. Its size is FILTER_BITS / 8 bytes for any input.
    """
    spark = ids.sparkSession
    words = (
        ids.select(slot(column, uniform).alias("h"))
        .groupBy(F.shiftright("h", 6).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))
        .toArrow()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits)


def only_members(df: DataFrame, column: str, bits) -> DataFrame:
    """Rows whose ``column`` may be in the bitmap (all that are, and few others)."""

    def run(batches):
        for b in batches:
            keep = held(bits.value, b.column("__h").to_numpy())
            if keep.any():
                yield b.filter(pa.array(keep)).drop_columns(["__h"])

    return df.where(F.col(column).isNotNull()).withColumn("__h", slot(column)).mapInArrow(run, df.schema)


#: Bytes of text that a Python worker takes apart at once.
PORTION_BYTES = 2 << 20


def portions(batches: Batches, size: int = PORTION_BYTES, column: str = "text") -> Batches:
    """The batches in slices of about ``size`` bytes of text, a row at least, so that memory does not follow Arrow's batch size."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy().astype(np.int64))
        at = 0
        while at < len(ends):
            have = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, have + size, "right")))
            yield b.slice(at, to - at)
            at = to
