"""N-gram Jaccard join: all documents whose word 5-gram sets have a Jaccard of at least 0.8.

The links are the cells of the product of the document by n-gram matrix M with
its transpose that reach a size-derived bound. Only cells that can reach it are
begun, and their overlaps are accumulated over blocks of columns:

* rows with equal sets are one row of M (classes), so copies cost one row;
* columns are ordered rare first; only the first ``n - ceil(t*n) + 1`` columns
  of a row can hold the first common one of a linked pair (prefix bound), so a
  cell begins where two rows meet in such a column;
* sizes of linked rows differ by the factor ``t`` at most (length bound);
* a pair that first meets at positions i, j shares at most
  ``min(n - i, m - j)`` columns (position bound);
* the columns are cut into COLUMN_BLOCKS blocks. A cell's common columns are
  counted in the first blocks and the counts summed; a cell whose sum and
  columns to come cannot reach the bound is dropped, the others go on to the
  next blocks. After the last one the sum is the overlap.

The order of the columns comes from a count sketch of all incidences, of a
fixed size (SKETCH_BITS), so it is the only thing broadcast. Any order gives the
same result; rare first keeps the columns that passages common to many
documents fill out of the prefixes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_table, materialise, membership, only, only_members, portions, repeated, signed, text_rows, window_hashes, word_hashes
from lectern.llm.components import linked_components

#: Buckets of the column count sketch: 2**SKETCH_BITS counts, the same for any input.
SKETCH_BITS = 20
#: Rows in which the sketch is merged.
SLICES = 16
#: Blocks of columns, by the first bits of their hashes, and where a round of blocks begins and ends.
COLUMN_BLOCKS, ROUNDS = 8, (0, 2, 8)


def shingles(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word windows of a text, A-Z lower-cased; fewer words: one for all."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(k, len(words))))


def overlap_needed(t_num: int, t_den: int, n: int, m: int) -> int:
    """The least intersection of sets of n and m with intersection / union >= t_num / t_den."""
    return -(-t_num * (n + m) // (t_num + t_den))


def _survey(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("t", pa.int32()), ("n", pa.int64()), ("fp", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        only("words")
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        some = False
        for b in portions(batches, size=8 << 20):
            held = [shingles(text, k) for text in b.column("text").to_pylist()]
            ids, ts, ns, fps = b.column("doc_id").to_pylist(), b.column("t").to_pylist(), list(map(len, held)), [xxhash.xxh3_128_digest(s.tobytes()) for s in held]
            sketch += np.bincount((np.concatenate(held) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS).astype(np.uint32)
            some = True
            none = [None] * len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, ts, ns, fps, none, none), schema)], schema=schema)
        if some:
            parts = [zlib.compress(x.tobytes(), 1) for x in np.split(sketch, SLICES)]
            none = [None] * SLICES
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((none, none, none, none, list(range(SLICES)), parts), schema)], schema=schema)

    return run


def _merge_slices(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((1 << SKETCH_BITS) // SLICES, np.uint64)
    for b in batches:
        for x in b.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(x), np.uint32)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slice", "counts"])


def _prefixes(k: int, t_num: int, t_den: int, rank_of):
    """Rows of the first columns of each document, rare first: positions count from 0."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.binary()), ("prefix", pa.binary())])

    def run(batches):
        only("words")
        rank = np.frombuffer(zlib.decompress(rank_of.value), np.uint32)
        for b in portions(batches):
            out = ([], [], [], [])
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text, k)
                n = len(s)
                if doc is None or not n:
                    continue
                p = n - -(-t_num * n // t_den) + 1
                r = rank[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = np.lexsort((s, r))[:p] if p < n else np.lexsort((s, r))
                for c, x in zip(out, (doc, n, xxhash.xxh3_128_digest(s.tobytes()), s[first].tobytes())):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

    return run


def _explode(batches):
    schema = pa.schema([("g", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("rank", pa.int32())])
    for b in batches:
        blobs = [np.frombuffer(x, np.uint64) for x in b.column("prefix").to_pylist()]
        if not blobs:
            continue
        sizes = np.array([len(x) for x in blobs])
        of = np.repeat(np.arange(len(blobs)), sizes)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(np.concatenate(blobs))),
                pa.array(b.column("id").to_numpy()[of]),
                pa.array(b.column("n").to_numpy()[of]),
                pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in sizes])),
            ],
            schema=schema,
        )


def _sets(k: int):
    """The set of a class by blocks of columns, from a text that has it; a row for each block."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("columns", pa.list_(pa.int64()))])
    cuts = np.array([(i << 64) // COLUMN_BLOCKS for i in range(1, COLUMN_BLOCKS)], np.uint64)

    def run(batches):
        for b in portions(batches):
            ids, ns, columns = [], [], []
            for i, fp, text in zip(b.column("id").to_pylist(), b.column("fp").to_pylist(), b.column("text").to_pylist()):
                s = shingles(text, k)
                if xxhash.xxh3_128_digest(s.tobytes()) == fp:
                    ids += [i] * COLUMN_BLOCKS
                    ns += [len(s)] * COLUMN_BLOCKS
                    columns += np.split(signed(s), np.searchsorted(s, cuts))
            blocks = list(range(COLUMN_BLOCKS)) * (len(ids) // COLUMN_BLOCKS)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, ns, blocks, columns), schema)], schema=schema)

    return run


def accumulated(pairs: DataFrame, sets: DataFrame, t_num: int, t_den: int) -> DataFrame:
    """The pairs (a, b) whose overlap, summed over all blocks of columns, reaches the bound.

    ``sets`` has a row (id, n, block, columns) for each block of each row of M.
    """
    need = F.expr(f"({t_num} * (n + m) + {t_num + t_den - 1}) div {t_num + t_den}")
    so_far = pairs.select("a", "b", *[F.lit(0).cast("long").alias(c) for c in ("n", "m", "overlap", "of_a", "of_b")])
    for lo, hi in zip(ROUNDS, ROUNDS[1:]):
        some = sets.where(F.col("block").between(lo, hi - 1))
        x = some.select(F.col("id").alias("a"), F.col("n"), "block", F.col("columns").alias("x"))
        y = some.select(F.col("id").alias("b"), F.col("n").alias("m"), "block", F.col("columns").alias("y"))
        cells = so_far.select("a", "b").join(x, "a").join(y, ["b", "block"])
        counts = cells.select("a", "b", "n", "m", F.size(F.array_intersect("x", "y")).cast("long").alias("overlap"), F.size("x").cast("long").alias("of_a"), F.size("y").cast("long").alias("of_b"))
        total = so_far.union(counts).groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), *[F.sum(c).alias(c) for c in ("overlap", "of_a", "of_b")])
        so_far = materialise(total.where(F.col("overlap") + F.least(F.col("n") - F.col("of_a"), F.col("m") - F.col("of_b")) >= need), "cells")
    return so_far.select("a", "b")


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs`` (doc_id long, text string).

    Documents link when ``t_den * |A & B| >= t_num * |A | B|`` over their sets of
    k-word shingles; component_id is the smallest doc_id that links reach. A null,
    empty or wordless text has no shingle and links with nothing; a null doc_id
    has a null component_id and links with nothing. Rows that repeat a doc_id are
    judged each by its own text. Equal sets are one class with its smallest doc_id
    as representative, so copies are never paired. Texts of any length are read whole. Other columns are not read. An empty table gives an empty one.
    ``options``: k, and t_num and t_den of the bound.
    """
    return _components(docs, **options).drop("t")


def _components(docs: DataFrame, k: int = 5, t_num: int = 80, t_den: int = 100) -> DataFrame:
    """As ``jaccard_components``, with ``t``, a hash of the text, which tells rows of one doc_id apart."""
    spark = docs.sparkSession
    rows = text_rows(docs)
    survey = materialise(rows.withColumn("t", F.hash("text")).mapInArrow(_survey(k), "doc_id long, t int, n long, fp binary, slice int, counts binary"), "survey")
    merged = (
        survey.where("slice is not null").select("slice", "counts").groupBy("slice").applyInArrow(_merge_slices, "slice int, counts binary")
    )
    counts = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(r.counts, np.uint64) for r in merged.orderBy("slice").collect()]])
    if len(counts) == 0:
        counts = np.zeros(1 << SKETCH_BITS, np.uint64)
    levels = np.unique(counts, return_inverse=True)[1].astype(np.uint32)
    rank_of = spark.sparkContext.broadcast(zlib.compress(levels.tobytes(), 1))
    sets = survey.where("slice is null").select("doc_id", "t", "n", "fp")
    classes = materialise(
        sets.where("doc_id is not null and n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id")).withColumn("id", F.xxhash64("fp")),
        "classes",
    )
    prefix = rows.mapInArrow(_prefixes(k, t_num, t_den, rank_of), "doc_id long, n long, fp binary, prefix binary")
    reps = materialise(prefix.join(classes, ["doc_id", "fp"]).select("id", "n", "prefix").dropDuplicates(["id"]), "prefixes")
    incidences = reps.agg(F.sum(F.length("prefix") / 8)).first()[0] or 0
    # a column of one row makes no pair
    lists = materialise(repeated(reps.mapInArrow(_explode, "g long, id long, n long, rank int"), "g", "columns", int(incidences)), "columns")
    drop_table(reps)

    def bound(x, y):
        n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
        need = F.ceil(t_num * (n + m) / (t_num + t_den) - 1e-9)
        return (t_den * F.least(n, m) >= t_num * F.greatest(n, m)) & (F.least(n - F.col(f"{x}.rank"), m - F.col(f"{y}.rank")) >= need)

    def verify(pairs):
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = classes.join(ids, "id", "left_semi")
        some = only_members(rows, "doc_id", membership(wanted, "doc_id"))
        some = some.join(wanted, "doc_id").select("id", "fp", "text").mapInArrow(_sets(k), "id long, n long, block int, columns array<long>")
        return accumulated(pairs, materialise(some.dropDuplicates(["id", "block"]), "sets"), t_num, t_den)

    comp = linked_components(lists, bound, verify)
    members = classes.join(comp, "id")
    named = members.join(members.groupBy("component").agg(F.min("doc_id").alias("c")), "component").select("fp", "c")
    alone = classes.select("fp", F.col("doc_id").alias("first"))
    return (
        sets.join(alone.join(named, "fp", "left"), "fp", "left")
        .select(
            "doc_id",
            "t",
            F.col("n").alias("n_shingles"),
            F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.coalesce("c", "first")).alias("component_id"),
        )
    )


def keep_one_per_component(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, without those that are not their component's smallest doc_id.

    Rows that repeat a doc_id go or stay each by its own text.
    """
    gone = _components(docs, **options).where("component_id <> doc_id").select(F.col("doc_id").alias("__id"), F.col("t").alias("__t")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.hash(F.col("text").cast("binary")).alias("__key"))
    left = rows.join(gone, (F.col("row.doc_id") == F.col("__id")) & (F.col("__key") == F.col("__t")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])
