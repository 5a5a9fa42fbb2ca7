"""Suffix dedup: bytes that a 50-byte string covers which also starts in a document of smaller doc_id are removed.

Suffixes of all shards (portions of the input) are brought into one order by
iterative interleave refinement, as Burrows-Wheeler transforms are merged: the order by the first
h bytes becomes that by h + 2 through the two bytes before each suffix, stable in the last order,
so no suffix is compared with another. After the last round, neighbours with a common prefix of 50 bytes form
the repeated intervals, and the smallest doc_id of an interval decides.

One order of all suffixes would pass through one task, and a shard's whole suffixes through its
shuffle, so the work is dealt by content first. A window's mark is the least hash of its
16-byte strings: equal windows have equal marks, and neighbouring windows mostly share theirs, so a run of windows of
one mark travels as one string. A first pass counts marks alone; strings whose mark occurs once go no further.
The others meet in the bucket of their mark, where the shards' strings are merged.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, mixed, only, portions

WINDOW = 50
#: Bytes that are hashed for a mark.
GRAM = 16
#: Bytes of text in a shard, or so; a document is in one.
SHARD_BYTES = 2 << 20
#: Bytes of a bucket's marks or strings, or so.
BUCKET_BYTES = 3 << 20
#: Windows of a run that travel as one string at most; longer runs are several strings.
RUN_WINDOWS = 64
#: Bits of the two broadcast bitmaps of marks. Their size is fixed; beyond some 10^7 marks they let more through, which costs work and changes no result.
FILTER_BITS = 1 << 26
#: A mark with more runs than this is hot: its windows travel one by one and meet in buckets of their own hashes.
HOT_RUNS = 50_000

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def _shards(size: int, batches):
    """(text bytes, bounds, ids, kinds) of portions with a doc_id and a window at least somewhere."""
    for b in portions(batches, size):
        text = b.column("text").combine_chunks() if isinstance(b.column("text"), pa.ChunkedArray) else b.column("text")
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        at = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
        data, at = data[at[0] : at[-1]], at - at[0]
        yield data, at, b.column("doc_id").to_numpy(), b.column("t").to_numpy()


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as a number."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,)).copy()


def marked_runs(data: np.ndarray, at: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(start, windows, mark, hashes): maximal runs of windows of one document with equal marks. ``hashes`` are of the 16 bytes from each position on."""
    none = np.zeros(0, np.int64)
    n = len(data) - window + 1
    if n <= 0:
        return none, none, none.view(_U), none.view(_U)
    eight = _eight(data)
    h = mixed(eight[: len(data) - gram + 1] * _MUL + eight[gram - 8 :]) | _U(1)
    del eight
    low, size, span = h, 1, window - gram + 1
    while size * 2 <= span:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - span + size], low[span - size :])[:n]
    # windows that begin in a document's last bytes reach into the next
    low = low if low is not h else low.copy()
    ends = at[1:]
    tail = np.minimum(ends - at[:-1], window - 1)
    over = np.repeat(ends - tail, tail) + np.arange(int(tail.sum())) - np.repeat(np.cumsum(tail) - tail, tail)
    low[over[over < n]] = 0
    new = np.concatenate([[True], low[1:] != low[:-1]])
    begins = at[:-1]
    new[begins[begins < n]] = True
    start = np.flatnonzero(new)
    windows = np.diff(np.append(start, n))
    real = low[start] != 0
    return start[real], windows[real], mixed(low[start[real]] * _MUL), h  # least hashes are low numbers: spread again


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(40)) * _U(buckets)) >> _U(24)


def _marks(window: int, size: int, buckets: int, batches):
    """Marks of a shard and how many runs have each, dealt by mark."""
    only("marks")
    names = ["bucket", "marks", "runs"]
    for data, at, _, _ in _shards(size, batches):
        mark, runs = np.unique(marked_runs(data, at, window)[2], return_counts=True)
        if len(mark):
            runs = np.minimum(runs, 65535).astype(np.uint16)
            to = _bucket(mark, buckets).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
            cols = [pa.array(to[cut[:-1]]), *(pa.array([x[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()) for x in (mark, runs))]
            yield pa.RecordBatch.from_arrays(cols, names=names)


def _slot(mark: np.ndarray, bits: int) -> np.ndarray:
    return (mark >> _U(65 - bits.bit_length())).astype(np.int64)


def _counted(hot_runs: int, bits: int):
    def run(table: pa.Table) -> pa.Table:
        """Words of the bitmaps of repeated and of hot marks, and the number of runs with a repeated mark."""
        mark = np.concatenate([np.frombuffer(x, _U) for x in table.column("marks").to_pylist()])
        runs = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("runs").to_pylist()])
        by = np.argsort(mark)
        mark = mark[by]
        first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
        total = np.add.reduceat(runs[by].astype(np.int64), first)
        often = total > 1
        slot, total = _slot(mark[first[often]], bits), total[often]
        if not len(slot):
            return pa.table({c: pa.array([], pa.int64()) for c in ("word", "bits", "hot", "runs")})
        word = slot >> 6
        begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        bit = np.int64(1) << (slot & 63)
        cols = np.bitwise_or.reduceat(bit, begins), np.bitwise_or.reduceat(np.where(total > hot_runs, bit, 0), begins), np.add.reduceat(total, begins)
        return pa.table({"word": word[begins], "bits": cols[0], "hot": cols[1], "runs": cols[2]})

    return run


def _held(bits: np.ndarray, mark: np.ndarray) -> np.ndarray:
    slot = _slot(mark, 64 * len(bits))
    return ((bits[slot >> 6] >> (slot & 63)) & 1).astype(bool)


_STRINGS = "bucket long, text binary, size binary, string binary, doc binary, start binary, doc_id binary, t binary"


def _strings(window: int, size: int, longest: int, buckets: int, filters, batches):
    """The runs of a shard whose mark is repeated, as strings, dealt by mark: distinct strings, and for each run its string, document and start."""
    only("marks")
    names = [x.split()[0] for x in _STRINGS.split(", ")]
    for data, at, doc_id, t in _shards(size, batches):
        start, windows, mark, h = marked_runs(data, at, window)
        bits, hot = filters.value
        keep = _held(bits, mark)
        start, windows, mark = start[keep], windows[keep], mark[keep]
        if not len(start):
            continue
        is_hot = _held(hot, mark)
        step = np.where(is_hot, 1, longest)
        parts = -(-windows // step)
        of = np.repeat(np.arange(len(start)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = start[of] + k * step[of]
        count = np.minimum(windows[of] - k * step[of], step[of])
        key = mark[of]
        alone = is_hot[of]
        if alone.any():
            a = begin[alone]
            whole = h[a]
            for b in [*range(GRAM, window - GRAM, GRAM), window - GRAM]:
                whole = mixed(whole * _MUL + h[a + b])
            key[alone] = whole
        del h
        doc = np.searchsorted(at, begin, "right") - 1
        to = _bucket(key, buckets).astype(np.int64)
        by = np.argsort(to, kind="stable")
        begin, count, doc, to = begin[by], count[by], doc[by], to[by]
        raw, end = data.tobytes(), begin + count + (window - 1)
        cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() + [len(to)]
        rows = [[] for _ in names]
        for a, b in zip(cut, cut[1:]):
            found: dict[bytes, int] = {}
            string = [found.setdefault(raw[x:y], len(found)) for x, y in zip(begin[a:b].tolist(), end[a:b].tolist())]
            docs, of_doc = np.unique(doc[a:b], return_inverse=True)
            sizes = np.fromiter(map(len, found), np.uint8, len(found))
            values = (
                int(to[a]), b"".join(found), sizes.tobytes(), np.array(string, np.uint32).tobytes(), of_doc.astype(np.uint32).tobytes(),
                (begin[a:b] - at[doc[a:b]]).astype(np.int32).tobytes(), doc_id[docs].tobytes(), t[docs].tobytes(),
            )
            for c, x in zip(rows, values):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(c, pa.binary()) for c in rows[1:])], names=names)


def interleaved(text: np.ndarray, start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the windows in the order of their bytes, and which of them differ from the one before.

    Every round prepends two bytes to what the windows are ordered by, from the last two on.
    """
    pair = text[:-1].astype(np.uint16) * np.uint16(256) + text[1:]
    order = np.arange(len(start))
    for back in range(window - 2, -2, -2):
        at = start[order] + back
        order = order[np.argsort(pair[at], kind="stable")]
    first = np.ones(len(order), bool)
    at = start[order]
    differ = np.zeros(len(order) - 1, bool)
    eight = _eight(text)
    for k in [*range(0, window - 8, 8), window - 8]:
        v = eight[at + k]
        differ |= v[1:] != v[:-1]
    first[1:] = differ
    return order, first


def _merged(window: int):
    def run(table: pa.Table) -> pa.Table:
        """Strings of all shards to the spans that go from each document, as pairs of int32."""
        table = table.combine_chunks()
        column = lambda c: table.column(c).to_pylist()
        found: dict[bytes, int] = {}
        string, docs, kinds, starts = [], [], [], []
        for text, size, of, doc, start, doc_id, t in zip(*map(column, ("text", "size", "string", "doc", "start", "doc_id", "t"))):
            ends = np.cumsum(np.frombuffer(size, np.uint8), dtype=np.int64).tolist()
            here = np.fromiter((found.setdefault(text[a:b], len(found)) for a, b in zip([0, *ends], ends)), np.int64, len(ends))
            doc = np.frombuffer(doc, np.uint32)
            string.append(here[np.frombuffer(of, np.uint32)])
            docs.append(np.frombuffer(doc_id, np.int64)[doc])
            kinds.append(np.frombuffer(t, np.int32)[doc])
            starts.append(np.frombuffer(start, np.int32))
        string, doc, kind, start = map(np.concatenate, (string, docs, kinds, starts))
        del docs, kinds, starts
        names = ["doc_id", "t", "spans"]
        empty = pa.table({"doc_id": pa.array([], pa.int64()), "t": pa.array([], pa.int32()), "spans": pa.array([], pa.binary())})
        least = np.full(len(found), _LAST)
        np.minimum.at(least, string, doc)
        size = np.fromiter(map(len, found), np.int64, len(found))
        text = np.frombuffer(b"".join(found), np.uint8)
        found.clear()
        windows = size - (window - 1)
        base = np.cumsum(windows) - windows
        of = np.repeat(np.arange(len(size)), windows)
        at = np.repeat(np.cumsum(size) - size, windows) + np.arange(len(of)) - base[of]
        order, first = interleaved(text, at, window)
        begins = np.flatnonzero(first)
        smallest = np.minimum.reduceat(least[of[order]], begins)
        by_window = np.empty(len(of), np.int64)
        by_window[order] = np.repeat(smallest, np.diff(np.append(begins, len(order))))
        del order, first, of, at
        low, high = np.minimum.reduceat(by_window, base), np.maximum.reduceat(by_window, base)
        some = low[string] < doc
        string, doc, kind, start = string[some], doc[some], kind[some], start[some]
        whole = high[string] < doc
        out = [(doc[whole], kind[whole], start[whole], start[whole] + size[string[whole]])]
        part = np.flatnonzero(~whole)
        for a in range(0, len(part), 100_000):
            p = part[a : a + 100_000]
            n = windows[string[p]]
            r = np.repeat(np.arange(len(p)), n)
            k = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            gone = by_window[base[string[p]][r] + k] < doc[p][r]
            r, k = r[gone], k[gone]
            opens = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1] + 1)])[: len(r)])
            closes = np.append(opens[1:], len(r)) - 1
            own = p[r[opens]]
            out.append((doc[own], kind[own], start[own] + k[opens], start[own] + k[closes] + window))
        doc, kind, start, stop = map(np.concatenate, zip(*out))
        if not len(doc):
            return empty
        by = np.lexsort((stop, start, kind, doc))
        doc, kind, start, stop = doc[by], kind[by], start[by].astype(np.int32), stop[by].astype(np.int32)
        other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])])
        new = other | np.concatenate([[True], (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])])  # equal rows give equal spans
        doc, kind, pairs, other = doc[new], kind[new], np.stack([start[new], stop[new]], axis=1), other[new]
        cut = np.flatnonzero(other).tolist() + [len(doc)]
        spans = pa.array([pairs[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())
        return pa.Table.from_arrays([pa.array(doc[cut[:-1]]), pa.array(kind[cut[:-1]]), spans], names=names)

    return run


def _cut(batches):
    only("marks")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    for b in portions(batches):
        rows = [b.column("doc_id").to_pylist(), [], [], [], []]
        for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
            text = text or b""
            kept, gone, n = text, 0, 0
            if spans:
                pairs = np.frombuffer(b"".join(spans), np.int32).reshape(-1, 2)
                step = np.zeros(len(text) + 2, np.int32)
                np.add.at(step, pairs[:, 0] + 1, 1)
                np.add.at(step, pairs[:, 1] + 1, -1)
                inside = np.cumsum(step) > 0
                n = int((inside[1:] & ~inside[:-1]).sum())
                inside = inside[1 : len(text) + 1]
                gone = int(inside.sum())
                kept = np.frombuffer(text, np.uint8)[~inside].tobytes()
            for c, x in zip(rows[1:], (len(text), gone, n, kept)):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema)], schema=schema)


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, t, spans): spans of bytes of ``rows`` (doc_id, t, text) that go, as binary pairs of int32, several to a row; they may overlap."""
    spark = rows.sparkSession
    able = rows.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= window))
    total = able.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))  # a mark and its number for every 15 bytes or so
    marks = able.mapInArrow(partial(_marks, window, SHARD_BYTES, buckets), "bucket long, marks binary, runs binary")
    words = marks.groupBy("bucket").applyInArrow(_counted(HOT_RUNS, FILTER_BITS), "word long, bits long, hot long, runs long").toArrow()
    bits, hot = np.zeros(FILTER_BITS // 64, np.int64), np.zeros(FILTER_BITS // 64, np.int64)
    word = words.column("word").to_numpy()
    np.bitwise_or.at(bits, word, words.column("bits").to_numpy())
    np.bitwise_or.at(hot, word, words.column("hot").to_numpy())
    runs = int(words.column("runs").to_numpy().sum())
    filters = spark.sparkContext.broadcast((bits, hot))
    buckets = max(1, -(-runs * 2 * window // BUCKET_BYTES))
    strings = able.mapInArrow(partial(_strings, window, SHARD_BYTES, RUN_WINDOWS, buckets, filters), _STRINGS)
    return strings.groupBy("bucket").applyInArrow(_merged(window), "doc_id long, t int, spans binary")


def remove_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): ``docs`` (doc_id, text) without the bytes of windows that a document of smaller doc_id holds too.

    Texts are taken as UTF-8 bytes, whole; ``kept`` is binary, as a cut may fall
    within a character; n_spans counts maximal removed runs. Windows are judged on the input.

    A null text is an empty one. Every row is cut by its own text; rows of equal doc_id
    never cut each other, and of equal texts the one with the smallest doc_id stays whole (unless others cover it). Rows with a null doc_id are
    neither cut nor cut others. Other columns are not read; an empty table gives an empty one.
    ``window`` is 24 at least, and even.
    """
    if window < GRAM + 8 or window % 2:
        raise ValueError("window must be even, and 24 at least")
    text = F.col("text").cast("binary")
    rows = docs.select("doc_id", F.hash(text).alias("t"), text.alias("text"))
    spans = materialise(repeated_spans(rows, window).groupBy("doc_id", "t").agg(F.collect_list("spans").alias("spans")), "spans")
    return rows.join(spans, ["doc_id", "t"], "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (
  SELECT doc_id, 1000 * j AS base, substr(hx, 2000 * j + 1, 2098) AS part, length(hx) // 2 AS n
  FROM d, unnest(range(0, length(hx) // 2000 + 1)) u(j)),
p AS (
  SELECT doc_id, base + i AS i, substr(part, 2 * i + 1, 2) AS b, CASE WHEN base + i + 50 <= n THEN md5(substr(part, 2 * i + 1, 100)) END AS w
  FROM c, unnest(range(0, least(1000, n - base))) u(i)),
f AS (SELECT w, min(doc_id) AS first FROM p WHERE w IS NOT NULL GROUP BY w),
g AS (SELECT p.doc_id, i, b, CASE WHEN first < p.doc_id THEN 1 ELSE 0 END AS s FROM p LEFT JOIN f USING (w)),
m AS (SELECT doc_id, i, b, max(s) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
e AS (SELECT *, gone = 1 AND lag(gone, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) = 0 AS opens FROM m),
k AS (
  SELECT doc_id, count(*) AS n_bytes, sum(gone)::BIGINT AS n_removed, count(*) FILTER (opens) AS n_spans,
    string_agg(b, '' ORDER BY i) FILTER (gone = 0) AS kept
  FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
