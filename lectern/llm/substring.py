"""Substring dedup: words that a window of 35 words repeated anywhere covers are removed.

Repeated windows are found level by level, each about twice as long as the last
(9, 18, 35): only places whose window is repeated at one level are extended to
the next, until none is left or the window asked for is reached. The first level
takes the minimisers of its windows: of all that fit a window of 35 words, the one
of least hash. Equal windows hold equal minimisers at equal places, so a
repeated one has a repeated place, and under a tenth of the places are shuffled.
A place is extended to the right and to the left, as one of the two stays inside
any window of 35 that holds it; at the last level all windows that hold a place
left are counted.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_table, materialise, membership, only, only_members, portions, repeated, signed, window_hashes, word_hashes

WINDOW = 35
#: The first level has windows of this many words at most.
SHORTEST = 17
#: Tells windows to the left of a place from those to its right.
_LEFT = np.uint64(0x9E3779B97F4A7C15)


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before, the last ``window``."""
    out = [window]
    while out[0] > SHORTEST:
        out.insert(0, (out[0] + 1) // 2)
    return out


def minimisers(h: np.ndarray, span: int) -> np.ndarray:
    """Positions of ``h`` that are least in some run of ``span`` (all of equal ones)."""
    n = len(h) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)

    def slide(x, op, fill):
        out, size = x, 1
        while size * 2 <= span:
            out = op(out[:-size], out[size:])
            size *= 2
        rest = span - size
        return op(out[: len(out) - rest], out[rest:]) if rest else out

    low = slide(h, np.minimum, None)
    pad = np.zeros(span - 1, h.dtype)
    high = slide(np.concatenate([pad, low, pad]), np.maximum, None)
    return np.flatnonzero(high == h)


def _place_ddl(window: int) -> str:
    return "d long, t int, pos int, h long" + "".join(f", r{n} long, l{n} long" for n in levels(window)[1:-1])


def _places(window: int, batches):
    """The places of the first level, with the hashes of their windows at the levels between."""
    only("words")
    first, *between = levels(window)[:-1] or [window]
    names = ["d", "t", "pos", "h", *(f"{side}{n}" for n in between for side in "rl")]
    for b in portions(batches):
        out = [[] for _ in names]
        for d, t, text in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("text").to_pylist()):
            words = text.split() if text else ()
            if len(words) < window:
                continue
            of_words = word_hashes(words)
            h = window_hashes(of_words, first)
            p = minimisers(h, window - first + 1)
            cols = [np.full(len(p), d, np.int64), np.full(len(p), t, np.int32), p.astype(np.int32), signed(h[p])]
            for n in between:
                long = window_hashes(of_words, n)
                left = p + first - n
                cols.append(pa.array(signed(long[np.minimum(p, len(long) - 1)]), mask=p >= len(long)))
                cols.append(pa.array(signed(long[np.maximum(left, 0)] ^ _LEFT), mask=left < 0))
            for c, x in zip(out, cols):
                c.append(pa.array(x))
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], names=names)


def _windows(window: int, size: int, batches):
    """All windows that hold one of ``size`` words that is left, with their hashes."""
    only("words")
    names = ["d", "t", "pos", "h"]
    for b in portions(batches):
        for d, t, text, left in zip(b.column("d").to_pylist(), b.column("t").to_pylist(), b.column("text").to_pylist(), b.column("left")):
            h = window_hashes(word_hashes(text.split()), window)
            p = left.values.to_numpy(zero_copy_only=False).astype(np.int64)
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, np.maximum(p - (window - size), 0), 1)
            np.add.at(step, np.minimum(p + 1, len(h)), -1)
            at = np.flatnonzero(np.cumsum(step)[:-1] > 0)
            if len(at):
                cols = [pa.array(np.full(len(at), d, np.int64)), pa.array(np.full(len(at), t, np.int32)), pa.array(at.astype(np.int32)), pa.array(signed(h[at]))]
                yield pa.RecordBatch.from_arrays(cols, names=names)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text as binary, and the key (d, t) of a row: rows that repeat a doc_id with another text have another key."""
    text = F.col("text").cast("binary")
    return docs.select("doc_id", text.alias("text"), F.coalesce("doc_id", F.xxhash64(text)).alias("d"), F.hash(text).alias("t"))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, starts): the rows with their keys (d, t), and (d, t, starts) of the repeated windows of each.

    Every row is a document of its own. Rows with a null text, or under ``window`` words, have no window.
    """
    rows = _rows(docs)
    first, *between = levels(window)[:-1] or [window]
    places = materialise(rows.mapInArrow(partial(_places, window), _place_ddl(window)), "places")
    left, size = repeated(places, "h", "level"), first
    for i, n in enumerate(between):
        sides = F.array(F.struct(F.col(f"r{n}").alias("h"), F.col("pos").alias("at")), F.struct(F.col(f"l{n}").alias("h"), (F.col("pos") + (first - n)).alias("at")))
        later = [f"{side}{m}" for m in between[i + 1 :] for side in "rl"]
        longer = left.select("d", "t", "pos", F.explode(sides).alias("s"), *later).select("d", "t", "pos", "s.*", *later)
        longer = materialise(longer.where("h is not null"), "places")
        drop_table(places)
        places, size = longer, n
        left = repeated(places, "h", "level")
        if later:  # a place counts once at the next level, though both sides of it were repeated
            left = left.dropDuplicates(["d", "t", "pos"])
    at = F.col("at") if between else F.col("pos")
    held = materialise(left.groupBy("d", "t").agg(F.collect_set(at).alias("left")), "held")
    drop_table(places)
    some = only_members(rows.select("d", "t", "text"), "d", membership(held, "d")).join(held, ["d", "t"]).select("d", "t", "text", "left")
    windows = materialise(some.mapInArrow(partial(_windows, window, size), "d long, t int, pos int, h long"), "windows")
    drop_table(held)
    starts = materialise(repeated(windows, "h", "level").groupBy("d", "t").agg(F.collect_list("pos").alias("starts")), "starts")
    drop_table(windows)
    return rows, starts


def covered(n: int, starts, window: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    p = np.asarray(starts, np.int64)
    np.add.at(step, p, 1)
    np.add.at(step, p + window, -1)
    return np.cumsum(step)[:-1] > 0


def _cut(window: int, batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])
    for b in portions(batches):
        ids, ns, rs, ks = b.column("doc_id").to_pylist(), [], [], []
        for text, starts in zip(b.column("text").to_pylist(), b.column("starts")):
            words = text.split() if text else []
            gone = 0
            kept = words
            if starts.is_valid:
                cut = covered(len(words), starts.values.to_numpy(zero_copy_only=False), window)
                gone = int(cut.sum())
                kept = [w for w, c in zip(words, cut) if not c]
            ns.append(len(words))
            rs.append(gone)
            ks.append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, ns, rs, ks), schema)], schema=schema)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept is the text that is left, words joined by a space, as binary UTF-8.

    Windows are judged on the input: of a passage found in several places, all
    places go. Empty and null texts keep nothing and have no words. Every row is
    a document of its own: rows that repeat a doc_id, or have none, are cut each
    by its own text, and equal rows of ``window`` words or more are copies of each other.
    Other columns are not read; an empty table gives an empty one.
    """
    rows, starts = repeated_windows(docs, window)
    return rows.join(starts, ["d", "t"], "left").select("doc_id", "text", "starts").mapInArrow(
        partial(_cut, window), "doc_id long, n_words long, n_removed long, kept binary"
    )


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS pos FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, pos, md5(array_to_string(list_slice(ws, pos, pos + 34), ' ')) AS h FROM p),
r AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM w),
m AS (
  SELECT e.doc_id, e.pos, e.word,
    coalesce(max(CASE WHEN r.pos IS NULL THEN 0 ELSE 1 END) OVER (
      PARTITION BY e.doc_id ORDER BY e.pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM e LEFT JOIN r ON r.doc_id = e.doc_id AND r.pos = e.pos),
k AS (
  SELECT doc_id, count(*) AS n_words, sum(gone)::BIGINT AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (WHERE gone = 0), '') AS kept
  FROM m GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""
