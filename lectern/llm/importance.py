"""Target-distribution importance resampling over hashed n-grams.

An untrained Regex Split of the tokenizers library, over text of which A-Z alone
is lower-cased, gives words with their offsets. Pairs of offsets delimit runs of one
to three words; the CRC of a run, its words joined by a space, goes on from the CRC
of the run without its last word, and names its bucket. A document is read once:
its buckets are written, a table as large as the texts or so, and the histogram
and the sums of gains come from there. Documents are drawn without replacement by the largest of weight
plus Gumbel noise.
"""

from __future__ import annotations

import math
import re
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import drop_table, materialise, only, portions
from lectern.operators.upsert import numbered

#: Words of ASCII-lowered text: digits, a-z and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: A longer text is taken apart in pieces of about this size, cut where no word is.
PIECE_BYTES = 1 << 18
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def splitter():
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    return Split(Regex(WORD), "removed", invert=True)


def _pieces(text: bytes):
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + PIECE_BYTES, len(text)))
        to = gap.start() if gap else len(text)
        yield text[at:to].decode("utf-8", "replace")
        at = to


def run_buckets(split, text: bytes, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """(number of words, the bucket of every run of 1 to ``longest`` words); the runs' order is not kept."""
    n, before, out = 0, [], []
    for piece in _pieces(text.lower()):
        new = [b" " + piece[start:end].encode() for _, (start, end) in split.pre_tokenize_str(piece)]
        words, old = before + new, len(before)
        crcs = list(map(crc32, (w[1:] for w in words)))
        for size in range(1, longest + 1):
            if size > 1:
                crcs = list(map(crc32, words[size - 1 :], crcs))
            out.append(np.array(crcs[max(old - size + 1, 0) :], np.uint32) % np.uint32(buckets))  # the rest was in the last piece
        n += len(new)
        before = words[len(words) - longest + 1 :] if len(words) >= longest else words
    return n, np.concatenate(out) if out else np.zeros(0, np.uint32)


def _runs(buckets: int, batches):
    only("runs")
    split = splitter()
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())])
    for b in portions(batches):
        cols = [b.column("doc_id").to_pylist(), [], [], []]
        for text in b.column("text"):
            n, found = run_buckets(split, text.as_py() or b"", buckets)
            for c, x in zip(cols[1:], (n, len(found), np.sort(found.astype(_kind(buckets))).tobytes())):
                c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def features(rows: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): sorted little-endian bucket numbers, of two bytes each (four, if there are over 65,536 buckets)."""
    keyed = rows.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return keyed.mapInArrow(partial(_runs, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def _numbers(blob, buckets: int) -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), _kind(buckets))


def _histogram(buckets: int, batches):
    total = np.zeros(buckets, np.int64)
    for b in portions(batches, column="buckets"):
        for blob in b.column("buckets"):
            found = _numbers(blob, buckets)
            if len(found) > buckets:
                total += np.bincount(found, minlength=buckets)
            else:
                np.add.at(total, found, 1)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def histogram(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket. A task sends a row for each bucket at most, and so does the sum."""
    rows = found.select("buckets").mapInArrow(partial(_histogram, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's smoothed share over the source's) of each bucket."""
    k, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weights(buckets: int, gain, batches):
    table = gain.value
    for b in portions(batches, column="buckets"):
        sums = [int(table[_numbers(x, buckets)].sum()) for x in b.column("buckets")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), b.column("n_features"), pa.array(sums, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``docs`` (doc_id, text) weighed towards the distribution of ``target`` (text).

    weight is the sum of gains over a document's features, score adds Gumbel noise hashed from
    ``seed`` and doc_id; of the documents with ``min_words`` words, ``percent`` in a hundred (rounded
    down) are drawn by highest score, ties to the smaller doc_id, and numbered from 1; for the rest rank is null.

    A null or empty text has no features and weight 0. Every row is a document of
    its own, repeated rows draw and are drawn each; a row with a null doc_id is weighed, but has no
    score and takes no part in the draw. A text of any length is read whole, in pieces. Other columns are not read.
    Empty ``docs`` give an empty table; with an empty ``target`` its shares are even.
    """
    spark = docs.sparkSession
    found = materialise(features(docs, "doc_id", buckets), "runs")
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), "text")
    gain = gains(histogram(found, buckets), histogram(features(wanted, "doc_id", buckets), buckets))
    gain = spark.sparkContext.broadcast(gain)  # a long for each bucket
    weighed = found.mapInArrow(partial(_weights, buckets, gain), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = materialise(weighed.withColumn("score", F.col("weight") + noise), "weights")
    drop_table(found)
    enters = (F.col("n_words") >= min_words) & F.col("score").isNotNull()
    n = weighed.where(enters).count()
    order = numbered(weighed.withColumn("__enters", enters), F.struct(~F.col("__enters"), -F.col("score"), "doc_id", "n_words"))
    return order.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("__enters") & (F.col("n") <= percent * n // 100), F.col("n").cast("long")).alias("rank"))


#: CRC-32 in SQL: the table of a byte's remainders, then a fold over the bytes.
CRC_SQL = r"""
RECURSIVE bits AS (
  SELECT i::BIGINT AS i, i::BIGINT AS c, 0 AS step FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, step + 1 FROM bits WHERE step < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE step = 8)"""


def crc_sql(hexed: str) -> str:
    """The unsigned crc32 of the bytes that a hexadecimal text spells; ``t`` of crc must be in scope."""
    byte = f"[('0x' || substr({hexed}, 2 * i - 1, 2))::BIGINT FOR i IN range(1, length({hexed}) // 2 + 1)]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


SQL = (
    "WITH "
    + CRC_SQL.strip()
    + r""",
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
w AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
runs AS (
  SELECT side, id, ws[i] AS f FROM w, unnest(range(1, len(ws) + 1)) u(i)
  UNION ALL SELECT side, id, ws[i] || ' ' || ws[i + 1] FROM w, unnest(range(1, len(ws))) u(i)
  UNION ALL SELECT side, id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM w, unnest(range(1, len(ws) - 1)) u(i)),
kinds AS (SELECT f, hex(encode(f)) AS hx FROM runs GROUP BY f),
named AS (SELECT f, """
    + crc_sql("hx")
    + r""" % 10000 AS bucket FROM kinds, crc),
held AS (SELECT side, id, bucket, count(*) AS n FROM runs JOIN named USING (f) GROUP BY ALL),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 1), 0)::DOUBLE AS t FROM held GROUP BY bucket),
totals AS (SELECT sum(s) AS ss, sum(t) AS tt FROM sums),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000))))::BIGINT AS g FROM sums, totals),
weight AS (SELECT id, sum(n) AS n_features, sum(n * g) AS weight FROM held JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (
  SELECT w.id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || w.id)[1:8])::BIGINT + 0.5) / 4294967296))))::BIGINT AS score
  FROM w LEFT JOIN weight USING (id) WHERE side = 0),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_words::BIGINT AS n_words, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END::BIGINT AS rank
FROM scored LEFT JOIN ranked USING (doc_id)
"""
)
