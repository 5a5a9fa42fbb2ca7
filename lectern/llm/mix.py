"""Mixing sources to target weights: Poisson replication and a global shuffle.

Every document is repeated k times, k drawn by inverting the Poisson
distribution whose mean is its source's target repetition rate, at a uniform
number that a hash of seed and doc_id gives. A large mean is split into equal
ones, each with a number of its own, as sums of Poissons are Poisson. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise

#: Rates above this are the sum of several draws of equal means, so the inversion sums few terms.
MAX_POISSON_MEAN = 16


def hash_uniform(*parts: Column) -> Column:
    """A number in (0, 1) from 48 bits of an MD5 digest of the parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def poisson_inverse(mean: Column, u: Column) -> Column:
    """The least k whose Poisson(mean) distribution function reaches u."""
    steps = F.sequence(F.lit(1), F.lit(MAX_POISSON_MEAN * 4 + 40))
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("cdf"))

    def step(a, i):
        p = a["p"] * mean / i
        return F.when(a["cdf"] >= u, a).otherwise(F.struct(i.alias("k"), p.alias("p"), (a["cdf"] + p).alias("cdf")))

    return F.aggregate(steps, start, step)["k"]


def poisson_count(mean: Column, *parts: Column) -> Column:
    """A Poisson(mean) count, by hashes of the parts: ceil(mean / MAX_POISSON_MEAN) inverted draws of equal means, the first from the parts alone."""
    draws = F.greatest(F.ceil(mean / MAX_POISSON_MEAN), F.lit(1)).cast("int")

    def draw(k, i):
        u = F.when(i == 0, hash_uniform(*parts)).otherwise(hash_uniform(*parts, F.lit("draw"), i))
        return k + poisson_inverse(mean / draws, u)

    return F.aggregate(F.sequence(F.lit(0), draws - 1), F.lit(0), draw)


def target_rates(counts: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5) -> DataFrame:
    """(source, n) -> (source, rate): mean repetitions that turn the corpus into the target mix at its present size.

    ``targets`` gives weights by source (a source not named gets none);
    without it a source weighs n ** temperature. Null is a source of its own.
    """
    if targets is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, w in targets.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    weighed = counts.withColumn("w", weight)
    total = weighed.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w"))
    # totals are one row
    return weighed.crossJoin(F.broadcast(total)).select("source", (F.col("w") / F.col("all_w") * F.col("all_n") / F.col("n")).alias("rate"))


def mix_sources(docs: DataFrame, targets: dict[str, float] | None = None, temperature: float = 0.5, seed: int = 7) -> DataFrame:
    """Rows of ``docs`` repeated to the target mix, in a global random order; plus __copy (from 0), __rate and __order.

    Rates come from counts over all rows. They are a table with a row per source
    that is written and joined: its size is known, so Spark broadcasts a small
    one and shuffles a large one. A null doc_id is hashed as an empty one; rows
    that repeat a doc_id are repeated alike. __order is a hash of seed, doc_id
    and copy, and the result is range-partitioned and sorted by it. A caller's
    columns of these three names are replaced, all others stay as they are,
    whatever their names. An empty table gives an empty one.
    """
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    rates = materialise(target_rates(counts, targets, temperature), "rates").withColumnRenamed("source", "of")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "source", F.col("doc_id").alias("id"), key.alias("key"))
    rated = rows.join(rates, F.col("source").eqNullSafe(F.col("of")))
    counted = rated.withColumn("k", poisson_count(F.coalesce("rate", F.lit(0.0)), F.lit(seed), F.col("key")).cast("int")).where("k > 0")
    copies = counted.select("row", "rate", "id", "key", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("copy"))
    keyed = copies.withColumn("order", F.md5(F.concat_ws(":", F.lit(str(seed)), "key", F.col("copy").cast("string")).cast("binary")))
    mixed = keyed.repartitionByRange("order", "id", "copy").sortWithinPartitions("order", "id", "copy")
    own = {"copy": "__copy", "rate": "__rate", "order": "__order"}
    return mixed.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in own.values()], *[F.col(c).alias(name) for c, name in own.items()])


#: The result of the query as DuckDB SQL.
SQL = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, sqrt(n::DOUBLE) AS w FROM counts),
shares AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS rate FROM weighed),
rates AS (SELECT source, greatest(ceil(rate / 16), 1)::BIGINT AS draws, rate / greatest(ceil(rate / 16), 1) AS mean FROM shares),
terms AS (SELECT source, k, exp(-mean) * pow(mean, k) / gamma(k + 1.0) AS p FROM rates, range(0, 105) t(k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
asked AS (
  SELECT d.doc_id, d.source, unnest(range(r.draws)) AS i FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (
  SELECT doc_id, source, i,
    (('0x' || substr(md5('7:' || doc_id || CASE WHEN i > 0 THEN ':draw:' || i ELSE '' END), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM asked),
times AS (
  SELECT doc_id, source, sum(k)::BIGINT AS k FROM (
    SELECT d.doc_id, d.source, d.i, min(c.k) AS k
    FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c >= d.u
    GROUP BY d.doc_id, d.source, d.i)
  GROUP BY doc_id, source)
SELECT doc_id, source, copy::INTEGER AS copy, md5('7:' || doc_id || ':' || copy) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(k)) AS copy FROM times)
"""
