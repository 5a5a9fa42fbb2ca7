"""Quality rules with thresholds that adapt to language and source.

Rule statistics are taken of every text. Their distribution in each (lang,
source) group is held by mergeable KLL quantile sketches (built in parts,
combined before the shuffle). A fence lies at a reach from its group's median, and
both are drawn towards those of all rows, the more the smaller the group is. The reach is some times the
distance of a tail quantile; or, for a measure that most rows do not have at all, half
way into the last gap of the upper quantiles that is wide beside what lies below it.
A group of which the sketch tells no reach takes that of all rows; if they tell none either, the rule rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise, only, portions, text_rows, window_hashes, word_hashes

#: A gap between neighbouring quantiles is wide if it is this many times the distance of the lower one from the median.
WIDE = 6.0
#: Quantiles that are searched for gaps.
LADDER = [0.5 + i / 200 for i in range(101)]
SKETCH_K = 400
#: A group of this many rows has as much weight in its quantiles as all rows have.
PRIOR_ROWS = 50
#: The symbols counted.
SYMBOLS = b"#*$%&|<>"

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The columns of STATS; lines are those that have a word."""
    text = text or b""
    words = text.split()
    if not words:
        symbols = sum(text.count(bytes([s])) for s in SYMBOLS)
        return 0, 0, symbols, 0, 0, 0
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(n.sum() - n[0x80:0xC0].sum() - n[9:14].sum() - n[32])
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    h = window_hashes(word_hashes(words), 5)
    again = 0
    if len(h) > 1:
        _, at, times = np.unique(h, return_inverse=True, return_counts=True)
        if times.max() > 1:
            step = np.zeros(len(words) + 1, np.int64)
            p = np.flatnonzero(times[at] > 1)
            np.add.at(step, p, 1)
            np.add.at(step, p + 5, -1)
            again = int((np.cumsum(step)[:-1] > 0).sum())
    return len(words), chars, int(n[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), again, len(lines)


def _stats(batches):
    only("words")
    for b in portions(batches):
        cols = list(zip(*map(text_stats, b.column("text").to_pylist()))) or [[]] * 6
        names = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in names), *(pa.array(c, pa.int64()) for c in cols)],
            names=[*names, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        )


@dataclass(frozen=True)
class Rule:
    """A measure, the quantile whose distance from the median counts, and how many times; without a tail the reach goes into the last wide gap."""

    name: str
    measure: Column
    tail: float | None = None
    times: float = 1.0
    low: bool = False


def rules() -> list[Rule]:
    """The tail of a rule lies further in the more of a corpus's rows it usually rejects."""
    words, lines = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "n_lines"))
    return [
        Rule("word_length", F.col("word_chars") / words, 0.8, 6.0, low=True),
        Rule("symbol_share", F.col("n_symbols") / words),
        Rule("dup_line_share", F.col("n_dup_lines") / lines, 0.99, 2.0),
        Rule("repeat_share", F.col("n_repeat_words") / words, 0.99, 2.0),
    ]


def _reaches(r: Rule, sketch: str) -> tuple[Column, Column, Column]:
    """Median, reach up and reach down by a sketch; a reach is null if the sketch tells none."""
    at = lambda q: F.kll_sketch_get_quantile_double(sketch, F.lit(q))
    if r.tail is not None:
        up, down = at(r.tail) - at(0.5), at(0.5) - at(1 - r.tail)
        return at(0.5), F.when(up > 0, r.times * up), F.when(down > 0, r.times * down) if r.low else F.lit(None).cast("double")
    q = F.array(*[at(x) for x in LADDER])
    steps = F.zip_with(F.slice(q, 1, len(LADDER) - 1), F.slice(q, 2, len(LADDER) - 1), lambda below, above: F.struct((above - below).alias("gap"), (below - q[0]).alias("off")))
    half = F.transform(F.filter(steps, lambda s: (s["gap"] > 0) & (s["gap"] >= WIDE * s["off"])), lambda s: s["off"] + s["gap"] / 2)
    return at(0.5), F.when(F.size(half) > 0, F.try_element_at(half, F.lit(-1))), F.lit(None).cast("double")


def fences(passed: DataFrame, rs: list[Rule]) -> DataFrame:
    """(lang, source, lo_*, hi_*) of each group of ``passed`` (lang, source, m_*); a fence that no sketch tells is null."""
    sketches = [F.kll_sketch_agg_double(f"m_{r.name}", SKETCH_K).alias(f"k_{r.name}") for r in rs]
    groups = materialise(passed.groupBy("lang", "source").agg(F.count("*").alias("n"), *sketches), "sketches")
    told = lambda df, prefix, keys: df.select(*keys, *[c.alias(f"{prefix}{part}_{r.name}") for r in rs for part, c in zip(("mid", "up", "down"), _reaches(r, f"k_{r.name}"))])
    every = told(groups.agg(*[F.kll_merge_agg_double(f"k_{r.name}").alias(f"k_{r.name}") for r in rs]), "all_", [])
    out = told(groups, "", ["lang", "source", "n"]).crossJoin(F.broadcast(every))  # one row
    own = F.col("n") / (F.col("n") + F.lit(PRIOR_ROWS))
    ends = []
    for r in rs:
        mid, up, down = (own * F.coalesce(f"{c}_{r.name}", f"all_{c}_{r.name}") + (1 - own) * F.coalesce(f"all_{c}_{r.name}", f"{c}_{r.name}") for c in ("mid", "up", "down"))
        ends += [(mid - down).alias(f"lo_{r.name}"), (mid + up).alias(f"hi_{r.name}")]
    return out.select("lang", "source", *ends)


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed and kept of each row of ``docs`` (doc_id, text, lang, source).

    base_failed: under 10 words, or more than 20 of 100 words in repeated
    windows. Others are kept unless a measure passes its group's fence. Null
    lang or source is a group of its own; a null or empty text fails the base.
    Rows are judged each by its own whole text, however long, so rows that
    repeat a doc_id, or have none, are as any other; other columns are not read;
    an empty table gives an empty one.
    """
    stats = materialise(
        text_rows(docs, "lang", "source").mapInArrow(_stats, f"doc_id long, lang string, source string, {STATS}"), "stats"
    )
    rs = rules()
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = stats.withColumn("base_failed", base)
    passed = judged.where(~F.col("base_failed")).select("lang", "source", *[r.measure.alias(f"m_{r.name}") for r in rs])
    limits = fences(passed, rs).withColumnsRenamed({"lang": "__lang", "source": "__source"})
    joined = judged.join(limits, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    ok = F.lit(True)
    for r in rs:
        ok = ok & F.coalesce(r.measure <= F.col(f"hi_{r.name}"), F.lit(True)) & F.coalesce(r.measure >= F.col(f"lo_{r.name}"), F.lit(True))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ok).alias("kept")
    )
