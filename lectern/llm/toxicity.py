"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words are read as symbols (a term of the lexicon, a threat, a target, a negation,
a verb of saying, ...). Five transducers rewrite the symbols of a sentence one
after the other, and are composed to one machine beforehand:

* insult: a term of the lexicon is an insult, with the term's weight;
* threat: a verb of violence is a threat, heavier after a modal verb;
* negation: what follows within three words of a clause counts half;
* target: a clause that addresses somebody raises its insults; a threat without
  a target is none. The target may come last, so the machine guesses and the
  wrong guess is no accepted path;
* reported speech: what follows a verb of saying counts less to the end of the
  sentence, across commas, colons and quotation marks.

Arcs carry factors, which multiply under composition; a path weighs the sum of its
words' weights times their factors, and the best accepted path counts. The lexicon,
whole words and stems, is learned with its weights from labelled texts; the weights
of a document's matched sentences give its score by a logistic curve fitted on the same texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import Memo, only, portions, text_rows
from lectern.llm.langid import held_out

#: Labelled rows learned from, at most, of each label: those of least hash.
TRAIN_ROWS = 8_000
#: Of a lexicon entry: the least share of toxic texts that hold it (so the sample bounds their number), and the least log odds.
LEAST_SHARE, LEAST_ODDS = 0.005, 3.0
STEM_LENGTHS = (4, 5, 6)
#: Least share of a term's toxic texts (up to 40) in which it has neighbours of its own.
LEAST_VARIED = 0.5
#: A term's weight never exceeds this.
MAX_WEIGHT = 6.0

#: Closed-class words of English, German, French and Spanish.
TARGETS = "you your yours he she they him her them du dich dir ihr euch sie er tu toi te vous il elle ils elles usted ustedes ellos ellas él ella".split()
NEGATIONS = "not no never none nobody isn't aren't don't doesn't nicht kein keine niemals nie ne pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say told tells wrote writes claimed claims called quoted sagte sagt schrieb dit disait écrit a-dit dijo dice escribió".split()
MODALS = "will shall gonna going werde werden wirst vais vas va voy vamos".split()
THREATS = "kill hurt destroy beat burn shoot stab töten schlagen verletzen tuer frapper détruire matar golpear destruir".split()

#: Factors of a threat after a modal verb, of what is negated, addressed and reported; words a negation reaches.
MODAL, NEGATED, ADDRESSED, REPORTED, NEGATION_WORDS = 1.5, 0.5, 1.25, 0.75, 3
#: Weight of a threat.
THREAT_WEIGHT = 1.0

_WORD = r"[^\W_]+(?:['’-][^\W_]+)*"
_words = re.compile(_WORD).findall
_tokens = re.compile(_WORD + "|[,:]").findall
_sentences = re.compile(r"[.!?;\n|]+").split


def terms_of(word: str) -> list[str]:
    """What a word may match: itself, and its stems ``abcd*``."""
    return [word, *(word[:n] + "*" for n in STEM_LENGTHS if len(word) > n)]


SYMBOLS = ("term", "insult", "threat", "target", "not", "said", "modal", ",", "other")


class Transducer:
    """``arcs[state, symbol]`` lists (next state, symbol written, factor); several starts and arcs for a symbol are guesses."""

    def __init__(self, starts, finals, arcs: dict):
        self.starts, self.finals, self.arcs = tuple(starts), frozenset(finals), arcs

    def then(self, after: "Transducer") -> "Transducer":
        """The composition: ``after`` reads what this one writes. States are pairs, of which only those reached are built."""
        starts = [(p, q) for p in self.starts for q in after.starts]
        arcs, todo, seen = {}, list(starts), set(starts)
        while todo:
            p, q = at = todo.pop()
            for symbol in SYMBOLS:
                out = [
                    ((p2, q2), written2, factor * factor2)
                    for p2, written, factor in self.arcs.get((p, symbol), ())
                    for q2, written2, factor2 in after.arcs.get((q, written), ())
                ]
                if out:
                    arcs[at, symbol] = out
                todo += [to for to, _, _ in out if not (to in seen or seen.add(to))]
        return Transducer(starts, [s for s in seen if s[0] in self.finals and s[1] in after.finals], arcs)

    def numbered(self) -> "Transducer":
        """The same machine with numbers for states."""
        states = {s: n for n, s in enumerate(dict.fromkeys([*self.starts, *(s for s, _ in self.arcs), *(a[0] for out in self.arcs.values() for a in out)]))}
        arcs = {(states[s], symbol): [(states[to], written, factor) for to, written, factor in out] for (s, symbol), out in self.arcs.items()}
        return Transducer([states[s] for s in self.starts], [states[s] for s in self.finals], arcs)

    def best(self, read: list[list[tuple[str, float]]]) -> float:
        """The weight of the best accepted path; each word is a choice of symbols with weights."""
        now = dict.fromkeys(self.starts, 0.0)
        for choices in read:
            reached: dict = {}
            for state, value in now.items():
                for symbol, weight in choices:
                    for to, _, factor in self.arcs.get((state, symbol), ()):
                        x = value + factor * weight
                        if x > reached.get(to, -1.0):
                            reached[to] = x
            now = reached
        return max((v for s, v in now.items() if s in self.finals), default=0.0)


def _machine(states, finals, special: dict, starts=None) -> Transducer:
    """Arcs of ``special``, and else one that stays in its state and writes what it reads."""
    arcs = {(s, x): [(s, x, 1.0)] for s in states for x in SYMBOLS} | special
    return Transducer(starts or states[:1], finals, {k: v for k, v in arcs.items() if v})


def transducers() -> list[Transducer]:
    """Insult, threat, negation, target, reported speech."""
    hits = ("insult", "threat")
    insult = _machine([0], [0], {(0, "term"): [(0, "insult", 1.0)]})
    threat = {("plain", "modal"): [("modal", "modal", 1.0)], ("modal", "threat"): [("plain", "threat", MODAL)], ("modal", ","): [("plain", ",", 1.0)]}
    left = range(NEGATION_WORDS + 1)  # words that a negation still reaches
    negation = {(n, x): [(max(n - 1, 0), x, NEGATED if n and x in hits else 1.0)] for n in left for x in SYMBOLS}
    negation |= {(n, "not"): [(NEGATION_WORDS, "not", 1.0)] for n in left} | {(n, ","): [(0, ",", 1.0)] for n in left}
    target = {(s, ","): [("nobody", ",", 1.0), ("awaited", ",", 1.0)] for s in ("nobody", "named")} | {("awaited", ","): [], ("awaited", "target"): [("named", "target", 1.0)]}
    target |= {(s, "insult"): [(s, "insult", ADDRESSED)] for s in ("awaited", "named")} | {("nobody", "threat"): [("nobody", "other", 0.0)]}
    reported = {("direct", "said"): [("reported", "said", 1.0)]} | {("reported", x): [("reported", x, REPORTED)] for x in hits}
    return [
        insult,
        _machine(["plain", "modal"], ["plain", "modal"], threat),
        _machine(list(left), list(left), negation),
        _machine(["nobody", "awaited", "named"], ["nobody", "named"], target, ["nobody", "awaited"]),
        _machine(["direct", "reported"], ["direct", "reported"], reported),
    ]


class Grammar:
    """Symbols of words, and the composed transducers."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        roles = [("target", TARGETS), ("not", NEGATIONS), ("said", REPORTS), ("modal", MODALS), ("threat", THREATS)]
        self.roles = {w: role for role, ws in roles for w in ws} | {",": ",", ":": ","}
        first, *rest = transducers()
        for t in rest:
            first = first.then(t)
        self.machine = first.numbered()
        self.memo = Memo(self.symbols, 200_000)

    def symbols(self, word: str) -> tuple[bool, list[tuple[str, float]]]:
        """Whether a word may be weighed, and what it may be read as, with its weight."""
        role = self.roles.get(word, "other")
        weight = max((self.lexicon[t] for t in terms_of(word) if t in self.lexicon), default=0.0)
        read = [(role, THREAT_WEIGHT if role == "threat" else 0.0)] + ([("term", weight)] if weight > 0 else [])
        return role == "threat" or weight > 0, read

    def sentence(self, text: str) -> float:
        """The weight of a lower-cased sentence."""
        read = list(map(self.memo.__getitem__, _tokens(text)))
        return self.machine.best([x for _, x in read]) if any(hit for hit, _ in read) else 0.0

    def matched(self, text: str) -> list[float]:
        """Weights of the sentences that match."""
        return [x for x in map(self.sentence, _sentences(text.lower())) if x > 0]

    def features(self, text: str) -> tuple[float, float]:
        """Total weight, and the strongest sentence, both damped."""
        found = self.matched(text)
        return (math.log1p(sum(found)), math.log1p(max(found))) if found else (0.0, 0.0)


def _term_counts(batches):
    """(term, pos, neg, around): texts of each label that hold a term, and a 64-bit map of the neighbours it has in toxic ones."""
    for b in portions(batches):
        pos, neg, around = Counter(), Counter(), {}
        for toxic, text in zip(b.column("toxic").to_pylist(), b.column("text").to_pylist()):
            words = _words((text or b"").decode("utf-8", "replace").lower())
            (pos if toxic else neg).update({t for w in set(words) for t in terms_of(w)})
            if toxic:
                for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                    bit = 1 << xxhash.xxh32_intdigest(f"{before} {after}") % 64
                    for t in terms_of(w):
                        around[t] = around.get(t, 0) | bit
        terms = list({*pos, *neg})
        bits = np.array([around.get(t, 0) for t in terms], np.uint64).view(np.int64)
        cols = [terms, [pos[t] for t in terms], [neg[t] for t in terms], bits]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["term", "pos", "neg", "around"])


def _features(lexicon: dict[str, float], batches):
    grammar = Grammar(lexicon)
    only("grammar")
    for b in portions(batches):
        found = [grammar.features((t or b"").decode("utf-8", "replace")) for t in b.column("text").to_pylist()]
        cols = [pa.array([f[i] for f in found], pa.float64()) for i in (0, 1)]
        keep = [c for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *cols], names=[*keep, "total", "strongest"])


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Weights and intercept by Newton's method with a small ridge."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, may_learn: Column) -> tuple[dict[str, float], list[float]]:
    """(lexicon, curve) from at most TRAIN_ROWS texts of each label (those of least hash of doc_id).

    Null labels are none; rows that repeat a label count once; a doc_id labelled
    both ways counts as toxic. Without labels of both kinds the lexicon is empty
    and the curve is flat at the share of toxic labels, or 0.1 without any.
    """
    spark = docs.sparkSession
    able = labels.where(may_learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = []
    for y in (0, 1):
        rows += able.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).select("doc_id", "toxic").collect()
    n_pos, n_neg = sum(r.toxic for r in rows), sum(1 - r.toxic for r in rows)
    if not n_pos or not n_neg:
        share = min(max(n_pos / len(rows), 0.01), 0.99) if rows else 0.1
        return {}, [0.0, 0.0, math.log(share / (1 - share))]
    chosen = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, toxic int")  # 2 * TRAIN_ROWS at most
    sample = text_rows(docs).join(F.broadcast(chosen), "doc_id")
    least = max(3, int(LEAST_SHARE * n_pos))
    found = sample.mapInArrow(_term_counts, "term string, pos long, neg long, around long").groupBy("term")
    counts = found.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.expr("bit_count(bit_or(around))").alias("places"))
    odds = F.log(((F.col("pos") + 0.5) / (n_pos + 1)) / ((F.col("neg") + 0.5) / (n_neg + 1)))
    # a word of copied texts stands between the same words everywhere; an insult does not
    varied = F.col("places") >= LEAST_VARIED * F.least(F.col("pos"), F.lit(40))
    terms = counts.where((F.col("pos") >= least) & varied).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS)
    lexicon = {r.term: min(r.odds, MAX_WEIGHT) for r in terms.select("term", "odds").collect()}
    seen = sample.mapInArrow(partial(_features, lexicon), "doc_id long, toxic int, total double, strongest double").toPandas()
    w = fit_logistic(seen[["total", "strongest"]].to_numpy(), seen["toxic"].to_numpy(float))
    # each label's sample may be cut, so the intercept is moved to the labels' own shares
    n = able.agg(F.sum("toxic"), F.count("*")).first()
    w[-1] += math.log(n[0] / (n[1] - n[0])) - math.log(n_pos / n_neg)
    return lexicon, w.tolist()


def score(docs: DataFrame, lexicon: dict[str, float], curve: list[float]) -> DataFrame:
    """(doc_id, score) of each row from its whole text alone; null and empty texts score as texts without a match.

    Rows are scored each by itself, so rows that repeat a doc_id, or have none,
    are as any other; other columns are not read; an empty table gives an empty one.
    """
    found = text_rows(docs).mapInArrow(partial(_features, lexicon), "doc_id long, total double, strongest double")
    z = F.col("total") * curve[0] + F.col("strongest") * curve[1] + curve[2]
    return found.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"))


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = held_out(F.col("doc_id"), 3, 1)
    found = score(docs, *learn(docs, labels, ~out))
    return found.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).cast("int").alias("predicted"))
