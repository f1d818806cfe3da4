"""Document quality by a sparse ensemble of rules from trees, as Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, crc_remainder, table

#: At most about this many labelled rows are learned from (chosen by a hash of the id).
LEARNED_ROWS = 12_000

STATISTICS = (
    "chars", "words", "word_chars", "letters", "capitals", "digits", "spaces", "marks", "stops", "shouts", "breaks", "line_words", "distinct_words", "distinct_lines", "bars", "open_ends",
)


def statistics(text: Column) -> list[Column]:
    """The STATISTICS of a whole text (null: empty) as columns: sizes, shares of the characters and of the words."""
    t = F.coalesce(text, F.lit(""))
    chars = F.char_length(t)
    per_char = F.greatest(chars, F.lit(1))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    count = lambda pattern: F.char_length(F.regexp_replace(t, pattern, ""))  # noqa: E731 - what is left
    n_words = F.greatest(F.size(words), F.lit(1))
    n_lines = F.greatest(F.size(lines), F.lit(1))
    letters = count(r"[^\p{L}]+")
    spaces = count(r"\S+")
    stops = count("[^.,;:]+")
    return [
        F.log1p(chars).alias("chars"),
        F.log1p(F.size(words)).alias("words"),
        ((chars - spaces) / n_words).alias("word_chars"),
        (letters / per_char).alias("letters"),
        (count(r"[^\p{Lu}]+") / F.greatest(letters, F.lit(1))).alias("capitals"),
        (count("[^0-9]+") / per_char).alias("digits"),
        (spaces / per_char).alias("spaces"),
        ((count(r"[\p{L}0-9\s]+") - stops) / n_words).alias("marks"),
        (stops / n_words).alias("stops"),
        (count("[^!?]+") / n_words).alias("shouts"),
        (count("[^\n]+") / n_words).alias("breaks"),
        (n_words / n_lines).alias("line_words"),
        (F.size(F.array_distinct(words)) / n_words).alias("distinct_words"),
        (F.size(F.array_distinct(lines)) / n_lines).alias("distinct_lines"),
        (count(r"[^|\\/<>{}=_#$%&*~^]+") / n_words).alias("bars"),
        (F.size(F.filter(lines, lambda x: ~x.rlike(r"[.!?]\s*$"))) / n_lines).alias("open_ends"),
    ]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, is above, bound); a null statistic counts as not above."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for i, above, bound in self.terms:
            out &= (x[:, i] > bound) == above
        return out

    def column(self) -> Column:
        out = None
        for i, above, bound in self.terms:
            is_above = F.col(STATISTICS[i]) > F.lit(float(bound))
            term = is_above if above else ~is_above
            out = term if out is None else out & term
        return out if out is not None else F.lit(True)


@dataclass
class RuleEnsemble:
    intercept: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, w in zip(self.rules, self.weights):
            z += w * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        """Probability of label 1 over the STATISTICS columns."""
        z = F.lit(float(self.intercept))
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(rule.column(), F.lit(float(w))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: list[np.ndarray], depth: int, used: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """One boosted tree over the used statistics: the rules of all its paths, and its step for each row."""
    rules: list[Rule] = []
    step = np.zeros(len(x))

    def split(rows: np.ndarray, terms: tuple, left: int) -> None:
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-3, -1, 0.0)
        if left and len(rows) >= 20:
            for i in used:
                if not len(cuts[i]):
                    continue
                place = np.searchsorted(cuts[i], x[rows, i], side="left")  # how many bounds the value is above
                gs = np.bincount(place, gradient[rows], len(cuts[i]) + 1).cumsum()[:-1]
                hs = np.bincount(place, hessian[rows], len(cuts[i]) + 1).cumsum()[:-1]
                n = np.bincount(place, minlength=len(cuts[i]) + 1).cumsum()[:-1]
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(n < 5) | (len(rows) - n < 5)] = -1
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), int(i), float(cuts[i][j]))
        if terms:
            rules.append(Rule(tuple(sorted(terms))))
        if best[1] < 0:
            step[rows] = g / (h + 1)
            return
        _, i, bound = best
        above = x[rows, i] > bound
        split(rows[~above], (*terms, (i, False, bound)), left - 1)
        split(rows[above], (*terms, (i, True, bound)), left - 1)

    split(np.arange(len(x)), (), depth)
    return rules, step


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient steps; the intercept isn't penalised."""
    n, m = a.shape
    lip = 0.25 * (np.linalg.norm(a, 2) ** 2 / n + 1) + 1e-9
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        w2 = v - (a.T @ r) / n / lip
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - penalty / lip, 0)
        b2 = c - r.mean() / lip
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 0.002, most_rules: int = 160, seed: int = 3) -> RuleEnsemble:
    """Boosted trees on half the statistics each, their paths as rules, lasso weights, rules of weight 0 dropped.

    Labels of one kind only, or none, give a constant (0.5 for none)."""
    if not len(y) or y.min() == y.max():
        return RuleEnsemble(float(np.clip(20 * (y.mean() - 0.5), -5, 5)) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.round(np.quantile(x[:, i], np.linspace(0.02, 0.98, 33)), 9)) for i in range(x.shape[1])]
    z = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[Rule, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        used = rng.choice(x.shape[1], -(-x.shape[1] // 2), replace=False)
        rules, step = grow(x, y - p, p * (1 - p), cuts, depth, used)
        z += 0.3 * step
        found.update(dict.fromkeys(rules))
    held = [(r, r.holds(x)) for r in found]
    distinct: dict[bytes, tuple[Rule, np.ndarray]] = {}
    for r, h in sorted(held, key=lambda q: len(q[0].terms)):
        if 0.002 < h.mean() < 0.998:
            distinct.setdefault(np.packbits(h).tobytes(), (r, h))
    kept = sorted(distinct.values(), key=lambda q: -abs(np.corrcoef(q[1], y)[0, 1]))[:most_rules]
    if not kept:
        return RuleEnsemble(float(z.mean()))
    b, w = lasso(np.stack([h for _, h in kept], axis=1).astype(float), y, penalty)
    some = [(r, v) for (r, _), v in zip(kept, w) if abs(v) > 1e-6]
    return RuleEnsemble(b, [r for r, _ in some], [float(v) for _, v in some])


def learn(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = LEARNED_ROWS) -> RuleEnsemble:
    """An ensemble from the statistics of about `rows` labelled documents at most, those with the smallest hashes.

    labels(doc_id, quality): null labels are left out, and a document with differing labels
    counts as bad. The labels drawn are bounded by `rows`, so they are broadcast and no text
    is shuffled; of rows of one doc_id that with the least statistics teaches."""
    marks = labels.where(F.col("quality").isNotNull() & usable).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    some = marks.where(draw < min(1_000_000, -(-rows * 1_000_000 // max(n, 1))))
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", *statistics(F.col("text")))
    got = found.groupBy("doc_id").agg(F.min(F.struct("quality", *STATISTICS)).alias("row")).select("row.*").toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    return fit(got[list(STATISTICS)].fillna(0).to_numpy(float), got["quality"].to_numpy(float))


def score(docs: DataFrame, model: RuleEnsemble, keep: list[str], name: str = "score") -> DataFrame:
    """docs' columns `keep` with `name`: the probability of quality 1 of each whole text, natively and without a shuffle.

    A null text is scored as an empty one; equal texts get equal scores; an empty table
    gives no rows. Columns of docs named like a statistic don't matter. A very long text is
    taken whole; its task holds it with its words, about 100 bytes each."""
    own = docs.select(*[column(c).alias(f"kept_{c}") for c in keep], *statistics(F.col("text")))
    return own.select(*[column(f"kept_{c}").alias(c) for c in keep], model.column().alias(name))


def op2_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", 3) == 1
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out)
    return score(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
