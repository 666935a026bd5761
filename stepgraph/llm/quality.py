"""Quality classification by a sparse rule ensemble compiled into Spark columns.

Statistics of a text are Spark expressions.  Boosted shallow trees are grown over them on a bounded sample of
labelled documents; every path from a root to a node is a conjunctive rule; a lasso-penalised logistic model
over the rules keeps a few of them (Friedman and Popescu, 2008).  The rules kept become one Spark expression,
so scoring is a projection.  At most FIT_ROWS labelled documents are used, those of the smallest id hashes.

Defined cases: null text is empty text, and empty texts are scored like any other; documents whose labels
disagree count once for each label; of the rows of one id the one with the least statistics is learned from; with no usable label every score is 0.5, with labels of one kind only
the score is their smoothed share; repeated rows each get their row; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, held_out, internal, lean, table

FIT_ROWS = 12_000
TREES, DEPTH, RATE, LEAST = 40, 3, 0.2, 10
BINS = 48
THRESHOLD = 0.3
SEED = 13


def statistics(text: Column) -> list[tuple[str, Column]]:
    """Steps of (name, expression) to add in order; names that start with an underscore are helpers."""
    whole = F.coalesce(text, F.lit(""))
    size, words = F.col("_size"), F.col("_words")
    share = lambda n, of: F.coalesce(F.try_divide(n.cast("double"), of), F.lit(0.0))
    without = lambda char: share(size - F.length(F.replace(F.col("_text"), F.lit(char), F.lit(""))), size)
    dropped = lambda pattern: share(size - F.length(F.regexp_replace(F.col("_text"), pattern, "")), size)
    lines = F.col("_lines")
    return [
        ("_text", whole),
        ("_size", F.length("_text")),
        ("_words", F.regexp_extract_all(F.col("_text"), F.lit(WORD), F.lit(0))),
        ("_lines", F.split("_text", "\n", -1)),
        ("chars", size.cast("double")),
        ("words", F.size(words).cast("double")),
        ("word_length", share(size, F.size(words))),
        ("distinct_words", share(F.size(F.array_distinct(words)), F.size(words))),
        ("lines", F.size(lines).cast("double")),
        ("distinct_lines", share(F.size(F.array_distinct(lines)), F.size(lines))),
        ("line_length", share(size, F.size(lines))),
        ("upper", dropped(r"\p{Lu}+")),
        ("letters", dropped(r"\p{L}+")),
        ("digits", dropped("[0-9]+")),
        ("symbols", dropped("[#$%&*]+")),
        ("pipes", without("|")),
        ("shouts", without("!")),
        ("stops", without(".")),
        ("commas", without(",")),
        ("breaks", without("\n")),
    ]


def names() -> list[str]:
    return [name for name, _ in statistics(F.lit("")) if not name.startswith("_")]


def with_statistics(docs: DataFrame, text: str, keep: list[str], wanted: list[str] | None = None) -> DataFrame:
    """The columns keep of docs as k0, k1, ... and the statistics, or those wanted."""
    steps = [(name, c) for name, c in statistics(F.col("_raw")) if name[0] == "_" or wanted is None or name in wanted]
    df = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).alias("_raw"))
    for name, column in steps[:4]:
        df = df.withColumn(name, column)
    # A generator, as no filter or projection over the score is pushed below one: each statistic is computed once.
    kept = [f"k{i}" for i in range(len(keep))]
    made = [c.alias(name) for name, c in steps if name[0] != "_"]
    once = F.explode(F.array(F.struct(*made or [F.lit(0).alias("none")]))).alias("s")
    return df.select(*kept, once).select(*kept, "s.*")


@dataclass(frozen=True)
class Rule:
    """A conjunction of tests (statistic, limit, whether above it)."""

    tests: tuple[tuple[int, float, bool], ...]

    def hits(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, limit, above in self.tests:
            out &= (x[:, f] > limit) == above
        return out

    def column(self, stats: list[str]) -> Column:
        out = F.lit(True)
        for f, limit, above in self.tests:
            test = F.col(stats[f]) > F.lit(limit)
            out = out & (test if above else ~test)
        return out


@dataclass
class Model:
    bias: float
    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def used(self, stats: list[str]) -> list[str]:
        """The statistics that some rule tests."""
        return [stats[f] for f in sorted({f for rule in self.rules for f, _, _ in rule.tests})]

    def score(self, stats: list[str]) -> Column:
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def simplified(tests: list[tuple[int, float, bool]]) -> Rule:
    """The same conjunction with one limit for each statistic and side."""
    low: dict[int, float] = {}
    high: dict[int, float] = {}
    for f, limit, above in tests:
        if above:
            low[f] = max(limit, low.get(f, limit))
        else:
            high[f] = min(limit, high.get(f, limit))
    return Rule(tuple(sorted([(f, v, True) for f, v in low.items()] + [(f, v, False) for f, v in high.items()])))


def grow(bins: np.ndarray, limits: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, step: np.ndarray, tests: list, rules: set, depth: int) -> None:
    """One tree on second-order gradients; adds its paths to rules and its leaf values to step."""
    if tests:
        rules.add(simplified(tests))
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None)
    if depth and len(rows) >= 2 * LEAST:
        for f, cuts in enumerate(limits):
            if not len(cuts):
                continue
            n = np.bincount(bins[rows, f], minlength=len(cuts) + 1).cumsum()[:-1]
            gl = np.bincount(bins[rows, f], grad[rows], len(cuts) + 1).cumsum()[:-1]
            hl = np.bincount(bins[rows, f], hess[rows], len(cuts) + 1).cumsum()[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < LEAST) | (len(rows) - n < LEAST)] = 0
            c = int(gain.argmax())
            if gain[c] > best[0]:
                best = (gain[c], (f, c))
    if best[1] is None:
        step[rows] = -g / (h + 1)
        return
    f, c = best[1]
    above = bins[rows, f] > c
    for side in (False, True):
        grow(bins, limits, grad, hess, rows[above == side], step, [*tests, (f, float(limits[f][c]), side)], rules, depth - 1)


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> list[Rule]:
    """The paths of boosted trees, each grown on a random half of the rows."""
    limits = []
    for column in x.T:
        values = np.unique(column)
        cuts = (values[1:] + values[:-1]) / 2
        limits.append(cuts[np.unique(np.linspace(0, len(cuts) - 1, min(BINS, len(cuts))).astype(int))] if len(values) <= BINS else np.unique(np.quantile(column, np.linspace(0.01, 0.99, BINS))))
    bins = np.stack([np.searchsorted(cuts, column, "left") for cuts, column in zip(limits, x.T, strict=True)], axis=1)
    draw = np.random.default_rng(seed)
    total = np.full(len(y), np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        rows = np.sort(draw.permutation(len(y))[: max(2 * LEAST, len(y) // 2)])
        rules: set[Rule] = set()
        step = np.zeros(len(y))
        grow(bins, limits, p - y, p * (1 - p), rows, step, [], rules, DEPTH)
        total = total + RATE * step
        found.update(dict.fromkeys(sorted(rules, key=lambda r: r.tests)))
    return list(found)


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, w: np.ndarray, b: float, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic weights with an absolute penalty by accelerated proximal gradients, the bias unpenalised."""
    n = len(y)
    vector = np.ones(z.shape[1])
    for _ in range(15):  # the largest singular value bounds the step
        vector = z.T @ (z @ vector)
        vector /= np.linalg.norm(vector) or 1.0
    rate = 1 / (0.25 * (np.linalg.norm(z @ vector) ** 2 / n + 1))
    ahead_w, ahead_b, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(z @ ahead_w + ahead_b))) - y
        new = ahead_w - rate * (z.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = ahead_b - rate * r.mean()
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead_w, ahead_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> Model:
    """A sparse rule ensemble; every fifth row chooses the penalty."""
    if not len(y):
        return Model(0.0)
    share = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max() or len(y) < 4 * LEAST:
        return Model(float(np.log(share / (1 - share))))
    rules = tree_rules(x, y, seed)
    z = np.stack([r.hits(x) for r in rules], axis=1).astype("f8")
    scale = np.maximum(z.std(axis=0), 0.05)
    z = z / scale
    check = np.arange(len(y)) % 5 == 0
    start = (np.zeros(z.shape[1]), float(np.log(share / (1 - share))))
    top = np.abs(z[~check].T @ (y[~check] - y[~check].mean())).max() / (~check).sum()
    best, w, b = (np.inf, None), *start
    for penalty in top * np.geomspace(0.5, 0.002, 12):
        w, b = lasso(z[~check], y[~check], penalty, w, b)
        p = np.clip(1 / (1 + np.exp(-(z[check] @ w + b))), 1e-6, 1 - 1e-6)
        loss = -(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-5:
            best = (loss, penalty)
    w, b = start
    for penalty in top * np.geomspace(0.5, 0.002, 12):
        if best[1] is None or penalty >= best[1] * 0.999:
            w, b = lasso(z, y, penalty, w, b, 500 if penalty == best[1] else 300)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return Model(float(b), [rules[i] for i in kept], [float(w[i] / scale[i]) for i in kept])


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", key: str = "doc_id", label: str = "quality") -> Model:
    """A model of labels among the documents outside the held-out fold."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)")
    known = known.filter(~held_out("k")).withColumn("h", F.xxhash64(F.lit(SEED), "k")).distinct()
    n = known.count()
    if n > 1.3 * fit_rows:
        known = known.filter(F.col("h") <= int(1.3 * fit_rows / n * 2**64) - 2**63)
    ours = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(known), "k")  # 1.3 times fit_rows ids
    # One row for each id and label, however often the id repeats.
    rows = with_statistics(ours, "t", ["h", "k", "y"]).groupBy("k0", "k1", "k2").agg(F.min(F.struct(*names())).alias("s"))
    values = F.array(F.col("k2").cast("double"), *[F.col(f"s.{c}") for c in names()])

    def model(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(h, k, v) for frame in frames for h, k, v in zip(*(c.to_pylist() for c in frame.columns), strict=True)]
        matrix = np.array([v for _, _, v in sorted(got)[:fit_rows]], "f8").reshape(-1, 1 + len(names_))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit(matrix[:, 1:], matrix[:, 0]))]})

    names_ = names()
    made = rows.select("k0", F.col("k1").cast("string").alias("k"), values.alias("v")).repartition(1).mapInArrow(lean(model), "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fit(np.zeros((0, 1)), np.zeros(0))


def scored(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The columns keep of docs with score and predicted."""
    keep = keep or []
    stats = with_statistics(docs, text, keep, model.used(names()))
    out = stats.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], model.score(names()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model, keep=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the documents predicted to be bad."""
    model = learn(docs, labels, **options)
    score = internal(docs, "_score")
    stats = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(score), F.col("text"))
    good = scored(stats, model, keep=[score]).filter("predicted = 1")
    return good.select(*[F.col(f"`{score}`.`{c}`").alias(c) for c in docs.columns])
