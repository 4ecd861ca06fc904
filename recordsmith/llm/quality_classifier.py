"""Quality classifier: a sparse ensemble of rules from trees, compiled into Spark columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textstats import add_statistics, ratios

#: The classifier is fitted on at most so many labelled rows, chosen by a hash of doc_id.
SAMPLE = 20_000
THRESHOLD = 0.3

#: (feature, is greater, limit)
Condition = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """score = 1 / (1 + exp(-(bias + sum of the weights of the rules that hold)))"""

    bias: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def score(self) -> Column:
        """The score over the columns of ratios(), as one column expression."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, greater, limit in conditions:
                holds = holds & ((F.col(name) > limit) if greater else (F.col(name) <= limit))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, names: list[str], conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, greater, limit in conditions:
        column = x[:, names.index(name)]
        out &= (column > limit) if greater else (column <= limit)
    return out


def _grow(x: np.ndarray, residual: np.ndarray, names: list[str], cuts: list[np.ndarray], rows: np.ndarray, depth: int, path: tuple[Condition, ...], least: int, out: list[tuple[tuple[Condition, ...], float]]) -> None:
    """Grow a regression tree on the residuals; every node below the root gives a path."""
    if path:
        out.append((path, float(residual[rows].mean())))
    if depth == 0 or len(rows) < 2 * least:
        return
    best, total, n = (0.0, -1, 0.0), residual[rows].sum(), len(rows)
    for j in range(len(names)):
        bins = np.searchsorted(cuts[j], x[rows, j], side="left")
        counts, sums = np.bincount(bins, minlength=len(cuts[j]) + 1).cumsum(), np.bincount(bins, residual[rows], minlength=len(cuts[j]) + 1).cumsum()
        left, left_sum = counts[:-1], sums[:-1]
        ok = (left >= least) & (n - left >= least)
        if ok.any():
            gain = np.where(ok, left_sum**2 / np.maximum(left, 1) + (total - left_sum) ** 2 / np.maximum(n - left, 1), -np.inf)
            k = int(gain.argmax())
            if gain[k] - total**2 / n > best[0] + 1e-9:
                best = (gain[k] - total**2 / n, j, float(cuts[j][k]))
    _, j, limit = best
    if j < 0:
        return
    low = x[rows, j] <= limit
    _grow(x, residual, names, cuts, rows[low], depth - 1, (*path, (names[j], False, limit)), least, out)
    _grow(x, residual, names, cuts, rows[~low], depth - 1, (*path, (names[j], True, limit)), least, out)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """L1-penalised logistic regression by accelerated proximal gradient; the bias is free."""
    n, m = z.shape
    z = z.astype(np.float32)
    step = 4.0 / (np.linalg.norm(z, 2) ** 2 / n + 1.0)
    p = y.mean().clip(0.01, 0.99)
    b, w = float(np.log(p / (1 - p))), np.zeros(m, np.float32)
    vb, vw, t = b, w, 1.0
    for _ in range(steps):
        error = (1 / (1 + np.exp(-(z @ vw + vb))) - y) / n
        nb = vb - step * float(error.sum())
        nw = vw - step * (z.T @ error)
        nw = (np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)).astype(np.float32)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vb, vw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return b, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5, penalty: float = 1e-3, seed: int = 5) -> RuleModel:
    """Boosted small trees give paths; a lasso picks and weighs the paths.

    Without rows the score is 0.5; with one class only it is that class's share.
    """
    if len(y) == 0:
        return RuleModel(0.0, ())
    y = y.astype(float)
    p = float(np.clip(y.mean(), 0.01, 0.99))
    if y.min() == y.max():
        return RuleModel(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65))[:-1]) for j in range(x.shape[1])]
    margin, found = np.full(len(y), np.log(p / (1 - p))), {}
    for _ in range(trees):
        residual = y - 1 / (1 + np.exp(-margin))
        rows = np.sort(rng.choice(len(y), max(1, len(y) // 2), replace=False))
        paths: list[tuple[tuple[Condition, ...], float]] = []
        _grow(x, residual, names, cuts, rows, depth, (), least, paths)
        inner = {q[:-1] for q, _ in paths}
        for path, value in paths:
            if path not in found:
                found[path] = _holds(x, names, path)
            if path not in inner:  # leaves move the margin
                margin += rate * 4 * value * found[path]
    if not found:
        return RuleModel(float(np.log(p / (1 - p))), ())
    paths = list(found)
    z = np.stack([found[q] for q in paths], axis=1)
    _, first = np.unique(z, axis=1, return_index=True)
    keep = np.sort(first)
    bias, weights = _lasso(z[:, keep], y, penalty)
    return RuleModel(bias, tuple((paths[k], float(w)) for k, w in zip(keep, weights, strict=True) if abs(w) > 1e-3))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the ids that no classifier learns from; false for null."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> RuleModel:
    """Fit on at most `sample` labelled documents outside the held-out fifth.

    The sample is the rows with the smallest hash of doc_id, so its bound does
    not grow with the input; its ids are broadcast and its statistics are the
    only rows that reach the driver. Labels with null id or quality are left out;
    repeated labels of one id count once (the smallest).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("_rs_doc")).agg(F.min("quality").alias("_rs_y"))
    chosen = known.orderBy(F.xxhash64("_rs_doc"), "_rs_doc").limit(sample)
    joined = docs.select(F.col("doc_id").cast("long").alias("_rs_doc"), F.col("text")).join(F.broadcast(chosen), "_rs_doc")
    names = list(ratios())
    rows = add_statistics(joined).select("_rs_doc", "_rs_y", *[c.alias(k) for k, c in ratios().items()]).distinct().orderBy(F.xxhash64("_rs_doc"), "_rs_doc").limit(2 * sample).collect()
    x = np.array([[r[k] for k in names] for r in rows], float).reshape(-1, len(names))
    return fit_rules(x, np.array([int(r["_rs_y"] > 0) for r in rows]), names)


def score(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """docs with the score in a column `name`; one pass, no shuffle, no Python on the executors.

    Null texts count as empty and get a score; every row and column is kept, whatever its name.
    """
    names = {f"_rs_{k}": c for k, c in ratios().items()}
    renamed = RuleModel(model.bias, tuple((tuple((f"_rs_{n}", g, v) for n, g, v in q), w) for q, w in model.rules))
    keep = [c for c in docs.columns]
    narrow = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_rs_row"), F.col("text").alias("_rs_text"))
    # The row number keeps a filter on the score from being pushed below, where every rule would repeat the statistics.
    wide = add_statistics(narrow, "_rs_text").select("_rs_row", *[c.alias(k) for k, c in names.items()], F.monotonically_increasing_id().alias("_rs_number"))
    done = wide.select("_rs_row", F.when(F.col("_rs_number") >= 0, renamed.score()).alias("score"))
    return done.select("_rs_row.*", F.col("score").alias(name))


def classify(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each input row.

    Labels, language, source and id are no inputs of the score; only the
    text's statistics are. Null texts count as empty and get a score too.
    """
    model = fit(docs, labels, sample=sample)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
