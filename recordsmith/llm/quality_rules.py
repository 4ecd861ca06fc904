"""Quality rules as weak supervision, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .textstats import add_statistics, ratios


def rules() -> dict[str, tuple[Column, Column]]:
    """Name: (votes good, votes bad) over the columns of ratios(); neither means abstain.

    Good votes ask for more than the absence of a fault; between the two limits a rule abstains.
    """
    f = F.col
    return {
        "length": (f("n_words") >= 50, f("n_words") < 20),
        "word_length": (f("word_length").between(3.0, 9.0), (f("word_length") < 2.0) | (f("word_length") > 14.0)),
        "symbols": (f("symbols") < 0.02, f("symbols") > 0.10),
        "symbol_chars": (f("symbol_chars") < 0.005, f("symbol_chars") > 0.03),
        "dup_lines": (f("dup_lines") < 0.10, f("dup_lines") > 0.30),
        "repeats": (f("repeats") < 0.10, f("repeats") > 0.25),
        "distinct": (f("distinct") > 0.30, f("distinct") < 0.10),
        "upper": (f("upper") < 0.15, f("upper") > 0.50),
        "marks": (f("marks") < 0.10, f("marks") > 0.50),
    }


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains."""
    return {f"v_{k}": F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0)).cast("byte") for k, (good, bad) in rules().items()}


def posterior(names: list[str], prior: float, rates: list[tuple[float, float]]) -> Column:
    """Probability of good quality given the votes; abstentions carry no evidence.

    rates holds for each rule how often it votes right: on good texts, on bad texts.
    """
    logit = F.lit(math.log(prior / (1 - prior)))
    for name, (on_good, on_bad) in zip(names, rates, strict=True):
        logit = logit + F.when(F.col(name) == 1, math.log(on_good / (1 - on_bad))).when(F.col(name) == -1, math.log((1 - on_good) / on_bad)).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


#: Limits of the estimates: the prior, and how often a rule votes right on good and on bad texts.
PRIORS, ON_GOOD, ON_BAD = (0.5, 0.99), (0.6, 0.999), (0.05, 0.999)


def estimate(patterns: DataFrame, names: list[str], rounds: int = 12, *, prior: float = 0.8, start: tuple[float, float] = (0.99, 0.3)) -> tuple[float, list[tuple[float, float]]]:
    """Prior and rule accuracies by expectation-maximisation over counted vote patterns.

    patterns has one row for each combination of votes that occurs (at most 3 to
    the number of rules, however many documents there are) and its count n, so the
    rounds need no jobs once it is read. A rule has one accuracy on good
    texts and one on bad texts, because a fault shows in few rules at a time: a
    bad vote says more than a good one. Their sum stays over 1, so no rule is
    worse than chance, which also fixes which class is the good one. Pseudo-counts
    of the start values keep a small table from extremes, and the limits above keep
    logarithms finite and the good class the larger one, where all votes agree.
    """
    counted = [(r["n"], [r[name] for name in names]) for r in patterns.collect()]
    rates, weight, total = [start] * len(names), 20.0, sum(n for n, _ in counted)
    for _ in range(rounds if total else 0):
        good = 0.0
        right, voted = [[0.0, 0.0] for _ in names], [[0.0, 0.0] for _ in names]
        for n, pattern in counted:
            logit = math.log(prior / (1 - prior))
            for vote, (on_good, on_bad) in zip(pattern, rates, strict=True):
                if vote:
                    logit += math.log(on_good / (1 - on_bad)) if vote == 1 else math.log((1 - on_good) / on_bad)
            p = 1.0 / (1.0 + math.exp(-logit))
            good += n * p
            for j, vote in enumerate(pattern):
                if vote:
                    right[j][vote == -1] += n * (p if vote == 1 else 1 - p)
                    voted[j][0] += n * p
                    voted[j][1] += n * (1 - p)
        prior = min(PRIORS[1], max(PRIORS[0], good / total))
        rates = []
        for j in range(len(names)):
            g, b = ((right[j][k] + weight * start[k]) / (voted[j][k] + weight) for k in (0, 1))
            g, b = min(ON_GOOD[1], max(ON_GOOD[0], g)), min(ON_BAD[1], max(ON_BAD[0], b))
            rates.append((g, max(b, 1.02 - g)))
    return prior, rates


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least: float = 0.5) -> DataFrame:
    """One row for each input row: the statistics, base_failed, the posterior and kept.

    A text is kept when it passes the base (50 words or more, at most half of
    them in repeated 3-word windows) and its posterior probability of good
    quality is at least `least`. Texts are read once: the statistics are written
    to the shared folder, from which the vote patterns are counted. Null texts
    are empty and fail the base; null or repeated ids keep their rows; an empty
    table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    voted = add_statistics(rows).drop("text").withColumns(ratios()).withColumns(votes())
    names = list(votes())
    kept_columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *names]
    done = materialize(voted.select(*kept_columns), "quality")
    prior, rates = estimate(done.groupBy(*names).agg(F.count("*").alias("n")), names)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return done.withColumns({"base_failed": failed, "quality": posterior(names, prior, rates)}).withColumn("kept", ~failed & (F.col("quality") >= least)).drop(*names)
