"""Prices and costs of usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with rate_in, rate_cached and rate_out; null where no price fits.

    The exact lower-cased model counts first, else the longest base such that
    the model is the base, '-' and a digit. Bases are found for the distinct
    (provider, model) pairs only, so the prefix join never sees the usage rows.
    """
    key = [F.coalesce("provider", F.lit("openai")).alias("_p"), F.lower(F.coalesce("model", F.lit(""))).alias("_m")]
    distinct = usage.select(*key).distinct()
    p = prices.select(F.col("provider").alias("_p"), "base", F.struct("rate_in", "rate_cached", "rate_out").alias("rates"))
    fits = (F.col("_m") == F.col("base")) | (F.startswith("_m", F.concat("base", F.lit("-"))) & F.expr("substr(_m, length(base) + 2, 1) rlike '[0-9]'"))
    rank = F.when(F.col("_m") == F.col("base"), 1_000_000).otherwise(F.length("base"))
    found = distinct.join(p, "_p").where(fits).groupBy("_p", "_m").agg(F.max_by("rates", rank).alias("rates"))
    out = usage.withColumns({"_p": key[0], "_m": key[1]}).join(found, ["_p", "_m"], "left")
    return out.select(*[F.col(c) for c in usage.columns], "rates.*")


# Dollars for one hosted search.
SEARCH_PRICE = {"openai": 0.01, "anthropic": 0.01}


def estimate_cost(priced: DataFrame) -> DataFrame:
    """priced with estimated_cost_usd; null where the rate or the usage is unknown.

    Cached tokens are at least 0 and never exceed the input charged; hosted
    searches count where has_hosted, else all calls.
    """
    c = lambda name: F.col(name) if name in priced.columns else F.lit(0)
    zero = lambda x: F.greatest(F.coalesce(x, F.lit(0)), F.lit(0))
    cached = zero(c("cached_tokens"))
    total = F.greatest(cached, F.coalesce(c("input_tokens"), F.lit(0)))
    has_hosted = F.coalesce(c("has_hosted"), F.lit(True)) if "has_hosted" in priced.columns else F.lit(True)
    searches = zero(F.when(has_hosted, c("hosted_calls")).otherwise(c("search_calls")))
    fee: Column = F.lit(0.0)
    for provider, price in SEARCH_PRICE.items():
        fee = F.when(F.coalesce("provider", F.lit("openai")) == provider, price).otherwise(fee)
    cost = ((total - cached) * F.col("rate_in") + cached * F.col("rate_cached") + zero(c("output_tokens")) * F.col("rate_out")) / 1e6 + searches * fee
    return priced.withColumn("estimated_cost_usd", F.when(F.col("rate_in").isNotNull(), cost))
