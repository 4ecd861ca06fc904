"""The lookup mart: records, filters, summaries, comparisons and reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

# The timings and the usage measures of a lookup record.
TIMINGS = ("queue_wait_seconds", "fingerprint_seconds", "cache_lookup_seconds", "epub_extraction_seconds", "provider_seconds", "search_seconds", "validation_seconds", "retrieval_seconds", "review_wait_seconds", "apply_seconds")
COUNTERS = ("input_tokens", "cached_tokens", "output_tokens", "reasoning_tokens", "total_tokens", "web_search_calls", "hosted_web_search_calls", "searxng_search_calls")
COSTS = ("estimated_cost_usd", "estimated_avoided_cost_usd")
OUTCOMES = ("failed", "cancelled", "applied", "skipped", "discarded")
PERIOD_DAYS = {"7": 7, "30": 30, "90": 90}


#: The columns of a lookup record; others of a detail are dropped.
RECORD = ("detail_id", "job_id", "timestamp_epoch", "session_id", "provider", "search_provider", "model", "preset", "cache_hit", "outcome", "batch_size", *TIMINGS, *COUNTERS, *COSTS)


def build_lookup_records(details: DataFrame, payloads: DataFrame, key: str = "job_id") -> DataFrame:
    """One record a detail, with what its payload says, then the payload's context, then defaults.

    Model and preset default to 'unknown', the provider to 'openai', the search
    mode to 'hosted', the batch size to the number of the job's details. A payload's own
    cache_hit overrides the detail's. Columns that no record has are dropped.
    """
    of = lambda c: F.col(c) if c in payloads.columns else F.lit(None)
    from_context = lambda c: of("context")[c] if "context" in payloads.columns and c in payloads.schema["context"].dataType.names else F.lit(None)
    said = {
        "_model": F.coalesce(of("model"), F.lit("unknown")),
        "_provider": F.coalesce(of("provider"), from_context("provider"), F.lit("openai")),
        "_mode": F.coalesce(of("search_mode"), from_context("search_provider"), F.lit("hosted")),
        "_preset": F.coalesce(of("preset"), from_context("preset"), F.lit("unknown")),
        "_size": of("batch_size").cast("long"),
        "_hit": of("cache_hit").cast("boolean"),
    }
    p = payloads.select(key, *[c.alias(k) for k, c in said.items()])
    counts = details.groupBy(key).agg(F.count("*").alias("_n"))
    out = details.join(p, key, "left").join(counts, key, "left")
    hit = F.col("cache_hit") if "cache_hit" in details.columns else F.lit(False)
    made = {
        "model": F.coalesce("_model", F.lit("unknown")),
        "preset": F.coalesce("_preset", F.lit("unknown")),
        "provider": F.coalesce("_provider", F.lit("openai")),
        "search_provider": F.coalesce("_mode", F.lit("hosted")),
        "cache_hit": F.coalesce("_hit", hit, F.lit(False)),
        "batch_size": F.coalesce("_size", "_n", F.lit(1)).cast("long"),
    }
    kept = [c for c in details.columns if c in RECORD and c not in made]
    return out.select(*kept, *[c.alias(k) for k, c in made.items()])


def filter_lookups(df: DataFrame, now: datetime, *, period: str = "all", model: str | None = None, preset: str | None = None, source: str | None = None, outcome: str | None = None, session_id: str | None = None, provider: str | None = None) -> DataFrame:
    """Rows that meet all conditions; a missing time counts as the epoch, a null provider as 'openai'."""
    if period == "session":
        df = df.where(F.col("session_id") == session_id)
    elif period in PERIOD_DAYS:
        df = df.where(F.col("ts") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {PERIOD_DAYS[period]} DAYS"))
    for column, value in (("model", model), ("preset", preset), ("outcome", outcome)):
        if value is not None:
            df = df.where(F.col(column) == value)
    if provider is not None:
        df = df.where(F.lower(F.coalesce("provider", F.lit("openai"))) == provider.lower())
    if source is not None:
        hit = F.coalesce("cache_hit", F.lit(False))
        df = df.where(hit if source == "cache" else ~hit)
    return df


#: Ranges that the values of a percentile are dealt into.
RANGES = 256
_POINTS = {"median_seconds": 0.5, "p90_seconds": 0.9, "p95_seconds": 0.95}


def _good() -> Column:
    return ~F.coalesce("outcome", F.lit("")).isin("failed", "cancelled")


def _range_of(value: Column, cuts: list[float], first: int = 0) -> Column:
    """The number of cuts below a value, by halving."""
    if not cuts:
        return F.lit(first)
    half = len(cuts) // 2
    return F.when(value <= cuts[half], _range_of(value, cuts[:half], first)).otherwise(_range_of(value, cuts[half + 1 :], first + half + 1))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column, points: dict[str, float], *, ranges: int = RANGES) -> DataFrame:
    """(keys..., one column for each point): exact percentiles with linear interpolation; groups without values are left out.

    No group's values meet in one task. An approximate sketch gives cuts that deal
    all values into equal ranges; counts by range tell in which one every wanted
    rank lies; only the values of those ranges are then ranked, a 256th of all rows
    in a task at most, repeated values once. points are shares, 0 to 1.
    """
    values = df.select(*keys, value.cast("double").alias("_v")).where("_v is not null")
    sketch = values.agg(F.percentile_approx("_v", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    placed = values.withColumn("_range", _range_of(F.col("_v"), sorted(set(sketch or ()))))
    sizes = placed.groupBy(*keys, "_range").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)])
    last = F.sum("_c").over(group.orderBy("_range"))
    sizes = sizes.select(*keys, "_range", (last - F.col("_c")).alias("_before"), last.alias("_last"), F.sum("_c").over(group).alias("_n"))
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in points.items()}
    ranks = F.array(*[f(x).cast("long") for x in at.values() for f in (F.floor, F.ceil)])
    wanted = sizes.where(F.exists(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_last")))).drop("_last")
    near = placed.join(wanted, [*keys, "_range"]).groupBy(*keys, "_range", "_v", "_before", "_n").agg(F.count("*").alias("_c"))
    end = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_range").orderBy("_v"))
    ranked = near.withColumn("_end", end)

    def point(x: Column) -> Column:
        holds = lambda r: F.max(F.when((r < F.col("_end")) & (r >= F.col("_end") - F.col("_c")), F.col("_v")))
        low, high, part = holds(F.floor(x)), holds(F.ceil(x)), F.max(x - F.floor(x))
        return low + (high - low) * part

    return ranked.groupBy(*keys).agg(*[point(x).alias(name) for name, x in at.items()])


def measures(df: DataFrame) -> list[Column]:
    """The measures of a summary over the columns that df has, but for the percentiles."""
    count = lambda c: F.count_if(c).cast("long")
    seconds = F.when(_good(), F.col("retrieval_seconds"))
    hit = F.coalesce("cache_hit", F.lit(False))
    records, successes, total = F.count("*"), count(_good()), F.coalesce(F.sum(seconds), F.lit(0.0))
    out = [records.alias("records"), successes.alias("successful"), *[count(F.col("outcome") == o).alias(o) for o in OUTCOMES], count(~hit).alias("live"), count(hit).alias("cache_hits")]
    out += [F.round(x, 4).alias(k) for k, x in (("total_retrieval_seconds", total), ("average_seconds", F.avg(seconds)), ("fastest_seconds", F.min(seconds)), ("slowest_seconds", F.max(seconds)), ("books_per_minute", F.try_divide(F.count(seconds) * 60.0, F.sum(seconds))))]
    out += usage_measures(df)
    if "total_tokens" in df.columns:
        tokens = F.coalesce(F.sum("total_tokens"), F.lit(0))
        out += [F.round(F.try_divide(tokens, records), 4).alias("average_tokens"), F.round(F.try_divide(tokens, successes), 4).alias("tokens_per_success")]
    if "estimated_cost_usd" in df.columns:
        cost = known_total("estimated_cost_usd")
        out += [F.round(F.try_divide(cost, records), 6).alias("average_cost"), F.round(F.try_divide(cost, successes), 6).alias("cost_per_success")]
    return out


def _with_points(summary: DataFrame, df: DataFrame, keys: list[str]) -> DataFrame:
    """A summary by keys with the percentiles of the good rows of df."""
    points = exact_percentiles(df.where(_good()), keys, F.col("retrieval_seconds"), _POINTS)
    return summary.join(points.withColumns({p: F.round(p, 4) for p in _POINTS}), keys, "left")


def known_total(column: str) -> Column:
    """The sum, or null as soon as one value is unknown."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))


def usage_measures(df: DataFrame) -> list[Column]:
    out = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS if c in df.columns]
    if "estimated_cost_usd" in df.columns:
        known = F.count("estimated_cost_usd")
        out += [F.round(known_total("estimated_cost_usd"), 6).alias("estimated_cost_usd"), known.alias("known_cost_records"), (F.count("*") - known).alias("unknown_cost_records")]
    if "estimated_avoided_cost_usd" in df.columns:
        out.append(F.round(F.sum("estimated_avoided_cost_usd"), 6).alias("estimated_avoided_cost_usd"))
    return out


def summarize(df: DataFrame) -> DataFrame:
    """One row of measures; all null-aware, from one partial aggregate and exact percentiles."""
    one = F.lit(0).alias("_all")
    return _with_points(df.agg(*measures(df)).withColumn("_all", one), df.withColumn("_all", one), ["_all"]).drop("_all")


def group_keys() -> dict[str, Column]:
    named = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "unknown").otherwise(F.col(c))
    return {
        "preset": named("preset"),
        "model": named("model"),
        "provider": named("provider"),
        "search_provider": named("search_provider"),
        "outcome": named("outcome"),
        "source": F.when(F.coalesce("cache_hit", F.lit(False)), "Cache hit").otherwise("Live lookup"),
        "date": F.coalesce(F.substring(F.col("ts").cast("string"), 1, 10), F.lit("unknown")),
        "batch_type": F.when(F.coalesce(F.nullif(F.col("batch_size"), F.lit(0)), F.lit(1)) == 1, "Single book").otherwise("Batch"),
    }


def summarize_by(df: DataFrame, key: str) -> DataFrame:
    """The measures by one of the eight keys, as column 'key', in its order."""
    keyed = df.withColumn("key", group_keys()[key])
    return _with_points(keyed.groupBy("key").agg(*measures(df)), keyed, ["key"]).orderBy("key")


def summarize_grouping_sets(df: DataFrame) -> DataFrame:
    """All eight comparisons: (comparison, key, measures...); the rows and their keys are made once and written."""
    keys = group_keys()
    wide = staged(df.withColumns({f"_k_{k}": c for k, c in keys.items()}), "keyed")  # read by the sums, the sketch, the sizes and the ranks
    names = [f"_k_{k}" for k in keys]
    grouped = wide.groupingSets([[F.col(n)] for n in names], *[F.col(n) for n in names]).agg(F.grouping_id().alias("_g"), *measures(df))
    which, key = F.lit(None).cast("string"), F.coalesce(*[F.col(n) for n in names])
    everything = (1 << len(names)) - 1
    for i, k in enumerate(keys):
        which = F.when(F.col("_g") == everything - (1 << (len(names) - 1 - i)), k).otherwise(which)
    summary = grouped.select(which.alias("comparison"), key.alias("key"), *[c for c in grouped.columns if c not in names and c != "_g"])
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("comparison"), F.col(f"_k_{k}").alias("key")) for k in keys]))
    return _with_points(summary, wide.select("outcome", "retrieval_seconds", each.alias("_e")).select("outcome", "retrieval_seconds", "_e.*"), ["comparison", "key"])


def percentile_linear(df: DataFrame, column: str, p: float) -> DataFrame:
    """The p-th percentile (0 to 100) with linear interpolation; nulls are skipped, no values give null."""
    found = exact_percentiles(df, [], F.col(column), {"value": p / 100})
    return found.agg(F.round(F.max("value"), 6).alias("value"))


def timing_breakdown(df: DataFrame) -> DataFrame:
    """(timing, average) over the non-null values of each timing that df has."""
    names = [t for t in TIMINGS if t in df.columns]
    wide = df.agg(*[F.round(F.avg(t), 4).alias(t) for t in names])
    return wide.unpivot([], names, "timing", "average")


def usage_totals(df: DataFrame) -> DataFrame:
    return df.agg(*usage_measures(df))


def combine_jobs(jobs: DataFrame) -> DataFrame:
    """One row over jobs: sums, a cost that is null if any job's is, the single provider or 'multiple'."""
    counters = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in COUNTERS if c in jobs.columns]
    single = lambda c: F.when(F.count_distinct(c) == 1, F.max(c)).otherwise("multiple").alias(c)
    return jobs.agg(*counters, F.round(F.sum("elapsed_seconds"), 4).alias("elapsed_seconds"), F.round(known_total("estimated_cost_usd"), 6).alias("estimated_cost_usd"), single("provider"))


def job_totals(lookups: DataFrame, job: str = "session_id") -> DataFrame:
    """Per job: usage sums, cost (null if unknown), books, completed, cancelled = total less completed."""
    done = F.count_if(F.coalesce("outcome", F.lit("")) != "cancelled").cast("long")
    return lookups.groupBy(job).agg(*usage_measures(lookups), F.count("*").alias("books"), done.alias("completed"), (F.count("*") - done).alias("cancelled"))


def filter_values(df: DataFrame) -> DataFrame:
    """(kind, value): the distinct models, providers (null: openai) and presets."""
    one = lambda kind, c: df.select(F.lit(kind).alias("kind"), c.alias("value")).where("value is not null").distinct()
    return one("model", F.col("model")).union(one("provider", F.coalesce("provider", F.lit("openai")))).union(one("preset", F.col("preset")))


def comparison_table(df: DataFrame, key: str) -> DataFrame:
    """(key, books, median, p90, success_percent, average_tokens, average_cost)."""
    return summarize_by(df, key).select("key", F.col("records").alias("books"), "median_seconds", "p90_seconds", F.round(F.try_divide(F.col("successful") * 100.0, "records"), 4).alias("success_percent"), "average_tokens", "average_cost")


def pending_counts(df: DataFrame, batch: str = "session_id") -> DataFrame:
    """(waiting_books, batches) over rows whose outcome is ready."""
    sizes = df.where("outcome = 'ready'").groupBy(batch).agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("waiting_books"), F.count("*").alias("batches"))


def duration(seconds: Column) -> Column:
    s = F.bround(seconds, 10)
    long = F.format_string("%dm %.1fs", F.floor(s / 60).cast("long"), s % 60)
    return F.when(seconds.isNull(), "—").when(s >= 60, long).otherwise(F.format_string("%.2fs", s))


def money(value: Column) -> Column:
    return F.when(value.isNull(), "—").otherwise(F.format_string("$%.4f", value))


def format_report(comparison: DataFrame) -> DataFrame:
    """The comparison as text: durations, percentages and dollars, '—' where unknown."""
    return comparison.select("key", F.col("books").cast("string").alias("books"), duration(F.col("median_seconds")).alias("median"), duration(F.col("p90_seconds")).alias("p90"), money(F.col("average_cost")).alias("cost"))


def usage_sentence(df: DataFrame) -> Column:
    """The usage of a row as a sentence: a cache hit, the counts, and the cost if it is known or why it is not."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long") if c in df.columns else F.lit(0).cast("long")
    hosted, own, provider = n("hosted_web_search_calls"), n("searxng_search_calls"), F.coalesce("provider", F.lit("openai"))
    # The sentences.
    counts = F.format_string("%d input (%d cached) · %d output (%d reasoning) · %d total · %d web search call(s)", n("input_tokens"), n("cached_tokens"), n("output_tokens"), n("reasoning_tokens"), n("total_tokens"), n("web_search_calls"))
    searches = F.when((hosted != 0) | (own != 0), F.format_string(" · %d hosted / %d SearXNG", hosted, own)).otherwise("")
    local = F.when(provider.isin("ollama", "lmstudio"), " · local inference; no API cost reported")
    unknown = F.format_string(" · estimated cost unavailable for %s model %s", provider, F.col("model"))
    cost = F.when(F.col("estimated_cost_usd").isNotNull(), F.format_string(" · estimated cost $%.4f USD", F.col("estimated_cost_usd"))).otherwise(F.coalesce(local, unknown))
    some = F.coalesce(*[F.col(c).isNotNull() for c in COUNTERS if c in df.columns], F.lit(False)) if any(c in df.columns for c in COUNTERS) else F.lit(False)
    told = F.when(some, F.concat(counts, searches, cost)).otherwise("Token usage unavailable")
    return F.when(F.coalesce("cache_hit", F.lit(False)), "Session cache hit · no new API call or cost").otherwise(told)


EXPORT = ("lookup_id", "book_id", "ts", "session_id", "provider", "search_provider", "model", "preset", "cache_hit", "outcome", "batch_size", *TIMINGS, *COUNTERS, *COSTS)


def export_columns(df: DataFrame) -> DataFrame:
    """The fixed columns of an export in their order; other columns are left out."""
    return df.select(*[c for c in EXPORT if c in df.columns])


def retain(df: DataFrame, cutoff: datetime, most: int, *, time: str = "ts", seq: str = "seq") -> DataFrame:
    """Rows at or after the cutoff, then the last `most` in insertion order; a top-k, not a one-partition window."""
    fresh = df.where(F.col(time) >= F.lit(cutoff).cast("timestamp_ntz"))
    return fresh.orderBy(F.col(seq).desc()).limit(most)


def evict_lru(accesses: DataFrame, key: str, n: int, *, seq: str = "seq") -> DataFrame:
    """The n keys used last, with the place of their last use."""
    return accesses.groupBy(key).agg(F.max(seq).alias("last_used")).orderBy(F.col("last_used").desc(), key).limit(n)
