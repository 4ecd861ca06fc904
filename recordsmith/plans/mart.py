"""Queries over the lookup mart: P1, P2, P4-P6, P14-P17, J1, J2, J8, J10, J12, A*, W1, W3, W10, W12, U1, U2, F14, F15, F17, F18, S11."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import catalog, enrich, journal, metrics, pricing, review
from ..sources import tables
from ..sources.staging import shared_folder
from .registry import add

NOW = datetime(2024, 1, 31)
TS = "TIMESTAMP '2024-01-31 00:00:00'"


def priced(v):
    return pricing.estimate_cost(pricing.price_usage(v.lookups, v.prices))


_PRICED = """WITH mm AS (SELECT DISTINCT coalesce(provider, 'openai') AS p, lower(model) AS m FROM lookups),
best AS (SELECT p, m, arg_max(rate_in, rk) AS rate_in, arg_max(rate_cached, rk) AS rate_cached, arg_max(rate_out, rk) AS rate_out FROM (
  SELECT mm.p, mm.m, x.rate_in, x.rate_cached, x.rate_out, CASE WHEN mm.m = x.base THEN 1000000 ELSE length(x.base) END AS rk
  FROM mm JOIN prices x ON x.provider = mm.p AND (mm.m = x.base OR (starts_with(mm.m, concat(x.base, '-')) AND regexp_matches(substr(mm.m, length(x.base) + 2, 1), '[0-9]')))) GROUP BY p, m),
priced AS (SELECT l.*, rate_in, rate_cached, rate_out, CASE WHEN rate_in IS NOT NULL THEN ((greatest(cached_tokens, input_tokens) - cached_tokens) * rate_in + cached_tokens * rate_cached + output_tokens * rate_out) / 1e6
  + hosted_calls * CASE WHEN coalesce(provider, 'openai') IN ('openai', 'anthropic') THEN 0.01 ELSE 0.0 END END AS estimated_cost_usd
  FROM lookups l LEFT JOIN best ON best.p = coalesce(l.provider, 'openai') AND best.m = lower(l.model)) """

_GOOD = "coalesce(outcome, '') NOT IN ('failed', 'cancelled')"
_SEC = f"CASE WHEN {_GOOD} THEN retrieval_seconds END"
_USAGE = """CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cached_tokens), 0) AS BIGINT) AS cached_tokens, CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
 round(CASE WHEN count(estimated_cost_usd) = count(*) THEN sum(estimated_cost_usd) END, 6) AS estimated_cost_usd, count(estimated_cost_usd) AS known_cost_records, count(*) - count(estimated_cost_usd) AS unknown_cost_records"""
_M = f"""count(*) AS records, count(*) FILTER (WHERE {_GOOD}) AS successful, {", ".join(f"count(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in metrics.OUTCOMES)},
 count(*) FILTER (WHERE NOT coalesce(cache_hit, false)) AS live, count(*) FILTER (WHERE coalesce(cache_hit, false)) AS cache_hits,
 round(coalesce(sum({_SEC}), 0), 4) AS total_retrieval_seconds, round(avg({_SEC}), 4) AS average_seconds, round(quantile_cont({_SEC}, 0.5), 4) AS median_seconds, round(min({_SEC}), 4) AS fastest_seconds, round(max({_SEC}), 4) AS slowest_seconds,
 round(quantile_cont({_SEC}, 0.9), 4) AS p90_seconds, round(quantile_cont({_SEC}, 0.95), 4) AS p95_seconds, round(count({_SEC}) * 60.0 / nullif(sum({_SEC}), 0), 4) AS books_per_minute, {_USAGE},
 round(sum(total_tokens) / nullif(count(*), 0), 4) AS average_tokens, round(sum(total_tokens) / nullif(count(*) FILTER (WHERE {_GOOD}), 0), 4) AS tokens_per_success,
 round(CASE WHEN count(estimated_cost_usd) = count(*) THEN sum(estimated_cost_usd) END / nullif(count(*), 0), 6) AS average_cost, round(CASE WHEN count(estimated_cost_usd) = count(*) THEN sum(estimated_cost_usd) END / nullif(count(*) FILTER (WHERE {_GOOD}), 0), 6) AS cost_per_success"""
_KEYS = {
    "preset": "coalesce(nullif(preset, ''), 'unknown')",
    "model": "coalesce(nullif(model, ''), 'unknown')",
    "provider": "coalesce(nullif(provider, ''), 'unknown')",
    "search_provider": "coalesce(nullif(search_provider, ''), 'unknown')",
    "outcome": "coalesce(nullif(outcome, ''), 'unknown')",
    "source": "CASE WHEN coalesce(cache_hit, false) THEN 'Cache hit' ELSE 'Live lookup' END",
    "date": "coalesce(substr(CAST(ts AS VARCHAR), 1, 10), 'unknown')",
    "batch_type": "CASE WHEN coalesce(nullif(batch_size, 0), 1) = 1 THEN 'Single book' ELSE 'Batch' END",
}

add("a1_summarize", lambda v: metrics.summarize(priced(v)), f"{_PRICED} SELECT {_M} FROM priced")
for _k, _e in _KEYS.items():
    add(f"a2_by_{_k}", lambda v, k=_k: metrics.summarize_by(metrics.filter_lookups(priced(v), NOW, period="90"), k), f"{_PRICED} SELECT {_e} AS key, {_M} FROM priced WHERE ts >= {TS} - INTERVAL 90 DAY GROUP BY 1")
add(
    "a3_grouping_sets",
    lambda v: metrics.summarize_grouping_sets(priced(v)),
    _PRICED + " UNION ALL ".join(f"SELECT '{k}' AS comparison, {e} AS key, {_M} FROM priced GROUP BY {e}" for k, e in _KEYS.items()),
)
add(
    "a4_percentile_linear",
    lambda v: metrics.percentile_linear(v.lookups, "retrieval_seconds", 90),
    "SELECT round(quantile_cont(retrieval_seconds, 0.9), 6) AS value FROM lookups",
)
add(
    "a5_timing_breakdown",
    lambda v: metrics.timing_breakdown(v.lookups),
    """SELECT 'retrieval_seconds' AS timing, round(avg(retrieval_seconds), 4) AS average FROM lookups UNION ALL SELECT 'provider_seconds',
    round(avg(provider_seconds), 4) FROM lookups""",
)
add("a6_usage_totals", lambda v: metrics.usage_totals(priced(v)), f"{_PRICED} SELECT {_USAGE} FROM priced")
_JOBS = """jobs AS (SELECT session_id, min(coalesce(provider, 'openai')) AS provider, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens,
    sum(retrieval_seconds) AS elapsed_seconds, CASE WHEN count(estimated_cost_usd) = count(*) THEN sum(estimated_cost_usd) END AS estimated_cost_usd
    FROM priced WHERE provider = 'openai' OR model LIKE 'claude%' GROUP BY session_id)"""


def _jobs(v):
    some = priced(v).where("provider = 'openai' OR model LIKE 'claude%'")
    return some.groupBy("session_id").agg(F.min(F.coalesce("provider", F.lit("openai"))).alias("provider"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("retrieval_seconds").alias("elapsed_seconds"), metrics.known_total("estimated_cost_usd").alias("estimated_cost_usd"))


add(
    "a7_combine_jobs",
    lambda v: metrics.combine_jobs(_jobs(v)),
    f"""{_PRICED.rstrip()}, {_JOBS} SELECT CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
    round(sum(elapsed_seconds), 4) AS elapsed_seconds, round(CASE WHEN count(estimated_cost_usd) = count(*) THEN sum(estimated_cost_usd) END, 6)
    AS estimated_cost_usd, CASE WHEN count(DISTINCT provider) = 1 THEN max(provider) ELSE 'multiple' END AS provider FROM jobs""",
)
add(
    "a8_job_totals",
    lambda v: metrics.job_totals(priced(v)),
    f"""{_PRICED} SELECT session_id, {_USAGE}, count(*) AS books, count(*) FILTER (WHERE coalesce(outcome, '') <> 'cancelled') AS completed, count(*) FILTER
    (WHERE coalesce(outcome, '') = 'cancelled') AS cancelled FROM priced GROUP BY session_id""",
)
_BATCH = """jobs AS (SELECT o_custkey AS job_id, count(*) AS batch_size, (o_custkey % 7 = 0) AS preflight_failed, count(*) FILTER (WHERE o_orderstatus = 'P') +
    o_custkey % 3 AS cancelled_count FROM orders GROUP BY o_custkey), results_ AS (SELECT o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'failed'
    WHEN 'P' THEN 'cancelled' ELSE 'ready' END AS outcome, round(o_totalprice / 1e6, 6) AS cost FROM orders)"""


def _accounted(v):
    o = v.orders
    jobs = o.groupBy(F.col("o_custkey").alias("job_id")).agg(F.count("*").alias("batch_size"), F.count_if(F.col("o_orderstatus") == "P").alias("p")).select("job_id", "batch_size", (F.col("job_id") % 7 == 0).alias("preflight_failed"), (F.col("p") + F.col("job_id") % 3).alias("cancelled_count"))
    results = o.select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "cancelled").otherwise("ready").alias("outcome"), F.round(F.col("o_totalprice") / 1e6, 6).alias("cost"))
    return journal.batch_accounting(jobs, results)


_ACCOUNTED = f"""WITH {_BATCH}, accounted AS (SELECT r.job_id, r.outcome, r.cost FROM results_ r JOIN jobs j ON j.job_id = r.job_id WHERE NOT j.preflight_failed
 UNION ALL SELECT job_id, outcome, 0.0 FROM (SELECT j.job_id, CASE WHEN preflight_failed THEN 'failed' ELSE 'cancelled' END AS outcome, unnest(range(CASE WHEN preflight_failed THEN batch_size ELSE greatest(0, cancelled_count - coalesce(c.n, 0)) END)) AS i
 FROM jobs j LEFT JOIN (SELECT job_id, count(*) AS n FROM results_ WHERE outcome = 'cancelled' GROUP BY 1) c ON c.job_id = j.job_id)) """
add(
    "a9_batch_accounting",
    lambda v: _accounted(v).groupBy("job_id", "outcome").agg(F.count("*").alias("books"), F.round(F.sum("cost"), 6).alias("cost")),
    f"{_ACCOUNTED} SELECT job_id, outcome, count(*) AS books, round(sum(cost), 6) AS cost FROM accounted GROUP BY 1, 2",
)
add(
    "a9_job_outcomes",
    lambda v: journal.job_outcomes(_accounted(v)),
    f"""{_ACCOUNTED} SELECT job_id, count(*) AS books, CASE WHEN bool_or(outcome = 'failed') THEN 'failed' WHEN bool_or(outcome = 'cancelled') THEN
    'cancelled' ELSE 'success' END AS outcome FROM accounted GROUP BY 1""",
)
add(
    "a11_pending_counts",
    lambda v: metrics.pending_counts(v.lookups),
    """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS waiting_books, count(*) AS batches FROM (SELECT session_id, count(*) AS n FROM lookups WHERE outcome =
    'ready' GROUP BY 1)""",
)
add(
    "a12_filter_values",
    lambda v: metrics.filter_values(v.lookups),
    """SELECT DISTINCT 'model' AS kind, model AS value FROM lookups UNION ALL SELECT DISTINCT 'provider', coalesce(provider, 'openai') FROM lookups UNION ALL
    SELECT DISTINCT 'preset', preset FROM lookups""",
)
_COMPARE = f"""SELECT {_KEYS['preset']} AS key, count(*) AS books, round(quantile_cont({_SEC}, 0.5), 4) AS median_seconds, round(quantile_cont({_SEC}, 0.9), 4)
    AS p90_seconds, round(count(*) FILTER (WHERE {_GOOD}) * 100.0 / count(*), 4) AS success_percent, round(sum(total_tokens) / count(*), 4)
    AS average_tokens, round(CASE WHEN count(estimated_cost_usd) = count(*) THEN sum(estimated_cost_usd) END / count(*), 6) AS average_cost FROM priced
    GROUP BY 1"""
add("a13_comparison_table", lambda v: metrics.comparison_table(priced(v), "preset"), _PRICED + _COMPARE)
def _shown(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '—' WHEN {c} >= 60 THEN concat(CAST(CAST(floor({c} / 60) AS BIGINT) AS VARCHAR), 'm ', CAST(CAST(round({c} % 60, 1) AS DECIMAL(9,1)) AS VARCHAR), 's') ELSE concat(CAST(CAST(round({c}, 2) AS DECIMAL(9,2)) AS VARCHAR), 's') END"


add(
    "f18_format_report",
    lambda v: metrics.format_report(metrics.comparison_table(priced(v), "preset")),
    f"""{_PRICED.rstrip()}, c AS ({_COMPARE}), d AS (SELECT *, CAST(median_seconds AS DECIMAL(18,4)) AS m, CAST(p90_seconds AS DECIMAL(18,4)) AS p FROM c)
    SELECT key, CAST(books AS VARCHAR) AS books, {_shown('m')} AS median, {_shown('p')} AS p90, CASE WHEN average_cost IS NULL THEN '—' ELSE
    printf('$%.4f', average_cost) END AS cost FROM d""",
)
_SENTENCE = """CASE WHEN coalesce(cache_hit, false) THEN 'Session cache hit · no new API call or cost' ELSE concat(CAST(input_tokens AS VARCHAR), ' input (', CAST(cached_tokens AS VARCHAR), ' cached) · ', CAST(output_tokens AS VARCHAR), ' output (0 reasoning) · ', CAST(total_tokens AS VARCHAR), ' total · 0 web search call(s)',
 CASE WHEN hosted_calls > 0 THEN concat(' · ', CAST(hosted_calls AS VARCHAR), ' hosted / 0 SearXNG') ELSE '' END, CASE WHEN estimated_cost_usd IS NOT NULL THEN printf(' · estimated cost $%.4f USD', estimated_cost_usd) WHEN coalesce(provider, 'openai') IN ('ollama', 'lmstudio') THEN ' · local inference; no API cost reported' ELSE concat(' · estimated cost unavailable for ', coalesce(provider, 'openai'), ' model ', model) END) END"""


def _sentences(v):
    rows = priced(v).withColumn("hosted_web_search_calls", F.col("hosted_calls")).withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 3))
    return rows.select("lookup_id", metrics.usage_sentence(rows).alias("usage"))


add(
    "f18_usage_sentences",
    _sentences,
    f"{_PRICED.rstrip()}, r AS (SELECT * REPLACE (round(estimated_cost_usd, 3) AS estimated_cost_usd) FROM priced) SELECT lookup_id, {_SENTENCE} AS usage FROM r",
)
add(
    "j2_price_usage",
    lambda v: pricing.price_usage(v.lookups, v.prices).select("lookup_id", "rate_in", "rate_cached", "rate_out"),
    f"{_PRICED} SELECT lookup_id, rate_in, rate_cached, rate_out FROM priced",
)
add(
    "f17_estimate_cost",
    lambda v: priced(v).select("lookup_id", F.round("estimated_cost_usd", 8).alias("estimated_cost_usd")),
    f"{_PRICED} SELECT lookup_id, round(estimated_cost_usd, 8) AS estimated_cost_usd FROM priced",
)

for _name, _kw, _sql in (
    ("p2_period_7", {"period": "7"}, f"ts >= {TS} - INTERVAL 7 DAY"),
    ("p2_period_30", {"period": "30"}, f"ts >= {TS} - INTERVAL 30 DAY"),
    ("p2_period_90", {"period": "90"}, f"ts >= {TS} - INTERVAL 90 DAY"),
    ("p2_preset", {"preset": "balanced"}, "preset = 'balanced'"),
    ("p2_outcome", {"outcome": "applied"}, "outcome = 'applied'"),
    ("p2_cache", {"source": "cache"}, "coalesce(cache_hit, false)"),
    ("p2_model", {"model": "gpt-5.6-luna"}, "model = 'gpt-5.6-luna'"),
    ("p2_provider", {"provider": "OpenAI"}, "lower(coalesce(provider, 'openai')) = 'openai'"),
    ("p2_live", {"source": "live"}, "NOT coalesce(cache_hit, false)"),
    ("p2_session", {"period": "session", "session_id": "s1"}, "session_id = 's1'"),
    ("p2_combined", {"period": "30", "preset": "balanced", "source": "cache", "outcome": "applied", "provider": "openai"}, f"ts >= {TS} - INTERVAL 30 DAY AND preset = 'balanced' AND cache_hit AND outcome = 'applied' AND lower(coalesce(provider, 'openai')) = 'openai'"),
):
    add(_name, lambda v, kw=_kw: metrics.filter_lookups(v.lookups, NOW, **kw).select("lookup_id", "model", "outcome"), f"SELECT lookup_id, model, outcome FROM lookups WHERE {_sql}")


def _records(v):
    """Orders as details of their customers' jobs; payloads say some things, their contexts others, and some nothing."""
    k = F.col("c_custkey")
    details = v.orders.select(F.col("o_orderkey").alias("detail_id"), F.col("o_custkey").alias("job_id"), (F.col("o_orderkey") % 3 == 0).alias("cache_hit"), F.col("o_totalprice").alias("provider_seconds"), F.lit("x").alias("unlisted"))
    context = F.struct(F.when(k % 4 == 0, "anthropic").alias("provider"), F.when(k % 6 == 0, "searxng").alias("search_provider"), F.when(k % 5 == 0, "thorough").alias("preset"))
    payloads = v.customer.select(k.alias("job_id"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("model"), F.when(k % 8 == 0, "ollama").alias("provider"), F.lit(None).cast("string").alias("search_mode"), F.when(k % 2 == 0, F.col("c_nationkey")).alias("batch_size"), F.when(k % 3 == 0, "economy").alias("preset"), F.when(k % 7 == 0, k % 2 == 0).alias("cache_hit"), context.alias("context"))
    return metrics.build_lookup_records(details, payloads)


add(
    "p1_build_lookup_records",
    _records,
    """SELECT o_orderkey AS detail_id, o_custkey AS job_id, o_totalprice AS provider_seconds, coalesce(CASE WHEN c_custkey % 5 > 0 THEN c_mktsegment END, 'unknown') AS model,
    CASE WHEN c_custkey % 3 = 0 THEN 'economy' WHEN c_custkey % 5 = 0 THEN 'thorough' ELSE 'unknown' END AS preset, CASE WHEN c_custkey % 8 = 0 THEN 'ollama' WHEN c_custkey % 4 = 0 THEN 'anthropic' ELSE 'openai' END AS provider,
    CASE WHEN c_custkey % 6 = 0 THEN 'searxng' ELSE 'hosted' END AS search_provider, CASE WHEN c_custkey % 7 = 0 THEN c_custkey % 2 = 0 ELSE o_orderkey % 3 = 0 END AS cache_hit,
    CAST(coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END, count(*) OVER (PARTITION BY o_custkey)) AS BIGINT) AS batch_size FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
add(
    "p4_sanitize_model_ids",
    lambda v: v.lookups.select("lookup_id", catalog.safe_model_id(F.col("model")).alias("model")),
    """SELECT lookup_id, CASE WHEN starts_with(model, 'sk-') OR NOT regexp_full_match(model, '[A-Za-z0-9][A-Za-z0-9._:/-]{0,127}') THEN
    '[REDACTED_INVALID_MODEL]' ELSE model END AS model FROM lookups""",
)


def _catalog(v):
    ids = v.events.select((F.col("event_id") % 40).alias("i"), (F.col("event_id") % 7).alias("m")).distinct()
    names = F.concat(F.when(F.col("m") < 3, "gpt-").when(F.col("m") == 3, "claude-opus-").when(F.col("m") == 4, "claude-sonnet-").when(F.col("m") == 5, "claude-haiku-").otherwise("other-"), (F.col("i") % 9).cast("string"), F.when(F.col("m") == 1, "-audio").when(F.col("m") == 2, "-2026-08-01").when(F.col("m") > 2, F.concat(F.lit("-"), (F.col("i") % 8).cast("string"))).otherwise(""))
    return ids.select(F.when(F.col("m").between(3, 5), "anthropic").otherwise("openai").alias("provider"), names.alias("model")).distinct()


_CATALOG = """catalog_ AS (SELECT DISTINCT CASE WHEN m BETWEEN 3 AND 5 THEN 'anthropic' ELSE 'openai' END AS provider, concat(CASE WHEN m < 3 THEN 'gpt-' WHEN m = 3
    THEN 'claude-opus-' WHEN m = 4 THEN 'claude-sonnet-' WHEN m = 5 THEN 'claude-haiku-' ELSE 'other-' END, CAST(i % 9 AS VARCHAR), CASE WHEN m = 1 THEN
    '-audio' WHEN m = 2 THEN '-2026-08-01' WHEN m > 2 THEN concat('-', CAST(i % 8 AS VARCHAR)) ELSE '' END) AS model FROM (SELECT DISTINCT event_id % 40
    AS i, event_id % 7 AS m FROM events))"""
_MAJOR, _MINOR = r"CAST(nullif(regexp_extract(model, '^claude-[a-z]+-(\d+)', 1), '') AS INT)", r"CAST(nullif(regexp_extract(model, '^claude-[a-z]+-\d+-(\d+)', 1), '') AS INT)"
_RESEARCH = rf"""coalesce(CASE WHEN provider = 'anthropic' THEN {_MAJOR} >= 5 OR ({_MAJOR} = 4 AND {_MINOR} >= 5) ELSE starts_with(model, 'gpt-') AND
    NOT regexp_matches(model, '-\d{{4}}-\d{{2}}-\d{{2}}$') AND NOT regexp_matches(model,
    'audio|chat|codex|image|realtime|search-preview|transcribe|tts|whisper') END, false)"""
add("p5_filter_research_models", lambda v: catalog.filter_research_models(_catalog(v)), f"WITH {_CATALOG} SELECT provider, model FROM catalog_ WHERE {_RESEARCH}")
add(
    "p6_effort_capable",
    lambda v: _catalog(v).select("provider", "model", catalog.supports_effort(F.col("model")).alias("effort")),
    f"""WITH {_CATALOG} SELECT provider, model, coalesce({_MAJOR} >= 5 OR ({_MAJOR} = 4 AND ((model LIKE 'claude-opus%' AND {_MINOR} >= 5) OR (model LIKE
    'claude-sonnet%' AND {_MINOR} >= 6))), false) AS effort FROM catalog_""",
)
add(
    "u1_catalog_union",
    lambda v: catalog.catalog_union(_catalog(v), v.lookups.select(F.coalesce("provider", F.lit("openai")).alias("provider"), "model")),
    f"""WITH {_CATALOG} SELECT DISTINCT provider, model FROM (SELECT provider, model FROM catalog_ UNION ALL SELECT coalesce(provider, 'openai'), model
    FROM lookups) WHERE {_RESEARCH}""",
)
add("u2_distinct_models", lambda v: catalog.distinct_models(v.lookups), "SELECT DISTINCT trim(model) AS model FROM lookups")
add(
    "w10_catalog_order",
    lambda v: catalog.catalog_order(_catalog(v).select("model").distinct(), "gpt-5", 50),
    f"WITH {_CATALOG} SELECT model, model = 'gpt-5' AS is_default FROM (SELECT DISTINCT model FROM catalog_) ORDER BY model <> 'gpt-5', lower(model), model LIMIT 50",
)
add(
    "j10_unavailable_models",
    lambda v: catalog.unavailable_models(v.lookups.where("provider is not null"), v.prices.select("provider", F.col("base").alias("model"))),
    "SELECT DISTINCT provider, model FROM lookups l WHERE provider IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prices p WHERE p.provider = l.provider AND p.base = l.model)",
)


def _requests(v):
    return v.lookups.select("lookup_id", "provider", "model", F.when(F.col("k") % 4 == 0, "custom").otherwise(F.col("preset")).alias("preset"), "search_provider", F.lit(5000).alias("front"), F.lit("high").alias("search"), F.lit("high").alias("reasoning"), F.lit(999).alias("output_cap"), F.lit(9).alias("evidence_urls"))


_SET = "CASE WHEN k % 4 = 0 THEN 'custom' ELSE preset END"
_pick = lambda a, b, c, own: f"CASE {_SET} WHEN 'economy' THEN {a} WHEN 'balanced' THEN {b} WHEN 'thorough' THEN {c} ELSE {own} END"
_EFF = f"""{_pick(4000, 6000, 12000, 5000)} AS front,
    {_pick(chr(39) + 'low' + chr(39), chr(39) + 'low' + chr(39), chr(39) + 'medium' + chr(39), chr(39) + 'high' + chr(39))} AS search,
    {_pick(1600, 2000, 3000, 999)} AS output_cap, {_pick(2, 3, 4, 9)} AS evidence_urls"""
_REASON = _pick("'none'", "'low'", "'medium'", "'high'")
_LOCAL = "coalesce(provider, 'openai') IN ('ollama', 'lmstudio')"
_MODE = f"CASE WHEN NOT {_LOCAL} AND search_provider = 'hosted' THEN 'hosted' ELSE 'searxng' END AS effective_mode"
add(
    "p14_effective_settings",
    lambda v: enrich.effective_settings(_requests(v)).select("lookup_id", "preset", *enrich.SETTINGS),
    f"SELECT lookup_id, {_SET} AS preset, {_EFF}, {_REASON} AS reasoning FROM lookups",
)
add(
    "p15_effective_search_mode",
    lambda v: enrich.effective_search_mode(v.lookups.withColumn("reasoning", F.lit("low"))).select("lookup_id", "effective_mode", "reasoning"),
    f"SELECT lookup_id, {_MODE}, CASE WHEN {_LOCAL} THEN 'none' ELSE 'low' END AS reasoning FROM lookups",
)
add(
    "j12_resolve_requests",
    lambda v: enrich.resolve_requests(_requests(v), v.prices).select("lookup_id", *enrich.SETTINGS, "effective_mode", "rate_in"),
    f"{_PRICED} SELECT lookup_id, {_EFF}, CASE WHEN {_LOCAL} THEN 'none' ELSE {_REASON} END AS reasoning, {_MODE}, rate_in FROM priced",
)


def _due(v):
    last = v.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    now, at = F.lit(1_000_000_000.0), F.when(F.col("c_custkey") % 11 == 0, "junk").otherwise((F.unix_timestamp(F.col("last").cast("timestamp")).cast("double") + 0.0).cast("string"))
    return v.customer.join(last, "c_custkey", "left").select("c_custkey", catalog.refresh_due(at, now, F.col("c_nationkey") != 3, 24 * 300).alias("due"))


add(
    "p16_refresh_due",
    _due,
    "SELECT c_custkey, c_nationkey <> 3 AND (c_custkey % 11 = 0 OR last IS NULL OR 1e9 < last OR 1e9 - last >= 300 * 86400.0) AS due FROM (SELECT c_custkey, c_nationkey, max(epoch(o_orderdate)) AS last FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2)".replace("300 * 86400.0", "24 * 300 * 3600.0"),
)


def _fresh(v):
    k = F.col("c_custkey")
    fetched = F.when(k % 9 == 0, "junk").when(k % 9 == 1, "NaN").when(k % 9 == 2, F.lit(None).cast("string")).otherwise((1_000_000_000 + (k % 20 - 12) * 86_400).cast("string"))
    models = F.when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m")))
    return v.customer.select("c_custkey", catalog.cache_is_fresh(fetched, models, F.lit(1_000_000_000.0)).alias("fresh"))


add(
    "p16_cache_is_fresh",
    _fresh,
    "SELECT c_custkey, c_custkey % 9 > 2 AND c_custkey % 7 <> 0 AND c_custkey % 20 - 12 <= 0 AND c_custkey % 20 - 12 > -7 AS fresh FROM customer",
)


def _reminders(v):
    k = F.col("p_partkey")
    skipped, reminded = F.when(k % 5 == 0, "1.2.3").when(k % 5 == 1, "1.2.2"), F.when(k % 3 > 0, "1.2.3").otherwise(F.lit(None).cast("string"))
    after = F.when(k % 4 == 0, "junk").when(k % 4 == 1, "inf").when(k % 4 == 2, F.lit(None).cast("string")).otherwise((1000 + k % 11 - 5).cast("string"))
    return v.part.select("p_partkey", catalog.reminder_due(F.lit("1.2.3"), skipped, reminded, after, F.lit(1000.0)).alias("due"))


add("p16_reminder_due", _reminders, "SELECT p_partkey, p_partkey % 5 <> 0 AND (p_partkey % 3 = 0 OR p_partkey % 4 < 3 OR p_partkey % 11 - 5 <= 0) AS due FROM part")
add(
    "p16_known_update",
    lambda v: v.part.select("p_partkey", catalog.known_update_available(F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.concat(F.lit("1.2."), F.col("p_partkey") % 20)), F.lit("5.0.0"), F.lit("1.2.9"), F.concat(F.lit("5."), F.col("p_size") % 3 - 1, F.lit(".0"))).alias("available")),
    "SELECT p_partkey, p_partkey % 9 <> 0 AND p_partkey % 20 > 9 AND p_size % 3 >= 1 AS available FROM part",
)


def _versions(v):
    s = lambda e: F.expr(e).cast("string")
    dots = lambda a, b, c: F.concat_ws(".", s(a), s(b), s(c))
    return v.part.select("p_partkey", catalog.classify_version(dots("p_size % 5", "p_size % 7", "9"), dots("p_partkey % 5", "p_partkey % 12", "10"), dots("5", "p_partkey % 20", "0"), dots("5", "p_size % 20", "0")).alias("state"))


add(
    "p17_classify_versions",
    _versions,
    """SELECT p_partkey, CASE WHEN p_size % 20 < p_partkey % 20 THEN 'incompatible' WHEN (p_partkey % 5, p_partkey % 12, 10) > (p_size % 5, p_size % 7, 9)
    THEN 'available' ELSE 'current' END AS state FROM part""",
)


def _cached(v):
    p = priced(v)
    keyed = p.withColumn("cache_key", F.concat_ws("|", F.col("book_id").cast("string"), "model", "preset"))
    first = keyed.groupBy("cache_key").agg(F.min("lookup_id").alias("first_id"), F.min_by("estimated_cost_usd", "lookup_id").alias("estimated_cost_usd"))
    asks = keyed.select("lookup_id", "cache_key", "input_tokens", "total_tokens", (F.col("k") % 9 == 0).alias("force_refresh"))
    return enrich.cache_lookup(asks, first.where("first_id % 3 > 0"))


add(
    "j1_cache_lookup",
    lambda v: _cached(v).select("lookup_id", "hit", "cost", F.round("avoided_cost", 8).alias("avoided_cost")),
    f"""{_PRICED.rstrip()}, keyed AS (SELECT *, concat_ws('|', CAST(book_id AS VARCHAR), model, preset) AS cache_key FROM priced), c AS (SELECT cache_key,
    min(lookup_id) AS f FROM keyed GROUP BY 1 HAVING min(lookup_id) % 3 > 0), cc AS (SELECT c.cache_key, k.estimated_cost_usd AS e FROM c JOIN keyed k ON
    k.lookup_id = c.f) SELECT a.lookup_id, cc.cache_key IS NOT NULL AND a.k % 9 <> 0 AS hit, CASE WHEN cc.cache_key IS NOT NULL AND a.k % 9 <> 0 THEN 0.0
    END AS cost, CASE WHEN a.k % 9 <> 0 THEN round(cc.e, 8) END AS avoided_cost FROM keyed a LEFT JOIN cc ON cc.cache_key = a.cache_key""",
)
add(
    "j8_apply_record_changes",
    lambda v: review.apply_record_changes(v.lookups.select("lookup_id", "outcome"), v.changes, ["outcome"]),
    """SELECT l.lookup_id, coalesce(c.o, l.outcome) AS outcome FROM lookups l LEFT JOIN (SELECT lookup_id, arg_max(outcome, seq) FILTER (WHERE outcome IS
    NOT NULL) AS o FROM changes GROUP BY 1) c ON c.lookup_id = l.lookup_id""",
)
add(
    "w12_lookup_lifecycle",
    lambda v: review.lookup_lifecycle(v.lookups.select("lookup_id", "outcome"), v.changes),
    """SELECT lookup_id, CASE WHEN coalesce(reviewed, false) AND o = 'ready' THEN 'skipped' ELSE o END AS outcome FROM (SELECT l.lookup_id,
    coalesce(c.outcome, l.outcome) AS o, c.reviewed FROM lookups l LEFT JOIN (SELECT * FROM changes QUALIFY row_number() OVER (PARTITION BY lookup_id
    ORDER BY seq DESC) = 1) c ON c.lookup_id = l.lookup_id)""",
)
add(
    "w1_retain",
    lambda v: metrics.retain(v.lookups.withColumn("seq", F.col("lookup_id")), datetime(2024, 1, 10), 1000).select("lookup_id", "outcome"),
    "SELECT lookup_id, outcome FROM lookups WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY lookup_id DESC LIMIT 1000",
)
add(
    "w3_evict_lru",
    lambda v: metrics.evict_lru(v.lookups.withColumn("seq", F.col("lookup_id")), "book_id", 64),
    "SELECT book_id, max(lookup_id) AS last_used FROM lookups GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 64",
)
add(
    "s11_export_lookups",
    lambda v: metrics.export_columns(v.lookups),
    """SELECT lookup_id, book_id, ts, session_id, provider, search_provider, model, preset, cache_hit, outcome, batch_size, provider_seconds,
    retrieval_seconds, input_tokens, cached_tokens, output_tokens, total_tokens FROM lookups""",
)
add(
    "f15_research_keys",
    lambda v: enrich.research_keys(v.lookups.select("lookup_id", "provider", "model", "preset", F.lit(" http://x/ ").alias("endpoint"), "search_provider").withColumnRenamed("search_provider", "search_mode")).groupBy("cache_key").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("classes")),
    "SELECT n, count(*) AS classes FROM (SELECT coalesce(provider, 'openai'), model, search_provider, count(*) AS n FROM lookups GROUP BY 1, 2, 3) GROUP BY n",
)


def _accounting(v):
    cached = _cached(v)
    return cached.groupBy("hit").agg(F.count("*").alias("requests"), F.round(F.coalesce(F.sum("avoided_cost"), F.lit(0.0)), 6).alias("avoided_cost"))


add(
    "e4_enrich_accounting",
    _accounting,
    f"""{_PRICED.rstrip()}, keyed AS (SELECT *, concat_ws('|', CAST(book_id AS VARCHAR), model, preset) AS cache_key FROM priced), c AS (SELECT cache_key,
    min(lookup_id) AS f FROM keyed GROUP BY 1 HAVING min(lookup_id) % 3 > 0), cc AS (SELECT c.cache_key, k.estimated_cost_usd AS e FROM c JOIN keyed k ON
    k.lookup_id = c.f), x AS (SELECT cc.cache_key IS NOT NULL AND a.k % 9 <> 0 AS hit, CASE WHEN a.k % 9 <> 0 THEN cc.e END AS e FROM keyed a LEFT JOIN cc
    ON cc.cache_key = a.cache_key) SELECT hit, count(*) AS requests, round(coalesce(sum(e), 0), 6) AS avoided_cost FROM x GROUP BY 1""",
)


#: Timings, counters and costs that the lookups lack, as SQL over lookup_id and k; the same text runs in Spark and DuckDB.
_TIMES = {t: f"CASE WHEN k % {i + 4} = 0 THEN NULL ELSE (lookup_id % {50 + i}) * CAST(0.25 AS DOUBLE) END" for i, t in enumerate(metrics.TIMINGS)}
_WHOLE = _TIMES | {"reasoning_tokens": "lookup_id % 70", "web_search_calls": "lookup_id % 5", "hosted_web_search_calls": "lookup_id % 2", "searxng_search_calls": "lookup_id % 5 - lookup_id % 2", "estimated_cost_usd": "CASE WHEN k % 6 > 0 THEN (lookup_id % 9) * CAST(0.5 AS DOUBLE) END", "estimated_avoided_cost_usd": "CASE WHEN cache_hit THEN CAST(0.25 AS DOUBLE) END"}
_KEPT = ("lookup_id", "book_id", "session_id", "provider", "search_provider", "model", "preset", "cache_hit", "outcome", "batch_size", "input_tokens", "cached_tokens", "output_tokens", "total_tokens")


def _whole(v):
    """Lookups with all columns of an export, the time as text."""
    return v.lookups.select(*_KEPT, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), *[F.expr(x).alias(c) for c, x in _WHOLE.items()])


def _all_columns(v):
    out = f"{shared_folder(v.spark)}/queries/csv-{uuid.uuid4().hex}"
    df = metrics.export_columns(_whole(v))
    assert tuple(df.columns) == metrics.EXPORT
    tables.write_csv(df, out, metrics.EXPORT)
    return v.spark.read.option("header", "true").schema(df.schema).csv(out)


_ALL = f"SELECT {', '.join(_KEPT)}, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, {', '.join(f'{x} AS {c}' for c, x in _WHOLE.items())} FROM lookups"
add("s11_csv_all_columns", _all_columns, _ALL)
add("a5_all_timings", lambda v: metrics.timing_breakdown(_whole(v)), " UNION ALL ".join(f"SELECT '{t}' AS timing, round(avg({t}), 4) AS average FROM ({_ALL})" for t in metrics.TIMINGS))
add(
    "j1_cached_usage",
    lambda v: _cached(v).select("lookup_id", "hit", "input_tokens", "total_tokens", "reasoning_tokens"),
    f"""{_PRICED.rstrip()}, keyed AS (SELECT *, concat_ws('|', CAST(book_id AS VARCHAR), model, preset) AS cache_key FROM priced), c AS (SELECT cache_key FROM keyed GROUP BY 1 HAVING min(lookup_id) % 3 > 0),
    h AS (SELECT a.*, c.cache_key IS NOT NULL AND a.k % 9 <> 0 AS hit FROM keyed a LEFT JOIN c ON c.cache_key = a.cache_key)
    SELECT lookup_id, hit, CASE WHEN hit THEN 0 ELSE input_tokens END AS input_tokens, CASE WHEN hit THEN 0 ELSE total_tokens END AS total_tokens, CAST(CASE WHEN hit THEN 0 END AS BIGINT) AS reasoning_tokens FROM h""",
)
