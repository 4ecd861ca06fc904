"""The enrichment pipeline: keys, cache, requests, responses and citations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse, instruction_risk, strip, valid_partial_date
from ..functions.urls import valid_evidence_url
from ..sources.staging import staged
from .contracts import response_fields, validate_metadata
from .metrics import COUNTERS, build_lookup_records, evict_lru
from .review import FIELDS

# What a preset sets, and what providers can do.
PRESETS = {
    "economy": (4000, "low", "none", 1600, 2),
    "balanced": (6000, "low", "low", 2000, 3),
    "thorough": (12000, "medium", "medium", 3000, 4),
}
SETTINGS = ("front", "search", "reasoning", "output_cap", "evidence_urls")
LOCAL_PROVIDERS = ("ollama", "lmstudio")


def preset_dimension(spark) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("preset"), *[F.lit(v).alias(f"_{n}") for n, v in zip(SETTINGS, values, strict=True)]) for k, values in PRESETS.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def effective_settings(requests: DataFrame) -> DataFrame:
    """requests with the five settings of a named preset; any other name keeps the row's own."""
    joined = requests.join(F.broadcast(preset_dimension(requests.sparkSession)), "preset", "left")
    return joined.withColumns({n: F.coalesce(f"_{n}", n) for n in SETTINGS}).select(*requests.columns)


def effective_search_mode(requests: DataFrame) -> DataFrame:
    """hosted only where the provider supports it and it is asked for; no reasoning where it is not supported."""
    local = F.coalesce("provider", F.lit("openai")).isin(*LOCAL_PROVIDERS)
    mode = F.when(~local & (F.col("search_provider") == "hosted"), "hosted").otherwise("searxng")
    out = requests.withColumn("effective_mode", mode)
    return out.withColumn("reasoning", F.when(local, "none").otherwise(F.col("reasoning"))) if "reasoning" in requests.columns else out


def resolve_requests(requests: DataFrame, prices: DataFrame) -> DataFrame:
    """The request with the settings of its preset, its search mode and its rates."""
    from .pricing import price_usage

    return effective_search_mode(price_usage(effective_settings(requests), prices))


# What a cache key covers, in sorted order.
KEY_FIELDS = ("allow_remote_endpoints", "endpoint", "epub", "evidence_urls", "front", "max_searches", "model", "output_cap", "prompt", "provider", "reasoning", "requested_fields", "search", "search_mode", "searxng_results", "searxng_url")


def research_keys(df: DataFrame) -> DataFrame:
    """df with cache_key: SHA-256 of canonical JSON of the sixteen fields; absent columns count as null.

    Requested fields are sorted, the endpoint trimmed (null when empty), the search
    address counts in searxng mode only; other columns, such as control flags, do not.
    """
    c = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    mode = F.coalesce(c("search_mode"), F.lit("hosted"))
    special = {
        "provider": F.coalesce(c("provider"), F.lit("openai")),
        "endpoint": F.nullif(F.regexp_replace(strip(c("endpoint")), "/+$", ""), F.lit("")),
        "search_mode": mode,
        "searxng_url": F.when(mode == "searxng", c("searxng_url")),
        "requested_fields": F.array_sort(F.coalesce(F.col("requested_fields") if "requested_fields" in df.columns else F.lit(None).cast("array<string>"), F.array(*[F.lit(f) for f in FIELDS]))),
    }
    material = F.struct(*[special.get(n, c(n)).alias(n) for n in KEY_FIELDS])
    return df.withColumn("cache_key", F.sha2(F.to_json(material, {"ignoreNullFields": "false"}), 256))


#: What the cache keeps of an answer: its fields as they were handed out.
RESULT = "array<struct<field: string, value: string, confidence: string, evidence_urls: array<string>, inferred: boolean, warning: string>>"
CACHE = f"cache_key string, estimated_cost_usd double, result {RESULT}, last_used struct<run: int, seq: bigint>"


def cache_lookup(requests: DataFrame, cache: DataFrame, *, key: str = "cache_key") -> DataFrame:
    """requests with hit, cost, avoided cost, the cached result (if the cache has them) and the usage counters.

    A hit costs 0, has used nothing and avoids its original cost; force_refresh bypasses.
    """
    kept = ["result"] if "result" in cache.columns else []
    c = cache.select(key, F.col("estimated_cost_usd").alias("_cost"), *[F.col(x).alias(f"_{x}") for x in kept], F.lit(True).alias("_hit"))
    hit = F.coalesce("_hit", F.lit(False)) & ~F.coalesce("force_refresh", F.lit(False))
    used = {n: F.when(F.col("hit"), F.lit(0)).otherwise(F.col(n) if n in requests.columns else F.lit(None)).cast("long") for n in COUNTERS}
    out = requests.join(c, key, "left").withColumn("hit", hit).withColumns(used)
    return out.select(*requests.columns, "hit", F.when(F.col("hit"), 0.0).alias("cost"), F.when(F.col("hit"), F.col("_cost")).alias("avoided_cost"), *[F.when(F.col("hit"), F.col(f"_{x}")).alias(x) for x in kept], *[n for n in COUNTERS if n not in requests.columns])


def cache_put(cache: DataFrame, answers: DataFrame, uses: DataFrame, run: int, most: int = 128) -> DataFrame:
    """The cache after a run: answers put in, uses noted, and only the `most` entries used last kept.

    answers: (cache_key, estimated_cost_usd, result, seq), the last of a key wins, also over what
    was cached; uses: (cache_key, seq) of hits. A put is a use. Runs are numbered upwards, and seq orders a run.
    """
    at = lambda seq: F.struct(F.lit(run).cast("int").alias("run"), seq.cast("long").alias("seq"))
    latest = answers.groupBy("cache_key").agg(F.max_by(F.struct("estimated_cost_usd", "result"), "seq").alias("a"), F.max("seq").alias("seq"))
    new = latest.select("cache_key", "a.*", at(F.col("seq")).alias("last_used"))
    old = cache.join(new.select("cache_key"), "cache_key", "left_anti").select("cache_key", "estimated_cost_usd", "result", "last_used")
    stored = old.unionByName(new)
    touched = stored.select("cache_key", "last_used").unionByName(uses.select("cache_key", at(F.col("seq")).alias("last_used")))
    return evict_lru(touched, "cache_key", most, seq="last_used").join(stored.drop("last_used"), "cache_key").select("cache_key", "estimated_cost_usd", "result", "last_used")


def constrain_citations(fields: DataFrame, results: DataFrame, *, request: str = "request_id") -> DataFrame:
    """fields whose evidence_urls hold only addresses that the same request's search found; order and repeats stay."""
    allowed = results.groupBy(request).agg(F.collect_set("url").alias("_allowed"))
    out = fields.join(allowed, request, "left")
    kept = F.filter("evidence_urls", lambda u: F.array_contains(F.coalesce("_allowed", F.array().cast("array<string>")), u))
    return out.withColumn("evidence_urls", kept).select(*fields.columns)


def combine_partials(chunks: DataFrame, expected: DataFrame) -> DataFrame:
    """(request_id, match, fields, errors): the field map of all chunks, the match of the first, chunks whose keys differ.

    chunks: (request_id, chunk, match, field, value); expected: (chunk, fields). Rows
    of one chunk agree in their match; the least is taken where they do not. Of a
    field that two chunks give, the later chunk's value stays. A request's rows are few:
    at most one for each field and chunk; so are the chunks, whose fields go along as one row. All is
    told from one gathering of a request's rows, so a task sorts its rows once.
    """
    known = expected.agg(F.map_from_entries(F.collect_list(F.struct("chunk", "fields"))).alias("_known"))
    gathered = chunks.groupBy("request_id").agg(F.collect_list(F.struct("chunk", "field", "value", "match")).alias("_r")).join(F.broadcast(known))
    of = lambda c, name: F.transform(F.filter("_r", lambda x: x["chunk"].eqNullSafe(c)), lambda x: x[name])

    def wrong(c: Column) -> Column:
        keys, fields = F.array_distinct(F.array_compact(of(c, "field"))), F.when(c.isNotNull(), F.try_element_at("_known", c))
        return F.coalesce((F.size(F.array_except(keys, fields)) > 0) | (F.size(F.array_except(fields, keys)) > 0), F.lit(True))

    def latest(f: Column) -> Column:
        return F.array_max(F.transform(F.filter("_r", lambda x: x["field"].eqNullSafe(f)), lambda x: F.struct(x["chunk"], x["value"])))["value"]

    every = F.array_distinct(F.transform("_r", lambda x: x["chunk"]))
    first = F.array_min(every)
    match = F.when(first.isNotNull(), F.array_min(of(first, "match")))
    fields = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform("_r", lambda x: x["field"]))), lambda f: F.struct(f.alias("field"), latest(f).alias("value"))))
    errors = F.size(F.filter(every, wrong)).cast("long")
    return gathered.select("request_id", match.alias("match"), fields.alias("fields"), errors.alias("errors"))


def research_queries(books: DataFrame, most: int = 3) -> DataFrame:
    """(book_id, rank, query): searches by identifier, then by title and first author; distinct, at most `most`."""
    compact = F.regexp_replace(F.coalesce("isbn_raw", F.lit("")), r"(?U)[^\p{L}\p{N}]", "")
    by_id = F.when(F.length(compact).between(8, 20), F.concat(F.lit('"'), compact, F.lit('" publisher publication date edition')))
    author = collapse(F.get(F.split("authors_text", ";"), F.lit(0)))
    title = F.concat(F.lit('"'), F.substring(collapse(F.col("title")), 1, 180), F.lit('"'))
    named = F.when(F.length(author) > 0, F.concat(F.lit(' "'), F.substring(author, 1, 100), F.lit('"'))).otherwise("")
    by_title = F.when(F.length("title") > 0, F.concat(title, named, F.lit(" publisher ISBN edition")))
    queries = F.slice(F.array_distinct(F.array_compact(F.array(by_id, by_title))), 1, max(1, most))
    return books.select("book_id", F.posexplode(queries).alias("rank", "query"))


def build_requests(books: DataFrame, fields: list[str], *, prompt: str = "", key: str = "book_id") -> DataFrame:
    """(key, scope, instructions, payload, suspicious): one research request a row.

    The payload is the local evidence as JSON with sorted keys: what the record
    says, and a column `evidence` if there is one. Whether that text looks like an
    instruction is kept beside the payload, never in it. scope names the fields asked for,
    in their order, and ends the instructions.
    """
    scope = ", ".join(f for f in FIELDS if f in fields)
    has = "evidence" in books.columns
    known = [F.col("authors_text").alias("authors"), *([F.col("evidence")] if has else []), F.col("isbn_raw").alias("identifier"), F.col("publisher"), F.col("title")]
    instructions = f"{prompt.rstrip()}\n\nReturn exactly these fields: {scope}.".lstrip()
    risky = instruction_risk(F.col("evidence")) >= 2 if has else F.lit(False)
    return books.select(key, F.lit(scope).alias("scope"), F.lit(instructions).alias("instructions"), F.to_json(F.struct(*known), {"ignoreNullFields": "false"}).alias("payload"), risky.alias("suspicious"))


CONFIDENCES = ("high", "medium", "low")


def proposal_errors(urls: int = 10) -> Column:
    """All errors of a proposal row (field, value_text, confidence, evidence_urls, inferred), never only the first."""
    limit = max(1, min(10, urls))
    text, field = F.col("value_text"), F.col("field")
    longest = F.when(field == "comments", 30_000).otherwise(1_000)
    rules = (
        ("unknown field", ~field.isin(*FIELDS)),
        ("confidence", F.coalesce(~F.col("confidence").isin(*CONFIDENCES), F.lit(True))),
        ("inferred", F.col("inferred").isNull()),
        ("too long", F.coalesce(F.length(text) > longest, F.lit(False))),
        ("too many urls", F.coalesce(F.size("evidence_urls") > limit, F.lit(False))),
        ("bad url", F.coalesce(F.exists("evidence_urls", lambda u: ~valid_evidence_url(u)), F.lit(False))),
        ("bad date", (field == "published_date") & ~F.coalesce(valid_partial_date(text), F.lit(False))),
    )
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))


def validate_responses(df: DataFrame, urls: int = 10) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors) of flat proposal rows; they are judged once and written, then split."""
    checked = staged(df.withColumn("errors", proposal_errors(urls)), "proposals")
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def finalize(df: DataFrame) -> DataFrame:
    """Where the evidence was suspicious, every confidence is low and a warning is set."""
    risky = F.coalesce("suspicious", F.lit(False))
    return df.withColumns({"confidence": F.when(risky, "low").otherwise(F.col("confidence")), "warning": F.when(risky, "Suspicious instructions were found in the evidence.")})


def single_flight(misses: DataFrame) -> DataFrame:
    """misses with `leader`: of the requests that share a cache key, the first one is asked for all; a forced one asks for itself.

    The leaders are one row a key, so a key that many requests share is no hot group.
    """
    forced = F.coalesce("force_refresh", F.lit(False))
    first = misses.where(~forced).groupBy("cache_key").agg(F.min("request_id").alias("_first"))
    return misses.join(first, "cache_key", "left").withColumn("leader", F.when(forced, F.col("request_id")).otherwise(F.coalesce("_first", "request_id"))).drop("_first")


def enrich(
    requests: DataFrame,
    cache: DataFrame,
    call: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    fields: list[str],
    *,
    results: DataFrame | None = None,
    evidence: Callable[[DataFrame], DataFrame] | None = None,
    urls: int = 10,
    prompt: str = "",
    run: int = 1,
    most_cached: int = 128,
) -> dict[str, DataFrame]:
    """From requests to reviewed fields: fields, rejected, records, the cache after the run, and lookups.

    requests: (request_id, book_id, force_refresh, evidence, what a record says, and what a
    cache key covers). Cached requests get the cache's fields. Of the others, those that
    share a key are asked once, and the answer goes to all of them: the first pays, the
    others count as hits, or fail with it. For what is asked, `evidence` may gather texts
    (it gets these requests and returns request_id, evidence). The user's function
    gets batches of (request_id, instructions, payload) and returns (request_id, body,
    estimated_cost_usd). Bodies are held to the closed contract, citations to what the
    search found (results: request_id, url), and every confidence is low where the
    evidence was suspicious. The function is the one extension point; what it
    returned is written before it is judged, so nothing is asked twice.

    records has one row a request, whatever happened; lookups, if requests has a job_id, the
    records of the mart. cache: see CACHE; without results, hits have no fields.
    """
    if "result" not in cache.columns:
        cache = cache.select("cache_key", "estimated_cost_usd", F.lit(None).cast(RESULT).alias("result"), F.lit(None).cast("struct<run: int, seq: bigint>").alias("last_used"))
    spread = requests.repartition("request_id")  # a table may be one file, which one task would read, key and hand on whole
    looked = staged(cache_lookup(research_keys(spread), cache), "looked")
    led = staged(single_flight(looked.where(~F.col("hit")).drop("result")), "led")
    leading = led.where(F.col("request_id") == F.col("leader"))
    if evidence is not None:
        leading = staged(leading.drop("evidence").join(evidence(leading.drop("evidence")), "request_id", "left"), "evidence")
    asked = build_requests(leading, fields, prompt=prompt, key="request_id")
    answered = staged(asked.select("request_id", "instructions", "payload").mapInPandas(call, "request_id long, body string, estimated_cost_usd double"), "answers")
    accepted, rejected = validate_metadata(answered, fields, urls)
    found = response_fields(accepted, fields, key="request_id")
    if results is not None:
        found = constrain_citations(found, results)
    # Not written: fields and the cache read it once each, records and lookups do not.
    done = finalize(found.join(asked.select("request_id", "suspicious"), "request_id")).drop("suspicious").withColumnRenamed("request_id", "leader")

    each = ("field", "value", "confidence", "evidence_urls", "inferred", "warning")
    fresh = led.select("request_id", "book_id", "leader").join(done, "leader").select("request_id", "book_id", *each)
    hits = looked.where("hit").select("request_id", "book_id", F.explode("result").alias("r")).select("request_id", "book_id", *[F.col(f"r.{c}").alias(c) for c in each])

    state = accepted.select("request_id", "estimated_cost_usd", F.lit("ready").alias("_state")).unionByName(rejected.select("request_id", "estimated_cost_usd", F.lit("failed").alias("_state")))
    state = state.select(F.col("request_id").alias("leader"), F.col("estimated_cost_usd").alias("_cost"), "_state")
    told = looked.join(led.select("request_id", "leader").join(state, "leader", "left"), "request_id", "left")
    follows = F.coalesce(F.col("leader") != F.col("request_id"), F.lit(False))
    good = F.coalesce(F.col("_state") == "ready", F.lit(False))
    said = {
        "cache_hit": F.col("hit") | (follows & good),
        "cost": F.when(F.col("hit") | follows, 0.0).otherwise(F.col("_cost")),
        "avoided_cost": F.when(F.col("hit"), F.col("avoided_cost")).when(follows & good, F.col("_cost")),
        "outcome": F.when(F.col("hit") | good, "ready").otherwise("failed"),
    }
    kept = [c for c in ("request_id", "book_id", "job_id", "provider", "model", "preset", "search_mode", "batch_size") if c in looked.columns]
    records = told.select(*kept, *[c.alias(k) for k, c in said.items()], *[F.when(F.col("hit") | follows, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in COUNTERS])

    results_of = done.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct(*each))).cast(RESULT).alias("result"))  # a row a field
    put = led.where(F.col("request_id") == F.col("leader")).join(state.where("_state = 'ready'"), "leader").join(results_of, "leader", "left")
    put = put.select("cache_key", F.col("_cost").alias("estimated_cost_usd"), F.coalesce("result", F.array().cast(RESULT)).alias("result"), F.col("request_id").alias("seq"))
    uses = told.where(F.col("hit") | (follows & good)).select("cache_key", F.col("request_id").alias("seq"))
    out = {"fields": fresh.unionByName(hits), "rejected": rejected, "records": records, "cache": cache_put(cache, put, uses, run, most_cached)}
    if "job_id" in looked.columns:
        details = records.select(F.col("request_id").alias("detail_id"), "job_id", "outcome", "cache_hit", F.col("cost").alias("estimated_cost_usd"), F.col("avoided_cost").alias("estimated_avoided_cost_usd"), *COUNTERS)
        payloads = looked.groupBy("job_id").agg(*[F.min(c).alias(c) for c in ("provider", "model", "preset", "search_mode", "batch_size") if c in looked.columns])
        out["lookups"] = build_lookup_records(details, payloads)
    return out


def top_results(results: DataFrame, n: int, *, by: str = "query", order: str = "pos") -> DataFrame:
    """The first n rows of each group in rank order; a group limit, so no group is held whole."""
    w = Window.partitionBy(by).orderBy(order)
    return results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
