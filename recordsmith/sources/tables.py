"""Histories, journals, search results, usage and manifests: reads and writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import collapse, strip
from ..functions.urls import valid_result_url
from ..operators.catalog import parse_version, safe_model_id
from ..operators.metrics import retain
from .staging import staged

HISTORY = "lookup_id long, timestamp string, timestamp_epoch double, model string, provider string, openai_seconds double, provider_seconds double, outcome string, total_tokens long"


#: Bytes of a history file up to which it is read whole, as one document or lines; a larger one is read by its lines.
WHOLE = 64 << 20


def read_history(spark: SparkSession, path: str, *, whole: int = WHOLE) -> DataFrame:
    """Records of history files: JSON lines, or documents with a list `records`.

    Rows that are no objects are dropped, and files that are no JSON or not there
    are empty. The legacy timing moves where the new one is null. A file of at most `whole` bytes is
    read whole, by one task, and its document may span lines. A larger file is read in splits by many tasks:
    each of its lines is a record or a document of its own.
    """
    try:
        small = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).where(F.col("length") <= whole)
        lines = spark.read.option("recursiveFileLookup", "true").text(path).where(F.col("_metadata.file_size") > whole)
    except AnalysisException:  # no such path
        return history_records(spark.createDataFrame([], "body string"))
    return history_records(small.select(F.col("content").cast("string").alias("body")).unionByName(lines.select(F.col("value").alias("body"))))


def history_records(bodies: DataFrame) -> DataFrame:
    """Records of (body) texts, each a document with `records` or JSON lines."""
    whole = F.from_json("body", "struct<version: string, salt: string, records: array<string>>")["records"]
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    raw = bodies.select(F.explode(F.when(whole.isNotNull(), whole).otherwise(lines)).alias("line")).where(F.ltrim("line").startswith("{"))
    good = raw.select(F.from_json("line", HISTORY + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*").where("_corrupt_record is null").drop("_corrupt_record")
    return good.withColumns({"provider_seconds": F.coalesce("provider_seconds", "openai_seconds"), "model": safe_model_id(F.col("model"))}).drop("openai_seconds")


JOURNAL = "entry_id long, timestamp_epoch double, outcome string, provider string, search_provider string, model string, failures array<struct<anonymous_book string, category string, message string, traceback string>>"


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """Journal entries with the defaults 'openai' and 'hosted', names cut to 40, model ids cleaned."""
    raw = spark.read.schema(JOURNAL.replace("anonymous_book string, category string, message string, traceback string", "anonymous_book: string, category: string, message: string, traceback: string")).json(path)
    name = lambda c, default: F.substring(F.coalesce(c, F.lit(default)), 1, 40)
    return raw.withColumns({"provider": name("provider", "openai"), "search_provider": name("search_provider", "hosted"), "model": safe_model_id(F.col("model"))})


def ingest_search_results(raw: DataFrame, most: int = 6) -> DataFrame:
    """(query, rank, title, url, snippet) from (query, body): the first valid results of each response in rank order."""
    most = max(1, min(10, most))
    parsed = raw.select("query", F.from_json("body", "struct<results: array<struct<title: string, url: string, content: string>>>").alias("r"))
    items = F.transform("r.results", lambda x: F.struct(F.substring(collapse(F.coalesce(x["title"], F.lit(""))), 1, 300).alias("title"), F.substring(F.coalesce(x["url"], F.lit("")), 1, 2048).alias("url"), F.substring(collapse(F.coalesce(x["content"], F.lit(""))), 1, 1500).alias("snippet")))
    kept = F.slice(F.filter(items, lambda x: valid_result_url(x["url"])), 1, most)
    return parsed.select("query", F.posexplode(kept).alias("rank", "x")).select("query", "rank", "x.*")


def unify_usage(raw: DataFrame) -> DataFrame:
    """(request_id, provider, input_tokens, cached_tokens, output_tokens, reasoning_tokens, total_tokens, search_calls).

    raw: (request_id, provider, body). Three shapes of JSON become one row a request; calls add up, missing counts are 0.
    """
    shape = (
        "struct<usage: struct<input_tokens: bigint, output_tokens: bigint, total_tokens: bigint, prompt_tokens: bigint, completion_tokens: bigint, cache_read_input_tokens: bigint,"
        " input_tokens_details: struct<cached_tokens: bigint>, output_tokens_details: struct<reasoning_tokens: bigint>, server_tool_use: struct<web_search_requests: bigint>>, output: array<struct<type: string>>>"
    )
    p = raw.select("request_id", "provider", F.from_json("body", shape).alias("b"))
    u = lambda n: F.coalesce(F.col(f"b.usage.{n}"), F.lit(0))
    a, b = F.col("provider") == "openai", F.col("provider") == "anthropic"
    pick = lambda x, y, z: F.when(a, x).when(b, y).otherwise(z)
    zero = F.lit(0).cast("long")
    searches = F.coalesce(F.size(F.filter("b.output", lambda o: o["type"] == "web_search_call")), F.lit(0)).cast("long")
    one = {
        "input_tokens": pick(u("input_tokens"), u("input_tokens"), u("prompt_tokens")),
        "cached_tokens": pick(u("input_tokens_details.cached_tokens"), u("cache_read_input_tokens"), zero),
        "output_tokens": pick(u("output_tokens"), u("output_tokens"), u("completion_tokens")),
        "reasoning_tokens": pick(u("output_tokens_details.reasoning_tokens"), zero, zero),
        "total_tokens": pick(u("total_tokens"), u("input_tokens") + u("output_tokens"), u("total_tokens")),
        "search_calls": pick(F.when(F.col("b.output").isNull(), zero).otherwise(searches), u("server_tool_use.web_search_requests"), zero),
    }
    return p.select("request_id", "provider", *[c.alias(k) for k, c in one.items()]).groupBy("request_id", "provider").agg(*[F.sum(k).alias(k) for k in one])


# The categories of a changelog item, and the keys of a manifest.
CATEGORIES = ("Added", "Changed", "Deprecated", "Removed", "Fixed", "Security")
MANIFEST_KEYS = ("changelog", "channel", "minimum_host", "product", "published", "schema", "version")
#: The changelog's keys and types, all of them, in the notation of schema_of_variant.
_CHANGELOG = "OBJECT<items: ARRAY<OBJECT<category: STRING, text: STRING>>, summary: STRING>"


def strict_manifest_load(rows: DataFrame, *, product: str, channel: str = "stable", key: str = "id") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with errors) of (id, body) manifests.

    Duplicate keys make the parser return null; key sets are exact on every
    level; schema is the number 1; versions have three numbers; the time is a real UTC
    second; the changelog has a summary and 1 to 8 items of known categories,
    whose texts are plain: trimmed, without markup, control characters or addresses.
    Manifests are judged once and written, then split.
    """
    shape = "struct<schema: string, product: string, channel: string, version: string, minimum_host: string, published: string, changelog: struct<summary: string, items: array<struct<category: string, text: string>>>>"
    v = rows.withColumns({"_v": F.try_parse_json("body"), "_m": F.from_json("body", shape)})
    keys = F.array_sort(F.json_object_keys("body"))
    m, items = (lambda n: F.col(f"_m.{n}")), F.col("_m.changelog.items")
    plain = lambda t, n: (F.length(t) > 0) & (F.length(t) <= n) & (t == strip(t)) & ~t.rlike(r"(?i)[\x00-\x1f\x7f<>]|(?:https?://|www\.)")
    no = lambda c: F.coalesce(~c, F.lit(True))
    typed = lambda path: F.schema_of_variant(F.try_variant_get("_v", path, "variant"))
    real = m("published").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z\z") & F.try_to_timestamp(m("published"), F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).isNotNull()
    rules = (
        ("json", F.col("_v").isNull()),
        ("keys", no(keys == F.array(*[F.lit(k) for k in MANIFEST_KEYS]))),
        ("schema", no(F.try_variant_get("_v", "$.schema", "string") == "1") | no(typed("$.schema") == "BIGINT")),
        ("product", no(m("product") == product)),
        ("channel", no(m("channel") == channel)),
        ("version", parse_version(m("version")).isNull() | parse_version(m("minimum_host")).isNull()),
        ("published", no(real)),
        ("changelog", no(typed("$.changelog") == _CHANGELOG) & no(F.size(items) == 0)),
        ("summary", no(plain(m("changelog.summary"), 300))),
        ("items", no(F.size(items).between(1, 8) & F.forall(items, lambda x: F.coalesce(x["category"].isin(*CATEGORIES) & plain(x["text"], 240), F.lit(False))))),
    )
    judged = v.withColumn("errors", F.array_compact(F.array(*[F.when(c, name) for name, c in rules])))
    checked = staged(judged.select(key, F.when(F.size("errors") == 0, F.col("_m")).alias("_m"), "errors"), "manifests")
    accepted = checked.where(F.size("errors") == 0).select(key, "_m.*")
    return accepted, checked.where(F.size("errors") > 0).select(key, "errors")


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] | None = None) -> None:
    """df as CSV files with a header, nulls empty; columns fixes which come and in what order."""
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", "true").option("nullValue", "").option("emptyValue", '""').csv(path)


def write_history(df: DataFrame, path: str, date: Column, *, append: bool = False) -> None:
    """The table by date into a new folder, or new rows appended to it."""
    df.withColumn("date", date).write.mode("append" if append else "errorifexists").partitionBy("date").parquet(path)


def prune_history(spark: SparkSession, path: str, cutoff: datetime, most: int, *, time: str = "ts", seq: str = "seq") -> list[str]:
    """Drop rows older than the cutoff, then all but the last `most` in insertion order; returns the dates that changed.

    Only the folders of those dates are rewritten; the others keep their files. What is kept of them
    is written aside before it replaces them. seq is unique.
    """
    history = spark.read.parquet(path)
    oldest = retain(history, cutoff, most, time=time, seq=seq).agg(F.min(seq)).first()[0]
    good = (F.col(time) >= F.lit(cutoff).cast(history.schema[time].dataType)) & (F.col(seq) >= F.lit(oldest))
    good = F.coalesce(good, F.lit(False))
    counts = history.groupBy("date").agg(F.count("*").alias("n"), F.count_if(good).alias("kept")).where("n <> kept").collect()  # a row a date
    cut = [r["date"] for r in counts if r["kept"]]
    if cut:
        kept = staged(history.where(good & F.col("date").isin(cut)), "pruned")
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
    for r in counts:
        if not r["kept"]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/date={r['date']}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return sorted(str(r["date"]) for r in counts)


def parse_api_errors(df: DataFrame, secrets: tuple[str, ...] = ()) -> Column:
    """'type: message' of an error body, secrets redacted, collapsed, cut to 500."""
    e = F.from_json(F.substring("body", 1, 16 * 1024), "struct<error: struct<message: string, code: string, type: string>>")["error"]
    message = F.coalesce(F.nullif(e["message"], F.lit("")), F.lit("request rejected"))
    for s in secrets:
        if s:
            message = F.replace(message, F.lit(s), F.lit("[REDACTED]"))
    message = F.substring(collapse(F.regexp_replace(message, r"\b(?:sk-|sess-)[A-Za-z0-9_-]{8,}\b", "[REDACTED]")), 1, 500)
    kind = F.coalesce(F.nullif(e["code"], F.lit("")), F.nullif(e["type"], F.lit("")))
    return F.concat(F.coalesce(F.concat(kind, F.lit(": ")), F.lit("")), message)
