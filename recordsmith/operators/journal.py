"""The diagnostic journal and the accounting of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import anonymize, failure_category, instruction_risk, redact_terms, sanitize_text

MOST_FAILURES = 50


def cap_failures(journal: DataFrame, most: int = MOST_FAILURES) -> DataFrame:
    return journal.withColumn("failures", F.slice("failures", 1, most))


def journal_from_results(results: DataFrame, salt: bytes, *, most: int = MOST_FAILURES) -> DataFrame:
    """One row a job: counts and its first failures, each with category, cleaned message and anonymous book.

    results: (job_id, book_id, title, outcome, message). Counts are partial
    sums. Failures are ranked apart and cut to the first `most`, which Spark does
    in every task before it shuffles, so no job is gathered whole.
    """
    counts = results.groupBy("job_id").agg(F.count("*").alias("books"), F.count_if(F.col("outcome") == "failed").alias("failed_books"))
    nth = F.row_number().over(Window.partitionBy("job_id").orderBy("book_id", "message"))
    first = results.where("outcome = 'failed'").withColumn("_n", nth).where(F.col("_n") <= most)
    clean = sanitize_text(redact_terms(F.col("message"), ((F.col("title"), "<TITLE>"),)))
    row = F.struct(F.col("_n"), anonymize(F.col("book_id").cast("string"), salt).alias("anonymous_book"), failure_category(F.col("message")).alias("category"), clean.alias("message"))
    failures = first.groupBy("job_id").agg(F.array_sort(F.collect_list(row)).alias("_f"))
    none = F.filter(F.array(F.struct(*[F.lit("").alias(c) for c in ("anonymous_book", "category", "message")])), lambda _: F.lit(False))
    kept = F.coalesce(F.transform("_f", lambda f: f.dropFields("_n")), none)
    return counts.join(failures, "job_id", "left").select("job_id", "books", "failed_books", kept.alias("failures"))


def export_journal(journal: DataFrame, include_details: bool = False) -> tuple[DataFrame, DataFrame]:
    """(entries, one-row manifest); without details, messages and tracebacks are dropped inside every failure."""
    fields = {f.name for f in journal.schema["failures"].dataType.elementType.fields}
    drop = [f for f in ("message", "traceback") if f in fields]
    out = journal if include_details or not drop else journal.withColumn("failures", F.transform("failures", lambda f: f.dropFields(*drop)))
    manifest = journal.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.size("failures")), F.lit(0)).alias("failures")).withColumn("details", F.lit(include_details))
    return out, manifest


def batch_accounting(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """One row (job_id, n, outcome, cost) for each book of each job, whatever happened.

    jobs: (job_id, batch_size, preflight_failed, cancelled_count); results: (job_id,
    outcome, cost). A job that failed before it began gives batch_size failed
    rows at cost 0; books that were never begun are cancelled rows at cost 0.
    """
    seen = results.groupBy("job_id").agg(F.count_if(F.col("outcome") == "cancelled").alias("_done"))
    done = results.join(jobs.where("preflight_failed").select("job_id"), "job_id", "left_anti").select("job_id", "outcome", "cost")
    missing = F.when(F.col("preflight_failed"), F.col("batch_size")).otherwise(F.greatest(F.lit(0), F.col("cancelled_count") - F.coalesce("_done", F.lit(0))))
    rest = jobs.join(seen, "job_id", "left").withColumn("_m", missing.cast("int")).where("_m > 0")
    filler = rest.select("job_id", F.when(F.col("preflight_failed"), "failed").otherwise("cancelled").alias("outcome"), F.lit(0.0).alias("cost"), F.explode(F.sequence(F.lit(1), F.col("_m"))).alias("_i")).drop("_i")
    return done.unionByName(filler)


def job_outcomes(accounted: DataFrame) -> DataFrame:
    """(job_id, books, outcome): failed before cancelled before success."""
    any_of = lambda o: F.bool_or(F.col("outcome") == o)
    return accounted.groupBy("job_id").agg(F.count("*").alias("books"), F.when(any_of("failed"), "failed").when(any_of("cancelled"), "cancelled").otherwise("success").alias("outcome"))


def diagnostic_rollup(lookups: DataFrame, journal: DataFrame) -> DataFrame:
    """One row: the summary and the journal's counts, without identifiers; a join of two one-row aggregates."""
    from .metrics import summarize

    counts = journal.agg(F.count("*").alias("journal_entries"), F.coalesce(F.sum(F.size("failures")), F.lit(0)).alias("journal_failures"))
    return summarize(lookups).join(F.broadcast(counts))


def count_suspicious(texts: DataFrame, group: str, text: str = "text", least: int = 2) -> DataFrame:
    return texts.groupBy(group).agg(F.count("*").alias("texts"), F.count_if(instruction_risk(F.col(text)) >= least).alias("suspicious"))
