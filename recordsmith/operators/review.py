"""Review of proposals against current records: diff, guard, merge, undo."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import clean_descriptions
from ..functions.text import distinct_tags, strip, valid_isbn

# The fields of a record in their order.
FIELDS = ("title", "authors", "series", "tags", "identifiers", "published_date", "publisher", "comments")
#: The text column of the current record that each field has.
CURRENT = {"title": "title", "authors": "authors_text", "series": "series_name", "tags": "tags_text", "identifiers": "isbn_raw", "published_date": "published_date", "publisher": "publisher"}


def field_dimension(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in FIELDS])).alias("pos", "field"))


def select_requested_fields(proposals: DataFrame, fields: list[str]) -> DataFrame:
    """Proposals for the named fields; an unknown name or none at all is an error."""
    unknown = sorted(set(fields) - set(FIELDS))
    if unknown or not fields:
        raise ValueError(f"unknown fields: {unknown}" if unknown else "no fields are requested")
    wanted = field_dimension(proposals.sparkSession).where(F.col("field").isin(*fields))
    return proposals.drop("pos").join(F.broadcast(wanted), "field")


def proposed_values(proposals: DataFrame, series_index: DataFrame | None = None) -> DataFrame:
    """(book_id, field, value_text) of every non-null proposal, and series_index where a proposed series has one (book_id, series_index)."""
    some = proposals.where("value_text is not null").select("book_id", "field", "value_text")
    if series_index is None:
        return some
    numbered = series_index.where("series_index is not null").select("book_id", F.lit("series_index").alias("field"), F.col("series_index").cast("string").alias("value_text"))
    return some.unionByName(numbered.join(some.where("field = 'series'").select("book_id"), "book_id", "left_semi"))


def all_proposed(proposals: DataFrame, series_index: DataFrame | None = None) -> DataFrame:
    """(book_id, field) of what proposed_values() has."""
    return proposed_values(proposals, series_index).select("book_id", "field")


def recommended(proposals: DataFrame) -> DataFrame:
    return proposals.where(F.col("value_text").isNotNull() & F.col("confidence").isin("high", "medium"))


def display_text(field: Column, value: Column) -> Column:
    """What a reviewer sees: authors joined by ' & ', tags by ', ', identifiers with their type."""
    shown = F.when(field == "authors", F.array_join(F.split(value, ";"), " & ")).when(field == "tags", F.array_join(F.split(value, " "), ", ")).when(field == "identifiers", F.concat(F.lit("isbn:"), value)).otherwise(value)
    return strip(F.coalesce(shown, F.lit("")))


def current_fields(books: DataFrame) -> DataFrame:
    """The current records in long form: (book_id, field, current_text)."""
    long = books.select("book_id", *[F.col(c).cast("string").alias(f) for f, c in CURRENT.items()]).unpivot("book_id", list(CURRENT), "field", "value")
    return long.select("book_id", "field", display_text(F.col("field"), F.col("value")).alias("current_text"))


def diff_records(books: DataFrame, proposals: DataFrame) -> DataFrame:
    """(book_id, field, current_text, proposed_text, change) over all fields of both sides.

    The series index has its own row. change is added, removed, changed or unchanged.
    """
    index = books.where("series_index is not null").select("book_id", F.lit("series_index").alias("field"), F.col("series_index").cast("string").alias("current_text"))
    cur = current_fields(books).where("current_text <> ''").unionByName(index)
    new = proposals.where("value_text is not null").select("book_id", "field", display_text(F.col("field"), F.col("value_text")).alias("proposed_text"))
    both = cur.join(new, ["book_id", "field"], "full")
    change = F.when(F.col("current_text").isNull(), "added").when(F.col("proposed_text").isNull(), "removed").when(F.col("current_text") == F.col("proposed_text"), "unchanged").otherwise("changed")
    return both.withColumn("change", change)


def stale_guard(jobs: DataFrame, library: DataFrame, key: str = "book_id") -> DataFrame:
    """jobs with status ready, library_changed (other uuid or fingerprint) or library_missing."""
    lib = library.select(key, F.col("uuid").alias("_uuid"), F.col("fingerprint").alias("_print"), F.lit(True).alias("_there"))
    same = F.col("uuid").eqNullSafe(F.col("_uuid")) & F.col("fingerprint").eqNullSafe(F.col("_print"))
    status = F.when(F.col("_there").isNull(), "library_missing").when(same, "ready").otherwise("library_changed")
    return jobs.join(lib, key, "left").withColumn("status", status).select(*jobs.columns, "status")


def merged_identifiers(old: Column, proposed: Column) -> Column:
    """The old map of identifiers with the good ones of 'kind:value' lines or a bare ISBN added; new values win.

    Kinds are trimmed and lower-cased; an ISBN keeps digits and X and needs a
    valid checksum, or it is dropped; the last good value of a kind counts.
    """
    items = F.filter(F.transform(F.split(proposed, ","), strip), lambda x: x != "")

    def entry(x: Column) -> Column:
        typed = F.instr(x, ":") > 0
        kind = F.when(typed, F.lower(strip(F.substring_index(x, ":", 1)))).otherwise("isbn")
        raw = F.when(typed, strip(F.regexp_replace(x, "^[^:]*:", ""))).otherwise(x)
        isbn = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
        return F.struct(kind.alias("key"), F.when(kind == "isbn", F.when(valid_isbn(isbn), isbn)).otherwise(F.nullif(raw, F.lit(""))).alias("value"))

    good = F.filter(F.transform(items, entry), lambda e: e["value"].isNotNull() & (e["key"] != ""))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    latest = lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, _: k != e["key"]), F.map_from_entries(F.array(e)))
    return F.aggregate(F.coalesce(good, F.array().cast("array<struct<key: string, value: string>>")), F.coalesce(old, none), latest)


def apply_merge(books: DataFrame, selected: DataFrame, *, tag_limit: int = 20, description_limit: int = 5000) -> DataFrame:
    """books with the selected fields replaced; selected has (book_id, field, value_text).

    Tags (separated by commas, or by spaces where there is none) are normalised again and cut to the limit, descriptions
    cleaned again. A series set to null clears its index; the index alone is the field
    series_index, and comes from a proposal of that name. Identifiers are merged into the old map,
    new values winning; fields that are not selected stay untouched.
    """
    wide = selected.groupBy("book_id").agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct(F.col("value_text").alias("v")).alias("s")))).alias("_m"))
    out = books.join(wide, "book_id", "left")
    chosen = lambda f: F.try_element_at("_m", F.lit(f))
    is_set = lambda f: chosen(f).isNotNull()
    new = {c: F.when(is_set(f), chosen(f)["v"]).otherwise(F.col(c)) for f, c in CURRENT.items() if f not in ("identifiers", "tags")}
    tags = chosen("tags")["v"]
    joined = F.when(tags.contains(","), F.array_join(distinct_tags(F.split(tags, ","), tag_limit), ", ")).otherwise(F.array_join(distinct_tags(F.split(tags, " "), tag_limit), " "))
    new["tags_text"] = F.when(is_set("tags"), F.coalesce(joined, F.lit(""))).otherwise(F.col("tags_text"))
    if "comments" in books.columns:
        new["comments"] = F.when(is_set("comments"), clean_descriptions(chosen("comments")["v"], description_limit)).otherwise(F.col("comments"))
    cleared = is_set("series") & chosen("series")["v"].isNull()
    index = F.when(is_set("series_index"), chosen("series_index")["v"].try_cast("double")).otherwise(F.col("series_index"))
    new["series_index"] = F.when(cleared, None).otherwise(index)
    old = F.when(F.col("isbn_raw").isNotNull(), F.create_map(F.lit("isbn"), F.col("isbn_raw")))
    new["identifiers"] = merged_identifiers(F.col("identifiers") if "identifiers" in books.columns else old, chosen("identifiers")["v"])
    return out.withColumns(new).select(*[c for c in books.columns if c != "identifiers"], "identifiers")


def undo_batch(books: DataFrame, undo_log: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(restored books, (restored, skipped) counts): the newest batch is taken back where the uuid still matches."""
    newest = undo_log.agg(F.max("batch_seq").alias("batch_seq"))
    last = undo_log.join(F.broadcast(newest), "batch_seq", "left_semi").select("book_id", F.col("uuid").alias("_uuid"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = books.join(last, "book_id", "left")
    match = F.col("_uuid").isNotNull() & (F.col("uuid") == F.col("_uuid"))
    out = joined.withColumns({c: F.when(match, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).select(*books.columns)
    return out, joined.where("_uuid is not null").agg(F.count_if(match).alias("restored"), F.count_if(~match).alias("skipped"))


def apply_record_changes(records: DataFrame, changes: DataFrame, columns: list[str], key: str = "lookup_id") -> DataFrame:
    """records with the last change of each column; unknown ids change nothing and null changes are none."""
    last = changes.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(f"_{c}") for c in columns])
    out = records.join(last, key, "left")
    return out.withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).select(*records.columns)


def risk_counts(proposals: DataFrame) -> DataFrame:
    """One row: books with proposals, inferred fields and low-confidence fields, of non-null values only."""
    some = proposals.where("value_text is not null")
    return some.agg(F.count_distinct("book_id").alias("books"), F.count_if("inferred").alias("inferred_fields"), F.count_if(F.col("confidence") == "low").alias("low_confidence_fields"))


def keep_last_batches(undo_log: DataFrame, n: int = 10) -> DataFrame:
    """Rows of the newest n batches; the batches are ranked apart from the rows."""
    newest = undo_log.select("batch_seq").distinct().orderBy(F.col("batch_seq").desc()).limit(n)
    return undo_log.join(F.broadcast(newest), "batch_seq", "left_semi")


def lookup_lifecycle(records: DataFrame, changes: DataFrame, key: str = "lookup_id") -> DataFrame:
    """(key, outcome): the last change of each record; a reviewed ready record that was not applied is skipped."""
    by = Window.partitionBy(key).orderBy(F.col("seq").desc())
    last = changes.withColumn("_n", F.row_number().over(by)).where("_n = 1").select(key, F.col("outcome").alias("_outcome"), "reviewed")
    out = records.join(last, key, "left")
    now = F.coalesce("_outcome", "outcome")
    return out.select(key, F.when(F.coalesce("reviewed", F.lit(False)) & (now == "ready"), "skipped").otherwise(now).alias("outcome"))


def split_series(books: DataFrame) -> DataFrame:
    """(book_id, field, value): series and series_index as two review rows."""
    rows = F.array(F.struct(F.lit("series").alias("field"), F.col("series_name").alias("value")), F.struct(F.lit("series_index").alias("field"), F.col("series_index").cast("string").alias("value")))
    return books.where("series_name is not null").select("book_id", F.explode(rows).alias("r")).select("book_id", "r.*").where("value is not null")


def key_set_check(records: DataFrame, expected: list[str]) -> DataFrame:
    """(book_id, missing, unexpected) of each record's keys against the expected set; good records give none."""
    keys, want = F.collect_set("field"), F.array(*[F.lit(f) for f in expected])
    out = records.groupBy("book_id").agg(F.array_sort(F.array_except(want, keys)).alias("missing"), F.array_sort(F.array_except(keys, want)).alias("unexpected"))
    return out.where((F.size("missing") > 0) | (F.size("unexpected") > 0))


def accept_all(books: DataFrame, proposals: DataFrame, library: DataFrame, batch_seq: int, *, series_index: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything proposed for every record that is not stale: updated, undo and outcomes.

    books has the uuid and the file's fingerprint that the research saw, library
    those of now; a record is left alone when either differs or it is gone. The
    index of a proposed series (series_index: book_id, series_index) is a field of its own.
    """
    jobs = stale_guard(books, library)
    ready = jobs.where("status = 'ready'").select("book_id")
    chosen = proposed_values(proposals, series_index).join(ready, "book_id", "left_semi")
    touched = chosen.select("book_id").distinct()
    updated = apply_merge(books, chosen)
    undo = books.join(touched, "book_id", "left_semi").withColumn("batch_seq", F.lit(batch_seq))
    outcome = F.when(F.col("status") != "ready", F.col("status")).when(F.col("_t").isNotNull(), "applied").otherwise("skipped")
    outcomes = jobs.join(touched.withColumn("_t", F.lit(1)), "book_id", "left").select("book_id", outcome.alias("outcome"))
    return {"updated": updated, "undo": undo, "outcomes": outcomes}


def review_apply(books: DataFrame, proposals: DataFrame, decisions: DataFrame) -> dict[str, DataFrame]:
    """Decisions (book_id, action, override_field, override_value) joined; the rest becomes skipped.

    An override replaces the value, is not inferred and has no evidence; a null override unselects the field.
    """
    d = decisions.select("book_id", "action", "override_field", "override_value")
    joined = proposals.where("value_text is not null").join(d.where("action = 'apply'"), "book_id")
    over = F.coalesce(F.col("override_field") == F.col("field"), F.lit(False))
    chosen = joined.select("book_id", "field", F.when(over, F.col("override_value")).otherwise(F.col("value_text")).alias("value_text"), (F.col("inferred") & ~over).alias("inferred"), *([F.when(~over, F.col("evidence_urls")).otherwise(F.array().cast("array<string>")).alias("evidence_urls")] if "evidence_urls" in proposals.columns else []), over.alias("user_override")).where(~F.col("user_override") | F.col("value_text").isNotNull())
    updated = apply_merge(books, chosen.select("book_id", "field", "value_text"))
    touched = chosen.select("book_id").distinct().withColumn("_t", F.lit(1))
    outcomes = books.select("book_id").join(touched, "book_id", "left").select("book_id", F.when(F.col("_t").isNotNull(), "applied").otherwise("skipped").alias("outcome"))
    return {"selected": chosen, "updated": updated, "outcomes": outcomes}
