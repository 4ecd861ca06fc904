"""Cleaning of identifiers, tags, lines and sections as table jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import distinct_tags, fold, strip, valid_isbn


def clean_identifiers(df: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, kind, value) from (key, pos, kind, value): the last good value of each kind.

    Kinds are trimmed and lower-cased; an ISBN keeps digits and X and needs a valid checksum.
    """
    kind = F.lower(strip(F.col("kind")))
    isbn = F.upper(F.regexp_replace("value", "[^0-9Xx]", ""))
    value = F.when(kind == "isbn", F.when(valid_isbn(isbn), isbn)).otherwise(F.nullif(strip(F.col("value")), F.lit("")))
    good = df.select(key, "pos", kind.alias("kind"), value.alias("value")).where("value is not null and kind <> ''")
    return good.groupBy(key, "kind").agg(F.max_by("value", "pos").alias("value"))


def clean_tags(df: DataFrame, limit: int = 20, key: str = "book_id") -> DataFrame:
    """(key, tags) from (key, tags array), row by row; records without a tag left are dropped."""
    return df.select(key, distinct_tags(F.col("tags"), limit).alias("tags")).where(F.size("tags") > 0)


def parse_override_lines(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, pos, kind, value, error) for each non-blank line 'kind:value'."""
    lines = df.select(key, F.posexplode(F.split(column, "\n")).alias("pos", "line")).select(key, "pos", strip(F.col("line")).alias("line")).where("line <> ''")
    at = F.instr("line", ":")
    kind, value = F.lower(strip(F.expr("substr(line, 1, instr(line, ':') - 1)"))), strip(F.expr("substr(line, instr(line, ':') + 1)"))
    good = (at > 0) & (kind != "") & (value != "")
    return lines.select(key, "pos", F.when(good, kind).alias("kind"), F.when(good, value).alias("value"), F.when(~good, "a line needs type:value").alias("error"))


def section_by_heading(lines: DataFrame, is_heading, *, key: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """(key, heading, section): the lines between each heading and the next, trimmed; empty sections give an error."""
    by = Window.partitionBy(key).orderBy(pos)
    marked = lines.withColumns({"_h": is_heading, "_s": F.sum(is_heading.cast("int")).over(by)}).where("_s > 0")
    out = marked.groupBy(key, "_s").agg(F.min(F.when(F.col("_h"), F.col(line))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct(pos, line)))), lambda x: x[line]), "\n").alias("body"))
    return out.select(key, "heading", strip(F.col("body")).alias("section"), F.when(strip(F.col("body")) == "", "empty section").alias("error"))


def dedupe_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in order, whole; keys and places are grouped first, then the rows are looked up.

    Ties in order keep one of the tied rows, the least of all columns.
    """
    firsts = df.groupBy(key).agg(F.min(order).alias(order))
    rows = df.join(firsts, [key, order], "left_semi")
    return rows.groupBy(key, order).agg(F.min(F.struct(*df.columns)).alias("_r")).select("_r.*")


def required_concepts(df: DataFrame, names: list[str], concepts: list[str], limit: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """(key, issues): empty, too long, and which names or concepts a text lacks."""
    body = strip(F.coalesce(column, F.lit("")))
    low = fold(body)
    lacks = lambda words: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: ~F.contains(low, w))
    missing = lacks(names)
    issues = F.concat(
        F.when(F.length(body) > limit, F.array(F.lit("too long"))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(missing) > 0, F.array(F.concat(F.lit("missing names: "), F.array_join(missing, ", ")))).otherwise(F.array().cast("array<string>")),
        F.transform(lacks(concepts), lambda c: F.concat(F.lit("missing concept: "), c)),
    )
    return df.select(key, F.when(body == "", F.array(F.lit("empty"))).otherwise(issues).alias("issues"))


def eligible_records(selection: DataFrame, formats: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(records that have the format, (eligible, missing) counts)."""
    have = formats.select(key).distinct().withColumn("_has", F.lit(True))
    joined = selection.join(have, key, "left")
    counts = joined.agg(F.count("_has").alias("eligible"), F.count_if(F.col("_has").isNull()).alias("missing"))
    return joined.where("_has").drop("_has"), counts


def dangling_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(page_id, link): internal links, without fragment, whose target is not a known path."""
    found = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("raw"))
    link = F.substring_index("raw", "#", 1)
    internal = found.where(~F.col("raw").rlike("^(https?:|#)")).select("page_id", link.alias("link")).where("link <> ''").distinct()
    return internal.join(known.select(F.col("path").alias("link")).distinct(), "link", "left_anti").select("page_id", "link")
