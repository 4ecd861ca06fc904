"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, identity, materialize, scratch, text_or_empty

#: A run of so many lines is found for certain; it is also the winnowing window.
RUN = 3
_BLANK = " \t\r\x0b\x0c"


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK))


def _digest(*parts: Column) -> Column:
    """128 bits of the lines: two XXH64 with seeds of their own."""
    return F.struct(F.xxhash64(F.lit(1), *parts).alias("a"), F.xxhash64(F.lit(2), *parts).alias("b"))


def fingerprints(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """Rows (id, h, m, pos, fp, matches), one for each selected line of a document of m lines.

    A line is selected when its hash is the least of some window of `run`
    non-blank lines (the rightmost on ties); only selected lines are kept.
    matches are the windows that selected it, from the lines
    before it to those after: (j, their line numbers, digest of their lines). Any
    two equal windows select the same line. A document of fewer lines is one
    window, which only matches whole documents of as many lines. With long_words a line of so
    many words is selected as a window of its own, too.
    """
    id_, h = identity()
    numbered = F.transform(F.split(text_or_empty(), "\n"), lambda x, i: F.struct(_trimmed(x).alias("t"), i.alias("at")))
    lines = docs.select(id_.alias("id"), h.alias("h"), F.filter(numbered, lambda x: x["t"] != "").alias("l"))
    lines = lines.select("id", "h", F.col("l.t").alias("t"), F.col("l.at").alias("at"), F.size("l").alias("m"), F.transform("l", lambda x: F.xxhash64(x["t"])).alias("hs"))

    def selected(j: Column) -> Column:
        hashes = [F.get("hs", j + k) for k in range(run)]
        least, at = F.least(*hashes), F.lit(0)
        for k in range(1, run):
            at = F.when(hashes[k] == least, k).otherwise(at)
        return j + at

    lines = lines.withColumn("p", F.when(F.col("m") >= run, F.transform(F.sequence(F.lit(0), F.col("m") - run), selected)))

    def line(p: Column) -> Column:
        around = F.filter(F.sequence(F.greatest(F.lit(0), p - run + 1), F.least(p, F.col("m") - run)), lambda j: F.get("p", j) == p)
        matches = F.transform(around, lambda j: F.struct(j.alias("j"), F.slice("at", j + 1, run).alias("at"), _digest(*[F.get("t", j + k) for k in range(run)]).alias("lines")))
        return F.struct(p.alias("pos"), F.get("hs", p).alias("fp"), matches.alias("matches"))

    whole = F.struct(F.lit(0).alias("pos"), F.array_min("hs").alias("fp"), F.array(F.struct(F.lit(0).alias("j"), F.col("at"), _digest(F.col("t"), F.col("m")).alias("lines"))).alias("matches"))
    kept = F.when(F.col("m") >= run, F.transform(F.array_distinct("p"), line)).when(F.col("m") > 0, F.array(whole))
    if long_words:
        words = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
        alone = lambda x, p: F.struct(p.alias("j"), F.array(F.get("at", p)).alias("at"), _digest(x, F.lit(-1)).alias("lines"))
        long = F.filter(F.transform("t", lambda x, p: F.when(words(x) >= long_words, F.struct(p.alias("pos"), F.get("hs", p).alias("fp"), F.array(alone(x, p)).alias("matches")))), lambda f: f.isNotNull())
        kept = F.concat(F.coalesce(kept, F.array().cast(lines.select(kept.alias("k")).schema["k"].dataType)), long)
    return lines.select("id", "h", "m", F.explode(kept).alias("f")).select("id", "h", "m", "f.*")


def repeated_runs(docs: DataFrame, run: int = RUN, long_words: int | None = None) -> DataFrame:
    """Rows (id, h, whole, gone): for each document the numbers of the lines that repeat an earlier run.

    whole documents repeat with every line, and their numbers are left out.

    Positions of one fingerprint are joined, if it has two. A match is
    extended to both sides over the lines around it, by a 128-bit digest of
    the lines. The first place of a run in (doc_id, line) order
    stays, later ones are deleted, and overlapping windows add up to maximal runs.
    Within one document a repeat must not overlap the first run. Every join has one
    row a key on one side, which is written first, so the other side, with hot
    lines and thousands of copies, can be split and stays linear.
    """
    with scratch(docs.sparkSession):
        places = materialize(fingerprints(docs, run, long_words), "fingerprints")
        place = F.struct("id", "h", "pos")
        shared = materialize(places.groupBy("fp").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("fp"), "shared")
        candidates = places.join(shared, "fp", "left_semi").select("id", "h", "m", F.explode("matches").alias("w")).select("id", "h", "m", "w.*")
        candidates = materialize(candidates, "candidates")
        place = F.struct("id", "h", "j")
        first = candidates.groupBy("lines").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z")
        first = materialize(first.select("lines", "a"), "first")
        same = (F.col("id") == F.col("a.id")) & (F.col("h") == F.col("a.h"))
        later = candidates.join(first, "lines").where(~same | (F.col("j") >= F.col("a.j") + F.size("at")))
        gone = later.groupBy("id", "h").agg(F.first("m").alias("m"), F.array_distinct(F.flatten(F.collect_list("at"))).alias("gone"))
        whole = F.size("gone") == F.col("m")
        return materialize(gone.select("id", "h", whole.alias("whole"), F.when(~whole, F.col("gone")).alias("gone")), "repeated", lasting=True)


def dedup_lines(docs: DataFrame, run: int = RUN, counts: tuple[str, str] | None = None, long_words: int | None = None) -> DataFrame:
    """docs with later repeats of runs of lines deleted; counts names two columns for the lines and the deleted ones.

    Lines are compared without white space around them; blank lines are no part
    of a run and stay. A document of which every non-blank line is deleted goes.
    A document without deletions keeps its text exactly (null stays null). Rows
    that agree in doc_id and text are one document and share its fate. No rows
    give no rows; other columns are kept, whatever their names. With long_words later repeats of
    single lines of so many words are deleted, too.
    """
    a, b, whole, gone, cut = fresh(docs, "id", "h", "whole", "gone", "cut")
    id_, h = identity()
    found = repeated_runs(docs, run, long_words).withColumnsRenamed({"id": a, "h": b, "whole": whole, "gone": gone})
    # A merge join at every size, so that disk grows in proportion to the documents.
    left = docs.withColumns({a: id_, b: h}).join(found.hint("merge"), [a, b], "left").where(~F.coalesce(whole, F.lit(False))).withColumn(cut, F.split(text_or_empty(), "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col(gone))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(cut, i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        number = F.size(F.filter(cut, lambda x: _trimmed(x) != "")).cast("long")
        columns += [number.alias(counts[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(counts[1])]
    return left.select(*columns)
