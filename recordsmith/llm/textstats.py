"""Statistics of whole texts as Spark column expressions, without Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: White space between words.
SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 3


def add_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts below added (long); null texts count as empty.

    n_words, word_chars (code points in words), n_chars, n_symbols, n_lines (with a
    word), n_dup_lines (equal to an earlier line), n_repeat_words (words in 3-word
    windows found twice or more), n_distinct (words), n_upper (A-Z), n_marks ('!' and '?').

    Windows are compared by their 64-bit hash within one text. Everything is
    local to a row and sorts at worst, so a very long text costs n log n.
    """
    body = text_or_empty(text)
    base = docs.withColumn("_rs_w", F.array_remove(F.split(body, SPACE), ""))
    n = F.size("_rs_w")
    gram = lambda i: F.struct(F.xxhash64(*[F.get("_rs_w", i + j) for j in range(WINDOW)]).alias("h"), i.alias("i"))
    grams = F.when(n >= WINDOW, F.sort_array(F.transform(F.sequence(F.lit(0), n - WINDOW), gram))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    base = base.withColumns({"_rs_g": grams, "_rs_l": F.filter(F.split(body, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))})
    m = F.size("_rs_g")
    same = lambda k: F.coalesce(F.get("_rs_g", k)["h"] == F.get("_rs_g", k - 1)["h"], F.lit(False)) | F.coalesce(F.get("_rs_g", k)["h"] == F.get("_rs_g", k + 1)["h"], F.lit(False))
    repeated = F.when(m > 1, F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), m - 1), same), lambda k: F.get("_rs_g", k)["i"])))
    base = base.withColumn("_rs_r", repeated)
    covered = F.aggregate(
        F.col("_rs_r"),
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
        lambda acc: acc["n"],
    )
    without = lambda chars: F.length(F.translate(body, chars, ""))
    size = F.length(body)
    out = base.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.array_join("_rs_w", "")).cast("long"),
            "n_chars": size.cast("long"),
            "n_symbols": (size - without(SYMBOLS)).cast("long"),
            "n_lines": F.size("_rs_l").cast("long"),
            "n_dup_lines": (F.size("_rs_l") - F.size(F.array_distinct("_rs_l"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_distinct": F.size(F.array_distinct("_rs_w")).cast("long"),
            "n_upper": (size - without(_UPPER)).cast("long"),
            "n_marks": (size - without("!?")).cast("long"),
        }
    )
    return out.drop("_rs_w", "_rs_g", "_rs_l", "_rs_r")


STATISTICS = ("n_words", "word_chars", "n_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_marks")


def share(part: str | Column, whole: str | Column) -> Column:
    """part / whole, 0 where whole is 0."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def ratios() -> dict[str, Column]:
    """Features of one text over the columns of add_statistics; all are finite."""
    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "n_words"),
        "symbol_chars": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "upper": share("n_upper", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "line_words": share("n_words", "n_lines"),
    }
