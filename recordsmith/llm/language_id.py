"""Language ID by Bayesian evidence fusion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, text_or_empty

#: Byte trigrams are counted in so many cells.
CELLS = 1 << 16
#: A text counts as at most so many independent trigrams, so that other evidence can speak.
EVIDENCE = 60.0
MOST_LANGUAGES = 64


def trigrams(text: str | None) -> np.ndarray:
    """The cell of every byte trigram of the lower-cased text, with a space at both ends."""
    a = np.frombuffer(b" " + (text or "").lower().encode() + b" ", np.uint8).astype(np.uint32)
    if len(a) < 3:
        return np.zeros(0, np.int64)
    return (((a[:-2] * np.uint32(40503) ^ a[1:-1] * np.uint32(9973)) * np.uint32(2654435) + a[2:] * np.uint32(65599)) >> np.uint32(4)).astype(np.int64) & (CELLS - 1)


@dataclass
class TextModel:
    """log_p[l, c]: log-probability of cell c in language l, at most 64 x 65536 numbers."""

    languages: list[str]
    log_p: np.ndarray

    def log_likelihood(self, text: str | None) -> list[float]:
        cells = trigrams(text)
        if not len(cells):
            return [0.0] * len(self.languages)
        mean = np.bincount(cells, minlength=CELLS) @ self.log_p.T / len(cells) if len(cells) > CELLS else self.log_p[:, cells].mean(axis=1)
        return (mean * min(EVIDENCE, len(cells))).tolist()


def train(docs: DataFrame, lang: str = "lang", text: str = "text") -> TextModel:
    """Trigram counts by language over all labelled documents, added up by Spark.

    What reaches the driver is one row for each language and cell, whatever the
    size of the corpus. More than 64 languages are an error.
    """
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), text_or_empty(text).alias("text"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for part in parts:
            for name, body in zip(part["lang"], part["text"], strict=True):
                if name not in totals:
                    totals[name] = np.zeros(CELLS, np.int64)
                np.add.at(totals[name], cells, 1) if len(cells := trigrams(body)) < 2000 else totals[name].__iadd__(np.bincount(cells, minlength=CELLS))
        for name, n in totals.items():
            at = n.nonzero()[0]
            yield pd.DataFrame({"lang": name, "cell": at, "n": n[at]})

    counted = labelled.mapInPandas(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "cells")
    languages = [r[0] for r in counted.select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()]
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((max(1, len(languages)), CELLS))
    for r in counted.toLocalIterator():
        counts[languages.index(r["lang"]), r["cell"]] = r["n"]
    return TextModel(languages or ["und"], np.log((counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)))


def _softmax(columns: list[Column]) -> list[Column]:
    top = F.greatest(*columns) if len(columns) > 1 else columns[0]
    parts = [F.exp(c - top) for c in columns]
    total = reduce(lambda a, b: a + b, parts)
    return [p / total for p in parts]


def host_levels(host: Column) -> dict[str, Column]:
    """suffix (last label), domain and host, without a leading www.; '' where there is none.

    The domain is the last two labels, or three where the second is as short as in co.uk.
    """
    name = F.regexp_replace(F.coalesce(F.lower(host), F.lit("")), "^www\\.", "")
    dotted, labels = name.contains("."), F.split(name, "\\.")
    short = F.length(F.get(labels, F.size(labels) - 2)) <= 3
    domain = F.substring_index(name, ".", -2)
    return {"suffix": F.when(dotted, F.substring_index(name, ".", -1)).otherwise(""), "domain": F.when(dotted, F.when(short, F.substring_index(name, ".", -3)).otherwise(domain)).otherwise(name), "host": name}


def identify(rows: DataFrame, model: TextModel, *, keep: tuple[str, ...], strength: float = 8.0) -> DataFrame:
    """Rows with lang, probability and text_lang added, for rows (keep..., text, declared, host).

    The posterior adds up three kinds of evidence: the text's likelihood in each
    language; how often texts of a language declare the given markup language;
    and the host's prior, which is drawn to that of its domain, its suffix and
    the whole corpus with the weight of `strength` rows a level. The last two
    are grouped sums of the text posteriors over all rows, so a hot host is one
    partial sum a task. A row's own posterior is taken out of the sums of its host, domain,
    suffix and corpus, so it counts once. The likelihoods are written once and read twice.

    Very long texts count like others of EVIDENCE trigrams; repeated rows are rows of
    their own; no rows give no rows. Null texts, hosts and declarations are no evidence; a row without any gets
    the corpus prior. Ties go to the first language in alphabetical order. Kept columns may have any names.
    """
    kept = {f"_rs_keep{i}": c for i, c in enumerate(keep)}
    rows = rows.select(*[F.col(f"`{c}`").alias(k) for k, c in kept.items()], "text", "declared", "host")
    return _identified(rows, model, tuple(kept), strength).withColumnsRenamed(kept)


def _identified(rows: DataFrame, model: TextModel, keep: tuple[str, ...], strength: float) -> DataFrame:
    n, schema = len(model.languages), T.ArrayType(T.DoubleType())

    @F.pandas_udf(schema)
    def likelihood(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.log_likelihood(t) for t in part], dtype=object)

    declared = F.lower(F.split(F.coalesce("declared", F.lit("")), "[-_]")[0])
    known = F.when(declared.isin(model.languages), declared).when(declared == "", "").otherwise("other")
    scored = rows.select(*keep, known.alias("_rs_declared"), *[c.alias(f"_rs_{k}") for k, c in host_levels(F.col("host")).items()], likelihood(text_or_empty()).alias("_rs_ll"))
    ll = [F.get("_rs_ll", i) for i in range(n)]
    scored = materialize(scored.select("*", *[c.alias(f"_rs_l{i}") for i, c in enumerate(ll)], *[p.alias(f"_rs_p{i}") for i, p in enumerate(_softmax(ll))]).drop("_rs_ll"), "likelihoods")
    sums = [F.sum(f"_rs_p{i}").alias(f"s{i}") for i in range(n)]
    by_host = scored.groupBy("_rs_suffix", "_rs_domain", "_rs_host").agg(*sums)
    add = [F.sum(f"s{i}").alias(f"s{i}") for i in range(n)]
    by_domain, by_suffix, whole = by_host.groupBy("_rs_suffix", "_rs_domain").agg(*add), by_host.groupBy("_rs_suffix").agg(*add), by_host.agg(*add).first()
    total = sum((whole[f"s{i}"] or 0.0) for i in range(n))
    levels = (by_suffix, "_rs_x", ["_rs_suffix"]), (by_domain, "_rs_y", ["_rs_suffix", "_rs_domain"]), (by_host, "_rs_h", ["_rs_suffix", "_rs_domain", "_rs_host"])
    named = [level.select(*key, *[F.col(f"s{i}").alias(f"{tag}{i}") for i in range(n)]) for level, tag, key in levels]
    host = named[2].join(named[1], ["_rs_suffix", "_rs_domain"]).join(named[0], "_rs_suffix").drop("_rs_suffix", "_rs_domain")
    host = materialize(host, "hosts")  # a row a host, of known size: a host that many rows share can be split

    def smoothed() -> list[Column]:
        own = [F.col(f"_rs_p{i}") for i in range(n)]
        prior = [(F.greatest(F.lit(whole[f"s{i}"] or 0.0) - own[i], F.lit(0.0)) + 1.0) / (max(total - 1.0, 0.0) + n) for i in range(n)]
        for _, tag, _ in levels:
            rest = [F.greatest(F.col(f"{tag}{i}") - own[i], F.lit(0.0)) for i in range(n)]
            mass = reduce(lambda a, b: a + b, rest)
            prior = [(rest[i] + strength * prior[i]) / (mass + strength) for i in range(n)]
        return [p.alias(f"_rs_q{i}") for i, p in enumerate(prior)]

    says = scored.groupBy("_rs_declared").agg(*sums).collect()  # at most 66 rows
    mass = {r["_rs_declared"]: [r[f"s{i}"] for i in range(n)] for r in says if r["_rs_declared"]}
    spoken = [sum(v[i] for v in mass.values()) + len(mass) + 1.0 for i in range(n)]

    def declares(i: int) -> Column:
        out = F.when(F.lit(False), 0.0)
        for value, v in sorted(mass.items()):
            out = out.when(F.col("_rs_declared") == value, float(np.log((v[i] + 1.0) / spoken[i])))
        return out.otherwise(0.0)

    joined = scored.join(host, "_rs_host").select(*keep, "_rs_declared", *[f"_rs_l{i}" for i in range(n)], *smoothed())
    p = _softmax([F.col(f"_rs_l{i}") + F.log(f"_rs_q{i}") + declares(i) for i in range(n)])
    joined = joined.select(*keep, F.array(*p).alias("_rs_p"), F.array(*[F.col(f"_rs_l{i}") for i in range(n)]).alias("_rs_t"))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return joined.select(*keep, best("_rs_p").alias("lang"), F.array_max("_rs_p").alias("probability"), best("_rs_t").alias("text_lang"))


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, host) of raw web pages: text without markup, the html element's lang, the address's host.

    Null markup is an empty text without a language, an address that is null or none has no host; rows stay as often
    as they stand, very long pages whole, and no pages give no rows. Other columns are not read.
    """
    body = F.regexp_replace(text_or_empty("html"), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract(text_or_empty("html"), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]+)", 1)
    return pages.select("page_id", body.alias("text"), F.nullif(declared, F.lit("")).alias("declared"), F.expr("try_parse_url(url, 'HOST')").alias("host"))


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, declared, host) of documents: the source is the host, and no markup declares a language."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("string").alias("declared"), F.col("source").cast("string").alias("host"))
