"""License scans by diagonal voting, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty

#: Words are runs of ASCII letters and digits and of everything outside ASCII.
WORD = "[0-9a-z\\x{80}-\\x{10FFFF}]+"

# Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Passages of well-known licences and notices, openings first, and their labels.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3"),
    ("agpl-3", "licensed under the gnu affero general public license version 3"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form"),
    ("apache-2", "you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("bsd-conditions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("gpl-2", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom to share and change free software"),
    ("gpl-3", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2", "it under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("gpl-3", "it under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("lgpl-2.1", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("lgpl-3", "it under the terms of the gnu lesser general public license as published by the free software foundation either version 3"),
    ("agpl-3", "it under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("agpl-3", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0"),
    ("cc-by-nd", "licensed under a creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-nc-sa", "licensed under a creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nc-nd", "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license"),
)
#: Licences that what is missing tells apart: label, labels that stand, labels that don't.
TOLD_APART = (("bsd-2", ("bsd", "bsd-conditions"), ("bsd-3",)),)
#: Labels of families whose passages differ in a word or a number: these stand exactly or not at all.
EXACT = ("gpl-2", "gpl-3", "lgpl-2.1", "lgpl-3", "agpl-3", "cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd")
K = 3
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _positions(templates: list[tuple[str, str]]) -> list[tuple[int, int, int, str, bool, list[str]]]:
    """(template, position, k-grams of the template, label, is base, words) for every k-gram."""
    out = []
    for t, (label, text, base) in enumerate(templates):
        words = text.split()
        for at in range(len(words) - K + 1):
            out.append((t, at, len(words) - K + 1, label, base, words[at : at + K]))
    return out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, templates: tuple[tuple[str, str], ...] = TEMPLATES, drift: int = 2, edit_every: int = 12) -> DataFrame:
    """One row for each input row: the base result and the labels found by diagonal voting.

    All rolling word k-gram hashes of a text are matched to template positions.
    Each match votes for the diagonal (position in the text less position in the
    template). A base phrase stands where one diagonal has a vote from every
    k-gram. For other templates, diagonals at most `drift` apart are merged, and
    a span is verified on its words: the template's words that no matched k-gram
    covers, and words that the span has too many, are edits, of which one is
    allowed for every `edit_every` words of the template. Short templates, and families that differ
    in a version or a word alone (EXACT), must stand exactly. A licence that only the lack of a clause
    tells apart (TOLD_APART) is added to the labels found.
    The templates are part of the library, so their table has a fixed size; it is
    the only table that is broadcast. Hashes that no template has are dropped in
    the scan, before anything is exploded, and a match is confirmed on the words.

    Null texts count as empty. Rows with null or repeated doc_id stay separate.
    No labels give '' and a score of 0; first_word and last_word are then null.
    Very long texts need memory in proportion to the text only.
    """
    spark = docs.sparkSession
    known = [(label, phrase, True) for phrase, label in BASE.items()] + [(label, t, False) for label, t in templates]
    grams = _positions(known)
    hashes = [_hash([F.lit(w) for w in words]) for words in {tuple(g[5]) for g in grams}]
    words = F.regexp_extract_all(F.translate(text_or_empty(text), _UPPER, _UPPER.lower()), F.lit(WORD), F.lit(0))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), words.alias("w"))
    gram = lambda i: [F.get("w", i + j) for j in range(K)]
    starts = F.when(F.size("w") >= K, F.filter(F.sequence(F.lit(0), F.size("w") - K), lambda i: _hash(gram(i)).isin(hashes)))
    found = rows.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), F.transform(starts, lambda i: F.struct(i.alias("pos"), _hash(gram(i)).alias("h"), F.concat_ws(" ", *gram(i)).alias("gram"))).alias("hits"))
    hits = found.select("row", "doc_id", "n_words", F.explode_outer("hits").alias("hit")).select("row", "doc_id", "n_words", "hit.*")
    matched = hits.join(F.broadcast(_template_table(spark, grams)), ["h", "gram"], "left")
    votes = matched.groupBy("row", "doc_id", "n_words", "template", "n_grams", "label", "base", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.col("base") | F.lag("diagonal").over(by).isNull() | (F.col("diagonal") - F.lag("diagonal").over(by) > drift)
    spans = votes.withColumn("span", F.sum(apart.cast("int")).over(by)).groupBy("row", "doc_id", "n_words", "template", "n_grams", "label", "base", "span").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("start")
    )
    length = F.col("n_grams") + K - 1
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + K - 1)))))
    edits = length - covered + F.greatest(F.lit(0), F.col("hi") - F.col("lo") + 1 - F.col("n_grams"))
    spans = spans.withColumn("edits", edits).withColumn("covered", 1 - F.least(F.col("edits"), length) / length)
    place = F.col("base") & (F.size("ats") == F.col("n_grams"))
    near = (F.col("edits") * edit_every <= length) & (~F.col("label").isin(*EXACT) | (F.col("edits") == 0))
    verified = place | (~F.col("base") & near)
    labels = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("label"))))
    out = spans.groupBy("row", "doc_id", "n_words").agg(
        F.count(F.when(place, 1)).alias("n_base"),
        F.min(F.when(place, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(place, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(labels(place), ",").alias("base_labels"),
        labels(verified).alias("labels"),
        F.coalesce(F.max(F.when(verified, F.col("covered"))), F.lit(0.0)).cast("double").alias("score"),
    )
    has = lambda name: F.array_contains("labels", name)
    told = [F.when(reduce(and_, [*map(has, there), *[~has(x) for x in missing]]), F.lit(label)) for label, there, missing in TOLD_APART]
    every = F.array_sort(F.concat("labels", F.array_compact(F.array(*told))))
    return out.withColumn("labels", F.array_join(every, ",")).drop("row")


def _template_table(spark: SparkSession, grams: list[tuple]) -> DataFrame:
    rows = [F.struct(F.lit(t).alias("template"), F.lit(at).alias("at"), F.lit(n).alias("n_grams"), F.lit(label).alias("label"), F.lit(base).alias("base"), _hash([F.lit(w) for w in words]).alias("h"), F.lit(" ".join(words)).alias("gram")) for t, at, n, label, base, words in grams]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
