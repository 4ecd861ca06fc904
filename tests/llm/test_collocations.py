"""Phrase collocations against plain counting, and on odd rows."""

import glob
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np

from recordsmith.llm import collocations as C
from recordsmith.llm.queries import ORACLE_SQL, QUERIES

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, min_count=100, longest=5, share=100, top=2000):
    """The same by dictionaries, over (lang, text)."""
    f, n, out = defaultdict(Counter), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        gone = {p[i : i + k] for p, a in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= share * counts[p[i : i + k]]}
        scored = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, n[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def got(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(seed, texts=60):
    rng = random.Random(seed)
    words = ["a", "B", "c", "d\x1ce", "é", "É", "日本", "f\xa0", "-", "x|y"]
    return [(rng.choice(["en", "de", None, "en"]), " ".join(rng.choices(words, [9, 7, 5, 3, 2, 2, 2, 1, 1, 1])[0] + rng.choice(["", "", "", ".", "\n", "\t ", "!?", "\r\n"]) for _ in range(rng.randrange(0, 90)))) for _ in range(texts)]


def test_against_plain_counts(spark):
    rows = made(1) + [("en", "the the the the the the")] * 7 + [(None, "u v w u v w")] * 9
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    for kw in ({"min_count": 8}, {"min_count": 3, "share": 60}, {"min_count": 2, "longest": 3, "top": 15}, {"min_count": 5, "longest": 1}):
        assert got(C.collocations(df, **kw)) == plain(rows, **kw)


def test_long_texts_are_cut_between_pieces(spark, monkeypatch):
    rows = [("en", t) for _, t in made(2, 20)]
    whole = [("en", ".".join(t for _, t in rows))]
    want = plain(whole, 4)
    spark_rows = spark.createDataFrame(whole, "lang string, text string")
    parts = [w for w in C._chunks(iter(spark_rows.selectExpr("text", "lang").toArrow().to_batches()))]
    assert len(parts) == 1
    monkeypatch.setattr(C, "CHUNK", 100)
    parts = [w for w in C._chunks(iter(spark_rows.selectExpr("text", "lang").toArrow().to_batches()))]
    assert len(parts) > 5
    counted = Counter()
    for w in parts:
        for counts in C.count_words(w):
            for r in C._elements(w, counts).to_pylist():
                counted[r["next"]] += r["n"]
    assert sum(counted.values()) == want[0][6]


def test_bits_that_stand_for_several_phrases_lose_nothing(spark):
    rows = made(3)
    assert got(C.collocations(spark.createDataFrame(rows, "lang string, text string"), min_count=6, bits=64, counters=64)) == plain(rows, 6)


def test_few_rare_phrases_pass_the_counters(spark):
    """Pairs that share a counter with others are let through; two rows of counters keep them few, and lose none."""
    rng = random.Random(4)
    rows = [("en", f"a{k % 40} b{k % 50}") for k in range(2000)] + [("en", f"x{rng.randrange(300)} y{rng.randrange(300)}") for _ in range(3000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    every = np.full(1, (1 << 64) - 1, np.uint64)
    sketch = C.sketched(df, lambda w: C.count_pairs(w, every, None), 10, 4096)
    w = next(C._chunks(iter(df.selectExpr("text", "lang").toArrow().to_batches())))
    pairs = Counter(text for _, text in rows)
    passed = {" ".join((r["prefix"], r["next"])) for counts in C.count_pairs(w, every, sketch) for r in C._elements(w, counts).to_pylist()}
    frequent = {p for p, n in pairs.items() if n >= 10}
    assert frequent == {p for p in passed if p in frequent} and len(frequent) == 200
    assert len(passed - frequent) < 0.03 * (len(pairs) - len(frequent))


def test_odd_rows(spark):
    rows = [(1, "en", None, 0), (None, None, "", 0), (2, "en", " \t ", 0), (3, "en", "...", 0), (4, "", "x y", 0), (4, "", "x y", 0), (5, "en", "q " * 60_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string, prefix int")
    assert got(C.collocations(df, min_count=2)) == plain([(r[1], r[2]) for r in rows], 2)
    assert C.collocations(df.limit(0)).count() == 0
    assert C.collocations(df.where("doc_id = 3")).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    want = c.sql(f"select lang, rank, phrase, a, l, r, n, score from ({ORACLE_SQL['op12_phrase_collocations']})").fetchall()
    assert got(QUERIES["op12_phrase_collocations"](spark, sf)) == sorted(want)
