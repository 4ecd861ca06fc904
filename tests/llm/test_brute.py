"""The training-data operators against plain Python, on odd rows, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from recordsmith.llm import decontamination, language_id, license_scan, line_dedup, near_dedup, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts
from recordsmith.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
CLASH = "doc_id long, text string, lang string, source string, n_chars long, _rs_id long, _rs_score string, _rs_mix int, _RS_h int, score int, n long, id int"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
ODD = [(1, None), (None, "a b c"), (None, None), (2, ""), (2, ""), (3, " \n \t"), (4, LONG), (5, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0."), (5, "other text"), (6, "a\x1cb  c <|endoftext|> d'S"), (7, "x"), (8, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, 0, 70 + k, "s", k, 3, 4, 5, 6) for k, (i, t) in enumerate(ODD)], CLASH)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def key(row):
    return tuple(map(repr, row))


def test_stages_keep_columns_that_clash(spark, odd, benchmark, labels):
    rows = Counter(map(key, odd.collect()))
    scored = quality_classifier.score(odd, quality_classifier.fit(odd, labels), "_rs_new").drop("_rs_new")
    for made in (scored, line_dedup.dedup_lines(odd), near_dedup.one_per_component(odd), decontamination.decontaminate(odd, benchmark)):
        assert made.columns == odd.columns
        assert not Counter(map(key, made.collect())) - rows
    assert Counter(map(key, scored.collect())) == rows
    assert Counter(map(key, decontamination.decontaminate(odd, benchmark).collect())) == rows
    for _, stage in corpus_pipeline.STAGES[:4]:
        assert stage(spark, odd, SF).columns == odd.columns
    pieces = odd.select("*", F.lit(0).alias("piece"), F.lit(9).cast("long").alias("length"), F.lit(1).alias("_rs_shard"))
    packed = packing.pack(pieces)
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"]
    assert Counter(key(r[:-2]) for r in packed.collect()) == Counter(map(key, pieces.collect()))


def test_empty_tables(spark, docs, odd, benchmark, labels):
    none = odd.limit(0)
    assert license_scan.scan_licenses(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert packing.pack_documents(none, tokenizer_path("word_bpe_49k.json")).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert decontamination.contaminated(none, benchmark).count() == 0
    assert decontamination.contaminated(odd, benchmark.limit(0)).count() == 0
    assert language_id.identify(language_id.document_rows(none), language_id.train(docs), keep=("doc_id",)).count() == 0
    assert language_id.identify(language_id.document_rows(odd), language_id.train(none), keep=("doc_id",)).where("lang = 'und'").count() == len(ODD)
    assert token_counts.count_tokens(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0 and substring_dedup.repeated_within(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert quality_classifier.classify(none, labels).count() == 0
    done = none
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, done, SF)
        assert done.count() == 0, name


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base_licenses(text):
    words = WORD.findall((text or "").translate(ASCII))
    found = []
    for phrase, label in (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")):
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_license_base_everywhere(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ODD
    rows += [(9, "Under the MIT license, under the mit LICENSE cc-by-nc"), (9, "İ under the mit license K"), (9, "cc by nc by nc apache license version 2 ")]
    got = license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()
    mine = Counter(repr((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"])) for r in got)
    assert mine == Counter(repr((i, *base_licenses(t))) for i, t in rows)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert license_scan.scan_licenses(odd).count() == len(ODD)


def test_license_edits(spark):
    rows, want = [], []
    for label, text in license_scan.TEMPLATES:
        w = text.split()
        mid = len(w) // 2
        edits = [w[:mid] + ["quux"] + w[mid + 1 :], w[:mid] + ["quux"] + w[mid:], w[:mid] + w[mid + 1 :]]
        for k, e in enumerate([w, *edits]):
            rows.append((len(rows), " ".join(["before"] * 9 + e + ["after"] * 9)))
            want.append((label, k == 0 or (len(w) >= 12 and label not in license_scan.EXACT), len(w), k))
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, DOCS)).collect()}
    for i, (label, found, _, k) in enumerate(want):
        assert (label in got[i]["labels"].split(",")) == found or got[i]["base_labels"] == label, (rows[i], got[i])
    isc = "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"
    nd = "licensed under a creative commons attribution noderivatives 4 0 international license"  # one word from cc-by-nc
    gpl = "licensed under the gnu general public license version 4"
    got = license_scan.scan_licenses(spark.createDataFrame([(1, isc), (2, nd), (3, gpl)], DOCS)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["isc", "cc-by-nd", ""]


def test_licences_that_a_clause_tells_apart(spark):
    passage = lambda label, k=0: [t for x, t in license_scan.TEMPLATES if x == label][k]
    bsd = [passage("bsd"), passage("bsd-conditions"), passage("bsd", 1)]
    lesser = "this program is free software you can redistribute it and or modify " + passage("lgpl-3", 1)
    texts = [" ".join(bsd), " ".join([*bsd[:2], passage("bsd-3"), bsd[2]]), passage("bsd"), lesser, passage("agpl-3", 2), passage("cc-by-nc-sa")]
    got = license_scan.scan_licenses(spark.createDataFrame(list(enumerate(texts)), DOCS)).orderBy("doc_id").collect()
    assert [r["labels"] for r in got] == ["bsd,bsd-2,bsd-conditions", "bsd,bsd-3,bsd-conditions", "bsd", "lgpl-3", "agpl-3", "cc-by-nc-sa"]


def deduped(rows, run=3, long=None):
    """Plain form of the line dedup: rows sorted by id, text; later windows of `run` lines go, and later lines of `long` words."""
    lines = {k: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((k[1] or "").split("\n"))] for k in rows}
    lines = {k: [(i, x) for i, x in v if x] for k, v in lines.items()}
    seen, gone = {}, {k: set() for k in rows}
    for k in sorted(rows, key=lambda k: (k[0] is not None, k[0] or 0, k[1] or "")):
        v = lines[k]
        if len(v) < run:
            windows = [(0, (len(v), *[x for _, x in v]))] if v else []
        else:
            windows = [(j, tuple(x for _, x in v[j : j + run])) for j in range(len(v) - run + 1)]
        windows = [(j, w, run) for j, w in windows] + [(j, ("long", x), 1) for j, (_, x) in enumerate(v) if long and len(x.split()) >= long]
        for j, w, n in windows:
            if w in seen and (seen[w][0] != k or j >= seen[w][1] + n):
                gone[k] |= {i for i, _ in v[j : j + n]}
            seen.setdefault(w, (k, j))
    out = []
    for k, n in rows.items():
        if gone[k] and len(gone[k]) == len(lines[k]):
            continue
        text = "\n".join(x for i, x in enumerate(k[1].split("\n")) if i not in gone[k]) if gone[k] else k[1]
        out += [(k[0], text)] * n
    return Counter(map(repr, out))


def test_line_dedup_everywhere(spark, docs):
    rng = random.Random(4)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(i, t) for i, t in ODD if i != 8]
    rows += [(1000 + k, "\n".join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 14)))) for k in range(150)]
    rows += [(2000, "p\nq\nr\np\nq\nr\np\nq"), (2001, "  p\n\nq \n\tr"), (2002, "h\n" * 500), (2003, "h\n" * 400)]
    got = Counter(repr((r["doc_id"], r["text"])) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect())
    assert got == deduped(Counter(rows))
    line = lambda k: " ".join(f"{c}{k}" for c in "abcdefgh")
    rows += [(3000 + k, "\n".join([line(k % 7), f"only {k}", line(k % 5), line(k % 7)][: k % 4 + 1])) for k in range(60)]
    got = Counter(repr((r["doc_id"], r["text"])) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS), long_words=8).collect())
    assert got == deduped(Counter(rows), long=8)


def test_winnowing_finds_what_it_keeps(spark):
    rng = random.Random(6)
    text = "\n".join(f"l{rng.randrange(99)}" for _ in range(40))
    kept = line_dedup.fingerprints(spark.createDataFrame([(1, text)], DOCS)).collect()
    assert len(kept) < 30 and sorted(w["j"] for r in kept for w in r["matches"]) == list(range(38))
    assert all(r["pos"] - 2 <= w["j"] <= r["pos"] for r in kept for w in r["matches"])


def test_rules_base(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()] + ODD
    split = re.compile("[^\x20\x09-\x0d]+")

    def base(text):
        text = text or ""
        words = split.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        n = Counter(grams)
        lines = [x for x in text.split("\n") if split.search(x)]
        repeated = len({i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)})
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), repeated, len(words) < 50 or 100 * repeated > 50 * len(words)

    got = quality_rules.quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    mine = Counter(repr((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])) for r in got)
    assert mine == Counter(repr((i, *base(t))) for i, t in rows)
    assert not any(r["kept"] and r["base_failed"] for r in got) and sum(r["kept"] for r in got) > 700


def test_estimated_accuracies(spark):
    rng = random.Random(9)
    names, truth, rows = ["a", "b", "c", "d"], [(0.95, 0.6), (0.9, 0.5), (0.85, 0.7), (0.97, 0.4)], Counter()
    for _ in range(20_000):
        good = rng.random() < 0.8
        rows[tuple(0 if rng.random() < 0.1 else (1 if (rng.random() < t[not good]) == good else -1) for t in truth)] += 1
    prior, rates = quality_rules.estimate(spark.createDataFrame([(*k, n) for k, n in rows.items()], "a int, b int, c int, d int, n long"), names, rounds=60)
    assert abs(prior - 0.8) < 0.06
    assert all(abs(r[0] - t[0]) < 0.06 for r, t in zip(rates, truth, strict=True))
    assert quality_rules.estimate(spark.createDataFrame([], "a int, n long"), ["a"])[0] == 0.8


def test_compiled_score_is_the_models(docs, labels):
    model = quality_classifier.fit(docs, labels)
    names = list(quality_classifier.ratios())
    frame = quality_classifier.add_statistics(docs).select("doc_id", *[c.alias(k) for k, c in quality_classifier.ratios().items()]).collect()
    x = np.array([[r[k] for k in names] for r in frame])
    total = model.bias + sum(w * quality_classifier._holds(x, names, rule) for rule, w in model.rules)
    want = {r["doc_id"]: 1 / (1 + math.exp(-t)) for r, t in zip(frame, total, strict=True)}
    got = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    assert got == pytest.approx(want) and len(model.rules) > 1
    import zlib

    rows = quality_classifier.classify(docs, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def edited(rng, words, edits, some):
    out = list(words)
    for _ in range(edits):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice(some)
        elif kind == 1:
            out.insert(at, rng.choice(some))
        else:
            del out[at]
    return out


def least_edits(item, text):
    """Edit distance of item to the nearest part of text, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_decontamination_against_plain_distances(spark):
    rng = random.Random(11)
    some = [f"v{k}" for k in range(400)]
    items = [[rng.choice(some) for _ in range(n)] for n in (1, 2, 4, 5, 12, 15, 25, 40, 60, 90)]
    items[0] = ["single"]
    texts = []
    for n, item in enumerate(items):
        for edits in (0, 0, 1, 2, len(item) // 10, len(item) // 7, len(item) // 5, len(item) // 3):
            inner = edited(rng, item, edits, some) if n > 3 or not edits else list(item[:-1])
            texts.append([rng.choice(some) for _ in range(60)] + inner + [rng.choice(some) for _ in range(rng.randrange(60))])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)] + [(50, None), (None, "x y z"), (51, " ... ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.find_leaks(docs, bench).collect()}
    want = {(d, i): e for d, t in enumerate(texts) for i, item in enumerate(items) if (e := least_edits(item, t)) <= len(item) // 5}
    assert got.keys() <= want.keys() and all(got[k] >= want[k] for k in got)
    short = {k for k in want if len(items[k[1]]) < 5}
    assert short <= got.keys() and len(short) >= 6
    assert len(got) >= 0.95 * len(want)
    clean = {r["doc_id"] for r in decontamination.decontaminate(docs, bench).collect()}
    assert clean == set(range(len(texts))) - {d for d, _ in got}
    assert sum(1 for _ in decontamination.blocks(bench, size=200)) > 3
    halves = {(r["doc_id"], r["item_id"]) for b in decontamination.blocks(bench, size=400) for r in decontamination._scan(docs.selectExpr("doc_id", "1L as h", "text"), b).collect()}
    assert halves == got.keys()


def test_language_evidence(spark):
    rng = random.Random(12)
    words = {"aa": ["tolo", "rami", "keso", "anato"], "bb": ["strix", "brund", "gworf", "plesk"]}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    known = spark.createDataFrame([(lang, text(lang, 60)) for lang in words for _ in range(40)] + [(None, "x")], "lang string, text string")
    model = language_id.train(known)
    plain = {lang: Counter() for lang in words}
    for r in known.collect():
        if r["lang"]:
            plain[r["lang"]].update(language_id.trigrams(r["text"]).tolist())
    for k, lang in enumerate(model.languages):
        total = sum(plain[lang].values()) + 0.5 * language_id.CELLS
        assert all(math.isclose(model.log_p[k, c], math.log((n + 0.5) / total)) for c, n in plain[lang].items())
    rows = [(f"a{i}", text("aa", 30), "aa" if i % 2 else None, "www.one.org") for i in range(20)] + [(f"b{i}", text("bb", 30), "bb-XX", "two.co.uk") for i in range(20)]
    rows += [("host", "", None, "one.org"), ("declared", None, "BB", None), ("nothing", None, None, None), ("new", "", None, "sub.two.co.uk")]
    got = {r["name"]: r for r in language_id.identify(spark.createDataFrame(rows, "name string, text string, declared string, host string"), model, keep=("name",)).collect()}
    assert len(got) == len(rows) and all(0 < r["probability"] <= 1 for r in got.values())
    assert all(got[n]["lang"] == n[0] * 2 for n in got if n[1:].isdigit())
    assert (got["host"]["lang"], got["declared"]["lang"], got["new"]["lang"]) == ("aa", "bb", "bb")
    assert got["nothing"]["probability"] < 0.6 < got["host"]["probability"]


def test_own_row_is_no_evidence(spark):
    model = language_id.TextModel(["aa", "bb"], np.log(np.full((2, language_id.CELLS), 1 / language_id.CELLS)))
    rows = spark.createDataFrame([("x", "", None, "lone.org")], "name string, text string, declared string, host string")
    assert language_id.identify(rows, model, keep=("name",)).first()["probability"] == pytest.approx(0.5)


def test_language_posterior_by_hand(spark):
    """The whole posterior of page rows, by dictionaries."""
    rng = random.Random(19)
    words = {"aa": ["tolo", "rami", "keso", "anato"], "bb": ["strix", "brund", "gworf", "plesk"], "cc": ["umu", "ubu", "uku"]}
    text = lambda x, n: " ".join(rng.choice(words[x]) for _ in range(n))
    model = language_id.train(spark.createDataFrame([(x, text(x, 50)) for x in words for _ in range(20)], "lang string, text string"))
    hosts = ["http://www.one.org/a", "https://two.co.uk/b", "http://sub.two.co.uk/", "ftp://three.net/x", None, "no address", "http://localhost/"]
    pages = []
    for k in range(120):
        x, y = rng.choice(list(words)), rng.choice([*words, "zz", None])
        lang = f' lang="{y}-XX"' if y else ""
        pages.append((k, rng.choice(hosts), rng.choice([f"<html{lang}><body><script>var a;</script><p>{text(x, rng.randrange(0, 9))}</p></body></html>", f"<HTML class=a{lang}> {text(x, 1)}", None])))
    pages += [pages[0], (None, None, None)]
    rows = language_id.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")).withColumnRenamed("page_id", "_rs_p0")
    said, strength = [r.asDict() for r in rows.collect()], 8.0
    assert said[0]["text"] is not None and {r["host"] for r in said} >= {"www.one.org", "two.co.uk", None}

    def levels(host):
        name = re.sub(r"^www\.", "", (host or "").lower())
        parts = name.split(".")
        if len(parts) < 2:
            return "", name, name
        return parts[-1], ".".join(parts[-3:] if len(parts[-2]) <= 3 else parts[-2:]), name

    def softmax(v):
        e = [math.exp(x - max(v)) for x in v]
        return [x / sum(e) for x in e]

    lls = [model.log_likelihood(r["text"]) for r in said]
    own = [softmax(v) for v in lls]
    sums = {}
    for r, p in zip(said, own, strict=True):
        a, b, c = levels(r["host"])
        for key in ((), (a,), (a, b), (a, b, c)):
            sums[key] = [s + q for s, q in zip(sums.get(key, [0.0] * 3), p, strict=True)]
    known = [None if not r["declared"] else r["declared"].lower() if r["declared"].lower() in model.languages else "other" for r in said]
    spoken = {}
    for d, p in zip(known, own, strict=True):
        if d:
            spoken[d] = [s + q for s, q in zip(spoken.get(d, [0.0] * 3), p, strict=True)]
    total = [sum(v[i] for v in spoken.values()) + len(spoken) + 1.0 for i in range(3)]
    want = []
    for r, ll, p, d in zip(said, lls, own, known, strict=True):
        a, b, c = levels(r["host"])
        whole = sum(sums[()])
        prior = [(max(sums[()][i] - p[i], 0) + 1) / (max(whole - 1, 0) + 3) for i in range(3)]
        for key in ((a,), (a, b), (a, b, c)):
            rest = [max(sums[key][i] - p[i], 0) for i in range(3)]
            prior = [(rest[i] + strength * prior[i]) / (sum(rest) + strength) for i in range(3)]
        post = softmax([ll[i] + math.log(prior[i]) + (math.log((spoken[d][i] + 1) / total[i]) if d else 0.0) for i in range(3)])
        want.append((r["_rs_p0"], model.languages[post.index(max(post))], max(post)))
    got = [(r["_rs_p0"], r["lang"], r["probability"]) for r in language_id.identify(rows, model, keep=("_rs_p0",)).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    for x, y in zip(order(got), order(want), strict=True):
        assert x[:2] == y[:2] and x[2] == pytest.approx(y[2], rel=1e-9)


def test_passages_with_null_and_repeated_ids(spark):
    rng = random.Random(14)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    shared, twice = [some(70) for _ in range(4)], some(80)
    text = lambda p: " ".join(some(40) + p + some(40))
    rows = [(None, text(shared[0])), (None, text(shared[0])), (3, text(shared[1])), (3, text(shared[1])), (4, text(shared[2])), (5, text(shared[2])), (4, text(shared[3])), (6, text(shared[3]))]
    rows += [(7, " ".join(twice + some(30) + twice)), (8, " ".join(["word"] * 300)), (9, " ".join(some(200)))]
    df = spark.createDataFrame(rows + rows[:2], DOCS)
    got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(df).collect()}
    assert got == {(None, None), (3, 3), (5, 4), (6, 4)}
    within = {r["doc_id"]: r for r in substring_dedup.repeated_within(df).collect()}
    assert set(within) == {7, 8}
    assert (within[7]["start_word"], within[7]["n_words"], within[7]["other_start"]) == (110, 80, 0)


def test_repeats_within_a_text_against_all_runs():
    """Every word of a run of `least` words that stands earlier, apart, is reported, and no other word."""
    rng = random.Random(16)
    for case in range(300):
        least = rng.choice([3, 5, 8])
        words = [rng.choice([b"a", b"b", b"c", b"d", b"e", b"f"][: rng.choice([1, 2, 4, 6])]) for _ in range(rng.randrange(0, 70))]
        if case % 3 == 0:
            words += words[5:40] + [b"x"] + words[12:30]
        runs = [tuple(words[p : p + least]) for p in range(len(words) - least + 1)]
        want = {p + i for p, w in enumerate(runs) if any(runs[q] == w for q in range(p - least + 1)) for i in range(least)}
        got = substring_dedup.own_repeats(words, least)
        assert {p + i for p, n, _ in got for i in range(n)} == want
        assert all(words[p : p + n] == words[q : q + n] and n >= least and q + least <= p for p, n, q in got)


def test_repeats_within_a_text_survive_edits(spark):
    rng = random.Random(17)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    p = some(60)
    rows = [(1, p + some(20) + p[27:33] + some(20) + p), (2, p[:30] + some(1) + p[30:] + some(20) + p), (3, p + some(9) + p + some(9) + p)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], DOCS)
    got = sorted((r["doc_id"], r["start_word"], r["n_words"], r["other_start"]) for r in substring_dedup.repeated_within(df).collect())
    assert got == [(1, 106, 60, 0), (3, 69, 60, 0), (3, 138, 60, 0)]


def test_long_items_are_embedded_few_at_a_time():
    rng = random.Random(18)
    item = [f"i{rng.randrange(10**5)}".encode() for _ in range(3000)]
    copy = list(item)
    for at in rng.sample(range(3000), 200):
        copy[at] = b"x"
    block = decontamination.Block.of([(1, b" ".join(item).decode())])
    found = decontamination.leaks([b"w"] * 50 + copy + [b"w"] * 50, block)
    assert len(found) == 1 and found[0][3] <= 600


def test_passages_lose_no_link(spark):
    """Documents are in one component of the rows exactly where passages() of all pairs join them: edits, copies, and 30 words that many share."""
    rng = random.Random(19)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    common, texts = some(30), []
    texts += [some(40) + common + some(40) for _ in range(40)]
    for k in range(12):  # the common words go on, over an edited word, in two documents
        more = some(30)
        texts += [some(20) + common + some(1) + more + some(20), some(20) + common + some(1) + more + some(20)] if k % 2 else [some(20) + more + some(1) + common + some(20) for _ in range(2)]
    for _ in range(60):  # one or two edits of 50 to 110 words
        p = some(rng.randrange(50, 110))
        q = list(p)
        for at in rng.sample(range(len(q)), 1 + len(q) // 80):
            q[at : at + rng.randrange(2)] = some(1)
        texts += [some(30) + p + some(30), some(30) + q + some(30)]
    texts += [texts[0]] * 3 + [texts[-1] + some(60)] * 2
    made = [substring_dedup.shingles([w.encode() for w in t]) for t in texts]

    def components(pairs):
        root = list(range(len(texts)))
        find = lambda x: x if root[x] == x else find(root[x])
        for x, y in pairs:
            root[max(find(x), find(y))] = min(find(x), find(y))
        return [find(x) for x in range(len(texts))]

    want = components((x, y) for x in range(len(texts)) for y in range(x) if substring_dedup.passages(made[x], made[y]))
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)).collect()
    assert components((r["doc_id"], r["other_id"]) for r in rows) == want
    assert len(set(want)) < len(texts) - 40


def test_words_repeated_many_times_are_few_open_rows(spark, monkeypatch):
    """A run of one word over and over has equal shingles all around at most of its places: these are one row of a document, and the rows stay the same."""
    rng = random.Random(20)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    texts = [some(30) + ["the"] * 36 + some(1) + ["the"] * 10 + some(30) for _ in range(30)]  # too short to be a passage
    more, put = some(30), some(25)
    texts += [some(20) + ["the"] * 30 + put + some(1) + more + some(20) for _ in range(2)]  # a passage over an edited word
    written, write = {}, substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, name, lasting=False: written.setdefault(name, write(df, name, lasting)))
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)).collect()
    assert {(r["doc_id"], r["other_id"]) for r in rows} == {(31, 30)}
    assert 0 < written["ends"].count() <= 3 * len(texts)


def test_passages_recall_at_the_threshold(spark):
    rng = random.Random(15)
    common = [f"c{k}" for k in range(3000)]
    boiler = [rng.choice(common) for _ in range(8)]  # eight words in every document
    rows, want = [], set()
    for k in range(150):
        p = [rng.choice(common) for _ in range(60)]
        p[20:28] = boiler
        q = list(p)
        for at in rng.sample(range(len(q)), 1):  # one word of 60: about 0.8
            q[at] = f"e{k}"
        sides = [set(zip(*(w[i:] for i in range(5)), strict=False)) for w in (p, q)]
        if len(sides[0] & sides[1]) / len(sides[0] | sides[1]) >= 0.8:
            want.add((1000 + k, k))
        for doc, w in ((k, p), (1000 + k, q)):
            rows.append((doc, " ".join([rng.choice(common) for _ in range(80)] + w + [rng.choice(common) for _ in range(80)])))
    got = {(r["doc_id"], r["other_id"]) for r in substring_dedup.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(want) > 100 and len(got & want) >= 0.9 * len(want)
    assert not {p for p in got if p[0] - 1000 != p[1]}


def test_pipeline_stages_one_by_one(spark, docs, labels):
    docs = docs.select("*", F.lit("x").alias("more"))
    model = quality_classifier.fit(docs, labels)
    good = {r["doc_id"] for r in quality_classifier.score(docs, model).where("score >= 0.3").collect()}
    first = corpus_pipeline.quality(spark, docs, SF)
    assert sorted(r["doc_id"] for r in first.collect()) == sorted(good)
    second = corpus_pipeline.line_dedup(spark, first, SF)
    assert Counter(repr((r["doc_id"], r["text"])) for r in second.collect()) == deduped(Counter((r["doc_id"], r["text"]) for r in first.collect()), long=50)
    third = corpus_pipeline.near_dedup(spark, second, SF)
    fourth = corpus_pipeline.decontamination(spark, third, SF)
    assert {r["doc_id"] for r in third.collect()} - {r["doc_id"] for r in fourth.collect()} == {r["doc_id"] for r in decontamination.find_leaks(third, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    lengths = Counter()
    for r in corpus_pipeline.packing(spark, fourth, SF).collect():
        lengths[r["doc_id"]] += r["length"]
    assert lengths == Counter({r["doc_id"]: len(t.encode(r["text"], add_special_tokens=False).ids) + 1 for r in fourth.collect()})


def test_passages_read_documents_twice(spark, tmp_path, monkeypatch):
    """Windows are made of all texts, words of those that are linked; open pairs and all verification take these words."""
    rng = random.Random(21)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    common, more = some(30), some(30)
    texts = [some(30) + common + some(30) for _ in range(12)]
    texts += [some(20) + common + some(1) + more + some(20) for _ in range(2)]  # a link that only open_pairs() finds
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS).write.parquet(str(tmp_path / "docs"))
    read, write = [], substring_dedup.materialize
    reads = lambda df: any(f"{tmp_path}/docs" in f for f in df.inputFiles())
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, name, lasting=False: (reads(df) and read.append(name), write(df, name, lasting))[1])
    rows = substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / "docs")))
    assert len(read) == 2 and not reads(rows)
    assert {(r["doc_id"], r["other_id"]) for r in rows.collect()} == {(13, 12)}


def test_passages_count_words_with_spaces_beyond_ascii(spark):
    """U+00A0 and U+3000 are parts of words, when passages are found and when they are verified."""
    rng = random.Random(22)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    p = [f"{w}\u00a0x\u3000y" for w in some(60)]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(1, " ".join(some(7) + p + some(9))), (2, " ".join(some(5) + p))], DOCS)).collect()
    assert [(r["doc_id"], r["other_id"], r["start_word"], r["n_words"], r["other_start"], r["other_words"]) for r in rows] == [(2, 1, 5, 60, 7, 60)]


def test_passages_pair_kinds_of_a_crowd(spark, monkeypatch):
    """Documents of a crowd that go on alike beside a run are one kind when ends are paired; all pairs of them and the others are still verified."""
    rng = random.Random(23)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    base = some(60)
    texts = [some(30) + base + some(30) for _ in range(40)]
    texts += [some(20) + base[:27] + some(1) + base[28:40] + some(50) for _ in range(3)]  # 31 shingles of them: no passage
    written, write = {}, substring_dedup.materialize
    monkeypatch.setattr(substring_dedup, "materialize", lambda df, name, lasting=False: written.setdefault(name, write(df, name, lasting)))
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)).collect()
    assert {x for r in rows for x in (r["doc_id"], r["other_id"])} == set(range(40))
    assert {(r["doc_id"], r["o_doc_id"]) for r in written["rest"].collect()} >= {(y, x) for y in (40, 41, 42) for x in range(40)}
    assert 0 < written["kinds"].count() <= 2 * 6 * substring_dedup.GAP


def test_passages_are_found_beside_another_link_of_their_documents(spark):
    """Two documents with a passage of theirs share a second one, over an edited word, whose keys stand in so many other documents that they are not paired; both are found."""
    rng = random.Random(24)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    left, right, other = some(27), some(27), some(60)
    texts = [some(40) + left + some(60) + right + some(40) for _ in range(12)]  # 27 words of them: no passage
    texts += [other + some(250) + left + some(1) + right + some(40) for _ in range(2)]
    rows = substring_dedup.repeated_passages(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)).collect()
    assert sorted((r["doc_id"], r["other_id"], r["start_word"], r["n_words"], r["other_start"], r["other_words"]) for r in rows) == [(13, 12, 0, 60, 0, 60), (13, 12, 310, 55, 310, 55)]


def test_passages_hold_equal_words_of_texts_that_repeat_themselves():
    """Every word of 50 that stand in the other text too is in a passage, on both sides, also where single shingles repeat."""
    rng = random.Random(25)
    for _ in range(300):
        a, b = ([w for _ in range(rng.randrange(2, 7)) for w in [rng.choice("uvw")] * rng.randrange(5, 60)] for _ in range(2))
        at = rng.randrange(max(1, len(a) - 55))
        b[rng.randrange(len(b)) : 0] = a[at : at + 55]
        found = substring_dedup.passages(*(substring_dedup.shingles([w.encode() for w in t]) for t in (a, b)))
        runs = [{tuple(t[k : k + 50]) for k in range(len(t) - 49)} for t in (a, b)]
        for t, other, side in ((a, runs[1], 0), (b, runs[0], 2)):
            held = {w for f in found for w in range(f[side], f[side + 1] + 5)}
            assert all(w in held for k in range(len(t) - 49) if tuple(t[k : k + 50]) in other for w in range(k, k + 50))
        assert all(s == 1 or s >= substring_dedup.SIMILARITY for *_, s in found)
