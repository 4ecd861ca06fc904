"""The training-data operators against brute force, and on odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from recordsmith.llm import decontamination, license_scan, line_dedup, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts
from recordsmith.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rs_id long"
LONG = " ".join(f"w{i % 5000}" for i in range(60_000))
ODD = [(1, None), (None, "a b c"), (2, ""), (2, ""), (3, " \n \t"), (4, LONG), (5, "Licensed under CC BY-NC 4.0."), (5, "Licensed under CC BY-NC 4.0."), (6, "a\x1cb  c <|endoftext|> d'S"), (7, "x"), (8, "x")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, None, None, 0, 9) for i, t in ODD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def test_simhash_against_all_pairs(docs, odd):
    rows = simhash.simhash_components(docs).collect()
    fps = {r["doc_id"]: int(r["fingerprint"], 16) for r in rows}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in fps:
        for j in fps:
            if i < j and (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert all(r["component_id"] == find(r["doc_id"]) for r in rows)
    assert simhash.simhash_components(odd).count() == len(ODD)
    assert simhash.simhash_components(odd.limit(0)).count() == 0


def test_crowded_buckets_link_like_pairs(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    fps = sorted({base ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for _ in range(150)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    from recordsmith.llm.components import connected_components

    roots = lambda crowd: {r["node"]: r["root"] for r in connected_components(simhash.links(df, crowd=crowd)).collect()}
    assert roots(8) == roots(10_000)


def test_line_dedup(spark, odd):
    a, b = "one\ntwo\nthree\nfour", "start\n one\ntwo\nthree\nend\none"
    df = spark.createDataFrame([(1, a), (2, b), (3, a), (4, "one\ntwo")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: a, 2: "start\nend\none", 4: "one\ntwo"}
    assert {r["doc_id"] for r in line_dedup.dedup_lines(odd).collect()} >= {1, None, 2, 3, 4, 6, 7}
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_packing_round_trip(odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    t, rows = Tokenizer.from_file(path), packing.pack_documents(odd, path).collect()
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0) and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"]
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= 4096
    for i, text in ODD:
        if i not in (2, 5):
            ids = b"".join(bytes(r["ids"]) for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]))
            assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == t.encode(text or "", add_special_tokens=False).ids + [1]


def test_token_counts(odd):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(odd, path).collect())
    assert got == sorted((str(i), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in ODD)
    counter = token_counts.Counter(path)
    hard = ["  two  spaces ", "\n\n a\n b", "it's 'S can't", "é ü  x", "a\x1c b", "日本語 text 12345 ½", " \t"]
    assert counter.counts(hard) == [len(t.encode(x, add_special_tokens=False).ids) for x in hard]


def test_licenses(odd):
    rows = license_scan.scan_licenses(odd).collect()
    assert len(rows) == len(ODD)
    five = [r for r in rows if r["doc_id"] == 5]
    assert all((r["n_base"], r["first_word"], r["base_labels"], r["score"]) == (1, 2, "cc-by-nc", 1.0) for r in five) and len(five) == 2


def test_quality(spark, odd, docs):
    assert quality_rules.quality_rules(odd).count() == len(ODD)
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = quality_classifier.classify(docs, labels).join(labels, "doc_id").where(F.col("held_out")).collect()
    assert sum((r["predicted"] == 1) == (r["quality"] == 1) for r in rows) >= 0.8 * len(rows)
    assert quality_classifier.classify(odd, labels.limit(0)).where("score between 0 and 1").count() == len(ODD)


def test_decontamination_recall():
    rng = random.Random(1)
    vocabulary = [f"v{k}".encode() for k in range(3000)]
    item = [rng.choice(vocabulary) for _ in range(40)]
    block = decontamination.Block.of([(9, b" ".join(item).decode())])
    found = 0
    for _ in range(50):
        x = list(item)
        for _ in range(8):
            x[rng.randrange(40)] = rng.choice(vocabulary)
        doc = [rng.choice(vocabulary) for _ in range(80)] + x + [rng.choice(vocabulary) for _ in range(80)]
        found += bool(decontamination.leaks(doc, block))
    assert found >= 45
    assert not decontamination.leaks([rng.choice(vocabulary) for _ in range(500)], block)


def test_repeated_passages(spark, odd):
    rng = random.Random(2)
    some = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    shared = some(60)
    rows = [(k, " ".join(some(100) + shared + some(100))) for k in range(5)] + [(9, " ".join(some(300)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} >= {(k, 0) for k in range(1, 5)}
    assert all(r["doc_id"] != 9 and r["other_id"] != 9 and abs(r["n_words"] - 60) <= 4 for r in got)
    assert substring_dedup.repeated_passages(odd).count() == 0
