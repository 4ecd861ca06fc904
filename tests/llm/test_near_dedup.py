"""The pipeline's near-dedup stage against all pairs."""

import random

import corpus_pipeline
from recordsmith.llm import near_dedup


def _edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"e{rng.randrange(10**6)}"
    return out


def _rows(spark):
    rng = random.Random(5)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    some = [f"z{k}" for k in range(2000)]
    for base in range(6):  # crowds of copies, edited so that some pairs are near and some are not
        words = [rng.choice(some) for _ in range(300)]
        rows += [(10_000 + 100 * base + k, " ".join(_edited(rng, words, rng.randrange(2, 9)))) for k in range(25)]
    passage = [rng.choice(some) for _ in range(50)]
    return rows + [(20_000 + k, " ".join(passage + [rng.choice(some) for _ in range(k)])) for k in range(40)]


def test_components_of_all_pairs(spark):
    rows = _rows(spark)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: near_dedup.shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and 4 * max(len(sets[i]), len(sets[j])) <= 5 * min(len(sets[i]), len(sets[j])) and near_dedup.near(sets[i], sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert sum(root[i] != i for i in root if i >= 10_000) > 50
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, df, "").collect())
    assert kept == sorted(i for i in root if root[i] == i)
