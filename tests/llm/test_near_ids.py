"""The pipeline's near-dedup stage on null and repeated ids."""

import random

import corpus_pipeline


def test_null_and_repeated_ids(spark):
    rng = random.Random(8)
    texts = [" ".join(f"n{rng.randrange(10**6)}" for _ in range(80)) for _ in range(6)]
    near = texts[0] + " end"
    rows = [(None, near), (7, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[4]), (6, texts[4]), (None, None), (9, texts[5]), (8, texts[5])]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, got)) == sorted(map(key, [(7, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[3]), (5, texts[4]), (None, None), (8, texts[5])]))
