"""Approximate nearest neighbours against all inner products, and on odd rows."""

import math

import numpy as np
import pytest

from recordsmith.llm import neighbours as N
from recordsmith.llm.queries import QUERIES


def plain(rows, k=20, every=20):
    """All inner products: each query's k best of the other ids, by (id, vector)."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    out = {}
    for i, v in rows:
        if i % every == 0:
            scored = [(-math.fsum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got = out.setdefault(r["query_id"], [])
        got.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got) and r["vec_id"] != r["query_id"]
    return out


def recall(got, want):
    """Of the wanted ranks, those whose score is found; checks that scores are true and in order."""
    hit = total = 0
    for q, best in want.items():
        mine = got.get(q, [])
        assert len(mine) == len(best)
        assert all(a[1] > b[1] or (a[1] == b[1] and a[0] < b[0]) for a, b in zip(mine, mine[1:], strict=False))
        hit += sum(s >= best[-1][1] - 1e-9 for _, s in mine)
        total += len(best)
    return hit / max(1, total)


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 0, "x") for i, v in rows], "vec_id long, embedding array<double>, shard int, hash string").repartition(4)


@pytest.mark.parametrize("shard", [N.SHARD, 300])
def test_recall_of_the_query(spark, shard):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    x, ids = np.array([v for _, v in rows], np.float64), np.array([i for i, _ in rows])
    got = found(N.nearest_neighbours(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), shard=shard))
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        s[ids == q] = -np.inf
        hit += len({i for i, _ in got[q]} & set(ids[np.argsort(-s)[:20]].tolist()))
    assert hit >= 0.95 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_norms_copies_and_ties(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 12)) * rng.lognormal(size=(900, 1)), 3)
    x[100:400] = x[100]  # a third of all rows is one vector
    rows = [(int(i), v) for i, v in enumerate(x)]
    got, want = found(N.nearest_neighbours(frame(spark, rows), shard=200)), plain([(i, v.tolist()) for i, v in rows])
    assert recall(got, want) >= 0.95
    copies = [i for i in want if 100 <= i < 400]
    assert all(got[i] == got[copies[0]] or set(j for j, _ in got[i]) ^ set(j for j, _ in got[copies[0]]) for i in copies)
    exact = [q for q in want if {j for j, _ in got[q]} == {j for j, _ in want[q]}]
    assert len(exact) >= 0.8 * len(want) and all([j for j, _ in got[q]] == [j for j, _ in want[q]] for q in exact)


def test_few_candidates_are_all_found(spark):
    rows = [(20, [1, 0]), (40, [0, 1]), (1, [1, 1]), (2, [-1, -1]), (60, [1, 2, 3])]
    got = found(N.nearest_neighbours(frame(spark, rows)))
    assert got == plain(rows) | {} and 60 not in got or got.get(60, []) == []
    assert [j for j, _ in got[20]] == [1, 40, 2] and [j for j, _ in got[40]] == [1, 20, 2]


def test_odd_rows(spark):
    good = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (0, [2.0, 1.0]), (7, [3.0, 3.0]), (7, [3.0, 3.0]), (8, [1e300, 1.0])]
    bad = [(None, [1.0, 1.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0])]
    df = frame(spark, good + bad).union(spark.createDataFrame([(120, [None, 1.0], 0, "x")], "vec_id long, embedding array<double>, shard int, hash string"))
    rows = N.nearest_neighbours(df).collect()
    assert {r["query_id"] for r in rows} == {0} and {r["vec_id"] for r in rows} == {7, 8}
    assert len(rows) == 4  # two vectors under the query's id, two lists
    assert N.nearest_neighbours(df.limit(0)).count() == 0
    assert N.nearest_neighbours(df.where("vec_id = 60")).count() == 0


def test_graph_reaches_every_node():
    rng = np.random.default_rng(1)
    x = N._padded(N._directions(np.concatenate([rng.normal(size=(200, 8)) * 0.01 + 9, rng.normal(size=(200, 8)) * 0.01 - 9, np.eye(8)])))
    near, entries = N.build_graph(x, degree=6, beam=12)
    reached, edge = set(entries.tolist()), list(entries.tolist())
    while edge:
        edge = [j for i in edge for j in near[i].tolist() if j < len(x) - 1 and j not in reached and not reached.add(j)]
    assert len(reached) == len(x) - 1


def test_query(spark):
    df = QUERIES["op11_approximate_neighbours"](spark, "/root/testdata/sf0.001")
    assert df.columns == ["query_id", "rank", "vec_id", "score"] and df.count() == 25 * 20
