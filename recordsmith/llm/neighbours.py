"""Approximate nearest neighbours by largest inner product: robust-pruned directed graphs, one for each shard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch

#: Vectors of a shard on average: what one task holds. Every query searches every shard, so with more memory take larger ones.
SHARD = 8192
#: Queries that search a shard in one task on average.
QUERIES = 50_000
#: Edges that leave a node, nodes of a beam when a graph is built and when it is searched, and how much farther than
#: direct a way round may be for an edge to go.
DEGREE, BUILD_BEAM, BEAM, RELAXED = 32, 64, 128, 1.2
#: A shard's longest vectors, where every search begins, too.
LONGEST = 32
#: Beam nodes that are expanded at once.
_AT_ONCE = 4

_INDEX = "dim int, shard int, node int, entry boolean, vec array<double>, ids array<long>, near array<int>"
_FOUND = "query_id long, query_hash long, vec_id array<long>, score array<double>"


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Negative inner products of vectors x[ids] and q, row by row; infinite for the padding node."""
    d = -np.matmul(x[ids], q[:, :, None])[:, :, 0]
    d[ids == len(x) - 1] = np.inf
    return d


def _alone(ids: np.ndarray, nothing: int) -> np.ndarray:
    """Rows of ids without repeats, padded at their ends and no wider than need be."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = nothing
    ids = np.sort(ids, axis=1)
    return ids[:, : max(1, int((ids < nothing).sum(axis=1).max(initial=0)))]


def beam_search(x: np.ndarray, near: np.ndarray, entries: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(the width best nodes of each query, best first; all nodes it expanded), padded with the node after the last.

    Greedy search by inner products: the best nodes of the beam that are not expanded yet bring
    in their neighbours, until the beam holds expanded nodes only. x and near end with a row of padding.
    """
    nothing, rows = len(x) - 1, np.arange(len(q))[:, None]
    seen = np.zeros((len(q), len(x)), bool)
    seen[:, nothing] = True
    seen[:, entries] = True
    ids = np.full((len(q), max(width, len(entries))), nothing)
    ids[:, : len(entries)] = entries
    dist = _distances(x, ids, q)
    fresh, path = ids < nothing, []
    while fresh.any():
        d = np.where(fresh, dist, np.inf)
        pick = np.argpartition(d, min(_AT_ONCE, d.shape[1]) - 1, axis=1)[:, :_AT_ONCE]
        expanded = np.where(np.isfinite(np.take_along_axis(d, pick, 1)), np.take_along_axis(ids, pick, 1), nothing)
        np.put_along_axis(fresh, pick, False, 1)
        path.append(expanded)
        new = near[expanded].reshape(len(q), -1)
        new[seen[rows, new]] = nothing
        new = _alone(new, nothing)
        seen[rows, new] = True
        ids, fresh = np.concatenate([ids, new], axis=1), np.concatenate([fresh, new < nothing], axis=1)
        dist = np.concatenate([dist, _distances(x, new, q)], axis=1)
        if ids.shape[1] > width:
            best = np.argpartition(dist, width - 1, axis=1)[:, :width]
            ids, dist, fresh = (np.take_along_axis(a, best, 1) for a in (ids, dist, fresh))
    order = np.argsort(dist, axis=1)
    return np.take_along_axis(ids, order, 1), np.concatenate(path, axis=1)


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, relaxed: float = RELAXED) -> np.ndarray:
    """The out-edges of nodes: from the nearest candidate on, each edge shuts out those that it is a good way to."""
    nothing, out = len(x) - 1, []
    for at in range(0, len(of), 256):
        me, ids = of[at : at + 256], candidates[at : at + 256].copy()
        ids[ids == me[:, None]] = nothing
        ids = _alone(ids, nothing)
        d = 2 + 2 * _distances(x, ids, x[me])  # squared distances of unit vectors
        order = np.argsort(d, axis=1)
        ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
        between = (2 - 2 * np.matmul(v := x[ids], v.transpose(0, 2, 1))) * relaxed**2
        alive, kept, n = np.isfinite(d), np.full((len(me), degree), nothing), np.zeros(len(me), int)
        for t in range(ids.shape[1]):
            chosen = np.flatnonzero(alive[:, t] & (n < degree))
            if len(chosen):
                kept[chosen, n[chosen]] = ids[chosen, t]
                n[chosen] += 1
                alive[chosen] &= between[chosen, t] > d[chosen]
        out.append(kept)
    return np.concatenate(out) if out else np.zeros((0, degree), int)


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries) over unit vectors x, of which the last row is padding.

    Nodes come in random order, in batches that grow with the graph. Each batch
    searches the graph so far; what the search met is pruned to its edges, and the way
    back is added to the nodes it now points to, which are pruned again when they have
    too many. Nodes that can't be reached from the entry become entries too.
    """
    n = len(x) - 1
    near, degrees = np.full((n + 1, degree), n), np.zeros(n + 1, int)
    order = np.random.default_rng(seed).permutation(n)
    first = int(np.argmax(x[:n] @ x[:n].mean(axis=0)))
    order, done, entries = order[order != first], 0, np.array([first])
    while done < len(order):
        batch = order[done : done + min(512, 1 + done, max(16, (1 << 22) // n))]
        done += len(batch)
        nearest, path = beam_search(x, near, entries, x[batch], beam)
        near[batch] = robust_prune(x, batch, np.concatenate([nearest, path], axis=1), degree)
        degrees[batch] = (near[batch] < n).sum(axis=1)
        to, back = near[batch].ravel(), np.repeat(batch, degree)
        to, back = to[to < n], back[to < n]
        by = np.lexsort((-np.einsum("ij,ij->i", x[to], x[back]), to))
        to, back = to[by], back[by]
        place = np.arange(len(to)) - np.searchsorted(to, to)  # 0 for the nearest of each node
        fits = degrees[to] + np.bincount(to, minlength=n + 1)[to] <= degree
        near[to[fits], degrees[to[fits]] + place[fits]] = back[fits]
        full = np.unique(to[~fits])
        more, some = np.full((len(full), degree), n), ~fits & (place < degree)
        more[np.searchsorted(full, to[some]), place[some]] = back[some]
        near[full] = robust_prune(x, full, np.concatenate([near[full], more], axis=1), degree)
        touched = np.unique(to)
        degrees[touched] = (near[touched] < n).sum(axis=1)
    reached = np.zeros(n + 1, bool)
    reached[n] = True
    while True:
        edge = entries[-1:]
        while len(edge):
            reached[edge] = True
            edge = np.unique(near[edge])
            edge = edge[~reached[edge]]
        if reached.all():
            return near, entries
        entries = np.append(entries, np.argmin(reached))


def _padded(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.zeros((1, x.shape[1]))]).astype(np.float32)


def _directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors as unit vectors; components of any size are brought down first."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy().reshape(-1, dim)


def _edges(near: np.ndarray) -> pa.ListArray:
    """Rows of edges without their padding, which is at the ends."""
    real = near < len(near)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(real.sum(axis=1))]).astype(np.int32)), pa.array(near[real].astype(np.int32)))


def _usable(rows: DataFrame) -> DataFrame:
    """Rows of (vec_id, vec) that take part: with an id and finite components, one of them at least not zero."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where("vec_id is not null and vec is not null").where(finite & F.exists("vec", lambda v: v != 0)).withColumns({"dim": F.size("vec"), "hash": F.xxhash64("vec")})


def build_index(rows: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """The index of (vec_id, vec): one row for each distinct vector, (dim, shard, node, entry, vec, ids, near).

    Copies of a vector are one node, with their k+1 least ids: no query's k nearest can need more,
    whatever id is its own. Nodes are dealt to shards by their hash, among
    vectors of their length; a shard is one graph and one task. The graph is that of their directions, so
    long vectors don't stand apart in it; a search orders what it meets by inner products,
    and begins at the longest vectors and at the middle.
    """
    distinct = _usable(rows).groupBy("dim", "hash", "vec", "vec_id").agg(F.lit(1).alias("one"))
    least = distinct.withColumn("place", F.row_number().over(Window.partitionBy("dim", "hash", "vec").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    nodes = materialize(least.groupBy("dim", "hash", "vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    sizes = materialize(nodes.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards")), "sizes")
    dealt = nodes.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("hash"), "shards").cast("int").alias("shard"), "vec", "ids")

    def build(part: pa.Table) -> pa.Table:
        dim = part.column("dim")[0].as_py()
        part = part.take(pa.array(np.argsort([i[0].as_py() for i in part.column("ids")], kind="stable")))
        vectors = _matrix(part.column("vec"), dim)
        near, entries = build_graph(_padded(_directions(vectors)))
        scaled = vectors / np.abs(vectors).max()
        entry = np.zeros(part.num_rows, bool)
        entry[entries] = True
        entry[np.argsort(-(scaled * scaled).sum(axis=1), kind="stable")[:LONGEST]] = True
        made = [part.column("dim"), part.column("shard"), pa.array(np.arange(part.num_rows, dtype=np.int32)), pa.array(entry), part.column("vec"), part.column("ids"), _edges(near[:-1])]
        return pa.table(made, names=["dim", "shard", "node", "entry", "vec", "ids", "near"])

    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, _INDEX), "index")


def _found(index: pa.Table, queries: pa.Table, k: int, beam: int) -> Iterator[pa.RecordBatch]:
    """The k+1 best ids that a shard has for each query, with their exact scores."""
    index = index.sort_by("node")
    dim, n = index.column("dim")[0].as_py(), index.num_rows
    vectors = _matrix(index.column("vec"), dim)
    x = _padded(vectors / np.abs(vectors).max())
    lists = index.column("near").combine_chunks()
    counts, near = np.diff(lists.offsets.to_numpy()), np.full((n + 1, max(1, DEGREE)), n)
    near[np.repeat(np.arange(n), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = lists.flatten().to_numpy()
    entries, ids = np.flatnonzero(index.column("entry").to_numpy(zero_copy_only=False)), [np.array(i.as_py()) for i in index.column("ids")]
    size = max(16, min(256, (1 << 22) // n))
    for at in range(0, queries.num_rows, size):
        part = queries.slice(at, size)
        q = _matrix(part.column("vec"), dim)
        nearest, _ = beam_search(x, near, entries, _directions(q).astype(np.float32), max(beam, 2 * k))
        vec_id, score = [], []
        for row, v in zip(nearest, q, strict=True):
            row = row[row < n]
            s = (vectors[row] * v).sum(axis=1)
            names = [ids[r] for r in row]
            every, scores = np.concatenate(names), np.repeat(s, [len(i) for i in names])
            best = np.lexsort((every, -scores))[: k + 1]
            vec_id.append(every[best])
            score.append(scores[best])
        yield pa.RecordBatch.from_arrays([part.column("query_id").combine_chunks(), part.column("query_hash").combine_chunks(), pa.array(vec_id, pa.list_(pa.int64())), pa.array(score, pa.list_(pa.float64()))], names=["query_id", "query_hash", "vec_id", "score"])


def search(index: DataFrame, queries: DataFrame, k: int = 20, beam: int = BEAM) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best of the index for queries (vec_id, vec), without a query's own id.

    Every query searches every shard of its length; the shards' best are ranked by exact inner products.
    """
    asked = _usable(queries).groupBy("dim", "hash", "vec", "vec_id").agg(F.lit(1).alias("one")).drop("one")
    asked = materialize(asked.select("dim", F.col("vec_id").alias("query_id"), F.col("hash").alias("query_hash"), "vec"), "queries")
    turns = max(1, -(-asked.count() // QUERIES))
    shards = materialize(index.select("dim", "shard").distinct(), "shards")
    sent = asked.withColumn("turn", F.pmod(F.xxhash64("query_id", "query_hash"), F.lit(turns)).cast("int")).join(shards, "dim")
    held = index.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("query_hash", pa.int64()), ("vec_id", pa.list_(pa.int64())), ("score", pa.list_(pa.float64()))])
        found = list(_found(left, right, k, beam)) if left.num_rows and right.num_rows else []
        return pa.Table.from_batches(found, schema)

    keys = ["dim", "shard", "turn"]
    found = held.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(run, _FOUND)
    each = found.select("query_id", "query_hash", F.explode(F.arrays_zip("vec_id", "score")).alias("c")).select("query_id", "query_hash", "c.*").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.col("score").desc(), "vec_id")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found for each row whose id is divisible by `every`.

    Nearness is the largest inner product in double precision, over all rows but
    those of the query's own id; ties go to smaller ids. Every row is indexed. The search is approximate, its scores are exact;
    where there are no more than k candidates, all are found.

    Vectors that are null, zero, empty or hold null or non-finite components,
    and rows without an id, take no part. Vectors are compared with those of their own length. Rows that repeat
    id and vector count once; an id with several vectors is a candidate, and a query, with each of them.
    No rows give no rows; extra columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec"))
    with scratch(vectors.sparkSession):
        index = build_index(rows, k, shard)
        return materialize(search(index, rows.where(F.col("vec_id") % every == 0), k, beam), "neighbours", lasting=True)
