"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, text_or_empty

#: Bytes of benchmark text that one pass over the documents may carry to the tasks.
BLOCK_BYTES = 8_000_000
#: Share of an item's words that may differ.
EDITS = 0.2
EMBEDDINGS, SAMPLES, BITS = 6, 8, 3
#: Words of the windows that are embedded at once (about 100 bytes each), but one window at least.
WINDOW_WORDS = 1 << 19

#: ASCII letters and digits and everything outside ASCII make words.
_TABLE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TABLE).split()


def edits_allowed(n: int) -> int:
    return int(EDITS * n)


@lru_cache(maxsize=4096)
def _choices(n: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """The random functions of the walks and the sampled places, for windows of n words."""
    steps = max(1, 2 * n)
    odd = np.stack([np.random.default_rng(1000 + e).integers(1, 2**62, steps, dtype=np.int64) | 1 for e in range(EMBEDDINGS)])
    return odd, [[np.random.default_rng([n, e, s]).integers(0, steps, BITS) for s in range(SAMPLES)] for e in range(EMBEDDINGS)]


def embed(windows: np.ndarray) -> np.ndarray:
    """CGK random-walk embeddings of rows of n symbols (-1: past the end): (embedding, row, step).

    At each step the symbol under the walker is output, and a random function of
    step and symbol tells whether it moves on. Equal rows walk alike, and rows
    a few edits apart meet again soon, so edit distance becomes Hamming distance.
    """
    rows, n = windows.shape
    odd, _ = _choices(n)
    flat = np.concatenate([windows, np.full((rows, 1), -1, np.int64)], axis=1).astype(np.int64).ravel()
    base = np.arange(rows) * (n + 1)
    at, out = np.zeros((EMBEDDINGS, rows), np.int64), np.empty((odd.shape[1], EMBEDDINGS, rows), np.int64)
    for j in range(odd.shape[1]):
        symbol = flat[base + at]
        out[j] = symbol
        at = np.minimum(at + (((symbol + 2) * odd[:, j, None] >> 40) & 1), n)
    return out.transpose(1, 2, 0)


def keys(windows: np.ndarray) -> np.ndarray:
    """LSH keys of rows of equal length: one for each embedding and bit sample."""
    rows, n = windows.shape
    walked, (_, places) = embed(windows), _choices(n)
    out = []
    for e in range(EMBEDDINGS):
        for s, sampled in enumerate(places[e]):
            key = np.full(rows, (n * 1009 + e) * 1009 + s, np.int64)
            for j in sampled:
                key = (key * np.int64(6364136223846793005) + walked[e, :, j] + 1442695040888963407) ^ (key >> 29)
            out.append(key)
    return np.stack(out, axis=1)


def best_edit(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(distance, start, end): the part of region with the least edit distance to item."""
    n, m = len(item), len(region)
    row, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        change = np.empty(m + 1, np.int64)
        change[0] = i
        diagonal, up = row[:-1] + (region != item[i - 1]), row[1:] + 1
        change[1:] = np.minimum(diagonal, up)
        came = np.empty(m + 1, np.int64)
        came[0] = origin[0]
        came[1:] = np.where(diagonal <= up, origin[:-1], origin[1:])
        slack = change - steps
        best = np.minimum.accumulate(slack)
        source = np.maximum.accumulate(np.where(slack == best, steps, 0))
        row, origin = best + steps, came[source]
    end = int(row.argmin())
    return int(row[end]), int(origin[end]), end


@dataclass
class Block:
    """A bounded block of benchmark items, in the form that tasks scan with."""

    ids: list[int]
    items: list[np.ndarray] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    seeds: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=dict)
    lsh: dict[int, list[int]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Block:
        block = cls([])
        found: dict[int, dict[int, set[tuple[int, int]]]] = defaultdict(lambda: defaultdict(set))
        lsh: dict[int, set[int]] = defaultdict(set)
        for item_id, text in rows:
            words = words_of(text)
            if not words:
                continue
            item = np.array([block.vocabulary.setdefault(w, len(block.vocabulary) + 1) for w in words], np.int64)
            n, k = len(item), edits_allowed(len(item))
            place = len(block.items)
            block.ids.append(item_id)
            block.items.append(item)
            bounds = [n * p // (k + 1) for p in range(k + 2)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                size = min(3, b - a)
                found[size][_gram(item[a : a + size].reshape(1, -1))[0]].add((n, a))
            for key in keys(item.reshape(1, -1))[0]:
                lsh[int(key)].add(place)
        block.seeds = {size: {g: sorted(v) for g, v in by.items()} for size, by in found.items()}
        block.lsh = {k: sorted(v) for k, v in lsh.items()}
        return block


def _gram(rows: np.ndarray) -> list[int]:
    code = np.zeros(len(rows), np.int64)
    for j in range(rows.shape[1]):
        code = code * np.int64(1_000_003) + rows[:, j]
    return code.tolist()


def leaks(words: list[bytes], block: Block) -> list[tuple[int, int, int, int]]:
    """(item's place, start, end, distance) for the items that stand in the words within the edits allowed.

    1. An item of n words cut into k + 1 parts keeps one part whole under k
       edits. Only windows around such a part of an item can pass, and no other
       window is embedded; this loses nothing.
    2. Those item-sized windows are embedded, and bit samples are looked up.
    3. Items that share a key are verified by exact edit distance.
    """
    ids = np.fromiter(map(block.vocabulary.get, words, repeat(0)), np.int64, len(words))
    starts: dict[int, set[int]] = defaultdict(set)
    for size, by in block.seeds.items():
        if len(ids) < size:
            continue
        code, known = np.zeros(len(ids) - size + 1, np.int64), np.ones(len(ids) - size + 1, bool)
        for j in range(size):
            part = ids[j : len(ids) - size + 1 + j]
            code = code * np.int64(1_000_003) + part
            known &= part > 0
        at = known.nonzero()[0]
        for p, g in zip(at.tolist(), code[at].tolist(), strict=True):
            for n, a in by.get(g, ()):
                k = edits_allowed(n)
                starts[n].update(range(max(0, p - a - k), min(len(ids) - 1, p - a + k) + 1))
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for n, at in starts.items():
        k, order = edits_allowed(n), np.array(sorted(at))
        padded = np.concatenate([ids, np.full(n, -1)])
        hits: dict[int, list[int]] = defaultdict(list)
        step = max(1, min(4096, WINDOW_WORDS // n))
        for lo in range(0, len(order), step):
            part = order[lo : lo + step]
            for s, row in zip(part.tolist(), keys(padded[part[:, None] + np.arange(n)]).tolist(), strict=True):
                for key in row:
                    for item in block.lsh.get(key, ()):
                        if not hits[item] or hits[item][-1] != s:
                            hits[item].append(s)
        for item, where in hits.items():
            done = -1
            for s in where:
                if s <= done:
                    continue
                lo, hi = max(0, s - k), min(len(ids), s + n + 2 * k)
                distance, a, b = best_edit(block.items[item], ids[lo:hi])
                if distance <= k:
                    found[item].append((lo + a, lo + b, distance))
                    done = lo + b - 1
                else:
                    done = s + k // 2
    return [(item, *span) for item, spans in found.items() for span in sorted(set(spans))]


LEAKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType())] + [T.StructField(c, T.LongType()) for c in ("item_id", "start_word", "end_word", "distance", "item_words")])


def _scan(docs: DataFrame, block: Block) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(doc, h, block.ids[i], a, b, d, len(block.items[i])) for doc, h, text in zip(part["doc_id"].array, part["h"].tolist(), part["text"], strict=True) for i, a, b, d in leaks(words_of(text), block)]
            yield pd.DataFrame({f.name: pd.array([None if pd.isna(r[k]) else int(r[k]) for r in rows], dtype="Int64") for k, f in enumerate(LEAKS.fields)})

    return docs.mapInPandas(run, LEAKS)


def blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The benchmark in blocks of about `size` bytes, one at a time; each is carried to the tasks whole."""
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / size))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).orderBy("i", "t")
        yield Block.of([(r["i"], r["t"]) for r in part.collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, h, item_id, start_word, end_word, distance, item_words): benchmark items found in documents.

    An item stands in a document when some window of it is at most a fifth of
    the item's words away in edits (similarity 0.8). Words are lower-cased runs
    of letters and digits. The benchmark is the stated query set, scanned
    against all documents in blocks of bounded size, one after the other; documents
    are read once a block, without a shuffle. An item of fewer than five words is
    found where it stands exactly; items without words and null items hold
    nothing. Null and empty texts hold nothing, repeated rows give repeated
    results, and no documents or no items give no rows; h is the text's
    hash, which with doc_id names a document where ids are null or repeated.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text_or_empty(text)).alias("h"), text_or_empty(text).alias("text"))
    found = None
    for block in blocks(benchmark):  # what earlier blocks found is written before the next one is built
        scanned = _scan(rows, block)
        found = scanned if found is None else materialize(found, "leaks").unionByName(scanned)
    return found


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row (doc_id, n_items, item_ids, n_passages, least_distance) for each document that holds a benchmark item.

    Documents are told apart by doc_id and text, so different texts under one id,
    or without one, have rows of their own; rows equal in both are one, with the passages of each.
    """
    found = find_leaks(docs, benchmark)
    return found.groupBy("doc_id", "h").agg(F.count_distinct("item_id").alias("n_items"), F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_passages"), F.min("distance").alias("least_distance")).drop("h")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; every other row stays as it is, also with null text or id."""
    a, b = fresh(docs, "id", "h")
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    # Written first, so that its size is known: where leaks are few, docs are not shuffled.
    found = materialize(find_leaks(docs, benchmark).select(known.alias(a), F.col("h").alias(b)).distinct(), "leaking")
    return docs.withColumns({a: known, b: F.xxhash64(text_or_empty())}).join(found, [a, b], "left_anti").select(*docs.columns)
