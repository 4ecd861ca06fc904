"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, scratch, text_or_empty
from .components import connected_components

#: Pairs of the four 16-bit quarters of a fingerprint; two differing bits leave two quarters whole.
BANDS = tuple((a, b) for a in range(4) for b in range(a + 1, 4))
_SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the text as a signed integer; 0 without words.

    A-Z is lower-cased, words are runs of anything but space and \\t..\\r, and
    shingles count as often as they occur. A bit is set when more than half of
    the shingle hashes (XXH64, seed 42) have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, len(grams), _CHUNK):  # bounded memory for very long texts
        part = np.frombuffer(b"".join([digest(g, _SEED) for g in grams[at : at + _CHUNK]]), np.uint8)
        counts += np.unpackbits(part.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(grams)).tobytes(), "big", signed=True)


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in texts:
        yield pd.Series([fingerprint(t) for t in part], dtype="int64")


def pivots(n: int = 12, seed: int = 7) -> list[int]:
    """n reference fingerprints, the same on every run."""
    rng = random.Random(seed)
    return [rng.getrandbits(64) - 2**63 for _ in range(n)]


def pivot_distances(fp: Column, refs: list[int]) -> list[Column]:
    """The fingerprint's row of the distance table: d0, d1, ... to every pivot."""
    return [F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte").alias(f"d{i}") for i, p in enumerate(refs)]


def links(fps: DataFrame, max_bits: int = 2, crowd: int = 64, refs: list[int] | None = None) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints (column fp) up to two differing bits.

    The distance table to the pivots is computed once. By the triangle
    inequality the coordinates of two linked fingerprints differ by max_bits at
    most, so candidates are found by an equi-join that probes the first pivot's
    distances within max_bits, among fingerprints that agree in two quarters of
    their bits (two differing bits leave such a pair whole). Pairs with a larger
    difference in any other coordinate are discarded, survivors are verified. A
    bucket of more than `crowd` fingerprints is not paired: each
    member is listed under every fingerprint within one bit that keeps the quarters,
    and members of one list are at most two bits apart, so each is linked to the
    smallest. That keeps connectivity exactly and stays linear in the bucket.
    """
    if max_bits > 2:
        raise ValueError("two whole quarters and the crowd rule hold for at most two bits")
    refs = refs or pivots()
    fp = F.col("fp")
    banded = fps.select(fp, F.explode(F.array(*[F.struct(F.lit(b).alias("band"), fp.bitwiseAND(F.lit(_mask(q))).alias("bits")) for b, q in enumerate(BANDS)])).alias("k")).select("fp", "k.*")
    sizes = materialize(banded.groupBy("band", "bits").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = materialize(banded.join(sizes, ["band", "bits"]), "bands")
    few = shared.where(F.col("n") <= crowd).select("band", "bits", "fp", *pivot_distances(fp, refs))
    probes = few.withColumn("probe", F.explode(F.array(*[(F.col("d0") + F.lit(k).cast("byte")).cast("byte") for k in range(max_bits + 1)])))
    near = F.greatest(*[F.abs(F.col(f"a.d{i}") - F.col(f"b.d{i}")) for i in range(1, len(refs))]) <= max_bits
    verified = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    once = (F.col("a.d0") < F.col("b.d0")) | (F.col("a.fp") < F.col("b.fp"))
    on = (F.col("a.band") == F.col("b.band")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.probe") == F.col("b.d0")) & once
    paired = probes.alias("a").join(few.alias("b"), on & near & verified).select(F.least("a.fp", "b.fp").alias("u"), F.greatest("a.fp", "b.fp").alias("v"))
    flips = F.lit(None).cast("array<bigint>")
    for b, quarters in enumerate(BANDS):
        keep = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if i // 16 not in quarters])
        flips = F.when(F.col("band") == b, keep).otherwise(flips)
    listed = shared.where(F.col("n") > crowd).select("fp", F.explode(flips).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("centre"))
    least = listed.groupBy("centre").agg(F.min("fp").alias("u"), F.max("fp").alias("most")).where("u <> most").drop("most")
    starred = listed.join(least, "centre").select("u", F.col("fp").alias("v")).where("u <> v")
    return paired.unionByName(starred).distinct()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _mask(quarters: tuple[int, ...]) -> int:
    return _signed(sum(0xFFFF << 16 * q for q in quarters))


def simhash_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each input row.

    component_id is the smallest doc_id reachable over links of at most two
    differing bits. Copies share a fingerprint and are not paired. Null texts
    count as empty (fingerprint zero, linked like any other); a null doc_id
    keeps its row and never names a component unless all ids in it are null.
    Repeated rows stay; extra columns are not read; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    with scratch(docs.sparkSession):
        marked = materialize(rows.select("doc_id", _fingerprints("text").alias("fp")), "simhash", lasting=True)
        distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
        roots = connected_components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
        labelled = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        named = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
        by_fp = materialize(labelled.join(named, "root").select("fp", "component_id"), "components", lasting=True)
    return marked.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
