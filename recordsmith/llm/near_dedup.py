"""Near-duplicate documents: min-hash blocks, SimHash pivot distances and exact Jaccard similarity.

At a similarity of 0.8 two 64-bit SimHash fingerprints differ in 9.7 bits on
average, and in more than 26 once in five million pairs. No band of so many
bits is selective, so documents meet in blocks of min-hashes of their five-word
shingles. Inside a block the SimHash pivot table and the distance itself discard
pairs before any text is fetched, and the shingle sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, identity, materialize, scratch, text_or_empty
from .components import connected_components
from .decontamination import words_of
from .simhash import pivot_distances, pivots
from .substring_dedup import SHINGLE, shingles

#: Two documents are near copies when common shingles : all shingles is at least OVER : UNDER.
OVER, UNDER = 4, 5
#: Blocks of a document and min-hashes of a block: a pair of similarity 0.8 shares no block once in 38,000 pairs.
BANDS, ROWS = 20, 4
#: Differing bits of two fingerprints beyond which a pair is discarded.
MOST_BITS = 26
_CHUNK, _ROWS = 4096, 200_000
_ODD = np.random.default_rng(11).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFT = np.random.default_rng(12).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct 64-bit hashes of the text's five-word shingles.

    A text of fewer words is one shingle; a text without words is one shingle of its characters.
    """
    words = words_of(text or "")
    if len(words) >= SHINGLE:
        return np.unique(shingles(words))
    whole = b" ".join(words) if words else b"\0" + (text or "").encode()
    return np.array([xxhash.xxh64_intdigest(whole)], np.uint64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """The number of shingles that two sets have both."""
    return len(np.intersect1d(a, b, assume_unique=True))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two shingle sets is at least OVER : UNDER."""
    return (OVER + UNDER) * common(a, b) >= OVER * (len(a) + len(b))


def set_fingerprint(s: np.ndarray) -> int:
    """SimHash of a shingle set, as a signed integer: the bits that over half of the hashes have."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(s), 16 * _CHUNK):
        counts += np.unpackbits(s[at : at + 16 * _CHUNK].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(s)).tobytes(), "big", signed=True)


def block_keys(s: np.ndarray) -> list[int]:
    """One key for each band: a hash of its min-hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), _CHUNK):  # bounded memory for very long texts
        least = np.minimum(least, (s[at : at + _CHUNK, None] * _ODD + _SHIFT).min(axis=0))
    return [int.from_bytes(xxhash.xxh64_digest(band.tobytes(), k), "big", signed=True) for k, band in enumerate(least.reshape(BANDS, ROWS))]


@F.pandas_udf(T.StructType([T.StructField("sid", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))]))
def _marks(texts: pd.Series) -> pd.DataFrame:
    out = []
    for text in texts:
        s = shingle_set(text)
        out.append((xxhash.xxh3_128_digest(s.tobytes()), len(s), set_fingerprint(s), block_keys(s)))
    return pd.DataFrame(out, columns=["sid", "n", "fp", "keys"])


@F.pandas_udf(T.LongType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common(shingle_set(x), shingle_set(y)) for x, y in zip(a, b, strict=True)], dtype="int64")


def _exploded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (x, sid), one for each shingle of a set."""
    for part in parts:
        held: list[tuple[bytes, np.ndarray]] = []
        for sid, text in zip(part["sid"], part["text"], strict=True):
            held.append((sid, shingle_set(text)))
            if sum(len(s) for _, s in held[-64:]) > _ROWS or len(held) == 512:
                yield _shingle_rows(held)
                held = []
        if held:
            yield _shingle_rows(held)


def _shingle_rows(held: list[tuple[bytes, np.ndarray]]) -> pd.DataFrame:
    sids = np.empty(len(held), object)
    sids[:] = [sid for sid, _ in held]
    return pd.DataFrame({"x": np.concatenate([s for _, s in held]).view(np.int64), "sid": np.repeat(sids, [len(s) for _, s in held])})


def _measured(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of sets (u, v, and their sizes n and m) with both, the number of shingles that they share."""
    side = lambda k, t: texts.select(F.col("sid").alias(k), F.col("text").alias(t))
    return materialize(pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "n", "m", _common("a", "b").alias("both")), "measured")


def _links(measured: DataFrame) -> DataFrame:
    return measured.where((OVER + UNDER) * F.col("both") >= OVER * (F.col("n") + F.col("m"))).select("u", "v")


def _possible(a: str, b: str, n_pivots: int) -> Column:
    """What pairs must meet before texts are fetched: sizes, shingles that any other set has, pivots, bits."""
    col = lambda side, name: F.col(f"{side}.{name}")
    n, m = col(a, "n"), col(b, "n")
    sizes = UNDER * F.least(n, m) >= OVER * F.greatest(n, m)
    others = (OVER + UNDER) * F.least(n - col(a, "own"), m - col(b, "own")) >= OVER * (n + m)
    coordinates = F.greatest(*[F.abs(col(a, f"d{i}") - col(b, f"d{i}")) for i in range(n_pivots)]) <= MOST_BITS
    return sizes & others & coordinates & (F.bit_count(col(a, "fp").bitwiseXOR(col(b, "fp"))) <= MOST_BITS)


def _around_centre(a: str, b: str) -> Column:
    """False where two sets of one block cannot be near, by how each differs from the block's centre.

    What a set lacks of the centre and what it has besides are its differences. Two sets
    differ in all of both but for what they lack both and have both, and the latter
    leaves out shingles that only one set has. True where a set was not measured.
    """
    col = lambda side, name: F.col(f"{side}.{name}")
    alike = F.least(col(a, "lacks"), col(b, "lacks")) + F.least(col(a, "more") - col(a, "own"), col(b, "more") - col(b, "own"))
    differ = col(a, "lacks") + col(a, "more") + col(b, "lacks") + col(b, "more") - 2 * alike
    return F.coalesce((OVER + UNDER) * differ <= col(a, "n") + col(b, "n"), F.lit(True))


def near_components(docs: DataFrame) -> DataFrame:
    """Rows (id, h, component), one for each row of docs: documents linked by a similarity of 0.8 or more.

    Equal shingle sets are one. A set that shares a block has its shingles
    counted over all such sets, which tells how many of them any partner can
    have. Each set is first measured against its blocks' centres, the sets with the
    smallest part of shingles of their own, which joins a crowd of edited copies
    in linear time. Pairs of a block whose sets are still in different components
    are all tried, but for those that the counts, pivots, bits or the differences from the
    centre rule out.
    """
    with scratch(docs.sparkSession):
        return materialize(_near_components(docs), "components", lasting=True)


def _near_components(docs: DataFrame) -> DataFrame:
    refs = pivots()
    marked = materialize(_marked(docs), "sets")
    sets = materialize(marked.groupBy("sid").agg(F.min(F.struct("id", "h")).alias("d"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "distinct")
    many = materialize(sets.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("many")).where("many > 1").select("key"), "many")
    shared = materialize(sets.select("sid", "n", "fp", F.explode("keys").alias("key")).join(many, "key", "left_semi"), "shared")
    chosen = materialize(sets.select("sid", "d.*").join(shared.select("sid").distinct(), "sid", "left_semi"), "chosen")
    id_, h = identity()
    texts = docs.select(id_.alias("id"), h.alias("h"), text_or_empty().alias("text")).join(chosen.hint("merge"), ["id", "h"])
    texts = materialize(texts.groupBy("sid").agg(F.first("text").alias("text")), "texts")
    own = texts.mapInPandas(_exploded, "x long, sid binary").groupBy("x").agg(F.count("*").alias("sets"), F.min("sid").alias("sid")).where("sets = 1")
    own = materialize(own.groupBy("sid").agg(F.count("*").alias("own")), "own")
    placed = shared.join(own, "sid", "left").select("key", "sid", "n", "fp", F.coalesce("own", F.lit(0)).alias("own"), *pivot_distances(F.col("fp"), refs))
    placed = materialize(placed, "placed")
    mine = F.struct("sid", "n", "fp", "own", *[f"d{i}" for i in range(len(refs))])
    centres = materialize(placed.groupBy("key").agg(F.min_by(mine, F.struct(F.col("own") / F.col("n"), "sid")).alias("o")), "centres")

    def pair(a: str, b: str) -> list[Column]:
        low, high = (f(F.struct(f"{a}.sid", f"{a}.n"), F.struct(f"{b}.sid", f"{b}.n")) for f in (F.least, F.greatest))
        return [low["sid"].alias("u"), high["sid"].alias("v"), low["n"].alias("n"), high["n"].alias("m")]

    starred = placed.alias("a").join(centres, "key").where((F.col("a.sid") != F.col("o.sid")) & _possible("a", "o", len(refs)))
    first = _measured(starred.select(*pair("a", "o")).distinct(), texts)
    links = _links(first)
    roots = connected_components(links).select(F.col("node").alias("sid"), "root")
    rooted = materialize(placed.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    mixed = materialize(rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z")).where("a <> z").select("key"), "mixed")
    # Only sets of blocks with several components are left; each with its differences from the block's centre.
    centre = centres.join(mixed, "key", "left_semi").select("key", F.col("o.sid").alias("c"), F.col("o.n").alias("cn"))
    open_ = rooted.join(centre, "key").withColumns({"u": F.least("sid", "c"), "v": F.greatest("sid", "c")})
    both = F.when(F.col("sid") == F.col("c"), F.col("n")).otherwise(F.col("both"))
    open_ = open_.join(first.select("u", "v", "both"), ["u", "v"], "left").withColumns({"lacks": F.col("cn") - both, "more": F.col("n") - both})
    open_ = materialize(open_.drop("u", "v", "c", "cn", "both"), "open")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.root") < F.col("b.root")) & _possible("a", "b", len(refs)) & _around_centre("a", "b")
    rest = open_.alias("a").join(open_.alias("b"), on).select(*pair("a", "b")).distinct()
    rest = materialize(rest.join(first, ["u", "v"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = connected_components(links.unionByName(_links(_measured(rest, texts)))).select(F.col("node").alias("sid"), "root")
    return marked.join(roots, "sid", "left").select("id", "h", F.coalesce("root", "sid").alias("component"))


def _marked(docs: DataFrame) -> DataFrame:
    id_, h = identity()
    return docs.select(id_.alias("id"), h.alias("h"), _marks(text_or_empty()).alias("s")).select("id", "h", "s.*")


def one_per_component(docs: DataFrame) -> DataFrame:
    """docs with one document of each component: that of the smallest (doc_id, text hash), null ids last.

    Rows that agree in doc_id and text are one document, and one of them stays.
    Null texts count as empty; no rows give no rows; every column is kept.
    """
    a, b, fate = fresh(docs, "id", "h", "fate")
    id_, h = identity()
    doc = F.struct((F.col("id") == -(2**63)).alias("none"), "id", "h")
    with scratch(docs.sparkSession):
        marked = near_components(docs)
        several = marked.groupBy("component").agg(F.min(doc).alias("d"), F.count("*").alias("n")).where("n > 1")
        several = materialize(several.select("component", "d.id", "d.h"), "several")
        members = marked.join(several.withColumnsRenamed({"id": a, "h": b}), "component")
        stays = (F.col("id") == F.col(a)) & (F.col("h") == F.col(b))
        # Only documents that go, and those that may stand there twice.
        known = members.select(F.col("id").alias(a), F.col("h").alias(b), stays.alias(fate)).groupBy(a, b, fate).agg(F.count("*").alias("n")).where(~F.col(fate) | (F.col("n") > 1))
        known = materialize(known.drop("n"), "fates", lasting=True)
    found = docs.withColumns({a: id_, b: h}).join(known.hint("merge"), [a, b], "left")  # at every size, so that disk grows in proportion
    alone = found.where(F.col(fate).isNull())
    return alone.unionByName(found.where(fate).dropDuplicates([a, b])).select(*docs.columns)
