"""Phrase collocations by stripes: each prefix keys an associative counter of its next words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch, text_or_empty

#: Bytes of text whose stripes a task holds at once; a longer text is cut where a piece ends.
CHUNK = 4 << 20
#: Bits of the fixed-size bitmap that tells tasks which phrases can be frequent (8 MB, whatever the corpus).
BITS = 1 << 26
#: Counters that pairs, and longer phrases, share by their hash before they are counted exactly (a byte each for counts to 255),
#: and the rows that they are dealt into: a phrase has a counter in each, by hashes of their own.
COUNTERS, ROWS = 1 << 24, 2
#: Elements of stripes that a task adds up before it sends them on.
HELD = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS_PIECE, _ENDS_WORD = np.zeros(256, bool), np.zeros(256, bool)
_ENDS_PIECE[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_ENDS_WORD[list(b".,;:!?\x0a\x0b\x0c\x0d \t")] = True
_CUT = re.compile(rb"[.,;:!?\x0a-\x0d]")
_STRIPE = "lang string, words int, prefix string, next array<string>, n array<long>"
_SCHEMA = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("prefix", pa.string()), ("next", pa.list_(pa.string())), ("n", pa.list_(pa.int64()))])


class Words:
    """The words of some texts in order: a number for each (language, word), and the piece that each word stands in."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        known = {x: k for k, x in enumerate(dict.fromkeys(langs))}
        self.langs, of_text = list(known), np.array([known[x] for x in langs], np.int64)
        raw = np.frombuffer(b"\n".join(texts), np.uint8)
        word = ~_ENDS_WORD[raw]
        edge = np.diff(word, prepend=False, append=False) if len(raw) else np.zeros(0, bool)
        at = np.flatnonzero(edge)
        starts, ends = at[::2], at[1::2]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[word]])])
        coded = data.dictionary_encode()
        lengths = np.array([len(t) + 1 for t in texts], np.int64)
        text_of = np.searchsorted(np.cumsum(lengths), starts, side="right")
        self.piece = np.searchsorted(np.flatnonzero(_ENDS_PIECE[raw]), starts)
        self.ids, both = pd.factorize(of_text[text_of] * max(1, len(coded.dictionary)) + coded.indices.to_numpy())
        self.lang = both // max(1, len(coded.dictionary))
        self.words = coded.dictionary.take(pa.array(both % max(1, len(coded.dictionary)))).cast(pa.large_string())

    @cached_property
    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each (language, word)."""
        return word_hashes([self.langs[k] for k in self.lang], self.words.to_pylist())


def word_hashes(langs: list[str], words: list[str]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(f"{x} {w}") for x, w in zip(langs, words, strict=True)), np.uint64, len(words))


def phrase_hashes(parts: list[np.ndarray], bits: int, row: int = 0) -> np.ndarray:
    """The places of phrases in a bitmap of so many bits (a power of two), from the hashes of their words; each row has a hash of its own."""
    out = parts[0].copy()
    for h in parts[1:]:
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h
    out ^= out >> np.uint64(32)
    for _ in range(row):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(29)
    return (out * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(65 - bits.bit_length())


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    """The texts in parts of about CHUNK bytes, at word boundaries that no phrase crosses."""
    texts, langs, size = [], [], 0
    few = (batch.slice(at, 64) for batch in batches for at in range(0, batch.num_rows, 64))  # become Python objects at once
    for batch in few:
        for text, lang in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lang").to_pylist(), strict=True):
            at = 0
            while at < len(text):
                cut = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
                end = cut.end() if cut else len(text)
                texts.append(text[at:end])
                langs.append(lang)
                size, at = size + end - at, end
                if size >= CHUNK:
                    yield Words(texts, langs)
                    texts, langs, size = [], [], 0
    if texts:
        yield Words(texts, langs)


#: Distinct phrases of some texts: the words of their prefixes, their last words, and how often each stands.
Counts = tuple[list[np.ndarray], np.ndarray, np.ndarray]


def _elements(w: Words, counts: Counts) -> pa.Table:
    """Counted phrases as rows (lang, words, prefix, next, n)."""
    prefix, following, n = counts
    lang = pa.array(w.langs, pa.string()).take(pa.array(w.lang[following]))
    names = [w.words.take(pa.array(x)) for x in prefix]
    name = pc.binary_join_element_wise(*names, pa.scalar(" ", pa.large_string())).cast(pa.string()) if names else pa.array([""] * len(following), pa.string())
    return pa.table([lang, pa.array(np.full(len(following), len(prefix) + 1, np.int32)), name, w.words.take(pa.array(following)).cast(pa.string()), pa.array(n.astype(np.int64))], names=["lang", "words", "prefix", "next", "n"])


def _stripes(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
    """The elements of some parts added up, as one stripe for each prefix."""
    if not parts:
        return
    by = ["lang", "words", "prefix"]
    rows = pa.concat_tables(parts).group_by([*by, "next"]).aggregate([("n", "sum")]).sort_by([(c, "ascending") for c in by]).combine_chunks()
    columns = [rows.column(c).combine_chunks() for c in by]
    new = np.ones(rows.num_rows, bool)
    new[1:] = np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns], axis=0)
    first = np.flatnonzero(new)
    ends = pa.array(np.concatenate([first, [rows.num_rows]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, rows.column(c).combine_chunks()) for c in ("next", "n_sum")]
    yield pa.RecordBatch.from_arrays([*[c.take(pa.array(first)) for c in columns], *lists], schema=_SCHEMA)


def _in(bitmap: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
    """Whether the bits of phrases are set: in a bitmap, or in every row of a sketch."""
    out = np.ones(len(hashes[0]), bool)
    for row, bits in enumerate(np.atleast_2d(bitmap)):
        at = phrase_hashes(hashes, 64 * len(bits), row)
        out &= (bits[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def count_words(w: Words) -> Iterator[Counts]:
    """The stripe of the empty prefix, one for each language."""
    yield [], np.arange(len(w.lang)), np.bincount(w.ids, minlength=len(w.lang))


def count_pairs(w: Words, frequent: np.ndarray, sketch: np.ndarray | None) -> Iterator[Counts]:
    """The stripes of single words, over pairs of words that may both be frequent."""
    may = _in(frequent, [w.hashes])[w.ids]
    i = np.flatnonzero(may[:-1] & may[1:] & (w.piece[:-1] == w.piece[1:]))
    pairs, n = np.unique(w.ids[i] * len(w.lang) + w.ids[i + 1], return_counts=True)
    yield from _sketched(w, ([pairs // len(w.lang)], pairs % len(w.lang), n), sketch)


def count_longer(w: Words, frequent: np.ndarray, sketch: np.ndarray | None, longest: int) -> Iterator[Counts]:
    """The stripes of two words and more, over runs of which every pair, and every phrase so far, may be frequent."""
    size, h = len(w.lang), w.hashes
    inside = np.flatnonzero(w.piece[:-1] == w.piece[1:])
    codes, pairs = pd.factorize(w.ids[inside] * size + w.ids[inside + 1])
    words = [pairs // size, pairs % size]
    may = _in(frequent, [h[x] for x in words])
    code = np.full(len(w.ids) + 1, -1)  # of the phrase so far that begins at a word
    code[inside[may[codes]]] = codes[may[codes]]
    for k in range(2, longest):
        at = np.flatnonzero((code[:-1] >= 0) & (code[1:] >= 0))  # both parts of k words, which overlap
        codes, grams = pd.factorize(code[at] * size + w.ids[np.minimum(at + k, len(w.ids) - 1)])
        words = [*(x[grams // size] for x in words), grams % size]
        may = np.ones(len(grams), bool) if sketch is None else _in(sketch, [h[x] for x in words])
        if may.any():
            yield [x[may] for x in words[:-1]], words[-1][may], np.bincount(codes, minlength=len(grams))[may]
        code = np.full(len(w.ids) + 1, -1)
        code[at[may[codes]]] = codes[may[codes]]


def _sketched(w: Words, counts: Counts, sketch: np.ndarray | None) -> Iterator[Counts]:
    """Only the phrases that may be frequent by a sketch."""
    prefix, last, n = counts
    keep = slice(None) if sketch is None else _in(sketch, [w.hashes[x] for x in [*prefix, last]])
    prefix, last, n = [x[keep] for x in prefix], last[keep], n[keep]
    if len(last):
        yield prefix, last, n


def stripes(docs: DataFrame, count: Callable[[Words], Iterator[Counts]]) -> DataFrame:
    """Rows (lang, words, prefix, next, n): the stripes of docs (lang, text), added up within a task as far as HELD elements go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for w in _chunks(batches):
            if len(w.lang):
                held += [_elements(w, counts) for counts in count(w)]
            if sum(t.num_rows for t in held) > HELD:
                yield from _stripes(held)
                held = []
        yield from _stripes(held)

    return docs.mapInArrow(run, _STRIPE)


def sketched(docs: DataFrame, count: Callable[[Words], Iterator[Counts]], min_count: int, counters: int) -> np.ndarray:
    """A bitmap for each of ROWS rows of counters (a power of two in all): which of them, that phrases share by their hash, reach min_count.

    Each task fills one vector of counters that stop at min_count; blocks of these
    are shuffled and added up as they come. The bitmaps are what comes to the driver. A phrase
    must reach min_count in every row: one row alone lets through what shares a counter with a
    frequent phrase, whose number grows with both the phrases and the frequent ones.
    """
    each = max(64, counters // ROWS)
    counters, block = each * ROWS, min(each, 1 << 16)
    kind = np.min_scalar_type(min_count)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, kind)
        for w in _chunks(batches):
            if len(w.lang):
                for prefix, last, n in count(w):
                    parts = [w.hashes[x] for x in [*prefix, last]]
                    for row in range(ROWS if len(last) else 0):
                        at = phrase_hashes(parts, each, row).astype(np.int64) + row * each
                        order = np.argsort(at)
                        at, first = np.unique(at[order], return_index=True)
                        sums = np.add.reduceat(n[order], first) + total[at]
                        total[at] = np.minimum(sums, min_count)
        for k in np.flatnonzero(total.reshape(-1, block).any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * block : (k + 1) * block].tobytes()], pa.binary())], names=["block", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums = np.frombuffer(counts, kind).astype(np.int64) + total.get(k, 0)
                total[k] = np.minimum(sums, min_count).astype(kind)
        for k, counts in total.items():
            bits = np.packbits(counts >= min_count, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])

    out = np.zeros(counters // 64, np.uint64)
    rows = docs.mapInArrow(fill, "block int, counts binary").repartition("block").mapInArrow(add_up, "block int, bits binary")
    for k, bits in rows.collect():
        out.view(np.uint8)[k * block // 8 : (k + 1) * block // 8] = np.frombuffer(bits, np.uint8)
    return out.reshape(ROWS, -1)


def merged(parts: DataFrame) -> DataFrame:
    """Rows (lang, words, prefix, next, f): the stripes added up element by element.

    A stripe is a map from next words to counts. Its elements are rows here, so
    that the stripe of a word that a third of all places hold is added up in many tasks.
    """
    each = parts.select("lang", "words", "prefix", F.explode(F.arrays_zip("next", "n")).alias("e"))
    return each.groupBy("lang", "words", "prefix", F.col("e.next").alias("next")).agg(F.sum("e.n").alias("f"))


def _bitmap(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of so many bits, set for every phrase of (lang, prefix, next); what comes to the driver is bounded by them."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, phrases = batch.column("lang").to_pylist(), [[w for w in (p, x) if w] for p, x in zip(batch.column("prefix").to_pylist(), batch.column("next").to_pylist(), strict=True)]
            for size in {len(p) for p in phrases}:
                some = [k for k, p in enumerate(phrases) if len(p) == size]
                at = phrase_hashes([word_hashes([langs[k] for k in some], [phrases[k][i] for k in some]) for i in range(size)], bits)
                set_ = (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(set_)], names=["word", "bits"])

    out = np.zeros(bits // 64, np.int64)
    rows = frequent.select("lang", "prefix", "next").mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    for part in rows.toArrow().to_batches():
        out[part.column("word").to_numpy()] = part.column("bits").to_numpy()
    return out.view(np.uint64)


def frequent_phrases(docs: DataFrame, min_count: int = 100, longest: int = 5, bits: int = BITS, counters: int = COUNTERS) -> tuple[DataFrame, DataFrame]:
    """(phrases, totals): the phrases of at most `longest` words that occur min_count times, and the words of each language.

    docs: (lang, text), no nulls. phrases: (lang, words, prefix, next, f), where
    prefix is '' for single words; totals: (lang, n). Stripes are made of words, then of pairs,
    then of longer phrases. A phrase cannot be frequent where a part is not: which parts are, tasks
    read from a bitmap of fixed size. Of the rest, a pass before the stripes counts by hash in a
    vector of fixed size, and only phrases whose counters all reach min_count get into stripes, which count
    exactly. A bit or counter that several phrases share lets more through and loses none. On a corpus
    for which they are too small, more is shuffled and the result is the same.
    """
    spark, enough = docs.sparkSession, F.col("f") >= min_count
    words = materialize(merged(stripes(docs, count_words)), "words")
    found = [level := materialize(words.where(enough), "phrases1")]
    for k, count in ((2, count_pairs), (3, partial(count_longer, longest=longest))):
        if k <= longest:
            frequent = spark.sparkContext.broadcast(_bitmap(level, bits))
            sketch = spark.sparkContext.broadcast(sketched(docs, lambda w, c=count, f=frequent: c(w, f.value, None), min_count, counters))
            level = merged(stripes(docs, lambda w, c=count, f=frequent, s=sketch: c(w, f.value, s.value)))
            found.append(level := materialize(level.where(enough), f"phrases{k}"))
    phrases = found[0]
    for x in found[1:]:
        phrases = phrases.unionByName(x)
    return phrases, words.groupBy("lang").agg(F.sum("f").alias("n"))


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, share: int = 100, top: int = 2000, bits: int = BITS, counters: int = COUNTERS, text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): each language's first `top` phrases.

    A-Z is lower-cased, texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these into words
    `[^\\x20\\x09]+`. n counts the words of a language, a the places of a phrase of 2 to
    `longest` words that has min_count of them. A cut after the first words
    gives l and r, the places of both parts, and floor(1000 a n / (l r)); the
    least counts, ties to the first cut. A phrase goes when a candidate that is longer and
    holds it has at least `share` percent of its places: as counts never grow
    with length, the two extensions by one word decide that.

    Null texts are empty, null languages 'und'; rows are told apart by nothing,
    so repeated rows count as often as they stand. Very long texts are counted
    in parts. Ties in score and places are ordered by the phrase's bytes. No
    rows, or no phrase with min_count places, give no rows; extra columns are not
    read. Arithmetic is exact where 1000 a n has at most 38 digits.
    """
    body = text_or_empty(text)
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), body.alias("text"))
    with scratch(docs.sparkSession):
        phrases, totals = frequent_phrases(rows, min_count, longest, bits, counters)
        named = F.when(F.col("prefix") == "", F.col("next")).otherwise(F.concat_ws(" ", "prefix", "next"))
        known = materialize(phrases.select("lang", "words", named.alias("phrase"), "f"), "known")
        candidates = known.where("words > 1").withColumnRenamed("f", "a")
        part = lambda at, n: F.array_join(F.slice(F.split("phrase", " "), at, n), " ")
        # One-word extensions, at the right and at the left: the most places any of them has.
        longer = known.where("words > 2")
        extended = longer.select("lang", F.explode(F.array(part(F.lit(1), F.col("words") - 1), part(F.lit(2), F.col("words") - 1))).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
        kept = candidates.join(extended, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
        cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
        cuts = cuts.withColumns({"left": part(F.lit(1), F.col("k")), "right": part(F.col("k") + 1, F.col("words") - F.col("k"))})
        side = lambda name, count: known.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
        cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        score = F.expr("(CAST(1000 AS DECIMAL(5,0)) * _a * _n) div (_l * _r)")
        cuts = cuts.withColumns({f"_{c}": wide(c) for c in "alrn"}).withColumn("score", score)
        best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
        order = Window.partitionBy("lang").orderBy(F.col("c.score").desc(), F.col("a").desc(), "phrase")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        return materialize(ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "c.l", "c.r", "n", "c.score"), "collocations", lasting=True)
