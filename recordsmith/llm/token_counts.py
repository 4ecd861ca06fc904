"""Token counts with a whole-token shortcut for byte-level BPE."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

#: Entries of a worker's memory of counted segments; beyond it, segments are counted again.
MEMO = 600_000
#: Single spaces are where a text may be cut: with white space beside one, runs of it matter.
_PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Segments of these characters are cut into pre-tokens here, others by the library.
_PLAIN = re.compile("[\\t\\n\\r -~\u00a1-\u024f]+")
_RUNS = re.compile(r"\s\s|^\s|\s$")


def whole_tokens(tokenizer) -> set[str]:
    """Vocabulary strings that encode alone as one token, proved by encoding every one.

    A vocabulary string is written in the byte alphabet of byte-level BPE, so it
    is decoded first; strings that are no whole UTF-8, or that the library
    splits or merges otherwise, fail the proof and stay out.
    """
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    texts = [t for t in (tokenizer.decode([i], skip_special_tokens=False) for i in vocab.values()) if t and "�" not in t]
    return {t for t, e in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True) if len(e.ids) == 1}


def load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=8)
def proved(path: str) -> frozenset[str]:
    """The whole tokens of a tokenizer file, proved once on the driver; at most its vocabulary."""
    return frozenset(whole_tokens(load(path)))


class Counter:
    """Counts the tokens of texts as the tokenizers library does.

    A text is cut at single spaces, where the tokenizer's own pattern always
    starts a new pre-token. A segment that is a whole token counts 1; only the
    rest is merged by the library, each distinct segment once.
    """

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        self.tokenizer = load(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = proved(path) if whole is None else whole
        self.known: dict[str, int] = {}
        self.pieces = dict.fromkeys(self.whole, 1)

    def _merged(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def segments(self, text: str) -> list[str] | None:
        """The text's segments, each with its leading space; None where it must be encoded whole."""
        if not text:
            return []
        if any(s in text for s in self.special):
            return None
        if _RUNS.search(text):
            return _regrouped(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def _fresh(self, segments: list[str]) -> dict[str, int]:
        """Counts of segments that are not known yet: whole tokens count 1, other pre-tokens are merged once."""
        cut, new, get = [], {}, self.pieces.get
        for s in segments:
            cut.append(_PRETOKEN.findall(s) if _PLAIN.fullmatch(s) else [s])
            for p in cut[-1]:
                if get(p) is None:
                    new[p] = None
        made = dict(zip(new, self._merged(list(new)), strict=True)) if new else {}
        if len(self.pieces) < MEMO:
            self.pieces |= made
            return {s: sum(map(get, parts)) for s, parts in zip(segments, cut, strict=True)}
        return {s: sum(get(p) or made[p] for p in parts) for s, parts in zip(segments, cut, strict=True)}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.segments(t) for t in texts]
        get, miss = self.known.get, set()
        for segs in cut:
            if segs is not None:
                miss.update(segs)
        miss = [s for s in miss if get(s) is None]
        fresh = self._fresh(miss) if miss else {}
        if len(self.known) < MEMO:
            self.known |= fresh
            fresh = {}
        out = []
        for text, segs in zip(texts, cut, strict=True):
            if segs is None:
                out.append(self._merged([text])[0])
            elif fresh:
                out.append(sum(fresh[s] if (n := get(s)) is None else n for s in segs))
            else:
                out.append(sum(map(get, segs)))
        return out


def _regrouped(text: str) -> list[str] | None:
    """Segments where white space runs occur: cut only at a single space between two other characters."""
    out: list[str] = []
    for part in text.split(" "):
        if out and (not part or part[0].isspace() or not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(" " + part if out else part)
    return out


_COUNTERS: dict[str, Counter] = {}


def _counter(path: str, whole: frozenset[str]) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path, whole)
    return _COUNTERS[path]


def _batches(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counter(path: str, get: Callable[[str, frozenset[str]], Counter] = _counter):
    """A pandas UDF from text to its number of tokens; the proof goes to the tasks with it."""
    whole = proved(path)

    @F.pandas_udf(T.LongType())
    def n_tokens(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = get(path, whole)
        for part in parts:
            yield pd.Series([n for batch in _batches(part.tolist()) for n in counter.counts(batch)], dtype="int64")

    return n_tokens


def count_tokens(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = 512) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit), one for each input row, in one pass without a shuffle.

    path is a byte-level BPE file of the tokenizers library. No begin, end or
    other special tokens are added; special strings inside a text are handled as
    the library does by default. Null texts count as empty (0 tokens). Null or
    repeated ids keep their rows; extra columns are not read.
    """
    body = text_or_empty(text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), token_counter(path)(body).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
