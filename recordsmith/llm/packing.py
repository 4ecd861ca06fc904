"""Best-fit packing of token sequences with a bounded number of open bins."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize, text_or_empty

#: Distinct words whose ids a worker keeps.
MEMO = 600_000
#: Texts that are cut into words at once, which bounds a worker's memory.
BATCH = 500
#: Open bins of a packer.
OPEN_BINS = 512
#: Tokens for a shard, which one task packs as a stream; and the most shards.
SHARD_TOKENS, MOST_SHARDS = 1 << 25, 20_000


#: Pre-tokens of the tokenizer, for text that is already lower-cased.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Words of these characters are their own normal form and have one lower case everywhere.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space, as little-endian 32-bit bytes.

    Pre-tokens never cross white space, so a text's ids are those of its words,
    and a plain word's ids are those of its pre-tokens. The library encodes each
    distinct pre-token, and each word of other characters, once.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str], chunk: int = 4000) -> list[bytes]:
        """Ids of plain pre-tokens: many in one text, cut after the tokens that end a word."""
        out: list[bytes] = []
        for at in range(0, len(pieces), chunk):
            some = pieces[at : at + chunk]
            ids = np.array(self.tokenizer.encode(" ".join(some), add_special_tokens=False).ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(ends) == len(some) and (not some or ends[-1] == 4 * len(ids)):
                raw = ids.tobytes()
                out += [raw[i:j] for i, j in pairwise([0, *ends.tolist()])]
            else:
                out += self._encode(some)
        return out

    def _fresh(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of words that are not known yet."""
        plain, other, new, get = {}, [], {}, self.pieces.get
        for w in words:
            core = w.rstrip(b".,;:!?")
            if core.isalpha():  # ASCII letters, then at most one run of marks
                parts = (core.lower().decode(),) if len(core) == len(w) else (core.lower().decode(), w[len(core) :].decode())
            elif _PLAIN.fullmatch(t := w.decode()):
                parts = (t.lower(),) if t.isalpha() else _SPLIT.findall(t.lower())
            else:
                other.append(w)
                continue
            plain[w] = parts
            for p in parts:
                if get(p) is None:
                    new[p] = None
        made = dict(zip(new, self._encode_pieces(list(new)), strict=True))
        out = dict(zip(other, self._encode([w.decode() for w in other]), strict=True)) if other else {}
        if len(self.pieces) < MEMO:
            self.pieces |= made
            made = {}
        for w, parts in plain.items():
            ids = [made[p] if (b := get(p)) is None else b for p in parts]
            out[w] = ids[0] if len(ids) == 1 else b"".join(ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if any(s in t.lower() for s in self.special) else t.encode().split() for t in texts]  # bytes: at ASCII white space only
        get, ids, missing = self.known.get, [], []
        for words in cut:
            found, at = list(map(get, words or ())), -1
            gaps = []
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                gaps.append(at)
            ids.append(found)
            missing.append(gaps)
        fresh = self._fresh(list({words[i] for words, gaps in zip(cut, missing, strict=True) for i in gaps}))
        out = []
        for t, words, found, gaps in zip(texts, cut, ids, missing, strict=True):
            for i in gaps:
                found[i] = fresh[words[i]]
            out.append(self._encode([t])[0] if words is None else b"".join(found))
        if len(self.known) < MEMO:
            self.known |= fresh
        return out


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def token_pieces(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, size: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids) of at most `size` tokens.

    ids are little-endian unsigned 32-bit; end_id follows each document. Only
    longer documents are cut. Null texts are empty: one piece with end_id alone.
    """
    stop = np.asarray([end_id], "<u4").tobytes()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(path)
        for part in parts:
            for at in range(0, len(part), BATCH):
                some = part.iloc[at : at + BATCH]
                rows = []
                for doc, ids in zip(some["doc_id"], encoder.encode(some["text"].tolist()), strict=True):
                    ids += stop
                    doc = None if pd.isna(doc) else int(doc)
                    rows += [(doc, p, p * size, len(ids[b : b + 4 * size]) // 4, ids[b : b + 4 * size]) for p, b in enumerate(range(0, len(ids), 4 * size))]
                made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])
                made["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
                yield made

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).mapInPandas(run, PIECES)


class Packer:
    """Online best-fit with a fixed number of open bins, in a bitset keyed by free space."""

    def __init__(self, size: int, open_bins: int = OPEN_BINS):
        self.size, self.open_bins, self.open, self.made = size, open_bins, 0, 0
        self.bits = 0  # bit f: an open bin has f tokens free
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        seq = self.bins[free].pop()
        if not self.bins[free]:
            del self.bins[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return seq

    def add(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for the next piece: the open bin with the least room that suffices, or a new one."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.size, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            self.bins.setdefault(left, []).append(seq)
            self.bits |= 1 << left
            self.open += 1
        return seq, self.size - free


def pack(pieces: DataFrame, *, size: int = 4096, open_bins: int = OPEN_BINS, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset; every other column is kept.

    Pieces are dealt by hash to shards of about SHARD_TOKENS tokens, and each
    shard is a stream that one task packs with open_bins bins in memory, whatever
    its length. Arrival order is by a hash, so lengths come well mixed. A shard
    leaves at most open_bins bins unfilled, a small part of its thousands.
    Ties, nulls and repeated rows need nothing special: any order packs validly,
    and no rows give no rows.
    """
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    shards = int(min(MOST_SHARDS, max(1, round(total / SHARD_TOKENS))))
    mixed = F.xxhash64(*order, F.lit(3))
    mix, at = fresh(pieces, "mix", "shard")
    dealt = pieces.withColumns({mix: mixed, at: F.pmod(mixed, F.lit(shards)).cast("int")})
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, packer = None, Packer(size, open_bins)
        for part in parts:
            placed = []
            for s, n in zip(part[at].tolist(), part["length"].tolist(), strict=True):
                if s != shard:
                    shard, packer = s, Packer(size, open_bins)
                seq, offset = packer.add(n)
                placed.append((s << 40 | seq, offset))
            part["sequence_id"] = np.array([p[0] for p in placed], "int64")
            part["offset"] = np.array([p[1] for p in placed], "int64")
            yield part

    # By partition number: hashing the shard numbers would put several shards into one task.
    sorted_shards = dealt.repartitionById(shards, at).sortWithinPartitions(at, mix, *order)
    return sorted_shards.mapInPandas(run, schema).drop(mix, at)


def pack_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", *, size: int = 4096, end_id: int = 1, keep_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack documents; one row for each piece with its ids (keep_ids) and their CRC-32."""
    pieces = token_pieces(docs, path, doc_id, text, size=size, end_id=end_id).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), size=size)
