"""Cross-tokenizer alignment with an identity map from token to token of the same bytes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, text_or_empty
from .token_counts import load

#: Bytes of text that are aligned at once and share one look-up of their irregular pairs; a longer text is a part of its own.
CHUNK = 2 << 20
#: Distinct parts of texts that a worker remembers; then it starts anew.
MEMO = 150_000
#: Longer parts are aligned but not remembered.
LONG = 64
#: Characters of parts that are encoded as one text.
SLAB = 1 << 15
#: A pair of ids is one number: the A id above, the B id below.
LOW = (1 << 32) - 1

_EDGES = re.compile(r"\s\s|^\s|\s$")
_DOC = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, same array<int>, odd array<long>"
_CELL = "part long, fast boolean, pair long, n long"
_OUT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in a byte-level vocabulary: printable bytes are themselves, others follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def parts_of(text: str) -> list[str]:
    """The parts of a text that both tokenizers treat alone; a part p stands for ' ' + p, and they make up ' ' + text.

    A cut is made at single spaces between two characters that are no white space.
    Byte-level BPE starts a pre-token there, and the pieces of B, of which none has
    a space after another character, can't reach across.
    """
    cut = text.split(" ")
    if not _EDGES.search(text):
        return cut
    out: list[str] = []
    for part in cut:
        if out and (not part or part[0].isspace() or not out[-1] or out[-1][-1].isspace()):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


class Aligner:
    """Aligns texts by their parts, each distinct part once while it is remembered."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = load(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, k in vocabulary.items():
            self.bytes_a[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        #: Whether parts can be aligned alone: no piece has a space after another character.
        self.by_part = not any(re.search("[^▁]▁", p) for p in pieces)
        #: The B id of the same bytes for each A id, -1 where there is none; of two such pieces the one that is no byte.
        of_bytes = {x: k for k, x in sorted(enumerate(self.bytes_b), key=lambda e: not self.b.is_byte(e[0])) if not (self.b.is_control(k) or self.b.is_unknown(k))}
        self.same = np.array([of_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        self.said = [str(k) for k in range(max(len(self.bytes_a), len(self.bytes_b)))]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.numbers = np.zeros((0, 5), np.int64)  # tokens of A, of B, groups, links' first place and number; -1 groups: other bytes
        self.links = np.zeros(0, np.int64)
        self.held, self.new_numbers, self.new_links = 0, [], []

    def _learn(self, parts: list[str]) -> None:
        """Align parts and append them to the tables, many in one text where both tokenizers cut between them."""
        slab, size = [], 0
        for p in parts:
            alone = not p or p[0].isspace() or p[-1].isspace()
            if slab and (alone or size > SLAB):
                self._append(slab)
                slab, size = [], 0
            slab.append(p)
            size += len(p)
            if alone:
                self._append(slab)
                slab, size = [], 0
        if slab:
            self._append(slab)

    def _append(self, parts: list[str]) -> None:
        """Tables of parts that are encoded as one text; where its bytes are not kept, those of each half."""
        text = " ".join(parts)
        x, y, raw = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text), (" " + text).encode()
        if b"".join([self.bytes_a[k] for k in x]) != raw or b"".join([self.bytes_b[k] for k in y]) != raw:
            if len(parts) > 1:
                self._append(parts[: len(parts) // 2])
                self._append(parts[len(parts) // 2 :])
            else:
                self._table([""], np.array([[0, 0, -1, 0]]), np.zeros(0, np.int64))
            return
        ids_a, ids_b = np.array(x, np.int64), np.array(y, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        both, i, j = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
        begin_a, begin_b = np.concatenate([[0], i[:-1] + 1]), np.concatenate([[0], j[:-1] + 1])
        said_a, said_b = [self.said[k] for k in x], [self.said[k] for k in y]
        single = ((begin_a == i) & (begin_b == j)).tolist()
        said = [
            said_a[m] + "|" + said_b[n] if one else ",".join(said_a[a : m + 1]) + "|" + ",".join(said_b[b : n + 1])
            for one, a, m, b, n in zip(single, begin_a.tolist(), i.tolist(), begin_b.tolist(), j.tolist(), strict=True)
        ]
        ends = np.cumsum([len(p.encode()) + 1 for p in parts])
        upto = [np.searchsorted(e, ends, side="right") for e in (ends_a, ends_b, both)]
        numbers = np.stack([np.diff(u, prepend=0) for u in (*upto, upto[2])], axis=1)
        groups = upto[2].tolist()
        self._table([";".join(said[a:b]) for a, b in zip([0, *groups], groups, strict=False)], numbers, ids_a[i] << 32 | ids_b[j])

    def _table(self, groups: list[str], numbers: np.ndarray, links: np.ndarray) -> None:
        """numbers: tokens of A, of B, groups and links of each part."""
        first = self.held + np.cumsum(numbers[:, 3]) - numbers[:, 3]
        self.groups += groups
        self.new_numbers.append(np.column_stack([numbers[:, :3], first, numbers[:, 3]]))
        self.new_links.append(links)
        self.held += len(links)

    def _settle(self) -> None:
        """What _learn() has appended becomes part of the tables."""
        self.numbers = np.concatenate([self.numbers, *self.new_numbers])
        self.links = np.concatenate([self.links, *self.new_links])
        self.new_numbers, self.new_links = [], []

    def align(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(numbers of each text: n_a, n_b, n_groups, n_links; its pairs one after the other; its groups' digest)."""
        if len(self.known) > MEMO:
            self.forget()
        cut = [(parts_of(t) if self.by_part else [t]) if t else [] for t in texts]
        get, known = self.known.get, self.known
        new = list(dict.fromkeys(p for parts in cut for p in parts if p not in known))
        first = len(self.groups)
        if new:
            self._learn(new)
            self._settle()
            known.update(zip(new, range(first, first + len(new)), strict=True))
        n = np.array([len(parts) for parts in cut], np.int64)
        at = np.fromiter((get(p) for parts in cut for p in parts), np.int64, int(n.sum()))
        of = np.repeat(np.arange(len(texts)), n)
        numbers = self.numbers[at]
        bad = np.zeros(len(texts), bool)
        bad[of[numbers[:, 2] < 0]] = True
        bad |= n == 0
        numbers[bad[of], :3] = numbers[bad[of], 4] = 0
        sums = np.stack([np.bincount(of, numbers[:, k], len(texts)).astype(np.int64) for k in (0, 1, 2, 4)], axis=1)
        many = numbers[:, 4]
        pairs = self.links[np.repeat(numbers[:, 3] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
        digests, end = [], 0
        for k, size in enumerate(n.tolist()):
            said = [self.groups[i] for i in at[end : end + size].tolist()]
            digests.append("" if bad[k] else hashlib.sha256(";".join(said).encode()).hexdigest())
            end += size
        for p in new:  # long parts are seldom seen again
            if len(p) > LONG:
                del known[p]
        return sums, pairs, digests


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def _lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values, kind))


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (part, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, same, odd) of docs (doc_id, text).

    same: the A ids of groups of two tokens of the same bytes, one for each group.
    odd: the pairs of other groups. part numbers texts that were aligned together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = _aligner(path_a, path_b), TaskContext.get().partitionId() << 32

        def made(ids: list, texts: list[str]) -> pa.RecordBatch:
            sums, pairs, digests = aligner.align(texts)
            fast, of = aligner.same[pairs >> 32] == (pairs & LOW), np.repeat(np.arange(len(texts)), sums[:, 3])
            count = lambda which: np.bincount(of[which], minlength=len(texts))
            columns = [pa.array(np.full(len(texts), part)), pa.array(ids, pa.int64()), *[pa.array(sums[:, k]) for k in range(4)], pa.array(digests, pa.string())]
            columns += [_lists(pairs[fast] >> 32, count(fast), pa.int32()), _lists(pairs[~fast], count(~fast), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "same", "odd"])

        ids, texts, size = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # a few texts at a time become Python strings
                some = batch.slice(at, 64)
                for i, text in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist(), strict=True):
                    ids.append(i)
                    texts.append(text)
                    size += len(text)
                    if size >= CHUNK:
                        yield made(ids, texts)
                        ids, texts, size, part = [], [], 0, part + 1
        if ids:
            yield made(ids, texts)

    return docs.mapInArrow(run, _DOC)


def cells(links: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows (part, fast, pair, n): what each task and part has of a pair.

    Pairs of the same bytes are counted in a vector as long as A's vocabulary, one
    for each task (part is null); others once for each part that holds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = _aligner(path_a, path_b).same
        vector = np.zeros(len(same), np.int64)

        def made(part: pa.Array, fast: bool, pair: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([part, pa.array(np.full(len(pair), fast)), pa.array(pair), pa.array(n)], names=["part", "fast", "pair", "n"])

        for batch in batches:
            vector += np.bincount(batch.column("same").flatten().to_numpy(), minlength=len(same))
            parts, odd = batch.column("part").to_numpy(), batch.column("odd")
            turns = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(turns, turns[1:], strict=False):
                pair, n = np.unique(odd.slice(a, b - a).flatten().to_numpy(), return_counts=True)
                yield made(pa.array(np.full(len(pair), parts[a])), False, pair, n)
        a = np.flatnonzero(vector)
        yield made(pa.nulls(len(a), pa.int64()), True, a << 32 | same[a], vector[a])

    return links.select("part", "same", "odd").mapInArrow(run, _CELL)


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one for each input row.

    A is byte-level BPE of the tokenizers library and encodes ' ' + text, B a
    sentencepiece model that puts the space before by itself; strings of special tokens are plain text.
    Where tokens of both end at one byte, a group ends; its last two tokens are a
    link, whose count is how often the corpus has that pair linked. n_best: links
    whose count is the highest of their B id, ties included; count_sum: over links.

    An array, made once, maps A ids to the B id of the same bytes. Groups of two such
    tokens are counted in vectors as long as the vocabulary, and their counts go to
    every task in one such vector. Only pairs of other groups are shuffled: first the
    distinct ones of each part of the texts, for their sums, then these back to their parts.

    Null and empty texts, and texts whose tokens' bytes are not those of ' ' + text, have no
    tokens: zeros and an empty digest. Null or repeated ids keep their rows, and repeated rows
    count as often as they stand. Very long texts are a part of their own. No rows give no
    rows; extra columns are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    with scratch(docs.sparkSession):
        links = materialize(aligned(rows, path_a, path_b), "links")
        each = materialize(cells(links, path_a, path_b), "cells")
        summed = materialize(each.groupBy("pair").agg(F.sum("n").alias("n"), F.max("fast").alias("fast")), "pairs")
        of_b = F.col("pair").bitwiseAND(F.lit(LOW))
        most = summed.groupBy(of_b.alias("b")).agg(F.max("n").alias("most"))
        rated = materialize(summed.withColumn("b", of_b).join(most, "b").select("pair", "n", "fast", (F.col("n") == F.col("most")).alias("best")), "rated")
        vector = rated.where("fast").select("pair", "n", "best").toArrow()  # at most A's vocabulary
        a = vector.column("pair").to_numpy() >> 32
        count, best = np.zeros(max([0, *a.tolist()]) + 1, np.int64), np.zeros(max([0, *a.tolist()]) + 1, np.int64)
        count[a], best[a] = vector.column("n").to_numpy(), vector.column("best").to_numpy(zero_copy_only=False)
        fast = docs.sparkSession.sparkContext.broadcast((count, best))
        looked = each.where("not fast").select("part", "pair").distinct().join(rated.where("not fast").select("pair", "n", "best"), "pair").select("part", "pair", "n", "best")

        def finish(left: pa.Table, right: pa.Table) -> pa.Table:
            count, best = fast.value
            pair = right.column("pair").to_numpy()
            order = np.argsort(pair)
            pair, n, top = pair[order], right.column("n").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order].astype(np.int64)
            sums = np.zeros((2, left.num_rows), np.int64)
            done = 0
            for batch in left.to_batches():
                for name, of_count, of_best in (("same", count, best), ("odd", n, top)):
                    column = batch.column(name)
                    ids = column.flatten().to_numpy()
                    at = ids if name == "same" else np.searchsorted(pair, ids)
                    lengths = np.diff(column.offsets.to_numpy())
                    for k, values in enumerate((of_best, of_count)):
                        total = np.concatenate([[0], np.cumsum(values[at])])
                        ends = np.cumsum(lengths)
                        sums[k, done : done + batch.num_rows] += total[ends] - total[ends - lengths]
                done += batch.num_rows
            keep = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
            return keep.append_column("n_best", pa.array(sums[0])).append_column("count_sum", pa.array(sums[1])).append_column("groups_sha256", left.column("groups_sha256"))

        done = links.groupBy("part").cogroup(looked.groupBy("part")).applyInArrow(finish, _OUT)
        return materialize(done, "alignment", lasting=True)
