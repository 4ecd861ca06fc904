"""Cross-tokenizer alignment against the libraries' whole texts, and on odd rows."""

import hashlib
import random
from collections import Counter

import pytest

from recordsmith.llm import alignment as L
from recordsmith.llm.queries import QUERIES, tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    return a, b


def plain(texts, libraries):
    """Every text encoded whole, cut where tokens of both end, and counted over all texts."""
    a, b = libraries
    # The byte that each character of a byte-level vocabulary stands for, by its own rule.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    byte_of = {chr(x) if x in printable else chr(next(rest)): x for x in range(256)}

    def piece(k):
        p = b.id_to_piece(k)
        return bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode()

    rows = []
    for text in texts:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bx, by = [bytes(byte_of[c] for c in a.id_to_token(k)) for k in x], [piece(k) for k in y]
        if not text or not b"".join(bx) == b"".join(by) == (" " + text).encode():
            rows.append(None)
            continue
        ends = [[sum(map(len, z[: k + 1])) for k in range(len(z))] for z in (bx, by)]
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, links, last = [], [], 0
        for e in both:
            inside = [[k for k, end in zip(z, es, strict=True) if last < end <= e] for z, es in ((x, ends[0]), (y, ends[1]))]
            groups.append("|".join(",".join(map(str, z)) for z in inside))
            links.append((inside[0][-1], inside[1][-1]))
            last = e
        rows.append((len(x), len(y), groups, links))
    count = Counter(link for r in rows if r for link in r[3])
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((r[0], r[1], len(r[2]), len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest()))
    return out


ODD = [None, "", " ", "  two  spaces ", "a\x00b", "▁x y", "é ü ½ x²", "<s> </s> <unk> <|endoftext|>", "\n\n a\r\n b\t c", "日本語 text 12345", "it's 'S can't", "a\x1c b", " x 　y", "🙂🙂 ok", "x" * 300, "the the", "the the"]


def rows_of(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in df.collect())


def test_against_whole_texts(spark, libraries):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect() if len(r["text"]) < 3000][:120] + ODD
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = sorted((str(k), *row) for k, row in enumerate(plain(texts, libraries)))
    assert rows_of(L.align_tokenizers(df, A, B)) == want


def test_small_parts_and_a_forgetful_memory(spark, libraries, monkeypatch):
    rng = random.Random(4)
    words = ["the", "über", "x.y", "12", "Straße,", "don't", "a\nb", "▁", "", "Zwischenzeit"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(150)]
    want = plain(texts, libraries)
    aligner = L.Aligner(A, B)
    monkeypatch.setattr(L, "MEMO", 20)
    monkeypatch.setattr(L, "LONG", 5)
    for at in range(0, len(texts), 7):
        sums, pairs, digests = aligner.align(texts[at : at + 7])
        assert [tuple(r) for r in sums.tolist()] == [w[:4] for w in want[at : at + 7]]
        assert digests == [w[6] for w in want[at : at + 7]] and len(pairs) == sums[:, 3].sum()


def test_odd_rows(spark, libraries):
    rows = [(None, "the cat"), (1, None), (2, "the cat"), (2, "the cat"), (3, "word " * 30_000)]
    df = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, part int, same string")
    got = rows_of(L.align_tokenizers(df, A, B))
    assert len(got) == len(rows) and [r[1] for r in got if r[0] == "1"] == [0]
    assert [r[2] for r in got if r[0] == "3"] == [len(libraries[1].encode("word " * 30_000))]
    assert L.align_tokenizers(df.limit(0), A, B).count() == 0
    assert L.align_tokenizers(df.where("doc_id = 1"), A, B).count() == 1


def test_query(spark):
    df = QUERIES["op13_cross_tokenizer_alignment"](spark, "/root/testdata/sf0.001")
    assert df.columns[:7] == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    assert df.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
