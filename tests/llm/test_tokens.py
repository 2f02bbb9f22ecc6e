"""Byte-level BPE and packing against the libraries, on real texts, odd texts and empty tables."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tokenizers
from pyspark.sql import functions as F

from tessera.llm import bpe, packing

from .conftest import sentence

SF = "/root/testdata/sf0.01"
RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    lib = tokenizers.Tokenizer.from_file(JSON)
    lib.encode_special_tokens = True
    return lib


def test_ids_of_the_whole_vocabulary(library):
    """The rank file made from the JSON gives the library's ids for every entry's own text."""
    enc = bpe.encoder(packing.ranks_of_json(open(JSON, encoding="utf-8").read()), P.PATTERN)
    texts = [enc.decode([i]) for i in range(enc.n_vocab)]
    assert [enc.encode_ordinary(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a b" * 40_000, " " * 3000 + "a", "a" + " " * 3000, "\n \n" * 700 + "x", "a" * 70_000 + " b",
                                  "x 　  y" * 9000, "!?" * 50_000, "1 22 333 " * 12_000, "it's 'll " * 10_000])
def test_pieces_keep_the_ids(library, text):
    assert "".join(p for _, p in bpe.pieces(text, 1000)) == text
    enc = bpe.encoder(bpe.read_ranks(RANKS), P.PATTERN)
    expected = library.encode(text, add_special_tokens=False).ids
    assert bpe.encode_text(enc, text) == expected
    cut = []
    for whole, part in bpe.pieces(text, 1000):
        cut += enc._encode_single_piece(part) if whole else enc.encode_ordinary(part)
    assert cut == expected


def test_encode_decode_round_trip(spark, odd_docs, no_docs, library):
    docs = odd_docs.withColumn("ids", F.lit("clash"))
    rows = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["decoded"] == (r["text"] or "").encode()
        assert list(r["ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_op8_on_a_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = bpe.op8(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def check_packing(rows, texts, library):
    """Every id in one piece, sequences gapless and within the length, little padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = np.array([*library.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        pieces.sort(key=lambda r: r["start"])
        assert [p["start"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        assert sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
    real = padded = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [p["offset"] for p in pieces] == [0, *np.cumsum([p["length"] for p in pieces])[:-1].tolist()]
        n = sum(p["length"] for p in pieces)
        assert n <= 2048
        real, padded = real + n, padded + (n if n & (n - 1) == 0 else 2048)
    return real / padded


def test_op1_on_a_table(spark, library):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert check_packing(packing.op1(spark, SF).collect(), texts, library) > 0.98


def test_packing_of_odd_texts(spark, odd_docs, no_docs, library):
    docs = odd_docs.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_packing(packing.packed_documents(docs).collect(), texts, library)
    repeated = packing.packed_documents(odd_docs).filter("doc_id = 4").collect()
    assert sum(r["length"] for r in repeated) == 3 * repeated[0]["doc_tokens"]
    assert packing.packed_documents(no_docs).count() == 0
    ids = packing.pack(docs, JSON, P.PATTERN, 1).filter("doc_id = 9").orderBy("start").collect()
    assert [i for r in ids for i in r["ids"]] == [*library.encode(texts[9], add_special_tokens=False).ids, 1]


def test_differencing():
    rng = np.random.default_rng(1)
    assert sorted(sum(packing.difference([5], 3), [])) == [0]
    assert packing.difference([], 2) == [[], []]
    for k in (2, 3, 7):
        sizes = rng.integers(1, 500, 60)
        groups = packing.difference(sizes, k)
        assert sorted(sum(groups, [])) == list(range(60)) and len(groups) == k
        sums = [int(sizes[g].sum()) for g in groups]
        assert max(sums) - min(sums) <= 20
    # Karmarkar-Karp's two-way result on its textbook example: {8, 7} and {6, 5, 4} differ by the last difference, 2
    groups = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in g) for g in groups) == [14, 16]
    for w in packing.windows([2000, 1500, 600, 600, 2048, 1]):
        assert sum([2000, 1500, 600, 600, 2048, 1][i] for i in w) <= 2048


@pytest.mark.parametrize("parts", [1, 40])
def test_every_task_differences(spark, parts):
    """Few documents a task: whole windows still come from differencing, near-equal, and little stays empty."""
    docs = spark.createDataFrame([(i, sentence(i, 30 + 7 * i % 90)) for i in range(1200)], "doc_id long, text string").repartition(parts)
    rows = packing.packed_documents(docs).collect()
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r["length"])
    tasks = {}
    for k, lengths in sequences.items():
        tasks.setdefault(k >> 40, []).append((sum(lengths), len(lengths)))
    assert len(tasks) == parts
    for own in tasks.values():
        near_full = [n for n, pieces in own if n > packing.LENGTH * 0.98 and pieces > 1]
        assert near_full and max(near_full) - min(near_full) <= packing.PIECE
        padding = sum(0 if n & (n - 1) == 0 else packing.LENGTH - n for n, _ in own)
        assert padding <= 0.02 * sum(n for n, _ in own) + packing.LENGTH * (parts == 1)
