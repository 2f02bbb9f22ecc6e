"""WARC round trip, and the pipeline against its stages applied by brute force."""

import base64
import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import jaccard_join, langid, pii, quality, warc
from tessera.llm.common import fold

from .conftest import sentence
from .test_pairs import brute_join
from .test_tokens import check_packing

SF = "/root/testdata/sf0.01"


def expected(rows, least=0):
    best = {}
    for p, _, html in rows:
        if p is not None:
            best[html or ""] = max(best.get(html or "", p), p)
    out = []
    for p, url, html in rows:
        data = (html or "").encode()
        top = best.get(html or "")
        refers = top if len(data) >= least and top is not None and p != top else None
        out.append((p, url, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None else "response", refers, True))
    return sorted(out, key=str)


ROWS = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://c\r\nX: y", "é" * 70_000), (4, "http://d", None), (5, "http://e", ""),
        (6, "http://ü", "a\r\n\r\nWARC/1.1\r\n\r\nb"), (None, "http://n", "<p>x</p>"), (7, "http://e", "z"), (7, "http://e", "z"), (8, "h", "z")]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest_ok", F.lit("clash")).repartition(3)
    manifest = warc.write(pages, revisit_bytes=least)
    got = sorted((tuple(r) for r in warc.read(manifest).collect()), key=str)
    rows = [(p, u and u.replace("\r\n", "%0D%0A"), h) for p, u, h in ROWS]
    assert got == expected(rows, least)
    full = warc.read(manifest, payload=True).filter("record_type = 'response'").collect()
    assert all(base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() == r["payload_digest"] for r in full)
    assert sum(r["records"] for r in manifest.collect()) == len(ROWS)
    for r in manifest.collect():  # one gzip member for each record, readable by anything
        data = open(r["path"].removeprefix("file:"), "rb").read()
        assert len(data) == r["bytes"] and gzip.decompress(data).count(b"WARC-Record-ID") == r["records"]
    assert warc.read(warc.write(pages.limit(0))).count() == 0


def member(**change):
    parts = b"".join(warc.record(1, "u", b"payload", 7, hashlib.sha1(b"payload").hexdigest(), None, "1970-01-01T00:00:00Z"))
    for a, b in change.items():
        parts = parts.replace(a.encode(), b.encode())
    return gzip.compress(parts)


def test_reader_checks():
    assert [r["digest_ok"] for r in warc.read_archive(io.BytesIO(member() + member(payload="pAyload")))] == [True, False]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(member()[:-20])))
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(member(payload="longer payload"))))


def test_op5_on_a_table(spark):
    pages = [(r["page_id"], None, r["html"]) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    got = sorted(((r["page_id"], None, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], r["digest_ok"])
                  for r in warc.op5(spark, SF).collect()), key=str)
    assert got == expected(pages)


def test_pipeline_by_brute_force(spark):
    """Each stage's decisions recomputed on what the one before kept; the packed pieces hold exactly the masked texts."""
    import public_tokenizers as P
    import tokenizers
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.scored(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("score >= 0.5")
    kept = corpus_pipeline.quality_stage(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == good.count() < docs.count()
    spoken = corpus_pipeline.language_stage(spark, kept, SF)
    model = langid.fit(kept.filter(fold(F.col("doc_id"), 3) != 1), rest=True)
    found = langid.predict(kept, model).filter(f"lang_pred != 'und' and lang_value >= {model.floor!r}")
    rows = sorted((r["doc_id"], r["text"]) for r in spoken.collect())
    assert rows == sorted((r["doc_id"], r["text"]) for r in found.collect())
    sets, comp = brute_join(rows)
    single = [(i, t) for k, (i, t) in enumerate(rows) if comp[k] == i]
    distinct = corpus_pipeline.near_duplicate_stage(spark, spoken, SF)
    assert sorted((r["doc_id"], r["text"]) for r in distinct.collect()) == single
    masked = {r["doc_id"]: r["text"] for r in corpus_pipeline.pii_stage(spark, distinct, SF).collect()}
    by_hand = {r["doc_id"]: r["text"] for r in pii.mask(pii.detect(distinct)).collect()}
    assert masked == by_hand and masked.keys() == {i for i, _ in single}
    lib = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    check_packing(corpus_pipeline.run(spark, SF).collect(), masked, lib)


def test_stages_take_odd_documents(spark, odd_docs, no_docs):
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd_docs, odd_docs.select(*cols), no_docs):
        rows = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            rows = stage(spark, rows, SF)
            assert rows.columns == docs.columns, name
            rows.count()
        corpus_pipeline.packing_stage(spark, rows, SF).count()
    kept = corpus_pipeline.near_duplicate_stage(spark, odd_docs, SF)
    assert kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id is null").count() == 1
    assert jaccard_join.near_duplicates(odd_docs).count() == odd_docs.count()


def test_near_duplicates_by_row(spark):
    """One row of each group stays, whatever ids repeat or are missing; of near copies too."""
    rows = [(5, 0), (5, 1), (3, 1), (7, 0), (15, 2), (15, 3), (13, 3), (25, 4), (25, 4), (None, 5), (39, 5), (None, 6), (None, 6), (None, 7)]
    docs = [(i, f"{sentence(k, 80)} tail{n} text{k}") for n, (i, k) in enumerate(rows)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(r["doc_id"], int(r["text"].rsplit("text", 1)[1])) for r in corpus_pipeline.near_duplicate_stage(spark, frame, SF).collect()]
    assert sorted(got, key=str) == sorted([(5, 0), (3, 1), (15, 2), (13, 3), (25, 4), (39, 5), (None, 6), (None, 7)], key=str)


def test_archives_are_read_by_many_tasks(spark, tmp_path):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), "id").alias("html")).repartition(40)
    manifest = warc.write(pages)
    back = warc.read(manifest)
    assert back.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and manifest.count() > 4
    assert back.select(F.spark_partition_id()).distinct().count() > 2
    assert back.filter("digest_ok").count() == 400


def test_later_stages_remove_earlier_tables(spark, tmp_path):
    """The near-duplicate stage's tables go once its written result is worked on, and not before."""
    docs = spark.createDataFrame([(i, sentence(i % 5, 40)) for i in range(20)], "doc_id long, text string")
    found = corpus_pipeline.near_duplicate_stage(spark, docs, "own")
    held = list(corpus_pipeline._held["own"])
    corpus_pipeline.pii_stage(spark, found, "own")
    assert found.count() == 5
    found.write.parquet(str(tmp_path / "stage"))
    corpus_pipeline.pii_stage(spark, spark.read.parquet(str(tmp_path / "stage")), "own").count()
    assert "own" not in corpus_pipeline._held and held
    with pytest.raises(Exception):
        found.count()


@pytest.mark.parametrize("langs", [1, 2, 4])
def test_language_stage_whatever_the_number_of_languages(spark, langs):
    """Its own texts stay and letters in random order go, with one, two or more languages learnt."""
    import random
    rng = random.Random(langs)
    words = {k: ["".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8))) for _ in range(60)]
             for k, alphabet in enumerate(["abcde", "fghij", "klmno", "pqrst"][:langs])}
    rows = [(i, " ".join(rng.choice(words[i % langs]) for _ in range(80)), f"l{i % langs}") for i in range(300)]
    noise = [(1000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(500)), None) for i in range(30)]
    kept = corpus_pipeline.language_stage(spark, spark.createDataFrame(rows + noise, "doc_id long, text string, lang string"), SF)
    ids = {r["doc_id"] for r in kept.collect()}
    assert len([i for i in ids if i < 1000]) >= 297 and not [i for i in ids if i >= 1000]
