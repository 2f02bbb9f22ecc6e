"""Corpus pipeline over ``documents``: quality, language, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every document its predecessor kept and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All stages but the last return the columns of documents.

Null texts count as empty texts in every stage; the language stage rejects them. Columns beside doc_id and text
pass through the first four stages as they are, save that masking updates n_chars. Empty tables give empty tables. Texts
of any length are worked on whole. What a stage decides depends on its input's rows alone, not on earlier runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, langid, packing, pii, quality
from tessera.llm.common import discard, stored

BUCKETS = 1 << 20
#: Rows of text that a Python worker takes at a time.
BATCH_ROWS = "2048"

#: By input, the tables that the near-duplicate stage's result reads; they go when a later stage works on what was written of it.
_held: dict[str, list[DataFrame]] = {}


def _drop_superseded(docs: DataFrame, sf_dir: str) -> None:
    """Remove the tables of the stage before, unless ``docs`` is its unwritten result."""
    files, held = docs.inputFiles(), [t.stored_at.rsplit("/", 1)[1] for t in _held.get(sf_dir, [])]  # names of their own
    if not any(name in f for name in held for f in files):
        discard(*_held.pop(sf_dir, []))


def _small_batches(spark) -> None:
    """All columns travel with the texts here, so batches are kept small; a setting of the session, as results are lazy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more; labels come from the labels table."""
    _small_batches(spark)
    scored = quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.filter("score >= 0.5").select(*docs.columns)


def language_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learnt languages: those without letters or without a likely language go."""
    _small_batches(spark)
    return langid.recognised(docs)


def near_duplicate_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: the one with the smallest doc_id, of several the first row.

    Rows are told apart by a key of their own, so rows that repeat a doc_id or have none are documents by themselves;
    null ids come after all others.
    """
    _small_batches(spark)
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    found = jaccard_join.near_duplicates(keyed, key="_row").select("_row", "component_id")
    # the rows of groups of two or more; most documents are alone and kept without a shuffle of their texts
    groups = stored(found.filter("component_id != _row").select("_row", F.col("component_id").alias("_group")), "pipeline-linked")
    members = groups.unionByName(groups.select(F.col("_group").alias("_row"), "_group").distinct())
    ids = members.join(keyed.select("_row", "doc_id"), "_row")
    first = ids.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("_first"))
    others = stored(ids.join(first, "_group").filter(F.col("_row") != F.col("_first._row")).select("_row"), "pipeline-others")
    # the buckets are a table of at most BUCKETS numbers, the rows in them are decided by an exact join
    bucket = F.pmod(F.xxhash64("_row"), F.lit(BUCKETS))
    buckets = F.broadcast(others.select(bucket.alias("_bucket")).distinct())
    tagged = keyed.withColumn("_bucket", bucket)
    discard(groups)
    _held.setdefault(sf_dir, []).extend([keyed, others])
    kept = tagged.join(buckets, "_bucket", "left_anti").unionByName(
        tagged.join(buckets, "_bucket", "left_semi").join(others, "_row", "left_anti").select(*tagged.columns))
    return kept.select(*docs.columns)


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data replaced by its kind; no document goes."""
    _drop_superseded(docs, sf_dir)
    masked = pii.mask(pii.detect(docs))
    if "n_chars" in docs.columns:
        changed = (F.size("spans") > 0) & F.col("n_chars").isNotNull()
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents as pieces of sequences of at most 2048 tokens."""
    _small_batches(spark)
    return packing.packed_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Trained models and tokenizers have no SQL form; tests/llm compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if k:
            discard(before)
    return docs
