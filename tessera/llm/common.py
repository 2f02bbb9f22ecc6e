"""Helpers shared by the corpus operators: shared-folder tables, Arrow text access, vectorised words, components.

Everything that runs inside a task works on slices of bounded size, so memory follows the longest
single document and not the batch.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ensure_checkpoint_dir

#: Bytes of text that a task turns into NumPy arrays at a time.
SLICE_BYTES = 2 << 20


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{label}-{uuid.uuid4().hex}"


#: Shuffle files of a query go when it ends, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there, and a
    lost executor costs no recomputation of what lies before it."""
    spark = df.sparkSession
    path, before = shared_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``stored`` wrote, once nothing that is still to run reads them."""
    for df in frames:
        at = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fold(doc_id, parts: int):
    """crc32 of the id's decimal text modulo ``parts`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def fitting_sample(df: DataFrame, label: str, key: str, rows: int, total: int = 1 << 14, least: int = 8) -> DataFrame:
    """About ``rows`` rows of every class of ``df``; fewer, but ``least``, where the classes are so many that all together
    would be more than ``total``. A class with no more rows than that is taken whole.

    A row is taken by the hash of its key, at a rate that follows from its class's count. The rates are a small table
    that Spark broadcasts by its size. For fitting only.
    """
    counts = stored(df.groupBy(label).agg(F.count("*").alias("_n")).filter(F.col(label).isNotNull()), "labels")
    classes = counts.count()
    if not classes:
        return df.limit(0)
    rows, scale = max(min(rows, total // classes), min(rows, least)), 1 << 30
    rates = counts.select(label, F.least(F.lit(scale), F.ceil(F.lit(rows * scale) / F.col("_n"))).alias("_rate"))
    place = F.pmod(F.xxhash64(F.col(key), F.lit("fit")), F.lit(scale))
    return df.join(rates, label).filter(place < F.col("_rate")).drop("_rate").limit(2 * rows * classes)


# ---------------------------------------------------------------- text inside tasks

def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as the empty text. offsets has n + 1 entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    col = column.cast(pa.large_utf8()).fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of at most ``rows`` documents and ``limit`` bytes (a longer document stands alone)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = min(a + rows, max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1))
        yield a, b
        a = b


#: The six characters \x20 and \x09-\x0D that separate words.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64  # words of more bytes are hashed one by one


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((int(_BASE), _inverse(int(_BASE)))):
            step = np.full(m, np.uint64(base))
            step[0] = 1
            _POW[k] = np.multiply.accumulate(step)
    return _POW[0], _POW[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word, index of its document) in text order.

    Words are maximal runs without \\x20 and \\x09-\\x0D after A-Z are lower-cased. The hash is a
    polynomial of the bytes modulo 2^64 taken from prefix sums and then mixed; longer words than
    64 bytes, for which such polynomials are weak, are hashed by BLAKE2b.
    """
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    gap = _SPACE[raw]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < n]
    first[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= gap[1:]
    edge = edge[edge > 0]
    last[edge - 1] |= inside[edge - 1]
    starts = np.flatnonzero(first)
    ends = np.flatnonzero(last) + 1
    power, inverse = _powers(n + 1)
    low = _LOWER[raw]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
    size = ends - starts
    out = mix64((sums[ends] - sums[starts]) * inverse[starts] + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for k in np.flatnonzero(size > _LONG):
        digest = hashlib.blake2b(low[starts[k]:ends[k]].tobytes(), digest_size=8).digest()
        out[k] = int.from_bytes(digest, "little")
    return out, np.searchsorted(offsets, starts, side="right") - 1


def word_chunks(raw: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[np.ndarray]:
    """Pieces of one long text that end at a space each (a single longer word stays whole)."""
    a, n = 0, len(raw)
    while a < n:
        b = min(n, a + limit)
        if b < n:
            back = np.flatnonzero(_SPACE[raw[a:b]])
            if len(back):
                b = a + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(_SPACE[raw[b:]])
                b = b + int(ahead[0]) + 1 if len(ahead) else n
        yield raw[a:b]
        a = b


def document_words(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(a, b, hashes, owner) for runs [a, b) of rows; owner counts from a. Long texts are hashed in pieces."""
    raw, offsets = text_buffers(column)
    for a, b in slices(offsets):
        part, off = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        if len(part) <= SLICE_BYTES:
            yield a, b, *word_hashes(part, off)
        else:
            found = [word_hashes(x, np.array([0, len(x)]))[0] for x in word_chunks(part)]
            words = np.concatenate(found)
            yield a, b, words, np.zeros(len(words), np.int64)


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component) for every id of ``edges`` (columns a, b): component is the smallest id reachable.

    Hash-min with pointer jumping: each round every id takes the smallest label among its neighbours
    and then the label of that label. The tables are written to the shared folder each round and the
    loop ends when no label changes. A hub's neighbours are pre-aggregated by ``min`` before the
    shuffle, so no group is collected. Ids must be of one comparable type; self loops are harmless.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                  f"{label}-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m"))
                    .select("id", F.least("id", "m").alias("component")), f"{label}-labels")
    while True:
        seen = (both.join(labels.select(F.col("id").alias("b"), "component"), "b")
                .groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near")))
        step = labels.join(seen, "id").select("id", F.col("component").alias("old"),
                                              F.least("component", "near").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = stored(step.join(jump, "component", "left")
                      .select("id", "old", F.least("component", F.coalesce("further", "component")).alias("component")),
                      f"{label}-labels")
        discard(labels)
        labels = step
        if step.filter(F.col("old") != F.col("component")).isEmpty():
            discard(both)
            return step.select("id", "component")


def rows_of(batch: pa.RecordBatch, names: Iterable[str]) -> list[pa.Array]:
    return [batch.column(batch.schema.get_field_index(n)) for n in names]
