"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

An ``Index`` counts, for every line key, the inserted documents that hold it. ``insert`` adds documents, ``delete``
takes them out again, in any order; the same documents in give the same index whatever happened in between.
``clean`` drops the lines whose key is in at least ``threshold`` documents of the index.

* ``refs`` is the exact table: one row for each key with a count other than 0. Keys are 128-bit BLAKE2b digests
  (exact up to their collisions). Counts are summed inside a task before they are shuffled, so a line that every
  document holds is a few rows.
* ``filters`` is one cuckoo filter for each shard of the keys that have reached the threshold, by leading bits of the
  digest. When an insertion or deletion moves a key across the threshold, its 32-bit fingerprint goes into or out
  of its shard's filter, which no Bloom filter could undo. A fingerprint that finds no slot goes to the
  shard's stash. The number of shards doubles when they fill, so a shard's size is fixed.
* ``clean`` reads documents once for each ``ROUND_BYTES`` of filters (one round up to six million such lines) and
  shuffles no text: tasks test their lines against the round's filters, which are broadcast. Keys below the threshold
  that a filter takes for others (about 2e-9 of all) are found beforehand from the exact table and broadcast too, so the
  result is exact.

Every row is a document of its own: repeated rows and ids each count, null ids are ids like any other. Null and
empty texts are one empty line. Lines with fewer than ``points`` code points in their key are never counted or
dropped. A document that loses all its lines keeps the empty text. Empty tables give empty tables. Documents deleted
without having been inserted leave negative counts, which a later insertion evens out. Existing columns named like
the output's are replaced; others pass through.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, slices, stored, text_buffers

#: Buckets of a shard's filter and fingerprints in a bucket.
BUCKETS, SLOTS = 1 << 14, 4
#: Keys of a shard on average before the shards double (three quarters of its slots).
SHARD_KEYS = BUCKETS * SLOTS * 3 // 4
#: Bytes of filters that tasks hold at a time.
ROUND_BYTES = 32 << 20
#: Moves before a fingerprint goes to the stash.
KICKS = 500

BLANK = b" \t\n\x0b\x0c\r"
REFS = "k1 long, k2 long, before long, n long"
FILTERS = "shard int, slots binary, stash binary"


# ---------------------------------------------------------------- filter

def _places(k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprint, bucket, other bucket) of digests; a fingerprint is never 0, which marks a free slot."""
    mark = k1.view(np.uint64) & np.uint64(0xFFFFFFFF)
    mark[mark == 0] = 1
    one = k2.view(np.uint64) & np.uint64(BUCKETS - 1)
    return mark, one, one ^ (mix64(mark) & np.uint64(BUCKETS - 1))


class Cuckoo:
    """A cuckoo filter of digests. ``stash`` has the fingerprints that found no slot, with their lower bucket."""

    def __init__(self, slots: bytes | None = None, stash: bytes | None = None):
        self.slots = np.frombuffer(slots, np.uint32).tolist() if slots else [0] * (BUCKETS * SLOTS)
        self.stash = np.frombuffer(stash, np.uint64).tolist() if stash else []

    def _other(self, mark: int, bucket: int) -> int:
        return bucket ^ (int(mix64(np.array([mark], np.uint64))[0]) & (BUCKETS - 1))

    def insert(self, mark: int, one: int, two: int) -> None:
        for bucket in (one, two):
            at = bucket * SLOTS
            for k in range(at, at + SLOTS):
                if not self.slots[k]:
                    self.slots[k] = mark
                    return
        bucket = one
        for turn in range(KICKS):
            k = bucket * SLOTS + (mark + turn) % SLOTS
            mark, self.slots[k] = self.slots[k], mark
            bucket = self._other(mark, bucket)
            at = bucket * SLOTS
            for k in range(at, at + SLOTS):
                if not self.slots[k]:
                    self.slots[k] = mark
                    return
        self.stash.append(mark << 32 | min(bucket, self._other(mark, bucket)))

    def delete(self, mark: int, one: int, two: int) -> None:
        """Takes out one copy of a fingerprint that was inserted."""
        rest = mark << 32 | min(one, two)
        if rest in self.stash:
            self.stash.remove(rest)
            return
        for bucket in (one, two):
            at = bucket * SLOTS
            for k in range(at, at + SLOTS):
                if self.slots[k] == mark:
                    self.slots[k] = 0
                    return
        raise ValueError("fingerprint is not in the filter")

    def row(self) -> tuple[bytes, bytes]:
        return np.array(self.slots, np.uint32).tobytes(), np.array(self.stash, np.uint64).tobytes()


class Held:
    """The filters of some shards as one array, and the keys that they take for others."""

    def __init__(self, shards: int, filters: list[tuple[int, bytes, bytes]], wrong: list[tuple[int, int]]):
        self.bits = shards.bit_length() - 1
        self.place = np.full(shards, -1)
        for at, (shard, _, _) in enumerate(filters):
            self.place[shard] = at
        self.slots = np.frombuffer(b"".join(x for _, x, _ in filters), np.uint32).reshape(-1, BUCKETS, SLOTS)
        self.stash = {(shard, int(x)) for shard, _, rest in filters for x in np.frombuffer(rest or b"", np.uint64)}
        self.wrong = set(wrong)

    def hits(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        shard = shard_of(k1, self.bits)
        at = self.place[shard]
        out = np.zeros(len(k1), bool)
        some = np.flatnonzero(at >= 0)
        if len(some) == 0:
            return out
        mark, one, two = _places(k1[some], k2[some])
        for bucket in (one, two):
            out[some] |= (self.slots[at[some], bucket.astype(np.int64)] == mark[:, None].astype(np.uint32)).any(axis=1)
        if self.stash:
            rest = (mark << np.uint64(32) | np.minimum(one, two)).tolist()
            out[some] |= [(s, x) in self.stash for s, x in zip(shard[some].tolist(), rest)]
        if self.wrong:
            for k in np.flatnonzero(out):
                out[k] = (int(k1[k]), int(k2[k])) not in self.wrong
        return out


def shard_of(k1: np.ndarray, bits: int) -> np.ndarray:
    return (k1.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k1), np.int64)


# ---------------------------------------------------------------- lines

def keys_of(text: bytes) -> list[bytes]:
    """The key of every line: blanks stripped at both ends, A-Z lower-cased."""
    return [line.strip(BLANK).lower() for line in text.split(b"\n")]


def digests(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join([blake2b(k, digest_size=16).digest() for k in keys])
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _counted(key: bytes, points: int) -> bool:
    return len(key) >= points and (points <= 1 or len(key.decode("utf-8", "replace")) >= points)


def line_counts(docs: DataFrame, text: str = "text", points: int = 1) -> DataFrame:
    """(k1, k2, n): documents of ``docs`` by the keys they hold, added up within slices of 2 MB of text only."""
    least = max(points, 1)

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(0))
            for a, b in slices(offsets):
                seen = Counter()
                for i in range(a, b):
                    seen.update(set(keys_of(raw[offsets[i]:offsets[i + 1]].tobytes())))
                keys = [k for k in seen if _counted(k, least)]
                k1, k2 = digests(keys)
                yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array([seen[k] for k in keys], pa.int64())],
                                                 ["k1", "k2", "n"])

    return docs.select(F.col(text).cast("string")).mapInArrow(run, "k1 long, k2 long, n long")


# ---------------------------------------------------------------- index

@dataclass(frozen=True)
class Index:
    refs: DataFrame  # k1, k2, before, n: counts before and after the last change; n = 0: gone
    filters: DataFrame  # shard, slots, stash
    shards: int
    threshold: int
    points: int


def empty(spark: SparkSession, threshold: int = 10, points: int = 1) -> Index:
    """An index without documents: lines found in at least ``threshold`` documents will go."""
    return Index(spark.createDataFrame([], REFS), spark.createDataFrame([], FILTERS), 1, threshold, points)


def insert(index: Index, docs: DataFrame, text: str = "text") -> Index:
    return _changed(index, line_counts(docs, text, index.points), 1)


def delete(index: Index, docs: DataFrame, text: str = "text") -> Index:
    return _changed(index, line_counts(docs, text, index.points), -1)


def _changed(index: Index, counts: DataFrame, sign: int) -> Index:
    """The index with ``counts`` added or taken off; tables are written to the shared folder."""
    old = index.refs.filter("n != 0").select("k1", "k2", F.col("n").alias("before"), "n")
    new = counts.select("k1", "k2", F.lit(0).cast("long").alias("before"), (F.col("n") * sign).alias("n"))
    refs = stored(old.unionByName(new).groupBy("k1", "k2").agg(F.sum("before").alias("before"), F.sum("n").alias("n")), "lines-refs")
    held = refs.filter(F.col("n") >= index.threshold)
    most, shards = held.count(), index.shards
    while most > shards * SHARD_KEYS:
        shards *= 2
    if shards != index.shards:
        moves, filters = held.withColumn("up", F.lit(True)), index.filters.limit(0)
    else:
        was, now = F.col("before") >= index.threshold, F.col("n") >= index.threshold
        moves, filters = refs.filter(was != now).withColumn("up", now), index.filters
    bits = shards.bit_length() - 1
    shard = F.shiftrightunsigned("k1", 64 - bits) if bits else F.lit(0)
    moves = moves.select(shard.cast("int").alias("shard"), "k1", "k2", "up")

    def update(key, before: pa.Table, moved: pa.Table) -> pa.Table:
        own = Cuckoo(before.column("slots")[0].as_py(), before.column("stash")[0].as_py()) if len(before) else Cuckoo()
        up = np.asarray(moved.column("up"))
        places = np.stack(_places(*(np.array(moved.column(c), np.int64) for c in ("k1", "k2"))), axis=1)
        for row in places[~up].tolist():
            own.delete(*row)
        for row in places[up].tolist():
            own.insert(*row)
        slots, stash = own.row()
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "slots": [slots], "stash": [stash]})

    filters = filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInArrow(update, FILTERS)
    return replace(index, refs=refs, filters=stored(filters, "lines-filters"), shards=shards)


def _rounds(index: Index, source: DataFrame):
    """(shared ``Held``) for each round. ``source``: k1, k2 of keys below the threshold that documents may hold."""
    sc = index.refs.sparkSession.sparkContext
    step = max(1, ROUND_BYTES // (BUCKETS * SLOTS * 4))
    for low in range(0, index.shards, step):
        some = [tuple(r) for r in index.filters.filter(F.col("shard").between(low, low + step - 1)).collect()]
        some = [(s, bytes(a), bytes(b)) for s, a, b in some]
        tested = sc.broadcast(Held(index.shards, some, []))

        def run(batches, tested=tested):
            for batch in batches:
                k1, k2 = (np.array(c, np.int64) for c in batch.columns)
                yield batch.filter(pa.array(tested.value.hits(k1, k2)))

        wrong = [tuple(r) for r in source.mapInArrow(run, "k1 long, k2 long").collect()] if some else []
        yield sc.broadcast(Held(index.shards, some, wrong))


def clean(index: Index, docs: DataFrame, text: str = "text", inserted: bool = True) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept, the text of the lines whose keys are below the threshold.

    ``inserted``: all of ``docs`` are in the index. Otherwise keys that the index has never seen are checked too, for
    which the documents are read once more.
    """
    kinds = {"n_lines": T.LongType(), "n_dropped": T.LongType(), "kept": T.StringType()}
    rest = [f for f in docs.schema.fields if f.name not in kinds]
    schema = T.StructType([*rest, *(T.StructField(k, v) for k, v in kinds.items())])
    if inserted:
        source = index.refs.filter(F.col("n") < index.threshold).select("k1", "k2")
    else:
        held = index.refs.filter(F.col("n") >= index.threshold)
        source = line_counts(docs, text, index.points).select("k1", "k2").distinct().join(held, ["k1", "k2"], "left_anti")
    least = max(index.points, 1)
    out = docs.select(*[f.name for f in rest], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("kept"))
    out = out.withColumns({"n_lines": F.lit(-1).cast("long"), "n_dropped": F.lit(0).cast("long")}).select(*schema.names)
    for turn, shared in enumerate(_rounds(index, source)):
        def run(batches, shared=shared):
            for batch in batches:
                raw, offsets = text_buffers(batch.column(len(rest) + 2))
                for a, b in slices(offsets):
                    yield _kept(batch.slice(a, b - a), raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a],
                                shared.value, least, schema.names)
        out = (stored(out, "lines-round") if turn else out).mapInArrow(run, schema)
    return out


def _kept(batch: pa.RecordBatch, raw: np.ndarray, offsets: np.ndarray, held: Held, least: int, names: list[str]) -> pa.RecordBatch:
    lines = [raw[offsets[i]:offsets[i + 1]].tobytes().split(b"\n") for i in range(len(batch))]
    keys = [[x.strip(BLANK).lower() for x in own] for own in lines]
    known = [k for k in set().union(*keys) if _counted(k, least)]
    gone = {known[i] for i in np.flatnonzero(held.hits(*digests(known)))} if known else set()
    texts, dropped = [], []
    for own, key in zip(lines, keys):
        left = [x for x, k in zip(own, key) if k not in gone] if gone else own
        texts.append(b"\n".join(left))
        dropped.append(len(own) - len(left))
    n, m, k = len(names) - 3, len(names) - 2, len(names) - 1
    before = np.asarray(batch.column(n))
    columns = list(batch.columns)
    columns[n] = pa.array(np.where(before < 0, [len(x) for x in lines], before))
    columns[m] = pa.array(np.asarray(batch.column(m)) + np.array(dropped, np.int64))
    columns[k] = pa.array(texts, pa.binary()).cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, names)


def op13(spark, sf_dir: str) -> DataFrame:
    """op13: lines whose key is in at least 10 documents leave every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    cleaned = clean(insert(empty(spark, threshold=10, points=1), docs), docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: The same result by one row for each line.
OP13_SQL = r"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
split as (select r, doc_id, string_split(text, chr(10)) as lines from docs),
lines as (
  select r, unnest(lines) as line, unnest(range(len(lines))) as i from split),
keyed as (
  select r, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from lines),
common as (select key from keyed where length(key) >= 1 group by key having count(distinct r) >= 10),
kept as (
  select r, count(*) as n_lines, count(c.key) as n_dropped,
         coalesce(string_agg(line, chr(10) order by i) filter (where c.key is null), '') as text
  from keyed left join common c using (key) group by r)
select doc_id, n_lines::bigint as n_lines, n_dropped::bigint as n_dropped, sha256(kept.text) as kept_sha256
from docs join kept using (r)
"""
