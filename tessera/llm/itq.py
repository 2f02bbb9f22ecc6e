"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and exact cosines.

A rotation is learnt on a bounded sample so that the signs of the rotated, centred unit vectors make 64-bit codes close to
the vectors (iterative quantisation), and each bit is cut at its median, so that codes are balanced whatever mean the
vectors share. Centre, rotation and medians come from representatives of the sample, no two of them within the link
threshold: a group of near copies that outweighs the rest counts once, so it becomes neither the centre nor a cut that
tears it apart. A code's substrings are its keys in as many tables; two vectors are candidates if in some table their keys differ in at most ``radius`` bits, so
every pair of codes at a Hamming distance below tables * (radius + 1) is found, and most beyond. Candidates
are compared by cosine of the original vectors in double precision, so no link is wrong.

At every size the tables are 4 of 16 bits with radius 2, which finds all codes within 11 bits: each vector stands
under its key and the 16 keys one bit away, so that two keys at most two bits apart share one. A bucket is cut into
blocks by a hash, and pairs of blocks are compared apart, so a bucket of any size is spread over tasks. A pair found
in several tables or keys counts in the first. Only each vector's number of links and a spanning forest leave a task,
not the pairs. Equal vectors are one class with a count, so copies meet nowhere.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; so do vectors
of different lengths with each other. Rows with a null id are returned with no links and kept. Rows that repeat
an id are vectors by themselves. Columns other than id and vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import components, stored

BITS, SAMPLE, ROUNDS, BLOCK = 64, 4096, 50, 512
TABLES, RADIUS = 4, 2


class Rotation:
    """Balanced codes for one vector length."""

    def __init__(self, x: np.ndarray, threshold: float = 0.95):
        """``x``: unit vectors (rows). Principal directions of the centred representatives first, then the rotation that fits
        their signs best, then each bit's median. Without vectors, a random projection of all dimensions, cut at 0."""
        rng = np.random.default_rng(0)
        if len(x) == 0:
            self.axes, self.cuts = rng.standard_normal((x.shape[1], BITS)), np.zeros(BITS)
            return
        x = representatives(x, threshold)
        dims = x.shape[1]
        y = np.pad(x - x.mean(0) if len(x) > 1 else x, ((0, 0), (0, max(0, BITS - dims))))
        _, vectors = np.linalg.eigh(y.T @ y + 1e-12 * np.eye(y.shape[1]))
        axes = vectors[:, ::-1][:, :BITS]
        turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
        v = y @ axes
        for _ in range(ROUNDS):
            u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
            turn = (u @ w).T
        self.axes = (axes @ turn)[:dims]
        self.cuts = np.median(x @ self.axes, axis=0) if len(x) > 1 else np.zeros(BITS)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.axes >= self.cuts, axis=1).view("<i8").ravel()


def representatives(x: np.ndarray, threshold: float) -> np.ndarray:
    """Rows of ``x`` such that no two have a cosine of ``threshold`` or more and every row has one with some of them."""
    left, taken = np.arange(len(x)), []
    while len(left):
        taken.append(left[0])
        left = left[x[left] @ x[left[0]] < threshold]
        left = left[left != taken[-1]]
    return x[taken]


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows divided by their length; scaled first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def valid(v):
    """Condition: the vector has components, all finite, not all zero."""
    return (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(v, lambda x: x != 0))


def classes(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(cls, v, low, n): the distinct valid vectors, their smallest id and how many rows have them."""
    return stored(df.filter(F.col(key).isNotNull() & valid(F.col(vector))).groupBy(F.col(vector).alias("v"))
                  .agg(F.min(key).alias("low"), F.count("*").alias("n"))
                  .withColumn("cls", F.monotonically_increasing_id()), "itq-classes")


def fit(distinct: DataFrame, threshold: float = 0.95, sample: int = SAMPLE, lengths: int = 8) -> dict[int, Rotation]:
    """A rotation for each of the ``lengths`` most frequent vector lengths, from about ``sample`` vectors each; vectors of
    other lengths get a random projection when they are coded."""
    counts = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(lengths).collect()
    out = {}
    for row in counts:
        place = F.pmod(F.xxhash64("low", F.lit("itq")), F.lit(1 << 30))
        rows = (distinct.filter((F.size("v") == row["d"]) & (place < min(1 << 30, -(-(sample << 30) // row["n"]))))
                .select("low", "v").limit(2 * sample).collect())
        x = np.array([r["v"] for r in sorted(rows, key=lambda r: r["low"])], np.float64).reshape(-1, row["d"])
        out[row["d"]] = Rotation(_unit(x) if len(x) else x, threshold)
    return out


def coded(distinct: DataFrame, model: dict[int, Rotation]) -> DataFrame:
    """``distinct`` (cls, n, v) with its code; a length without a learnt rotation gets a random projection."""
    shared = distinct.sparkSession.sparkContext.broadcast(model)  # a few matrices of length x 64

    def run(batches):
        model = dict(shared.value)
        for batch in batches:
            v = batch.column(2)
            lengths = np.diff(np.asarray(v.offsets))
            codes = np.zeros(len(v), np.int64)
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                if d not in model:
                    model[d] = Rotation(np.zeros((0, d)))
                codes[at] = model[d].codes(_unit(_matrix(v.take(pa.array(at)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes)], ["cls", "n", "v", "code"])

    rows = distinct.select("cls", "n", "v")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("code", T.LongType())]))


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index in each node's component of the graph with edges (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def links(distinct: DataFrame, model: dict[int, Rotation], threshold: float, tables: int, radius: int) -> DataFrame:
    """(cls, n_links, root): for each class and pair of blocks that links it, the rows it links to (0 if counted in
    an earlier table) and the smallest class it reaches there. ``radius``: 0, 1 or 2."""
    width = BITS // tables
    codes = stored(coded(distinct, model), "itq-codes")
    keys = []
    for t in range(tables):
        key = F.shiftrightunsigned("code", t * width).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(F.struct(F.lit(t).alias("t"), key.alias("key"), F.lit(False).alias("probe")))
        for bit in range(width if radius else 0):  # a key and its neighbour meet where the bit is 1
            probe = F.struct(F.lit(t).alias("t"), key.bitwiseXOR(F.lit(1 << bit)).alias("key"), F.lit(True).alias("probe"))
            keys.append(probe if radius > 1 else F.when(key.bitwiseAND(F.lit(1 << bit)) == 0, probe))
    rows = codes.select("cls", "n", "v", "code", F.size("v").alias("d"), F.explode(F.array_compact(F.array(*keys))).alias("k")).select(
        "cls", "n", "v", "code", "d", "k.*")
    # blocks of a bucket: its size is counted first; one row for each bucket that needs more than one block
    buckets = (codes.select(F.size("v").alias("d"), F.explode(F.array_compact(F.array(*keys))).alias("k")).groupBy("d", "k.t", "k.key")
               .agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).filter("blocks > 1"))
    rows = rows.join(buckets, ["d", "t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("d", "t", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                       "own", "probe", "cls", "n", "code", "v")

    mask = np.uint64((1 << width) - 1)

    def pairs(table: pa.Table) -> pa.Table:
        t, bucket = table.column("t")[0].as_py(), np.uint64(table.column("key")[0].as_py())
        inner = table.column("i")[0] == table.column("j")[0]
        probe, own = np.asarray(table.column("probe")), np.asarray(table.column("own"))
        cls, n, code = (np.asarray(table.column(c)) for c in ("cls", "n", "code"))
        x = _unit(_matrix(table.column("v")))
        left = np.flatnonzero(~probe) if radius < 2 else np.arange(len(cls))  # up to 1 every pair has a side in its own bucket
        a, b = [], []
        for at in range(0, len(left), 1024):
            some = left[at:at + 1024]
            r, c = np.nonzero(x[some] @ x.T >= threshold)
            r = some[r]
            ok = (cls[r] != cls[c]) & (probe[c] & (radius < 2) | (r < c))
            if not inner:
                ok &= own[r] != own[c]
            r, c = r[ok], c[ok]
            if radius > 1:  # keys that differ share several buckets: the pair belongs to the greatest, equal ones' to their own
                k, l = ((code[x].view(np.uint64) >> np.uint64(t * width)) & mask for x in (r, c))
                low = (k ^ l) & (~(k ^ l) + np.uint64(1))
                ok = bucket == np.where(k == l, k, np.maximum(k ^ low, l ^ low))
                r, c = r[ok], c[ok]
            a.append(r)
            b.append(c)
        a, b = np.concatenate(a or [[]]).astype(np.int64), np.concatenate(b or [[]]).astype(np.int64)
        differ = (code[a] ^ code[b]).view(np.uint64)
        new = np.ones(len(a), bool)
        for before in range(t):
            part = (differ >> np.uint64(before * width)) & mask
            new &= np.bitwise_count(part) > radius
        count = np.zeros(len(cls), np.int64)
        np.add.at(count, a[new], n[b[new]])
        np.add.at(count, b[new], n[a[new]])
        # a class can stand here twice, by itself and as a probe: roots go by class
        ids, place = np.unique(cls, return_inverse=True)
        root = ids[_forest(len(ids), place[a], place[b])][place]
        some = (count > 0) | (root != cls) | np.isin(cls, root[root != cls])
        return pa.table({"cls": cls[some], "n_links": count[some], "root": root[some]})

    return rows.groupBy("d", "t", "key", "i", "j").applyInArrow(pairs, "cls long, n_links long, root long")


def near_duplicates(df: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding",
                    tables: int | None = None, radius: int | None = None) -> DataFrame:
    """(key, n_links, component_id, kept) for every row of ``df``."""
    rows = df.select(F.col(key), F.col(vector).alias("v"))
    distinct = classes(df, key, vector)
    if tables is None:
        tables, radius = TABLES, RADIUS
    found = stored(links(distinct, fit(distinct, threshold), threshold, tables, radius), "itq-links")
    counts = found.groupBy("cls").agg(F.sum("n_links").alias("others"))
    groups = components(found.filter("cls != root").select(F.col("cls").alias("a"), F.col("root").alias("b")), "itq")
    members = groups.select(F.col("id").alias("cls"), "component").join(distinct.select("cls", "low"), "cls")
    lowest = members.groupBy("component").agg(F.min("low").alias("lowest"))
    result = (distinct.select("cls", "v", "low", "n").join(counts, "cls", "left")
              .join(members.select("cls", "component"), "cls", "left").join(lowest, "component", "left")
              .select("v", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                      F.coalesce("lowest", "low").alias("component_id")))
    linked = rows.filter(F.col(key).isNotNull() & valid(F.col("v")))
    alone = rows.filter(~F.coalesce(F.col(key).isNotNull() & valid(F.col("v")), F.lit(False)))
    out = linked.join(result, "v").select(key, "n_links", "component_id").unionByName(
        alone.select(key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id")))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))


def op10(spark, sf_dir: str) -> DataFrame:
    """op10: near-duplicate links and groups of all vectors at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), 0.95)


#: The same result by comparing all pairs.
OP10_SQL = """
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select x.vec_id as a, y.vec_id as b from v x join v y on x.vec_id <> y.vec_id
  where list_cosine_similarity(x.e, y.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
comp as (select a as vec_id, min(b) as component_id from reach group by a),
deg as (select a as vec_id, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from embeddings join comp using (vec_id) left join deg using (vec_id)
"""
