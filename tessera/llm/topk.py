"""Exact top-k inner products by a three-phase uniform threshold.

Every vector of integers is cut into ``LISTS`` groups of dimensions; a group's partial products with a query form one
list, and a candidate's score is the sum of its entries in all lists.

Phase 1  Each task holds a block of candidates and a block of queries and takes the k best entries of each
         list. The union's candidates get exact scores; the k-th best of them is a safe cutoff: no result
         scores less.
Phase 2  The cutoffs go back to the query blocks. A list gives every entry of at least cutoff / LISTS: what
         stays below in every list sums to less than the cutoff.
Phase 3  Each candidate given is resolved exactly from its entries in all lists, which are whole numbers, and the k
         best remain. The task holds both vectors, so it resolves them itself and sends k of a query at most.

Blocks are cut where rows are stored, without a shuffle, so a repeated id or vector cannot gather in one
task. Query blocks meet candidate blocks in the cells of a grid; query blocks are sent once for each
column of it. A table of blocks takes much more memory than its files, so no join of them goes through the driver. Vectors that occur several times are one candidate that carries its k + 1 smallest
ids (a result can need no more), so copies do not multiply the entries.

Vectors that are null, empty, or hold null or non-finite components take no part. Only vectors of equal
length are compared. A query id that occurs twice with different vectors ranks each row by itself.
Null ids take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Lists, rows of a block, candidate rows of a grid column, salts for the copies of one vector.
LISTS, BLOCK, COLUMN, SALTS = 2, 2048, 16384, 32
_BLOCKS = "block long, dim int, ids array<long>, names array<array<long>>, data binary"
_SCORED = "q long, query_id long, ids array<long>, score long"


def _clean(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, v as array<bigint>."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                                                       & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return df.select(F.col(key).cast("long").alias("id"), F.when(fine, v).alias("v")).filter("id is not null and v is not null")


def _blocks(df: DataFrame, size: int) -> DataFrame:
    """Rows (row, names, v) of each partition as blocks of at most ``size`` vectors of one length: rows, their names and an
    int64 matrix."""
    def run(batches):
        from pyspark import TaskContext
        block = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}
        for batch in batches:
            for i, names, v in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x = np.asarray(v.values)
                held.setdefault(len(x), []).append((i, np.asarray(names.values), x))
                if len(held[len(x)]) == size:
                    yield out(block, held.pop(len(x)))
                    block += 1
        for rows in held.values():
            yield out(block, rows)
            block += 1

    def out(block, rows):
        data = np.stack([x for _, _, x in rows]).astype("<i8")
        return pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.array([data.shape[1]], pa.int32()),
            pa.array([[i for i, _, _ in rows]], pa.list_(pa.int64())),
            pa.array([[names for _, names, _ in rows]], pa.list_(pa.list_(pa.int64()))), pa.array([data.tobytes()], pa.binary())],
            ["block", "dim", "ids", "names", "data"])

    return df.select("row", "names", "v").mapInArrow(run, _BLOCKS)


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8").reshape(-1, dim)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly: in floating point while every sum stays within its whole numbers, else in int64."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    for kind, limit in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):
        if bound < limit:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    return a @ b.T


def _groups(dim: int) -> list[slice]:
    step = -(-dim // LISTS)
    return [slice(i, min(dim, i + step)) for i in range(0, dim, step)]


def top_k(vectors: DataFrame, queries, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``vectors`` that satisfies the Column ``queries`` the k
    other rows of highest integer inner product, ties to the smaller id. ``vector``: array of integers."""
    rows = _clean(vectors.withColumn("_query", queries), key, vector)
    asked = _clean(vectors.filter(queries), key, vector)
    # one candidate for each distinct vector, with its k + 1 smallest ids; copies are cut down in two steps
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    small = Window.partitionBy("v", "salt").orderBy("id")
    few = salted.withColumn("n", F.row_number().over(small)).filter(F.col("n") <= k + 1)
    distinct = few.groupBy("v").agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids"))
    # collect_list gathers at most SALTS * (k + 1) ids
    candidates = stored(distinct.select(F.monotonically_increasing_id().alias("row"), F.col("ids").alias("names"), "v"), "topk-candidates")
    asked = stored(asked.select(F.monotonically_increasing_id().alias("row"), F.array("id").alias("names"), "v"), "topk-queries")
    many = candidates.count()
    columns = max(1, -(-many // COLUMN))
    cand = stored(_blocks(candidates, COLUMN).select(
        F.pmod(F.xxhash64("block"), F.lit(columns)).alias("column"), "dim", "ids", "names", "data"), "topk-blocks")
    ask = stored(_blocks(asked, BLOCK), "topk-asked").withColumnsRenamed({"block": "q_block", "ids": "q_ids", "names": "q_names", "data": "q_data"})

    def entries(ask: DataFrame, cut: bool) -> DataFrame:
        grid = ask.withColumn("column", F.explode(F.expr(f"sequence(0L, {columns - 1}L)")))
        pairs = grid.join(cand.hint("merge"), ["column", "dim"])
        return pairs.select("dim", "q_ids", "q_names", "q_data", "ids", "names", "data", *["cutoffs"] * cut).mapInArrow(_entries(k, cut), _SCORED)

    # phase 1: the k best entries of each list
    scored = entries(ask, False)
    # the query's own id must not count: a candidate vector counts as often as it has other ids
    place_of = Window.partitionBy("q").orderBy(F.desc("score"))
    before = F.sum("copies").over(place_of.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cutoff = (scored.select("q", "score", (F.size("ids") - F.array_contains("ids", F.col("query_id")).cast("int")).alias("copies"))
              .withColumn("upto", before).filter(F.col("upto") >= k).groupBy("q").agg(F.max("score").alias("cutoff")))
    # phase 2: every entry of at least a LISTS-th of the cutoff; a query without k others has no cutoff
    lowest = asked.select(F.col("row").alias("q")).join(cutoff, "q", "left")
    cut = (ask.select("q_block", F.posexplode("q_ids").alias("at", "q")).join(lowest.hint("merge"), "q")
           .groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("at", "cutoff"))).alias("cuts")))  # a block's rows
    # phase 3: exact scores of what was given
    exact = entries(ask.join(cut.select("q_block", F.col("cuts.cutoff").alias("cutoffs")).hint("merge"), "q_block"), True)
    found = exact.select("q", "query_id", "score", F.explode("ids").alias("vec_id")).filter("vec_id != query_id")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _entries(k: int, cut: bool):
    """(query row, query id, ids, exact score) of the candidates that the lists give: the k + 1 best of each, or those above
    the cut. Of these the k best of each query by score and the smallest id that is not its own."""
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                at = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                dim = at["dim"].as_py()
                q, c = _matrix(at["q_data"].as_py(), dim), _matrix(at["data"].as_py(), dim)
                q_ids, own = np.asarray(at["q_ids"].values), np.asarray(at["q_names"].values.flatten())
                names = at["names"].values
                first, second = _first_two(names)
                groups = _groups(dim)
                if cut:  # a query without cutoff takes every entry
                    cutoffs = np.array([-(1 << 62) if x is None else x for x in at["cutoffs"].as_py()], np.int64)[:, None]
                step = max(1, (1 << 21) // len(c))
                for a in range(0, len(q), step):
                    rows = slice(a, a + step)
                    parts = [_product(q[rows, dims], c[:, dims]) for dims in groups]
                    taken = np.zeros(parts[0].shape, bool)
                    for part in parts:
                        if cut:
                            taken |= part >= -(-cutoffs[rows] // len(groups))
                        else:
                            n = min(k + 1, len(c))
                            np.put_along_axis(taken, np.argpartition(-part, n - 1, axis=1)[:, :n], True, axis=1)
                    score = sum(parts)
                    if cut:
                        taken &= score >= cutoffs[rows]
                    i, j = np.nonzero(taken)
                    i, j, score = i + a, j, score[i, j]
                    other = np.where(first[j] == own[i], second[j], first[j])
                    fit = other < _NONE
                    i, j, score, other = i[fit], j[fit], score[fit], other[fit]
                    order = np.lexsort((other, -score, i))
                    i, j, score = i[order], j[order], score[order]
                    best = np.arange(len(i)) - np.searchsorted(i, i) < k
                    i, j, score = i[best], j[best], score[best]
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(own[i]), names.take(pa.array(j)), pa.array(score)],
                                                     ["q", "query_id", "ids", "score"])
    return run


_NONE = np.iinfo(np.int64).max


def _first_two(names: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the second id of each list, ``_NONE`` where there is none."""
    start, size = names.offsets.to_numpy()[:-1], names.value_lengths().to_numpy()
    flat = np.append(names.values.to_numpy(), _NONE)
    return flat[start], np.where(size > 1, flat[np.where(size > 1, start + 1, 0)], _NONE)


def op6(spark, sf_dir: str) -> DataFrame:
    """op6: for every vec_id divisible by 50 the five best of all other rows."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    whole = rows.withColumn("embedding", F.transform("embedding", lambda x: F.when(
        ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.floor(x.cast("double") * 256))))
    return top_k(whole, F.col("vec_id") % 50 == 0, 5)


#: The same result by comparing every query with every row.
OP6_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings
           where embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
      from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 5
"""
