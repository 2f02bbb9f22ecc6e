"""Exact Jaccard join of documents' word shingles as a metric-space join, for components of linked documents.

Sets are of 64-bit shingle hashes; Jaccard distance 1 - |A n B| / |A u B| is a metric. Equal sets are one class, with
the smallest doc_id of its documents. Two classes link at ``percent`` * |A u B| <= 100 * |A n B|; call delta the
distance 1 - percent / 100.

Unrelated documents share no shingle, so they are all at distance 1 from any document pivot and such pivots
alone would leave one region. Hence two levels:

1. Pivots are the single-shingle sets {s}: at distance 1 - 1/n from a set of n shingles that holds s, else at 1.
   A set lies in the Voronoi regions of its nearest pivots, ties broken by one global order, rare shingles
   first. The boundary window is the first n - ceil(percent * n / 100) + 1 of them: a set that links with it
   misses at most the others' number, so two linked sets share a region. The order uses a fixed-size table of
   approximate frequencies; any table gives a right result, this one keeps regions small.
2. In a region, the class with the fewest rarer shingles (of a group of copies, what they were copied from) is the
   pivot and is compared with every other class exactly. What links with it is one component already and is not
   compared again. If all classes of the region are in one component the region is done. Otherwise it is joined
   recursively: the remaining pairs of different components whose distances to the pivot differ by at most
   delta (triangle inequality) are compared, all of them in a region of at most ``leaf`` classes, else those
   of further pivots, one for each of up to ``PIVOTS`` components, and so on.

A region answers for the pairs whose first common shingle it is: their common shingles are no more than those
that follow in either set, so pairs with too few of them, or with sizes that no link allows, are not compared.

Regions of a frequent shingle are salted for the counting and never collected; pivots come from partial aggregates.
No pair is compared twice, and no link between different components is lost.

Null texts and texts without words have no set and link with nothing; with fewer than ``width`` words the whole
sequence is one shingle. Rows that repeat a doc_id are documents by themselves. Null ids link, but give no
component its name. Two different sets count as equal only if their sizes and 64-bit hashes agree.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, document_words, mix64, rows_of, stored

WIDTH, PERCENT, LEAF, PIVOTS = 5, 80, 64, 64
#: Bytes of text for an entry of the frequency table, whose size follows the corpus, and the bits of its least and largest
#: size; entries of the filter of wanted ids; share of documents that makes a shingle frequent.
TABLE_BYTES, LEAST_BITS, MOST_BITS, FILTER_BITS, FREQUENT, SALTS = 128, 16, 23, 25, 0.002, 32
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


# ---------------------------------------------------------------- sets

def _hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words."""
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mix64(total + words[k:k + n] * _ODD[k % 5])
    return total


def shingle_sets(column, width: int):
    """(row, sorted distinct shingle hashes) of every text of an Arrow column, in order."""
    for a, b, words, owner in document_words(column):
        ends = np.searchsorted(owner, np.arange(b - a + 1))
        runs = _hashes(words, width) if len(words) >= width else None
        for i in range(b - a):
            lo, hi = int(ends[i]), int(ends[i + 1])
            if hi - lo >= width:
                yield a + i, np.unique(runs[lo:hi - width + 1])
            elif hi > lo:
                yield a + i, _hashes(words[lo:hi], hi - lo)
            else:
                yield a + i, np.zeros(0, np.uint64)


def _class(s: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    with np.errstate(over="ignore"):
        x = mix64(np.array([s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(s ^ _ODD[1])), np.uint64(len(s))], np.uint64))
        return int(mix64(x[:1] * _ODD[0] + x[1:2] * _ODD[2] + x[2:] * _ODD[3]).view(np.int64)[0])


def table_bits(rows: DataFrame) -> int:
    """Size of the frequency table for the texts of ``rows``, from their bytes."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, (size // TABLE_BYTES).bit_length()))


def _survey(width: int, bits: int):
    """Per document (doc, c, n); at a task's end its part of the frequency table in rows (block, counts)."""
    def run(batches):
        table = np.zeros(1 << bits, np.int32)

        def count(sets):
            at, n = np.unique((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            table[at] += n.astype(np.int32)

        for batch in batches:
            c, n, found, size = [], [], [], 0
            for _, s in shingle_sets(batch.column(1), width):
                c.append(_class(s) if len(s) else None)
                n.append(len(s))
                found.append(s)
                size += len(s)
                if size > 1 << 18:
                    count(found)
                    found, size = [], 0
            if size:
                count(found)
            empty = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int64()), pa.array(n, pa.int32()), *empty],
                                             ["doc", "c", "n", "block", "counts"])
        part = table.reshape(-1, 1 << 14)
        used = np.flatnonzero(part.any(1))
        for at in range(0, len(used), 64):
            some = used[at:at + 64]
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int32()), pa.array(some, pa.int32()),
                pa.array([zlib.compress(part[i].astype("<i4").tobytes(), 1) for i in some], pa.binary())], ["doc", "c", "n", "block", "counts"])
    return run


def _sum(table: pa.Table) -> np.ndarray:
    total = np.zeros(1 << 14, np.int64)
    for x in table.column("counts"):
        total += np.frombuffer(zlib.decompress(x.as_py()), "<i4")
    return total


def _added(table: pa.Table) -> pa.Table:
    counts = zlib.compress(_sum(table).clip(0, 2**31 - 1).astype("<i4").tobytes(), 1)
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([counts], pa.binary())})


def _levelled(table: pa.Table) -> pa.Table:
    level = np.minimum(np.log2(_sum(table) + 1.0) * 3, 127).astype(np.uint8)
    return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary())})


def frequencies(parts: DataFrame, bits: int) -> np.ndarray:
    """The frequency table as levels, three to a doubling: parts are added by block in two steps, a byte an entry goes to
    the driver (8 MB at most)."""
    parts = parts.select("block", "counts", F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("salt"))
    once = parts.groupBy("block", "salt").applyInArrow(_added, "block int, counts binary")
    out = np.zeros((1 << bits - 14, 1 << 14), np.uint8)
    for row in once.groupBy("block").applyInArrow(_levelled, "block int, counts binary").collect():
        out[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
    return out.ravel()


def _levels(level: np.ndarray, documents: int) -> np.ndarray:
    """Place of each table entry in the order (low: rare), 128 added where the shingle may be frequent."""
    often = 2 ** (float(np.median(level)) / 3) + max(64, FREQUENT * documents)
    return level + np.where(level >= min(127, 3 * np.log2(often)), 128, 0).astype(np.uint8)


def _regions(width: int, percent: int, bits: int, levels):
    """Rows (s, c, n, i, salt): the regions of every set, once for each class in a task; i shingles precede s in the order."""
    def run(batches):
        level, seen = levels.value, set()
        for batch in batches:
            rows, size = [], 0
            for _, s in shingle_sets(batch.column(0), width):
                c = _class(s) if len(s) else None
                if c is None or (c, len(s)) in seen:
                    continue
                seen.add((c, len(s)))
                place = level[(s >> np.uint64(64 - bits)).astype(np.int64)]
                key = place.astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                first = np.argsort(key, kind="stable")[:len(s) - -(-percent * len(s) // 100) + 1]
                rows.append((s[first].view(np.int64), c, len(s), np.where(place[first] >= 128, c % SALTS, -1)))
                size += len(first)
                if size > 1 << 17:
                    yield batch_of(rows)
                    rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        count = [len(r[0]) for r in rows]
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([r[0] for r in rows])), pa.array(np.repeat(np.array([r[1] for r in rows]), count)),
            pa.array(np.repeat(np.array([r[2] for r in rows], np.int32), count)),
            pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in count])),
            pa.array(np.concatenate([r[3] for r in rows]).astype(np.int32))], ["s", "c", "n", "i", "salt"])
    return run


def _sets(width: int, bits):
    """Rows (c, n, items) of the documents whose id is in the filter, once for each class in a task."""
    def run(batches):
        wanted, seen = bits.value, set()
        for batch in batches:
            at = mix64(np.asarray(batch.column(0).fill_null(0)).astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)
            keep = np.flatnonzero(wanted[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
            rows, size = [], 0
            for _, s in shingle_sets(batch.column(1).take(pa.array(keep)), width):
                c = _class(s) if len(s) else None
                if c is not None and (c, len(s)) not in seen:
                    seen.add((c, len(s)))
                    rows.append((c, s))
                    size += len(s)
                    if size > 1 << 18:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        ends = np.cumsum([0, *(len(s) for _, s in rows)]).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([s for _, s in rows]).view(np.int64)))
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()),
                                           pa.array([len(s) for _, s in rows], pa.int32()), items], ["c", "n", "items"])
    return run


def _filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^FILTER_BITS places of the ids' hashes (4 MB at any size); it passes every id of ``ids``.

    It only spares texts that no pair needs; which sets are used is decided by an exact join.
    """
    def run(batches):
        bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            at = mix64(np.asarray(batch.column(0)).astype(np.uint64)) >> np.uint64(64 - FILTER_BITS)
            np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        rows = bits.reshape(-1, 1 << 14)
        used = np.flatnonzero(rows.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["block", "bits"])

    def either(table: pa.Table) -> pa.Table:
        total = reduce(np.bitwise_or, (np.frombuffer(x.as_py(), np.uint8) for x in table.column("bits")))
        return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([total.tobytes()])})

    out = np.zeros((1 << FILTER_BITS - 17, 1 << 14), np.uint8)
    parts = ids.mapInArrow(run, "block int, bits binary").groupBy("block").applyInArrow(either, "block int, bits binary")
    for row in parts.collect():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


# ---------------------------------------------------------------- the join

def _class_key(c: str = "c", n: str = "n"):
    return F.struct(F.col(c).alias("c"), F.col(n).alias("n"))


def _fits(percent: int, n, i, m, j):
    """Whether sets of n and m shingles can link if their first common one follows i and j others."""
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT,
                    leaf: int = LEAF) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``df``; ``key`` an integer column."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    bits = table_bits(rows)
    survey = stored(rows.mapInArrow(_survey(width, bits), "doc long, c long, n int, block int, counts binary"), "jaccard-survey")
    docs = survey.filter("n is not null").select("doc", "c", "n")
    level = frequencies(survey.filter("block is not null"), bits)
    levels = spark.sparkContext.broadcast(_levels(level, docs.count()))  # 8 MB at most
    regions = _shared_regions(rows.select("text"), width, percent, bits, levels)
    low = docs.filter("c is not null").groupBy("c", "n").agg(F.min("doc").alias("low"))
    low = low.select(_class_key().alias("k"), "low")

    def compare(pairs: DataFrame) -> DataFrame:
        """The exact distances of ``pairs``, which are removed then. The sets are hashed anew from the text of each class's
        first document.

        They are not stored: both sides of a comparison read the one shuffle by class that removes duplicates. Sets of
        other documents that pass the filter by chance match no pair.
        """
        members = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        members = stored(members.join(low, "k").select("k", F.coalesce("low", F.lit(0)).alias("low")), "jaccard-wanted")
        bits = spark.sparkContext.broadcast(_filter(members.select("low")))  # 4 MB; a null id passes as 0
        found = rows.mapInArrow(_sets(width, bits), "c long, n int, items array<long>").select(_class_key().alias("k"), "items")
        out = _compared(pairs, found.dropDuplicates(["k"]), percent)
        discard(pairs, members)
        return out

    star = stored(regions.filter((F.col("p") != F.col("k")) & _fits(percent, F.col("p.n"), F.col("pi"), F.col("k.n"), F.col("i"))).select(
        F.least("p", "k").alias("a"), F.greatest("p", "k").alias("b")).distinct(), "jaccard-star")
    compared = [compare(star)]
    distance = compared[0].select("a", "b", "d").union(compared[0].select("b", "a", "d")).toDF("p", "k", "d")
    superseded = regions
    regions = regions.filter("size > 2").select("s", "k", "i", "p")  # two classes have met
    groups, heads, seen = None, None, 0
    while True:
        if len(compared) > seen and not compared[-1].filter("linked").isEmpty() or groups is None:
            groups = components(reduce(DataFrame.union, compared).filter("linked").select("a", "b"), "jaccard")
        seen = len(compared)
        if heads is not None and heads.isEmpty():
            break
        labelled = regions.join(groups.select(F.col("id").alias("k"), "component"), "k", "left").withColumn(
            "component", F.coalesce("component", "k"))
        open_ = labelled.groupBy("s").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("size"))
        open_ = open_.filter("x != y").select("s", "size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        labelled = labelled.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))  # a common shingle's rows in several tasks
        todo = labelled.join(open_, ["s", "salt"]).filter("k != p")  # p has met its whole region
        todo = stored(todo.join(distance, ["p", "k"], "left").select("s", "p", "k", "i", "component", "d", "size"), "jaccard-open")
        if todo.isEmpty():
            break
        side = lambda *names: [F.col(x).alias(y) for x, y in zip(("k", "i", "component", "d"), names)]
        # regions beyond a leaf are spread by salt; their pivots go to every salt
        salt = F.when(F.col("size") > leaf, F.pmod(F.xxhash64("k"), F.lit(SALTS))).otherwise(0).cast("int").alias("salt")
        other = todo.select("s", salt, *side("l", "j", "other", "e"))
        window = Window.partitionBy("s").orderBy("m.i", "m.k")
        heads = (todo.filter(F.col("size") > leaf).groupBy("s", "component").agg(F.min(F.struct("i", "k", "d")).alias("m"))
                 .withColumn("r", F.row_number().over(window)).filter(F.col("r") <= PIVOTS))
        heads = stored(heads.select("s", "m.k", "m.i", "component", "m.d"), "jaccard-pivots")
        asked = todo.filter(F.col("size") <= leaf).select("s", F.lit(0).alias("salt"), *side("k", "i", "component", "d")).unionByName(
            heads.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
        near = F.col("d").isNull() | F.col("e").isNull() | (F.abs(F.col("d") - F.col("e")) <= 1 - percent / 100 + 1e-12)
        pairs = stored(asked.join(other, ["s", "salt"]).filter((F.col("component") != F.col("other")) & near
                                               & _fits(percent, F.col("k.n"), F.col("i"), F.col("l.n"), F.col("j")))
                 .select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b")).distinct()
                 .join(reduce(DataFrame.union, compared).select("a", "b"), ["a", "b"], "left_anti"), "jaccard-pairs")
        if not pairs.isEmpty():
            compared.append(compare(pairs))
        regions = stored(todo.filter(F.col("size") > leaf).join(heads.select("s", "k"), ["s", "k"], "left_anti")
                         .select("s", "k", "i", "p"), "jaccard-regions")
        discard(superseded, todo)
        superseded = regions
    named = groups.join(low.withColumnRenamed("k", "id"), "id").select("id", "component", "low")
    named = named.join(named.groupBy("component").agg(F.min("low").alias("lowest")), "component").select(F.col("id").alias("k"), "lowest")
    classes = low.join(named, "k", "left").select("k.c", "k.n", F.coalesce("lowest", "low").alias("component_id"))
    return docs.join(classes, ["c", "n"], "left").select(
        F.col("doc").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def _shared_regions(texts: DataFrame, width: int, percent: int, bits: int, levels) -> DataFrame:
    """(s, k, i, p, pi, size): the regions of more than one class, without members that no other member can link with by
    size and place, each with its pivot p and the pivot's place.

    One shuffle by shingle does it all. The rows of frequent shingles are spread by salt and not looked
    into there; their regions' sizes and pivots come from partial aggregates.
    """
    spread = texts.mapInArrow(_regions(width, percent, bits, levels), "s long, c long, n int, i int, salt int")
    region = Window.partitionBy("s", "salt")
    n, i, alone = F.col("n"), F.col("i"), F.col("salt") < 0
    useful = (100 + percent) * (n - i) >= percent * (n + F.greatest(F.col("least"), F.ceil(n * percent / 100)))
    key = F.struct("i", "c", "n")
    rows = spread.withColumns({"least": F.min("n").over(region)}).filter(~alone | useful)
    rows = rows.withColumns({"p": F.min(key).over(region), "q": F.max(F.struct("c", "n")).over(region), "o": F.min(F.struct("c", "n")).over(region)})
    rows = rows.filter(~alone | (F.col("o") != F.col("q"))).select("s", "salt", "c", "n", "i", "p").distinct()
    rows = stored(rows.withColumn("size", F.count("*").over(region)), "jaccard-shared")
    member = ["s", _class_key().alias("k"), "i", F.struct("p.c", "p.n").alias("p"), F.col("p.i").alias("pi"), "size"]
    rare = rows.filter(alone).select(*member)
    often = rows.filter(~alone).drop("p", "size")
    whole = often.groupBy("s").agg(F.min("n").alias("least"), F.min(key).alias("p"), F.max(F.struct("c", "n")).alias("q"),
                                   F.min(F.struct("c", "n")).alias("o"), F.count("*").alias("size")).filter("o != q").drop("o", "q")
    out = stored(rare.unionByName(often.join(whole, "s").filter(useful).select(*member)), "jaccard-regions")
    discard(rows)
    return out


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, d, linked) with the exact Jaccard distance of each pair of classes."""
    both = F.size(F.array_intersect("x", "y"))
    joined = (pairs.join(sets.select(F.col("k").alias("b"), F.col("items").alias("y")), "b")
              .join(sets.select(F.col("k").alias("a"), F.col("items").alias("x")), "a")
              .select("a", "b", both.cast("long").alias("i"), (F.col("a.n") + F.col("b.n")).cast("long").alias("t")))
    return stored(joined.select("a", "b", (1 - F.col("i") / (F.col("t") - F.col("i"))).alias("d"),
                                (100 * F.col("i") >= percent * (F.col("t") - F.col("i"))).alias("linked")), "jaccard-compared")


def op9(spark, sf_dir: str) -> DataFrame:
    """op9: components of all documents linked at a Jaccard similarity of 0.8 of their five-word shingles."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The same result by counting the shared shingles of every pair that shares one.
OP9_SQL = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
             else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from w),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select x.doc_id as a, y.doc_id as b, count(*) as i from s x join s y on x.s = y.s and x.doc_id <> y.doc_id group by all),
links as (select a, b from i join n p on p.doc_id = a join n q on q.doc_id = b where 100 * i >= 80 * (p.n + q.n - i)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on r.b = l.a)
select a as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(b) as component_id
from reach left join n on n.doc_id = a group by a
"""
