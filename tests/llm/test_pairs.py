"""Top-k search, vector near-duplicates and the Jaccard join against brute force."""

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import itq, jaccard_join, topk

from .conftest import ODD, sentence

SF = "/root/testdata/sf0.01"


def duck(sql):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return sorted(con.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("query, sql, columns", [
    (topk.op6, topk.OP6_SQL, ["query_id", "rank", "vec_id", "score"]),
    (itq.op10, itq.OP10_SQL, ["vec_id", "n_links", "component_id", "kept"]),
    (jaccard_join.op9, jaccard_join.OP9_SQL, ["doc_id", "n_shingles", "component_id"])])
def test_query_matches_sql(spark, query, sql, columns):
    assert sorted((tuple(r) for r in query(spark, SF).select(*columns).collect()), key=str) == duck(sql)


# ---------------------------------------------------------------- vectors

def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1.0, True) for r in rows], "vec_id long, embedding array<double>, score double, kept boolean")


BAD = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan"), 1.0]), (904, [float("inf"), 1.0]), (None, [1.0, 1.0])]


def brute_top(rows, k):
    out = {}
    for i, x in rows:
        if i % 2 == 0:
            scores = sorted((-int(np.dot(np.array(x, object), np.array(y, object))), j) for j, y in rows if j != i and len(x) == len(y))
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.mark.parametrize("n, low, high", [(3, -5, 5), (120, -100, 100), (40, -2**28, 2**28)])
def test_top_k(spark, n, low, high):
    rng = np.random.default_rng(n)
    rows = [(i, [float(v) for v in rng.integers(low, high, 6)]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(12)]  # copies: ties to the smaller id
    rows.append((500, [1.0, 2.0]))  # another length: compared with nothing here but itself
    df = vectors(spark, rows + BAD).withColumn("embedding", F.transform("embedding", lambda x: F.when(
        ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x.cast("long"))))
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 2 == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    expected = {q: v for q, v in brute_top([(i, [int(v) for v in x]) for i, x in rows], 5).items() if v}
    assert got == expected
    assert topk.top_k(df.limit(0), F.col("vec_id") % 2 == 0, 5).count() == 0


def brute_links(rows, threshold):
    x = {k: np.array(v, float) / np.linalg.norm(v) for k, (_, v) in enumerate(rows)}
    links = {k: {j for j in x if j != k and len(x[j]) == len(x[k]) and x[k] @ x[j] >= threshold} for k in x}
    return components(links, {k: rows[k][0] for k in x}), {k: len(v) for k, v in links.items()}


def components(links, name):
    out = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        out[k] = min(name[j] for j in seen)
    return out


@pytest.mark.parametrize("tables, radius", [(None, None), (4, 1)])
def test_near_duplicate_vectors(spark, tables, radius):
    rng = np.random.default_rng(5)
    rows = []
    for group in range(25):
        centre = rng.normal(size=32)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), list(map(float, centre + rng.normal(size=32) * 0.12))))
    rows += [(1000 + i, rows[0][1]) for i in range(700)]  # one vector in many copies: more than a block
    rows += [(2000, [0.1, 0.2]), (2001, [0.2, 0.4])]
    comp, degree = brute_links(rows, 0.95)
    got = {r["vec_id"]: r for r in itq.near_duplicates(vectors(spark, rows + BAD + [(905, [0.0, 0.0])]), 0.95, tables=tables, radius=radius).collect()}
    assert len(got) == len(rows) + len(BAD) + 1
    found = sum(got[i]["n_links"] for i, _ in rows)
    assert 0.95 * sum(degree.values()) <= found <= sum(degree.values())
    assert sum(got[rows[k][0]]["component_id"] == comp[k] for k in comp) >= 0.98 * len(rows)
    assert got[2001]["component_id"] == 2000
    for i in (900, 901, 902, 903, 904, 905, None):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert itq.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_buckets_of_several_blocks(spark):
    """Many near copies in one bucket: every pair counted once although blocks and tables share it."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=16)
    rows = [(i, list(map(float, centre + rng.normal(size=16) * 0.01))) for i in range(1300)]
    got = itq.near_duplicates(vectors(spark, rows), 0.95).collect()
    assert {r["n_links"] for r in got} == {1299} and {r["component_id"] for r in got} == {0}


def test_links_beyond_seven_bits(spark, monkeypatch):
    """Every pair of codes within 11 bits is found and counted once, by the same tables at every size."""
    assert not hasattr(itq, "MANY")  # no switch by size
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2, 64)
    rows, bits = [], []
    for i in range(60):
        flipped = base.copy()
        flipped[rng.choice(64, int(rng.integers(0, 7)), replace=False)] ^= 1
        bits.append(flipped)
        rows.append((i, [float(v) for v in np.where(flipped == 1, 1.0, -1.0) * 0.02 + 1 + 0.0001 * rng.normal(size=64)]))
    signs = {tuple(r[1]): b for r, b in zip(rows, bits)}

    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "cls long, v array<double>, n long")

    def coded(distinct, model):
        out = [(i, 1, v, int(np.packbits(signs[tuple(v)]).view("<i8")[0])) for i, v in rows]
        return spark.createDataFrame(out, "cls long, n long, v array<double>, code long")

    monkeypatch.setattr(itq, "coded", coded)
    got = {r["cls"]: r["n"] for r in itq.links(frame, {}, 0.95, itq.TABLES, itq.RADIUS).groupBy("cls").agg(F.sum("n_links").alias("n")).collect()}
    for i in range(60):
        near = sum(int((bits[i] != bits[j]).sum()) <= 11 for j in range(60) if j != i)
        assert near <= got.get(i, 0) <= 59


# ---------------------------------------------------------------- sets

@pytest.mark.parametrize("mean", [0.0, 1.0, 3.0])
def test_codes_are_balanced_whatever_the_mean(mean):
    """Vectors that share a mean spread over the buckets of a table like those that do not."""
    rng = np.random.default_rng(1)
    x = itq._unit(rng.normal(size=(20_000, 64)) + mean)
    codes = itq.Rotation(x[:4096]).codes(x)
    for table in range(4):
        _, n = np.unique(codes >> 16 * table & 0xFFFF, return_counts=True)
        assert n.max() < 60
    bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1).mean(axis=0)
    assert np.abs(bits - 0.5).max() < 0.06


def test_a_dense_group_is_not_torn_apart():
    """Two thirds of the sample are near copies of one vector: their codes stay close, the others' stay balanced."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    x = itq._unit(np.vstack([base + 0.05 * rng.normal(size=(4000, 64)), rng.normal(size=(2000, 64))]))
    codes = itq.Rotation(x).codes(x)
    differ = np.bitwise_count((codes[:4000] ^ codes[0]).view(np.uint64))
    assert np.percentile(differ, 99) <= 11
    assert np.unique(codes[4000:] & 0xFFFF, return_counts=True)[1].max() < 20
    assert len(itq.representatives(x, 0.95)) < 2100


def test_lengths_beyond_the_learnt_ones_use_all_dimensions():
    own = itq.Rotation(np.zeros((0, 256)))
    rng = np.random.default_rng(3)
    x = itq._unit(rng.normal(size=(500, 256)))
    y = x.copy()
    y[:, 64:] = rng.normal(size=(500, 192))
    assert np.bitwise_count((own.codes(x) ^ own.codes(itq._unit(y))).view(np.uint64)).mean() > 10


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", w) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_join(rows):
    sets = {k: shingles(t) for k, (_, t) in enumerate(rows)}
    links = {k: set() for k in sets}
    for a in sets:
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= 80 * (len(sets[a]) + len(sets[b]) - i):
                links[a].add(b)
                links[b].add(a)
    return sets, components(links, {k: r[0] for k, r in enumerate(rows)})


def edited(text, seed, share):
    r = random.Random(seed)
    return " ".join("new%d" % r.randint(0, 10**6) if r.random() < share else w for w in text.split())


def check_join(spark, rows, **options):
    sets, comp = brute_join(rows)
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, component_id string").repartition(3)
    got = sorted(tuple(r) for r in jaccard_join.near_duplicates(df, **options).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted((rows[k][0], len(sets[k]), comp[k]) for k in sets)


def test_join_groups(spark):
    """Exact copies, near copies at the threshold, a passage that unrelated documents share, odd texts."""
    passage = sentence(999, 80)
    rows = [(i, t) for i, t in enumerate(ODD)]
    for i in range(12):
        rows.append((100 + i, sentence(i, 90)))
        rows += [(200 + 20 * i + k, edited(rows[-1][1], 50 * i + k, share)) for k, share in enumerate((0, .01, .02, .03, .04, .05))]
        rows.append((600 + i, sentence(300 + i, 30 + 10 * i) + " " + passage))
        rows.append((700 + i, sentence(300 + i, 30 + 10 * i).upper() + "\n\t" + passage))
    rows += [rows[20]] * 3
    check_join(spark, rows)


def test_join_recursion(spark):
    """Near copies that link only through some of them, in regions of more classes than a leaf, whose source is absent."""
    base = sentence(1, 120)
    rows = [(i, edited(base, i, 0.005 + 0.03 * (i % 5) / 4)) for i in range(90)]
    check_join(spark, rows, leaf=4)
    check_join(spark, rows, leaf=64)


def test_join_of_nothing(spark):
    check_join(spark, [(1, None), (2, "")])
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.near_duplicates(df).count() == 0
    nameless = spark.createDataFrame([(None, "one two three four five six"), (7, "one two three four five six")], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in jaccard_join.near_duplicates(nameless).collect()} == {(None, 7), (7, 7)}


def test_top_k_joins_no_blocks_through_the_driver(spark):
    """tables of blocks take far more memory than their files; none of them is broadcast, however small its files."""
    rows = [(i, [float(i % 7), 1.0 + i]) for i in range(200)]
    df = vectors(spark, rows).withColumn("embedding", F.transform("embedding", lambda x: x.cast("long")))
    found = topk.top_k(df, F.col("vec_id") % 5 == 0, 3)
    assert found.count() == 120
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [x for x in re.split(r"\n(?=[ :+\-*()\d]*\w*Join)", plan) if "Join" in x.splitlines()[0]]
    wide = [x for x in plan.split("\n") if "BroadcastHashJoin" in x and re.search(r"column|q_block|\bq#", x)]
    assert joins and not wide, wide
