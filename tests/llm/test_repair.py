"""Conversation repair, whitening and reversible line dedup against brute force."""

import hashlib
import random
import re
from functools import lru_cache
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import conversation, line_dedup, whitening

from .conftest import ODD

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("query, sql, table", [(conversation.op11, conversation.OP11_SQL, "conversations"),
                                               (line_dedup.op13, line_dedup.OP13_SQL, "documents")])
def test_query_matches_sql(spark, query, sql, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted((tuple(r) for r in query(spark, SF).select(*columns).collect()), key=str) == sorted(found.fetchall(), key=str)


# ---------------------------------------------------------------- conversations

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    return out


def brute(rows):
    """The contract by trying all edits, shortest string first, from any row and grammar state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
    seen, marks, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        marks.append(fault)
        if fault:
            count[fault] += 1

    @lru_cache(None)
    def best(i, state, inserted):  # state: initials so far as one of "", "s", "u", "a"
        some = []
        if i == len(rows) and state in ("", "a"):
            some.append((0, "", ()))
        if inserted < 3:
            to = "a" if state == "u" else "u"
            c, a, t = best(i, to, inserted + 1)
            some.append((c + 2, "I" + a, ({"u": "user:", "a": "assistant:"}[to], *t)))
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, t = best(i + 1, state, 0)
            some.append((c + 3, "D" + a, t))
            if marks[i] in (None, "truncated"):
                extra = marks[i] is not None
                for edit, new in (("K", role), ("R", "user"), ("R", "assistant")):
                    to = new[:1]
                    if (to == "u" and state != "u") or (to == "a" and state == "u") or (to == "s" and state == "" and edit == "K"):
                        c, a, t = best(i + 1, to, 0)
                        some.append((c + extra + 2 * (edit == "R"), edit + a, (f"{new}:{text}", *t)))
        return min(some) if some else (1 << 30, "", ())

    cost, audit, lines = best(0, "", 0)
    turns = {r[1] for r in rows if r[1] is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expected(rows):
    out = {conv: [] for conv, *_ in rows}
    for r in damage(rows):
        out[r[0]].append(r)
    return {conv: brute(own) for conv, own in out.items()}


def conversations():
    rng, rows = random.Random(5), []
    for conv in range(60):
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "u", None])
            text = rng.choice(["yes.", "no", "done!", "why? ", " ", "", "\t\n", "a. b", None, f"text {rng.randint(0, 99)}."])
            rows.append((conv, rng.choice([turn, turn, turn + rng.randint(0, 3), None]), role, text))
    rows += [(None, 1, "user", "hi."), (None, None, "assistant", "é?"), (1000, 5, "system", "only."), *[(1001, t, "user", "same.") for t in range(30)]]
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, cost double, audit string"


@pytest.mark.parametrize("most", [1, 3, 1024])
def test_repair_by_trying_all_edits(spark, most):
    rows = conversations()
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], COLUMNS)
    got = conversation.repair(conversation.damaged(df), segment_rows=most)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    found = {r["conv_id"]: tuple(r[c] for c in names) for r in got.collect()}
    assert got.count() == len(found)
    assert found == expected(rows)


def test_repair_of_a_long_conversation_spreads_over_tasks(spark):
    rows = [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 400}.") for t in range(3000)] + [(8, 0, "user", "x.")]
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], COLUMNS)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        segments = conversation._segments(df.withColumn("copies", F.lit(1)), df.schema["conv_id"].dataType, 100)
        assert segments.filter("conv_id = 7").select("part").distinct().count() > 1
        got = {r["conv_id"]: r for r in conversation.repair(df, segment_rows=100).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got[7]["duplicate"] == 2600 and got[7]["audit"] == "K" * 400 + "D" * 2600 and got[7]["cost"] == 7800
    text = "\n".join(f"{r[2]}:{r[3]}" for r in rows[:400])
    assert got[7]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_repair_of_nothing_and_of_long_texts(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert conversation.repair(conversation.damaged(empty)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "y" * 3_000_000 + "."), (1, 1, "assistant", "z" * 3_000_000)], "conv_id long, turn long, role string, text string")
    (row,) = conversation.repair(df).collect()
    assert (row["cost"], row["audit"], row["truncated"]) == (1, "KK", 1)


def test_nodes_are_shared_by_common_suffixes():
    automaton = conversation.Automaton()
    automaton.read(True, conversation.END, "auau")
    before = list(automaton.nodes)
    automaton.read(True, conversation.END, "auaxs")
    assert all(a is b for a, b in zip(before[:4], automaton.nodes[:4])) and len(automaton.nodes) == 6


# ---------------------------------------------------------------- whitening

def whitened(spark, rows, k=16):
    df = spark.createDataFrame([(*r, 0.25) for r in rows], "vec_id long, embedding array<double>, whitened double")
    return whitening.whiten(df, components=k)


def check_whitened(spark, rows, k=16):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([v for _, v in good])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    e, q = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    got = whitened(spark, rows, k).collect()
    some = int((e > 1e-9).sum())
    assert len(got) == len(good) * some
    deviation = {}
    for (i, _), own in zip(good, x):
        deviation.setdefault(i, []).append(sum((n * int(a) - int(b)) ** 2 for a, b in zip(own, sums)))
    assert all(r["n"] == n and r["deviation"] in deviation[r["vec_id"]] and r["identity_error"] < 1e-9 for r in got)
    for r in got:
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace((fit - sums / n).T @ (fit - sums / n) / n), rel=1e-9)
    return good, x, e, q, sums / n, got


def test_whitening_by_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=24) * np.geomspace(1, 0.05, 24) + 3).tolist()) for i in range(300)]
    rows += [(i, rows[0][1]) for i in range(300, 500)]  # one vector holds a third of the rows
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 24), (903, [float("-inf")] * 24), (None, rows[5][1])]
    good, x, e, q, mean, got = check_whitened(spark, rows)
    place = {i: k for k, (i, _) in enumerate(good)}
    want = (x - mean) @ q / np.sqrt(e)
    found = np.zeros_like(want)
    for r in got:
        found[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    signs = np.sign((want * found).sum(axis=0))
    assert np.abs(found * signs - want).max() < 1e-8


def test_triangles_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(9)
        check_whitened(spark, [(i, rng.normal(size=8).tolist()) for i in range(200)])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_whitening_of_degenerate_tables(spark):
    rng = np.random.default_rng(4)
    few = [(i, rng.normal(size=20).tolist()) for i in range(6)]  # rank 5
    check_whitened(spark, few)
    flat = [(i, [*rng.normal(size=4).tolist(), 1.0, 0.0]) for i in range(40)]  # constant dimensions
    check_whitened(spark, flat)
    assert whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0  # one distinct vector
    assert whitened(spark, [(1, []), (2, None)]).count() == 0
    assert whitened(spark, few).limit(0).count() == whitened(spark, [(1, None)]).count() == 0
    huge = whitened(spark, [(1, [1e300, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])]).collect()  # held within bounds
    assert len(huge) and {r["deviation"] for r in huge if r["vec_id"] == 1} == {None}
    both = whitened(spark, few + [(100 + i, rng.normal(size=3).tolist()) for i in range(9)]).groupBy("n").count().collect()
    assert sorted(map(tuple, both)) == [(6, 30), (9, 27)]  # each length by itself


@pytest.mark.parametrize("seed", range(4))
def test_qd_solver_keeps_relative_accuracy(seed):
    rng = np.random.default_rng(seed)
    a, b = np.abs(rng.normal(size=30)) * np.geomspace(1, 1e-12, 30), np.abs(rng.normal(size=29)) * np.geomspace(1, 1e-12, 29)
    matrix = np.diag(a) + np.diag(b, 1)
    values = whitening.dqds(a, b)
    z = whitening.directions(a, b, values, 30)
    assert np.abs(z.T @ z - np.eye(30)).max() < 1e-9
    # ||Bz|| = sigma, also for the smallest, twelve digits below the largest
    assert np.abs(np.linalg.norm(matrix @ z, axis=0) / np.sqrt(values) - 1).max() < 1e-3
    assert np.allclose(np.sqrt(values[:10]), np.linalg.svd(matrix, compute_uv=False)[:10], rtol=1e-10)


def test_qd_solver_on_clusters():
    q = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0]
    for spectrum in (np.ones(40), np.r_[np.full(10, 5.0), np.ones(30)], 1 + np.arange(40) * 1e-13, np.r_[np.ones(20), np.zeros(20)]):
        values, z = whitening.principal(whitening.triangle(np.diag(spectrum) @ q), 16)
        assert len(values) == 16 and np.allclose(np.sqrt(values), np.sort(spectrum)[::-1][:16])
        assert np.abs(z.T @ z - np.eye(16)).max() < 1e-11


# ---------------------------------------------------------------- lines

def brute_clean(texts, counted, threshold=3, points=1):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    count = {}
    for t in counted:
        for k in {key(x) for x in (t or "").split("\n")}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < points or count.get(key(x), 0) < threshold]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def texts(seed, n=120):
    rng = random.Random(seed)
    some = ["Licence LINE", " licence line\t", "ÄÖ", "äö", "", " ", "rare 1", "x", "　wide　"]
    return ["\n".join(rng.choice(some) if rng.random() < 0.4 else f"own {rng.randint(0, 400)}" for _ in range(rng.randint(1, 6))) for _ in range(n)] + ODD


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "k", 9) for i, t in enumerate(rows)], "doc_id long, text string, kept string, n_lines int")


def cleaned(index, df, **how):
    return sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in line_dedup.clean(index, df, **how).collect())


@pytest.mark.parametrize("points", [0, 1, 3])
def test_lines_by_counting(spark, points):
    rows = texts(1)
    df = docs(spark, rows)
    index = line_dedup.insert(line_dedup.empty(spark, 3, points), df)
    assert cleaned(index, df) == brute_clean(rows, rows, 3, max(points, 1))


def test_deletions_undo_insertions(spark):
    a, b = texts(1), texts(2)
    first = line_dedup.insert(line_dedup.empty(spark, 3), docs(spark, a))
    both = line_dedup.insert(first, docs(spark, b))
    assert cleaned(both, docs(spark, b)) == brute_clean(b, a + b)
    back = line_dedup.delete(both, docs(spark, b))
    assert cleaned(back, docs(spark, a)) == brute_clean(a, a)
    keys = lambda i: {tuple(r) for r in i.refs.filter("n != 0").select("k1", "k2", "n").collect()}
    assert keys(back) == keys(first)
    marks = lambda i: sorted(sorted(x for x in np.frombuffer(bytes(r["slots"]), np.uint32) if x) for r in i.filters.collect())
    assert marks(back) == marks(first)
    # documents that the index has not seen
    assert cleaned(first, docs(spark, b), inserted=False) == brute_clean(b, a)
    none = line_dedup.delete(back, docs(spark, a))
    assert keys(none) == set() and cleaned(none, docs(spark, a)) == brute_clean(a, [])


def test_lines_of_nothing(spark):
    df = docs(spark, ["a"]).limit(0)
    index = line_dedup.insert(line_dedup.empty(spark), df)
    assert line_dedup.clean(index, df).count() == 0


def test_several_shards_and_rounds(spark, monkeypatch):
    rows = [f"line {i % 500}\nmore {i % 37}\nown {i}" for i in range(3000)]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 100)
    monkeypatch.setattr(line_dedup, "ROUND_BYTES", 2 * line_dedup.BUCKETS * line_dedup.SLOTS * 4)
    index = line_dedup.insert(line_dedup.empty(spark, 6), docs(spark, rows[:1000]))
    index = line_dedup.insert(index, docs(spark, rows[1000:]))
    assert index.shards >= 8 and index.filters.count() > 4
    assert cleaned(index, docs(spark, rows)) == brute_clean(rows, rows, 6)


def test_cuckoo_filter_beyond_its_slots():
    rng = np.random.default_rng(0)
    n = line_dedup.BUCKETS * line_dedup.SLOTS + 50
    k1, k2 = (rng.integers(-2**63, 2**63 - 1, n) for _ in range(2))
    own = line_dedup.Cuckoo()
    places = np.stack(line_dedup._places(k1, k2), axis=1)
    for row in places.tolist():
        own.insert(*row)
    assert len(own.stash) >= 50
    again = line_dedup.Cuckoo(*own.row())
    held = line_dedup.Held(1, [(0, *again.row())], [(int(k1[0]), int(k2[0]))])
    hits = held.hits(k1, k2)
    assert hits[1:].all() and not hits[0]
    for row in places[100:].tolist():
        again.delete(*row)
    assert line_dedup.Held(1, [(0, *again.row())], []).hits(k1, k2).sum() in range(100, 103)
