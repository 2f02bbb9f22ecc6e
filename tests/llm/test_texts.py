"""Personal data, language, quality and language-model scores: brute force, held-out accuracy, odd texts, empty tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import gru_lm, langid, pii, quality

from .conftest import ODD, sentence

SF = "/root/testdata/sf0.01"
BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def passes(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")),
            "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if passes(k, m[0])]


PRIVATE = [
    "mail a@b.c+d@e.f or x@y or @z.com or a@b@c.de x.y-z@sub.domain-x.org.", "ips 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 10.0.0.1, 1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 and 378282246310005 0000000000000 1 2", "+1 (555) 123-4567 +12 +49.30.1234567 x+1-2-3-4-5-6-7-8-9- end",
    "née 🙂 漢字 émile@exemple.fr 🙂 +33 1 23 45 67 89", "1" * 5000 + " " + "a." * 5000 + "@x.y " + "+1" + " " * 3000 + "2345678901 ",
    "call me: phone (555) 123-4567 or 555-123-4567", "write to john [at] example [dot] com please", "server fe80:0000:0000:0000:0202:b3ff:fe1e:8329 up",
    "7.7.7.7 " * 400 + "me@you.org " * 400]


def test_op2_base_matches_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in pii.op2(spark, SF).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join("%s:%d:%d" % s for s in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert {"%s:%d:%d" % s for s in spans} <= set(r["spans"].split(","))


def test_pii_of_odd_texts(spark, odd_docs, no_docs):
    rows = [(i, t) for i, t in enumerate([*PRIVATE, *ODD])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("base", F.lit(1))
    found = pii.detect(df)
    for r in found.collect():
        assert [tuple(s) for s in r["base"]] == base_spans(r["text"])
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    masked = {r["doc_id"]: r["text"] for r in pii.mask(found).collect()}
    assert masked[0].startswith("mail <EMAIL><EMAIL> or x@y") and masked[4].startswith("née 🙂 漢字 é<EMAIL> 🙂 <PHONE>")
    assert masked[9] == "<IP> " * 400 + "<EMAIL> " * 400
    assert masked[len(PRIVATE)] is None and masked[len(PRIVATE) + 1] == ""
    out = pii.detect(odd_docs)
    assert out.count() == odd_docs.count() and out.columns.count("spans") == 1 and "score" in out.columns
    assert pii.mask(pii.detect(no_docs)).count() == 0


def test_pii_labelers_learn(spark):
    """Cue words and formats make a wide candidate a span; the same digits after an order number do not."""
    yes = [(i, f"please call phone ({200 + i}) 555-{1000 + i} now, mail u{i}@site.org, tel +1 {200 + i} 555 {1000 + i}") for i in range(60)]
    no = [(100 + i, f"order{200 + i}-555-{1000 + i}x") for i in range(60)]
    spans = {r["doc_id"]: {s["kind"] for s in r["spans"] if s["kind"] == "phone"} for r in
             pii.detect(spark.createDataFrame(yes + no, "doc_id long, text string")).collect()}
    assert all(spans[i] for i in range(60)) and not any(spans[100 + i] for i in range(60))


def test_pii_runs_no_python(spark):
    plan = pii.op2(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_language_on_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = langid.op3(spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)


def test_language_scores_by_brute_force(spark):
    """A batch's scores are those of the kernel computed set by set; long texts in pieces give the same."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(200)
    model = langid.fit(docs)
    table = langid._letters()
    for r in docs.limit(20).collect():
        c = [int(table[ord(ch)]) for ch in r["text"]]
        grams = {langid._UNI + a for a in c} | {langid._BI + (a << 7 | b) for a, b in zip(c, c[1:])}
        grams |= {a << 14 | b << 7 | d for a, b, d in zip(c, c[1:], c[2:])}
        present = np.zeros((1, model.marks.shape[0]), np.float32)
        present[0, [model.index[g] for g in grams if model.index[g] >= 0]] = 1
        raw = np.frombuffer(r["text"].encode(), np.uint8)
        one = langid._score(model, raw, np.array([0, len(raw)]))
        two = langid._score(model, np.concatenate([raw, raw]), np.array([0, len(raw), 2 * len(raw)]))
        assert one[1] == pytest.approx([float(model.scores(model.values(present)).max())], abs=1e-5)
        assert two[1] == pytest.approx(one[1] * 2, abs=1e-5) and two[0] == one[0] * 2


def test_language_of_odd_texts(spark, odd_docs, no_docs):
    out = langid.predicted(odd_docs.withColumn("lang_pred", F.lit(3)))
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == odd_docs.count() and out.columns.count("lang_pred") == 1 and got[0]["spans"] == "c"
    for i in (0, 1, 2, 3):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    assert got[8]["lang_pred"] in ("en", "de")
    assert langid.predicted(no_docs).count() == 0
    unlabelled = langid.predicted(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    single = langid.predicted(odd_docs.withColumn("lang", F.lit("xx"))).collect()
    assert {r["lang_pred"] for r in single} == {"und", "xx"}


def test_quality_on_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = quality.op4(spark, SF).collect()
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_chain_by_enumeration():
    """Marginals, pair counts and log Z of chains of different lengths against all labelings."""
    rng = np.random.default_rng(0)
    first = np.array([0, 1, 5, 7, 11])
    node, trans = rng.normal(size=(11, 2)), rng.normal(size=(2, 2))
    good, pairs, logz = quality.marginals(node, trans, first)
    for i, (a, b) in enumerate(zip(first, first[1:])):
        total, on, pair = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for code in range(2 ** (b - a)):
            y = [code >> k & 1 for k in range(b - a)]
            w = math.exp(sum(node[a + k, v] for k, v in enumerate(y)) + sum(trans[u, v] for u, v in zip(y, y[1:])))
            total, on = total + w, on + w * np.array(y)
            for u, v in zip(y, y[1:]):
                pair[u, v] += w
        assert np.allclose(good[a:b], on / total) and np.allclose(pairs[i], pair / total) and np.isclose(logz[i], math.log(total))


def test_line_table():
    texts = ["A b\n\nc c c.", "", "\n", "é|1 2"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    x, size, first = quality.line_table(raw, offsets)
    assert first.tolist() == [0, 3, 4, 6, 7] and size.tolist() == [3, 0, 6, 0, 0, 0, 6]
    assert x[2, 8] == pytest.approx(1 / 3) and x[1, quality.OWN] == 1 and x.shape == (7, quality.WIDTH)
    assert np.allclose(x[0, 1 + 2 * quality.OWN:], x[1, 1:1 + quality.OWN]) and not x[3, 1 + quality.OWN:].any()


def test_quality_of_odd_texts(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(100 + i, i % 2) for i in range(20)] + [(4, 0), (4, 1), (5, None), (None, 1)], "doc_id long, quality int")
    out = quality.scored(odd_docs, labels)
    assert out.count() == odd_docs.count() and out.columns.count("score") == 1 and "spans" in out.columns
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert quality.scored(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.scored(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r["score"] for r in quality.scored(odd_docs, labels.filter("quality = 1")).collect()} == {1.0}


# ---------------------------------------------------------------- language model

def tokens(text):
    return (text or "").encode().lower().split() + [None]


def check_base(rows, texts):
    train = Counter(t for i, x in texts for t in tokens(x) if fold("" if i is None else i, 10) != 0)
    n, v = sum(train.values()), len(train)
    seen = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows)
    expected = []
    for i, x in texts:
        t = tokens(x)
        base = sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        expected.append((i is None, i or 0, len(t), sum(train[w] > 0 for w in t), round(base, 6)))
    assert [x[:4] for x in seen] == [x[:4] for x in sorted(expected)]
    assert [x[4] for x in seen] == pytest.approx([x[4] for x in sorted(expected)], rel=1e-9, abs=1e-5)
    assert {r["train_tokens"] for r in rows} <= {n}


def test_op7_base_scores_and_gain(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = gru_lm.op7(spark, SF).collect()
    check_base(rows, texts)
    held = [r for r in rows if r["held_out"]]
    assert {r["held_out"] for r in rows} == {True, False} and all(r["score"] < 0 for r in rows)
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_of_odd_texts(spark, odd_docs, no_docs, monkeypatch):
    rows = gru_lm.score_documents(odd_docs).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert all(math.isfinite(r["score"]) for r in rows)
    assert gru_lm.score_documents(no_docs).count() == 0
    untrained = gru_lm.score_documents(odd_docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0)).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == pytest.approx(0) and math.isfinite(r["score"]) for r in untrained)


def network(seed=0):
    net = gru_lm.Network.first(np.arange(gru_lm.SIZE, 0, -1.0))
    return net


def test_network_gradient():
    """Backpropagation through one window against finite differences; probabilities of all entries sum to 1."""
    net, rng = network(), np.random.default_rng(3)
    tokens, target = rng.integers(0, gru_lm.SIZE, (5, 4)), rng.integers(0, gru_lm.SIZE, (5, 4))
    weight, h = rng.random((5, 4)).astype(np.float32), rng.normal(size=(4, gru_lm.HIDDEN)).astype(np.float32)

    def value(flat):
        n = gru_lm.Network(flat)
        s, _ = n.steps(tokens, h)
        return float((n.log_probabilities(s.reshape(-1, gru_lm.HIDDEN).astype(np.float64), target.ravel())[0] * weight.ravel()).sum())

    g, _ = net.gradients(tokens, target, weight, h)
    for i in [*np.argsort(-np.abs(g))[:12], *rng.choice(np.flatnonzero(g), 12)]:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-2
        down[i] -= 1e-2
        assert g[i] == pytest.approx((value(up) - value(down)) / 2e-2, abs=2e-3, rel=3e-2)
    s = rng.normal(size=(1, gru_lm.HIDDEN)).astype(np.float32)
    p, _ = net.log_probabilities(np.repeat(s, gru_lm.SIZE, 0), np.arange(gru_lm.SIZE))
    assert np.exp(p.astype(np.float64)).sum() == pytest.approx(1, abs=1e-4)


def test_network_carries_its_state():
    """Batched windows give each document the score of one pass over the whole of it."""
    net, rng = network(), np.random.default_rng(4)
    lengths = [1, 3, 16, 17, 100, 33, 1]
    docs = [rng.integers(0, gru_lm.SIZE, n) for n in lengths]
    got = gru_lm._likelihoods(net, np.concatenate(docs), np.cumsum([0, *lengths]))
    for d, value in zip(docs, got):
        h, last, total = np.zeros((1, gru_lm.HIDDEN), np.float32), 0, 0.0
        for w in d.tolist():
            s, _ = net.steps(np.array([[last]]), h)
            h, last = s[-1], w
            total += float(net.log_probabilities(h, np.array([w]))[0][0])
        assert value == pytest.approx(total / math.log(10), rel=1e-4)


def test_vocabulary_slots():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 5000).astype(np.uint64)
    keys[1:200] = keys[0] + np.arange(1, 200, dtype=np.uint64)  # neighbours share a slot
    voc = gru_lm.Vocabulary(keys, np.arange(5000, 0, -1), 10**6, 5000)
    assert (voc.entries(keys) == np.arange(5000)).all()
    assert (voc.entries(rng.integers(2**63, 2**64, 1000, dtype=np.uint64)) == -1).all()


def test_training_takes_every_token():
    """Windows over all documents, each in order through one lane from a new state, whatever groups they come in."""
    rng = np.random.default_rng(7)
    lengths = [1, 5000, 16, 17, *rng.integers(1, 200, 900).tolist(), 700]
    docs = [rng.integers(0, gru_lm.SIZE, n) for n in lengths]
    groups = [(np.concatenate(docs[a:a + 100]), np.cumsum([0, *lengths[a:a + 100]])) for a in range(0, len(docs), 100)]
    got, open_ = [], {}
    for lanes, first, before, target, weight in gru_lm._windows(groups):
        for k, lane in enumerate(lanes.tolist()):
            n = int(weight[:, k].sum())
            if first[k]:
                open_[lane] = []
                got.append(open_[lane])
            assert before[:n, k].tolist() == [*(open_[lane][-1:] or [0]), *target[:n - 1, k].tolist()]
            open_[lane] += target[:n, k].tolist()
    assert sorted(got) == sorted(d.tolist() for d in docs)


def test_network_learns_beyond_the_start(spark):
    """A word's successor that shows only deep in long documents is learnt."""
    text = " ".join(["w%d" % (i % 7) for i in range(100)] + ["left right"] * 3000)
    docs = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string")
    for r in gru_lm.score_documents(docs).collect():
        assert r["score"] > 0.5 * r["base_score"]


def test_end_token_beyond_the_common_words(spark, monkeypatch):
    """The end token has its count although many words are more frequent than there are documents."""
    monkeypatch.setattr(gru_lm, "COMMON", 8)
    docs = spark.createDataFrame([(i, " ".join("w%d" % (j % 40) for j in range(400))) for i in range(20)], "doc_id long, text string")
    check_base(gru_lm.score_documents(docs).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_every_language_is_learnt(spark):
    """300 languages of their own words: all are learnt, and told apart on texts that were not."""
    rng = np.random.default_rng(2)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 7))) for _ in range(12)] for _ in range(300)]
    rows = [(300 * k + j, " ".join(rng.choice(words[j], 40)), f"l{j:03d}") for j in range(300) for k in range(8)]
    df = spark.createDataFrame([(i, t, w) for i, t, w in rows], "doc_id long, text string, lang string")
    model = langid.fit(df.filter("doc_id < 2100"))
    assert len(model.langs) == 300
    test = langid.predict(df.filter("doc_id >= 2100"), model)
    assert test.filter("lang = lang_pred").count() > 270


def test_quality_learns_from_long_documents(spark):
    """All documents of one label have more lines than the fit takes of each; the label is learnt all the same."""
    good = "\n".join(f"This is line {i} of a calm and readable text." for i in range(700))
    rows = [(i, good if i % 2 else "$$$ %%% ###\n!!! 0000 @@@", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    assert model.constant is None
    got = quality.score(df, model).select("quality", "score").distinct().collect()
    assert all((r["score"] >= 0.5) == (r["quality"] == 1) for r in got)


def test_common_words_are_bounded(spark):
    counts = spark.createDataFrame([((i * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63), 1 + 1000 // (i + 1)) for i in range(3000)], "h long, c long")
    by_count = sorted((r["c"] for r in counts.collect()), reverse=True)
    for most in (10, 100, 1500):
        got = [r["c"] for r in gru_lm.common(counts, most).collect()]
        assert most * 0.9 - 2 <= len(got) <= most
        assert sorted(got, reverse=True)[:len(got) // 2] == by_count[:len(got) // 2]
    assert gru_lm.common(counts, 5000).count() == 3000


def test_network_score_by_one_token_at_a_time(spark):
    """log10 probabilities of a document against a plain forward pass."""
    net = network(3)
    ids = np.random.default_rng(1).integers(0, gru_lm.SIZE - 1, 90)
    h, last, total = np.zeros(gru_lm.HIDDEN), 0, 0.0
    sig = lambda x: 1 / (1 + np.exp(-x))
    H, C = gru_lm.HIDDEN, gru_lm.CLASS_SIZE
    for t in ids.tolist():
        g, a = net.x[last], h @ net.u
        z, r = sig(g[:H] + a[:H]), sig(g[H:2 * H] + a[H:2 * H])
        n = np.tanh(g[2 * H:] + r * a[2 * H:])
        h = n + z * (h - n)
        c = h @ net.c + net.d
        w = h @ net.w[t // C * C:(t // C + 1) * C].T + net.v[t // C * C:(t // C + 1) * C]
        total += (c[t // C] - np.log(np.exp(c).sum()) + w[t % C] - np.log(np.exp(w).sum())) / np.log(10)
        last = t
    got = gru_lm._likelihoods(net, np.concatenate([ids, ids[:5]]), np.array([0, 90, 95]))
    assert got[0] == pytest.approx(total, rel=1e-4)


def test_windows_share_their_room():
    """op7: gradients of windows of different sizes are added in place; arrays used again leave nothing of the window before."""
    rng, total, alone = np.random.default_rng(6), gru_lm.Network(np.zeros_like(network().flat)), 0
    net = network()
    for steps, lanes in ((16, 40), (16, 3), (5, 40), (16, 64)):
        tokens, target = rng.integers(0, gru_lm.SIZE, (steps, lanes)), rng.integers(0, gru_lm.SIZE, (steps, lanes))
        weight, h = rng.random((steps, lanes)).astype(np.float32), rng.uniform(-1, 1, (lanes, gru_lm.HIDDEN)).astype(np.float32)
        _, last = net.gradients(tokens, target, weight, h, total)
        g, own = network().gradients(tokens, target, weight, h)
        alone = alone + g
        assert np.allclose(last, own, atol=1e-6)
    assert np.allclose(total.flat, alone, rtol=1e-4, atol=1e-4)
