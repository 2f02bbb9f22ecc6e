"""Language identification with a string kernel.

Kernel: blended spectrum of 1-, 2- and 3-grams of letters, by presence: the number of n-grams that two texts
share, divided by the square root of the product of their own numbers, over the n-grams that occur
in the fitting sample (the most frequent ``features`` of them). Nyström: a few landmark texts for each
language; K(text, landmarks) K(landmarks)^(-1/2) are a text's features. One-versus-rest kernel
ridge regression on these gives a value for each language. Scoring is two matrix products for a batch of
texts, presence x landmarks and kernel x weights.

Letters are lower-cased and mapped to 7 bits: a-z to themselves, other letters by a hash, everything else
to a gap; so every n-gram has a small code and tables stay small for any script.

The fit reads at most 2 * rows_per_class rows of each language (documented bound). Scoring reads whole
texts, piece by piece when they are long. A text that is null or has no letter is ``und`` with score 0. If no
row can be learnt from, every text is ``und``; with one language, every other text is that one. Ties go to the language that sorts first. Repeated rows are scored each.
Every language with a row is learnt, however many there are.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fitting_sample, fold, slices, text_buffers

#: Labelled rows of each language for the fit, landmarks among them, n-grams kept, ridge.
ROWS_PER_CLASS, LANDMARKS, FEATURES, RIDGE = 200, 32, 4096, 1e-2
#: Landmarks of all languages together: beyond 32 languages each has fewer, one at least.
ALL_LANDMARKS = 1024
#: Sharpness of the softmax that turns the regression's values into a score.
SHARPNESS = 5.0
_BITS = 7
_TRI, _BI = 0, 1 << 3 * _BITS
_UNI = _BI + (1 << 2 * _BITS)
CODES = _UNI + (1 << _BITS)

_TABLE: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code of every code point: 0 for a gap, 1-26 for a-z, 27-127 for other letters by hash."""
    if not _TABLE:
        table = np.zeros(0x110000, np.uint8)
        for cp in range(0x32400):
            c = chr(cp)
            if c.isalpha():
                low = ord(c.lower()[0])
                table[cp] = low - 96 if 97 <= low <= 122 else 27 + (low * 2654435761 >> 7) % 101
        _TABLE.append(table)
    return _TABLE[0]


def _grams(codes: np.ndarray):
    """n-gram codes at every place of one text's letter codes."""
    c = codes.astype(np.int32)
    yield _UNI + c
    if len(c) > 1:
        two = c[:-1] << _BITS | c[1:]
        yield _BI + two
    if len(c) > 2:
        yield _TRI + (two[:-1] << _BITS | c[2:])


def _codes(raw: bytes) -> np.ndarray:
    return _letters()[np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")]


def _pieces(raw: np.ndarray, limit: int = 1 << 21):
    """Letter codes of one long text in pieces that overlap by two characters."""
    codes, a = np.zeros(0, np.uint8), 0
    while a < len(raw):
        b = min(len(raw), a + limit)
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        codes = np.concatenate([codes[-2:], _codes(raw[a:b].tobytes())])
        yield codes
        a = b


def gram_sets(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, grams): distinct n-gram codes of each text as little-endian int32 bytes; bounded by the code space."""
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(1))
            out = []
            for i in range(batch.num_rows):
                seen = np.zeros(CODES, bool)
                for codes in _pieces(raw[offsets[i]:offsets[i + 1]]):
                    for g in _grams(codes):
                        seen[g] = True
                out.append(np.flatnonzero(seen).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["key", "grams"])

    return df.select(F.col(key).alias("key"), text).mapInArrow(
        run, T.StructType([T.StructField("key", kind), T.StructField("grams", T.BinaryType())]))


class Model:
    """Vocabulary index of n-gram codes, landmark presence, landmark norms, weights, languages."""

    def __init__(self, langs: list[str], rows: list[tuple[str, np.ndarray]], landmarks: int, features: int, ridge: float):
        self.langs = langs
        if not langs:
            return
        landmarks = max(1, min(landmarks, ALL_LANDMARKS // len(langs)))
        count = np.zeros(CODES, np.int64)
        for _, g in rows:
            count[g] += 1
        vocab = np.argsort(-count, kind="stable")[:features]
        vocab = vocab[count[vocab] > 0]
        self.index = np.full(CODES, -1, np.int16)
        self.index[vocab] = np.arange(len(vocab))
        presence = np.zeros((len(rows), len(vocab)), np.float32)
        for i, (_, g) in enumerate(rows):
            at = self.index[g]
            presence[i, at[at >= 0]] = 1
        taken: dict[str, int] = {}
        marks = [i for i, (lang, _) in enumerate(rows) if taken.setdefault(lang, 0) < landmarks
                 and not taken.__setitem__(lang, taken[lang] + 1)]
        self.marks = presence[marks].T.copy()
        self.norms = np.sqrt(np.maximum(self.marks.sum(0), 1))
        values, vectors = np.linalg.eigh(self.kernel(presence[marks]).astype(np.float64))
        keep = values > 1e-6 * max(values.max(), 1e-12)
        root = vectors[:, keep] / np.sqrt(values[keep])
        x = np.hstack([self.kernel(presence) @ root, np.ones((len(rows), 1))])
        y = np.where(np.array([r[0] for r in rows])[:, None] == np.array(langs)[None, :], 1.0, -1.0)
        held = Counter(lang for lang, _ in rows)
        share = np.array([1 / held[lang] for lang, _ in rows]) * len(rows) / len(held)
        xw = x * share[:, None]
        w = np.linalg.solve(x.T @ xw + ridge * len(rows) / x.shape[1] * np.eye(x.shape[1]), xw.T @ y)
        self.weights = (root @ w[:-1]).astype(np.float32)
        self.bias = w[-1].astype(np.float32)
        values = x @ w
        own = [v[langs.index(lang)] for v, (lang, _) in zip(values, rows) if lang is not None]
        others = [v.max() for v, (lang, _) in zip(values, rows) if lang is None]
        #: Half-way from the lowest of the languages' texts to the middle of the rest: what lies below is no text of theirs.
        self.floor = min(0.0, (float(min(own)) + float(np.median(others))) / 2) if others else -np.inf

    def kernel(self, presence: np.ndarray) -> np.ndarray:
        own = np.sqrt(np.maximum(presence.sum(1), 1))
        return presence @ self.marks / (own[:, None] * self.norms[None, :])

    def values(self, presence: np.ndarray) -> np.ndarray:
        """The regression's value for each language: about 1 for its texts, -1 for others."""
        return self.kernel(presence) @ self.weights + self.bias

    @staticmethod
    def scores(values: np.ndarray) -> np.ndarray:
        v = values * SHARPNESS
        e = np.exp(v - v.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_class: int = ROWS_PER_CLASS,
        landmarks: int = LANDMARKS, features: int = FEATURES, ridge: float = RIDGE, rest: bool = False) -> Model:
    """A model from the rows of ``docs`` with a language and a letter. With ``rest``, every language is also told from the
    same letters in random order, so that a text in no language has a low value for all of them."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike("\\p{L}"))
    sample = fitting_sample(known.select(key, text, lang), lang, key, rows_per_class)
    found = gram_sets(sample.select(F.struct(lang, key).alias("row"), text), "row").collect()
    rows = sorted(((r["key"][lang], np.frombuffer(r["grams"], "<i4")) for r in found), key=lambda r: (r[0], r[1].tobytes()))
    langs, rng = sorted({r[0] for r in rows}), np.random.default_rng(0)
    if rest:
        rows += [(None, _scrambled(g, rng)) for _, g in rows]
    order = rng.permutation(len(rows))
    return Model(langs, [rows[i] for i in order], landmarks, features, ridge)


def _scrambled(grams: np.ndarray, rng) -> np.ndarray:
    """As many n-grams of the same letters, drawn at random."""
    letters = grams[grams >= _UNI] - _UNI
    if not len(letters):
        return grams
    two, three = int(((grams >= _BI) & (grams < _UNI)).sum()), int((grams < _BI).sum())
    a, b = rng.choice(letters, (2, two)), rng.choice(letters, (3, three))
    return np.unique(np.concatenate([grams[grams >= _UNI], _BI + (a[0] << _BITS | a[1]), _TRI + (b[0] << 2 * _BITS | b[1] << _BITS | b[2])])).astype("<i4")


def predict(df: DataFrame, model: Model, text: str = "text", lang_col: str = "lang_pred", score_col: str = "score",
            value_col: str = "lang_value") -> DataFrame:
    """``df`` with the predicted language, its score and its value; no shuffle. Columns of these names are replaced.

    The score is a share among the learnt languages, so it depends on how many there are. The value is the language's
    own regression's: above 0 the text is on its language's side of the rest, whatever else was learnt.
    """
    names = [lang_col, score_col, value_col]
    fields = [f for f in df.schema.fields if f.name not in names]
    keep = [f.name for f in fields]
    schema = T.StructType([*fields, *(T.StructField(c, k) for c, k in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType())))])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: CODES, features x landmarks

    def run(batches):
        model = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            raw, offsets = text_buffers(column)
            langs, scores, values = [], [], []
            for a, b in slices(offsets, rows=256):
                found, share, value = _score(model, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                langs += found
                scores += share
                values += value
            rest = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(values, pa.float64())], [*keep, *names])

    return df.mapInArrow(run, schema)


def _score(model: Model, raw: np.ndarray, offsets: np.ndarray) -> tuple[list[str], list[float], list[float]]:
    """Language, score and best value of each text."""
    n = len(offsets) - 1
    if not model.langs:
        return ["und"] * n, [0.0] * n, [-1.0] * n
    features = model.marks.shape[0]
    present = np.zeros(n * features, np.float32)
    if n == 1:
        letter = False
        for codes in _pieces(raw):
            letter = letter or bool(codes.any())
            for g in _grams(codes):
                at = model.index[g]
                present[at[at >= 0]] = 1
        has = np.array([letter])
    else:
        codes = _codes(raw.tobytes())
        starts = np.zeros(len(raw) + 1, np.int64)
        np.cumsum((raw & 0xC0) != 0x80, out=starts[1:])
        ends = starts[offsets]
        owner = np.repeat(np.arange(n, dtype=np.int32) * features, np.diff(ends))
        has = np.diff(np.concatenate([[0], np.cumsum(codes > 0)])[ends]) > 0
        for k, g in enumerate(_grams(codes)):
            at = model.index[g]
            for back in range(k):  # n-grams across two documents
                cross = ends[1:-1] - 1 - back
                at[cross[(cross >= 0) & (cross < len(at))]] = -1
            ok = at >= 0
            present[owner[:len(at)][ok] + at[ok]] = 1
    values = model.values(present.reshape(n, features))
    p, best = model.scores(values), values.argmax(1)
    return ([model.langs[k] if h else "und" for k, h in zip(best.tolist(), has.tolist())],
            [v if h else 0.0 for v, h in zip(p.max(1).astype(float).tolist(), has.tolist())],
            [v if h else -1.0 for v, h in zip(values.max(1).astype(float).tolist(), has.tolist())])


def predicted(docs: DataFrame) -> DataFrame:
    """doc_id, text, held_out, lang_pred, score of all documents, learnt from those of the other folds."""
    model = fit(docs.filter(fold(F.col("doc_id"), 3) != 1))
    return predict(docs.withColumn("held_out", fold(F.col("doc_id"), 3) == 1), model)


def recognised(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in a learnt language: it has a letter, and the best language's value is nearer
    to what the fit has seen of languages than to letters in random order. Neither depends on how many languages there are."""
    model = fit(docs.filter(fold(F.col("doc_id"), 3) != 1), rest=True)
    if not model.langs:
        return docs.limit(0)
    found = predict(docs, model, lang_col="_lang", score_col="_score", value_col="_value")
    return found.filter((F.col("_lang") != "und") & (F.col("_value") >= model.floor)).select(*docs.columns)


def op3(spark, sf_dir: str) -> DataFrame:
    """op3: the language of every document, by the string kernel; the scoring is one narrow stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predicted(docs.select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")
