"""Language-model scoring of documents by a gated recurrent network with class-factored output.

Counting   Word counts over all training documents (those outside fold 0 of 10): hashed words are counted in the
           tasks and summed by Spark. Every token's base probability, and the share of rare words in the
           model's, comes from this table.
Training   All tokens of all training documents, in every round. Data-parallel rounds: every task runs truncated
           backpropagation through time over its documents in NumPy (windows of ``WINDOW`` tokens, the state
           carried from one to the next through the whole document, Adam), Spark averages the tasks' weights by
           tokens, and the next round starts from the average.
Scoring    A document's log-likelihood is summed window by window with the state carried to its end; no text is cut.
           Many documents move through the network together, sorted by length.

The network knows the ``WORDS`` most frequent tokens (the end among them) in classes: P(word) = P(class) P(word |
class). All other words share one entry, which is divided among them as in the base model, so every token has
a probability. Words are lower-cased (A-Z) runs between the six spaces, hashed to 64 bits.

Frequent words' counts go to all tasks (``COMMON`` entries, a fixed bound). Other words are joined with the count
table by a shuffle, exactly. Documents are told apart by row, so repeated and null ids score each by themselves.
Null texts are empty: one end token. Without training documents all base probabilities are those of 0.1 / 0.1.
"""

from __future__ import annotations

from itertools import chain
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_words, fold, stored

HIDDEN, WORDS, CLASS_SIZE, COMMON = 16, 1022, 32, 1 << 17
WINDOW, BATCH, ROUNDS, RATE = 16, 256, 2, 0.02
LANES, GROUP_TOKENS = 512, 1 << 20
END = np.uint64(0x5851F42D4C957F2D)  # the end token's hash
SIZE = WORDS + 2  # two more entries: rare words, and one unused that fills the last class
RARE = WORDS


# ---------------------------------------------------------------- counting

def _tokens(column):
    """(a, b, hashes with ends, owner): as document_words, with one end token after each document's words."""
    for a, b, words, owner in document_words(column):
        n = b - a
        ends = np.searchsorted(owner, np.arange(n), side="right")
        yield a, b, np.insert(words, ends, END), np.insert(owner, ends, np.arange(n))


def _survey(batches):
    """Rows (h, n) of word counts."""
    held: list[tuple] = []
    size = 0

    def merged():
        h = np.concatenate([x[0] for x in held])
        n = np.concatenate([x[1] for x in held])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(n, first) if len(h) else n

    def counts(h, n):
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    for batch in batches:
        for _, _, h, _ in _tokens(batch.column(0)):
            u, n = np.unique(h, return_counts=True)
            held.append((u, n.astype(np.int64)))
            size += len(u)
            if size > 1 << 20:
                held[:] = [merged()]
                size = len(held[0][0])
                if size > 1 << 20:  # what a task holds is bounded; Spark adds the parts
                    yield counts(*held.pop())
                    size = 0
    if held:
        yield counts(*merged())


class Vocabulary:
    """The COMMON most frequent words: entry of a hash, -1 beyond; counts; totals of the training tokens."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int):
        """Entries in order of frequency, the end token moved to entry 0."""
        self.keys, self.counts, self.tokens, self.distinct = hashes, counts, tokens, distinct
        self.total = tokens + 0.1 * (distinct + 1)
        self.base = np.log10((counts + 0.1) / self.total)
        known = float((counts[:WORDS] + 0.1)[counts[:WORDS] > 0].sum())
        #: log10 of the factor between a rare word's base probability and its probability among the rare ones
        self.rare = float(np.log10(self.total / max(self.total - known, 0.1)))
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int32)
        place = (hashes >> self.shift).astype(np.int64)
        for k, p in enumerate(place.tolist()):
            while self.slots[p] >= 0:
                p += 1
            self.slots[p] = k

    def entries(self, h: np.ndarray) -> np.ndarray:
        place = (h >> self.shift).astype(np.int64)
        out = self.slots[place]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != h))
        while len(wrong):
            place[wrong] += 1
            got = self.slots[place[wrong]]
            out[wrong] = got
            wrong = wrong[(got >= 0) & (self.keys[got] != h[wrong])]
        return out


# ---------------------------------------------------------------- the network

def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """x: the gates' input by token (held by gate, as xt); u: the gates' recurrent weights; c, d: classes; w, v: words of the classes."""

    SHAPES = {"xt": (3 * HIDDEN, SIZE), "u": (HIDDEN, 3 * HIDDEN), "c": (HIDDEN, SIZE // CLASS_SIZE), "d": (SIZE // CLASS_SIZE,),
              "w": (SIZE, HIDDEN), "v": (SIZE,)}

    def __init__(self, flat: np.ndarray):
        self.flat, self.rooms = flat.astype(np.float32), {}
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, self.flat[at:at + n].reshape(shape))
            at += n
        self.x = self.xt.T

    @classmethod
    def first(cls, counts: np.ndarray) -> Network:
        """Random recurrent part; the output starts at the tokens' shares."""
        rng = np.random.default_rng(0)
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.SHAPES.values())))
        net.x[:] = rng.normal(0, 0.3, net.x.shape)
        net.u[:] = rng.normal(0, 0.3, net.u.shape)
        net.c[:] = rng.normal(0, 0.05, net.c.shape)
        net.w[:] = rng.normal(0, 0.05, net.w.shape)
        share = (counts + 0.1) / (counts + 0.1).sum()
        by_class = share.reshape(-1, CLASS_SIZE)
        net.d[:] = np.log(by_class.sum(1))
        net.v[:] = np.log(by_class / by_class.sum(1, keepdims=True)).ravel()
        return net

    def room(self, name: str, *shape: int) -> np.ndarray:
        """An array that this network uses again in every window, uninitialised."""
        n = prod(shape)
        if name not in self.rooms or len(self.rooms[name]) < n:
            self.rooms[name] = np.empty(n, np.float32)
        return self.rooms[name][:n].reshape(shape)

    def steps(self, tokens: np.ndarray, h: np.ndarray):
        """States [steps, lanes, HIDDEN] after each row of ``tokens`` [steps, lanes] from state ``h`` [lanes, HIDDEN], and what
        backpropagation needs; both hold until the next call. Inside, lanes are the last axis: every gate is one block."""
        steps, lanes = tokens.shape
        states = self.room("states", steps + 1, HIDDEN, lanes)
        states[0] = h.T
        gates, inner = self.room("gates", steps, 3 * HIDDEN, lanes), self.room("inner", steps, HIDDEN, lanes)
        gates[:] = np.take(self.xt, tokens, axis=1, out=self.room("x", 3 * HIDDEN, steps, lanes), mode="clip").transpose(1, 0, 2)
        across = np.ascontiguousarray(self.u.T)
        a, part = np.empty((3 * HIDDEN, lanes), np.float32), np.empty((HIDDEN, lanes), np.float32)
        for t in range(steps):
            np.matmul(across, states[t], out=a)
            zr, n = gates[t, :2 * HIDDEN], gates[t, 2 * HIDDEN:]  # z, r and n take the places of their inputs
            zr += a[:2 * HIDDEN]
            np.negative(zr, zr)
            np.exp(zr, zr)
            zr += 1
            np.reciprocal(zr, zr)
            inner[t] = a[2 * HIDDEN:]
            np.multiply(zr[HIDDEN:], inner[t], part)
            n += part
            np.tanh(n, n)
            after = np.subtract(states[t], n, states[t + 1])
            after *= zr[:HIDDEN]
            after += n
        return states[1:].transpose(0, 2, 1), (states, gates, inner)

    def log_probabilities(self, states: np.ndarray, target: np.ndarray, grad=None):
        """Natural log P of each target after its state; with ``grad`` (a Network of gradients, weights) also
        adds the gradients of the weighted sum and returns that of the states, transposed."""
        s = self.room("s", HIDDEN + 1, len(target))
        s[:HIDDEN] = states.T
        return self._log_probabilities(s, target, grad)

    def _log_probabilities(self, s: np.ndarray, target: np.ndarray, grad=None):
        """``log_probabilities`` of the states in the columns of ``s`` but for its last row, which takes the biases."""
        n = len(target)
        s[HIDDEN] = 1
        kind, j = np.divmod(target, CLASS_SIZE)
        into, weight = grad if grad is not None else (None, None)
        c, w = np.vstack([self.c, self.d]), np.hstack([self.w, self.v[:, None]])
        out, e = _softmax(np.matmul(c.T, s, out=self.room("logits", SIZE // CLASS_SIZE, n)), kind, weight)
        back = None
        if grad is not None:
            moved = e @ s.T
            into.c += moved[:, :HIDDEN].T
            into.d += moved[:, HIDDEN]
            back = np.matmul(self.c, e, out=self.room("back", HIDDEN, n))
        # words in their classes: targets in order of class, one product a class
        order = np.argsort(kind.astype(np.int16), kind="stable")
        ends = np.cumsum(np.bincount(kind, minlength=SIZE // CLASS_SIZE)).tolist()
        parts = [(k, a, b) for k, (a, b) in enumerate(zip([0, *ends], ends)) if a < b]
        s = np.take(s, order, axis=1, out=self.room("sorted", HIDDEN + 1, n), mode="clip")
        w = w.reshape(-1, CLASS_SIZE, HIDDEN + 1)
        logits = self.room("logits", CLASS_SIZE, n)
        for k, a, b in parts:
            np.matmul(w[k], s[:, a:b], out=logits[:, a:b])
        chosen, e = _softmax(logits, j[order], weight[order] if grad is not None else None)
        out[order] += chosen
        if grad is not None:
            moved = np.zeros_like(w)
            for k, a, b in parts:
                np.matmul(e[:, a:b], s[:, a:b].T, out=moved[k])
            moved = moved.reshape(SIZE, HIDDEN + 1)
            into.w += moved[:, :HIDDEN]
            into.v += moved[:, HIDDEN]
            for k, a, b in parts:  # the states are not needed any more
                np.matmul(w[k, :, :HIDDEN].T, e[:, a:b], out=s[:HIDDEN, a:b])
            place = np.empty_like(order)
            place[order] = np.arange(n)
            back += np.take(s[:HIDDEN], place, axis=1, out=self.room("s", HIDDEN, n), mode="clip")
        return out, back

    def gradients(self, tokens: np.ndarray, target: np.ndarray, weight: np.ndarray, h: np.ndarray, into: Network | None = None):
        """(gradient of the weighted log-likelihood, last state) of one window [steps, lanes]; ``h`` is taken as given. With
        ``into`` the gradient is added to it."""
        into = Network(np.zeros_like(self.flat)) if into is None else into
        steps, lanes = tokens.shape
        after, (states, gates, inner) = self.steps(tokens, h)
        s = self.room("s", HIDDEN + 1, steps * lanes)
        s[:HIDDEN].reshape(HIDDEN, steps, lanes)[:] = after.transpose(2, 0, 1)
        _, back = self._log_probabilities(s, target.ravel(), (into, weight.ravel()))
        back = back.reshape(HIDDEN, steps, lanes).transpose(1, 0, 2)
        z, r, n, before = gates[:, :HIDDEN], gates[:, HIDDEN:2 * HIDDEN], gates[:, 2 * HIDDEN:], states[:-1]
        factors = self.room("factors", steps, 4 * HIDDEN, lanes)  # of the state's gradient
        by_z, by_r, by_a, by_n = (factors[:, k * HIDDEN:(k + 1) * HIDDEN] for k in range(4))
        keep = self.room("keep", steps, HIDDEN, lanes)
        np.subtract(1, z, keep)
        np.subtract(before, n, by_z)
        by_z *= z
        by_z *= keep
        np.multiply(n, n, by_n)
        np.subtract(1, by_n, by_n)
        by_n *= keep
        np.multiply(by_n, r, by_a)
        np.subtract(1, r, by_r)
        by_r *= by_a
        by_r *= inner
        dh, part = np.zeros((HIDDEN, lanes), np.float32), np.empty((HIDDEN, lanes), np.float32)
        for t in range(steps - 1, -1, -1):
            dh += back[t]
            f = factors[t].reshape(4, HIDDEN, lanes)
            f *= dh
            dh *= z[t]
            dh += np.matmul(self.u, factors[t, :3 * HIDDEN], out=part)
        into.u += np.matmul(before, factors[:, :3 * HIDDEN].transpose(0, 2, 1)).sum(0)
        inputs = self.room("x", 3, HIDDEN, steps, lanes)
        for k, by in enumerate((by_z, by_r, by_n)):
            inputs[k] = by.transpose(1, 0, 2)
        place = tokens.ravel()
        for row, g in zip(into.xt, inputs.reshape(3 * HIDDEN, -1)):
            np.add.at(row, place, g)
        return into.flat, states[-1].T


def _softmax(logits: np.ndarray, chosen: np.ndarray, weight: np.ndarray | None):
    """(log of the softmax down each column at its ``chosen`` row, the weighted gradient of that) of ``logits``, which are used up."""
    columns = np.arange(len(chosen))
    logits -= logits.max(0)
    out = logits[chosen, columns]
    e = np.exp(logits, out=logits)
    total = e.sum(0)
    out -= np.log(total)
    if weight is not None:
        e *= -weight / total
        e[chosen, columns] += weight
    return out, e


def _windows(groups):
    """(lanes, first, tokens, target, weight) of windows [steps, lanes] over all documents of ``groups`` (ids, starts).

    A lane goes through a document window by window (``first``: its first) and then takes the next document, so lanes
    stand empty only behind the last ones.
    """
    ids, steps = np.zeros(0, np.int64), np.arange(WINDOW)
    begin, left, last, first = (np.zeros(BATCH, np.int64) for _ in range(4))
    nothing = np.zeros(0, np.int64), np.zeros(1, np.int64)
    for new, starts in chain(groups, [nothing]):
        held = np.flatnonzero(left)
        ids = np.concatenate([*[ids[i:i + n] for i, n in zip(begin[held].tolist(), left[held].tolist())], new])
        begin[held] = np.cumsum(left[held]) - left[held]
        starts, lengths, at = starts + (len(ids) - len(new)), np.diff(starts), 0
        while True:
            free = np.flatnonzero(left == 0)[:len(lengths) - at]
            begin[free], left[free], last[free], first[free] = starts[at:at + len(free)], lengths[at:at + len(free)], 0, 1
            at += len(free)  # last: entry 0 is the end token
            lanes = np.flatnonzero(left)
            if not len(lanes) or len(lanes) < BATCH and len(lengths) and left.sum() < GROUP_TOKENS:
                break  # the next documents fill the lanes first, if what waits is not too long
            inside = steps[:, None] < left[lanes]
            target = ids.take(begin[lanes] + steps[:, None], mode="clip")
            target *= inside
            before = np.vstack([last[lanes], target[:-1]])
            yield lanes, first[lanes] == 1, before, target, inside.astype(np.float32)
            last[lanes], first[lanes] = target[-1], 0
            done = np.minimum(left[lanes], WINDOW)
            begin[lanes] += done
            left[lanes] -= done


def _train(flat, vocabulary):
    """One round over a task's documents: (block, weights times tokens, tokens) of the weights it ends with."""
    def groups(batches):
        for batch in batches:
            for a, b, h, owner in _tokens(batch.column(0)):
                yield entry_ids(vocabulary.value, h), np.searchsorted(owner, np.arange(b - a + 1))

    def run(batches):
        net = Network(flat.value.copy())
        m, s = np.zeros_like(net.flat), np.zeros_like(net.flat)
        h, total, spare = np.zeros((BATCH, HIDDEN), np.float32), Network(np.zeros_like(net.flat)), np.empty_like(net.flat)
        tokens = step = held = 0

        def climb():
            nonlocal m, s, step
            step += 1
            g, a = total.flat, spare
            g /= held
            np.subtract(g, m, a)
            a *= 0.1
            m += a
            g *= g
            g -= s
            g *= 0.01
            s += g
            np.divide(s, 1 - 0.99 ** step, g)
            np.sqrt(g, g)
            g += 1e-6
            np.divide(m, g, a)
            a *= RATE / (1 + step / 100) / (1 - 0.9 ** step)
            net.flat += a
            total.flat[:] = 0

        for lanes, first, before, target, weight in _windows(groups(batches)):
            h[lanes[first]] = 0
            _, h[lanes] = net.gradients(before, target, weight, h[lanes], total)
            n = int(weight.sum())
            tokens, held = tokens + n, held + n
            if 2 * held >= WINDOW * BATCH:  # the last lanes' windows are few tokens each: one step for several
                climb()
                held = 0
        if held:
            climb()
        if tokens:
            blocks = np.array_split(net.flat.astype(np.float64) * tokens, 16)
            yield pa.RecordBatch.from_arrays([pa.array(range(16), pa.int32()), pa.array([b.tobytes() for b in blocks], pa.binary()),
                                              pa.array([tokens] * 16, pa.int64())], ["block", "sums", "tokens"])
    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
    return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()]),
                     "tokens": pa.array([sum(table.column("tokens").to_pylist())], pa.int64())})


def entry_ids(vocabulary: Vocabulary, h: np.ndarray) -> np.ndarray:
    ids = vocabulary.entries(h)
    return np.where((ids < 0) | (ids >= WORDS), RARE, ids).astype(np.int64)


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Network:
    """Rounds of local training on all of ``texts`` (one column) and averaging. Two-step sums: no task gathers all tasks' weights."""
    sc = texts.sparkSession.sparkContext
    counts = np.zeros(SIZE)
    known = vocabulary.counts[:WORDS]
    counts[:len(known)] = known
    counts[RARE] = max(vocabulary.tokens - known.sum(), 0)
    net = Network.first(counts)
    shared = sc.broadcast(vocabulary)  # COMMON entries
    schema = "block int, sums binary, tokens long"
    for _ in range(rounds):
        parts = texts.mapInArrow(_train(sc.broadcast(net.flat), shared), schema)
        parts = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(64)))
        once = parts.groupBy("block", "salt").applyInArrow(_added, schema)
        got = {r["block"]: np.frombuffer(r["sums"], np.float64) / r["tokens"]
               for r in once.groupBy("block").applyInArrow(_added, schema).collect()}  # one set of weights
        if len(got) < 16:
            break
        net = Network(np.concatenate([got[k] for k in range(16)]))
    return net


# ---------------------------------------------------------------- scoring

def _likelihoods(net: Network, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """log10 likelihood of each document ids[first[i]:first[i + 1]], from the zero state after an end token."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    out = np.zeros(len(length))
    for g in range(0, len(order), LANES):
        docs = order[g:g + LANES]
        left, begin = length[docs], first[docs]
        h = np.zeros((len(docs), HIDDEN), np.float32)
        last = np.zeros(len(docs), np.int64)  # the end token before
        for t in range(0, int(left[0]), WINDOW):
            n = int(np.searchsorted(-left, -t, side="left"))  # documents with more than t tokens
            steps = min(WINDOW, int(left[0]) - t)
            place = begin[:n, None] + t + np.arange(steps)[None, :]
            inside = t + np.arange(steps)[None, :] < left[:n, None]
            target = np.where(inside, ids[np.minimum(place, len(ids) - 1)], 0)
            tokens = np.hstack([last[:n, None], target[:, :-1]]).T
            states, _ = net.steps(tokens, h[:n])
            rows = np.flatnonzero(inside.T)
            s = states.transpose(2, 0, 1).reshape(HIDDEN, -1)
            if len(rows) < s.shape[1]:
                s = np.take(s, rows, axis=1)
            p, _ = net.log_probabilities(s.T, target.T.ravel()[rows])
            owner = rows % n
            out[docs[:n]] += np.bincount(owner, weights=p, minlength=n)
            h, last = states[-1], target[:, -1]
    return out / np.log(10)


_DOCS = ("row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, h long, n long")


def _score(network, vocabulary):
    """Document rows, and rows (row, h, n) of the words that are not among the common ones."""
    names = [x.strip().split(" ")[0] for x in _DOCS.split(",")]

    def run(batches):
        from pyspark import TaskContext
        net, words = Network(network.value), vocabulary.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            pending, size = [], 0
            for a, b, h, owner in _tokens(batch.column(2)):
                pending.append((a, b, h, owner))
                size += len(h)
                if size >= GROUP_TOKENS:
                    yield from score(batch, pending, net, words, row)
                    pending, size = [], 0
            if pending:
                yield from score(batch, pending, net, words, row)
            row += batch.num_rows

    def score(batch, pending, net, words, row):
        a, b = pending[0][0], pending[-1][1]
        h = np.concatenate([x[2] for x in pending])
        owner = np.concatenate([x[3] + x[0] - a for x in pending])
        entry = words.entries(h)
        n, common = b - a, entry >= 0
        tokens = np.bincount(owner, minlength=n)
        ids = np.where(common & (entry < WORDS), entry, RARE).astype(np.int64)
        value = _likelihoods(net, ids, np.concatenate([[0], np.cumsum(tokens)]))
        base = np.where(common, words.base[entry], 0.0)
        value += np.bincount(owner, weights=np.where(ids == RARE, base + words.rare, 0.0), minlength=n)
        known = np.bincount(owner, weights=common & (words.counts[entry] > 0), minlength=n).astype(np.int64)
        empty = pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([
            pa.array(np.arange(row + a, row + b)), batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(tokens),
            pa.array(known), pa.array(np.bincount(owner, weights=base, minlength=n)), pa.array(value), *empty], names)
        rare = ~common
        hashes, of = h[rare].view(np.int64), (owner[rare] + row + a)
        for at in range(0, len(hashes), 1 << 18):
            k = len(hashes[at:at + (1 << 18)])
            yield pa.RecordBatch.from_arrays([
                pa.array(of[at:at + k]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()),
                pa.nulls(k, pa.float64()), pa.nulls(k, pa.float64()), pa.array(hashes[at:at + k]), pa.array(np.ones(k, np.int64))], names)
    return run


def common(counts: DataFrame, most: int = COMMON) -> DataFrame:
    """At most ``most`` rows of ``counts`` (h, c): the highest classes of frequency, 64 to a doubling, and of the next class
    the words with the lowest hashes. Two histograms of bounded size find the cut, so no task sorts or sends more."""
    level, place = F.floor(F.log2("c") * 64), F.shiftrightunsigned("h", 50)
    left, cut = most, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):
        if r["count"] > left:
            cut = r["level"]
            break
        left -= r["count"]
    if cut is None:
        return counts
    low = 0
    for r in sorted(counts.filter(level == cut).groupBy(place.alias("place")).count().collect()):
        left -= r["count"]
        if left < 0:
            break
        low = r["place"] + 1
    return counts.filter((level > cut) | ((level == cut) & (place < low)))


def score_documents(df: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``key`` an integer column."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), (fold(F.col(key), folds) == 0).alias("held_out"),
                     F.col(text).cast("string").alias("text"))
    learnt = rows.filter("not held_out").select("text")
    counts = stored(learnt.mapInArrow(_survey, "h long, n long").groupBy("h").agg(F.sum("n").alias("c")), "lm-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = sorted(common(counts).collect(), key=lambda r: (-r["c"], r["h"]))  # at most COMMON rows
    h, c = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], np.int64)
    ends = counts.filter(F.col("h") == F.lit(int(END.view(np.int64)))).first()  # not only if it is among the top
    ends = ends["c"] if ends else 0
    vocabulary = Vocabulary(np.concatenate([[END], h[h != END]]).astype(np.uint64), np.concatenate([[ends], c[h != END]]),
                            total["n"], total["v"])
    net = train(learnt, vocabulary)
    sc = spark.sparkContext
    scored = stored(rows.mapInArrow(_score(sc.broadcast(net.flat), sc.broadcast(vocabulary)), _DOCS), "lm-scores")
    rare = (scored.filter("h is not null").groupBy("h", "row").agg(F.sum("n").alias("n")).join(counts, "h", "left")
            .withColumn("c", F.coalesce("c", F.lit(0))).groupBy("row").agg(
                F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"), F.sum("n").alias("m"),
                F.sum(F.col("n") * F.log10((F.col("c") + 0.1) / vocabulary.total)).alias("rest")))
    rest, known = F.coalesce("rest", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return scored.filter("h is null").drop("h", "n").join(rare, "row", "left").select(
        F.col("doc_id").alias(key), "held_out", "n_tokens", (F.col("n_known") + known).alias("n_known"),
        F.lit(total["n"]).cast("long").alias("train_tokens"), (F.col("base") + rest).alias("base_score"),
        (F.col("score") + rest + F.coalesce("m", F.lit(0)) * vocabulary.rare).alias("score"))


def op7(spark, sf_dir: str) -> DataFrame:
    """op7: base and model log-likelihood of every document."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
