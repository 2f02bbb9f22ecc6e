"""Conversation structure repair on a suffix-shared automaton of role/fault signatures.

``repair`` finds each conversation's cheapest edits that make its role initials ``(s?(ua)+)?``: Keep 0, Rerole to user or
assistant 2, Delete 3 (required for blank rows and repeats of an earlier role and text), Insert an empty user or
assistant row 2; a row without a final ``[.!?]`` that is not deleted adds 1. Of the cheapest edits the ASCII-least
initials (D, I, K, R) are taken.

A row is one symbol: s, u, a or x (another initial), upper case if truncated, ``-`` if it must go. What can still happen
depends on the symbols that follow and on the grammar's state only, so signatures are read from their end and those with
a common suffix share its nodes. A node holds the cost-to-go and the best edit for each of the four states; the first
letters of a state's edits differ, so the least letter among the cheapest is the least string. Signatures of all
conversations are sorted by their reversed text, so every node is met once (and again where a task begins inside it), its
edits once for each class of equal cost differences.

Rows go to tasks by ranges of (conversation, turn), and a task cuts them into segments of at most ``segment_rows`` rows, so
a conversation of any length spreads over tasks. Conversations of one segment, nearly all, are finished where their
signature is solved. Of longer ones each segment becomes a 4 x 4 matrix of costs from state to state; a pass from the
end gives every segment the cost-to-go behind it, the segments are solved like the others, and a pass from the front
streams the chosen pieces into the audit and the hash (SHA-256 has to read a conversation in order, so this pass sees one
conversation in one task, a segment at a time).

Rows of a conversation are ordered by turn (nulls first), then role, then the text's MD5; equal rows are interchangeable.
Null roles and texts are one space, null conversation ids form one conversation. An empty role has no initial and counts as
x. Rows with ``copies`` 0 are not there, but their conversation is: without rows it has zeros, an empty audit and the
empty text's hash. Empty tables give empty tables; columns other than the four named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

#: Most rows and bytes of text in a segment (a longer row stands alone).
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 20
#: Rows that a task turns into Python objects at a time.
SLICE_ROWS = 512

BLANK = " \t\n\x0b\x0c\r"
MUST_GO = "-"
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDED = (USER, USER, ASSISTANT, USER)  # the state after the next user or assistant row that the grammar takes
ROLES = {USER: "user", ASSISTANT: "assistant"}
END = (0, 4, 2, 0)  # cost of the rows to insert where a conversation ends
FAR = 1 << 40

RESULT = [("gaps", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("cost", "long"),
          ("audit", "string"), ("repaired_sha256", "string")]


# ---------------------------------------------------------------- damage

def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows damaged by crc32(conv_id:turn) % 20 (nulls: one space).

    0 drops a row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes its role user.
    """
    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), code.alias("code"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1).alias("copies"))


# ---------------------------------------------------------------- automaton

@lru_cache(1 << 16)
def _step(symbol: str, ahead: tuple) -> tuple[tuple, tuple, tuple]:
    """(cost-to-go, edit, state after it) for each state before ``symbol``, when ``ahead`` is the cost-to-go behind it."""
    extra, kind = (1 if symbol.isupper() else 0), symbol.lower()
    kept = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}.get(kind, {})
    best = []
    for s in range(4):
        some = [(3 + ahead[s], "D", s)]
        if symbol != MUST_GO:
            if s in kept:
                some.append((extra + ahead[kept[s]], "K", kept[s]))
            some.append((2 + extra + ahead[NEEDED[s]], "R", NEEDED[s]))
        best.append(min(some))
    inserted = list(best)
    for s in (USER, ASSISTANT):
        inserted[s] = min(best[s], (2 + best[NEEDED[s]][0], "I", NEEDED[s]))
    for s in (START, SYSTEM):
        inserted[s] = min(best[s], (2 + inserted[USER][0], "I", USER))
    return tuple(zip(*inserted))


def step(symbol: str, ahead: tuple) -> tuple[tuple, tuple, tuple]:
    """``_step`` by cost differences: there are few classes of them, whatever the costs."""
    low = min(ahead)
    cost, edit, after = _step(symbol, tuple(min(c - low, FAR) for c in ahead))
    return tuple(c + low for c in cost), edit, after


class Automaton:
    """The nodes of one signature's suffixes; the next signature keeps those of their common suffix."""

    def __init__(self):
        self.key, self.reversed, self.nodes = None, "", []

    def read(self, last: bool, ahead: tuple, reversed_signature: str) -> None:
        shared = 0
        if (last, ahead) != self.key:
            self.key, self.nodes = (last, ahead), [(ahead, None, None)]
        else:
            most = min(len(self.reversed), len(reversed_signature))
            while shared < most and self.reversed[shared] == reversed_signature[shared]:
                shared += 1
            del self.nodes[shared + 1:]
        for symbol in reversed_signature[shared:]:
            self.nodes.append(step(symbol, self.nodes[-1][0]))
        self.reversed = reversed_signature

    def edits(self, state: int) -> tuple[int, str, int, list]:
        """(cost, audit, last state, [(row or None, new role or None)]) of the best edits from ``state``."""
        at, row, audit, out = len(self.nodes) - 1, 0, [], []
        cost = self.nodes[at][0][state]
        while at:
            _, edit, after = self.nodes[at]
            letter, state = edit[state], after[state]
            audit.append(letter)
            if letter == "I":
                out.append((None, ROLES[state]))
                continue
            if letter != "D":
                out.append((row, ROLES[state] if letter == "R" else None))
            at, row = at - 1, row + 1
        if not self.key[0]:
            return cost - self.nodes[0][0][state], "".join(audit), state, out
        while state in (SYSTEM, USER):  # an open turn at the conversation's end
            state = NEEDED[state]
            audit.append("I")
            out.append((None, ROLES[state]))
        return cost, "".join(audit), state, out


def rendered(edits: list, roles: list, texts: list) -> Iterator[str]:
    """The ``role:text`` lines of the edited rows."""
    for row, role in edits:
        yield f"{role}:" if row is None else f"{role or roles[row]}:{texts[row]}"


def crossing(signature: str) -> list[int]:
    """Costs from each state before ``signature`` to each state after it, row by row."""
    nodes = [tuple(0 if s == t else FAR for s in range(4)) for t in range(4)]
    for symbol in reversed(signature):
        nodes = [step(symbol, ahead)[0] for ahead in nodes]
    return [min(nodes[t][s], FAR) for s in range(4) for t in range(4)]


# ---------------------------------------------------------------- segments

def _segments(rows: DataFrame, conv_type: T.DataType, most: int) -> DataFrame:
    """One row for each run of at most ``most`` rows of a conversation, in order of (part, seq).

    ``whole``: the conversation has no other segment. The first and the last conversation of a task may go on
    in its neighbours, so they are never whole.
    """
    at = F.monotonically_increasing_id()
    last = F.right(F.rtrim(F.col("text"), F.lit(BLANK)), F.lit(1))
    first = F.substring("role", 1, 1)
    kind = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("x"))
    symbol = F.when(last == "", MUST_GO).when(last.isin(".", "!", "?"), kind).otherwise(F.upper(kind))
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.when(F.col("copies") > 0, F.col("text")).alias("text"),
                       "copies", first.alias("first"), symbol.alias("symbol"), F.md5(F.col("text").cast("binary")).alias("_text"), at.alias("_at"))
    order = ["conv_id", "turn", "role", "_text", "_at"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_text", "_at")
    schema = T.StructType([
        T.StructField("conv_id", conv_type), T.StructField("part", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("whole", T.BooleanType()),
        T.StructField("signature", T.StringType()), T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()), T.StructField("truncated", T.LongType()),
        T.StructField("illegal", T.LongType()), T.StructField("first", T.StringType()), T.StructField("final", T.StringType()),
        T.StructField("low", T.LongType()), T.StructField("high", T.LongType()), T.StructField("turns", T.LongType())])

    def run(batches):
        part, seq, conversations, held = TaskContext.get().partitionId(), 0, 0, None
        own = _Segment(None)
        for batch in batches:
            for low in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for conv, turn, role, text, copies, first, symbol in zip(*(c.to_pylist() for c in batch.slice(low, SLICE_ROWS).columns)):
                    if not conversations or conv != own.conv:
                        if conversations:
                            # the first conversation is open, the others are whole if this is their only segment
                            out.append(own.row(part, seq, conversations > 1 and own.begins))
                            seq += 1
                        conversations, own = conversations + 1, _Segment(conv)
                    for _ in range(copies):
                        if own.full(text, most):
                            out.append(own.row(part, seq, False))
                            seq, own = seq + 1, _Segment(conv, begins=False)
                        own.add(turn, role, text, first, symbol)
                if out:
                    yield _batch(out, schema)
        if conversations:
            yield _batch([own.row(part, seq, False)], schema)

    return ranged.mapInArrow(run, schema)


class _Segment:
    def __init__(self, conv, begins: bool = True):
        self.conv, self.begins = conv, begins
        self.roles, self.texts, self.signature, self.firsts, self.turns = [], [], [], [], []
        self.seen, self.size, self.faults = set(), 0, [0, 0, 0]

    def full(self, text: str, most: int) -> bool:
        return bool(self.roles) and (len(self.roles) >= most or self.size + len(text) > SEGMENT_BYTES)

    def add(self, turn, role: str, text: str, first: str, symbol: str) -> None:
        if symbol == MUST_GO:
            self.faults[0] += 1
        elif (role, text) in self.seen:
            self.faults[1] += 1
            symbol = MUST_GO
        else:
            self.seen.add((role, text))
            self.faults[2] += symbol.isupper()
        self.roles.append(role)
        self.texts.append(text)
        self.signature.append(symbol)
        self.firsts.append(first)
        self.turns.append(turn)
        self.size += len(text)

    def row(self, part: int, seq: int, whole: bool) -> tuple:
        turns = {t for t in self.turns if t is not None}
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(self.firsts, self.firsts[1:]))
        ends = (self.firsts[0], self.firsts[-1]) if self.firsts else (None, None)
        return (self.conv, part, seq, whole, "".join(self.signature), self.roles, self.texts, *self.faults, illegal, *ends,
                min(turns, default=None), max(turns, default=None), len(turns))


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)


# ---------------------------------------------------------------- long conversations

def _linked(open_segments: DataFrame) -> DataFrame:
    """Segments of long conversations with repeats of earlier segments' rows marked, and ``ahead``, the cost-to-go behind
    them (null behind the last)."""
    # the first segment of each role and text, over rows without their texts
    row = F.posexplode(F.arrays_zip("roles", "texts"))
    rows = open_segments.select("conv_id", "part", "seq", "signature", row.alias("pos", "row")).filter(
        F.expr(f"substring(signature, pos + 1, 1) != '{MUST_GO}'")).select(
        "conv_id", "pos", F.struct("part", "seq").alias("at"), F.col("row.roles").alias("role"), F.sha2(F.col("row.texts").cast("binary"), 256).alias("text"))
    first = F.min("at").over(Window.partitionBy("conv_id", "role", "text"))
    repeats = rows.withColumn("first", first).filter(F.col("at") > F.col("first")).groupBy("at").agg(F.collect_list("pos").alias("repeats"))
    marked = open_segments.join(repeats.select("at.part", "at.seq", "repeats"), ["part", "seq"], "left")
    schema = T.StructType([*open_segments.schema.fields, T.StructField("matrix", T.ArrayType(T.LongType()))])

    def mark(batches):
        for batch in batches:
            for low in range(batch.num_rows):
                r = batch.slice(low, 1).to_pylist()[0]
                symbols = list(r["signature"])
                for k in r["repeats"] or []:
                    r["truncated"] -= symbols[k].isupper()
                    symbols[k] = MUST_GO
                r["duplicate"] += len(r["repeats"] or [])
                r["signature"] = "".join(symbols)
                r["matrix"] = crossing(r["signature"])
                yield _batch([tuple(r[c] for c in schema.names)], schema)

    marked = stored(marked.mapInArrow(mark, schema), "conversation-marked")

    def back(batches):
        conv, ahead, begun = None, END, False
        for batch in batches:
            out = []
            for own, part, seq, matrix in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or own != conv:
                    conv, ahead, begun = own, None, True
                out.append((part, seq, ahead and list(ahead)))
                costs = np.array(matrix).reshape(4, 4) + np.array(ahead or END)
                ahead = tuple((costs.min(axis=1) - costs.min()).tolist())
            if out:
                kinds = pa.int64(), pa.int64(), pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["part", "seq", "ahead"])

    order = marked.select("conv_id", "part", "seq", "matrix").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seq"))
    ahead = order.mapInArrow(back, "part long, seq long, ahead array<long>")
    return marked.drop("matrix").join(stored(ahead, "conversation-ahead"), ["part", "seq"])


def _solved(segments: DataFrame, schema: T.StructType, finish) -> DataFrame:
    """``finish(row, automaton)`` for every segment, in order of the reversed signature so that suffixes are shared."""
    backwards = F.reverse("signature")
    order = ["ahead", "_reversed", "part", "seq"]
    ranged = segments.withColumn("_reversed", backwards).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            for low in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(low, 64).to_pylist():
                    last = r["ahead"] is None
                    automaton.read(last, END if last else tuple(r["ahead"]), r["_reversed"])
                    out.append(finish(r, automaton))
                yield _batch(out, schema)

    return ranged.mapInArrow(run, schema)


def repair(df: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conversation of ``df``
    (conv_id, turn, role, text and, if there, copies: how often a row stands there)."""
    conv_type = df.schema["conv_id"].dataType
    if "copies" not in df.columns:
        df = df.withColumn("copies", F.lit(1))
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "copies")
    segments = stored(_segments(rows, conv_type, segment_rows), "conversation-segments")
    result = T.StructType([T.StructField("conv_id", conv_type), *(T.StructField(n, T.LongType() if k == "long" else T.StringType()) for n, k in RESULT)])

    def finished(r, automaton):
        cost, audit, _, edits = automaton.edits(START)
        digest = sha256("\n".join(rendered(edits, r["roles"], r["texts"])).encode("utf-8", "surrogatepass")).hexdigest()
        gaps = r["high"] - r["low"] + 1 - r["turns"] if r["turns"] else 0
        return r["conv_id"], gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], cost, audit, digest

    nothing = F.lit(None).cast("array<long>")
    short = _solved(segments.filter("whole").withColumn("ahead", nothing), result, finished)

    linked = _linked(segments.filter("not whole"))
    counts = ["blank", "duplicate", "truncated", "illegal", "first", "final", "low", "high", "turns"]
    keys = ["conv_id", "part", "seq", *counts]
    pieces = T.StructType([*(linked.schema[c] for c in keys), T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType())),
                           T.StructField("after", T.ArrayType(T.LongType())), T.StructField("lines", T.ArrayType(T.ArrayType(T.StringType())))])

    def piece(r, automaton):
        found = [automaton.edits(s) for s in range(4)]
        lines = [list(rendered(x[3], r["roles"], r["texts"])) for x in found]
        return *(r[c] for c in keys), [x[0] for x in found], [x[1] for x in found], [x[2] for x in found], lines

    solved = _solved(linked, pieces, piece).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def forward(batches):
        own, begun = None, False
        for batch in batches:
            for low in range(batch.num_rows):
                r = batch.slice(low, 1).to_pylist()[0]
                if not begun or r["conv_id"] != own.conv:
                    if begun:
                        yield _batch([own.row()], result)
                    own, begun = _Whole(r["conv_id"]), True
                own.add(r)
        if begun:
            yield _batch([own.row()], result)

    return short.unionByName(solved.mapInArrow(forward, result))


class _Whole:
    """A long conversation, put together from its segments in order."""

    def __init__(self, conv):
        self.conv, self.state, self.cost, self.audit, self.hash, self.lines = conv, START, 0, [], sha256(), 0
        self.faults, self.illegal, self.final, self.low, self.high, self.turns = [0, 0, 0], 0, None, None, None, 0

    def add(self, r: dict) -> None:
        s = self.state
        self.cost += r["costs"][s]
        self.audit.append(r["audits"][s])
        for line in r["lines"][s]:
            self.hash.update((("\n" if self.lines else "") + line).encode("utf-8", "surrogatepass"))
            self.lines += 1
        self.state = r["after"][s]
        self.faults = [a + r[c] for a, c in zip(self.faults, ("blank", "duplicate", "truncated"))]
        self.illegal += r["illegal"]
        if r["first"] is not None:
            self.illegal += self.final is not None and self.final + r["first"] not in ("su", "ua", "au")
            self.final = r["final"]
        if r["turns"]:
            self.turns += r["turns"] - (r["low"] == self.high)
            self.low, self.high = r["low"] if self.low is None else self.low, r["high"]

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return self.conv, gaps, *self.faults, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


def op11(spark, sf_dir: str) -> DataFrame:
    """op11: all conversations, damaged and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: The same result by a recursion over the rows of each conversation from its end. Lists of four: the grammar's states.
OP11_SQL = r"""
with recursive base as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
coded as (
  select *, xor(list_reduce(list_concat([4294967295::bigint], range(0, 8 * length(k))), lambda c, i:
    xor((case when i % 8 = 0 then xor(c, ascii(substr(k, (i // 8 + 1)::int, 1))::bigint) else c end) // 2,
        3988292384::bigint * ((case when i % 8 = 0 then xor(c, ascii(substr(k, (i // 8 + 1)::int, 1))::bigint) else c end) % 2))),
    4294967295::bigint) % 20 as code from base),
copied as (
  select conv_id, turn, case when code = 4 then 'user' else role end as role,
         case code when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(range(case code when 0 then 0 when 3 then 2 else 1 end)) as copy from coded),
marked as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen, substr(role, 1, 1) as ini,
         right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) as fin from copied),
faults as (
  select *, fin = '' as blank, fin <> '' and seen > 1 as duplicate, fin <> '' and seen = 1 and fin not in ('.', '!', '?') as truncated,
         lag(ini) over (partition by conv_id order by i) as previous from marked),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where blank) as blank,
         count(*) filter (where duplicate) as duplicate, count(*) filter (where truncated) as truncated,
         count(*) filter (where previous is not null and previous || ini not in ('su', 'ua', 'au')) as illegal, count(*) as n
  from faults group by conv_id),
walk as (
  select conv_id, n as i, [0, 4, 2, 0]::bigint[] as c, ['', 'II', 'I', ''] as a,
         [[], ['user:', 'assistant:'], ['assistant:'], []]::varchar[][] as t from counted
  union all
  select conv_id, i, [u1.c, u2.c, e3.c, e4.c], [u1.a, u2.a, e3.a, e4.a], [u1.t, u2.t, e3.t, e4.t] from (
    select conv_id, i, e3, e4,
           least(e1, {c: 2 + e3.c, a: 'I' || e3.a, t: list_prepend('user:', e3.t)}) as u1,
           least(e2, {c: 2 + e3.c, a: 'I' || e3.a, t: list_prepend('user:', e3.t)}) as u2 from (
      select conv_id, i, b1 as e1, b2 as e2,
             least(b3, {c: 2 + b4.c, a: 'I' || b4.a, t: list_prepend('assistant:', b4.t)}) as e3,
             least(b4, {c: 2 + b3.c, a: 'I' || b3.a, t: list_prepend('user:', b3.t)}) as e4 from (
        select w.conv_id, w.i - 1 as i,
               list_min(list_filter([
                 {c: 3 + w.c[s], a: 'D' || w.a[s], t: w.t[s]},
                 case when not gone and ini = 's' and s = 1 then {c: x + w.c[2], a: 'K' || w.a[2], t: list_prepend(line, w.t[2])} end,
                 case when not gone and ini = 'u' then {c: x + w.c[3], a: 'K' || w.a[3], t: list_prepend(line, w.t[3])} end,
                 case when not gone then {c: 2 + x + w.c[3], a: 'R' || w.a[3], t: list_prepend('user:' || f.text, w.t[3])} end],
                 lambda o: o is not null)) as b1,
               list_min(list_filter([
                 {c: 3 + w.c[2], a: 'D' || w.a[2], t: w.t[2]},
                 case when not gone and ini = 'u' then {c: x + w.c[3], a: 'K' || w.a[3], t: list_prepend(line, w.t[3])} end,
                 case when not gone then {c: 2 + x + w.c[3], a: 'R' || w.a[3], t: list_prepend('user:' || f.text, w.t[3])} end],
                 lambda o: o is not null)) as b2,
               list_min(list_filter([
                 {c: 3 + w.c[3], a: 'D' || w.a[3], t: w.t[3]},
                 case when not gone and ini = 'a' then {c: x + w.c[4], a: 'K' || w.a[4], t: list_prepend(line, w.t[4])} end,
                 case when not gone then {c: 2 + x + w.c[4], a: 'R' || w.a[4], t: list_prepend('assistant:' || f.text, w.t[4])} end],
                 lambda o: o is not null)) as b3,
               list_min(list_filter([
                 {c: 3 + w.c[4], a: 'D' || w.a[4], t: w.t[4]},
                 case when not gone and ini = 'u' then {c: x + w.c[3], a: 'K' || w.a[3], t: list_prepend(line, w.t[3])} end,
                 case when not gone then {c: 2 + x + w.c[3], a: 'R' || w.a[3], t: list_prepend('user:' || f.text, w.t[3])} end],
                 lambda o: o is not null)) as b4
        from walk w join (
          select conv_id, i, ini, text, role || ':' || text as line, blank or duplicate as gone, truncated::bigint as x, 1 as s from faults) f
        on w.conv_id is not distinct from f.conv_id and w.i = f.i))))
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(w.c[1], 0)::bigint as cost,
       coalesce(w.a[1], '') as audit, sha256(coalesce(list_aggregate(w.t[1], 'string_agg', chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counted n on o.conv_id is not distinct from n.conv_id
left join walk w on o.conv_id is not distinct from w.conv_id and w.i = 0
"""
