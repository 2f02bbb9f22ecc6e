"""Personal data in texts by weak supervision, with DataFrame and SQL expressions only.

1. Candidates. For each kind (email, ip, card, phone) the base pattern's leftmost non-overlapping matches and
   those of a wider pattern (spelt-out addresses, IPv6, dotted card groups, national phone numbers).
   Positions follow from the lengths of the pieces between matches, so a text is scanned once for each pattern.
2. Labelers vote +1, 0 or -1 on every candidate: the base pattern (regex), the kind's arithmetic rule,
   a gazetteer (top-level domains, issuer prefixes, dialling codes, address ranges), cue words in the
   text before it, and the characters at its edges.
3. Expectation-maximisation estimates, for each kind, how often each labeler casts each vote on true and on
   false candidates. It runs over the table of distinct vote patterns (at most 3^5 for a kind), as a fold.
4. A logistic span classifier learns the estimated truth from votes and shape of the spans, again as a fold
   over distinct feature patterns.

A base match that passes its rule is always a span; a wider candidate is one if the classifier gives it
``threshold`` or more and it overlaps no base span. Offsets are code points, ends exclusive.

Null texts are empty and have no spans; columns of ``df`` pass through unless they bear a result's name. Repeated rows have the
same spans each and count as often in the estimates; spans that begin alike are ordered by kind. An empty table gives an
empty table.
Quantifiers that cannot give back are possessive: same matches, no deep recursion and linear time on long runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns. (\G or no such character before) starts each run once.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests without which a pattern cannot match.
GUARD = {"email": "contains(_text, '@')", "ip": "_digit and contains(_text, '.')", "card": "_digit",
         "phone": "_digit and contains(_text, '+')"}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++"
             r"(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.])[0-9]{4}(?:\.[0-9]{4}){3}(?![0-9.])",
    "phone": r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
}
WIDE_GUARD = {"email": r"_text rlike '(?i)[\\[( ]dot[\\]) ]'", "ip": "_digit and contains(_text, ':')",
              "card": "_digit and contains(_text, '.')", "phone": "_digit"}

# gazetteers: values in use, not results of this corpus
DOMAINS = ("com org net edu gov mil int info biz name pro io co ai app dev me tv us uk de fr es it nl be ch at se no dk fi "
           "pl pt gr ie cz hu ro ru ua tr in cn jp kr au nz ca mx br ar cl za eu").split()
CUES = {"email": "e-?mail|contact|write|mailto|correo|courriel", "ip": "ip|address|server|host|adresse|servidor",
        "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta|payment",
        "phone": "phone|tel|call|fax|mobile|cell|telefon|t[eé]l[eé]phone|tel[eé]fono|whatsapp"}
AGAINST = "version|isbn|issn|doi|order|invoice|serial|article|page|section|token|hash|sha|md5|build|release"

LABELERS = ("regex", "rule", "gazetteer", "context", "edges")
_VOTES = 3 * len(LABELERS)
EM_STEPS, FIT_STEPS, BLOCK = 30, 120, 128


def _matches(df: DataFrame, name: str, pattern: str, guard: str) -> DataFrame:
    """``name``: array of (start, stop, m) of the pattern's matches in _text."""
    empty = "cast(array() as array<string>)"
    text, lit = F.col("_text"), F.lit(pattern)
    df = df.withColumn(name + "_m", F.when(F.expr(guard), F.regexp_extract_all(text, lit, F.lit(0))).otherwise(F.expr(empty)))
    df = df.withColumn(name + "_p", F.when(F.size(name + "_m") > 0, F.split(text, pattern, -1)).otherwise(F.expr(empty)))
    df = df.withColumn(name + "_g", F.expr(
        f"transform({name}_m, (x, i) -> length({name}_p[i]) + if(i > 0, length({name}_m[i - 1]), 0))"))
    df = df.withColumn(name + "_b", F.expr(
        f"if(size({name}_g) = 0, cast(array() as array<int>), transform(sequence(0, (size({name}_g) - 1) div {BLOCK}), "
        f"b -> aggregate(slice({name}_g, int(b * {BLOCK} + 1), {BLOCK}), 0, (s, x) -> s + x)))"))
    start = (f"aggregate(slice({name}_b, 1, int(i div {BLOCK})), 0, (s, x) -> s + x) + "
             f"aggregate(slice({name}_g, int(i div {BLOCK}) * {BLOCK} + 1, i % {BLOCK} + 1), 0, (s, x) -> s + x)")
    return df.withColumn(name, F.expr(
        f"transform(transform({name}_m, (m, i) -> named_struct('start', {start}, 'm', m)), "
        "c -> named_struct('start', c.start, 'stop', c.start + length(c.m), 'm', c.m))")).drop(
        *[name + x for x in ("_m", "_p", "_g", "_b")])


_DIGITS = "regexp_replace(c.m, '[^0-9]', '')"
_LUHN = ("aggregate(sequence(1, length({d})), 0, (s, i) -> s + if((length({d}) - i) % 2 = 1, "
         "if(int(substr({d}, i, 1)) > 4, 2 * int(substr({d}, i, 1)) - 9, 2 * int(substr({d}, i, 1))), int(substr({d}, i, 1)))) % 10 = 0")
RULE = {
    "email": "true",
    "ip": "forall(split(c.m, '[.]'), x -> length(ltrim('0', x)) <= 3 and coalesce(try_cast(ltrim('0', x) as int), 0) <= 255)",
    "card": f"if(length({_DIGITS}) between 13 and 19, {_LUHN.format(d=_DIGITS)}, false)",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
WIDE_RULE = {"email": "length(c.m) <= 254", "ip": "true", "card": RULE["card"], "phone": "true"}
GAZETTEER = {
    "email": f"lower(regexp_extract(c.m, '([A-Za-z0-9-]+)$', 1)) in ({', '.join(repr(x) for x in DOMAINS)})",
    "ip": "contains(c.m, ':') or not regexp_like(c.m, '^(0|22[4-9]|23[0-9]|24[0-9]|25[0-5])[.]')",
    "card": f"regexp_like({_DIGITS}, '^(4|5[1-5]|2[2-7]|3[47]|30|36|38|6011|62|64|65|35)')",
    "phone": f"regexp_like(c.m, '^[+](1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])') or not startswith(c.m, '+')",
}


def _votes(kind: str, wide: bool) -> str:
    """The struct of a candidate c with its labelers' votes (indices 3 * labeler + vote + 1) and shape."""
    before = "substr(_text, greatest(c.start - 39, 1), least(c.start, 40))"
    edge = "substr(_text, greatest(c.start, 1), if(c.start > 0, 1, 0)) || ' ' || substr(_text, c.stop + 1, 1)"
    rule = WIDE_RULE[kind] if wide else RULE[kind]
    votes = [
        "if(rule, 1, 0)" if not wide else "-1" if kind == "phone" else "0",
        "if(rule, 1, -1)",
        f"if({GAZETTEER[kind]}, 1, -1)",
        rf"case when regexp_like({before}, '(?i)\\b({CUES[kind]})\\b[^.!?]*$') then 1 "
        rf"when regexp_like({before}, '(?i)\\b({AGAINST})\\b[^.!?]*$') then -1 else 0 end",
        f"if(regexp_like({edge}, '[A-Za-z0-9_]'), -1, 1)",
    ]
    shape = (f"array({_VOTES} + least(length(c.m) div 6, 5), {_VOTES + 6} + least(size(regexp_extract_all(c.m, '[^A-Za-z0-9]', 0)), 5), "
             f"{_VOTES + 12} + {1 if wide else 0})")
    body = ", ".join(f"{3 * j + 1} + " + v.replace("rule", f"({rule})") for j, v in enumerate(votes))
    return (f"named_struct('kind', '{kind}', 'start', c.start, 'stop', c.stop, 'wide', {str(wide).lower()}, "
            f"'rule', {rule}, 'v', array({body}), 's', {shape})")


FEATURES = _VOTES + 14


def candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """``df`` with an array of voted candidates, base ones by kind and start first; no shuffle."""
    keep = [c for c in df.columns if c != out]
    df = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    df = df.withColumn("_digit", F.col("_text").rlike("[0-9]"))
    for kind in KINDS:
        df = _matches(df, f"_b_{kind}", BASE[kind], GUARD[kind])
        df = _matches(df, f"_w_{kind}", WIDE[kind], WIDE_GUARD[kind])
    parts = []
    for kind in KINDS:
        parts += [f"transform(filter(_b_{kind}, c -> {RULE[kind]}), c -> {_votes(kind, False)})",
                  f"transform(_w_{kind}, c -> {_votes(kind, True)})"]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.expr(f"concat({', '.join(parts)})").alias(out))


def reliabilities(found: DataFrame, column: str = "candidates") -> DataFrame:
    """(kind, prior, yes, no): the share of true candidates and the votes' probabilities on true and false ones.

    ``yes`` and ``no`` have three entries (-1, 0, +1) for each labeler. One row for each kind with candidates.
    """
    patterns = (found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.v").agg(F.count("*").alias("n"))
                .groupBy("kind").agg(F.collect_list(F.struct("v", "n")).alias("p")))  # at most 3^5 for a kind
    start = lambda a, b, c: "array(" + ", ".join(f"{x}D" for _ in LABELERS for x in (a, b, c)) + ")"
    product = lambda t: f"aggregate(q.v, 1D, (z, i) -> z * s.{t}[i])"
    soft = (f"transform(p, q -> named_struct('v', q.v, 'n', q.n, 'r', s.prior * {product('yes')} / "
            f"(s.prior * {product('yes')} + (1 - s.prior) * {product('no')})))")
    share = lambda r: (f"transform(sequence(0, {_VOTES - 1}), i -> (0.5D + aggregate(e, 0D, (z, q) -> z + if(array_contains(q.v, i), "  # noqa: E731
                       f"q.n * {r}, 0D))) / (1.5D + aggregate(e, 0D, (z, q) -> z + q.n * {r})))")
    step = (f"element_at(transform(array({soft}), e -> named_struct("
            "'prior', (1D + aggregate(e, 0D, (z, q) -> z + q.n * q.r)) / (2D + aggregate(e, 0D, (z, q) -> z + q.n)), "
            f"'yes', {share('q.r')}, 'no', {share('(1 - q.r)')})), 1)")
    fold = (f"aggregate(sequence(1, {EM_STEPS}), named_struct('prior', 0.5D, 'yes', {start(0.1, 0.2, 0.7)}, "
            f"'no', {start(0.7, 0.2, 0.1)}), (s, k) -> {step})")
    return patterns.select("kind", F.expr(fold).alias("m")).select("kind", "m.prior", "m.yes", "m.no")


def classifier(found: DataFrame, reliable: DataFrame, column: str = "candidates") -> DataFrame:
    """One row: ``w``, for each kind (map) the weights of the span classifier over votes and shape."""
    product = lambda t: f"aggregate(v, 1D, (z, i) -> z * {t}[i])"
    patterns = (found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.v", "c.s").agg(F.count("*").alias("n"))
                .join(F.broadcast(reliable), "kind")  # at most four rows
                .select("kind", F.expr("concat(v, s)").alias("f"), "n",
                        F.expr(f"prior * {product('yes')} / (prior * {product('yes')} + (1 - prior) * {product('no')})").alias("r"))
                .groupBy("kind").agg(F.collect_list(F.struct("f", "n", "r")).alias("p")))  # bounded: votes x shapes
    error = ("transform(p, q -> named_struct('f', q.f, 'e', q.n * (q.r - 1 / (1 + exp(-aggregate(q.f, 0D, (z, i) -> z + w[i]))))))")
    step = (f"element_at(transform(array({error}), e -> transform(sequence(0, {FEATURES - 1}), i -> w[i] + "
            "2D * (aggregate(e, 0D, (z, q) -> z + if(array_contains(q.f, i), q.e, 0D)) / total - 0.001D * w[i]))), 1)")
    fold = f"aggregate(sequence(1, {FIT_STEPS}), array_repeat(0D, {FEATURES}), (w, k) -> {step})"
    weights = patterns.select("kind", "p", F.expr("aggregate(p, 0D, (z, q) -> z + q.n)").alias("total")).select(
        "kind", F.expr(fold).alias("w"))
    return weights.agg(F.map_from_entries(F.collect_list(F.struct("kind", "w"))).alias("w"))


def detect(df: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``df`` (without ``text`` unless ``keep_text``) with ``base`` and ``spans``: arrays of (kind, start, stop) by kind and then start.

    The candidates are written to the shared folder once; votes, patterns and the final classifier are
    computed from there, so each text is scanned once. Nothing but counts of patterns is shuffled.
    """
    df = df.drop("base", "spans", "candidates")
    found = candidates(df, text)
    found = stored(found if keep_text else found.drop(text), "pii-candidates")
    keep = [c for c in found.columns if c != "candidates"]
    reliable = stored(reliabilities(found), "pii-reliabilities")
    model = classifier(found, reliable)
    logit = "aggregate(concat(c.v, c.s), 0D, (z, i) -> z + w[c.kind][i])"
    order = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    sort = (f"transform(array_sort(transform(%s, x -> named_struct('o', {order}, 'start', x.start, 'stop', x.stop, 'kind', x.kind))), "
            "x -> named_struct('kind', x.kind, 'start', x.start, 'stop', x.stop))")
    rows = found.join(F.broadcast(model))  # one row of weights
    rows = rows.withColumn("_base", F.expr("filter(candidates, c -> not c.wide)"))
    rows = rows.withColumn("_more", F.expr(
        f"filter(candidates, c -> c.wide and 1 / (1 + exp(-{logit})) >= {threshold}D "
        "and not exists(_base, b -> b.start < c.stop and c.start < b.stop))"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], F.expr(sort % "_base").alias("base"),
                       F.expr(sort % "concat(_base, _more)").alias("spans"))


def mask(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in angle brackets; overlapping spans by the first's."""
    order = f"array_sort(transform({spans}, x -> named_struct('start', x.start, 'stop', x.stop, 'kind', x.kind)))"
    fold = (f"aggregate({order}, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> "
            "if(x.start < a.at, named_struct('at', greatest(a.at, x.stop), 'out', a.out), named_struct('at', x.stop, 'out', "
            f"concat(a.out, array(substr(`{text}`, a.at + 1, x.start - a.at), concat('<', upper(x.kind), '>'))))), "
            f"a -> concat(array_join(a.out, ''), substr(`{text}`, a.at + 1)))")
    return df.withColumn(text, F.expr(f"if(size({spans}) > 0, {fold}, `{text}`)"))


def op2(spark, sf_dir: str) -> DataFrame:
    """op2: personal data of every document; native expressions throughout."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = detect(docs, keep_text=False)
    joined = lambda c: f"array_join(transform({c}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')"
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"),
                      F.expr(joined("spans")).alias("spans"))
