"""Column expressions shared by the operators.

All of these are built-in Spark expressions (JVM side, codegen friendly);
nothing here calls back into Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)

# String layouts the datetime-role probe accepts besides ISO-8601.
DATETIME_FORMATS = ["yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "MM/dd/yyyy HH:mm:ss",
                    "dd.MM.yyyy", "dd-MMM-yyyy", "yyyyMMdd HH:mm:ss"]


def q(name: str) -> str:
    """Backtick-quote a column name for ``F.col``/SQL."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(q(name))


def kind_of(dtype: T.DataType) -> str:
    """Storage kind used by role inference: numeric, datetime, string, boolean, other."""
    if isinstance(dtype, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dtype, DATETIME_TYPES):
        return "datetime"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "other"


def clean_value(c: Column, dtype: T.DataType) -> Column:
    """NaN is a missing value (pandas semantics); Spark treats it as a value."""
    if isinstance(dtype, FLOAT_TYPES):
        return F.when(~F.isnan(c), c)
    return c


def is_missing(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, FLOAT_TYPES):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def safe4(c: Column, digits: int = 4) -> Column:
    """Non-finite or missing statistic -> 0.0, else rounded; ``+ 0.0`` folds -0.0 to 0.0."""
    d = c.cast("double")
    bad = d.isNull() | F.isnan(d) | (F.abs(d) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(F.round(d, digits) + F.lit(0.0))


def rnd(c: Column, digits: int = 4) -> Column:
    """Round keeping nulls, folding -0.0."""
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def sample_skewness(n: Column, g1: Column) -> Column:
    """Bias-corrected G1 from Spark's population skewness g1."""
    n = n.cast("double")
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def sample_excess_kurtosis(n: Column, g2: Column) -> Column:
    """Bias-corrected excess kurtosis G2 from Spark's population excess kurtosis g2."""
    n = n.cast("double")
    return F.when(n > 3, ((n - 1) / ((n - 2) * (n - 3))) * ((n + 1) * g2 + 6))


def split_hash(key: Column, seed: int = 42) -> Column:
    """Portable 32-bit hash of a key: md5 prefix, identical in DuckDB.

    ``('0x' || substr(md5('42|' || key), 1, 8))::BIGINT`` computes the same value.
    """
    s = F.concat(F.lit(f"{seed}|"), key.cast("string"))
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint")


def parses_as_datetime(c: Column) -> Column:
    """True when a string parses as ISO or one of the fixed layouts.

    Every accepted layout starts with a digit; the cheap regex guard keeps the
    (exception-driven, slow) parsers away from ordinary text.
    """
    attempts = [F.try_to_timestamp(c)] + [F.try_to_timestamp(c, F.lit(f)) for f in DATETIME_FORMATS]
    return F.when(F.trim(c).rlike("^[0-9]"), F.coalesce(*attempts).isNotNull()).otherwise(F.lit(False))


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Two-sided asymptotic KS p-value with Stephens' small-sample correction."""
    m = (n1.cast("double") * n2.cast("double")) / (n1 + n2).cast("double")
    lam = (F.sqrt(m) + 0.12 + 0.11 / F.sqrt(m)) * d
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    p = F.least(F.greatest(2.0 * series, F.lit(0.0)), F.lit(1.0))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(p)


def dagostino_k2_pvalue(n: Column, g1: Column, g2: Column) -> Column:
    """D'Agostino-Pearson omnibus p-value from population skewness/kurtosis (n >= 8)."""
    n = n.cast("double")
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = -1.0 + F.sqrt(2.0 * (beta2 - 1))
    delta = 1.0 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    ya = y / alpha
    z1 = delta * F.log(ya + F.sqrt(ya * ya + 1))
    b2 = g2 + 3.0
    e = 3.0 * (n - 1) / (n + 1)
    var = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - e) / F.sqrt(var)
    s = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + (8.0 / s) * (2.0 / s + F.sqrt(1 + 4.0 / (s * s)))
    dd = 1 + x * F.sqrt(2.0 / (a - 4.0))
    term = F.signum(dd) * F.cbrt((1 - 2.0 / a) / F.abs(dd))
    z2 = ((1 - 2.0 / (9.0 * a)) - term) / F.sqrt(2.0 / (9.0 * a))
    k2 = z1 * z1 + z2 * z2
    return F.exp(-k2 / 2.0)


def short_float_str(c: Column, digits: int = 4) -> Column:
    """Plain decimal text of a value already rounded to ``digits`` (``0.0001``, ``0.5``,
    ``12.0``), the way Python prints such floats; Spark's cast would print ``1.0E-4``."""
    s = F.regexp_replace(F.format_string(f"%.{digits}f", c), "0+$", "")
    return F.when(c.isNull(), F.lit(None)).otherwise(
        F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s))


# AS 241 (PPND16), numerator and denominator in its three ranges, ascending powers.
_PPND = (
    ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
      45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
     (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077,
      21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610)),
    ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
      1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550,
      0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
      0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)
# Hart's approximation of the normal tail, ascending powers.
_TAIL = ((220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383, 6.37396220353165, 0.700383064443688,
          0.0352624965998911),
         (440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674, 86.7807322029461, 16.064177579207,
          1.75566716318264, 0.0883883476483184))


def polynomial_sql(coefficients, x: str) -> str:
    """Horner form as SQL text that Spark and ANSI engines read alike."""
    out = f"CAST({coefficients[-1]:.20e} AS DOUBLE)"
    for c in reversed(coefficients[:-1]):
        out = f"(CAST({c:.20e} AS DOUBLE) + ({x}) * {out})"
    return out


#: Standard normal quantile ``m`` of a column ``p``: steps of names and SQL text, each over the columns before it.
INVERSE_NORMAL_STEPS = [
    {"q": "p - CAST(0.5 AS DOUBLE)"},
    {"r": "CASE WHEN abs(q) <= 0.425 THEN 0.0 ELSE sqrt(-ln(least(p, 1 - p))) END"},
    {"s": "CASE WHEN abs(q) <= 0.425 THEN CAST(0.180625 AS DOUBLE) - q * q WHEN r <= 5 THEN r - CAST(1.6 AS DOUBLE) ELSE r - 5 END"},
    {"m": "CASE " + " ".join(
        f"{when} {sign} * ({polynomial_sql(_PPND[k][0], 's')}) / ({polynomial_sql(_PPND[k][1], 's')})"
        for k, (when, sign) in enumerate((("WHEN abs(q) <= 0.425 THEN", "q"), ("WHEN r <= 5 THEN", "sign(q)"), ("ELSE", "sign(q)")))) + " END"},
]


def normal_tail_steps(z: str, out: str) -> list[dict[str, str]]:
    """Steps for ``out`` = P(Z > z), ``z`` a column name; 0 beyond 37, where the density underflows."""
    far = "a_ + 1 / (a_ + 2 / (a_ + 3 / (a_ + 4 / (a_ + CAST(0.65 AS DOUBLE)))))"
    return [
        {"a_": f"abs({z})"},
        {"e_": "exp(-a_ * a_ / 2)", "far_": f"CAST(1 AS DOUBLE) / ({far}) / CAST(2.506628274631 AS DOUBLE)",
         "near_": f"({polynomial_sql(_TAIL[0], 'a_')}) / ({polynomial_sql(_TAIL[1], 'a_')})"},
        {"up_": "CASE WHEN a_ > 37 THEN CAST(0 AS DOUBLE) WHEN a_ < 7.07106781186547 THEN e_ * near_ ELSE e_ * far_ END"},
        {out: f"CASE WHEN {z} >= 0 THEN up_ ELSE 1 - up_ END"},
    ]


def with_steps(df, steps: list[dict[str, str]]):
    """``df`` with the columns of each step added, step by step."""
    for step in steps:
        df = df.withColumns({name: F.expr(text) for name, text in step.items()})
    return df
