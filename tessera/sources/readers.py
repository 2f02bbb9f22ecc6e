"""Sources and sinks (S-1 ... S-6, S-12, S-13).

``load`` picks the reader from the extension, like the reference's ingestor,
and also accepts Parquet. Excel workbooks are read as binary files and parsed
per file in ``mapInPandas`` into long cell rows, which Spark pivots into a
table -- a directory of workbooks is read in parallel.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import clean

SUPPORTED = (".csv", ".json", ".xlsx", ".parquet")
# Tokens pandas reads as missing in CSV files.
NA_TOKENS = ["", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "#N/A", "n/a", "-NaN", "-nan"]


def _ext(path: str) -> str:
    m = re.search(r"(\.[A-Za-z0-9]+)$", path.rstrip("/"))
    return m.group(1).lower() if m else ""


def load(spark: SparkSession, path: str, fmt: str | None = None, schema=None, do_clean: bool = True,
         orient: str = "auto", multi_line: bool = False) -> DataFrame:
    """S-1 ... S-4: read CSV / JSON / xlsx / Parquet; unknown extension -> ``ValueError``.
    ``orient`` is the JSON layout (see ``read_json``); ``multi_line`` says that CSV values hold line feeds,
    which keeps Spark from splitting a file."""
    ext = f".{fmt}" if fmt else _ext(path)
    if ext not in SUPPORTED:
        raise ValueError(f"Unsupported file type: {ext}")
    if ext == ".csv":
        df = read_csv(spark, path, schema, multi_line)
    elif ext == ".json":
        df = read_json(spark, path, schema, orient)
    elif ext == ".xlsx":
        df = read_xlsx(spark, path)
    else:
        df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
    return clean(df) if do_clean else df


def read_csv(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """S-1: CSV with header. Missing-value tokens become null on the text, before types are inferred from what
    is left (one aggregate): a number column that holds ``NA`` stays a number column."""
    text = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line).csv(path)
    text = text.select(*[F.when(~F.trim(F.col(f"`{c}`")).isin(*NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in text.columns])
    if schema is None:
        return _infer_types(text)
    from pyspark.sql import types as T
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return text.select(*[F.col(f"`{c}`").try_cast(f.dataType).alias(f.name) for c, f in zip(text.columns, kinds.fields)])


#: Types tried for a text column, narrowest first.
CSV_TYPES = ("int", "bigint", "double", "boolean", "timestamp")


#: First rows that rule types out before the whole table is looked at.
PROBE_ROWS = 1000


def _infer_types(df: DataFrame) -> DataFrame:
    """Each string column as the first of CSV_TYPES that all its values parse as. One value that does not parse rules a type
    out, so the first rows are asked first (a failing parse is dear); what they leave is checked over the table in one aggregate."""
    def fits(c, kind):
        v, shape = F.col(f"`{c}`"), {"int": "^[+-]?[0-9]+$", "bigint": "^[+-]?[0-9]+$", "timestamp": "^[0-9]{4}-"}.get(kind)
        ok = v.try_cast(kind).isNotNull()
        return F.bool_and(F.when(v.isNotNull(), F.trim(v).rlike(shape) & ok if shape else ok))
    checks = {(i, k): None for i in range(len(df.columns)) for k in CSV_TYPES}
    for rows in (df.limit(PROBE_ROWS), df):
        asked = [at for at, fit in checks.items() if fit is not False]
        if asked:
            found = rows.agg(*[fits(df.columns[i], k).alias(f"{i}_{k}") for i, k in asked]).first()
            checks.update(zip(asked, found))
    kind = [next((k for k in CSV_TYPES if checks[i, k]), None) for i in range(len(df.columns))]
    return df.select(*[(F.col(f"`{c}`").try_cast(k) if k else F.col(f"`{c}`")).alias(c) for c, k in zip(df.columns, kind)])


def _looks_column_oriented(text) -> F.Column:
    """``{"col": {"0": v, ...}, ...}``: an object of objects whose keys are row numbers."""
    inner = F.from_json(text, "map<string, map<string, string>>")
    rows = F.forall(F.map_values(inner), lambda m: m.isNotNull() & F.forall(F.map_keys(m), lambda k: k.rlike("^[0-9]+$")))
    return text.startswith("{") & F.coalesce(rows, F.lit(False)) & (F.size(inner) > 0)


def _json_orient(spark: SparkSession, path: str) -> str:
    """The layout that all files have, from aggregates; no text leaves the executors. Files of an object on each of several lines
    are recognised line by line, in splits; only other layouts, which cannot be split, are looked at file by file."""
    text = F.ltrim("value")
    plain = text.startswith("{") & F.from_json(text, "map<string, string>").isNotNull() & ~_looks_column_oriented(text)
    lines = spark.read.text(path).where(F.trim("value") != "").agg(F.count(F.lit(1)).alias("n"), F.count_if(plain).alias("objects")).first()
    if lines["n"] > 1 and lines["objects"] == lines["n"]:
        return "lines"
    r = spark.read.text(path, wholetext=True).agg(F.bool_and(_looks_column_oriented(text)).alias("columns"),
                                                  F.bool_and(text.startswith("[")).alias("records")).first()
    return "columns" if r["columns"] else "records" if r["records"] else "lines"


def read_json(spark: SparkSession, path: str, schema=None, orient: str = "auto") -> DataFrame:
    """S-3: JSON by ``orient``: ``records`` (one array of objects, or one object, a file), ``lines`` (an object per
    line; files are split) or ``columns`` (pandas' ``{"col": {"0": v}}``). ``auto`` finds out in one scan more; only
    ``records`` and ``columns`` files, which Spark cannot split either, are looked at whole."""
    orient = _json_orient(spark, path) if orient == "auto" else orient
    if orient == "columns":
        return _column_oriented_json(spark, path)
    if orient not in ("records", "lines"):
        raise ValueError(f"Unknown JSON layout: {orient}")
    r = spark.read.option("multiLine", orient == "records")
    return r.schema(schema).json(path) if schema else r.json(path)


def _column_oriented_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    parsed = raw.select("path", F.from_json("value", "map<string, map<string, string>>").alias("m"))
    cells = parsed.select("path", F.explode("m").alias("column_name", "rows")) \
        .select("path", "column_name", F.explode("rows").alias("row", "value"))
    cols = [r[0] for r in cells.select("column_name").distinct().orderBy("column_name").collect()]  # column names: metadata
    wide = cells.groupBy("path", F.col("row").cast("long").alias("_row")).pivot("column_name", cols).agg(F.first("value"))
    return _infer_numeric(wide.drop("path", "_row"))


def _infer_numeric(df: DataFrame) -> DataFrame:
    """Cast string columns whose every non-null value is numeric to double (one aggregate)."""
    checks = df.agg(*[F.bool_and(F.when(F.col(f"`{c}`").isNotNull(), F.col(f"`{c}`").try_cast("double").isNotNull()))
                      .alias(c) for c in df.columns]).first()
    return df.select(*[(F.col(f"`{c}`").try_cast("double") if checks[c] else F.col(f"`{c}`")).alias(c)
                       for c in df.columns])


XLSX_CELLS = "path string, row int, col int, value string"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def _col_index(ref: str) -> int:
    letters = re.match(r"[A-Z]+", ref).group(0)
    n = 0
    for ch in letters:
        n = n * 26 + (ord(ch) - 64)
    return n - 1


def _first_sheet(z: zipfile.ZipFile) -> str:
    """Part name of the first sheet in the workbook's own order, which need not be that of the file names."""
    names = z.namelist()
    sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        first = next(ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"), None)
        rel = first is not None and first.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")
        for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels")) if rel else ():
            target = r.get("Target", "").lstrip("/")
            target = target if target.startswith("xl/") else f"xl/{target}"
            if r.get("Id") == rel and target in names:
                return target
    return sheets[0]


def parse_xlsx_cells(path: str, content: bytes) -> pd.DataFrame:
    """Cells of the first worksheet as (path, row, col, value) using only the stdlib."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ET.fromstring(z.read("xl/sharedStrings.xml"))
            for si in root.findall("m:si", _NS):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")))
        root = ET.fromstring(z.read(_first_sheet(z)))
    rows, rnum = [], -1
    for r in root.iter(f"{{{_NS['m']}}}row"):
        rnum = int(r.get("r")) - 1 if r.get("r") else rnum + 1  # the row number is optional
        cnum = -1
        for c in r.findall("m:c", _NS):
            cnum = _col_index(c.get("r")) if c.get("r") else cnum + 1
            t = c.get("t")
            v = c.find("m:v", _NS)
            if t == "s" and v is not None:
                val = shared[int(v.text)]
            elif t == "inlineStr":
                val = "".join(x.text or "" for x in c.iter(f"{{{_NS['m']}}}t"))
            else:
                val = v.text if v is not None else None
            rows.append((path, rnum, cnum, val))
    return pd.DataFrame(rows, columns=["path", "row", "col", "value"])


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """S-2: first sheet of each workbook; the first row is the header."""
    files = spark.read.format("binaryFile").load(path)

    def parse(it):
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"]):
                yield parse_xlsx_cells(p, bytes(content))
    cells = files.mapInPandas(parse, XLSX_CELLS)
    header = cells.where(F.col("row") == 0).select("path", "col", F.col("value").alias("name"))
    names = [r["name"] for r in header.select("col", "name").distinct().orderBy("col").collect()]  # header only
    body = cells.where(F.col("row") > 0).join(header, ["path", "col"])
    wide = body.groupBy("path", "row").pivot("name", names).agg(F.first("value"))
    return _infer_numeric(wide.orderBy("path", "row").drop("path", "row"))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S-12: CSV with header."""
    df.write.mode(mode).option("header", True).csv(path)


def to_json_rows(df: DataFrame) -> DataFrame:
    """S-13: one JSON document per row (``to_json(struct(*))``)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
