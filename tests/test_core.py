"""Behavioural tests modelled on the reference's unit tests (properties, not NumPy's exact draws)."""

import pytest
from pyspark.sql import functions as F


class TestIngest:
    def test_csv_roundtrip_and_roles(self, spark, regression_df, tmp_path):
        from tessera.operators.profile import schema_profile
        from tessera.sources.readers import load, write_csv
        path = str(tmp_path / "reg.csv")
        write_csv(regression_df, path)
        df = load(spark, path, fmt="csv")
        assert df.count() == 200 and "target" in df.columns
        prof = schema_profile(df).collect()
        assert {r["column_name"] for r in prof} == set(df.columns)
        assert all(r["role"] in ("numeric", "categorical", "datetime", "text", "other") for r in prof)
        roles = {r["column_name"]: r["role"] for r in prof}
        assert roles["feature_b"] == "categorical" and roles["feature_a"] == "numeric"

    def test_bad_extension(self, spark):
        from tessera.sources.readers import load
        with pytest.raises(ValueError):
            load(spark, "/tmp/file.xyz")

    def test_column_oriented_json(self, spark, tmp_path):
        import pandas as pd
        from tessera.sources.readers import load
        p = tmp_path / "c.json"
        pd.DataFrame({"a": [1.5, 2.5, None], "b": ["x", "y", "z"]}).to_json(p)
        df = load(spark, str(p))
        rows = sorted(df.collect(), key=lambda r: r["b"])
        assert [r["b"] for r in rows] == ["x", "y", "z"] and rows[0]["a"] == 1.5 and rows[2]["a"] is None

    def test_xlsx(self, spark, tmp_path):
        import zipfile
        from tessera.sources.readers import load
        sheet = ('<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>'
                 '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'
                 '<row r="2"><c r="A2"><v>3.5</v></c><c r="B2" t="inlineStr"><is><t>red</t></is></c></row>'
                 '<row r="3"><c r="A3"><v>4</v></c><c r="B3" t="inlineStr"><is><t>blue</t></is></c></row>'
                 '</sheetData></worksheet>')
        shared = ('<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">'
                  '<si><t>size</t></si><si><t>color</t></si></sst>')
        p = tmp_path / "book.xlsx"
        with zipfile.ZipFile(p, "w") as z:
            z.writestr("xl/worksheets/sheet1.xml", sheet)
            z.writestr("xl/sharedStrings.xml", shared)
        df = load(spark, str(p))
        assert df.columns == ["size", "color"]
        assert sorted((r["size"], r["color"]) for r in df.collect()) == [(3.5, "red"), (4.0, "blue")]


class TestEDA:
    def test_quality_and_sections(self, spark, regression_df):
        from tessera.operators.stats import eda_report
        rep = eda_report(regression_df)
        q = rep["quality"].first()["quality_score"]
        assert 0 <= q <= 100
        for k in ("numeric_stats", "missing", "histograms", "correlations", "quality"):
            assert k in rep
        hist = rep["histograms"].groupBy("column_name").agg(F.sum("count").alias("n")).collect()
        assert all(r["n"] == 200 for r in hist)


class TestTaskDetector:
    def _detect(self, spark, df, target):
        from tessera.operators.profile import schema_profile
        from tessera.operators.task import detect_task
        t = spark.createDataFrame([(0, target)], "dataset_id int, target_column string")
        return detect_task(schema_profile(df), t).first()

    def test_regression(self, spark, regression_df):
        assert self._detect(spark, regression_df, "target")["task_type"] == "regression"

    def test_clustering(self, spark, regression_df):
        assert self._detect(spark, regression_df, None)["task_type"] == "clustering"

    def test_second_opinion_overrides_only_when_confident(self, spark, regression_df):
        from tessera.operators.profile import schema_profile
        from tessera.operators.task import detect_task
        t = spark.createDataFrame([(0, "target")], "dataset_id int, target_column string")
        so = spark.createDataFrame([(0, "classification", 0.9, "x")], "dataset_id int, task_type string, confidence double, reasoning string")
        assert detect_task(schema_profile(regression_df), t, so).first()["task_type"] == "classification"
        so2 = spark.createDataFrame([(0, "classification", 0.6, "x")], "dataset_id int, task_type string, confidence double, reasoning string")
        assert detect_task(schema_profile(regression_df), t, so2).first()["task_type"] == "regression"


class TestWorkflow:
    def test_linear(self, spark, regression_df):
        from tessera.operators.models import fit_eval
        from tessera.operators.prep import prepare
        df = regression_df.withColumn("rid", F.monotonically_increasing_id())
        prep = prepare(df.select("rid", "feature_a", "feature_b", "target"), "target", "regression", ["rid"])
        m = {r["metric"]: r["value"] for r in fit_eval(prep, "linear_regression")["metrics"].collect()}
        assert -1 <= m["r2"] <= 1 and m["r2"] > 0.5

    def test_logistic(self, spark, classification_df):
        from tessera.operators.models import fit_eval
        from tessera.operators.prep import prepare
        prep = prepare(classification_df, "label", "classification", ["row_id"])
        m = {r["metric"]: r["value"] for r in fit_eval(prep, "logistic_regression")["metrics"].collect()}
        assert 0 <= m["accuracy"] <= 1

    def test_kmeans(self, spark, regression_df):
        from pyspark.ml.feature import VectorAssembler
        from tessera.operators.evaluate import cluster_metrics
        from tessera.operators.models import kmeans
        df = VectorAssembler(inputCols=["feature_a", "feature_b"], outputCol="v").transform(
            regression_df.withColumn("rid", F.monotonically_increasing_id()))
        labels, _ = kmeans(df, "v", "rid", k=3)
        m = cluster_metrics(labels.cache(), "_s", "rid", "cluster").first()
        assert m["n_clusters_found"] == 3


class TestDrift:
    def test_same_distribution(self, spark):
        from tessera.operators.drift import drift, drift_rollup
        a = spark.range(200).select(*[F.randn(10 + i).alias(f"f{i}") for i in (1, 2, 3)])
        b = spark.range(50).select(*[F.randn(20 + i).alias(f"f{i}") for i in (1, 2, 3)])
        rep = drift(a, b, ["f1", "f2", "f3"])
        assert rep.count() == 3
        assert drift_rollup(rep, 3).first()["drift_severity"] in ("none", "warning", "critical")

    def test_shift_detected(self, spark):
        from tessera.operators.drift import drift, drift_rollup
        a = spark.range(200).select(F.randn(1).alias("f1"), F.randn(2).alias("f2"))
        b = spark.range(50).select((F.randn(3) + 10).alias("f1"), (F.randn(4) + 10).alias("f2"))
        assert drift_rollup(drift(a, b, ["f1", "f2"]), 2).first()["overall_drift_detected"]


class TestFeatureEngineer:
    def test_suggestion_keys(self, spark, regression_df):
        from tessera.operators.features import suggest_features
        from tessera.operators.profile import schema_profile
        from tessera.operators.stats import correlations, iqr_outliers, numeric_stats
        prof = schema_profile(regression_df)
        num = ["feature_a", "target"]
        out = suggest_features(prof, numeric_stats(regression_df, num), iqr_outliers(regression_df, num),
                               correlations(regression_df, num)).collect()
        assert out and all({"feature", "transform", "reason", "priority", "impact", "code_hint"} <= set(r.asDict())
                           for r in out)


class TestRecommender:
    def test_scores(self, spark, regression_df):
        from tessera.operators.profile import schema_profile
        from tessera.operators.recommend import dataset_summary, recommend, registry
        prof = schema_profile(regression_df)
        s = dataset_summary(regression_df, prof, ["feature_a", "target"], 0, "regression")
        rows = recommend(s, registry(spark)).orderBy("rank").collect()
        assert rows and rows[0]["recommended"] and all(0 <= r["score"] <= 100 for r in rows)


def test_readers_on_awkward_files(spark, tmp_path):
    """NA tokens in number columns, nested JSON lines, two column-oriented files, null fields kept, sheet order."""
    import zipfile
    from tessera.sources.readers import load, parse_xlsx_cells, to_json_rows
    (tmp_path / "a.csv").write_text("a,b, c \n1,x,2020-01-01\nNA,,2021-05-06\n3,n/a,NaN\n")
    df = load(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"a": "int", "b": "string", "c": "timestamp"} and [r["a"] for r in df.collect()] == [1, None, 3]
    (tmp_path / "l.json").write_text('{"o": {"p": 1}, "q": null}\n{"o": {"p": 2}, "q": 5}\n')
    assert [r["o"]["p"] for r in load(spark, str(tmp_path / "l.json"), orient="lines").collect()] == [1, 2]
    folder = tmp_path / "cols.json"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.json").write_text('{"u": {"0": %d, "1": 2}, "v": {"0": "s", "1": null}}' % k)
    assert sorted(r["u"] for r in load(spark, str(folder), orient="columns").collect()) == [0.0, 1.0, 2.0, 2.0]
    assert load(spark, str(folder)).count() == 4 and load(spark, str(tmp_path / "l.json")).count() == 2
    assert to_json_rows(spark.range(1).selectExpr("id", "cast(null as int) as n")).first()["json"] == '{"id":0,"n":null}'
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(tmp_path / "w.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} {rel}><sheets><sheet name="A" r:id="r2"/><sheet name="B" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/>'
                   '<Relationship Id="r2" Target="worksheets/sheet10.xml"/></Relationships>')
        for name, v in (("sheet1", 1), ("sheet10", 10)):
            z.writestr(f"xl/worksheets/{name}.xml", f"<worksheet {ns}><sheetData><row><c><v>{v}</v></c></row></sheetData></worksheet>")
    cells = parse_xlsx_cells("w", (tmp_path / "w.xlsx").read_bytes())
    assert cells[["row", "col", "value"]].values.tolist() == [[0, 0, "10"]]


def test_class_codes_of_the_whole_target(spark):
    """A class with one row has its code wherever the row falls."""
    from tessera.operators.prep import prepare
    rows = [(i, float(i), "rare" if i == 7 else ("a" if i % 2 else "b")) for i in range(41)]
    out = prepare(spark.createDataFrame(rows, "id long, x double, y string"), "y", "classification", ["id"])
    both = out["train"].unionByName(out["test"])
    assert both.where("label is null").count() == 0 and both.select("label").distinct().count() == 3


def test_explanation_of_a_clustering(spark):
    from tessera.operators.chartdata import explain
    got = explain(spark.createDataFrame([("k", 0.61)], "model_name string, silhouette_sq double"), "clustering").first()
    assert got["performance_analysis"] == "Silhouette score = 0.61. Good cluster separation."


def test_duplicates_by_row_hash(spark):
    """Nulls in different columns differ; NaN is null; -0.0 is 0.0; repeated rows count."""
    from tessera.operators.stats import duplicate_rows
    rows = [(None, 1.0, "a"), (1.0, None, "a"), (float("nan"), 1.0, "a"), (0.0, 2.0, None), (-0.0, 2.0, None), (3.0, 3.0, "")]
    assert duplicate_rows(spark.createDataFrame(rows, "a double, b double, c string")).first()[0] == 2


def test_json_layouts_are_found(spark, tmp_path):
    """Lines, arrays, pretty-printed arrays and column-oriented files, one or several, without saying which."""
    from tessera.sources.readers import _json_orient, load
    texts = {"lines": ['{"a": 1, "o": {"x": 2}}\n\n{"a": 2}\n'], "records": ['[{"a": 1}, {"a": 2}]'], "pretty": ['[\n {\n  "a": 1\n },\n {"a": 2}\n]'],
             "columns": ['{"a": {"0": 1, "1": 2}}'], "two": ['{"a": {"0": 1}}', '{"a": {"0": 2}}']}
    for name, files in texts.items():
        folder = tmp_path / name
        folder.mkdir()
        for k, text in enumerate(files):
            (folder / f"{k}.json").write_text(text)
        assert _json_orient(spark, str(folder)) == {"pretty": "records", "two": "columns"}.get(name, name)
        assert sorted(r["a"] for r in load(spark, str(folder), fmt="json").collect()) == [1, 2]


def test_csv_types_are_ruled_out_by_the_first_rows(spark, monkeypatch):
    """types that a first row rules out are not tried over the table; a late row still decides a column's type."""
    from pyspark.sql import functions as F
    from pyspark.sql.classic.dataframe import DataFrame
    from tessera.sources import readers
    n = readers.PROBE_ROWS * 3
    df = spark.range(n).repartition(1).sortWithinPartitions("id").select(
        F.col("id").cast("string").alias("whole"), F.lit("a word").alias("word"), F.when(F.col("id") < n - 1, "7").otherwise("x").alias("late"),
        F.when(F.col("id") == n - 1, F.lit("2.5")).alias("rare"), F.lit("2024-01-02 03:04:05").alias("at"))
    asked, plain = [], DataFrame.agg
    monkeypatch.setattr(DataFrame, "agg", lambda self, *e: asked.append(len(e)) or plain(self, *e))
    got = readers._infer_types(df)
    assert dict(got.dtypes) == {"whole": "int", "word": "string", "late": "string", "rare": "double", "at": "timestamp"}
    # whole and late: int, bigint, double; rare: all five; at: timestamp; word: nothing
    assert asked == [25, 12]
