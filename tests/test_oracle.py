"""Catalogue queries against their DuckDB oracle at sf0.01 (set TESSERA_FULL_ORACLE=1 for all)."""

import os

import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry  # noqa: E402
from oracle_compare import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.01"
FAST = ["schema_profile", "numeric_stats", "categorical_top10", "duplicate_rows", "missing_table", "histogram20",
        "normality_k2", "pearson_matrix", "iqr_outliers", "drift_report", "stratified_split", "task_detect",
        "feature_apply", "linreg_simple", "class_metrics", "cluster_metrics", "lag_matrix", "leaderboard", "normality", "density_clusters", "drift_stream", "csv_missing_roundtrip",
        "json_missing_roundtrip", "quality_score", "forecast_hw", "forecast_arima", "forecast_status", "dbscan_clusters", "silhouette",
        "impute_medians", "null_targets", "ridge_supplier", "newton_boosting", "recommend_detail", "pca_2d_customer", "prep_matrix"]
NAMES = sorted(entry.oracle_sql()) if os.environ.get("TESSERA_FULL_ORACLE") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    pdf = entry.queries()[name](spark, SF).toPandas()
    ok, msg = compare(pdf, con.execute(entry.oracle_sql()[name]).df())
    assert ok, msg


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "role" in df.columns
