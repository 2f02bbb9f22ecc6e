import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tessera.session import get_spark
    s = get_spark("local[4]", shuffle_partitions=8)
    yield s


@pytest.fixture(scope="session")
def regression_df(spark):
    from pyspark.sql import functions as F
    a = 100 + 4900 * F.rand(1)
    b = F.floor(1 + 5 * F.rand(2)).cast("double")
    return spark.range(200).select(a.alias("feature_a"), b.alias("feature_b"), F.randn(3).alias("_e")) \
        .select("feature_a", "feature_b", (2 * F.col("feature_a") + 1000 * F.col("feature_b") + 500 * F.col("_e"))
                .alias("target")).cache()


@pytest.fixture(scope="session")
def classification_df(spark):
    from pyspark.sql import functions as F
    return spark.range(200).select((10 * F.rand(4)).alias("feature_a"), (10 * F.rand(5)).alias("feature_b")) \
        .withColumn("label", F.when(F.col("feature_a") + F.col("feature_b") > 10, "Yes").otherwise("No")) \
        .withColumn("row_id", F.monotonically_increasing_id()).cache()
