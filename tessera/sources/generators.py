"""Demo-table generators (S-7 ... S-11) as Spark jobs (``range`` + seeded ``rand``/``randn``).

Spark's generators do not reproduce NumPy's seeded draws; the distributions and
column semantics match, not the exact values. Sizes are parameters, so the same
code writes a demo file or a billion-row benchmark table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _u(lo, hi, seed):
    return lo + (hi - lo) * F.rand(seed)


def _ri(lo, hi, seed):
    """Uniform integer in [lo, hi)."""
    return F.floor(_u(lo, hi, seed)).cast("int")


def house_prices(spark: SparkSession, n: int = 400, seed: int = 42) -> DataFrame:
    """S-7: linear price of area, rooms, age, garage, distance plus noise."""
    df = spark.range(n).select(_ri(500, 5000, seed).alias("area_sqft"), _ri(1, 6, seed + 1).alias("bedrooms"),
                               _ri(1, 4, seed + 2).alias("bathrooms"), _ri(0, 50, seed + 3).alias("age_years"),
                               _ri(0, 2, seed + 4).alias("garage"),
                               F.round(_u(1, 30, seed + 5), 2).alias("distance_to_center_km"), F.randn(seed + 6).alias("_e"))
    price = (50000 + 120 * F.col("area_sqft") + 15000 * F.col("bedrooms") + 10000 * F.col("bathrooms")
             - 1000 * F.col("age_years") + 20000 * F.col("garage") - 3000 * F.col("distance_to_center_km")
             + 25000 * F.col("_e"))
    return df.withColumn("price_usd", F.greatest(price, F.lit(20000)).cast("int")).drop("_e")


def customer_churn(spark: SparkSession, n: int = 400, seed: int = 42) -> DataFrame:
    """S-8: churn drawn from a logistic probability, labelled Yes/No."""
    df = spark.range(n).select(_ri(1, 72, seed).alias("tenure_months"), F.round(_u(20, 120, seed + 1), 2).alias("monthly_charges"),
                               _ri(1, 5, seed + 2).alias("num_products"), _ri(0, 2, seed + 3).alias("has_support_plan"),
                               _ri(0, 5, seed + 4).alias("complaints_last_year"), _ri(1, 10, seed + 5).alias("satisfaction_score"))
    z = (-0.05 * F.col("tenure_months") + 0.02 * F.col("monthly_charges") - 0.8 * F.col("has_support_plan")
         + 0.5 * F.col("complaints_last_year") - 0.3 * F.col("satisfaction_score") + 1.0)
    p = 1 / (1 + F.exp(-z))
    return df.withColumn("churn", F.when(F.rand(seed + 6) < p, "Yes").otherwise("No"))


def customer_segments(spark: SparkSession, n: int = 400, seed: int = 42) -> DataFrame:
    """S-9: five uniform features for clustering."""
    return spark.range(n).select(F.round(_u(20, 200, seed), 1).alias("annual_income_k"),
                                 _ri(1, 100, seed + 1).alias("spending_score"), _ri(18, 70, seed + 2).alias("age"),
                                 _ri(1, 52, seed + 3).alias("purchase_frequency"),
                                 F.round(_u(15, 500, seed + 4), 2).alias("avg_order_value"))


def monthly_sales(spark: SparkSession, n: int = 60, seed: int = 42) -> DataFrame:
    """S-10: month-end dates, linear trend + 12-month sine + noise, a region label."""
    i = F.col("id")
    date = F.last_day(F.add_months(F.lit("2020-01-31").cast("date"), i.cast("int")))
    sales = 1500 + 20 * i + 400 * F.sin(2 * 3.141592653589793 * i / 12) + 150 * F.randn(seed)
    regions = F.array(*[F.lit(r) for r in ("North", "South", "East", "West")])
    return spark.range(n).select(F.date_format(date, "yyyy-MM-dd").alias("date"), sales.cast("int").alias("sales"),
                                 _ri(500, 2000, seed + 1).alias("marketing_spend"),
                                 F.element_at(regions, (F.pmod(i, F.lit(4)) + 1).cast("int")).alias("region"))


def motor_sensors(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """S-11: sensor readings, remaining useful life clipped to 0..8000, three fault classes."""
    df = spark.range(n).select(
        F.concat(F.lit("MTR-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("asset_id"),
        F.round(_u(0, 50000, seed), 1).alias("operating_hours"), F.round(_u(0.5, 12, seed + 1), 3).alias("vibration_x_rms"),
        F.round(_u(0.5, 12, seed + 2), 3).alias("vibration_y_rms"), F.round(_u(40, 110, seed + 3), 1).alias("bearing_temp_c"),
        F.round(_u(50, 140, seed + 4), 1).alias("stator_temp_c"), F.round(_u(20, 60, seed + 5), 2).alias("phase_a_current_a"),
        F.round(_u(20, 60, seed + 6), 2).alias("phase_b_current_a"), F.round(_u(20, 60, seed + 7), 2).alias("phase_c_current_a"),
        F.round(_u(0, 5, seed + 8), 2).alias("voltage_imbalance_pct"), F.round(_u(1400, 1800, seed + 9), 0).alias("shaft_rpm"),
        F.round(_u(20, 80, seed + 10), 1).alias("oil_viscosity_cst"), F.round(_u(0.3, 1.0, seed + 11), 2).alias("load_factor"))
    wear = (F.col("operating_hours") / 50000 + (F.col("vibration_x_rms") + F.col("vibration_y_rms")) / 24
            + (F.col("bearing_temp_c") - 40) / 70) / 3
    rul = F.least(F.greatest(8000 * (1 - wear) + 300 * F.randn(seed + 12), F.lit(0)), F.lit(8000)).cast("int")
    risk = 1 / (1 + F.exp(-(8 * wear - 4)))
    fault = F.when(risk > 0.7, "Imminent Failure").when(risk > 0.4, "Degraded").otherwise("Healthy")
    return df.withColumn("remaining_useful_life_h", rul).withColumn("fault_status", fault)
