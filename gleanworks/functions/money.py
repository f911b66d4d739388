"""Prices of model calls and the table of cost figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dollars for a million tokens in and out, and for a unit.
PRICES = (
    ("chat-large", 5.50, 27.50, None),
    ("chat-small", 2.20, 11.00, None),
    ("embed-text", 0.02, None, None),
    ("rerank", None, None, 0.002),
)
#: Passages that one billed re-ranking unit holds.
UNIT_PASSAGES = 100

#: Key, amount as written, unit, page.
COST_FIGURES = (
    ("part_b_standard_premium", "202.90", "per month", 23),
    ("part_b_deductible", "283", "per year", 30),
    ("part_a_deductible", "1736", "per benefit period", 27),
    ("part_a_coinsurance_days_61_90", "434", "per day", 27),
    ("part_a_coinsurance_lifetime_reserve_days", "868", "per day", 27),
    ("snf_coinsurance_days_21_100", "217", "per day", 29),
    ("part_d_out_of_pocket_cap", "2100", "per year", 83),
    ("insulin_monthly_cap", "35", "per one-month supply", 88),
    ("part_d_national_base_beneficiary_premium", "38.99", "in 2026", 84),
    ("medigap_high_deductible_plan_deductible", "2950", "in 2026", 76),
    ("part_b_immunosuppressive_drug_premium", "121.60", "per month", 53),
)


def price_table(spark: SparkSession, prices=PRICES) -> DataFrame:
    """model, input_per_million, output_per_million, per_unit."""
    return spark.createDataFrame(prices, "model string, input_per_million double, output_per_million double, per_unit double")


def cost_table(spark: SparkSession, figures=COST_FIGURES) -> DataFrame:
    """key, amount_text (the scale as printed), amount, unit, page."""
    frame = spark.createDataFrame(figures, "key string, amount_text string, unit string, page int")
    return frame.withColumn("amount", F.col("amount_text").cast("decimal(10,2)"))


def rerank_units(passages: Column) -> Column:
    """Billed units of a re-ranking call: one for every 100 passages begun, none for none."""
    return F.when(passages > 0, F.ceil(passages / UNIT_PASSAGES)).otherwise(0).cast("long")


def call_cost(tokens_in: Column, tokens_out: Column, units: Column) -> Column:
    """Dollars of a call beside its price columns; null where the price is of another kind."""
    million = 1_000_000
    tokens = tokens_in * F.col("input_per_million") / million + F.coalesce(tokens_out * F.col("output_per_million") / million, F.lit(0.0))
    return F.coalesce(F.when(F.col("per_unit").isNotNull(), units * F.col("per_unit")), tokens)
