"""What is known strictly before a cut-off: customer profiles, catalog, interactions, descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.functions import days_before, exact_sum, half_even, stamp
from basketry.params import DEFAULT, Params

ACTIVE, INACTIVE = "known_active", "known_inactive"


def history(bought: DataFrame, cutoff: str) -> DataFrame:
    return bought.where(F.col("ts") < stamp(cutoff))


def rfm_profiles(bought: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """Recency, distinct invoices and spend of the window for every customer seen before the cut-off.

    Invoices are summed up first, so the distinct count is a plain count of the second step.
    """
    recent = F.col("ts") >= days_before(stamp(cutoff), p.rfm_days)
    invoices = history(bought, cutoff).groupBy("customer_id", "invoice_no").agg(F.max("ts").alias("last"), F.sum(F.when(recent, F.col("value").cast("decimal(28,4)"))).alias("value"), F.max(recent).alias("recent"))
    per = invoices.groupBy("customer_id").agg(F.max("last").alias("last"), F.count_if("recent").alias("frequency_invoices"), F.coalesce(F.sum("value"), F.lit(0).cast("decimal(28,4)")).cast("double").alias("spent"), F.max("recent").alias("active"))
    seconds = F.expr(f"timestampdiff(SECOND, last, TIMESTAMP_NTZ '{cutoff}')")
    return per.select(
        "customer_id", F.floor(seconds / 86400).cast("double").alias("recency_days"), F.col("frequency_invoices").cast("bigint").alias("frequency_invoices"),
        half_even(F.col("spent"), 4).alias("monetary_gbp"), F.when(F.col("active"), ACTIVE).otherwise(INACTIVE).alias("status"),
    )


def rfm_metadata(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count("*").alias("n_known"), F.count_if(F.col("status") == ACTIVE).alias("n_active"), F.count_if(F.col("status") == INACTIVE).alias("n_inactive"), half_even(exact_sum(F.col("monetary_gbp")), 2).alias("monetary_total")
    )


def reconciliation(profiles: DataFrame, bought: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """One row: what the profiles add up to, what the window's purchases add up to, and whether they agree to the penny."""
    window = history(bought, cutoff).where(F.col("ts") >= days_before(stamp(cutoff), p.rfm_days))
    sums = profiles.agg(half_even(F.coalesce(exact_sum(F.col("monetary_gbp")), F.lit(0.0)), 2).alias("profiles_total")).join(window.agg(half_even(F.coalesce(exact_sum(F.col("value")), F.lit(0.0)), 2).alias("purchases_total")))
    return sums.withColumn("difference", half_even(F.col("profiles_total") - F.col("purchases_total"), 2)).withColumn("agrees", F.abs("difference") < 0.01)


def last_purchases(bought: DataFrame, cutoff: str) -> DataFrame:
    """(stock_code, customer_id, last): every customer's items with the latest purchase of each."""
    return history(bought, cutoff).groupBy("stock_code", "customer_id").agg(F.max("ts").alias("last"))


def catalog(bought: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """Items with enough buyers in all history and a purchase in the last days before the cut-off."""
    return catalog_of(last_purchases(bought, cutoff), cutoff, p)


def catalog_of(lasts: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """The same from what `last_purchases` gives."""
    items = lasts.groupBy("stock_code").agg(F.count("*").alias("n_buyers"), F.max("last").alias("last"))
    return items.where((F.col("n_buyers") >= p.least_buyers) & (F.col("last") >= days_before(stamp(cutoff), p.popular_days))).select("stock_code", "n_buyers")


def descriptions(bought: DataFrame, cutoff: str) -> DataFrame:
    """The latest description of each item of the history; its code where it has none."""
    latest = history(bought, cutoff).groupBy("stock_code").agg(F.max(F.when(F.col("description").isNotNull(), F.struct("ts", "invoice_no", "description"))).alias("m"))
    return latest.select("stock_code", F.coalesce("m.description", "stock_code").alias("description"))


def interactions(bought: DataFrame, items: DataFrame, cutoff: str) -> DataFrame:
    """Distinct (customer, item) pairs over the catalog."""
    return history(bought, cutoff).select("customer_id", "stock_code").distinct().join(items.select("stock_code"), "stock_code", "left_semi").select("customer_id", "stock_code")
