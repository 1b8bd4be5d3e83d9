"""Popularity over the catalog: distinct buyers in the last days before a cut-off."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import days_before, stamp
from basketry.params import DEFAULT, Params
from basketry.sources import small


def recent_pairs(lasts: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """Distinct (customer, item) pairs of the last days, from what `last_purchases` gives: a purchase there is the last one or has a later one there."""
    return lasts.where(F.col("last") >= days_before(stamp(cutoff), p.popular_days)).select("customer_id", "stock_code")


def global_scores(lasts: DataFrame, items: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """(stock_code, score) for every catalog item; items without recent buyers score 0."""
    recent = recent_pairs(lasts, cutoff, p).groupBy("stock_code").agg(F.count("*").alias("score"))
    return items.select("stock_code").join(recent, "stock_code", "left").select("stock_code", F.coalesce("score", F.lit(0)).cast("bigint").alias("score"))


def segment_scores(lasts: DataFrame, items: DataFrame, segments: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """(segment_id, stock_code, score) with positive scores only."""
    pairs = recent_pairs(lasts, cutoff, p).join(small(items.select("stock_code")), "stock_code", "left_semi")
    return pairs.join(segments.select("customer_id", "segment_id"), "customer_id").groupBy("segment_id", "stock_code").agg(F.count("*").alias("score"))


def top_ranked(scores: DataFrame, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The n best by score, then code, with their rank; per group where `by` names one.

    Without groups the limit comes first, so only n rows meet in one place.
    """
    order = [F.desc("score"), F.col("stock_code")]
    best = scores if by else scores.orderBy(*order).limit(n)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("bigint"))
