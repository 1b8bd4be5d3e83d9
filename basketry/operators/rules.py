"""Rule segments: quartile cut points, scores, ordered rules, profiles and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import half_even, score
from basketry.operators.quantiles import array_of, long, pick, quantiles
from basketry.operators.snapshot import ACTIVE

# Segments of the rules, in the order they are tried.
INACTIVE_SEGMENT = ("SG_INACTIVE", "Inactive (Outside 180-Day Window)")
RULE_SEGMENTS = (("SG01", "Recent Frequent High Spend"), ("SG02", "Less Recent High Spend"), ("SG03", "Recent Occasional"), ("SG04", "Other Active"))
CLUSTER_NAMES = (
    ("High-Value Frequent VIPs", "Loyalty perks, early product access, and premium bundles to maximize retention."),
    ("Lapsed High Spenders", "Re-engagement win-back campaigns with personalized high-tier product discounts."),
    ("Steady Active Buyers", "Category cross-sell recommendations and volume discounts to boost basket size."),
    ("Recent New / Occasional Buyers", "Nurture sequence and introductory category recommendations to foster repeat purchase."),
    ("Dormant / Low Engagement", "Low-cost seasonal email reminders and highlight of top global bestsellers."),
    ("Standard Active Shoppers", "Targeted segment-popular product promotions and seasonal campaigns."),
)
QUARTILES = (0.25, 0.5, 0.75)
RFM = ("recency_days", "frequency_invoices", "monetary_gbp")


def cutpoints(profiles: DataFrame) -> DataFrame:
    """One row of the three quartiles of each measure over active customers."""
    values = long(profiles.where(F.col("status") == ACTIVE), {c: F.col(c) for c in RFM})
    found = quantiles(values, array_of(*QUARTILES), ("measure",))  # nine rows
    return found.agg(*(pick(c, q).alias(f"{c[0]}_q{i}") for c in RFM for i, q in enumerate(QUARTILES, 1)))


def scores(profiles: DataFrame) -> DataFrame:
    """Active and inactive customers with scores 1 to 4; a short recency scores high."""
    cuts = F.broadcast(cutpoints(profiles))  # one row
    of = lambda c: score(F.col(c).cast("double"), [F.col(f"{c[0]}_q{i}") for i in (1, 2, 3)])
    return profiles.join(cuts).select(
        *profiles.columns, (F.lit(5) - of("recency_days")).alias("r_score"), of("frequency_invoices").alias("f_score"), of("monetary_gbp").alias("m_score")
    )


def _first_match(conditions: list[Column], pairs) -> tuple[Column, Column]:
    """The (id, text) of the first condition that holds, else the last pair."""
    out = []
    for side in (0, 1):
        case = F.lit(pairs[-1][side])
        for cond, pair in reversed(list(zip(conditions, pairs, strict=False))):
            case = F.when(cond, pair[side]).otherwise(case)
        out.append(case)
    return out[0], out[1]


def rule_segments(scored: DataFrame) -> DataFrame:
    """Adds segment_id and segment_label by the scores; inactive customers are a segment apart."""
    r, f, m = (F.col(f"{x}_score") for x in "rfm")
    conditions = [F.col("status") != ACTIVE, (r >= 3) & (f >= 3) & (m >= 3), (r <= 2) & (m >= 3), (r >= 3) & (f <= 2)]
    sid, label = _first_match(conditions, (INACTIVE_SEGMENT, *RULE_SEGMENTS))
    return scored.withColumn("segment_id", sid).withColumn("segment_label", label)


def cluster_names(profiled: DataFrame) -> DataFrame:
    """Adds label and hypothesis by the raw medians of each segment."""
    r, f, m = F.col("median_recency"), F.col("median_frequency"), F.col("median_monetary")
    conditions = [(m >= 1500) & (f >= 4) & (r <= 30), (m >= 1000) & (r > 50), (f >= 3) & (r <= 40), (r <= 30) & (f <= 2), r > 60]
    label, hypothesis = _first_match(conditions, CLUSTER_NAMES)
    return profiled.withColumn("label", label).withColumn("hypothesis", hypothesis)


def segment_profiles(assigned: DataFrame) -> DataFrame:
    """Size, share and medians of each segment of active customers."""
    active = assigned.where(F.col("status") == ACTIVE)
    sizes = active.groupBy("segment_id").agg(F.count("*").alias("n_customers"))  # a row a segment
    total = sizes.agg(F.sum("n_customers").alias("total"))
    found = quantiles(long(active, {c: F.col(c) for c in RFM}, ("segment_id",)), array_of(0.5), ("segment_id", "measure"))
    per = sizes.join(found.groupBy("segment_id").agg(*(pick(c, 0.5).alias(f"median_{c.split('_')[0]}") for c in RFM)), "segment_id")
    return per.join(F.broadcast(total)).select(
        "segment_id", "n_customers", half_even(F.col("n_customers") / F.col("total"), 4).alias("share"),
        half_even(F.col("median_recency"), 1).alias("median_recency"), half_even(F.col("median_frequency"), 1).alias("median_frequency"), half_even(F.col("median_monetary"), 2).alias("median_monetary"),
    )


def ordinals(profiled: DataFrame) -> DataFrame:
    """SG01, SG02, ... by spend, then frequency, then recency; over one row a segment."""
    order = Window.orderBy(F.desc("median_monetary"), F.desc("median_frequency"), "median_recency", "segment_id")
    return profiled.withColumn("ordinal", F.format_string("SG%02d", F.row_number().over(order)))
