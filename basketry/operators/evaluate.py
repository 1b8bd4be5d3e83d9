"""Evaluation on the days after a cut-off: cohorts, ranking metrics, intervals and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import half_even, stamp
from basketry.operators.serve import TIERS
from basketry.operators.snapshot import history
from basketry.params import DEFAULT, Params

COHORTS = ("primary", "cold_start", "new_product")


def future_pairs(bought: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """Distinct (customer, item) pairs of the half-open window that starts at the cut-off."""
    end = stamp(cutoff) + F.expr(f"INTERVAL {p.future_days} DAYS")
    return bought.where((F.col("ts") >= stamp(cutoff)) & (F.col("ts") < end)).select("customer_id", "stock_code").distinct()


def truth(bought: DataFrame, items: DataFrame, cutoff: str, cohort: str, p: Params = DEFAULT) -> DataFrame:
    """(customer_id, stock_code) that a cohort buys next: known customers, unknown ones, or known ones' first purchases of an item."""
    past = history(bought, cutoff)
    wanted = future_pairs(bought, cutoff, p).join(items.select("stock_code"), "stock_code", "left_semi").select("customer_id", "stock_code")
    known = past.select("customer_id").distinct()
    if cohort == "cold_start":
        return wanted.join(known, "customer_id", "left_anti")
    wanted = wanted.join(known, "customer_id", "left_semi")
    if cohort == "new_product":
        wanted = wanted.join(past.select("customer_id", "stock_code").distinct(), ["customer_id", "stock_code"], "left_anti")
    return wanted


def cohort_counts(bought: DataFrame, items: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    parts = [truth(bought, items, cutoff, c, p).groupBy("customer_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_pairs")).select(F.lit(c).alias("cohort"), "n_customers", "n_pairs") for c in COHORTS]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def future_coverage(bought: DataFrame, items: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """All pairs of the window, those in the catalog and their share."""
    pairs = future_pairs(bought, cutoff, p).join(items.select("stock_code", F.lit(1).alias("inside")), "stock_code", "left")
    out = pairs.agg(F.count("*").alias("n_pairs"), F.count("inside").alias("n_in_catalog"))
    return out.select("n_pairs", "n_in_catalog", F.when(F.col("n_pairs") > 0, half_even(F.col("n_in_catalog") / F.col("n_pairs"), 4)).otherwise(0.0).alias("coverage"))


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def user_metrics(lists: DataFrame, wanted: DataFrame, k: int = DEFAULT.k) -> DataFrame:
    """Recall, precision over k (short lists lose), hit and NDCG of each customer with a truth."""
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_true").cast("int"), F.lit(k))), F.lit(0.0), lambda acc, i: acc + _gain(i))
    sizes = wanted.groupBy("customer_id").agg(F.count("*").alias("n_true"))
    hits = lists.where(F.col("rank") <= k).join(wanted, ["customer_id", "stock_code"], "left_semi").groupBy("customer_id").agg(F.count("*").alias("hits"), F.sum(_gain(F.col("rank"))).alias("dcg"))
    joined = sizes.join(hits, "customer_id", "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("dcg", F.coalesce("dcg", F.lit(0.0)))
    return joined.select(
        "customer_id", half_even(F.col("hits") / F.col("n_true"), 8).alias("recall"), half_even(F.col("hits") / k, 8).alias("precision"),
        (F.col("hits") > 0).cast("double").alias("hit"), half_even(F.col("dcg") / ideal, 8).alias("ndcg"),
    )


def summary(metrics: DataFrame, model: str) -> DataFrame:
    means = [F.coalesce(half_even(F.avg(F.col(c).cast("decimal(18,8)")).cast("double"), 6), F.lit(0.0)).alias(f"mean_{c}") for c in ("ndcg", "recall", "precision", "hit")]
    return metrics.agg(F.count("*").alias("n_users"), *means).select(F.lit(model).alias("model"), "n_users", *(f"mean_{c}" for c in ("ndcg", "recall", "precision", "hit")))


def strongest(means: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(model, mean_ndcg) of the best of the models in order; of equals the first."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("model"))
    return means.where(F.col("model").isin(*order)).select("model", "mean_ndcg").orderBy(F.desc("mean_ndcg"), place).limit(1)


def list_shares(lists: DataFrame, n_items: DataFrame) -> DataFrame:
    """Catalog coverage, share of fallback rows and share of customers with any similar item."""
    rows = lists.groupBy("customer_id").agg(F.count("*").alias("n"), F.count_if(F.col("method") != TIERS[0]).alias("fell"), F.max(F.col("method") == TIERS[0]).alias("personal"))
    users = rows.agg(F.count("*").alias("users"), F.sum("n").alias("n"), F.sum("fell").alias("fell"), F.count_if("personal").alias("personal"))
    distinct = lists.select("stock_code").distinct().agg(F.count("*").alias("shown"))
    one = users.join(distinct).join(n_items)  # three single rows
    ratio = lambda a, b: F.when(F.col(b) > 0, half_even(F.col(a) / F.col(b), 4)).otherwise(0.0)
    return one.select(ratio("shown", "n_items").alias("coverage"), ratio("fell", "n").alias("fallback_share"), ratio("personal", "users").alias("personalised_share"))


# Cumulative Poisson(1) probabilities for 0 to 7 draws.
_POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def bootstrap(metric_a: DataFrame, metric_b: DataFrame, draws: int = DEFAULT.bootstraps) -> DataFrame:
    """95 % intervals of two models' mean NDCG and of their difference on the same customers.

    Each customer enters draw b as often as a Poisson variate from a hash of (customer,
    b) says, so draws need no order of the customers and every partition adds its sums.
    """
    both = metric_a.select("customer_id", F.col("ndcg").alias("a")).join(metric_b.select("customer_id", F.col("ndcg").alias("b")), "customer_id")
    each = both.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = F.conv(F.substring(F.md5(F.concat_ws(":", "customer_id", F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / float(2**32)
    times = sum(((u >= c).cast("int") for c in _POISSON), F.lit(0))
    exact = lambda c: F.sum((F.col(c) * F.col("w")).cast("decimal(28,8)")).cast("double")
    means = each.withColumn("w", times).groupBy("draw").agg(F.sum("w").alias("n"), exact("a").alias("sa"), exact("b").alias("sb")).where("n > 0")
    means = means.select((F.col("sa") / F.col("n")).alias("a"), (F.col("sb") / F.col("n")).alias("b"))
    bounds = means.select("a", "b", (F.col("a") - F.col("b")).alias("d")).agg(*(half_even(F.percentile(c, F.lit(q)), 6).alias(f"{c}_{n}") for c in "abd" for q, n in ((0.025, "low"), (0.975, "high"))))
    return bounds


def promotion(baseline: DataFrame, candidate: DataFrame, bounds: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Whether the candidate replaces the baseline: enough gain, no less recall, difference surely positive."""
    a, b = candidate.select(F.col("mean_ndcg").alias("ndcg"), F.col("mean_recall").alias("recall")), baseline.select(F.col("mean_ndcg").alias("base_ndcg"), F.col("mean_recall").alias("base_recall"))
    one = a.join(b).join(bounds.select("d_low"))  # three single rows
    gain = F.when(F.col("base_ndcg") > 0, half_even((F.col("ndcg") - F.col("base_ndcg")) / F.col("base_ndcg"), 4)).otherwise(0.0)
    return one.select(gain.alias("relative_gain"), "ndcg", "base_ndcg", "recall", "base_recall", "d_low").withColumn(
        "qualifies", (F.col("relative_gain") >= p.least_gain) & (F.col("recall") >= F.col("base_recall")) & (F.coalesce("d_low", F.lit(0.0)) > 0)
    )
