"""Transforms of customer measures, clustering and its diagnostics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.functions import half_even
from basketry.operators import fits
from basketry.operators.quantiles import long
from basketry.operators.quantiles import quantiles as exact_quantiles
from basketry.operators.rules import RFM
from basketry.operators.snapshot import ACTIVE
from basketry.params import DEFAULT, Params
from basketry.sources import stored

METHODS = ("yeo_johnson", "quantile", "log1p")


def measures(profiles: DataFrame) -> DataFrame:
    """(customer_id, r, f, m) of active customers, not below 0."""
    return profiles.where(F.col("status") == ACTIVE).select("customer_id", *(F.greatest(F.lit(0.0), F.col(c).cast("double")).alias(c[0]) for c in RFM))


def standardized(points: DataFrame) -> DataFrame:
    """Each measure minus its mean over its population deviation; constants become 0."""
    stats = F.broadcast(points.agg(*(x for c in "rfm" for x in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}")))))  # one row
    z = lambda c: F.when(F.col(f"sd_{c}") > 0, (F.col(c) - F.col(f"mu_{c}")) / F.col(f"sd_{c}")).otherwise(0.0)
    return points.join(stats).select("customer_id", *(z(c).alias(c) for c in "rfm"))


def log1p(points: DataFrame) -> DataFrame:
    return points.select("customer_id", *(F.log1p(c).alias(c) for c in "rfm"))


def power(x: Column, lam: Column) -> Column:
    """Yeo-Johnson for x >= 0."""
    return F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)


def power_likelihood(points: DataFrame, lambdas: DataFrame) -> DataFrame:
    """(measure, lambda, loglik) for every candidate lambda: one aggregation, each row expanded by the short list of lambdas.

    lambdas: (measure, lambda).
    """
    long = points.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in "rfm"))).alias("p")).select("p.measure", "p.x")
    each = long.join(F.broadcast(lambdas), "measure").withColumn("y", power(F.col("x"), F.col("lambda")))
    sums = each.groupBy("measure", "lambda").agg(F.count("*").alias("n"), F.var_pop("y").alias("v"), F.sum(F.log1p("x")).alias("jac"))
    return sums.where("v > 0").select("measure", "lambda", (-F.col("n") / 2 * F.log("v") + (F.col("lambda") - 1) * F.col("jac")).alias("loglik"))


def fit_power(points: DataFrame, levels: int = 5, low: float = -2.0, high: float = 2.0, steps: int = 20) -> dict[str, float]:
    """The likeliest lambda of each measure by a grid that narrows around the best value; one job a level."""
    spark, centre, width = points.sparkSession, dict.fromkeys("rfm", (low + high) / 2), (high - low) / 2
    points = points.persist()
    for _ in range(levels):
        grid = [(c, centre[c] + width * (2 * i / steps - 1)) for c in "rfm" for i in range(steps + 1)]
        found = power_likelihood(points, spark.createDataFrame(grid, "measure string, lambda double"))
        for r in found.groupBy("measure").agg(F.max_by("lambda", "loglik").alias("best")).collect():  # three rows
            centre[r.measure] = r.best
        width *= 2 / steps
    points.unpersist()
    return centre


def powered(points: DataFrame, lambdas: dict[str, float]) -> DataFrame:
    return points.select("customer_id", *(power(F.col(c), F.lit(float(lambdas[c]))).alias(c) for c in "rfm"))


# Coefficients of the rational approximations of the normal quantile (algorithm AS 241, 16 digits), by part: numerator, denominator.
AS241 = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)),
)


def normal_quantile(u: np.ndarray) -> np.ndarray:
    """The standard normal value below which a share u (0 < u < 1) lies."""
    q = u - 0.5
    tail = np.sqrt(-np.log(np.minimum(u, 1 - u)))
    near, far = np.abs(q) <= 0.425, tail > 5
    x = np.where(near, 0.180625 - q * q, tail - np.where(far, 5.0, 1.6))
    parts = [np.polynomial.polynomial.polyval(x, top) / np.polynomial.polynomial.polyval(x, bottom) for top, bottom in AS241]
    return np.where(near, q * parts[0], np.sign(q) * np.where(far, parts[2], parts[1]))


def quantile_normal(points: DataFrame, quantiles: int = 1000) -> DataFrame:
    """Each measure's rank among its quantiles as a standard normal value (clipped): interpolation in Arrow batches.

    There are as many quantiles as customers at most; one customer is in the middle.
    """
    quantiles = min(quantiles, points.count())
    levels = np.linspace(0, 1, quantiles) if quantiles > 1 else np.array([0.5])
    values = long(points, {c: F.col(c) for c in "rfm"})
    found = exact_quantiles(values, F.lit(levels.tolist()), ("measure",)).collect()  # 3 * quantiles numbers
    cuts = {c: np.array([r.value for r in sorted(found, key=lambda r: r.level) if r.measure == c]) for c in "rfm"}

    def of(c: str):
        def normal(x: pd.Series) -> pd.Series:
            q = cuts[c]
            u = 0.5 * (np.interp(x, q, levels) - np.interp(-x, -q[::-1], -levels[::-1]))
            return pd.Series(normal_quantile(np.clip(u, 1e-7, 1 - 1e-7)))

        normal.__annotations__ = {"x": pd.Series, "return": pd.Series}
        return F.pandas_udf(normal, "double")

    return points.select("customer_id", *(of(c)(c).alias(c) for c in "rfm"))


def transformed(points: DataFrame, method: str = "yeo_johnson") -> DataFrame:
    if method == "yeo_johnson":
        return standardized(powered(points, fit_power(points)))
    if method == "quantile":
        return quantile_normal(points)
    if method == "log1p":
        return standardized(log1p(points))
    raise ValueError(f"unknown transform {method!r}; known: {', '.join(METHODS)}")


def kmeans(points: DataFrame, k: int, seed: int = DEFAULT.seeds[0], p: Params = DEFAULT) -> DataFrame:
    """(customer_id, cluster) of the cheapest of several fits."""
    return fits.one_fit(points, "KMeans", k, seed=seed, p=p).select("customer_id", "cluster")


def gaussian_mixture(points: DataFrame, k: int, covariance: str = "full", seed: int = DEFAULT.seeds[0], p: Params = DEFAULT) -> DataFrame:
    """(customer_id, cluster, certainty) of the likeliest of several fits; covariance is full or diag."""
    return fits.one_fit(points, "GMM", k, covariance, seed, p)


def _distance2(a: str, b: str) -> Column:
    return sum((F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), 2.0) for c in "rfm"), F.lit(0.0))


def lloyd_step(points: DataFrame, centres: DataFrame) -> DataFrame:
    """(cluster, n, r, f, m): the means of the points nearest to each of a few centres (cluster, r, f, m)."""
    pairs = points.alias("p").join(F.broadcast(centres).alias("c"))  # as many centres as clusters
    nearest = pairs.withColumn("d", _distance2("p", "c")).groupBy("p.customer_id").agg(F.min(F.struct("d", F.col("c.cluster").alias("cluster"))).alias("best"))
    return nearest.select("customer_id", "best.cluster").join(points, "customer_id").groupBy("cluster").agg(F.count("*").alias("n"), *(half_even(F.avg(c), 6).alias(c) for c in "rfm"))


def sampled(points: DataFrame, size: int = DEFAULT.sample) -> DataFrame:
    """The silhouette's fixed sample: `size` customers by a hash of their id."""
    return points.orderBy(F.md5("customer_id"), "customer_id").limit(size)


def silhouette(labelled: DataFrame, size: int = DEFAULT.sample) -> DataFrame:
    """Mean Euclidean silhouette of a sample of (customer_id, cluster, r, f, m): at most size * size distances."""
    s = sampled(labelled, size)
    near = s.alias("p").join(F.broadcast(s).alias("q"), F.col("p.customer_id") != F.col("q.customer_id")).select(F.col("p.customer_id").alias("id"), F.col("p.cluster").alias("own"), F.col("q.cluster").alias("other"), F.sqrt(_distance2("p", "q")).alias("d"))
    means = near.groupBy("id", "own", "other").agg(F.avg("d").alias("d"))
    ab = means.groupBy("id").agg(F.min(F.when(F.col("own") == F.col("other"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("d"))).alias("b"))
    value = F.when(F.col("a").isNull() | F.col("b").isNull() | (F.greatest("a", "b") == 0), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return ab.agg(F.count("*").alias("n_sampled"), half_even(F.avg(value), 4).alias("silhouette"))


def davies_bouldin(labelled: DataFrame) -> DataFrame:
    centres = labelled.groupBy("cluster").agg(*(F.avg(c).alias(c) for c in "rfm"))
    spread = labelled.alias("p").join(F.broadcast(centres).alias("c"), F.col("p.cluster") == F.col("c.cluster")).groupBy("c.cluster").agg(F.avg(F.sqrt(_distance2("p", "c"))).alias("s"))
    wide = centres.join(spread, "cluster")
    pairs = wide.alias("x").join(wide.alias("y"), F.col("x.cluster") != F.col("y.cluster"))  # pairs of clusters
    worst = pairs.groupBy("x.cluster").agg(F.max((F.col("x.s") + F.col("y.s")) / F.sqrt(_distance2("x", "y"))).alias("w"))
    return worst.agg(F.count("*").alias("n_clusters"), half_even(F.avg("w"), 4).alias("davies_bouldin"))


def rule_labelled(assigned: DataFrame) -> DataFrame:
    """(customer_id, cluster, r, f, m) of active customers by their rule segment, on standardised logs rounded to six places."""
    z = standardized(log1p(measures(assigned)))
    return z.join(assigned.select("customer_id", F.col("segment_id").alias("cluster")), "customer_id").select("customer_id", "cluster", *(half_even(F.col(c), 6).alias(c) for c in "rfm"))


def rule_baseline(assigned: DataFrame) -> DataFrame:
    """One row like those of `fits.candidates`: the rule segments, which no seed changes."""
    labelled = stored(rule_labelled(assigned), "labelled")
    sizes = labelled.groupBy("cluster").agg(F.count("*").alias("n")).agg((F.min("n") / F.sum("n")).alias("min_share"), F.count("*").cast("int").alias("k"))
    one = sizes.join(silhouette(labelled).select("silhouette")).join(davies_bouldin(labelled).select("davies_bouldin"))  # single rows
    return one.select(F.lit("RFMRules").alias("family"), F.lit("none").alias("covariance"), "k", "min_share", F.lit(1.0).alias("ari"), "silhouette", "davies_bouldin", F.lit(None).cast("double").alias("bic"))


def adjusted_rand(a: DataFrame, b: DataFrame) -> DataFrame:
    """Agreement of two labellings (customer_id, cluster) beyond chance; 1 where either is trivial."""
    both = a.select("customer_id", F.col("cluster").alias("x")).join(b.select("customer_id", F.col("cluster").alias("y")), "customer_id").groupBy("x", "y").agg(F.count("*").alias("n"))
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cells = both.agg(F.sum(two("n")).alias("s"), F.sum("n").alias("total"))
    rows = both.groupBy("x").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sx"))
    cols = both.groupBy("y").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sy"))
    one = cells.join(rows).join(cols)  # single rows
    chance = F.col("sx") * F.col("sy") / two("total")
    top = (F.col("sx") + F.col("sy")) / 2 - chance
    return one.select(F.when(F.abs(top) < 1e-12, 1.0).otherwise(half_even((F.col("s") - chance) / top, 6)).alias("ari"))


def selection(candidates: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The chosen candidate (family, covariance, k): eligible ones within 0.01 of the best silhouette, most stable first; the rules otherwise.

    The gates see the values as they are, the choice sees them rounded to four places.
    """
    ok = candidates.where((F.col("min_share") >= p.least_share) & (F.col("ari") >= p.least_ari) & (F.col("silhouette") >= p.least_silhouette))
    ok = ok.select("family", "covariance", "k", half_even(F.col("ari"), 4).alias("ari"), half_even(F.col("silhouette"), 4).alias("silhouette"))
    best = ok.agg(F.max("silhouette").alias("best"))
    near = ok.join(best).where(F.col("silhouette") >= F.col("best") - 0.01 - 1e-6)
    pick = near.orderBy(F.desc("ari"), "k", F.when(F.col("family") == "KMeans", 0).otherwise(1), F.desc("silhouette"), F.desc("covariance")).limit(1).select("family", "covariance", "k")
    rules = candidates.sparkSession.createDataFrame([("RFMRules", "none", 4)], "family string, covariance string, k int")
    return pick.unionAll(rules.join(pick, F.lit(True), "left_anti"))
