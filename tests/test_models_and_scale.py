"""Exact quantiles, heavy baskets, several neighbour counts, model tables and stored snapshots."""

from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import cluster, evaluate, fits, itemcf, models, monitor, quantiles, rules
from basketry.params import DEFAULT

PROFILES = "customer_id string, recency_days double, frequency_invoices bigint, monetary_gbp double, status string"


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_quantiles_equal_percentile(spark):
    levels, rng = [0.0, 0.025, 0.25, 0.5, 0.75, 1.0], np.random.default_rng(6)
    of = {"one": [3.0], "two": [1.0, 2.0], "ties": [2.0] * 9 + [5.0], "nulls": [None, None], "mixed": [None, -1.5, 0.0, -0.0, 1e300], "many": rng.normal(0, 1e6, 501).tolist(), "whole": rng.integers(-3, 4, 200).astype(float).tolist()}
    df = spark.createDataFrame([(g, x) for g, xs in of.items() for x in xs], "g string, x double").repartition(3)
    got = {(r.g, r.level): r.value for r in quantiles.quantiles(df, quantiles.array_of(*levels), ("g",)).collect()}
    want = {(r.g, q): v for r in df.groupBy("g").agg(F.percentile("x", quantiles.array_of(*levels)).alias("v")).collect() if r.v for q, v in zip(levels, r.v, strict=True)}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v) for k, v in want.items())


def test_quantiles_without_groups_and_in_many_ranges(spark):
    df = spark.range(0, 5000).select(((F.col("id") * 7919) % 5000).cast("double").alias("x")).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = quantiles.quantiles(df, quantiles.array_of(0.1, 0.333, 0.5))
    assert [round(v, 6) for _, v in rows(found)] == [499.9, round(0.333 * 4999, 6), 2499.5]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan
    assert quantiles.quantiles(df.limit(0), quantiles.array_of(0.5)).count() == 0


def test_normal_quantiles(spark):
    u = np.concatenate((np.linspace(1e-7, 1 - 1e-7, 999), [1e-15, 0.0750001, 0.9249999]))
    assert np.allclose(cluster.normal_quantile(u), [NormalDist().inv_cdf(float(v)) for v in u], rtol=0, atol=1e-14)
    few = spark.createDataFrame([(str(i), float(i), float(i % 2), 1.0) for i in range(5)], "customer_id string, r double, f double, m double")
    got = {r.customer_id: r for r in cluster.quantile_normal(few).collect()}
    assert [round(got[str(i)].r, 6) for i in range(5)] == [round(NormalDist().inv_cdf(v), 6) for v in (1e-7, 0.25, 0.5, 0.75, 1 - 1e-7)]
    assert rows(cluster.quantile_normal(few.limit(1)), "m") == [(0.0,)]


def test_heavy_baskets_are_shared(spark):
    heavy = [("H", f"{i:05d}") for i in range(2000)]
    light = [(f"C{c}", f"{(7 * c + i) % 300:05d}") for c in range(40) for i in range(c % 9)]
    few = spark.createDataFrame([*heavy[:300], *light], "customer_id string, stock_code string").distinct()
    plain = rows(few.alias("a").join(few.alias("b"), "customer_id").where("a.stock_code < b.stock_code").groupBy("a.stock_code", "b.stock_code").count())
    for block in (7, 64, 2000):
        assert rows(itemcf.co_buyers(few, block), "item_a", "item_b", "n_both") == plain
    whole = itemcf.co_buyers(spark.createDataFrame([*heavy, *light], "customer_id string, stock_code string").distinct(), 400)
    assert whole.agg(F.sum("n_both")).first()[0] == 2000 * 1999 // 2 + sum(len(s) * (len(s) - 1) // 2 for c in range(40) for s in [{(7 * c + i) % 300 for i in range(c % 9)}])
    assert itemcf.co_buyers(few.limit(0)).count() == 0


def test_all_neighbour_counts_from_one_join(spark):
    rng = np.random.default_rng(3)
    pairs = spark.createDataFrame([(f"C{c}", f"{i:05d}") for c in range(60) for i in set(rng.integers(0, 30, 8).tolist())], "customer_id string, stock_code string")
    most = itemcf.neighbours(itemcf.co_buyers(pairs), itemcf.item_counts(pairs), most=12)
    together = itemcf.scores_by_bound(pairs, most, (3, 12))
    for n in (3, 12):
        alone = itemcf.candidate_scores(pairs, itemcf.neighbours(itemcf.co_buyers(pairs), itemcf.item_counts(pairs), replace(DEFAULT, neighbours=n)), n)
        assert rows(itemcf.scores_of(together, n)) == rows(alone)


def test_the_best_of_equals_is_the_first_and_others_dont_count(spark):
    means = spark.createDataFrame([("x", 0.9), ("b", 0.2), ("a", 0.2)], "model string, mean_ndcg double")
    assert evaluate.strongest(means, ("b", "a")).first().model == "b"


def plain_silhouette(x, own, who):
    out = []
    for i in who:
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        same = own == own[i]
        if same.sum() < 2:
            out.append(0.0)
            continue
        a, b = d[same].sum() / (same.sum() - 1), min(d[own == k].mean() for k in set(own.tolist()) - {own[i]})
        out.append((b - a) / max(a, b))
    return float(np.mean(out))


def test_silhouette_where_the_sample_misses_a_cluster(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(6, 1, (150, 3)), rng.normal(-9, 0.1, (3, 3))])
    own = np.repeat([0, 1, 2], [150, 150, 3])
    ids = [f"c{i}" for i in range(len(x))]
    labels = spark.createDataFrame([(c, *map(float, v), [int(k), int(k > 0)]) for c, v, k in zip(ids, x, own, strict=True)], "customer_id string, r double, f double, m double, labels array<int>").repartition(4)
    import hashlib

    order = sorted(range(len(x)), key=lambda i: (hashlib.md5(ids[i].encode()).hexdigest(), ids[i]))
    size = next(n for n in range(40, 4, -1) if 2 not in own[order[:n]])
    got = dict(rows(fits.silhouettes(labels, [3, 2], size)))
    assert got[0] == pytest.approx(plain_silhouette(x, own, order[:size]))
    s = order[:size]
    assert got[1] == pytest.approx(plain_silhouette(x[s], (own > 0)[s].astype(int), range(size)))
    whole = dict(rows(fits.silhouettes(labels, [3, 2], 1000)))
    assert whole[0] == pytest.approx(plain_silhouette(x, own, range(len(x))))
    index = dict(rows(fits.davies_bouldins(labels, [3, 2])))
    for fit, marks in ((0, own), (1, (own > 0).astype(int))):
        table = spark.createDataFrame([(c, int(k), *map(float, v)) for c, v, k in zip(ids, x, marks, strict=True)], "customer_id string, cluster int, r double, f double, m double")
        assert round(index[fit], 4) == cluster.davies_bouldin(table).first().davies_bouldin


@pytest.fixture(scope="module")
def profiles(spark):
    rng = np.random.default_rng(4)
    kinds = [(5, 12, 2500.0), (70, 2, 1200.0), (20, 1, 90.0)]
    data = [(f"C{i}", float(max(0, round(kinds[i % 3][0] + rng.normal(0, 3)))), int(max(1, kinds[i % 3][1] + rng.integers(-1, 2))), float(kinds[i % 3][2] * (1 + rng.normal(0, 0.05))), "known_active") for i in range(150)]
    return spark.createDataFrame([*data, ("Z", 300.0, 0, 0.0, "known_inactive")], PROFILES)


@pytest.mark.parametrize("family,covariance", [("KMeans", "none"), ("GMM", "full"), ("GMM", "diag"), ("RFMRules", "none")])
def test_models_label_from_their_table_alone(spark, profiles, tmp_path, family, covariance):
    p = replace(DEFAULT, kmeans_restarts=3, mixture_restarts=2)
    k = 4 if family == "RFMRules" else 3
    models.fit(profiles, family, covariance, k, p).write.parquet(str(tmp_path / "model"))
    model = models.read(spark.read.parquet(str(tmp_path / "model")))
    got = {r.customer_id: r for r in models.assign(profiles, model).collect()}
    assert len(got) == 151 and got["Z"].segment_id == "SG_INACTIVE"
    if family == "RFMRules":
        want = {r.customer_id: (r.segment_id, r.segment_label) for r in rules.rule_segments(rules.scores(profiles)).collect()}
        assert {c: (r.segment_id, r.segment_label) for c, r in got.items()} == want
    else:
        by_kind = [{got[f"C{i}"].segment_id for i in range(kind, 150, 3)} for kind in range(3)]
        assert by_kind == [{"SG01"}, {"SG02"}, {"SG03"}]  # by spend
        assert got["C0"].segment_label == "High-Value Frequent VIPs" and got["C1"].segment_label == "Lapsed High Spenders"
        one = profiles.where("customer_id = 'C7'")  # a later snapshot of a single customer
        assert models.assign(one, model).first().segment_id == "SG02"
        table = models.summary(models.assign(profiles, model), "2001-01-01", "v1")
        assert {r.segment_id: r.customer_count for r in table.collect()} == {"SG01": 50, "SG02": 50, "SG03": 50}
    with pytest.raises(ValueError, match="0 models"):
        models.read(spark.createDataFrame([], models.SCHEMA))


def test_models_need_customers(spark, profiles):
    with pytest.raises(ValueError, match="no active"):
        models.fit(profiles.where("status = 'known_inactive'"), "KMeans", "none", 3)


def snapshot(spark, name, spend, items, fallback):
    data = [(f"C{i}", 10.0, 2, spend * (1 + i), "known_active") for i in range(8)]
    profiles = spark.createDataFrame(data, PROFILES)
    catalog = spark.createDataFrame([(x, 5) for x in items], "stock_code string, n_buyers bigint")
    return monitor.snapshot_rows(name, profiles, rules.rule_segments(rules.scores(profiles)), catalog, spark.createDataFrame([(fallback,)], "share double"))


def test_stored_snapshots_are_compared_in_order_of_time(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    assert monitor.snapshot_names(spark, path) == []
    monitor.append_snapshot(snapshot(spark, "2001-01-01", 100.0, "abcd", 0.10), path)
    monitor.append_snapshot(snapshot(spark, "2001-02-01", 160.0, "abxy", 0.25), path)
    monitor.append_snapshot(snapshot(spark, "2001-03-01", 160.0, "abxy", 0.05), path)
    with pytest.raises(ValueError, match="already"):
        monitor.append_snapshot(snapshot(spark, "2001-02-01", 1.0, "a", 0.0), path)
    assert monitor.snapshot_names(spark, path) == ["2001-01-01", "2001-02-01", "2001-03-01"]
    table = monitor.read_snapshots(spark, path)
    found = rows(monitor.compared(table, "2001-01-01", "2001-02-01"))
    assert found == [("catalog", "jaccard", "similarity 0.3333"), ("fallback", "share", "share increased by +15.00%"), ("median", "monetary_gbp", "median changed by +60.00%")]
    assert monitor.compared(table, "2001-02-01", "2001-03-01").count() == 0  # a falling share asks for nothing
    told = monitor.report(monitor.compared(table, "2001-01-01", "2001-02-01")).first()
    assert told.n_alerts == 3 and told.requires_review and "fallback: share" in told.alerts
    with pytest.raises(ValueError, match="isn't before"):
        monitor.compared(table, "2001-02-01", "2001-01-01")
    with pytest.raises(ValueError, match="isn't before"):
        monitor.compared(table, "2001-02-01", "2001-02-01")
