"""Hand-calculated cases of the retail operators."""

from dataclasses import replace
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.functions import canonical_customer, formula_safe, half_even, json_codes
from basketry.operators import clean, cluster, evaluate, fits, itemcf, monitor, popularity, rules, serve, snapshot
from basketry.params import DEFAULT, Params
from basketry.sources import RAW_COLUMNS, require_columns

RAW = "InvoiceNo string, StockCode string, Description string, Quantity string, InvoiceDate string, UnitPrice string, CustomerID string, Country string"
BOUGHT = "invoice_no string, stock_code string, description string, quantity bigint, ts timestamp_ntz, unit_price double, customer_id string, country string, value double"


def line(inv="1", code="10001", q="2", at="2011-01-01 10:00:00", price="1.5", cust="17850.0", desc="cup", land="UK"):
    return (inv, code, desc, q, at, price, cust, land)


def buy(cust, code, at, inv="i", value=10.0, desc="x"):
    return (inv, code, desc, 1, datetime.fromisoformat(at), value, cust, "UK", value)


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_each_rule_removes_its_line(spark):
    raw = [
        line(), line(), line(q="many"), line(at="never"), line(price="free"), line(cust="ABC-1"), line(cust=None, inv="2"), line(inv="C3"), line(inv="4", q="-1"),
        line(inv="5", price="0"), line(inv="6", code="POST"), line(inv="7", code=None), line(inv="8", q="0.5"), line(inv=None, cust="9"), line(q="inf"),
    ]
    got = dict(rows(clean.audit(clean.classified(spark.createDataFrame(raw, RAW)))))
    assert got == {"raw": 15, "2_invalid_core": 5, "3_duplicate": 1, "4_no_customer": 1, "5_cancelled": 2, "6_price": 1, "7_merchandise": 2, "8_value": 1, "kept": 2}
    strict = dict(rows(clean.audit(clean.classified(spark.createDataFrame(raw, RAW), strict_nulls=True))))
    assert strict["2_invalid_core"] == 7 and strict["kept"] == 1


def test_empty_lines_and_missing_columns(spark):
    empty = clean.classified(spark.createDataFrame([], RAW))
    assert clean.audit(empty).count() == 0
    assert rows(clean.anonymous_value(empty)) == [(0, 0.0)]
    with pytest.raises(ValueError, match="Country"):
        require_columns(spark.createDataFrame([], RAW).drop("Country"))
    assert len(RAW_COLUMNS) == 8


@pytest.mark.parametrize("raw,want", [(" 123.0 ", "123"), ("123.0.0", "123.0"), ("", None), ("NaN", None), ("none", None), (None, None), ("\t77\n", "77")])
def test_canonical_customer(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "c string").select(canonical_customer(F.col("c"))).first()[0] == want


def test_text_helpers(spark):
    df = spark.createDataFrame([("=SUM(A1)", ["a", "b"]), ("Regular", [])], "t string, a array<string>")
    assert rows(df, formula_safe(F.col("t")).alias("t"), json_codes(F.col("a")).alias("j")) == [("'=SUM(A1)", '["a", "b"]'), ("Regular", "[]")]
    assert spark.range(1).select(half_even(F.lit(0.125), 2)).first()[0] == 0.12


def test_snapshot_sees_only_the_past(spark):
    past = [buy("A", "10001", "2011-10-01 10:00:00", "i1", 20.0), buy("A", "10002", "2011-10-01 10:00:00", "i1", 10.0), buy("A", "10001", "2011-09-01 10:00:00", "i2", 15.0), buy("B", "10001", "2011-01-01 10:00:00", "i3")]
    future = [buy("A", "10001", "2011-10-15 00:00:00", "i9", 99.0)]
    want = [("A", 13.0, 2, 45.0, "known_active"), ("B", 286.0, 0, 0.0, "known_inactive")]
    for data in (past, past + future):
        assert rows(snapshot.rfm_profiles(spark.createDataFrame(data, BOUGHT), "2011-10-15")) == want


def test_catalog_needs_buyers_and_a_recent_sale(spark):
    data = [buy(f"C{i}", "10001", "2011-10-01 00:00:00") for i in range(5)] + [buy(f"C{i}", "10002", "2011-10-01 00:00:00") for i in range(4)] + [buy(f"C{i}", "10003", "2011-01-01 00:00:00") for i in range(6)]
    df = spark.createDataFrame(data, BOUGHT)
    items = snapshot.catalog(df, "2011-10-15")
    assert rows(items) == [("10001", 5)]
    assert snapshot.interactions(df, items, "2011-10-15").count() == 5


PAIRS = [("C1", "10001"), ("C1", "10002"), ("C2", "10001"), ("C2", "10002"), ("C3", "10002"), ("C3", "10003"), ("C4", "10001")]


def cf(spark, p=Params()):
    pairs = spark.createDataFrame(PAIRS, "customer_id string, stock_code string")
    return pairs, itemcf.neighbours(itemcf.co_buyers(pairs), itemcf.item_counts(pairs), p)


def test_cosine_and_gate(spark):
    _, near = cf(spark)
    assert [(a, b, round(s, 6)) for a, b, s in rows(near, "seed", "neighbour", "sim")] == [("10001", "10002", 0.666667), ("10002", "10001", 0.666667)]


def test_fallback_chain_equals_the_step_by_step_one(spark):
    pairs, near = cf(spark)
    customers = spark.createDataFrame([("C4", "SG01")], "customer_id string, segment_id string")
    seg = spark.createDataFrame([("SG01", "10001", 1)], "segment_id string, stock_code string, score bigint")
    world = spark.createDataFrame([("10001", 3), ("10002", 3), ("10003", 1)], "stock_code string, score bigint")
    scored = itemcf.candidate_scores(pairs, near).where("customer_id = 'C4'")
    lists = serve.fallback_lists(scored, customers, seg, world, pairs, 3)
    assert rows(lists, "rank", "stock_code", "method") == [(1, "10002", "item_cf"), (2, "10001", "segment_popularity"), (3, "10003", "global_popularity")]
    fresh = serve.fallback_lists(serve.cf_scores_for(pairs, scored, True), customers, seg, world, pairs, 3, new_only=True)
    assert rows(fresh, "rank", "stock_code") == [(1, "10002"), (2, "10003")]


def test_popularity_ties_go_by_code(spark):
    scores = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5)], "stock_code string, score bigint")
    assert rows(popularity.top_ranked(scores, 2), "rank", "stock_code") == [(1, "c"), (2, "a")]


def test_ranking_metrics(spark):
    lists = spark.createDataFrame([("u", i + 1, x) for i, x in enumerate("ABCDE")], "customer_id string, rank int, stock_code string")
    wanted = spark.createDataFrame([("u", x) for x in "BDF"] + [("v", "A")], "customer_id string, stock_code string")
    got = {r.customer_id: r for r in evaluate.user_metrics(lists, wanted, 5).collect()}
    assert (round(got["u"].recall, 6), got["u"].precision, got["u"].hit, round(got["u"].ndcg, 5)) == (0.666667, 0.4, 1.0, 0.49819)
    assert got["v"].ndcg == 0.0


def test_bootstrap_orders_its_bounds(spark):
    a = spark.createDataFrame([(f"u{i}", 0.6 + i / 100) for i in range(20)], "customer_id string, ndcg double")
    b = a.withColumn("ndcg", F.col("ndcg") - 0.3)
    r = evaluate.bootstrap(a, b, 100).first()
    assert 0 < r.d_low <= r.d_high and r.a_low <= r.a_high


def test_rule_segments_and_names(spark):
    data = [(f"C{i:03d}", float(i % 90), i % 7 + 1, float(i * 13 % 500), "known_active") for i in range(100)] + [("Z", 300.0, 0, 0.0, "known_inactive")]
    df = spark.createDataFrame(data, "customer_id string, recency_days double, frequency_invoices bigint, monetary_gbp double, status string")
    assigned = rules.rule_segments(rules.scores(df))
    found = {r.segment_id for r in assigned.select("segment_id").distinct().collect()}
    assert found <= {"SG01", "SG02", "SG03", "SG04", "SG_INACTIVE"} and assigned.where("customer_id = 'Z'").first().segment_id == "SG_INACTIVE"
    ordered = rules.ordinals(rules.segment_profiles(assigned)).orderBy("ordinal").collect()
    assert [r.median_monetary for r in ordered] == sorted((r.median_monetary for r in ordered), reverse=True)
    shares = monitor.segment_shares(assigned)
    assert not monitor.share_drift(shares, shares).where("alert").count()


def test_catalog_drift_and_empty_catalogs(spark):
    one, two = (spark.createDataFrame([(c,) for c in x], "stock_code string") for x in ("abc", "bc"))
    assert rows(monitor.catalog_drift(one, two)) == [(0, 1, 2, 0.6667, True)]
    none = one.limit(0)
    assert rows(monitor.catalog_drift(none, none)) == [(0, 0, 0, 1.0, False)]


def test_cluster_diagnostics(spark):
    pts = [(f"c{i}", int(i >= 10), (i % 10) / 10 + 10.0 * (i >= 10), 0.0, 0.0) for i in range(20)]
    df = spark.createDataFrame(pts, "customer_id string, cluster int, r double, f double, m double")
    assert cluster.silhouette(df).first().silhouette > 0.9 and cluster.davies_bouldin(df).first().davies_bouldin < 0.1
    assert cluster.adjusted_rand(df, df).first().ari == 1.0
    found = cluster.kmeans(df.drop("cluster"), 2)
    assert cluster.adjusted_rand(df, found).first().ari == 1.0
    lam = cluster.fit_power(df.drop("cluster").withColumn("f", F.rand(1)).withColumn("m", F.exp(F.rand(2))), levels=2)
    assert set(lam) == set("rfm")
    with pytest.raises(ValueError, match="unknown transform"):
        cluster.transformed(df, "sqrt")


def blobs(spark, n=40):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, s, (n, 3)) for c, s in ((0.0, 0.3), (4.0, 0.5), (-5.0, 0.2))])
    return x, spark.createDataFrame([(f"c{i}", *map(float, v)) for i, v in enumerate(x)], "customer_id string, r double, f double, m double").repartition(3)


def test_lloyd_and_expectation_steps_against_numpy(spark):
    x, df = blobs(spark)
    start = np.stack([x[[0, 50, 90]], x[[0, 1, 2]]])
    got, cost = fits.kmeans_fits(df, start, tolerance=0)
    for c, v in zip(start.copy(), got, strict=True):
        for _ in range(100):
            near = ((x[:, None] - c) ** 2).sum(2).argmin(1)
            c = np.array([x[near == k].mean(0) if (near == k).any() else c[k] for k in range(3)])
        assert np.allclose(c, v)
    assert cost[0] == pytest.approx(((x[:, None] - got[0]) ** 2).sum(2).min(1).sum())
    m, likely = fits.mixture_fits(df, len(x), got[[0, 0]], np.array([False, True]))
    for i in range(2):
        density = np.zeros(len(x))
        for w, mu, cov in zip(m.weight[i], m.mean[i], m.cov[i], strict=True):
            d = x - mu
            density += w * np.exp(-(d @ np.linalg.inv(cov) * d).sum(1) / 2) / np.sqrt((2 * np.pi) ** 3 * np.linalg.det(cov))
        assert np.log(density).sum() == pytest.approx(likely[i], rel=1e-6)
        assert np.allclose(m.mean[i], got[0], atol=0.01) and np.allclose(m.weight[i].sum(), 1)
    assert np.count_nonzero(m.cov[1]) == 9 and likely[0] > likely[1]


def test_candidates_agree_with_single_diagnostics(spark):
    x, df = blobs(spark)
    p = replace(DEFAULT, ks=(2, 3), seeds=(1, 2, 3), kmeans_restarts=4, mixture_restarts=2)
    found = {(r.family, r.covariance, r.k): r for r in fits.candidates(df, p).collect()}
    assert set(found) == {(f, c, k) for f, c in (("KMeans", "none"), ("GMM", "full"), ("GMM", "diag")) for k in (2, 3)}
    labels = cluster.kmeans(df, 3, 1, p).join(df, "customer_id")
    best = found["KMeans", "none", 3]
    assert best.ari == 1.0 and best.min_share == pytest.approx(1 / 3) and best.bic is None
    assert round(best.silhouette, 4) == cluster.silhouette(labels).first().silhouette
    assert found["GMM", "full", 3].bic < found["GMM", "full", 2].bic
    assert rows(cluster.selection(fits.candidates(df, p), p)) == [("KMeans", "none", 3)]
    assert fits.candidates(df.limit(0), p).count() == 0 and cluster.kmeans(df.limit(0), 3).count() == 0
    certain = cluster.gaussian_mixture(df, 3, "diag", p=p)
    assert certain.count() == len(x) and certain.agg(F.min("certainty")).first()[0] > 0.99


def test_agreement_of_unlike_seeds(spark):
    rng = np.random.default_rng(2)
    a, b, c = rng.integers(0, 3, (3, 60)).tolist()
    df = spark.createDataFrame([(f"c{i}", list(v)) for i, v in enumerate(zip(a, b, c, strict=True))], "customer_id string, labels array<int>")
    one = lambda k: df.select("customer_id", F.col("labels")[k].alias("cluster"))
    want = sorted(cluster.adjusted_rand(one(i), one(j)).first().ari for i, j in ((0, 1), (0, 2), (1, 2)))[1]
    assert fits.seed_agreement(df, [("KMeans", "none", 3, s) for s in range(3)]).first().ari == pytest.approx(want, abs=1e-6)


def test_selection_gates_before_rounding_and_ranks_after(spark):
    schema = "family string, covariance string, k int, min_share double, ari double, silhouette double"
    of = lambda *r: rows(cluster.selection(spark.createDataFrame(list(r), schema)))
    assert of(("KMeans", "none", 3, 0.02999, 1.0, 0.9)) == [("RFMRules", "none", 4)]
    assert of(("KMeans", "none", 5, 0.1, 0.90001, 0.5), ("GMM", "full", 3, 0.1, 0.90004, 0.495)) == [("GMM", "full", 3)]
    assert of(("GMM", "diag", 4, 0.1, 0.9, 0.5), ("KMeans", "none", 4, 0.1, 0.9, 0.491)) == [("KMeans", "none", 4)]
    assert of(("KMeans", "none", 3, 0.1, 0.99, 0.45), ("GMM", "full", 6, 0.1, 0.8, 0.5)) == [("GMM", "full", 6)]


@pytest.mark.parametrize("cid,k,mode", [("", 5, "repeat_allowed"), ("a/b", 5, "repeat_allowed"), ("..", 5, "repeat_allowed"), ("a", 0, "repeat_allowed"), ("a", True, "repeat_allowed"), ("a", 5, "any")])
def test_bad_requests(cid, k, mode):
    with pytest.raises(ValueError):
        serve.request(cid, k, mode)


def test_rules_are_judged_above_the_aggregate(spark):
    """A filter on the rule must not repeat the clean-up of texts below the aggregation."""
    raw = spark.createDataFrame([line(), line(), line(price="0")], RAW)
    other = spark.createDataFrame([("1", "x")], "InvoiceNo string, y string")
    bought = clean.purchases(clean.classified(raw.join(other, "InvoiceNo").select(*RAW_COLUMNS)))
    plan = bought._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert joins and not any("regexp_replace" in x for x in joins) and bought.count() == 1


def test_concentration_counts_ties_once(spark):
    df = spark.createDataFrame([buy(f"C{i:02d}", "10001", "2011-01-01 00:00:00", value=[100.0, 50.0, 50.0, 50.0][i] if i < 4 else 1.0) for i in range(20)], BOUGHT)
    assert rows(clean.concentration(df, (0.1, 0.5))) == [(0.1, round(150 / 266, 4)), (0.5, round(256 / 266, 4))]


def test_reasons_name_what_was_bought(spark):
    lists = spark.createDataFrame([("A", 1, "10001", 0.5, "item_cf"), ("A", 2, "10002", 3.0, "segment_popularity"), ("A", 3, "10003", 1.0, "global_popularity")], "customer_id string, rank bigint, stock_code string, score double, method string")
    backers = spark.createDataFrame([("A", "10001", ["10009", "10008"])], "customer_id string, stock_code string, supporters array<string>")
    names = spark.createDataFrame([("10009", "red cup"), ("10001", "tea pot")], "stock_code string, description string")
    segments = spark.createDataFrame([("A", "SG02")], "customer_id string, segment_id string")
    got = {r["rank"]: r for r in serve.explained(lists, backers, names, segments).collect()}
    assert (got[1].reason, got[1].supporting_codes, got[1].description) == ("Frequently bought together with red cup, 10008", '["10009", "10008"]', "tea pot")
    assert (got[2].reason_code, got[2].reason) == ("popular_in_segment", "Popular among shoppers in your segment (SG02)")
    assert (got[3].reason_code, got[3].description, got[3].is_fallback) == ("popular_overall", "10003", True)


def test_answers_for_known_and_unknown_customers(spark):
    profiles = spark.createDataFrame([("A", "known_active", "SG01", "x")], "customer_id string, status string, segment_id string, segment_label string")
    lists = spark.createDataFrame([("A", r, f"1000{r}", 0.5, "item_cf" if r == 1 else "global_popularity") for r in (1, 2, 3)], "customer_id string, rank bigint, stock_code string, score double, method string")
    names = spark.createDataFrame([("10001", "cup")], "stock_code string, description string")
    backers = spark.createDataFrame([], "customer_id string, stock_code string, supporters array<string>")
    world = spark.createDataFrame([("10001", 5), ("10002", 4)], "stock_code string, score bigint")
    asked = spark.createDataFrame([("A", 2), ("Z", 2), ("Y", 5)], "customer_id string, top_k int")
    named = serve.explained(lists, backers, names, profiles)
    got = {r.customer_id: r for r in serve.answers(asked, profiles, named, world, names).collect()}
    assert (got["A"].customer_status, got["A"].status, got["A"].returned_k, got["A"].fallback_count) == ("known_active", "ok", 2, 1)
    assert (got["Z"].customer_status, got["Z"].status, [x.stock_code for x in got["Z"]["items"]]) == ("unknown_customer", "fallback_only", ["10001", "10002"])
    assert got["Y"].status == "insufficient_catalog"
    none = serve.answers(asked, profiles, named.limit(0), world.limit(0), names)
    assert {r.status for r in none.collect()} == {"empty_catalog"}


def test_fallback_drift_alerts_on_growth_only(spark):
    low, high = (spark.createDataFrame([(x,)], "share double") for x in (0.1, 0.25))
    assert rows(monitor.fallback_drift(low, high)) == [(0.1, 0.25, 0.15, True)] and rows(monitor.fallback_drift(high, low)) == [(0.25, 0.1, -0.15, False)]
