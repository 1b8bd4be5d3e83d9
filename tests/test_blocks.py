"""Item-to-item filtering in blocks: the same rows as the plain joins, and no exchange of what the joins multiply."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from basketry.operators import itemcf


@pytest.fixture(scope="module")
def pairs(spark):
    rng = np.random.default_rng(5)
    data = {(f"C{c}", f"{i:05d}") for c in range(90) for i in rng.integers(0, 40, 1 + c % 23).tolist()} | {("H", f"{i:05d}") for i in range(45)}
    return spark.createDataFrame(sorted(data), "customer_id string, stock_code string").repartition(3).cache()


def rows(df, *cols):
    return sorted(tuple(tuple(x) if isinstance(x, list) else round(x, 10) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())


@pytest.fixture(params=[(10**9, 10**9, 10**9, 10**6, 10**6), (700, 300, 200, 64, 50)])
def sizes(request, monkeypatch):
    for name, n in zip(("MET", "HELD", "SCORED", "CHUNK", "TERMS"), request.param, strict=True):
        monkeypatch.setattr(itemcf, name, n)


def test_blocks_equal_the_joins(spark, pairs, sizes):
    codes = itemcf.numbered(pairs).cache()
    assert [r.item for r in codes.orderBy("stock_code").collect()] == list(range(45))
    bought = itemcf.baskets(pairs, codes).cache()
    both = itemcf.co_buyers(pairs)
    assert rows(itemcf.pair_counts(bought, codes, 2), "item_a", "item_b", "n_both") == rows(both.where("n_both >= 2"), "item_a", "item_b", "n_both")
    plain = itemcf.neighbours(both, itemcf.item_counts(pairs), most=12).cache()
    near = itemcf.near_items(bought, codes, most=12).cache()
    assert rows(near, "seed", "neighbour", "sim", "rank") == rows(plain, "seed", "neighbour", "sim", "rank")
    idf = itemcf.item_idf(pairs, spark.range(1).select(F.lit(200).alias("n")))
    cols = ("seed", "neighbour", "sim", "rank")
    assert rows(itemcf.near_items(bought, codes, idf), *cols) == rows(itemcf.neighbours(both, itemcf.item_counts(pairs), idf=idf), *cols)
    scored = itemcf.scores_by_bound(pairs, plain, (3, 12)).cache()
    got = itemcf.best_candidates(bought, codes, near, (3, 12), backers=3).cache()
    for n in (3, 12):
        want = itemcf.scores_of(scored, n)
        assert rows(got.where(F.col("bound") == n), "customer_id", "stock_code", "score") == rows(want, "customer_id", "stock_code", "score")
        backed = itemcf.supporters(pairs, plain.where(F.col("rank") <= n))
        assert rows(got.where(F.col("bound") == n), "customer_id", "stock_code", "supporters") == rows(backed, "customer_id", "stock_code", "supporters")
        for new_only in (False, True):
            few = itemcf.best_candidates(bought, codes, near, (3, 12), 4, new_only).where(F.col("bound") == n)
            left = itemcf.without_owned(want, pairs) if new_only else want
            cols = ("customer_id", "rank", "stock_code", "score")
            assert rows(itemcf.top_candidates(few, 4), *cols) == rows(itemcf.top_candidates(left, 4), *cols)


def test_empty_blocks(spark, pairs):
    none = pairs.limit(0)
    codes = itemcf.numbered(none)
    bought = itemcf.baskets(none, codes)
    near = itemcf.near_items(bought, codes)
    assert near.count() == 0 and itemcf.pair_counts(bought, codes).count() == 0
    assert itemcf.best_candidates(bought, codes, near, (50,), 10).count() == 0
    alone = spark.createDataFrame([("A", "1"), ("B", "2")], "customer_id string, stock_code string")
    codes = itemcf.numbered(alone)
    bought = itemcf.baskets(alone, codes)
    assert itemcf.best_candidates(bought, codes, itemcf.near_items(bought, codes), (50,), 10).count() == 0


def shuffled(spark, df):
    """Rows that writing df sends through exchanges."""
    store, arr = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, arr, spark.sparkContext._jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = total()
    df.write.format("noop").mode("overwrite").save()
    return sum(n for k, n in total().items() if k not in before)


def test_no_exchange_of_terms_of_scores(spark):
    """A registered query's candidates: 400 baskets of 30 of 60 items say 400 * 30 * 50 things of their neighbours."""
    from basketry.plans import registry

    rng = np.random.default_rng(7)
    data = [(f"C{c}", f"{i:05d}") for c in range(400) for i in rng.permutation(60)[:30].tolist()]
    d = object.__new__(registry.Data)
    d.spark, d.pairs = spark, spark.createDataFrame(data, "customer_id string, stock_code string").cache()
    d.near.count()
    assert shuffled(spark, d.candidates()) < 30_000 < 400 * 30 * 50


def test_only_what_a_query_asks_for_is_scored(spark, monkeypatch):
    from basketry.plans import registry

    asked = []
    real = itemcf.best_candidates

    def noted(bought, codes, near, bounds, k=None, new_only=False, backers=0):
        asked.append((bounds, backers))
        return real(bought, codes, near, bounds, k, new_only, backers)

    monkeypatch.setattr(itemcf, "best_candidates", noted)
    d = registry.Data(spark, "/root/testdata/sf0.001")
    d.lists()
    d.lists()
    d.explained()
    assert asked == [((50,), 0), ((50,), 3)]
    assert set(d.metrics) == {"GlobalPopularity", "SegmentPopularity", *registry.CF_MODELS} and len(asked) == 3
    early = registry.Data.of(d.bought, "test")
    early.lists(n=100, choices=(50, 100))
    early.lists(n=50)
    assert asked[3:] == [((50, 100), 0)]


def test_terms_are_grouped_in_order():
    key, place = np.array([7, 3, 7, 3, 2**61]), np.array([10, 11, 12, 13, 14])
    for last in (9, 2**61):
        key[-1] = last
        keys, said, at, order = itemcf._grouped(key, place)
        assert keys.tolist() == [3, 7, last] and said.tolist() == [0, 0, 1, 1, 2]
        assert at.tolist() == [11, 13, 10, 12, 14] and order.tolist() == [1, 3, 0, 2, 4]


def test_baskets_travel_packed(spark):
    """Fewer rows go through the exchanges of a count than there are baskets, even without a copy for each unit."""
    rng = np.random.default_rng(9)
    data = [(f"C{c}", f"{i:05d}") for c in range(400) for i in rng.permutation(60)[:30].tolist()]
    pairs = spark.createDataFrame(data, "customer_id string, stock_code string").repartition(2)
    codes = itemcf.numbered(pairs).cache()
    bought = itemcf.baskets(pairs, codes).cache()
    assert codes.count() == 60 and bought.count() == 400
    assert shuffled(spark, itemcf.near_items(bought, codes)) < 100
    assert shuffled(spark, itemcf.pair_counts(bought, codes)) < 100


def test_packed_lists_come_back():
    width, values = np.array([3, 1, 2]), np.array([5, 90_000, 2**31 - 1, 7, 0, 1], np.int32)
    both = itemcf._unpacked(itemcf._packed(width, itemcf._steps(values, width)), 9)
    assert both[:3].tolist() == width.tolist() and itemcf._summed(both[3:], width).tolist() == values.tolist()


def test_last_purchases_give_what_the_history_gives(spark):
    from basketry.operators import snapshot
    from basketry.plans import registry

    d = registry.Data(spark, "/root/testdata/sf0.001")
    history = snapshot.history(d.bought, d.cutoff).select("customer_id", "stock_code").distinct()
    assert rows(d.owned, "customer_id", "stock_code") == rows(history, "customer_id", "stock_code")
    assert rows(d.items, "stock_code", "n_buyers") == rows(snapshot.catalog(d.bought, d.cutoff), "stock_code", "n_buyers")
    assert rows(d.pairs, "customer_id", "stock_code") == rows(snapshot.interactions(d.bought, d.items, d.cutoff), "customer_id", "stock_code")


def test_recent_pairs_come_from_the_last_purchases(spark):
    from basketry.functions import days_before, stamp
    from basketry.operators import popularity
    from basketry.params import DEFAULT
    from basketry.plans import registry

    d = registry.Data(spark, "/root/testdata/sf0.001")
    ts = F.col("ts")
    want = d.bought.where((ts >= days_before(stamp(d.cutoff), DEFAULT.popular_days)) & (ts < stamp(d.cutoff))).select("customer_id", "stock_code").distinct()
    assert want.count() and rows(popularity.recent_pairs(d.lasts, d.cutoff), "customer_id", "stock_code") == rows(want, "customer_id", "stock_code")


def test_metrics_ask_for_those_with_a_truth_only(spark, monkeypatch):
    from basketry.operators import evaluate
    from basketry.plans import registry

    d = registry.Data(spark, "/root/testdata/sf0.001")
    truth = d.truth("primary")
    lists = {"GlobalPopularity": d.popular_lists(), "SegmentPopularity": d.segment_lists(), "ItemItemCF_N50": d.lists(n=50), "ItemItemCF_N100": d.lists(n=100)}
    asked = truth.select("customer_id").distinct().count()
    assert 0 < asked < d.known.count()
    scored, real = [], itemcf.best_candidates
    monkeypatch.setattr(itemcf, "best_candidates", lambda bought, *a: scored.append(bought.count()) or real(bought, *a))
    columns = ("customer_id", "recall", "precision", "hit", "ndcg")
    for name, got in d.metrics.items():
        assert rows(got, *columns) == rows(evaluate.user_metrics(lists[name], truth), *columns)
    assert len(scored) == 1 and scored[0] <= asked


def test_units_of_scores_send_little():
    """Many neighbours and few customers: neighbours are dealt to blocks; many customers: customers to shares."""
    assert itemcf._dealt(10_000_000, 500_000, 300_000, 8)[0] > 1
    assert itemcf._dealt(5_000_000, 15_000_000, 9_000_000, 8) == (1, 8)
    for n_near, n_bought, n_best, busy in ((0, 0, 0, 1), (30_000_000, 100, 10, 8), (10, 40_000_000, 0, 8)):
        blocks, shares = itemcf._dealt(n_near, n_bought, n_best, busy)
        assert blocks * itemcf.HELD >= n_near and shares * itemcf.SCORED >= n_bought and blocks * shares >= busy
