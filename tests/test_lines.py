"""The join of the order tables and the clean-up of their texts: few exchanges, bounded shares, the same lines."""

from pyspark.sql import functions as F

from basketry import sources
from basketry.functions import strip
from basketry.operators import clean
from basketry.plans import registry

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trimming_equals_the_pattern(spark):
    odd = ["", " ", "a", " a ", "\t\n a b \r\n", " é ", "x\x85", "x \x85", "  ", "\x1cx", "\x0bx\x0c", None, "a\n\n", " a ", "'-.0 "]
    df = spark.createDataFrame([(x,) for x in odd], "t string")
    assert not df.where(~strip(F.col("t")).eqNullSafe(F.regexp_replace("t", r"^\s+|\s+$", ""))).count()


def test_lines_are_grouped_where_they_lie(spark):
    keyed = clean.classified(sources.invoice_lines(spark, SF, keyed=True))
    plain = clean.classified(sources.invoice_lines(spark, SF))
    assert keyed.columns == plain.columns
    assert not keyed.exceptAll(plain).count() and not plain.exceptAll(keyed).count()
    assert "hashpartitioning(InvoiceNo" in plan_of(plain) and "hashpartitioning(InvoiceNo" not in plan_of(keyed)


def test_shares_of_lines_are_bounded(spark, monkeypatch):
    want = clean.audit(clean.classified(sources.invoice_lines(spark, SF, keyed=True))).collect()
    monkeypatch.setattr(sources, "TASK_LINES", 500)
    lines = clean.classified(sources.invoice_lines(spark, SF, keyed=True))
    n = -(-sources.table(spark, SF, "lineitem").count() // 500)
    assert "hashpartitioning(l_orderkey" in plan_of(lines) and f", {n}), REPARTITION_BY_NUM" in plan_of(lines)
    assert sorted(clean.audit(lines).collect()) == sorted(want)


def odd_tables(spark, folder):
    """Order tables with parts alike in code and name, cut codes, postage, blank names, and every reason to remove a line; no line is there once only."""
    parts = [(0, "red ring", "LARGE", 1), (7, " red ring", "SMALL", 9), (1234560, "blue bolt", "SMALL", 9), (1234561, " blue bolt ", "SMALL", 9), (1234562, "blue nut", "SMALL", 9), (1234563, None, "SMALL", 9), (1234564, " ", "SMALL", 9), (9, "stamp", "PROMO", 2), (10, "odd", None, None)]
    orders = [(k, c, day) for k, c, day in ((1, 1, "1996-01-02"), (97, 2, "1997-01-02"), (211, 3, "1996-03-04"), (307, 4, "1996-03-04"), (5, 50, "1996-03-04"), (6, 173, "1996-03-04"), (8, 5, None), (12, 1, "2000-12-30"))]
    flags = (("N", "O"), ("R", "F"), ("A", "O"), (None, None))
    lines = [(o, p, q, price, *f, d) for o, _, _ in orders for p, *_ in parts for q, price in ((2.0, 10.0), (2.0, 0.0), (0.5, 3.0), (None, 1.0), (3.0, None), (1.0, 5.0)) for f in flags for d in (0.0, 0.1)]
    spark.createDataFrame(lines * 2, "l_orderkey bigint, l_partkey bigint, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, d string").selectExpr("o_orderkey", "o_custkey", "CAST(d AS TIMESTAMP_NTZ) AS o_orderdate").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(c, c % 2) for c in (1, 2, 3, 4, 5, 50, 173)], "c_custkey bigint, c_nationkey int").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(0, "A"), (1, "B")], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")


def test_sound_lines_give_the_same_purchases(spark, tmp_path):
    odd_tables(spark, tmp_path)
    for folder, least in ((SF, 1000), (str(tmp_path), 30)):
        full = clean.purchases(clean.classified(sources.invoice_lines(spark, folder, keyed=True))).select(*registry.BOUGHT)
        lean = clean.purchases(clean.classified(sources.invoice_lines(spark, folder, keyed=True, sound=True))).select(*registry.BOUGHT)
        assert lean.count() >= least
        assert not lean.exceptAll(full).count() and not full.exceptAll(lean).count()


def test_exchanged_lines_have_no_texts(spark, monkeypatch):
    """Three exchanges of lines and orders, none of which takes a text or a line that the tables tell to be removed."""
    monkeypatch.setattr(sources, "TASK_LINES", 500)
    plan = plan_of(registry.lean(spark, SF, once=True).bought)
    assert "p_name" in plan  # the names are still told apart
    lines = plan[: plan.index("hashpartitioning(l_orderkey")]
    assert "n_name" not in plan and "Description" not in lines[lines.rindex("Exchange") :]
    assert "l_returnflag" in plan and "NOT " in plan[plan.index("hashpartitioning(l_partkey") :]


def test_tables_are_written_small(spark):
    import glob

    held = sources.stored(spark.range(10), "small")
    assert glob.glob(held.inputFiles()[0].removeprefix("file://"))[0].endswith(".zstd.parquet") and held.count() == 10
