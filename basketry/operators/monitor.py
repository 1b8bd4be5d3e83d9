"""Drift between two snapshots: medians, segment shares, catalog and fallback share."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import half_even
from basketry.operators.quantiles import array_of, long, quantiles
from basketry.operators.rules import QUARTILES, RFM
from basketry.operators.serve import TIERS
from basketry.operators.snapshot import ACTIVE
from basketry.params import DEFAULT, Params


def snapshot_summary(profiles: DataFrame) -> DataFrame:
    """(measure, n, median, q25, q75) over active customers."""
    values = long(profiles.where(F.col("status") == ACTIVE), {c: F.col(c) for c in RFM})
    found = quantiles(values, array_of(*QUARTILES), ("measure",))  # nine rows
    q = lambda at: half_even(F.max(F.when(F.col("level") == at, F.col("value"))), 2)
    told = found.groupBy("measure").agg(q(0.5).alias("median"), q(0.25).alias("q25"), q(0.75).alias("q75"))
    return values.groupBy("measure").agg(F.count("x").alias("n")).join(told, "measure").select("measure", "n", "median", "q25", "q75")


def median_drift(before: DataFrame, after: DataFrame, p: Params = DEFAULT) -> DataFrame:
    joined = before.select("measure", F.col("median").alias("before")).join(after.select("measure", F.col("median").alias("after")), "measure")
    change = F.when(F.col("before") != 0, half_even((F.col("after") - F.col("before")) / F.col("before"), 4))
    alert = F.when(F.col("before") != 0, F.abs((F.col("after") - F.col("before")) / F.col("before")) > p.median_alert).otherwise(F.abs(F.col("after") - F.col("before")) > 0.01)
    return joined.select("measure", "before", "after", change.alias("change"), alert.alias("alert"))


def segment_shares(assigned: DataFrame) -> DataFrame:
    active = assigned.where(F.col("status") == ACTIVE)
    total = active.agg(F.count("*").alias("total"))
    return active.groupBy("segment_id").agg(F.count("*").alias("n")).join(F.broadcast(total)).select("segment_id", half_even(F.col("n") / F.col("total"), 4).alias("share"))


def share_drift(before: DataFrame, after: DataFrame, p: Params = DEFAULT) -> DataFrame:
    joined = before.select("segment_id", F.col("share").alias("b")).join(after.select("segment_id", F.col("share").alias("a")), "segment_id", "full_outer")
    b, a = F.coalesce("b", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return joined.select("segment_id", b.alias("before"), a.alias("after"), half_even(a - b, 4).alias("change"), (F.abs(half_even(a - b, 4)) > p.share_alert).alias("alert"))


def catalog_drift(before: DataFrame, after: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Items added, removed and kept, and the Jaccard similarity of both catalogs (1 where both are empty)."""
    joined = before.select("stock_code", F.lit(True).alias("b")).join(after.select("stock_code", F.lit(True).alias("a")), "stock_code", "full_outer")
    counts = joined.agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("kept"), F.count("*").alias("n"))
    jaccard = F.when(F.col("n") > 0, half_even(F.col("kept") / F.col("n"), 4)).otherwise(1.0)
    return counts.select("added", "removed", "kept", jaccard.alias("jaccard")).withColumn("alert", F.col("jaccard") < p.jaccard_alert)


def overview(profiles: DataFrame, items: DataFrame, fallback: DataFrame) -> DataFrame:
    """One row: customers known and active, items of the catalog, share of fallback rows in the lists (fallback: one row of `share`)."""
    customers = profiles.agg(F.count("*").alias("total_known"), F.count_if(F.col("status") == ACTIVE).alias("total_active"))
    return customers.join(items.agg(F.count("*").alias("catalog_size"))).join(fallback.select(F.col("share").alias("fallback_item_share")))


def fallback_share(lists: DataFrame) -> DataFrame:
    """One row: the share of list rows that aren't similar items; 0 without lists."""
    counts = lists.agg(F.count("*").alias("n"), F.count_if(F.col("method") != TIERS[0]).alias("fell"))
    return counts.select(F.when(F.col("n") > 0, half_even(F.col("fell") / F.col("n"), 4)).otherwise(0.0).alias("share"))


def fallback_drift(before: DataFrame, after: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(before, after, change, alert): only a growing share of fallbacks asks for a look."""
    one = before.select(F.col("share").alias("before")).join(after.select(F.col("share").alias("after")))  # single rows
    change = half_even(F.col("after") - F.col("before"), 4)
    return one.select("before", "after", change.alias("change"), (change > p.fallback_alert).alias("alert"))


def percent(c: Column) -> Column:
    return F.format_string("%+.2f%%", c * 100)


def alerts(medians: DataFrame, shares: DataFrame, items: DataFrame, fallback: DataFrame) -> DataFrame:
    """(check, key, message) of every alert."""
    return (
        medians.where("alert").select(F.lit("median").alias("check"), F.col("measure").alias("key"), F.concat(F.lit("median changed by "), percent(F.coalesce("change", F.lit(0.0)))).alias("message"))
        .unionAll(shares.where("alert").select(F.lit("segment"), "segment_id", F.concat(F.lit("share changed by "), percent(F.col("change")))))
        .unionAll(items.where("alert").select(F.lit("catalog"), F.lit("jaccard"), F.format_string("similarity %.4f", "jaccard")))
        .unionAll(fallback.where("alert").select(F.lit("fallback"), F.lit("share"), F.concat(F.lit("share increased by "), percent(F.col("change")))))
    )


SNAPSHOT = "snapshot string, kind string, key string, value double"


def snapshot_rows(name: str, profiles: DataFrame, assigned: DataFrame, items: DataFrame, fallback: DataFrame) -> DataFrame:
    """(snapshot, kind, key, value): all that a comparison reads of a snapshot, for a table that runs append to.

    Kinds: median, q25 and q75 by measure, customers by status, share by segment, the
    items of the catalog, and the share of fallback rows.
    """
    summary = snapshot_summary(profiles)
    measures = F.array(*(F.struct(F.lit(kind).alias("kind"), F.col(kind).alias("value")) for kind in ("median", "q25", "q75")))
    parts = [
        summary.select(F.col("measure").alias("key"), F.explode(measures).alias("m")).select("m.kind", "key", "m.value"),
        profiles.groupBy(F.lit("customers").alias("kind"), F.col("status").alias("key")).agg(F.count("*").cast("double").alias("value")),
        segment_shares(assigned).select(F.lit("share").alias("kind"), F.col("segment_id").alias("key"), F.col("share").alias("value")),
        items.select(F.lit("item").alias("kind"), F.col("stock_code").alias("key"), F.col("n_buyers").cast("double").alias("value")),
        fallback.select(F.lit("fallback").alias("kind"), F.lit("share").alias("key"), F.col("share").alias("value")),
    ]
    return reduce(DataFrame.unionAll, parts).select(F.lit(name).alias("snapshot"), "kind", "key", "value")


def append_snapshot(rows: DataFrame, path: str) -> None:
    """Add a snapshot to the table at path; a name that is there already is refused."""
    name = rows.select("snapshot").first()[0]
    if name in snapshot_names(rows.sparkSession, path):
        raise ValueError(f"the table has a snapshot {name!r} already")
    rows.write.mode("append").partitionBy("snapshot").parquet(path)


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT).parquet(path)


def snapshot_names(spark: SparkSession, path: str) -> list[str]:
    """Names in the table at path, which are days, in order; none where there is no table yet."""
    try:
        table = read_snapshots(spark, path)
        return sorted(r.snapshot for r in table.select("snapshot").distinct().collect())  # a row a snapshot
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def compared(table: DataFrame, reference: str, current: str, p: Params = DEFAULT) -> DataFrame:
    """(check, key, message) of every alert between two snapshots of the table, the earlier one first."""
    if not reference < current:
        raise ValueError(f"the reference {reference} isn't before {current}")
    of = lambda name, kind, key, value: table.where((F.col("snapshot") == name) & (F.col("kind") == kind)).select(F.col("key").alias(key), F.col("value").alias(value))
    two = lambda *c: (of(reference, *c), of(current, *c))
    return alerts(
        median_drift(*two("median", "measure", "median"), p), share_drift(*two("share", "segment_id", "share"), p), catalog_drift(*two("item", "stock_code", "n_buyers"), p), fallback_drift(*two("fallback", "key", "share"), p)
    )


def report(found: DataFrame) -> DataFrame:
    """One row: how many alerts, their messages in order and whether someone has to look."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("check", "key", "message"))), lambda x: F.concat_ws(": ", x["check"], x["key"], x["message"]))
    return found.agg(F.count("*").alias("n_alerts"), F.array_join(listed, "; ").alias("alerts")).withColumn("requires_review", F.col("n_alerts") > 0)
