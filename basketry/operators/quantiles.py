"""Exact quantiles without one task that holds all values.

Values are counted, dealt to sorted ranges and written once. The counts of the ranges say
which of them hold the wanted ranks; only those are read again and sorted, each alone. No
value reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.sources import stored


def long(df: DataFrame, measures: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, measure, x): a row for each measure of each row."""
    parts = F.array(*(F.struct(F.lit(name).alias("measure"), c.cast("double").alias("x")) for name, c in measures.items()))
    return df.select(*by, F.explode(parts).alias("p")).select(*by, "p.measure", "p.x")


def quantiles(values: DataFrame, levels: Column, by: tuple[str, ...] = (), x: str = "x") -> DataFrame:
    """(*by, level, value): linear interpolation between the two nearest ranks, as `percentile` does; nulls don't count.

    levels: an array of doubles from 0 to 1.
    """
    keys = list(by)
    counts = values.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count("*").alias("n"))
    held = stored(counts.repartitionByRange(*keys, "x").withColumn("part", F.spark_partition_id()), "ranges")
    whole, earlier = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = held.groupBy(*keys, "part").agg(F.sum("n").alias("n"))  # a row for each range
    spans = spans.withColumn("total", F.sum("n").over(whole)).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    at = spans.withColumn("level", F.explode(levels)).withColumn("at", (F.col("total") - 1) * F.col("level"))
    ranks = at.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    wanted = ranks.where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))).select(*keys, "part", "before", "level", "at", "rank")
    running = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = held.join(wanted.select(*keys, "part").distinct(), [*keys, "part"], "left_semi").withColumn("upto", running)
    own = F.col("rank") - F.col("before")
    hits = placed.join(wanted, [*keys, "part"]).where((own < F.col("upto")) & (own >= F.col("upto") - F.col("n")))
    ends = hits.groupBy(*keys, "level", "at").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    return ends.select(*keys, "level", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value"))


def pick(measure: str, level: float) -> Column:
    """The value of one measure and level, as an aggregate over the rows of `quantiles`."""
    return F.max(F.when((F.col("measure") == measure) & (F.col("level") == level), F.col("value")))


def array_of(*levels: float) -> Column:
    return F.array(*map(F.lit, levels))
