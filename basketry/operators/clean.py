"""Cleaning of raw invoice lines by ordered rules; every line is charged to the first rule that removes it.

Copies are counted by one aggregation over the canonical columns, so a line repeated any
number of times is one row from there on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import blank_to_null, canonical_code, canonical_customer, exact_sum, half_even, lenient
from basketry.params import DEFAULT
from basketry.sources import KEY, RAW_COLUMNS, require_columns, stored

RULES = ("2_invalid_core", "3_duplicate", "4_no_customer", "5_cancelled", "6_price", "7_merchandise", "8_value")


def canonical(raw: DataFrame) -> DataFrame:
    require_columns(raw)
    return raw.select(
        canonical_code(F.col("InvoiceNo")).alias("InvoiceNo"),
        canonical_code(F.col("StockCode")).alias("StockCode"),
        blank_to_null(F.col("Description")).alias("Description"),
        lenient(F.col("Quantity"), "double").alias("Quantity"),
        F.col("InvoiceDate").try_cast("timestamp_ntz").alias("InvoiceDate"),
        lenient(F.col("UnitPrice"), "double").alias("UnitPrice"),
        canonical_customer(F.col("CustomerID")).alias("CustomerID"),
        F.coalesce(blank_to_null(F.col("Country")), F.lit("Unknown")).alias("Country"),
        *([KEY] if KEY in raw.columns else []),
    )


def classified(raw: DataFrame, merchandise: str = DEFAULT.merchandise, strict_nulls: bool = False) -> DataFrame:
    """Distinct canonical lines with `copies` and the rule that removes them (null: kept).

    A line that fails the core checks is charged with all its copies; of others the
    first copy goes on and the rest are duplicates. With strict_nulls a missing invoice
    or code fails the core checks as well. Where the lines have a key that InvoiceNo
    decides, grouping by it too changes no group and spares the exchange.
    """
    lines = canonical(raw)
    lines = lines.groupBy(*lines.columns).agg(F.count("*").alias("copies")).drop(KEY)
    absent = F.col("InvoiceDate").isNull() | F.col("Quantity").isNull() | F.col("UnitPrice").isNull() | (F.col("InvoiceNo") == "") | (F.col("StockCode") == "")
    if strict_nulls:
        absent |= F.col("InvoiceNo").isin("NAN") | F.col("StockCode").isin("NAN")
    odd_id = F.col("CustomerID").isNotNull() & ~F.col("CustomerID").rlike("^[0-9]+$")
    value = half_even(F.col("Quantity").cast("bigint") * F.col("UnitPrice"), 4)
    rule = (
        F.when(absent | odd_id, RULES[0])
        .when(F.col("CustomerID").isNull(), RULES[2])
        .when(F.col("InvoiceNo").startswith("C") | (F.col("Quantity") <= 0), RULES[3])
        .when(F.col("UnitPrice") <= 0, RULES[4])
        .when(~F.col("StockCode").rlike(f"^(?:{merchandise})"), RULES[5])
        .when(~(value > 0), RULES[6])
    )
    # Tied to the aggregate: a filter on the rule would else go below it and repeat the clean-up of texts there.
    return lines.withColumn("value", value).withColumn("rule", F.when(F.col("copies") > 0, rule))


def audit(lines: DataFrame) -> DataFrame:
    """(rule, n_rows): raw lines, lines removed by each rule, lines kept; the parts add up to the whole."""
    first, again = F.when(F.col("rule") == RULES[0], F.col("copies")).otherwise(1), F.when(F.col("rule") == RULES[0], 0).otherwise(F.col("copies") - 1)
    parts = F.array(
        F.struct(F.lit("raw").alias("rule"), F.col("copies").alias("n")),
        F.struct(F.coalesce("rule", F.lit("kept")).alias("rule"), first.cast("bigint").alias("n")),
        F.struct(F.lit(RULES[1]).alias("rule"), again.cast("bigint").alias("n")),
    )
    return lines.select(F.explode(parts).alias("p")).groupBy("p.rule").agg(F.sum("p.n").alias("n_rows")).where("n_rows > 0")


def anonymous_value(lines: DataFrame) -> DataFrame:
    """Lines without a customer and what they add up to, returns netted off."""
    none = lines.where(F.col("rule") == RULES[2])
    return none.agg(F.count("*").alias("n_rows"), F.coalesce(half_even(F.sum((F.col("Quantity") * F.col("UnitPrice")).cast("decimal(28,6)")).cast("double"), 2), F.lit(0.0)).alias("anonymous_value"))


def excluded_codes(lines: DataFrame, top: int = 50) -> DataFrame:
    """The codes that aren't merchandise, most frequent first (a top-k report)."""
    return lines.where(F.col("rule") == RULES[5]).groupBy(F.col("StockCode").alias("stock_code")).agg(F.count("*").alias("n_rows")).orderBy(F.desc("n_rows"), "stock_code").limit(top)


def purchases(lines: DataFrame) -> DataFrame:
    return lines.where("rule IS NULL").select(
        F.col("InvoiceNo").alias("invoice_no"), F.col("StockCode").alias("stock_code"), F.col("Description").alias("description"), F.col("Quantity").cast("bigint").alias("quantity"),
        F.col("InvoiceDate").alias("ts"), F.col("UnitPrice").alias("unit_price"), F.col("CustomerID").alias("customer_id"), F.col("Country").alias("country"), "value",
    )


def provenance(raw: DataFrame) -> DataFrame:
    return raw.agg(F.count("*").alias("n_rows"), F.min("InvoiceDate").alias("first_ts"), F.max("InvoiceDate").alias("last_ts"))


def concentration(bought: DataFrame, shares=(0.01, 0.05, 0.10)) -> DataFrame:
    """(top_share, spend_share): part of all spend by the top customers, ceil(share * customers) of them.

    The rank comes from counts of customers by exact spend, so no one task sorts all customers;
    of customers with one spend as many count as the share asks for.
    """
    spend = bought.groupBy("customer_id").agg(F.sum(F.col("value").cast("decimal(28,4)")).alias("spend"))
    total = spend.agg(F.count("*").alias("n"), F.sum("spend").alias("all")).select("n", F.col("all").cast("double").alias("all"))
    cuts = total.select("all", F.explode(F.array(*(F.struct(F.lit(s).alias("share"), F.ceil(F.lit(s) * F.col("n")).cast("bigint").alias("m")) for s in shares))).alias("c")).select("all", "c.share", "c.m").collect()
    # Customers by exact spend, in ranges of it: a range's first rank is the count of all above, so each range adds up alone.
    counts = spend.groupBy("spend").agg(F.count("*").alias("n")).repartitionByRange(F.desc("spend")).withColumn("part", F.spark_partition_id())
    counts = stored(counts, "spend")
    above = counts.groupBy("part").agg(F.sum("n").alias("n"), F.sum(F.col("spend") * F.col("n")).alias("s"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    above = above.select("part", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("before"))
    running = F.sum("n").over(Window.partitionBy("part").orderBy(F.desc("spend")).rowsBetween(Window.unboundedPreceding, -1))
    placed = counts.withColumn("own", F.coalesce(running, F.lit(0))).join(F.broadcast(above), "part").select("spend", "n", (F.col("own") + F.col("before")).alias("first"))
    wanted = F.broadcast(bought.sparkSession.createDataFrame([(r.share, r.m) for r in cuts], "top_share double, m bigint"))
    taken = placed.join(wanted, F.col("first") < F.col("m")).withColumn("take", F.least(F.col("n"), F.col("m") - F.col("first")))
    total = cuts[0]["all"]
    return taken.groupBy("top_share").agg(F.sum(F.col("spend") * F.col("take")).cast("double").alias("s")).select("top_share", half_even(F.col("s") / total, 4).alias("spend_share"))
