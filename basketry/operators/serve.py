"""Recommendation lists with their fallback chain, response status and safe exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import formula_safe, json_codes
from basketry.operators.itemcf import top_candidates, without_owned
from basketry.operators.popularity import top_ranked
from basketry.params import DEFAULT, Params
from basketry.sources import small

# Method names by tier.
TIERS = ("item_cf", "segment_popularity", "global_popularity")
# The fields of a recommended item.
ITEM = ("rank", "stock_code", "description", "score", "method", "reason_code", "reason", "supporting_codes", "is_fallback")
# Reason codes and what they say.
REASONS = (
    ("similar_to_purchase_history", "Frequently bought together with "),
    ("similar_to_purchase_history", "Based on products in your purchase history"),
    ("popular_in_segment", "Popular among shoppers in your segment "),
    ("popular_overall", "One of the most popular products among all shoppers"),
)


def fallback_lists(cf: DataFrame, customers: DataFrame, segment: DataFrame, world: DataFrame, owned: DataFrame | None, k: int, new_only: bool = False) -> DataFrame:
    """(customer_id, rank, stock_code, score, method): similar items, then the segment's, then everyone's.

    cf: (customer_id, stock_code, score), owned items already out of it for new_only.
    customers: (customer_id, segment_id). segment, world: popularity scores. owned: read for new_only alone.
    Only customers short of k similar items look at the fallbacks, and a fallback list
    need only be as long as k and what the customer may have to skip: a customer stays one
    row with its codes in arrays until the k of its list are known.
    """
    best = top_candidates(cf, k)
    have = best.groupBy("customer_id").agg(F.array_sort(F.collect_list(F.struct("rank", "stock_code", F.col("score").cast("double").alias("score")))).alias("have"))
    each = customers.select("customer_id", "segment_id", F.lit(True).alias("known")).join(have, "customer_id", "full")
    nothing = F.array().cast("array<string>")
    if new_only:
        skips = owned.groupBy("customer_id").agg(F.collect_set("stock_code").alias("skip"))
        each = each.join(skips, "customer_id", "left").withColumn("skip", F.coalesce("skip", nothing))
        longest = 2 * k + (owned.groupBy("customer_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)  # by the histories alone, before any list is made
    else:
        each, longest = each.withColumn("skip", nothing), 2 * k
    seg = top_ranked(segment, longest, ("segment_id",)).select("segment_id", "stock_code", "score", "rank")
    all_ = top_ranked(world, longest).select("stock_code", "score", "rank")
    inside = F.array_sort(F.collect_list(F.struct("rank", "stock_code")))["stock_code"]
    # One row a segment and one row: the popular codes in order, no longer than the catalog, beside each customer.
    each = each.join(F.broadcast(seg.groupBy("segment_id").agg(inside.alias("in_segment"))), "segment_id", "left").join(F.broadcast(all_.agg(inside.alias("in_all"))))
    reach, similar = F.lit(2 * k) + F.size("skip"), F.coalesce(F.col("have")["stock_code"], nothing)
    short = F.col("known") & (F.size(similar) < k)
    popular = lambda codes: F.when(short, F.slice(F.coalesce(codes, nothing), F.lit(1), reach)).otherwise(nothing)
    each = each.withColumn("similar", similar).withColumn("second", F.array_except(popular(F.col("in_segment")), F.concat("similar", "skip")))
    each = each.withColumn("third", F.array_except(popular(F.col("in_all")), F.concat("similar", "skip", "second")))
    tier = lambda codes, t: F.transform(codes, lambda x: F.struct(F.lit(t).alias("tier"), x.alias("stock_code")))
    chain = F.slice(F.concat(tier("similar", 0), tier("second", 1), tier("third", 2)), 1, k)
    rows = each.select("customer_id", "segment_id", "have", F.posexplode(chain).alias("at", "x")).select("customer_id", "segment_id", "x.stock_code", "x.tier", (F.col("at") + 1).cast("bigint").alias("rank"), F.when(F.col("x.tier") == 0, F.get("have", F.col("at"))["score"]).alias("own"))
    of_segment = small(seg.select("segment_id", "stock_code", F.lit(1).alias("tier"), F.col("score").alias("of_segment")))
    of_all = small(all_.select("stock_code", F.lit(2).alias("tier"), F.col("score").alias("of_all")))
    rows = rows.join(of_segment, ["segment_id", "stock_code", "tier"], "left").join(of_all, ["stock_code", "tier"], "left")
    score = F.coalesce("own", F.col("of_segment").cast("double"), F.col("of_all").cast("double"))
    return rows.select("customer_id", "rank", "stock_code", score.alias("score"), F.element_at(F.array(*map(F.lit, TIERS)), (F.col("tier") + 1).cast("int")).alias("method"))


def global_lists(customers: DataFrame, world: DataFrame, k: int) -> DataFrame:
    """The global list for customers without any history; k rows each."""
    top = top_ranked(world, k)  # k rows
    return customers.select("customer_id").join(F.broadcast(top)).select("customer_id", "rank", "stock_code", F.col("score").cast("double").alias("score"), F.lit(TIERS[2]).alias("method"))


def response_status(lists: DataFrame, customers: DataFrame, n_items: DataFrame, k: int) -> DataFrame:
    """(customer_id, returned_k, status): empty_catalog, insufficient_catalog, fallback_only or ok, the first that fits."""
    per = lists.groupBy("customer_id").agg(F.count("*").alias("returned_k"), F.max(F.col("method") == TIERS[0]).alias("personal"))
    joined = customers.select("customer_id").join(per, "customer_id", "left").join(F.broadcast(n_items))
    n = F.coalesce("returned_k", F.lit(0))
    status = F.when(F.col("n_items") == 0, "empty_catalog").when(n < k, "insufficient_catalog").when(~F.coalesce("personal", F.lit(False)), "fallback_only").otherwise("ok")
    return joined.select("customer_id", n.alias("returned_k"), status.alias("status"))


def explained(lists: DataFrame, backers: DataFrame, names: DataFrame, segments: DataFrame) -> DataFrame:
    """The lists with descriptions, reasons and the supporting codes of similar items, whose descriptions the reason tells.

    names: (stock_code, description); segments: (customer_id, segment_id).
    """
    similar = lists.where(F.col("method") == TIERS[0]).select("customer_id", "stock_code").join(backers, ["customer_id", "stock_code"])
    each = similar.select("customer_id", "stock_code", "supporters", F.posexplode("supporters").alias("place", "seed"))
    spoken = each.join(names.select(F.col("stock_code").alias("seed"), F.col("description").alias("spoken")), "seed", "left")
    spoken = spoken.groupBy("customer_id", "stock_code").agg(F.first("supporters").alias("supporters"), F.array_sort(F.collect_list(F.struct("place", F.coalesce("spoken", "seed").alias("name")))).alias("told"))
    named = lists.join(spoken, ["customer_id", "stock_code"], "left").join(names, "stock_code", "left").join(segments.select("customer_id", "segment_id"), "customer_id", "left")
    is_similar, in_segment = F.col("method") == TIERS[0], F.col("method") == TIERS[1]
    by_history = F.when(F.size("told") > 0, F.concat(F.lit(REASONS[0][1]), F.array_join(F.transform("told", lambda x: x["name"]), ", "))).otherwise(REASONS[1][1])
    text = F.when(is_similar, by_history).when(in_segment, F.concat(F.lit(REASONS[2][1]), F.lit("("), "segment_id", F.lit(")"))).otherwise(REASONS[3][1])
    return named.select(
        "customer_id", "rank", "stock_code", F.coalesce("description", "stock_code").alias("description"), "score", "method",
        F.when(is_similar, REASONS[0][0]).when(in_segment, REASONS[2][0]).otherwise(REASONS[3][0]).alias("reason_code"), text.alias("reason"),
        json_codes(F.when(is_similar, F.col("supporters"))).alias("supporting_codes"), (~is_similar).alias("is_fallback"),
    )


def csv_rows(named: DataFrame) -> DataFrame:
    """Export rows whose texts no spreadsheet takes for formulas."""
    return named.select("customer_id", "rank", formula_safe(F.col("stock_code")).alias("stock_code"), formula_safe(F.col("description")).alias("description"), "method", "reason_code", formula_safe(F.col("reason")).alias("reason"), "supporting_codes")


def cf_scores_for(pairs: DataFrame, scored: DataFrame, new_only: bool) -> DataFrame:
    return without_owned(scored, pairs) if new_only else scored


def request(customer_id: str, top_k: int = DEFAULT.k, mode: str = "repeat_allowed") -> tuple[str, int, str]:
    """The checked request: trimmed id without path characters, k from 1 to 20, a known mode."""
    cid = customer_id.strip() if isinstance(customer_id, str) else ""
    if not cid or len(cid) > 64 or any(x in cid for x in ("/", "\\", "..")):
        raise ValueError("customer_id")
    if isinstance(top_k, bool) or not isinstance(top_k, int) or not 1 <= top_k <= 20:
        raise ValueError("top_k")
    if mode not in ("repeat_allowed", "new_items_only"):
        raise ValueError("mode")
    return cid, top_k, mode


def answers(requests: DataFrame, profiles: DataFrame, named: DataFrame, world: DataFrame, names: DataFrame) -> DataFrame:
    """One row a request (customer_id, top_k): who asks, the status, and the items up to top_k.

    profiles: (customer_id, status, segment_id, segment_label); named: `explained` lists of
    known customers, as long as the longest request; an unknown customer gets the global list.
    """
    asked = requests.join(profiles.select("customer_id", F.col("status").alias("customer_status"), "segment_id", "segment_label"), "customer_id", "left").withColumn("customer_status", F.coalesce("customer_status", F.lit("unknown_customer")))
    columns = list(ITEM)
    strangers = asked.where("customer_status = 'unknown_customer'").select("customer_id")
    top = top_ranked(world, 20).join(names, "stock_code", "left")  # the longest list that may be asked for
    theirs = strangers.join(F.broadcast(top)).select(
        "customer_id", "rank", "stock_code", F.coalesce("description", "stock_code").alias("description"), F.col("score").cast("double").alias("score"), F.lit(TIERS[2]).alias("method"),
        F.lit(REASONS[3][0]).alias("reason_code"), F.lit(REASONS[3][1]).alias("reason"), F.lit("[]").alias("supporting_codes"), F.lit(True).alias("is_fallback"),
    )
    items = named.select("customer_id", *columns).unionByName(theirs)
    rows = asked.join(items, "customer_id", "left").withColumn("rank", F.when(F.col("rank") <= F.col("top_k"), F.col("rank")))
    per = rows.groupBy(*asked.columns).agg(F.array_sort(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct(*columns)))).alias("items"))
    n, fell = F.size("items"), F.size(F.filter("items", lambda x: x["is_fallback"]))
    status = F.when(n == 0, "empty_catalog").when(n < F.col("top_k"), "insufficient_catalog").when(fell == n, "fallback_only").otherwise("ok")
    return per.select("customer_id", "customer_status", "segment_id", "segment_label", "top_k", n.alias("returned_k"), status.alias("status"), fell.alias("fallback_count"), "items")


__all__ = ["REASONS", "TIERS", "Params", "answers", "cf_scores_for", "csv_rows", "explained", "fallback_lists", "global_lists", "request", "response_status"]
