"""URL filters: rules on host and path, and trust and distrust that flow over the link graph of hosts.

A rule (host, path) fits its host and all subdomains where the url's path starts with
the rule's; the longest rule wins. Pages without a rule follow their host: hosts whose
pages rules allow seed trust, which a personalised PageRank carries along links; hosts
whose pages rules block seed distrust, which flows against the links (who links to
blocked hosts is suspect). Edges are the links between different hosts in the pages'
html and those between a host and its parent domain. A host is blocked if it has more
distrust than trust, and more distrust than `share` times its part of all pages.

A walk goes on until all that could still arrive is less than `least` of it. Mass on
hosts without edges returns to the seeds, which only scales the ranks: what each step
moves is added up, and the sums are divided by their total at the end.

Defined cases: null urls and urls without :// have an empty host and path, fit no rule,
and their host gives and takes no link; null html has no links; repeated rows give
repeated results; without pages nothing is judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import stored

# The stated rules as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
DAMPING = 0.85
#: The part of a walk's mass that may be missing when it ends.
LEAST = 1e-3
#: Steps between two tables in the shared folder.
STEPS = 4
#: Edges that a task of a step takes on average; a graph with no more, and no more seeds, is walked in one task.
TASK_EDGES = 500_000
SHARE = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?[a-z][a-z0-9+.-]*://([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, null if none does; rules is a short list."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) between different hosts: links counted once a page, and a host's tie with its parent domain."""
    links = pages.select("host", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)), lambda h: F.translate(h, _UPPER, _LOWER)))).alias("dst"))
    linked = links.groupBy(F.col("host").alias("src"), "dst").agg(F.count("*").cast("double").alias("weight"))
    parent = F.regexp_extract("host", r"^[^.]+\.([^.]+\..+)$", 1)
    ties = pages.select("host", parent.alias("up")).where("up <> ''").distinct()
    both = ties.select(F.col("host").alias("src"), F.col("up").alias("dst")).unionAll(ties.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    edges = linked.unionAll(both.withColumn("weight", F.lit(1.0))).where("src <> '' AND dst <> '' AND src <> dst")
    return edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, least: float = LEAST, damping: float = DAMPING) -> DataFrame:
    """(kind, host, rank): personalised PageRank from seeds (kind, host, mass) over edges (kind, src, dst, weight).

    The masses of a kind add up to 1, as do its ranks.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    moves = stored(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("total") * damping).alias("part")), "edges")
    tasks = 1 + moves.count() // TASK_EDGES
    if tasks == 1 and seeds.count() <= TASK_EDGES:
        return _in_one_task(moves, seeds, least, damping)
    moves = stored(moves.coalesce(tasks), "moves")
    front = seeds.select("kind", "host", F.col("mass").alias("rank"))
    total = front
    while True:
        for _ in range(STEPS):
            moved = front.join(moves, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("part")).alias("rank"))
            front = moved.groupBy("kind", "host").agg(F.sum("rank").alias("rank")).coalesce(tasks)
            total = total.unionAll(front)
        # the sum so far and the last step in one table, so that each step is taken once
        both = total.groupBy("kind", "host").agg(F.sum("rank").alias("rank")).withColumn("last", F.lit(False)).unionAll(front.withColumn("last", F.lit(True)))
        both = stored(both.coalesce(tasks), "ranks")
        total, front = (both.where(F.col("last") == x).select("kind", "host", "rank") for x in (False, True))
        moving = front.groupBy("kind").agg(F.sum("rank").alias("m")).agg(F.max("m")).first()[0] or 0.0
        if moving * damping / (1 - damping) <= least:
            break
    sums = total.groupBy("kind").agg(F.sum("rank").alias("all"))  # two rows
    return total.join(F.broadcast(sums), "kind").select("kind", "host", (F.col("rank") / F.col("all")).alias("rank"))


def _in_one_task(moves: DataFrame, seeds: DataFrame, least: float, damping: float) -> DataFrame:
    """The same walks where all edges fit the share of one task: its steps need no exchange, so they are one job and not a plan each."""
    hosts = moves.select("host").unionAll(moves.select("dst")).unionAll(seeds.select("host")).distinct()
    hosts = stored(hosts.coalesce(1).select("host", F.monotonically_increasing_id().alias("id")), "numbers")  # one partition, so from 0 on
    no = lambda kind: F.lit(None).cast(kind)
    number = lambda of, name: hosts.select(F.col("host").alias(of), F.col("id").alias(name))
    ways = moves.join(number("host", "a"), "host").join(number("dst", "b"), "dst").select("kind", "a", "b", F.col("part").alias("x"), no("string").alias("host"))
    starts = seeds.join(number("host", "a"), "host").select("kind", "a", no("bigint"), "mass", "host")
    names = hosts.select(no("int"), F.col("id"), no("bigint"), no("double"), "host")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        named = rows.filter(pc.is_null(rows["kind"])).sort_by("a")["host"].combine_chunks()
        n, size = len(named), 2 * len(named)  # both kinds beside each other

        def part(which: pa.ChunkedArray) -> tuple[np.ndarray, pa.Table]:
            t = rows.filter(pc.and_(pc.is_valid(rows["kind"]), which))
            return t["kind"].to_numpy().astype(np.int64) * n, t

        shift, seed = part(pc.is_null(rows["b"]))
        front = np.bincount(shift + seed["a"].to_numpy(), seed["x"].to_numpy(), size) if seed.num_rows else np.zeros(size)
        shift, edge = part(pc.is_valid(rows["b"]))
        src, dst, x = (shift + edge["a"].to_numpy(), shift + edge["b"].to_numpy(), edge["x"].to_numpy()) if edge.num_rows else (shift, shift, np.zeros(0))
        total = front.copy()
        while True:
            for _ in range(STEPS):
                front = np.bincount(dst, front[src] * x, size)
                total += front
            if front.reshape(2, -1).sum(axis=1).max() * damping / (1 - damping) <= least:
                break
        for kind, sums in enumerate(total.reshape(2, -1)):
            held = np.flatnonzero(sums)
            rank = sums[held] / sums.sum() if len(held) else sums[held]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), kind, np.int32)), named.take(pa.array(held)), pa.array(rank)], names=["kind", "host", "rank"])

    return ways.unionAll(starts).unionAll(names).coalesce(1).mapInArrow(walk, "kind int, host string, rank double")


def judge(pages: DataFrame, rules=RULES, least: float = LEAST, share: float = SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row."""
    known = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html").withColumn("r", fitting_rule(F.col("host"), F.col("path"), rules))
    counts = stored(
        known.where("host <> ''").groupBy("host").agg(
            F.count("*").alias("pages"), F.count_if(F.col("r.verdict") == "allow").alias("allowed"), F.count_if(F.col("r.verdict") == "block").alias("blocked")
        ),
        "hosts",
    )
    all_pages, allowed, blocked = (x or 0 for x in counts.agg(F.sum("pages"), F.sum("allowed"), F.sum("blocked")).first())
    seeds = counts.select(F.lit(0).alias("kind"), "host", (F.col("allowed") / max(allowed, 1)).alias("mass")).unionAll(
        counts.select(F.lit(1).alias("kind"), "host", (F.col("blocked") / max(blocked, 1)).alias("mass"))
    ).where("mass > 0")
    edges = host_edges(known)
    ways = edges.select(F.lit(0).alias("kind"), "src", "dst", "weight").unionAll(edges.select(F.lit(1).alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    ranks = propagate(ways, stored(seeds, "seeds"), least)
    by_host = ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("rank"))).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("rank"))).alias("distrust"))
    bad = (
        counts.join(by_host, "host")
        .where((F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))) & (F.col("distrust") > share * F.col("pages") / max(all_pages, 1)))
        .select("host", F.lit("block").alias("host_verdict"))
    )
    verdict = F.coalesce("r.verdict", "host_verdict", F.lit("allow"))
    return known.drop("html").join(bad, "host", "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"))
