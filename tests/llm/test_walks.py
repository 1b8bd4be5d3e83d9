"""Walks over the hosts: in one task and by steps through exchanges, with the same ranks."""

import random

from pyspark.sql import functions as F

from basketry.llm import url_filter


def graph(spark):
    rng = random.Random(3)
    ties = sorted({(kind, f"h{rng.randrange(60)}", f"h{rng.randrange(60)}", float(rng.randint(1, 4))) for kind in (0, 1) for _ in range(150)})
    edges = spark.createDataFrame([t for t in ties if t[1] != t[2]], "kind int, src string, dst string, weight double").groupBy("kind", "src", "dst").agg(F.sum("weight").alias("weight"))
    seeds = spark.createDataFrame([(0, "h1", 0.5), (0, "h2", 0.25), (0, "alone", 0.25), (1, "h3", 1.0)], "kind int, host string, mass double")
    return edges, seeds


def test_one_task_and_steps_give_the_same_ranks(spark, monkeypatch):
    edges, seeds = graph(spark)
    told = lambda: {(r.kind, r.host): r["rank"] for r in url_filter.propagate(edges, seeds, 1e-2).collect()}
    at_once = told()
    monkeypatch.setattr(url_filter, "TASK_EDGES", 40)
    by_steps = told()
    assert at_once.keys() == by_steps.keys() and (0, "alone") in at_once
    assert all(abs(at_once[k] - by_steps[k]) < 1e-12 for k in at_once)


def test_a_small_graph_is_one_job(spark):
    edges, seeds = graph(spark)
    plan = url_filter.propagate(edges, seeds, 1e-2)._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and plan.count("Aggregate") < 10
    assert not url_filter.propagate(edges.limit(0), seeds.limit(0)).count()
    assert {r.host: r["rank"] for r in url_filter.propagate(edges.limit(0), seeds).where("kind = 0").collect()} == {"h1": 0.5, "h2": 0.25, "alone": 0.25}
