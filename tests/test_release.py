"""Releases, runs, response times, readers and the command line."""

import csv
import hashlib
import json
from dataclasses import replace
from pathlib import Path

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from basketry import __main__ as command
from basketry import release, sources
from basketry.operators import evaluate, selection
from basketry.params import DEFAULT

SF = Path("/root/testdata/sf0.001")


LISTS = "customer_id string, rank bigint, stock_code string, description string, score double, method string, reason_code string, reason string, supporting_codes string, is_fallback boolean, mode string"


@pytest.fixture(scope="module")
def tables(spark):
    profiles = spark.createDataFrame([("A", "known_active", "SG01", "x"), ("B", "known_inactive", "SG_INACTIVE", "y")], "customer_id string, status string, segment_id string, segment_label string")
    lists = spark.createDataFrame([("A", 1, "10001", "cup", 0.5, "item_cf", "c", "r", "[]", False, "repeat_allowed"), ("A", 1, "10002", "pot", 0.4, "item_cf", "c", "r", "[]", False, "new_items_only")], LISTS)
    segments = spark.createDataFrame([("SG01", "=x", 1, "+try")], "segment_id string, segment_label string, customer_count bigint, campaign_hypothesis string")
    return {"profiles": profiles, "lists": lists, "world": spark.createDataFrame([("10001", 3)], "stock_code string, score bigint"), "names": spark.createDataFrame([("10001", "cup")], "stock_code string, description string"), "segments": segments}


def test_release_round_trip(spark, tables, tmp_path, capsys):
    path = str(tmp_path / "release")
    release.write_release(tables, path, "v1", "2001-01-01")
    found = release.read_release(spark, path)
    assert {r.table: r.n_rows for r in found["manifest"].collect()} == {"profiles": 2, "lists": 2, "world": 1, "names": 1, "segments": 1}
    assert release.answer(found, " A ", 1, "new_items_only").first()["items"][0].stock_code == "10002"
    assert release.answer(found, "Z", 1, "repeat_allowed").first().customer_status == "unknown_customer"
    command.main(["recommend", "--release", path, "--customer-id", "A", "--top-k", "1"], spark)
    told = json.loads(capsys.readouterr().out)
    assert (told["status"], told["snapshot_cutoff"], told["recommendation_mode"], told["model_version"], told["requested_k"]) == ("ok", "2001-01-01", "repeat_allowed", "v1", 1)
    command.main(["benchmark", "--release", path, "--output", str(tmp_path / "times"), "--warm-up", "1", "--calls", "3"], spark)
    assert json.loads(capsys.readouterr().out)["calls"] == 3
    changed = tables["names"].withColumn("description", F.lit("jug"))
    changed.write.mode("overwrite").parquet(f"{path}/names")
    with pytest.raises(ValueError, match="content"):
        release.read_release(spark, path)
    tables["names"].write.mode("overwrite").parquet(f"{path}/names")
    tables["world"].unionAll(tables["world"]).write.mode("overwrite").parquet(f"{path}/world")
    with pytest.raises(ValueError, match="rows"):
        release.read_release(spark, path)
    tables["world"].drop("score").write.mode("overwrite").parquet(f"{path}/world")
    with pytest.raises(ValueError, match="columns"):
        release.read_release(spark, path)
    with pytest.raises(ValueError, match="missing"):
        release.write_release({"profiles": tables["profiles"]}, path, "v", "c")


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A release of 900 customers in several buckets and row groups."""
    ids = [f"{i}" for i in range(900)]
    profiles = [(c, "known_active" if i % 3 else "known_inactive", f"SG0{i % 4 + 1}", "=label") for i, c in enumerate(ids)]
    methods = ("item_cf", "segment_popularity", "global_popularity")
    lists = [(c, r, f"1{r:04d}", "-pot, \"big\"", 1.0 / r, methods[(i + r) % 3], "code", f"reason {i}", '["a"]', (i + r) % 3 > 0, mode) for i, c in enumerate(ids) for mode in release.MODES for r in range(1, i % 7 + 1)]
    tables = {
        "profiles": spark.createDataFrame(profiles, "customer_id string, status string, segment_id string, segment_label string").repartition(3), "lists": spark.createDataFrame(lists, LISTS).repartition(5),
        "world": spark.createDataFrame([(f"1{i:04d}", 100 - i) for i in range(30)], "stock_code string, score bigint"), "names": spark.createDataFrame([(f"1{i:04d}", f"thing {i}") for i in range(0, 30, 2)], "stock_code string, description string"),
        "segments": spark.createDataFrame([(f"SG0{i}", "=x", i, "+try") for i in range(4, 0, -1)], "segment_id string, segment_label string, customer_count bigint, campaign_hypothesis string"),
    }
    path = str(tmp_path_factory.mktemp("wide") / "release")
    release.write_release(tables, path, "v2", "2001-01-01", bucket_customers=200)
    return path


def test_keyed_answers_equal_those_of_spark(spark, wide, monkeypatch):
    monkeypatch.setattr(release, "HELD_BUCKETS", 2)
    keyed, found = release.Keyed(wide), release.read_release(spark, wide)
    assert keyed.about["buckets"] == 5
    for cid, k, mode in [("0", 3, "repeat_allowed"), ("1", 1, "new_items_only"), (" 6 ", 20, "repeat_allowed"), ("899", 2, "new_items_only"), ("5", 3, "repeat_allowed"), ("nobody", 20, "repeat_allowed")]:
        assert keyed.answer(cid, k, mode) == release.answer(found, cid, k, mode).first().asDict(recursive=True)
    assert len(keyed.held) <= 2
    for bad in (("", 1), ("a/b", 1), ("1", 21)):
        with pytest.raises(ValueError):
            keyed.answer(*bad)


def test_single_requests_meet_the_target(spark, wide, tmp_path, capsys):
    command.main(["benchmark", "--release", f"file://{wide}", "--output", str(tmp_path / "times")], spark)
    told = json.loads(capsys.readouterr().out)
    assert told["calls"] == 200 and told["p95_ms"] <= 200 and told["target_met"]


def test_csv_files_are_safe_and_sorted_across_files(spark, wide, tmp_path):
    path = str(tmp_path / "csv")
    command.main(["export", "--release", wide, "--output", path, "--top-k", "4"], spark)
    lines = []
    for part in sorted((tmp_path / "csv" / "recommendations").glob("part-*.csv")):
        with open(part, newline="") as f:
            lines += list(csv.DictReader(f))
    keys = [(r["customer_id"], r["recommendation_mode"], int(r["rank"])) for r in lines]
    assert keys == sorted(keys) and len(keys) == 2 * sum(min(4, i % 7) for i in range(900))
    assert {r["description"] for r in lines} == {"'-pot, \"big\""} and {r["model_version"] for r in lines} == {"v2"} and {r["supporting_codes"] for r in lines} == {'["a"]'}
    one = [r for r in lines if r["customer_id"] == "6" and r["recommendation_mode"] == "repeat_allowed"]
    assert {r["fallback_count"] for r in one} == {str(sum(r["is_fallback"] == "true" for r in one))}
    (part,) = (tmp_path / "csv" / "segments").glob("part-*.csv")
    assert [(r["segment_id"], r["segment_label"], r["campaign_hypothesis"]) for r in csv.DictReader(part.open())] == [(f"SG0{i}", "'=x", "'+try") for i in range(1, 5)]


def test_sorted_sink_over_many_files(spark, tmp_path, monkeypatch):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3000).alias("a"), F.lit("x").alias("b")).repartition(5)
    sources.write_sorted(df, str(tmp_path / "t"), "a")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "t").glob("part-*.parquet"))
    assert len(parts) > 1 and [v for p in parts for v in pq.read_table(p).column("a").to_pylist()] == list(range(3000))


def test_digest_knows_no_order_but_every_cell(spark):
    data = [("a", 1, 0.5, None), ("a", 1, 0.5, None), (None, 2, 1e300, "x"), ("ab", 3, -0.25, "")]
    schema = "s string, i int, d double, t string"
    of = lambda rows, n=1, **k: tuple(selection.table_digest(spark.createDataFrame(rows, schema).repartition(n), **k).first())
    one = of(data)
    assert one == of(data[::-1], 3) and one[0] == 4
    assert len({one, of(data[1:]), of([*data[:3], ("ab", 3, -0.25, None)]), of([*data[:3], ("a", 3, -0.25, "b")]), of([*data[:3], ("ab", 4, -0.25, "")]), of([*data[:3], ("ab", 3, -0.2500001, "")])}) == 6
    assert of(data, decimals=6) == of([*data[:3], ("ab", 3, -0.2500000001, "")], decimals=6) and of([])[0] == 0


def test_a_changed_cell_or_parameter_is_refused(spark, tmp_path):
    raw = spark.createDataFrame([("1", 2.0), ("2", 3.0)], "InvoiceNo string, Quantity double")
    judged = spark.createDataFrame([("GlobalPopularity", "ItemItemCF_N50", 0.5, 0.3, 0.2, 0.4, 0.1, 0.01, True, "ItemItemCF_N50")], "baseline string, candidate string, relative_gain double, ndcg double, base_ndcg double, recall double, base_recall double, d_low double, qualifies boolean, selected string")
    path = str(tmp_path / "selection")
    with pytest.raises(RuntimeError, match="nothing"):
        selection.frozen(spark, path, raw)
    choice = spark.createDataFrame([("KMeans", "none", 3)], "family string, covariance string, k int")
    selection.freeze(selection.manifest(raw, judged, "2000-12-04"), choice, path)
    row = selection.frozen(spark, path, raw.orderBy(F.desc("InvoiceNo")))
    assert (row.recommender, row.family, row.k, row.validation_ndcg, row.n_lines) == ("ItemItemCF_N50", "KMeans", 3, 0.3, 2)
    with pytest.raises(ValueError, match="lines"):
        selection.frozen(spark, path, raw.withColumn("Quantity", F.when(F.col("InvoiceNo") == "2", 3.5).otherwise(F.col("Quantity"))))
    with pytest.raises(ValueError, match="parameters"):
        selection.frozen(spark, path, raw, replace(DEFAULT, neighbours=51))
    with pytest.raises(Exception, match="exist"):
        selection.freeze(selection.manifest(raw, judged, "2000-12-04"), choice, path)


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_freeze_refit_and_monitor(spark, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    command.main(["prepare", "--data", str(SF), "--output", at("bought"), "--report", at("report")], spark)
    parts = sorted((tmp_path / "bought").glob("part-*.parquet"))
    keys = [tuple(r.values()) for p in parts for r in pq.read_table(p, columns=["ts", "invoice_no", "stock_code"]).to_pylist()]
    assert keys == sorted(keys) and spark.read.json(at("report")).where("rule = 'kept'").first().n_rows == len(keys)
    command.main(["freeze", "--data", str(SF), "--output", at("selection"), "--rules"], spark)
    assert json.loads(capsys.readouterr().out)["family"] == "RFMRules"
    for stage in ("validation", "test"):
        command.main(["train", "--data", str(SF), "--output", at(stage), "--stage", stage, "--selection", at("selection"), "--runs", at("runs"), "--snapshots", at("snapshots")], spark)
    assert spark.read.parquet(at("runs")).select("run_id").distinct().count() == 2
    found = release.read_release(spark, at("test"))
    cid = found["profiles"].orderBy("customer_id").first().customer_id
    assert release.Keyed(at("test")).answer(cid, 5) == release.answer(found, cid, 5, release.MODES[0]).first().asDict(recursive=True)
    command.main(["monitor", "--snapshots", at("snapshots"), "--reference", "2000-12-04", "--current", "2001-01-01", "--output", at("alerts")], spark)
    assert spark.read.json(at("alerts")).first().n_alerts >= 0
    with pytest.raises(ValueError, match="isn't before"):
        command.main(["monitor", "--snapshots", at("snapshots"), "--reference", "2001-01-01", "--current", "2000-12-04", "--output", at("alerts")], spark)


def test_runs_add_up(spark, tmp_path):
    path = str(tmp_path / "runs")
    ids = [release.log_run(spark, path, "test", {"k": 10}, {"ndcg": 0.1 * i}) for i in range(2)]
    rows = spark.read.parquet(path).collect()
    assert {r.run_id for r in rows} == set(ids) and len(rows) == 4 and {r.kind for r in rows} == {"param", "metric"}


def test_time_summary(spark):
    times = spark.createDataFrame([(i, "a", float(i)) for i in range(1, 101)], "call int, customer_id string, ms double")
    r = release.time_summary(times).first()
    assert (r.calls, r.median_ms, r.p95_ms, r.p99_ms, r.max_ms, r.min_ms, r.mean_ms, r.target_met) == (100, 50.5, 95.05, 99.01, 100.0, 1.0, 50.5, True)
    assert not release.time_summary(times, 50.0).first().target_met


def test_strongest_takes_the_first_of_equals(spark):
    means = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", 0.1)], "model string, mean_ndcg double")
    assert evaluate.strongest(means, ("b", "a", "c")).first().model == "b"


def test_readers(spark, tmp_path):
    head = ",".join(sources.RAW_COLUMNS)
    (tmp_path / "lines.csv").write_text(f"{head}\n1,10001,cup,many,2011-01-01,1.5,17850.0,UK\n")
    row = sources.read_invoice_csv(spark, str(tmp_path / "lines.csv")).first()
    assert row.Quantity == "many" and row.CustomerID == "17850.0"
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="InvoiceNo"):
        sources.read_invoice_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "r.json").write_text('{"n": 3,\n "m": "x"}')
    assert tuple(sources.read_report(spark, str(tmp_path / "r.json")).select("n", "m").first()) == (3, "x")
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert sources.file_digests(spark, str(tmp_path / "f.bin")).first().sha256 == hashlib.sha256(b"abc").hexdigest().upper()


def test_unknown_commands_and_queries(spark):
    with pytest.raises(SystemExit):
        command.main(["fly"], spark)
    with pytest.raises(SystemExit, match="unknown query"):
        command.main(["query", "--data", "x", "--name", "nothing"], spark)
