"""Command line: python -m basketry COMMAND ...; see --help."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry import release
from basketry.operators import clean, cluster, fits, models, monitor, selection
from basketry.params import CUTOFFS, DEFAULT
from basketry.plans import registry
from basketry.sources import stored, write_sorted


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="basketry")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, text: str, *options: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=text)
        for o in options:
            p.add_argument(o, required=True)
        return p

    prepare = add("prepare", "clean the raw lines (a folder of tables, a .csv or a .xlsx file) and write the purchases in order of time", "--data", "--output")
    prepare.add_argument("--report", help="JSON folder for lines removed by rule")
    freeze = add("freeze", "choose models at the validation cut-off and tie the choice to data and parameters", "--data", "--output")
    freeze.add_argument("--rules", action="store_true", help="keep the rule segments, without a search of models")
    train = add("train", "write a release for a cut-off", "--data", "--output")
    train.add_argument("--stage", choices=sorted(CUTOFFS), default="test")
    train.add_argument("--selection", help="frozen choice to refit; refused where data or parameters have changed")
    train.add_argument("--runs", help="table of runs to append to")
    train.add_argument("--snapshots", help="table of snapshots to append to")
    evaluate = add("evaluate", "compare the models after a cut-off", "--data")
    evaluate.add_argument("--stage", choices=sorted(CUTOFFS), default="test")
    evaluate.add_argument("--output", help="JSON folder")
    ask = add("recommend", "answer a request from a release", "--release", "--customer-id")
    ask.add_argument("--mode", choices=release.MODES, default=release.MODES[0])
    ask.add_argument("--top-k", type=int, default=DEFAULT.k)
    add("monitor", "alerts between two snapshots of a table, the earlier one as the reference", "--snapshots", "--reference", "--current", "--output")
    export = add("export", "write lists and segments of a release as CSV", "--release", "--output")
    export.add_argument("--top-k", type=int, default=DEFAULT.k)
    timing = add("benchmark", "time single requests", "--release", "--output")
    timing.add_argument("--warm-up", type=int, default=10)
    timing.add_argument("--calls", type=int, default=200)
    timing.add_argument("--top-k", type=int, default=DEFAULT.k)
    query = add("query", "run a registered query", "--data", "--name")
    query.add_argument("--output", help="Parquet folder; shown without")
    return top


def release_tables(d: registry.Data, version: str, recommender: str = registry.CF_MODELS[0], longest: int = release.MOST_ASKED) -> dict[str, DataFrame]:
    """The release's tables at a cut-off, with the lists of the recommender and the segments that d has."""
    parts = []
    bound = int(recommender.rpartition("_N")[2]) if recommender in registry.CF_MODELS else 0
    for mode in release.MODES:
        parts.append(d.explained(mode == release.MODES[1], longest, bound).withColumn("mode", F.lit(mode)))
    profiles = d.assigned.select("customer_id", "recency_days", "frequency_invoices", "monetary_gbp", "status", "segment_id", "segment_label")
    return {"profiles": profiles, "lists": parts[0].unionAll(parts[1]), "world": d.world, "names": d.names, "segments": models.summary(d.assigned, d.cutoff, version)}


def train(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write a release; with a frozen choice its models are fitted again on the stage's customers."""
    d, recommender, choice = registry.Data(spark, args.data, args.stage), registry.CF_MODELS[0], models.RULES
    if args.selection:
        row = selection.frozen(spark, args.selection, d.raw)
        recommender, choice = row.recommender, (row.family, row.covariance, row.k)
        d.assigned = stored(models.assign(d.known, models.read(stored(models.fit(d.known, *choice), "model"))), "assigned")
    version = f"{args.stage}-{d.cutoff}"
    manifest = release.write_release(release_tables(d, version, recommender), args.output, version, d.cutoff, recommender)
    shown(manifest.select("table", "n_rows", "digest", "version"))
    if args.runs:
        chosen = dict(zip(selection.CHOICE, choice, strict=True)) | {"cutoff": d.cutoff, "k": DEFAULT.k, "recommender": recommender}
        release.log_run(spark, args.runs, args.stage, chosen, {r.table: r.n_rows for r in manifest.collect()})
    if args.snapshots:
        share = monitor.fallback_share(d.lists_of(recommender))
        monitor.append_snapshot(monitor.snapshot_rows(d.cutoff, d.known, d.assigned, d.items, share), args.snapshots)


def shown(df: DataFrame) -> None:
    for row in df.toJSON().collect():  # a report of a few rows
        print(row)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "prepare":
        d = registry.Data(spark, args.data)
        write_sorted(d.bought, args.output, "ts", "invoice_no", "stock_code")
        if args.report:
            clean.audit(d.lines).coalesce(1).write.mode("overwrite").json(args.report)
    elif args.command == "freeze":
        d = registry.lean(spark, args.data, "validation")
        choice = [models.RULES] if args.rules else cluster.selection(fits.candidates(cluster.transformed(d.points))).collect()  # one row
        selection.freeze(selection.manifest(d.raw, registry.gate(d), d.cutoff), spark.createDataFrame(choice, "family string, covariance string, k int"), args.output)
        shown(spark.read.schema(selection.SCHEMA).json(args.output))
    elif args.command == "train":
        train(spark, args)
    elif args.command == "evaluate":
        found = registry.compared(registry.lean(spark, args.data, args.stage))
        if args.output:
            found.coalesce(1).write.mode("overwrite").json(args.output)
        shown(found)
    elif args.command == "recommend":
        print(json.dumps(release.Keyed(args.release).answer(args.customer_id, args.top_k, args.mode), ensure_ascii=False))
    elif args.command == "monitor":
        found = monitor.report(monitor.compared(monitor.read_snapshots(spark, args.snapshots), args.reference, args.current))
        found.coalesce(1).write.mode("overwrite").json(args.output)
    elif args.command == "export":
        release.export_csv(release.read_release(spark, args.release), args.output, args.top_k)
    elif args.command == "benchmark":
        keyed, profiles = release.Keyed(args.release), spark.read.parquet(f"{args.release}/profiles")
        times = release.response_times(spark, lambda cid: keyed.answer(cid, args.top_k), release.pool(profiles), args.warm_up, args.calls)
        result = release.time_summary(times)
        result.coalesce(1).write.mode("overwrite").json(args.output)
        shown(result)
    else:
        known = dict(registry.QUERIES)
        if args.name not in known:
            raise SystemExit(f"unknown query {args.name!r}; known: {json.dumps(sorted(known))}")
        df = known[args.name](spark, args.data)
        df.write.mode("overwrite").parquet(args.output) if args.output else df.show(truncate=False)


if __name__ == "__main__":
    main()
