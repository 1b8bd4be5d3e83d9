"""A release: the tables that answer requests, with a manifest that says what they must be; runs and response times.

Everything is a Parquet or JSON table that Spark writes and reads, so any store it knows
will do. Profiles and lists are dealt to files by a hash of the customer and sorted in
them; `Keyed` answers a single request from the row groups of one file, without a Spark
job, and `answer` the same by a Spark query.
"""

from __future__ import annotations

import json
import time
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.functions import formula_safe
from basketry.operators import serve
from basketry.operators.popularity import top_ranked
from basketry.operators.selection import table_digest
from basketry.sources import write_sorted

TABLES = ("profiles", "lists", "world", "names", "segments")
#: Tables dealt to files by customer, and the order in a file.
KEYED = {"profiles": ("customer_id",), "lists": ("customer_id", "mode", "rank")}
MODES = ("repeat_allowed", "new_items_only")
MOST_ASKED = 20
#: Customers for each bucket of files, and bytes of a row group.
BUCKET_CUSTOMERS, ROW_GROUP = 100_000, 1 << 18
#: Buckets whose index of row groups stays in memory.
HELD_BUCKETS = 512
MANIFEST = "table string, n_rows bigint, digest string, columns string, version string, cutoff string, buckets int, recommender string"
RUNS = "run_id string, stage string, kind string, name string, value string, logged_at timestamp"


def write_release(tables: dict[str, DataFrame], path: str, version: str, cutoff: str, recommender: str = "ItemItemCF_N50", bucket_customers: int = BUCKET_CUSTOMERS) -> DataFrame:
    """Write the tables and their manifest: a row a table with its rows, digest of content, columns, version and cut-off."""
    missing = [t for t in TABLES if t not in tables]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")
    spark, rows = tables[TABLES[0]].sparkSession, []
    buckets = max(1, -(-tables["profiles"].count() // bucket_customers))
    for name in TABLES:
        df = tables[name]
        if name in KEYED:
            dealt = df.withColumn("bucket", F.pmod(F.crc32("customer_id"), F.lit(buckets)).cast("int")).repartition(buckets, "bucket").sortWithinPartitions("bucket", *KEYED[name])
            dealt.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
        found = table_digest(spark.read.schema(df.schema).parquet(f"{path}/{name}").select(df.columns)).first()
        rows.append((name, found.n_rows, found.digest, json.dumps(df.schema.jsonValue()), version, cutoff, buckets, recommender))
    # The global list as requests by unknown customers see it, as long as the longest request.
    top = top_ranked(tables["world"], MOST_ASKED).join(tables["names"], "stock_code", "left").orderBy("rank")
    top.coalesce(1).write.mode("overwrite").parquet(f"{path}/top")
    manifest = spark.createDataFrame(rows, MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def read_release(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a release, and its manifest; ValueError where a table is missing or isn't what the manifest says."""
    manifest = {r.table: r for r in spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()}  # a row a table
    out = {}
    for name in TABLES:
        if name not in manifest:
            raise ValueError(f"the manifest has no table {name}")
        df = spark.read.parquet(f"{path}/{name}").drop(*(["bucket"] if name in KEYED else []))
        said = {f["name"]: f["type"] for f in json.loads(manifest[name].columns)["fields"]}
        if {f.name: f.jsonValue()["type"] for f in df.schema.fields} != said:
            raise ValueError(f"table {name} has other columns than its manifest")
        found = table_digest(df).first()
        if found.n_rows != manifest[name].n_rows:
            raise ValueError(f"table {name} has other rows than its manifest")
        if found.digest != manifest[name].digest:
            raise ValueError(f"table {name} has another content than its manifest")
        out[name] = df
    out["manifest"] = spark.createDataFrame(list(manifest.values()), MANIFEST)
    return out


def answer(release: dict[str, DataFrame], customer_id: str, top_k: int, mode: str) -> DataFrame:
    """One row: the answer to a checked request."""
    cid, k, mode = serve.request(customer_id, top_k, mode)
    asked = release["profiles"].sparkSession.createDataFrame([(cid, k)], "customer_id string, top_k int")
    own = F.col("customer_id") == cid
    lists = release["lists"].where(own & (F.col("mode") == mode)).drop("mode")
    told = serve.answers(asked, release["profiles"].where(own), lists, release["world"], release["names"])
    about = release["manifest"].limit(1).select(F.col("cutoff").alias("snapshot_cutoff"), F.lit(mode).alias("recommendation_mode"), F.col("version").alias("model_version"))
    return told.withColumnRenamed("top_k", "requested_k").join(about)  # single rows


class Keyed:
    """A release open for single requests. Of each bucket asked for, the bounds of its row groups are kept, of some at a time."""

    def __init__(self, path: str):
        self.files, self.path = pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pa.fs.LocalFileSystem(), path)
        rows = [json.loads(line) for f in self._parts("manifest", ".json") for line in self.files.open_input_stream(f).read().splitlines()]
        self.manifest = {r["table"]: r for r in rows}
        missing = [t for t in TABLES if t not in self.manifest]
        if missing:
            raise ValueError(f"the manifest has no table {', '.join(missing)}")
        self.about = rows[0]
        self.top = [r for f in self._parts("top", ".parquet") for r in pq.read_table(f, filesystem=self.files).to_pylist()]
        self.held: OrderedDict[tuple[str, int], list[tuple[pq.ParquetFile, list[tuple[str, str]]]]] = OrderedDict()

    def _parts(self, name: str, ending: str) -> list[str]:
        found = self.files.get_file_info(pa.fs.FileSelector(f"{self.path}/{name}", allow_not_found=True))
        return sorted(f.path for f in found if f.base_name.endswith(ending) and not f.base_name.startswith(("_", ".")))

    def _bucket(self, table: str, bucket: int) -> list[tuple[pq.ParquetFile, list[tuple[str, str]]]]:
        """The bucket's files with the first and last customer of each row group."""
        key = (table, bucket)
        if key not in self.held:
            out = []
            for path in self._parts(f"{table}/bucket={bucket}", ".parquet"):
                file = pq.ParquetFile(self.files.open_input_file(path))
                column = file.schema_arrow.names.index("customer_id")
                stats = [file.metadata.row_group(g).column(column).statistics for g in range(file.num_row_groups)]
                out.append((file, [(s.min, s.max) if s is not None and s.has_min_max else ("", chr(0x10FFFF)) for s in stats]))
            self.held[key] = out
            while len(self.held) > HELD_BUCKETS:
                for file, _ in self.held.popitem(last=False)[1]:
                    file.close()
        self.held.move_to_end(key)
        return self.held[key]

    def rows(self, table: str, customer_id: str) -> list[dict]:
        bucket, out = zlib.crc32(customer_id.encode()) % self.about["buckets"], []
        for file, bounds in self._bucket(table, bucket):
            groups = [g for g, (low, high) in enumerate(bounds) if low <= customer_id <= high]
            if groups:
                found = file.read_row_groups(groups)
                out += found.filter(pc.equal(found.column("customer_id"), customer_id)).to_pylist()
        return out

    def answer(self, customer_id: str, top_k: int = 10, mode: str = MODES[0]) -> dict:
        """The answer to a checked request, as `answer` gives it."""
        cid, k, mode = serve.request(customer_id, top_k, mode)
        known = self.rows("profiles", cid)
        if known:
            who = (known[0]["status"], known[0]["segment_id"], known[0]["segment_label"])
            items = sorted((r for r in self.rows("lists", cid) if r["mode"] == mode and r["rank"] <= k), key=lambda r: r["rank"])
            items = [{c: r[c] for c in serve.ITEM} for r in items]
        else:
            who, (code, text) = ("unknown_customer", None, None), serve.REASONS[3]
            items = [
                dict(zip(serve.ITEM, (r["rank"], r["stock_code"], r["description"] or r["stock_code"], float(r["score"]), serve.TIERS[2], code, text, "[]", True), strict=True))
                for r in self.top[:k]
            ]
        n, fell = len(items), sum(x["is_fallback"] for x in items)
        status = "empty_catalog" if not n else "insufficient_catalog" if n < k else "fallback_only" if fell == n else "ok"
        return {
            "customer_id": cid, "customer_status": who[0], "segment_id": who[1], "segment_label": who[2], "requested_k": k, "returned_k": n, "status": status, "fallback_count": fell, "items": items,
            "snapshot_cutoff": self.about["cutoff"], "recommendation_mode": mode, "model_version": self.about["version"],
        }


def export_csv(release: dict[str, DataFrame], path: str, top_k: int = 10) -> None:
    """Lists of known customers and the segment table as CSV whose texts no spreadsheet takes for formulas.

    path/recommendations goes by customer, mode and rank across its files, path/segments by segment.
    """
    about = release["manifest"].limit(1).select(F.col("cutoff").alias("snapshot_cutoff"), F.col("version").alias("model_version"))  # one row
    lists = release["lists"].where(F.col("rank") <= top_k)
    fell = lists.groupBy("customer_id", "mode").agg(F.count_if("is_fallback").alias("fallback_count"))
    whole = lists.join(fell, ["customer_id", "mode"]).join(release["profiles"].select("customer_id", F.col("status").alias("customer_status")), "customer_id").join(F.broadcast(about))
    safe = lambda *names: [formula_safe(F.col(c)).alias(c) for c in names]
    rows = whole.select(
        "rank", *safe("stock_code", "description"), "score", "method", "reason_code", *safe("reason"), "supporting_codes", "is_fallback", *safe("customer_id"), "customer_status", "snapshot_cutoff",
        F.col("mode").alias("recommendation_mode"), "model_version", "fallback_count",
    )
    options = {"header": "true", "escape": '"', "emptyValue": ""}
    write_sorted(rows, f"{path}/recommendations", "customer_id", "recommendation_mode", "rank", kind="csv", **options)
    segments = release["segments"]
    texts = [formula_safe(F.col(c)).alias(c) if c in ("segment_label", "campaign_hypothesis") else F.col(c) for c in segments.columns]
    write_sorted(segments.select(*texts), f"{path}/segments", "segment_id", kind="csv", **options)


def log_run(spark: SparkSession, path: str, stage: str, params: dict, metrics: dict) -> str:
    """Append a run's parameters and metrics to the table of runs; gives its id."""
    run = uuid.uuid4().hex
    rows = [(run, stage, kind, name, str(value)) for kind, values in (("param", params), ("metric", metrics)) for name, value in sorted(values.items())]
    spark.createDataFrame(rows, "run_id string, stage string, kind string, name string, value string").withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)
    return run


def response_times(spark: SparkSession, ask: Callable[[str], object], ids: Iterable[str], warm_up: int = 10, calls: int = 200) -> DataFrame:
    """(call, customer_id, ms) of requests one after the other, round the ids, after some that don't count."""
    ids, rows = list(ids), []
    for i in range(-warm_up, calls):
        began = time.perf_counter()
        ask(ids[i % len(ids)])
        if i >= 0:
            rows.append((i, ids[i % len(ids)], 1000 * (time.perf_counter() - began)))
    return spark.createDataFrame(rows, "call int, customer_id string, ms double")


def time_summary(times: DataFrame, target_ms: float = 200.0) -> DataFrame:
    """One row: calls, median, 95th and 99th percentile, extremes and mean in ms, and whether the 95th meets the target."""
    q = lambda at: F.round(F.percentile("ms", F.lit(at)), 3)
    return times.agg(
        F.count("*").alias("calls"), q(0.5).alias("median_ms"), q(0.95).alias("p95_ms"), q(0.99).alias("p99_ms"), F.round(F.max("ms"), 3).alias("max_ms"), F.round(F.min("ms"), 3).alias("min_ms"),
        F.round(F.avg("ms"), 3).alias("mean_ms"), (F.percentile("ms", F.lit(0.95)) <= target_ms).alias("target_met"),
    )


def pool(profiles: DataFrame, active: int = 70, inactive: int = 20, unknown: int = 10) -> list[str]:
    """The ids of a timing: some active, inactive and unknown customers."""
    some = lambda status, n: [r.customer_id for r in profiles.where(F.col("status") == status).orderBy("customer_id").limit(n).select("customer_id").collect()]
    return some("known_active", active) + some("known_inactive", inactive) + [f"UNKNOWN-{i}" for i in range(unknown)]
