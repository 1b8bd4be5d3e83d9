"""Freeze, refit, test: what the validation cut-off chose, tied to the data and the parameters it was chosen on.

A table's digest doesn't know an order: every row is hashed by itself and the hashes are
added up, so tasks add their rows and nothing is sorted. A frozen choice is refused where
the lines or the parameters have another digest than when it was made.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketry.params import DEFAULT, Params

#: Hexadecimal digits of a part of a row's hash: four parts are added up, 240 bits.
DIGITS, PARTS = 15, 4
CHOICE = ("family", "covariance", "k")


def _text(name: str, kind: str, decimals: int | None) -> Column:
    """A value with its length before it, so that no two rows read alike; - for null."""
    c = F.col(f"`{name}`")
    text = c.cast("string")
    if decimals is not None and kind in ("double", "float"):
        whole = F.rint(c * 10.0**decimals)
        text = F.when(F.abs(whole) < 1e37, whole.try_cast("decimal(38,0)").cast("string")).otherwise(text)
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def table_digest(df: DataFrame, decimals: int | None = None) -> DataFrame:
    """One row (n_rows, digest) that is equal for equal rows in any order and partitioning.

    decimals: doubles count to so many decimals; without, as Spark writes them. Columns go
    by name. Repeated rows count each.
    """
    kinds = dict(df.dtypes)
    row = F.sha2(F.concat_ws(",", *(_text(c, kinds[c], decimals) for c in sorted(kinds))), 256)
    hashed = df.select(row.alias("h"))
    part = lambda i: F.conv(F.substring("h", 1 + DIGITS * i, DIGITS), 16, 10).cast("decimal(20,0)")
    sums = hashed.agg(F.count("*").alias("n_rows"), *(F.coalesce(F.sum(part(i).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"s{i}") for i in range(PARTS)))
    whole = F.concat_ws("|", F.col("n_rows").cast("string"), *(F.col(f"s{i}").cast("string") for i in range(PARTS)))
    return sums.select("n_rows", F.upper(F.sha2(whole, 256)).alias("digest"))


def params_digest(p: Params = DEFAULT) -> str:
    return hashlib.sha256(json.dumps(asdict(p), sort_keys=True).encode()).hexdigest().upper()


def manifest(raw: DataFrame, judged: DataFrame, cutoff: str, p: Params = DEFAULT) -> DataFrame:
    """One row: digests of lines and parameters, the cut-off, and the recommender that the gate (one row) selects."""
    won = F.col("qualifies")
    return table_digest(raw, 6).join(judged).select(  # single rows
        F.col("n_rows").alias("n_lines"), F.col("digest").alias("source_digest"), F.lit(params_digest(p)).alias("params_digest"), F.lit(cutoff).alias("cutoff"), F.col("selected").alias("recommender"), "qualifies", "relative_gain",
        F.when(won, F.col("ndcg")).otherwise(F.col("base_ndcg")).alias("validation_ndcg"), F.when(won, F.col("recall")).otherwise(F.col("base_recall")).alias("validation_recall"), "d_low",
    )


def freeze(chosen: DataFrame, segmentation: DataFrame, path: str) -> None:
    """Write the manifest with the segmentation's choice (one row each); what is there stays as it is."""
    chosen.join(segmentation.select(*CHOICE)).withColumn("frozen_at", F.current_timestamp()).coalesce(1).write.mode("error").json(path)


SCHEMA = "n_lines bigint, source_digest string, params_digest string, cutoff string, recommender string, qualifies boolean, relative_gain double, validation_ndcg double, validation_recall double, d_low double, family string, covariance string, k int, frozen_at timestamp"


def frozen(spark: SparkSession, path: str, raw: DataFrame, p: Params = DEFAULT):
    """The frozen choice's row; RuntimeError where there is none, ValueError where lines or parameters have changed since."""
    try:
        row = spark.read.schema(SCHEMA).json(path).first()
    except AnalysisException as e:
        raise RuntimeError(f"nothing is frozen at {path}") from e
    if row is None:
        raise RuntimeError(f"nothing is frozen at {path}")
    if row.params_digest != params_digest(p):
        raise ValueError("the parameters aren't those of the frozen choice")
    if row.source_digest != table_digest(raw, 6).first().digest:
        raise ValueError("the lines aren't those of the frozen choice")
    return row
