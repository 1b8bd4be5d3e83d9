"""Readers of the retail tables and of raw invoice lines."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketry.functions import blank_to_null

#: Lines that a task of the join of the order tables holds, about.
TASK_LINES = 500_000
#: An optional column of raw lines that InvoiceNo decides; lines that share it lie in one partition already.
KEY = "line_key"
# The columns of raw invoice lines.
RAW_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares; an own one only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-ckpt-"))
        path = spark.sparkContext.getCheckpointDir()
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df marked for broadcast if it has `most` rows at most (counted), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def write_sorted(df: DataFrame, path: str, *keys: str, kind: str = "parquet", mode: str = "overwrite", **options: str) -> None:
    """Write df sorted across its files: ranges of the keys are dealt to tasks, and the files' names follow the ranges."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).options(**options).format(kind).save(path)


def require_columns(df: DataFrame, columns=RAW_COLUMNS) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def read_invoice_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw invoice lines, every column text; cleaning parses them leniently."""
    df = spark.read.csv(path, header=True)
    return require_columns(df.select([F.col(c).cast(T.StringType()) for c in df.columns]))


def read_invoice_sheet(spark: SparkSession, path: str, sheet: str | None = None, rows_per_task: int = 50_000) -> DataFrame:
    """Raw invoice lines of a spreadsheet, every column text; cleaning parses them leniently."""
    from basketry.sources.xlsx import Spreadsheet

    spark.dataSource.register(Spreadsheet)
    reader = spark.read.format("xlsx").option("rowsPerPartition", str(rows_per_task))
    return require_columns((reader.option("sheet", sheet) if sheet else reader).load(path))


def raw_lines(spark: SparkSession, path: str, keyed: bool = False, sound: bool = False) -> DataFrame:
    """Raw invoice lines of a .xlsx or .csv file, or of a folder with the order tables; keyed, sound: see `invoice_lines`, for the tables alone."""
    readers = {"xlsx": read_invoice_sheet, "csv": read_invoice_csv}
    kind = path.rpartition(".")[2].lower()
    return readers[kind](spark, path) if kind in readers else invoice_lines(spark, path, keyed, sound)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files, upper-case hexadecimal."""
    return spark.read.format("binaryFile").load(path).select("path", F.upper(F.sha2("content", 256)).alias("sha256"))


def invoice_lines(spark: SparkSession, sf_dir: str, keyed: bool = False, sound: bool = False) -> DataFrame:
    """The order tables as raw invoice lines, with deterministic dirt for the cleaning rules to find.

    Lines meet their parts first and their orders, which know customer and nation by then,
    last: lines go through two exchanges, with what the raw line says in place of the columns
    that it is made of, and lie by order in the end. From some size on both
    have as many partitions as the lines ask for, so a task's share doesn't grow with them.
    keyed: with KEY. sound: for purchases without texts. Lines that the cleaning removes by
    what a single table tells stay out of the exchanges, and so do texts: a Description is
    the least key of the parts with that code and clean name, which tells lines apart as the
    names do (p_partkey is the key of the parts), and the Country, which the invoice decides, is missing.
    """
    orders = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    lines = table(spark, sf_dir, "lineitem")
    n_tasks = -(-lines.count() // TASK_LINES)
    dealt = lambda df, key: df.repartition(n_tasks, key) if n_tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else df
    lines = lines.selectExpr(
        "l_orderkey", "l_partkey", "l_returnflag = 'R' AND l_linestatus = 'F' AS cancelled",
        "CASE WHEN l_orderkey % 307 = 0 THEN NULL WHEN l_returnflag = 'A' AND l_linestatus = 'O' AND l_discount = 0.1D THEN -l_quantity ELSE l_quantity END AS Quantity",
        "CASE WHEN l_partkey % 101 = 0 THEN 0.0D ELSE l_extendedprice / l_quantity END AS UnitPrice",
    )
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name AS Description", "CASE WHEN p_type = 'PROMO' AND p_size <= 2 THEN 'POST' ELSE lpad(CAST(p_partkey AS STRING), 5, '0') END AS StockCode")
    told = ["cancelled", "Quantity", "UnitPrice"]
    if sound:
        lines = lines.where("cancelled IS NOT TRUE AND Quantity > 0 AND UnitPrice > 0 AND l_orderkey % 211 <> 0")
        orders = orders.where("o_orderdate IS NOT NULL AND o_custkey % 50 <> 0 AND o_custkey % 173 <> 0").drop("n_name")
        kind = F.min("p_partkey").over(Window.partitionBy("StockCode", blank_to_null(F.col("Description"))))
        parts, told = parts.where("StockCode <> 'POST'").select("p_partkey", kind.alias("kind")), told[1:]
    lines = dealt(lines.select("l_orderkey", "l_partkey", *told), "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.select("l_orderkey", *told, *(["kind"] if sound else ["Description", "StockCode"]))
    base = dealt(lines, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    copies = F.when(F.col("l_orderkey") % 97 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    lines = base.withColumn("copy", F.explode(copies))
    if sound:
        return lines.selectExpr(
            "CAST(o_orderkey AS STRING) AS InvoiceNo", "lpad(CAST(kind AS STRING), 5, '0') AS StockCode", "CAST(kind AS STRING) AS Description", "Quantity", "o_orderdate AS InvoiceDate",
            "UnitPrice", "concat(CAST(o_custkey AS STRING), '.0') AS CustomerID", "CAST(NULL AS STRING) AS Country",
            *([f"l_orderkey AS {KEY}"] if keyed else []),
        )
    return lines.selectExpr(
        "concat(CASE WHEN cancelled THEN 'C' ELSE '' END, CAST(o_orderkey AS STRING)) AS InvoiceNo", "StockCode", "Description", "Quantity",
        "CASE WHEN l_orderkey % 211 = 0 THEN NULL ELSE o_orderdate END AS InvoiceDate",
        "UnitPrice",
        "CASE WHEN o_custkey % 50 = 0 THEN NULL WHEN o_custkey % 173 = 0 THEN concat('ABC-', CAST(o_custkey AS STRING)) ELSE concat(CAST(o_custkey AS STRING), '.0') END AS CustomerID",
        "n_name AS Country",
        *([f"l_orderkey AS {KEY}"] if keyed else []),
    )
