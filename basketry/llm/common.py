"""Shared pieces: table access, shared scratch tables and the numpy text kernels.

The kernels run inside Spark tasks on slices of an Arrow batch, cut into slabs of half a
megabyte, so their memory doesn't follow the data.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
SLAB_BYTES = 500_000
SLICE_ROWS = 1000

_rng = np.random.Generator(np.random.PCG64(20240611))
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * U(2) + U(1)
GRAM = _rng.integers(1, 2**63, size=16, dtype=np.uint64) * U(2) + U(1)
_ROOT = 0x9E3779B97F4A7C15 | 5
_POW: dict[str, np.ndarray] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the whole cluster shares; an own one only where none is set and all runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df marked for broadcast if it has `most` rows at most (counted), else as it is: Spark then exchanges both sides of a join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def pieces(df: DataFrame, most: int, times: int = 4) -> list[DataFrame]:
    """df, which is cheap to read, in up to `times` pieces of about `most` rows by doc_id, marked for broadcast; with more rows (counted) as it is: Spark then exchanges both sides of a join."""
    n = df.limit(times * most + 1).count()
    if n > times * most:
        return [df]
    parts = max(1, -(-n // most))
    return [F.broadcast(df.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == k) if parts > 1 else df) for k in range(parts)]


def spare_name(df: DataFrame, name: str = "spare") -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def buckets(spark: SparkSession, least: int = 8) -> int:
    """How many partitions an explicit exchange uses: the session's shuffle width."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R^i and R^-i modulo 2^64 for i < n."""
    if "up" not in _POW or len(_POW["up"]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        for name, r in (("up", _ROOT), ("down", pow(_ROOT, -1, 2**64))):
            steps = np.full(size, U(r), dtype=np.uint64)
            steps[0] = 1
            _POW[name] = np.multiply.accumulate(steps)
    return _POW["up"], _POW["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def slabs(blobs: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about SLAB_BYTES together; one long text is a slab alone."""
    start = total = 0
    for i, b in enumerate(blobs):
        if total and total + len(b) > SLAB_BYTES:
            yield start, i
            start, total = i, 0
        total += len(b) + 1
    if start < len(blobs):
        yield start, len(blobs)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(blobs: list[bytes], is_space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first byte, end byte, word offsets of the texts) over b"\\n".join(blobs).

    A word is a maximal run of bytes that aren't white space (or other separators given).
    """
    buf = np.frombuffer(b"\n".join(blobs), dtype=np.uint8)
    n = len(buf)
    lengths = np.fromiter((len(b) + 1 for b in blobs), dtype=np.int64, count=len(blobs))
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(blobs) + 1, np.int64)
    solid = np.zeros(n + 2, dtype=np.int8)
    solid[1:-1] = ~is_space[buf]
    edge = np.diff(solid)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[buf] * up[:n], out=total[1:])
    h = mix((total[end] - total[first]) * down[first])
    offsets = np.concatenate(([0], np.searchsorted(first, np.cumsum(lengths))))
    return h, first, end, offsets


def windows(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` consecutive words, texts not yet separated."""
    n = len(h)
    if n < length:
        return np.zeros(0, U)
    up, down = _powers(n + 1)
    total = np.empty(n + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(h * up[:n], out=total[1:])
    return mix((total[length:] - total[:-length]) * down[: n - length + 1])


def grams(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` words by a sum with one odd factor per place."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        out += h[k : k + n] * GRAM[k]
    return mix(out)


def shingle_sets(blobs: list[bytes], size: int) -> Iterator[np.ndarray]:
    """For each text its distinct word shingles, as sorted 64-bit hashes.

    Fewer words than `size` make one shingle of them all; no words make none.
    """
    for lo, hi in slabs(blobs):
        h, _, _, at = words_of(blobs[lo:hi])
        g = grams(h, size)
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= size:
                s = np.sort(g[a : b - size + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(np.array([int(sum(int(x) * int(c) for x, c in zip(h[a:b], GRAM)) + b - a) % 2**64], dtype=np.uint64))
            else:
                yield np.zeros(0, U)


def slices(batches: Iterator, rows: int = SLICE_ROWS) -> Iterator:
    """The batches in slices of few rows (no copies), so that few texts at a time become Python objects."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def as_bytes(values, lower: bool = False) -> list[bytes]:
    """UTF-8 of each text of an Arrow column, null as empty; optionally A-Z lowered."""
    out = [(v or "").encode("utf-8", "surrogatepass") for v in values.to_pylist()]
    return [b.lower() for b in out] if lower else out
