"""Best-fit packing of tokenised documents into fixed-length sequences.

Every document becomes its token ids and an end id; only documents longer than a
sequence are cut, from the end, so that the first piece takes the remainder. Pieces
of one length are interchangeable, so the plan is made on the histogram of lengths
(at most `capacity` counts, a fixed bound): full pieces stand alone; large lengths, from
a sixth or a third of a sequence on, are rounded up within groups of equal cardinality
(linear grouping); the configurations of those few sizes are optimised as a linear programme
whose columns, multisets of sizes that fit, are generated by a knapsack over the duals;
whole parts of its solution are used, the actual lengths are put back in, and the pieces
left over and the small ones fill the room best fit first. The plan is a bounded list of
runs "this length, these sequences, this offset", which Spark joins to the ranked pieces.

Defined cases: null text is empty and packs as the end id alone; repeated rows are
packed once each; an empty table gives no rows; ties in length go by (doc_id, piece).
"""

from __future__ import annotations

import base64
import bisect
import os
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import buckets, slices, stored

CAPACITY = 1024
END_ID = 2
#: Longer texts go to `tokenizers`: the other library's matcher recurses.
LONG_TEXT = 1_000_000
#: From which shares of a sequence on lengths count as large; each is tried.
LARGE_SHARES = (6, 3)
GROUPS = 48
#: Tokens of room up to which a sequence counts as full.
SLACK = 0
#: Columns that are generated at most: a search that ends early leaves more to best fit, and every piece is placed.
MOST_COLUMNS = 600
PIECE_SCHEMA = "doc_id bigint, row_hash bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Alike(NamedTuple):
    """Sequences that hold the same lengths: what room they have left, and how many they are."""

    room: int
    lengths: tuple[int, ...]
    count: int


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, by the `tokenizers` file.

    ranks_path, if given, holds the same vocabulary as `tiktoken` ranks: the ids are the
    same, the time a quarter. Texts with an added token's string or of LONG_TEXT
    characters and more still go through `tokenizers`.
    """

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.ranks = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.ranks = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.ranks and len(text) < LONG_TEXT and not any(a in text for a in self.added):
            return array("I", self.ranks.encode_ordinary(text)).tobytes()
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row per piece of each document."""
    end = end_id.to_bytes(4, "little")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer_path, ranks_path, pattern)
        for batch in slices(batches):
            rows = []
            for doc, mark, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = enc.encode(text or "") + end
                rows += ((doc, mark, k, a, n, zlib.crc32(ids[4 * a : 4 * (a + n)])) for k, (a, n) in enumerate(cut(len(ids) // 4, capacity)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, (pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 3), strict=True)],
                names=["doc_id", "row_hash", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text").mapInArrow(tokenise, PIECE_SCHEMA)


def _fullest(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """How often each size is in the multiset of most worth that fits: an unbounded knapsack."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(sizes.min()), capacity + 1):
        best[c], last[c] = best[c - 1], last[c - 1] if best[c - 1] else -1
        fits = np.flatnonzero(sizes <= c)
        gain = best[c - sizes[fits]] + worth[fits]
        k = int(gain.argmax())
        if gain[k] > best[c] + 1e-12:
            best[c], last[c] = gain[k], fits[k]
    found, c = np.zeros(len(sizes)), capacity
    while c >= sizes.min() and best[c] > 0:
        while best[c - 1] == best[c]:
            c -= 1
        found[last[c]] += 1
        c -= sizes[last[c]]
    return found


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(how often each size is in it, how often it is used) of the configurations of fewest sequences, rounded down.

    Column generation: the basis starts with one size in each configuration; the
    knapsack over its duals brings in the configuration that saves most, until none does.
    """
    if not sizes:
        return []
    size, need = np.array(sizes), np.array(demand, dtype=float)
    basis = np.diag((capacity // size).astype(float))
    for _ in range(MOST_COLUMNS):
        inverse = np.linalg.inv(basis)
        used, dual = np.maximum(inverse @ need, 0), np.ones(len(size)) @ inverse
        column = _fullest(size, np.maximum(dual, 0), capacity)
        if dual @ column <= 1 + 1e-9:
            break
        way = inverse @ column
        ratio = np.where(way > 1e-9, used / np.where(way > 1e-9, way, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    times = np.floor(np.maximum(np.linalg.solve(basis, need), 0) + 1e-6).astype(int)
    return [(basis[:, k].astype(int), int(times[k])) for k in range(len(size)) if times[k]]


def best_fit(stock: Counter, bins: list[Alike], capacity: int) -> list[Alike]:
    """The bins with all of stock put in, longest first, each into the least room that takes it."""
    done = [x for x in bins if x.room == 0]
    rooms = sorted((x for x in bins if x.room), key=lambda x: x.room)
    for n in sorted(stock, reverse=True):
        need = stock[n]
        while need:
            at = bisect.bisect_left(rooms, n, key=lambda x: x.room)
            if at == len(rooms):
                rooms.append(Alike(capacity, (), -(-need // (capacity // n))))
                continue
            found = rooms.pop(at)
            take = min(need, found.count)
            need -= take
            if take < found.count:
                bisect.insort(rooms, found._replace(count=found.count - take), key=lambda x: x.room)
            found = Alike(found.room - n, (*found.lengths, n), take)
            bisect.insort(rooms, found, key=lambda x: x.room) if found.room else done.append(found)
    return done + rooms


def sequences(bins: list[Alike]) -> int:
    return sum(x.count for x in bins)


def configured(stock: Counter, capacity: int, groups: int, large_share: int) -> tuple[list[tuple[list[int], int]], dict[int, list[int]]]:
    """(configurations as (rounded sizes, times), members): linear grouping of the large lengths and its optimised configurations."""
    large = sorted((n for n in stock if n >= max(1, capacity // large_share)), reverse=True)
    goal = max(1, -(-sum(stock[n] for n in large) // groups))
    held, members = 0, {}
    for n in large:  # groups of about equal cardinality, each rounded up to its longest
        if not members or held + stock[n] > goal and held:
            held, members[n] = 0, []
        held += stock[n]
        members[next(reversed(members))].append(n)
    found = configurations(list(members), [sum(stock[n] for n in m) for m in members.values()], capacity)
    return [([top for top, c in zip(members, counts.tolist(), strict=True) for _ in range(c)], times) for counts, times in found], members


def substituted(patterns: list[tuple[list[int], int]], members: dict[int, list[int]], stock: Counter, capacity: int, spare: int) -> list[Alike]:
    """Sequences of the configurations with actual lengths, longest first, in place of all but the last `spare` rounded sizes; takes the lengths out of stock."""
    bins: list[Alike] = []
    for pattern, times in patterns:
        parts = [Alike(capacity, (), times)]
        for top in pattern[: max(1, len(pattern) - spare)]:
            filled = []
            for room, lengths, count in parts:
                while count and (n := next((m for m in members[top] if stock[m]), 0)):
                    take = min(count, stock[n])
                    stock[n] -= take
                    filled.append(Alike(room - n, (*lengths, n), take))
                    count -= take
                if count:
                    filled.append(Alike(room, lengths, count))
            parts = filled
        bins += [x for x in parts if x.lengths]
    return bins


def repacked(bins: list[Alike], capacity: int, slack: int) -> list[Alike]:
    """The bins with those that have more than `slack` room given up, and their lengths put together best fit."""
    again: Counter = Counter()
    for x in bins:
        if x.room > slack:
            for n in x.lengths:
                again[n] += x.count
    return best_fit(again, [x for x in bins if x.room <= slack], capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large_shares: tuple[int, ...] = LARGE_SHARES, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every piece below capacity.

    The configurations are filled with all of their sizes, or with all but the last, whose
    place best fit chooses; sequences with room are kept, or given up and packed anew where
    that makes fewer. Plain best fit without configurations is the bound: what is placed
    never needs more sequences. A run puts the pieces of one length with ranks first ..
    first + count - 1 into as many consecutive sequences at one offset. Full pieces aren't
    in it: each is a sequence itself.
    """
    stock = Counter({n: c for n, c in histogram.items() if c and n < capacity})
    plans = []
    for share in large_shares:
        patterns, members = configured(stock, capacity, groups, share)
        for spare in (0, 1):
            left = +stock
            bins = substituted(patterns, members, left, capacity, spare)
            plans.append(best_fit(+left, bins, capacity))
    plans += [repacked(x, capacity, slack) for x in plans]
    plans.append(best_fit(stock, [], capacity))
    runs, used, seq = [], Counter(), 0
    for _, lengths, count in min(plans, key=sequences):  # of equals the first: configurations as they are
        offset = 0
        for n in lengths:
            runs.append((n, used[n], count, seq, offset))
            used[n] += count
            offset += n
        seq += count
    return runs


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Every piece with its sequence and its place there."""
    spark = docs.sparkSession
    cutted = stored(pieces(docs, tokenizer_path, capacity, end_id, ranks_path, pattern), "pieces")
    histogram = {r.length: r.n for r in cutted.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs = plan(histogram, capacity)
    last = max((seq + count for _, _, count, seq, _ in runs), default=0)
    # Rank of each piece within its length, without one task for a length: local ranks in hash buckets plus the buckets' offsets.
    n_buckets = buckets(spark)
    short = cutted.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "row_hash"), F.lit(n_buckets)))
    counts = short.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    local = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "row_hash"))
    ranked = short.withColumn("local", local).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("local") - 1)
    # The plan's size is bounded by the number of lengths, not by the data.
    schema = "run_length bigint, rank_from bigint, run_count bigint, seq_from bigint, offset bigint"
    placed = spark.createDataFrame(runs, schema).withColumn("rank_to", F.col("rank_from") + F.col("run_count"))
    fits = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    joined = ranked.join(F.broadcast(placed), fits, "left")
    full = F.col("length") == capacity
    return joined.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(full, F.lit(last) + F.col("rank")).otherwise(F.col("seq_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"),
        F.when(full, F.lit(0)).otherwise(F.col("offset")).cast("bigint").alias("offset"),
    )
