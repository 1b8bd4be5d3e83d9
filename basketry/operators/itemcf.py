"""Item-to-item collaborative filtering on distinct (customer, item) pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.functions import half_even
from basketry.params import DEFAULT, Params
from basketry.sources import small, stored

#: Pairs of items bought together that a unit counts in one pass, neighbours that a unit of scores holds, and interactions that it scores.
MET, HELD, SCORED = 12_000_000, 12_000_000, 12_000_000
#: Passes that a unit makes over its baskets: with fewer, a basket goes to more units.
PASSES = 6
#: What a unit has at least of pairs and of interactions before another task is worth while.
LEAST_MET, LEAST_SCORED = 500_000, 100_000
#: Pairs that a unit counts at once, and terms of scores that it adds up at once, about.
CHUNK, TERMS = 16_000_000, 400_000


def co_buyers(pairs: DataFrame, block: int = DEFAULT.basket_block) -> DataFrame:
    """(item_a, item_b, n_both) with item_a < item_b: one half of the symmetric counts, summed before the exchange.

    The items of a customer with more than `block` are dealt to blocks by hash, and two of
    its blocks meet at a time, so the square of a heavy customer is shared by many tasks;
    everyone else has one block.
    """
    n_blocks = F.ceil(F.count("*").over(Window.partitionBy("customer_id")) / F.lit(float(block))).cast("bigint")
    dealt = pairs.withColumn("blocks", n_blocks).withColumn("own", F.pmod(F.xxhash64("stock_code"), F.col("blocks")))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    met = met.select("customer_id", "stock_code", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    key = ["customer_id", "low", "high"]
    a = met.where(F.col("own") == F.col("low")).select(*key, F.col("stock_code").alias("x"))
    b = met.where(F.col("own") == F.col("high")).select(*key, F.col("stock_code").alias("y"))
    both = a.join(b, key).where((F.col("low") < F.col("high")) | (F.col("x") < F.col("y")))
    return both.groupBy(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(F.count("*").alias("n_both"))


def item_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("stock_code").agg(F.count("*").alias("n_buyers"))


def item_idf(pairs: DataFrame, n_customers: DataFrame) -> DataFrame:
    """(stock_code, idf): ln((U + 1) / (buyers + 1)) + 1; n_customers is one row with column n."""
    return item_counts(pairs).join(F.broadcast(n_customers)).select("stock_code", "n_buyers", (F.log((F.col("n") + 1) / (F.col("n_buyers") + 1)) + 1).alias("idf"))


def neighbours(both: DataFrame, counts: DataFrame, p: Params = DEFAULT, idf: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(seed, neighbour, sim, rank): cosine of the buyers' sets, the best p.neighbours (or `most`) of each seed.

    A pair needs p.least_co_buyers common buyers. Weights by item cancel out of the cosine
    and act on this gate alone: with idf it is idf(seed) * common buyers.
    """
    na, nb = counts.select(F.col("stock_code").alias("item_a"), F.col("n_buyers").alias("n_a")), counts.select(F.col("stock_code").alias("item_b"), F.col("n_buyers").alias("n_b"))
    sims = both.join(na, "item_a").join(nb, "item_b").withColumn("sim", F.col("n_both") / F.sqrt((F.col("n_a") * F.col("n_b")).cast("double")))
    sides = F.array(F.struct(F.col("item_a").alias("seed"), F.col("item_b").alias("neighbour")), F.struct(F.col("item_b").alias("seed"), F.col("item_a").alias("neighbour")))
    each = sims.select(F.explode(sides).alias("s"), "n_both", "sim").select("s.seed", "s.neighbour", "n_both", "sim")
    if idf is None:
        kept = each.where(F.col("n_both") >= p.least_co_buyers)
    else:
        kept = each.join(idf.select(F.col("stock_code").alias("seed"), "idf"), "seed").where(F.col("idf") * F.col("n_both") >= p.least_co_buyers)
    order = Window.partitionBy("seed").orderBy(F.desc(F.round("sim", 12)), "neighbour")
    ranked = kept.select("seed", "neighbour", "sim", F.row_number().over(order).cast("bigint").alias("rank"))
    return ranked.where(F.col("rank") <= (most or p.neighbours))


def contributions(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """(customer_id, seed, stock_code, sim, rank): what each owned item says of its neighbours."""
    return pairs.select("customer_id", F.col("stock_code").alias("seed")).join(near.select("seed", F.col("neighbour").alias("stock_code"), "sim", "rank"), "seed")


def scores_by_bound(pairs: DataFrame, near: DataFrame, bounds: tuple[int, ...]) -> DataFrame:
    """(customer_id, stock_code, score_N, ...): summed similarity over the number of owned items, those without neighbours too.

    All numbers of neighbours N come from one join: an item's best N are the first N ranks
    of its best max(bounds). Null where none of the first N says anything of an item.
    """
    seeds = pairs.groupBy("customer_id").agg(F.count("*").alias("n_seeds"))
    totals = [F.sum(F.when(F.col("rank") <= n, F.col("sim"))).alias(f"total_{n}") for n in bounds]
    summed = contributions(pairs, near).groupBy("customer_id", "stock_code").agg(*totals)
    return summed.join(seeds, "customer_id").select("customer_id", "stock_code", *(half_even(F.col(f"total_{n}") / F.col("n_seeds"), 10).alias(f"score_{n}") for n in bounds))


def scores_of(scored: DataFrame, n: int) -> DataFrame:
    """(customer_id, stock_code, score) of one number of neighbours."""
    return scored.where(F.col(f"score_{n}").isNotNull()).select("customer_id", "stock_code", F.col(f"score_{n}").alias("score"))


def candidate_scores(pairs: DataFrame, near: DataFrame, n: int = DEFAULT.neighbours) -> DataFrame:
    """(customer_id, stock_code, score) by the first n ranks."""
    return scores_of(scores_by_bound(pairs, near, (n,)), n)


def supporters(pairs: DataFrame, near: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(customer_id, stock_code, supporters): the owned items most like each candidate, best first."""
    order = Window.partitionBy("customer_id", "stock_code").orderBy(F.desc(F.round("sim", 12)), "seed")
    best = contributions(pairs, near).withColumn("place", F.row_number().over(order)).where(F.col("place") <= p.supporters)
    listed = best.groupBy("customer_id", "stock_code").agg(F.array_sort(F.collect_list(F.struct("place", "seed"))).alias("s"))
    return listed.select("customer_id", "stock_code", F.transform("s", lambda x: x["seed"]).alias("supporters"))


def without_owned(scored: DataFrame, owned: DataFrame) -> DataFrame:
    return scored.join(owned.select("customer_id", "stock_code"), ["customer_id", "stock_code"], "left_anti")


def top_candidates(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("customer_id").orderBy(F.desc("score"), "stock_code")
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


# Blocks. Neither pairs of items nor what owned items say of candidates go through an
# exchange: baskets and neighbours are dealt to units, in which the rows that belong
# together meet, and a unit sends on counts, neighbours or a customer's best only.


def numbered(pairs: DataFrame) -> DataFrame:
    """(stock_code, n_buyers, item): the items with numbers from 0 in order of their codes."""
    dealt = item_counts(pairs).repartitionByRange("stock_code").sortWithinPartitions("stock_code")
    dealt = stored(dealt.withColumn("place", F.monotonically_increasing_id()), "codes").withColumn("part", F.shiftright("place", 33))
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row a partition
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("before"))
    own = F.col("place").bitwiseAND(F.lit(2**33 - 1))
    return dealt.join(F.broadcast(before), "part").select("stock_code", "n_buyers", (own + F.col("before")).cast("int").alias("item"))


def baskets(pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """(customer_id, items): the sorted numbers of each customer's items."""
    return pairs.join(small(codes.select("stock_code", "item")), "stock_code").groupBy("customer_id").agg(F.sort_array(F.collect_list("item")).alias("items"))


def _busy(df: DataFrame, amount: int, least: int) -> int:
    """The tasks that run at once, fewer where that left less than `least` to each."""
    return max(1, min(df.sparkSession.sparkContext.defaultParallelism, -(-amount // least)))


def _tasks(df: DataFrame, amount: int, most: int, least: int) -> int:
    return max(-(-amount // most), _busy(df, amount, least))


def _dealt(n_near: int, n_bought: int, n_best: int, busy: int) -> tuple[int, int]:
    """(blocks of neighbours, shares of customers) for `busy` tasks at least, of those that stay within bounds the ones that send least.

    Each share gets all neighbours, each block all baskets, and sends up to n_best candidates.
    A candidate is written and exchanged with its customer, which counts as four numbers.
    """
    least = max(1, -(-n_near // HELD))
    choices = [(b, max(1, -(-n_bought // SCORED), -(-busy // b))) for b in range(least, max(least, busy) + 1)]
    return min(choices, key=lambda x: (x[1] * n_near + x[0] * (n_bought + 4 * n_best), x))


def _upto(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _by_kind(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of batches sorted by kind, one kind at a time."""
    for batch in batches:
        kind = batch.column("kind").to_numpy()
        for k in np.unique(kind).tolist():
            lo, hi = np.searchsorted(kind, (k, k + 1))
            yield k, batch.slice(lo, hi - lo)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each list and the end of the last, values)."""
    return column.offsets.to_numpy().astype(np.int64), column.values.to_numpy()


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start[i], ..., start[i] + length[i] - 1 of all i in a row."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())


def _added(told: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, of several such."""
    if len(told) == 1:
        return told[0]
    k, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*told, strict=True)) if told else (np.zeros(0, np.int64),) * 2
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
    return k[first], np.add.reduceat(n, first) if len(k) else n


def _packed(*parts: np.ndarray) -> bytes:
    """Whole numbers of four bytes: first all lowest bytes, then the next ones, compressed."""
    return pa.compress(np.concatenate(parts).astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    """The n numbers that were packed."""
    plain = pa.decompress(packed, 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(4, n).T).view("<i4").ravel()


def _steps(values: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Each value less the one before it in its list; a list's first stays."""
    steps = np.diff(values, prepend=0)
    first = np.cumsum(width) - width
    steps[first] = values[first]
    return steps


def _summed(steps: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The values of which `steps` are the steps."""
    ends = np.cumsum(steps, dtype=np.int64)
    first = np.cumsum(width) - width
    return ends - np.repeat(ends[first] - steps[first], width)


def _marks(codes: DataFrame, n_units: int, *names: str) -> DataFrame:
    """(unit, kind 0, item, the named columns as arrays): what every unit is told of the items, in order, 4,096 items a row."""
    rows = codes.groupBy(F.shiftright("item", 12).alias("at")).agg(F.array_sort(F.collect_list(F.struct("item", *names))).alias("l"))
    return rows.select(_upto(n_units).alias("unit"), F.lit(0).alias("kind"), F.col("at").alias("item"), *(F.col(f"l.{c}").alias(c) for c in names))


def _joined(batches: list[pa.RecordBatch], name: str) -> pa.Array:
    return pa.concat_arrays([x.column(name).flatten() for x in batches])


def _met(bought: DataFrame, codes: DataFrame, tell, schema: str) -> DataFrame:
    """What `tell` makes of the common buyers (a, b, n) of each item a with every other item b.

    A unit has the items of one remainder as a; a basket goes once to each unit that has
    one of its items, packed with others that go there. A unit keeps its baskets packed and
    passes over them for as many shares of its items as keep the counts of a share small.
    codes: (stock_code, n_buyers, item, weight), told to every unit.
    tell(stock codes, buyers, weights, a, b, n) gives the columns of the schema; a ascends, then b.
    """
    size = F.size("items").cast("bigint")
    n_units, n_items = _tasks(bought, bought.agg(F.sum(size * size)).first()[0] or 0, MET * PASSES, LEAST_MET), codes.count()
    none = lambda kind: F.lit(None).cast(kind)
    marks = _marks(codes, n_units, "stock_code", "n_buyers", "weight").select("*", *(none(t).alias(c) for c, t in (("n", "int"), ("size", "int"), ("met", "bigint"), ("packed", "binary"))))
    names = [c.split()[0] for c in schema.split(", ")]
    most, chunk, slab = MET, CHUNK, CHUNK // 8

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, items = _lists(batch.column("items"))
            at, items = at - at[0], items[at[0] : at[-1]]
            width = np.diff(at)
            unit, row = items.astype(np.int64) % n_units, np.repeat(np.arange(len(batch)), width)
            met = np.bincount(unit, width[row], n_units)
            key = np.unique(unit * len(batch) + row)
            unit, row = key // max(1, len(batch)), key % max(1, len(batch))
            out, held = [], 0
            rows = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["unit", "n", "size", "met", "packed"])
            for u in np.unique(unit).tolist():
                mine = row[slice(*np.searchsorted(unit, (u, u + 1)))]
                values = items[_spread(at[mine], width[mine])]
                out.append((u, len(mine), len(values), int(met[u]), _packed(width[mine], _steps(values, width[mine]))))
                held += len(out[-1][-1])
                if held > 2**24:
                    yield rows(out)
                    out, held = [], 0
            if out:
                yield rows(out)

    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
    dealt = bought.select("items").mapInArrow(deal, "unit int, n int, size int, met bigint, packed binary")
    lists = dealt.select("unit", F.lit(1), none("int"), none("array<string>"), none("array<bigint>"), none("array<double>"), "n", "size", "met", "packed")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, held, unit = [], [], None
        for kind, batch in _by_kind(batches):
            if kind == 0:
                marked.append(batch.select(["stock_code", "n_buyers", "weight"]))
            else:
                unit = batch.column("unit")[0].as_py()
                held += zip(*(batch.column(c).to_pylist() for c in ("n", "size", "met", "packed")), strict=True)
        if unit is None:
            return
        code, buyers, weight = _joined(marked, "stock_code"), _joined(marked, "n_buyers").to_numpy(), _joined(marked, "weight").to_numpy()
        n_shares = max(1, -(-sum(met for _, _, met, _ in held) // most))
        for share in range(n_shares):
            raw, told, new, fresh, known = [], [], 0, 0, 0
            for n, size, _, packed in held:
                both = _unpacked(packed, n + size)
                width = both[:n].astype(np.int64)
                at, items = np.cumsum(width) - width, _summed(both[n:], width)
                row = np.repeat(np.arange(n), width)
                mine = (items % n_units == unit) & (items // n_units % n_shares == share)
                a, row = items[mine], row[mine]
                wide = width[row]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(np.cumsum(wide) // slab)) + 1, [len(a)]))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    raw.append(np.repeat(a[lo:hi] * n_items, wide[lo:hi]) + items[_spread(at[row[lo:hi]], wide[lo:hi])])
                    new += len(raw[-1])
                    if new > chunk:
                        told.append(np.unique(np.concatenate(raw), return_counts=True))
                        raw, new, fresh = [], 0, fresh + len(told[-1][0])
                        if fresh > max(chunk, known):  # what is held at least doubles between two sums
                            told, fresh = [_added(told)], 0
                            known = len(told[0][0])
            if raw:
                told.append(np.unique(np.concatenate(raw), return_counts=True))
            k, n = _added(told)
            a, b = k // n_items, k % n_items
            other = a != b
            out = pa.table(tell(code, buyers, weight, a[other], b[other], n[other].astype(np.int64)), names=names)
            yield from out.to_batches(max_chunksize=100_000)

    return marks.unionAll(lists).repartitionById(n_units, "unit").sortWithinPartitions("kind", "item").mapInArrow(count, schema)


def pair_counts(bought: DataFrame, codes: DataFrame, least: int = 1) -> DataFrame:
    """(item_a, item_b, n_both) of the pairs with `least` common buyers, item_a < item_b."""

    def tell(code, buyers, weight, a, b, n):
        keep = (a < b) & (n >= least)
        return [code.take(pa.array(a[keep])), code.take(pa.array(b[keep])), pa.array(n[keep])]

    return _met(bought, codes.withColumn("weight", F.lit(1.0)), tell, "item_a string, item_b string, n_both bigint")


def near_items(bought: DataFrame, codes: DataFrame, idf: DataFrame | None = None, p: Params = DEFAULT, most: int | None = None) -> DataFrame:
    """What `neighbours` gives, (seed, neighbour, sim, rank), with the items' numbers and common buyers."""
    most = most or p.neighbours
    gate = codes.withColumn("weight", F.lit(1.0)) if idf is None else codes.join(idf.select("stock_code", F.col("idf").alias("weight")), "stock_code")

    def tell(code, buyers, weight, a, b, n):
        keep = weight[a] * n >= p.least_co_buyers
        a, b, n = a[keep], b[keep], n[keep]
        sim = n / np.sqrt((buyers[a] * buyers[b]).astype(np.float64))
        order = np.lexsort((b, -np.rint(sim * 1e12), a))
        a, b, sim = a[order], b[order], sim[order]
        first = np.concatenate(([True], a[1:] != a[:-1])) if len(a) else np.zeros(0, bool)
        rank = np.arange(len(a)) - np.maximum.accumulate(np.where(first, np.arange(len(a)), 0)) + 1
        a, b, sim, n, rank = (x[rank <= most] for x in (a, b, sim, n[order], rank))
        return [code.take(pa.array(a)), code.take(pa.array(b)), pa.array(sim), pa.array(rank), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n)]

    return _met(bought, gate, tell, "seed string, neighbour string, sim double, rank bigint, seed_item int, item int, n_both bigint")


def best_candidates(bought: DataFrame, codes: DataFrame, near: DataFrame, bounds: tuple[int, ...], k: int | None = None, new_only: bool = False, backers: int = 0) -> DataFrame:
    """(customer_id, stock_code, bound, score, supporters): what `scores_by_bound` gives for each number of neighbours, a row each.

    A unit holds the neighbours whose number has one remainder, of all items, and scores
    the baskets of one share of the customers, so every score is whole there. With k, it
    sends a customer's k best only (best of a unit, so the k best of all are among them);
    new_only leaves out owned items first. supporters: the `backers` owned items most like the candidate.
    """
    near = near.where(F.col("rank") <= max(bounds))
    n_near, n_items = near.count(), codes.count()
    n_customers, n_bought = bought.agg(F.count("*"), F.coalesce(F.sum(F.size("items").cast("bigint")), F.lit(0))).first()
    n_blocks, n_shares = _dealt(n_near, n_bought, n_customers * (k or 0), _busy(bought, n_bought, LEAST_SCORED))
    none = lambda kind: F.lit(None).cast(kind)
    unit = F.col("share") * n_blocks + F.col("block")
    marks = _marks(codes, n_shares * n_blocks, "stock_code", "n_buyers").select("*", *(none(t).alias(c) for c, t in (("n", "int"), ("packed", "binary"), ("id", "string"), ("items", "array<int>"))))
    parts = ("seed_item", "item", "rank", "n_both")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("item").to_numpy() % n_blocks
            here = [(int(k), [batch.column(c).to_numpy()[block == k] for c in parts]) for k in np.unique(block)]
            columns = [[k for k, _ in here], [len(x[0]) for _, x in here], [_packed(*x) for _, x in here]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "n", "packed"])

    # The number of common buyers goes in place of the similarity, which it gives with the items' buyers.
    packed = near.select(*(F.col(c).cast("int").alias(c) for c in parts)).mapInArrow(pack, "block int, n int, packed binary").withColumn("share", _upto(n_shares))
    packed = packed.select(unit, F.lit(1), none("int"), none("array<string>"), none("array<bigint>"), "n", "packed", none("string"), none("array<int>"))
    lists = bought.withColumn("share", F.pmod(F.hash("customer_id"), F.lit(n_shares))).withColumn("block", _upto(n_blocks))
    lists = lists.select(unit, F.lit(2), none("int"), none("array<string>"), none("array<bigint>"), none("int"), none("binary"), "customer_id", "items")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, held, buyers, ready = [], [], None, False
        for kind, batch in _by_kind(batches):
            if kind == 0:
                marked.append(batch.select(["stock_code", "n_buyers"]))
            elif kind == 1:
                if buyers is None:
                    buyers = _joined(marked, "n_buyers").to_numpy()
                for n, x in zip(batch.column("n").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                    a, b, rank, n_both = _unpacked(x, 4 * n).reshape(4, n)
                    held.append((a, b.copy(), n_both / np.sqrt((buyers[a] * buyers[b]).astype(np.float64)), rank.copy()))
            else:
                if not held and not ready:
                    return
                if not ready:
                    names = _joined(marked, "stock_code")
                    seed = np.concatenate([x[0] for x in held])
                    order = np.argsort(seed, kind="stable")
                    candidate, sim, rank = (np.concatenate([x[i] for x in held])[order] for i in (1, 2, 3))
                    length = np.bincount(seed, minlength=n_items)
                    start = np.cumsum(length) - length
                    held, seed, order, ready = [], None, None, True
                at, items = _lists(batch.column("items"))
                terms = np.concatenate(([0], np.cumsum(length[items[at[0] : at[-1]]])))[at - at[0]]
                cuts = np.concatenate(([0], np.flatnonzero(np.diff(terms[1:] // TERMS)) + 1, [len(at) - 1]))
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    mine = items[at[lo] : at[hi]]
                    own, size = length[mine], np.diff(at[lo : hi + 1])
                    basket = np.repeat(np.arange(hi - lo), size)
                    place, row = _spread(start[mine], own), np.repeat(basket, own)
                    keys, said, place, term = _grouped(row * n_items + candidate[place], place)
                    who, what = keys // n_items, keys % n_items
                    free = np.ones(len(keys), bool)
                    if new_only:
                        owned = basket * n_items + mine  # ascends as the keys do
                        free = owned[np.minimum(np.searchsorted(owned, keys), max(len(owned) - 1, 0))] != keys if len(owned) else free
                    value, ranked = sim[place], rank[place]
                    for bound in bounds:
                        close = ranked <= bound
                        total = np.bincount(said[close], value[close], len(keys))
                        score = np.rint(total / size[who] * 1e10) / 1e10 if len(keys) else total
                        kept = np.flatnonzero((total > 0) & free)
                        if k is not None:
                            kept = kept[np.lexsort((-score[kept], who[kept]))]  # stable: equal scores stay by item
                            count = np.bincount(who[kept], minlength=hi - lo)
                            kept = kept[np.arange(len(kept)) - np.repeat(np.cumsum(count) - count, count) < k]
                        backed = _backers(np.repeat(mine, own)[term][close], value[close], said[close], kept, len(keys), backers) if backers else None
                        yield _told(batch, names, lo + who[kept], what[kept], bound, score[kept], backed)

    rows = marks.unionAll(packed).unionAll(lists).repartitionById(n_shares * n_blocks, "unit").sortWithinPartitions("kind", "item")
    return rows.mapInArrow(work, "customer_id string, stock_code string, bound int, score double, supporters array<string>")


def _grouped(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct keys, each term's place among them, `place` in that order, the order): terms by key, those of a key as they came."""
    if not len(key):
        return key, key, place, key
    bits = int(len(key)).bit_length()
    if int(key.max()).bit_length() + bits < 63:  # one sort of plain numbers, which is faster than one that tells the order
        both = np.sort(key << bits | np.arange(len(key)))
        key, order = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    return key[first], np.cumsum(first) - 1, place[order], order


def _backers(seed: np.ndarray, sim: np.ndarray, said: np.ndarray, kept: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(how many, items) of the owned items most like each kept candidate of n, best first; said: the candidate of each term."""
    wanted = np.full(n, -1, np.int64)
    wanted[kept] = np.arange(len(kept))
    to = wanted[said]
    seed, sim, to = seed[to >= 0], sim[to >= 0], to[to >= 0]
    order = np.lexsort((seed, -np.rint(sim * 1e12), to))
    seed, to = seed[order], to[order]
    count = np.bincount(to, minlength=len(kept))
    keep = np.arange(len(to)) - np.repeat(np.cumsum(count) - count, count) < most
    return np.minimum(count, most), seed[keep]


def _told(batch: pa.RecordBatch, names: pa.Array, row: np.ndarray, item: np.ndarray, bound: int, score: np.ndarray, backed: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    if backed is None:
        supporters = pa.nulls(len(item), pa.list_(pa.string()))
    else:
        supporters = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(backed[0]))).astype(np.int32)), names.take(pa.array(backed[1])))
    columns = [batch.column("id").take(pa.array(row)), names.take(pa.array(item)), pa.array(np.full(len(item), bound, np.int32)), pa.array(score), supporters]
    return pa.RecordBatch.from_arrays(columns, names=["customer_id", "stock_code", "bound", "score", "supporters"])
