"""Source divergence audit: how far apart the sources of a language are in their terms.

The occurrences of terms by group (a language's source) are a sparse matrix. Tasks count
their texts first, so what is exchanged follows distinct (language, source, term) triples
of a task, however hot a source is. Pairs of sources meet in blocks: sources and terms are
dealt to row and column blocks by hashes, a pair of row blocks and a column block is one
task's work, and the number of blocks follows the sources and terms counted.

A block is a k²-tree with k = 2: a bitmap a level tells which quadrants hold occurrences,
leaves are tiles of TILE x TILE cells. Two row blocks are walked jointly, from the root:
where both quadrants are empty, every cell of a source has the same price, so the columns
are only counted, for all its pairs of sources at once; other quadrants are split, down
to tiles whose divergences are summed cell by cell.

All arithmetic is on whole numbers: prices are floor(SCALE * (count + 2) / (N + 2V)) + 1,
divergences floor((p - q)² / (p + q)).

Defined cases: null text, lang and source are ''; a group without terms takes part with
every count 0; a language without kept terms has pairs of value 0 and no terms; a
language of one source has no pairs; repeated rows count each; an empty table gives no
rows; other columns aren't looked at.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import as_bytes, buckets, slices, small, stored

SCALE = 1_000_000_000
LEAST_DOCS = 10
TOP_TERMS = 10
#: Sources and terms of a block, in the mean.
ROWS, COLS = 64, 4096
TILE = 8
#: Tiles that are compared at once.
SLAB_TILES = 512
#: Triples that a task counts before it hands them on.
HELD_TRIPLES = 400_000
#: A table of groups with more rows isn't broadcast.
FEW_GROUPS = 50_000

_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and rows; a null term stands for the group itself. Several rows a triple, one or a few from each task."""

    def told(held: dict[tuple[str, str], tuple[Counter, Counter, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, in_docs, rows) in held.items():
            size = len(n) + 1
            terms = pa.array([*n, None], pa.binary()).cast(pa.string())
            counts = np.fromiter(itertools.chain(n.values(), (0,)), dtype=np.int64, count=size)
            with_term = np.fromiter(itertools.chain(map(in_docs.__getitem__, n), (rows,)), dtype=np.int64, count=size)
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), size), pa.repeat(pa.scalar(source, pa.string()), size), terms, pa.array(counts), pa.array(with_term)], names=["lang", "source", "term", "n", "docs"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter, int]] = {}
        for batch in slices(batches, 200):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                found = _TERM.findall(text.lower())  # bytes: A-Z alone are lowered
                n, in_docs, rows = held.get((lang or "", source or "")) or (Counter(), Counter(), 0)
                n.update(found)
                in_docs.update(set(found))
                held[lang or "", source or ""] = (n, in_docs, rows + 1)
            if sum(len(n) for n, _, _ in held.values()) > HELD_TRIPLES:
                yield from told(held)
                held = {}
        yield from told(held)

    return docs.select("lang", "source", "text").mapInArrow(work, COUNTS)


def price(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * terms)), exactly."""
    wide = lambda c: c.cast("decimal(20,0)")
    scaled = F.lit(SCALE).cast("decimal(10,0)") * (wide(count) + 2)
    return F.call_function("div", scaled, wide(total) + 2 * wide(terms)) + 1


def matrix(docs: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """(cells, groups). Cells: (lang, source, term, n, lang_n, lead, p) of kept terms that occur, lead true once a term. Groups: (lang, source, total, lang_total, terms, sources, zero), zero the price of a count of 0.

    One exchange by (lang, term) serves the sums, the choice of kept terms and the language's counts.
    """
    spark = docs.sparkSession
    dealt = term_counts(docs).repartition(buckets(spark), "lang", "term")
    whole = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    same = Window.partitionBy("lang", "term")
    judged = whole.withColumn("lang_docs", F.sum("docs").over(same)).withColumn("lang_n", F.sum("n").over(same))
    judged = judged.withColumn("lead", (F.row_number().over(same.orderBy("source")) == 1) & F.col("term").isNotNull())
    kept = stored(judged.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select("lang", "source", "term", "n", "lang_n", "lead"), "terms")
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("lead").alias("led"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("led").alias("terms"), F.count("*").alias("sources"))
    groups = groups.drop("led").join(langs, "lang")  # a row for each source of a language
    groups = stored(groups.withColumn("zero", F.when(F.col("terms") > 0, price(F.lit(0), F.col("total"), F.col("terms"))).otherwise(1)), "groups")
    cells = kept.where("term IS NOT NULL").join(small(groups, FEW_GROUPS), ["lang", "source"])
    return cells.withColumn("p", price(F.col("n"), F.col("total"), F.col("terms"))), groups


class Tree:
    """The k²-tree of one row block: bitmaps of the quadrants that hold something, from the root down, and the tiles of prices."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, prices: np.ndarray, zero: np.ndarray, width: int, side: int):
        self.zero, self.width = zero, width
        self.depth = (-(-max(side, 1) // TILE) - 1).bit_length()
        tiles = np.zeros((-(-len(zero) // TILE), max(1, -(-width // TILE))), dtype=bool)
        tiles[rows // TILE, cols // TILE] = True
        self.levels = [tiles]
        while len(self.levels) <= self.depth:
            low = self.levels[0]
            low = np.pad(low, [(0, low.shape[0] % 2), (0, low.shape[1] % 2)])
            self.levels.insert(0, low[::2, ::2] | low[1::2, ::2] | low[::2, 1::2] | low[1::2, 1::2])
        at = np.argwhere(tiles)
        self.place = np.full(tiles.shape, -1)
        self.place[tiles] = np.arange(len(at))
        # Leaves, and after them one tile for each row of tiles that holds nothing.
        padded = np.ones(tiles.shape[0] * TILE, dtype=np.int64)
        padded[: len(zero)] = zero
        by_row = np.broadcast_to(padded.reshape(-1, TILE, 1), (tiles.shape[0], TILE, TILE))
        self.leaves = np.concatenate((by_row[at[:, 0]], by_row))
        self.leaves[self.place[rows // TILE, cols // TILE], rows % TILE, cols % TILE] = prices
        self.empty = len(at)

    def tiles_of(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        found = self.place[row, col]
        return self.leaves[np.where(found >= 0, found, self.empty + row)]


def joint(a: Tree, b: Tree) -> np.ndarray:
    """(rows of a, rows of b): the summed divergences over all columns of two trees of equal sides; of a tree and itself only where the column isn't left of the row."""
    out = np.zeros((a.levels[-1].shape[0] * TILE, b.levels[-1].shape[0] * TILE), dtype=np.int64)
    empty = np.zeros_like(out)  # columns where both have nothing
    ra = rb = c = np.zeros(1, dtype=np.int64)
    depth = a.depth
    for level in range(depth + 1):
        size = TILE << (depth - level)
        la, lb = a.levels[level - depth - 1], b.levels[level - depth - 1]
        full = la[ra, c] | lb[rb, c]
        wide = np.minimum(size, a.width - c * size)
        bare = np.zeros((la.shape[0], lb.shape[0]), dtype=np.int64)
        np.add.at(bare, (ra[~full], rb[~full]), wide[~full])
        empty += np.repeat(np.repeat(bare, size, axis=0)[: len(out)], size, axis=1)[:, : out.shape[1]]
        ra, rb, c = ra[full], rb[full], c[full]
        if level < depth:  # split into the quadrants' quadrants that lie inside the matrix
            na, nb = a.levels[level - depth], b.levels[level - depth]
            step = np.arange(8)
            ra, rb, c = ((2 * x[:, None] + (step >> k & 1)).ravel() for x, k in ((ra, 0), (rb, 1), (c, 2)))
            inside = (ra < na.shape[0]) & (rb < nb.shape[0]) & (c < na.shape[1]) & ((ra <= rb) | (a is not b))
            ra, rb, c = ra[inside], rb[inside], c[inside]
    lane = np.arange(TILE)
    for lo in range(0, len(c), SLAB_TILES):
        i, j, k = ra[lo : lo + SLAB_TILES], rb[lo : lo + SLAB_TILES], c[lo : lo + SLAB_TILES]
        p, q = a.tiles_of(i, k)[:, :, None, :], b.tiles_of(j, k)[:, None, :, :]
        f = (p - q) ** 2 // (p + q) * (k[:, None] * TILE + lane < a.width)[:, None, None, :]
        np.add.at(out, ((i[:, None, None] * TILE + lane[:, None]), (j[:, None, None] * TILE + lane)), f.sum(axis=3))
    za, zb = (np.concatenate((t.zero, np.ones(n - len(t.zero), dtype=np.int64))) for t, n in ((a, out.shape[0]), (b, out.shape[1])))
    out += empty * ((za[:, None] - zb) ** 2 // (za[:, None] + zb))
    return out[: len(a.zero), : len(b.zero)]


def _block(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
    """One pair of row blocks over one column block: (lang, a, b, value) for its pairs of sources."""
    lang, low, high = (k.as_py() for k in key[:3])
    term = block.column("term")
    cells, groups = block.filter(term.is_valid()), block.filter(term.is_null())
    col = {t: i for i, t in enumerate(sorted(cells.column("term").unique().to_pylist()))}
    in_block = lambda part, mark: part.filter(pc.equal(part.column("row_block"), mark))
    zeros = {mark: dict(zip(x.column("source").to_pylist(), x.column("p").to_pylist(), strict=True)) for mark in sorted({low, high}) for x in [in_block(groups, mark)]}
    # Kept terms of this column block that neither row block has are columns too, empty ones.
    width = pc.max(groups.column("width")).as_py() or 0
    side = max(width, *map(len, zeros.values()))
    trees = []
    for mark, zero in zeros.items():
        sources = sorted(zero)
        row = {s: i for i, s in enumerate(sources)}
        held = in_block(cells, mark)
        rows = np.array([row[s] for s in held.column("source").to_pylist()], dtype=np.int64)
        cols = np.array([col[t] for t in held.column("term").to_pylist()], dtype=np.int64)
        trees.append((sources, Tree(rows, cols, held.column("p").to_numpy(), np.array([zero[s] for s in sources], dtype=np.int64), width, side)))
    (left, a), (right, b) = trees[0], trees[-1]
    sums = joint(a, b)
    i, j = np.triu_indices(len(left), 1) if low == high else (x.ravel() for x in np.indices(sums.shape))
    return pa.table({"lang": pa.array([lang] * len(i), pa.string()), "a": pa.array([left[x] for x in i], pa.string()), "b": pa.array([right[x] for x in j], pa.string()), "value": pa.array(sums[i, j], pa.int64())})


def pair_sums(cells: DataFrame, groups: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """(lang, a, b, value) of every unordered pair of sources of a language."""
    parts = lambda n, size: F.greatest(F.lit(1), F.ceil(n / size)).cast("bigint")
    ahead = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    row_block = F.pmod(F.xxhash64("source"), parts(F.col("sources"), rows)).alias("row_block")
    col_block = F.pmod(F.xxhash64("term"), parts(F.col("terms"), cols)).alias("col_block")
    held = cells.select("lang", "source", "term", "p", "sources", row_block, col_block)
    every = groups.where("sources > 1").select("lang", "source", F.lit(None).cast("string").alias("term"), F.col("zero").alias("p"), "sources", row_block, F.explode(ahead(parts(F.col("terms"), cols))).alias("col_block"))
    widths = cells.where("lead").groupBy("lang", col_block).agg(F.count("*").alias("width"))  # a row for each column block
    every = every.join(small(widths, FEW_GROUPS), ["lang", "col_block"], "left")
    both = held.where("sources > 1").unionByName(every, allowMissingColumns=True).withColumn("other", F.explode(ahead(parts(F.col("sources"), rows))))
    keyed = both.select("lang", F.least("row_block", "other").alias("low"), F.greatest("row_block", "other").alias("high"), "col_block", "row_block", "source", "term", "p", "width")
    summed = keyed.groupBy("lang", "low", "high", "col_block").applyInArrow(_block, "lang string, a string, b string, value bigint")
    return summed.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): each other source by its distance, and the terms a source has more of than its language."""
    cells, groups = matrix(docs, least_docs)
    sums = pair_sums(cells, groups)
    turned = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))
    pairs = sums.select("lang", F.explode(turned).alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")
    p, q = F.col("p"), F.col("q")
    over = cells.where("n > 0").withColumn("q", price(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).where(p > q)
    terms = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).unionAll(ranked(terms).where(F.col("rank") <= top_terms))


#: The audit with its production parameters in ANSI SQL.
AUDIT_SQL = r"""
WITH words AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
kept AS (SELECT lang, term, count(*) AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10),
grp AS (SELECT DISTINCT coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
cnt AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
tot AS (SELECT lang, source, sum(n) AS total FROM cnt GROUP BY lang, source),
size AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(t.total, 0) + 2 * s.v) AS p, 1 + (1000000000::HUGEINT * (k.lang_n + 2)) // (s.lang_total + 2 * s.v) AS q
  FROM grp g JOIN kept k ON g.lang = k.lang JOIN size s ON g.lang = s.lang LEFT JOIN tot t ON g.lang = t.lang AND g.source = t.source LEFT JOIN cnt c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) FROM p x JOIN p y ON x.term = y.term WHERE x.lang = a.lang AND y.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
every AS (SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every) WHERE part = 'pair' OR rank <= 10
"""
