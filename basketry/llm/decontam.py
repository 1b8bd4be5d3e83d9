"""Benchmark decontamination by spaced-seed hashing.

Words are runs of ASCII letters, digits and all non-ASCII bytes of the lower-cased
text. A document holds a passage of a benchmark item when, at some alignment, one of
the item's windows of `span` words (the whole item where it is shorter) differs from
the document in at most one word in `per_miss`. Fixed masks that ignore some places
are hashed on both sides; the masks are chosen so that every tolerated pattern of
substitutions leaves one of them untouched (checked when they are built), so the seeds
lose no such window. Hits are verified on the words around them.

The benchmark is small beside the corpus; it is shipped to the tasks in blocks of at
most `block_words` words, one map pass over the corpus a block, so what is broadcast
has a fixed bound. No shuffle of texts.

Defined cases: null or empty texts match nothing; items of fewer than `least_words` words
(any text holds those by chance) match nothing;
repeated rows give repeated results; an empty benchmark flags nothing.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import GRAM, U, mix, slabs, slices, words_of

SPAN = 12
PER_MISS = 6
#: Shorter items are no passages.
LEAST_WORDS = 3
BLOCK_WORDS = 500_000
_APART = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])


@cache
def masks(span: int, misses: int) -> tuple[tuple[int, ...], ...]:
    """Spaced seeds, as tuples of places, that no `misses` substitutions in `span` words can all hit.

    From heavy to light weights, adds the mask that rescues most of the patterns still
    uncovered until none is left; weight floor(span / (misses + 1)) always suffices.
    """
    todo = set(itertools.combinations(range(span), misses))
    heaviest = span - misses
    lightest = span // (misses + 1)
    start = max(lightest, (span * 6) // 10 - misses + 1)
    found: list[tuple[int, ...]] = []
    for weight in range(min(heaviest, start), lightest - 1, -1):
        choices = [m for m in itertools.combinations(range(span), weight) if m[0] == 0]
        while todo:
            saves = lambda m: {p for p in todo if any(not {x + o for x in m} & set(p) for o in range(span - m[-1]))}
            best = max(choices[:: max(1, len(choices) // 150)], key=lambda m: (len(saves(m)), -m[-1]))
            if not (saved := saves(best)) or len(found) >= 6 and weight > lightest:
                break
            found.append(best)
            todo -= saved
    assert not todo
    return tuple(found)


def seed_hashes(h: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(h) - mask[-1]
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, dtype=np.uint64)
    for k in mask:
        out += h[k : k + n] * GRAM[k]
    return mix(out)


class Index:
    """Seeds of benchmark items: for each mask the sorted hashes with (item, place), and a bitmap before them."""

    BITS = 22

    def __init__(self, items: list[tuple[int, str]], span: int, per_miss: int, least_words: int = LEAST_WORDS):
        blobs = [(t or "").lower().encode() for _, t in items]
        h, _, _, at = words_of(blobs, _APART)
        self.ids = [i for i, _ in items]
        self.words = [h[at[k] : at[k + 1]] for k in range(len(items))]
        self.span, self.per_miss = span, per_miss
        by_mask: dict[tuple[int, ...], list[tuple[np.ndarray, int]]] = {}
        for k, w in enumerate(self.words):
            width = min(span, len(w))
            if width >= max(1, least_words):
                for m in masks(width, width // per_miss):
                    by_mask.setdefault(m, []).append((seed_hashes(w, m), k))
        self.seeds = []
        self.bitmap = np.zeros(1 << self.BITS, dtype=bool)
        for m, parts in by_mask.items():
            hashes = np.concatenate([s for s, _ in parts])
            item = np.concatenate([np.full(len(s), k) for s, k in parts])
            place = np.concatenate([np.arange(len(s)) for s, _ in parts])
            order = np.argsort(hashes, kind="stable")
            self.bitmap[hashes >> U(64 - self.BITS)] = True
            self.seeds.append((m, hashes[order], item[order], place[order]))

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(position in h, item, place in item) of equal seeds, as arrays for each mask."""
        for m, hashes, item, place in self.seeds:
            s = seed_hashes(h, m)
            at = np.flatnonzero(self.bitmap[s >> U(64 - self.BITS)])
            lo, hi = np.searchsorted(hashes, s[at], "left"), np.searchsorted(hashes, s[at], "right")
            times = hi - lo
            k = np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())
            yield np.repeat(at, times), item[k], place[k]

    def best_window(self, h: np.ndarray, item: int, start: int) -> tuple[int, int] | None:
        """(equal words at this alignment, first word in h) if some whole window is within tolerance."""
        w = self.words[item]
        a, b = max(0, -start), min(len(w), len(h) - start)
        width = min(self.span, len(w))
        if b - a < width:
            return None
        same = np.concatenate(([0], np.cumsum(h[start + a : start + b] == w[a:b])))
        if (same[width:] - same[:-width]).max() < width - width // self.per_miss:
            return None
        return int(same[-1]), start + a

    def find(self, h: np.ndarray, at: np.ndarray) -> dict[int, dict[int, tuple[int, int]]]:
        """text index -> item -> (most equal words, first word there)."""
        out: dict[int, dict[int, tuple[int, int]]] = {}
        found = [np.zeros((0, 3), np.int64)]
        for p, item, place in self.hits(h):
            text = np.searchsorted(at, p, "right") - 1
            found.append(np.unique(np.column_stack((text, item, p - place - at[text])), axis=0))
        for text, item, start in np.unique(np.concatenate(found), axis=0).tolist():  # each alignment once
            if window := self.best_window(h[at[text] : at[text + 1]], item, start):
                best = out.setdefault(text, {})
                best[item] = max(window, best.get(item, (0, 0)))
        return out


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, span: int = SPAN, per_miss: int = PER_MISS, least_words: int = LEAST_WORDS) -> Iterator[Index]:
    """Indexes over the benchmark, each of about block_words words at most (one item may be longer)."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), r"\s+"))
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    n = -(-total // block_words) or 1
    for k in range(n):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).select("item_id", "text").collect()  # about block_words words
        yield Index([(r.item_id, r.text) for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text or ""))], span, per_miss, least_words)


def _texts(batch: pa.RecordBatch, column: int, index: Index):
    """(row, item, equal words, first word) of each match of a batch."""
    blobs = [(v or "").lower().encode() for v in batch.column(column).to_pylist()]
    for lo, hi in slabs(blobs):
        h, _, _, at = words_of(blobs[lo:hi], _APART)
        for text, items in sorted(index.find(h, at).items()):
            for item, (equal, first) in sorted(items.items()):
                yield lo + text, item, equal, first


def matches(docs: DataFrame, benchmark: DataFrame, **bounds) -> DataFrame:
    """(doc_id, item_id, n_equal, item_words, first_word), one row for each document row and item found in it."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, n_equal bigint, item_words bigint, first_word bigint"

    def one(index: Index) -> DataFrame:
        held = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for batch in slices(batches):
                ids = batch.column(0).to_pylist()
                rows = [(ids[r], index.ids[i], n, len(index.words[i]), f) for r, i, n, f in _texts(batch, 1, index)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 5)], names=["doc_id", "item_id", "n_equal", "item_words", "first_word"])

        return docs.select("doc_id", "text").mapInArrow(search, schema)

    return reduce(DataFrame.unionAll, map(one, blocks(benchmark, **bounds)))


def clean(docs: DataFrame, benchmark: DataFrame, **bounds) -> DataFrame:
    """The rows of docs that hold no benchmark passage, with all their columns."""
    for index in blocks(benchmark, **bounds):
        held = docs.sparkSession.sparkContext.broadcast(index)
        column = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch], held=held, column=column) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                bad = {r for r, *_ in _texts(batch, column, held.value)}
                yield batch.filter(pa.array([k not in bad for k in range(batch.num_rows)], pa.bool_())) if bad else batch

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
