"""Removal of word windows that an earlier document has too, by level-wise doubling.

Levels are window lengths that double up to `window` (50: 25, 50). At the first
level each document sends only its local minima: the window with the least hash among
those inside any one window of full length, so every full window holds a sent one and
equal full windows send equal ones. Windows repeated in another document survive, and
only windows that contain a survivor are tried at twice the length (where the first
doubling reaches full length, only those whose least window survived), until the full
length is reached or no candidate survives. The documents' texts meet their surviving
places once, and once more, by the same exchange, the words to remove.

Defined cases: null texts have no words; texts shorter than the window lose nothing;
rows repeated under one doc_id are one document for the comparison ("smaller doc_id" is
strict) and each keeps its row; rows without a doc_id are neither compared nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import U, as_bytes, slabs, slices, stored, windows, words_of

WINDOW = 50
FIRST = 25


def levels(window: int, first: int = FIRST) -> list[int]:
    """Window lengths from the shortest, each at most twice the one before, ending at `window`."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def least_places(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the least (the last of equals); one run where there are fewer."""
    if len(h) == 0:
        return np.zeros(0, np.int64)
    width = min(width, len(h))
    view = np.lib.stride_tricks.sliding_window_view(h, width)
    return np.arange(len(view)) + width - 1 - view[:, ::-1].argmin(axis=1)


def local_minima(h: np.ndarray, width: int) -> np.ndarray:
    return np.unique(least_places(h, width))


def first_level(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(h, doc_id, row, place): the local minima among windows of `length` words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            blobs = as_bytes(batch.column(2))
            for lo, hi in slabs(blobs):
                words, _, _, at = words_of(blobs[lo:hi])
                h = windows(words, length)
                out_h, out_r, out_p = [], [], []
                for k in range(hi - lo):
                    if at[k + 1] - at[k] >= window:
                        own = h[at[k] : at[k + 1] - length + 1]
                        p = local_minima(own, window - length + 1)
                        out_h.append(own[p])
                        out_p.append(p.astype(np.int32))
                        out_r.append(np.full(len(p), lo + k))
                if out_h:
                    r = np.concatenate(out_r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(out_h).view(np.int64)), pa.array(ids[r], pa.int64()), pa.array(rows[r], pa.int32()), pa.array(np.concatenate(out_p))],
                        names=["h", "doc_id", "row", "place"],
                    )

    return docs.mapInArrow(send, "h bigint, doc_id bigint, row int, place int")


def repeated(found: DataFrame) -> DataFrame:
    """The windows that start in at least two documents, each with the least doc_id that has it."""
    shared = found.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("h", "least")
    return found.join(stored(shared, "shared"), "h")  # stored: only a join of two plain exchanges splits a frequent window


def _packed(found: DataFrame) -> DataFrame:
    """The places of each document row in one array: (doc_id, row, at)."""
    return found.groupBy("doc_id", "row").agg(F.collect_set("place").alias("at"))  # as many as the text has words at most


def next_level(docs: DataFrame, survivors: DataFrame, length: int, target: int, minima: bool) -> DataFrame:
    """Windows of `target` words that contain a surviving window of `length` words; with minima, as their least one."""
    joined = docs.join(_packed(survivors), ["doc_id", "row"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            blobs, places = as_bytes(batch.column(2)), batch.column(3).to_pylist()
            for lo, hi in slabs(blobs):
                words, _, _, at = words_of(blobs[lo:hi])
                h, short = windows(words, target), windows(words, length)
                for k in range(hi - lo):
                    own = h[at[k] : max(at[k], at[k + 1] - target + 1)]
                    p = np.array(places[lo + k], dtype=np.int64)
                    if minima:
                        alive = np.zeros(at[k + 1] - at[k], dtype=bool)
                        alive[p] = True
                        start = np.flatnonzero(alive[least_places(short[at[k] : at[k + 1] - length + 1], target - length + 1)])
                    else:
                        mark = np.zeros(len(own) + 1, dtype=np.int32)
                        np.add.at(mark, np.clip(p - (target - length), 0, len(own)), 1)
                        np.add.at(mark, np.clip(p + 1, 0, len(own)), -1)
                        start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
                    if len(start):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(own[start].view(np.int64)), pa.array(np.full(len(start), ids[lo + k])), pa.array(np.full(len(start), rows[lo + k], dtype=np.int32)), pa.array(start.astype(np.int32))],
                            names=["h", "doc_id", "row", "place"],
                        )

    return joined.select("doc_id", "row", "text", "at").mapInArrow(extend, "h bigint, doc_id bigint, row int, place int")


def _cut_out(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, n_words, n_removed, kept_sha256) of (doc_id, row, text[, at])."""
    for batch in slices(batches):
        places = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
        n, gone, digest = [], [], []
        for raw, at in zip(as_bytes(batch.column(2)), places, strict=True):
            words = raw.split()
            n.append(len(words))
            if at is not None:
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                p = np.array(at, dtype=np.int64)
                np.add.at(mark, p, 1)
                np.add.at(mark, p + window, -1)
                words = [w for w, x in zip(words, np.cumsum(mark), strict=False) if not x]
            gone.append(n[-1] - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())],
            names=["doc_id", "row", "n_words", "n_removed", "kept_sha256"],
        )


def repeated_windows(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(doc_id, row, place): each window of `window` words that starts in a document with a smaller doc_id too.

    docs: (doc_id, row, text), row telling apart rows of one doc_id.
    """
    steps = levels(window, first)
    found = stored(first_level(docs, steps[0], window), "windows")
    for length, target in zip(steps, steps[1:], strict=False):
        found = stored(next_level(docs, repeated(found), length, target, len(steps) == 2), "windows")
    return repeated(found).where("least < doc_id").select("doc_id", "row", "place")


def with_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.hash("text").alias("row"), "text")


def dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), a row for each row of docs."""
    rows = with_rows(docs)
    schema = "doc_id bigint, row int, n_words bigint, n_removed bigint, kept_sha256 string"
    cut = lambda batches: _cut_out(batches, window)
    changed = rows.join(_packed(repeated_windows(rows, window, first)), ["doc_id", "row"]).select("doc_id", "row", "text", "at").mapInArrow(cut, schema)
    changed = changed.distinct().select("doc_id", "row", F.col("n_removed").alias("gone"), F.col("kept_sha256").alias("left_over"))
    whole = rows.mapInArrow(cut, schema)
    return whole.join(changed, ["doc_id", "row"], "left").select(
        "doc_id", "n_words", F.coalesce("gone", "n_removed").alias("n_removed"), F.coalesce("left_over", "kept_sha256").alias("kept_sha256")
    )
