"""Fill-in-the-middle transformation with content-defined chunks.

A text's cuts lie at line ends, so what must be known of it is how many lines and code
points lie before each place, and whether a sentinel stands in it. A rolling hash over
the last 32 bytes cuts every text into chunks by content, so passages that documents
share become equal chunks wherever they stand. Each chunk has a summary (bytes, code
points, line ends, whether it holds a sentinel, its first and last bytes); a cache keyed
by the chunk itself, so that a hit is an equal chunk and not just an equal hash, spares
the second reading. Summaries add up: sums along a text tell the chunk that holds the
wanted line end, and only this chunk is searched; first and last bytes tell a sentinel
that lies across chunks. A map stage without exchange; the cache is bounded in bytes.

`transform` gives the texts, `restore` rebuilds them from output and form alone.

Defined cases: null text is empty and plain; a null id counts as an empty one; a text of
one line without a line end has one unit; rows are transformed by their id alone, so
repeated rows give repeated results; other columns aren't looked at.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import as_bytes, slabs, slices

SENTINELS = ("<P>", "<S>", "<M>")
LEAST_CHUNK, MOST_CHUNK = 128, 4096
#: A place is a cut where this many leading bits of its hash are 0: a chunk has 2^CUT_BITS bytes beyond the least in the mean.
CUT_BITS = 7
CACHE_BYTES = 32_000_000
PLAIN, PSM, SPM = "plain", "psm", "spm"

_GEAR = np.random.Generator(np.random.PCG64(11)).integers(0, 2**32, size=256, dtype=np.uint32)
_INSIDE = bytes(range(0x80, 0xC0))


def rolling(buf: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 32 bytes that end at each place, by doubling the width."""
    h = _GEAR[buf]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def chunk_ends(places: list[int], n: int) -> Iterator[int]:
    """Ends of the chunks of n bytes: the cuts among places that leave no chunk too short; too long ones are cut evenly."""
    at = 0
    for end in (*places, n):
        while end - at > MOST_CHUNK:
            at += MOST_CHUNK
            yield at
        if end - at >= LEAST_CHUNK or end == n > at:
            yield end
            at = end


def code_points(b: bytes) -> int:
    return len(b.translate(None, _INSIDE))


class Summary(NamedTuple):
    size: int
    chars: int
    lines: int
    marked: bool
    head: bytes
    tail: bytes


class Reader:
    """Summaries of chunks, kept by content; the older half is dropped when the newer one is full."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS, most: int = CACHE_BYTES):
        self.marks = [s.encode() for s in sentinels]
        self.edge = max(map(len, self.marks)) - 1
        self.most, self.held = most, 0
        self.young: dict[bytes, Summary] = {}
        self.old: dict[bytes, Summary] = {}

    def read(self, chunk: bytes) -> Summary:
        return Summary(len(chunk), code_points(chunk), chunk.count(b"\n"), any(m in chunk for m in self.marks), chunk[: self.edge], chunk[-self.edge :])

    def summary(self, chunk: bytes) -> Summary:
        found = self.young.get(chunk)
        if found is None:
            found = self.old.get(chunk) or self.read(chunk)
            if self.held > self.most // 2:
                self.old, self.young, self.held = self.young, {}, 0
            self.young[chunk] = found
            self.held += len(chunk) + 200
        return found

    def spans(self, before: bytes, after: Summary) -> bool:
        """Whether a sentinel lies across the end of `before`, the last bytes so far."""
        return any(m in before + after.head for m in self.marks)


class Text:
    """A text's chunks with their summaries added up."""

    def __init__(self, data: bytes, ends: list[int], reader: Reader):
        self.data, self.starts = data, [0, *ends]
        parts = [reader.summary(data[a:b]) for a, b in itertools.pairwise(self.starts)]
        self.lines = list(itertools.accumulate(p.lines for p in parts))
        self.chars = [0, *itertools.accumulate(p.chars for p in parts)]
        self.marked, tail = False, b""
        for p in parts:
            self.marked = self.marked or p.marked or reader.spans(tail, p)
            tail = (tail + p.tail)[-reader.edge :]
        self.units = (self.lines[-1] if parts else 0) + (bool(tail) and not tail.endswith(b"\n"))

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the end of the first `unit` units."""
        if unit == self.units:
            return len(self.data), self.chars[-1]
        if not unit:
            return 0, 0
        k = bisect.bisect_left(self.lines, unit)
        at = self.starts[k]
        for _ in range(unit - (self.lines[k - 1] if k else 0)):
            at = self.data.index(b"\n", at) + 1
        return at, self.chars[k] + code_points(self.data[self.starts[k] : at])


def texts(blobs: list[bytes], reader: Reader) -> Iterator[Text]:
    for lo, hi in slabs(blobs):
        part = blobs[lo:hi]
        buf = np.frombuffer(b"".join(part), dtype=np.uint8)
        ends = np.cumsum([len(b) for b in part])
        places = np.flatnonzero(rolling(buf) >> np.uint32(32 - CUT_BITS) == 0) + 1 if len(buf) else np.zeros(0, np.int64)
        first = 0
        for blob, end, upto in zip(part, ends.tolist(), np.searchsorted(places, ends).tolist(), strict=True):
            own = places[first:upto] - (end - len(blob))
            # A hash that reaches into the text before counts for nothing: it lies within the least chunk.
            yield Text(blob, list(chunk_ends(own.tolist(), len(blob))), reader)
            first = upto


class Fim(NamedTuple):
    """How often (per cent) texts are transformed and in suffix-first order, by hashes of `seed`:id."""

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    sentinels: tuple[str, str, str] = SENTINELS


def rearranged(doc_id: object, text: Text, how: Fim) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix and the middle, output)."""
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    if not text.data or text.marked or h3 % 100 >= how.rate:
        return text.units, PLAIN, None, None, text.data
    low, high = sorted((h1 % (text.units + 1), h2 % (text.units + 1)))
    (a, chars_a), (b, chars_b) = text.cut(low), text.cut(high)
    pre, suf, mid = (s.encode() for s in how.sentinels)
    prefix, middle, suffix = text.data[:a], text.data[a:b], text.data[b:]
    form = SPM if h4 % 100 < how.suffix_first else PSM
    out = (suf, suffix, pre, prefix, mid, middle) if form == SPM else (pre, prefix, suf, suffix, mid, middle)
    return text.units, form, chars_a, chars_b - chars_a, b"".join(out)


def transform(docs: DataFrame, how: Fim = Fim(), text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(how.sentinels)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        for batch in slices(batches):
            rows = [rearranged(i, t, how) for i, t in zip(batch.column(0).to_pylist(), texts(as_bytes(batch.column(1)), reader), strict=True)]
            columns = [pa.array([r[k] if k < 4 else r[k].decode() for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(work, f"`{id_col}` {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restore(transformed: DataFrame, how: Fim = Fim()) -> DataFrame:
    """Adds `restored`, the text rebuilt from output and form: no text that is cut holds a sentinel."""
    pre, suf, mid = how.sentinels

    def parts(first: str, second: str) -> F.Column:
        body = F.expr(f"substring(output, {len(first) + 1})")
        return F.split(body, f"{re.escape(second)}|{re.escape(mid)}", -1)

    psm, spm = parts(pre, suf), parts(suf, pre)
    whole = F.when(F.col("form") == PSM, F.concat(psm[0], psm[2], psm[1])).when(F.col("form") == SPM, F.concat(spm[1], spm[2], spm[0])).otherwise(F.col("output"))
    return transformed.withColumn("restored", whole)


#: The transformation with its production parameters in ANSI SQL.
DIGEST_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
cut AS (SELECT *, string_split(t, chr(10)) AS parts, length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND NOT ends_with(t, chr(10)) THEN 1 ELSE 0 END AS n FROM docs),
dice AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS k1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS k2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
ends AS (SELECT *, CASE WHEN least(k1, k2) = 0 THEN '' WHEN least(k1, k2) < len(parts) THEN array_to_string(parts[1:least(k1, k2)], chr(10)) || chr(10) ELSE t END AS low,
  CASE WHEN greatest(k1, k2) = 0 THEN '' WHEN greatest(k1, k2) < len(parts) THEN array_to_string(parts[1:greatest(k1, k2)], chr(10)) || chr(10) ELSE t END AS high FROM dice),
split AS (SELECT *, substr(high, length(low) + 1) AS middle, substr(t, length(high) + 1) AS suffix FROM ends)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(low) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || low || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || low || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM split
"""
