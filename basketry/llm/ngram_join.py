"""N-gram Jaccard self-join over a count-vector R-tree, down to linked groups of documents.

Word shingles are hashed into groups and a document is the point of its group counts.
Two directory levels replace the tree's root, since boxes over random counts overlap
everywhere. The first is the size class: linked sets differ in at most
(1 - t) / t of the smaller one's size, d shingles. The second cuts the groups into d + 1
blocks and a few spare: d differing shingles leave blocks of counts equal, so a directory entry is
the box of all points with just these counts in one block (a "cell"), and linked points
share a cell. Leaves hold the coarse count vector; a pair is kept if the sum of
coordinate minima can reach the overlap its sizes ask for.

Equal sets are one node from the start. Only linked groups are wanted, so no task ever
sends pairs: inside a cell the bounds join members to a forest (at most members - 1
rows), the components of all forests are crowds that a link can't leave. In a crowd each
node's finer vector, whose length follows its set, bounds again and splits it, and each
node's text travels once, compressed, to what is left, where exact overlaps from postings
of its shingles give the forest of true links.

A key (cell or crowd) above the limit is dealt to parts, each with the key's least
member beside its own. What the parts leave apart from the key's largest group is then
compared with all of the key, block by block; so a large group that hangs together costs
two passes, and only members that are alike but not linked cost the square.

Mappers gather entries, keep one per cell and send packed arrays, one row for each
bucket, so a cell shared by many documents reaches a task a few times. An entry takes
about 7 bytes: cells are sorted and coded by their gaps, nodes go by a short name.

Passages that many documents share make cells that grow with the corpus. The spare
blocks let each node stay out of as many of its cells as it has room, most shared first
(see room): so nodes with no more than such passages in common don't meet.

Defined cases: null texts and texts without words have an empty set and stay alone;
fewer words than a shingle make one shingle; rows repeated under one doc_id are rows of
one node each and keep their row; rows without a doc_id link with nothing; other columns
aren't looked at. Two sets with one 64-bit name are told apart by a second hash and get
names of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import U, as_bytes, buckets, mix, pieces, shingle_sets, slices, small, spare_name, stored
from basketry.llm.components import components

#: Each size class reaches to this multiple of its lower end.
CLASS_STEP = 1.5
#: Shingle groups of the fine count vector, and coordinates of the coarse one in the leaves.
GROUP_BITS = 44
COARSE = 64
#: Members of a cell that one unit of work compares, and shingles of a crowd's sets.
UNIT = 1024
UNIT_SHINGLES = 1 << 18
#: Shingles whose cells meet in one bucket, about.
BUCKET_SHINGLES = 1 << 21
#: Cell entries that a task gathers, each cell once, before it sends them on.
PACKED_ENTRIES = 1_000_000
PACKED_NODES_BITS = 16
PACKED_NODES = 1 << PACKED_NODES_BITS
#: The bits of a node's name that go with its cells.
SHORT = (1 << 31) - 1
#: Sets whose 64-bit names clash that are told to all tasks at most.
MOST_CLASHES = 10_000
#: Ids of documents that are broadcast at once at most; with more than a few times as many the texts are exchanged.
MOST_BROADCAST = 500_000
#: Points under one box.
LEAF = 64


def size_class(n: int) -> int:
    return int(math.log(max(n, 1)) / math.log(CLASS_STEP) + 1e-9)


@cache
def blocks_of_class(c: int, t: Fraction) -> tuple[int, int]:
    """(blocks, spare) for pairs whose smaller set is in class c.

    d shingles at most differ in a linked pair; d + 1 + spare blocks leave 1 + spare of
    them equal. spare is what a set may have of empty blocks, with few exceptions.
    """
    d = int(Fraction(math.ceil(CLASS_STEP ** (c + 1))) * (1 - t) / t)
    spare, least = 0, CLASS_STEP**c
    while spare <= d:
        empty = (d + 1 + spare) * math.exp(-least / (d + 1 + spare))
        if spare >= empty + 2 * math.sqrt(empty):
            break
        spare += 1
    return d + 1 + spare, spare


def cell_keys(s: np.ndarray, t: Fraction) -> Iterator[np.ndarray]:
    """The cells of one set of sorted shingle hashes, for its class and those of possible smaller partners.

    Of a set with no more empty blocks than spare ones only the others count: whatever
    it is linked to has one of them equal too. So no cell gathers all sets with a gap.
    """
    n = len(s)
    weight = np.concatenate(([U(0)], np.cumsum(mix(s >> U(64 - GROUP_BITS)))))  # adds up to a hash of the counts by group
    for c in range(size_class(max(1, math.ceil(n * t))), size_class(n) + 1):
        k, spare = blocks_of_class(c, t)
        edges = np.searchsorted(s, np.arange(1, k, dtype=np.uint64) * U((2**64 - 1) // k))
        at = np.concatenate(([0], edges, [n]))
        counts = np.diff(at).astype(np.uint64)
        keys = mix(weight[at[1:]] - weight[at[:-1]] + counts * U(0xD6E8FEB86659FD93) + np.arange(k, dtype=np.uint64) * U(0xA0761D6478BD642F) + U(c))
        yield keys[counts > 0] if np.count_nonzero(counts == 0) <= spare else keys


def signature(s: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """A name of `bits` bits for a set of shingle hashes, and a second hash that tells apart sets of one name."""
    total = np.array([int(np.sum(mix(s))) + len(s) * 0x9E3779B97F4A7C15 & 2**64 - 1, int(np.sum(mix(s ^ U(0xA0761D6478BD642F)))) & 2**64 - 1], dtype=np.uint64)
    name, check = (int(x) for x in mix(total).view(np.int64))
    return (name if bits == 64 else name & (1 << bits) - 1), check


def coarse_vector(s: np.ndarray) -> bytes:
    """Counts by coarse group, one byte each; 255 stands for that or more."""
    return np.minimum(np.bincount((mix(s) >> U(58)).astype(np.int64), minlength=COARSE), 255).astype(np.uint8).tobytes()


def fine_vector(s: np.ndarray) -> bytes:
    """Counts by a power of two of groups, 64 at least and one for each 8 to 16 shingles: where sets are large a coarse vector bounds nothing."""
    bits = max(6, (len(s) // 8).bit_length() - 1)
    return np.minimum(np.bincount((mix(s) >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bound on the overlap of points a[i] and b[j]: the sum of coordinate minima (full bytes bound nothing)."""
    least = np.minimum(a[:, None, :], b[None, :, :]).sum(axis=2, dtype=np.int64)
    return np.where((a == 255).any(axis=1)[:, None] & (b == 255).any(axis=1)[None, :], 1 << 40, least)


def may_link(na: np.ndarray, va: np.ndarray, nb: np.ndarray, vb: np.ndarray, t: Fraction) -> np.ndarray:
    """Pairs (i, j) for which sizes and count vectors allow a Jaccard similarity of t."""
    p, q = t.numerator, t.denominator
    a, b = na[:, None].astype(np.int64), nb[None, :].astype(np.int64)
    sizes = (q * np.minimum(a, b) >= p * np.maximum(a, b)) & (a > 0)
    if not sizes.any():
        return sizes
    return sizes & ((p + q) * most_overlap(va, vb) >= p * (a + b))


def linked(a: np.ndarray, b: np.ndarray, t: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and t.denominator * both >= t.numerator * (len(a) + len(b) - both)


def nodes(docs: DataFrame, size: int, t: Fraction, bits: int = 64) -> DataFrame:
    """(doc_id, n, sig, check, vec, fine, room) of each row's shingle set."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, sig, vec, fine, rooms = [], [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(1), lower=True), size):
                n.append(len(s))
                sig.append(signature(s, bits))
                vec.append(coarse_vector(s))
                fine.append(fine_vector(s) if len(s) >= 16 * COARSE else vec[-1])
                rooms.append(room(s, t))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array([x for x, _ in sig], pa.int64()), pa.array([x for _, x in sig], pa.int64()), pa.array(vec, pa.binary()), pa.array(fine, pa.binary()), pa.array(rooms, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "sig", "check", "vec", "fine", "room"])

    return docs.select("doc_id", "text").mapInArrow(name, "doc_id bigint, n bigint, sig bigint, check bigint, vec binary, fine binary, room int")


def clashes(named: DataFrame) -> dict[tuple[int, int], int]:
    """New names, by (sig, check), of the different sets that share a 64-bit name: hardly ever any."""
    found = named.groupBy("sig").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("sig")
    rows = named.join(found, "sig").select("sig", "check").distinct().limit(MOST_CLASHES + 1).collect()
    if len(rows) > MOST_CLASHES:
        raise ValueError("too many shingle sets share a name")
    return {(r.sig, r.check): r.check for r in rows}


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start of each run of equal sorted keys, its length)."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return start, np.diff(np.concatenate((start, [len(keys)])))


def _sorted_entries(keys: np.ndarray, sigs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((sigs, keys))
    keys, sigs = keys[order], sigs[order]
    keep = np.concatenate(([True], (keys[1:] != keys[:-1]) | (sigs[1:] != sigs[:-1]))) if len(keys) else np.zeros(0, bool)
    return keys[keep], sigs[keep]


def room(s: np.ndarray, t: Fraction) -> int:
    """How many of its cells one set may leave out, if all sets leave out their most shared ones.

    Linked sets have 1 + spare equal blocks of their class, of which no more are empty
    than either has empty ones. So they share 1 + (spare - empty) cells at least, and of
    those the one that fewest share is left out by neither. One more stays, for two cells
    of a set that have one name.
    """
    most, n = len(s), len(s)
    for c in range(size_class(max(1, math.ceil(n * t))), size_class(n) + 1) if n else ():
        k, spare = blocks_of_class(c, t)
        block = np.minimum(s // U((2**64 - 1) // k), U(k - 1))
        most = min(most, spare - k + 1 + int(np.count_nonzero(block[1:] != block[:-1])) - 1)
    return max(0, most)


def sorted_bytes(x: np.ndarray) -> bytes:
    """Sorted numbers in about 2 bits more than the logarithm of their mean gap: low bits as they are, high ones as places of set bits."""
    y, k = x - x[0], len(x)
    r = max(0, (int(y[-1]) // k).bit_length() - 1)
    low = y.view(np.uint8).reshape(k, 8)
    rest = np.packbits(np.unpackbits(low[:, r // 8, None], axis=1, bitorder="little")[:, : r % 8])
    at = (y >> U(r)).astype(np.int64) + np.arange(k)
    high = np.zeros(at[-1] + 1, np.uint8)
    high[at] = 1
    return x[:1].tobytes() + bytes([r]) + low[:, : r // 8].tobytes() + rest.tobytes() + np.packbits(high).tobytes()


def sorted_numbers(data: bytes, k: int) -> np.ndarray:
    """What sorted_bytes had: k numbers."""
    raw, r = np.frombuffer(data, np.uint8), data[8]
    low = np.zeros((k, 8), np.uint8)
    at, end = 9 + k * (r // 8), 9 + k * (r // 8) + (k * (r % 8) + 7) // 8
    low[:, : r // 8] = raw[9:at].reshape(k, r // 8)
    if r % 8:
        bits = np.unpackbits(raw[at:end], count=k * (r % 8)).reshape(k, r % 8)
        low[:, r // 8] = np.packbits(bits, axis=1, bitorder="little")[:, 0]
    high = np.flatnonzero(np.unpackbits(raw[end:]))[:k] - np.arange(k)
    return low.view(np.uint64)[:, 0] + (high.astype(np.uint64) << U(r)) + np.frombuffer(data, np.uint64, 1)


def shared_cells(docs: DataFrame, size: int, t: Fraction, names: dict[tuple[int, int], int], shingles: int, bits: int = 64) -> DataFrame:
    """(cell, total, x, y, shorts): every cell that holds more than one node, in one row with its nodes' short names, each once.

    Cells are named by some bits more than tell apart all entries, nodes by 31 bits.
    Where two have one name a cell holds a few nodes more, and none less: see crowds
    for nodes of one short name. x and y tell the same members.
    """
    n_buckets = max(8 * buckets(docs.sparkSession), shingles // BUCKET_SHINGLES)
    name_bits = min(48, max(32, int(shingles).bit_length() + 14))

    def packed(keys: list[np.ndarray], sigs: list[int]) -> Iterator[pa.RecordBatch]:
        place = np.repeat(np.arange(len(keys), dtype=np.uint64), [len(x) for x in keys])
        both = np.sort((np.concatenate(keys) >> U(64 - name_bits) << U(PACKED_NODES_BITS)) | place)
        both = both[np.concatenate(([True], both[1:] != both[:-1]))]
        k, s = both >> U(PACKED_NODES_BITS), np.array(sigs, np.int32)[(both & U(PACKED_NODES - 1)).astype(np.int64)]
        start, length = _runs(k)
        multi = np.repeat(length > 1, length)
        # One entry a cell goes on; cells shared within the entries at hand are told at once.
        for known, (kk, ss) in enumerate(((k[start], s[start]), (k[multi], s[multi]))):
            bucket = ((kk >> U(name_bits - 32)) * U(n_buckets) >> U(32)).astype(np.int32)
            at, count = _runs(bucket)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[at]),
                        pa.array(np.full(len(at), bool(known))),
                        pa.array([sorted_bytes(kk[i : i + c]) for i, c in zip(at, count, strict=True)], pa.binary()),
                        pa.array([ss[i : i + c].tobytes() for i, c in zip(at, count, strict=True)], pa.binary()),
                    ],
                    names=["bucket", "known", "cells", "shorts"],
                )

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sigs, held, seen = [], [], 0, set()
        for s in (s for part in slices(batches) for s in shingle_sets(as_bytes(part.column(0), lower=True), size)):
            sig = signature(s, bits)
            sig = names.get(sig, sig[0])
            if not len(s) or sig in seen:
                continue
            seen.add(sig)
            keys.append(np.concatenate(list(cell_keys(s, t))))
            sigs.append(sig & SHORT)
            held += len(keys[-1])
            if held > PACKED_ENTRIES or len(keys) == PACKED_NODES:
                yield from packed(keys, sigs)
                keys, sigs, held, seen = [], [], 0, set()
        if keys:
            yield from packed(keys, sigs)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows):
            out = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))]
            for known in (False, True):
                own = [r for r in rows if r[0] == known]
                if own:
                    k = np.concatenate([sorted_numbers(r[1], len(r[2]) // 4) for r in own])
                    s = np.frombuffer(b"".join(r[2] for r in own), dtype=np.int32)
                    if not known:
                        order = np.argsort(k)
                        k, s = k[order], s[order]
                        _, length = _runs(k)
                        multi = np.repeat(length > 1, length)
                        k, s = k[multi], s[multi]
                    out.append((k, s))
            k, s = _sorted_entries(np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out]))
            _, length = _runs(k)
            multi = np.repeat(length > 1, length)
            k, s = k[multi], s[multi]
            start, length = _runs(k)
            h = s.astype(np.uint64)
            x, y = (np.add.reduceat(mix(h * U(2) + U(i)), start).view(np.int64) if len(start) else np.zeros(0, np.int64) for i in (0, 1))
            shorts = pa.ListArray.from_arrays(pa.array(np.append(start, len(k)).astype(np.int32)), pa.array(s))
            return pa.RecordBatch.from_arrays([pa.array(k[start].view(np.int64)), pa.array(length.astype(np.int64)), pa.array(x), pa.array(y), shorts], names=["cell", "total", "x", "y", "shorts"])

        held, now = [], None
        for batch in batches:  # sorted by bucket: one bucket at a time is in memory
            for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield told(held)
                    held = []
                now = bucket
                held.append(row)
        if held:
            yield told(held)

    sent = docs.select("text").mapInArrow(entries, "bucket int, known boolean, cells binary, shorts binary")
    dealt = sent.repartition(buckets(docs.sparkSession), "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(meet, "cell bigint, total bigint, x bigint, y bigint, shorts array<int>")


def forest(grp: np.ndarray, pivots: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links (i, j) that join different groups, one for each two groups that meet; pivots gives (i, places linked with i)."""
    grp, out, groups = grp.copy(), [], len(np.unique(grp))
    for i, near in pivots:
        others, at = np.unique(grp[near], return_index=True)
        for g, k in zip(others.tolist(), near[at].tolist(), strict=True):
            if g != grp[i]:
                out.append((i, k))
                grp[grp == g] = grp[i]
                groups -= 1
        if groups == 1:
            break
    return out


def bounded_links(table: pa.Table, start: np.ndarray, t: Fraction) -> list[np.ndarray]:
    """Pairs of rows that join the groups of each unit of (..., sig, grp, left, n, vec), by sizes and count vectors.

    All members of all units meet the first of their unit at once; only those that
    can't be linked with it are compared one by one, in leaves under boxes.
    """
    p, q = t.numerator, t.denominator
    grp, left, n = (table.column(k).to_numpy() for k in ("grp", "left", "n"))
    v = np.frombuffer(b"".join(table.column("vec").to_pylist()), dtype=np.uint8).reshape(-1, COARSE)
    size = np.diff(np.append(start, len(n)))
    head = np.repeat(start, size)
    least = np.minimum(v, v[head]).sum(axis=1, dtype=np.int64)
    full = (v == 255).any(axis=1)
    least[full & full[head]] = 1 << 40
    ok = (q * np.minimum(n, n[head]) >= p * np.maximum(n, n[head])) & ((p + q) * least >= p * (n + n[head]))
    rows = np.arange(len(n))
    star = rows[ok & (grp != grp[head])]
    out = [np.column_stack((head[star], star))]
    todo = np.unique(np.searchsorted(start, rows[~ok], "right") - 1)
    for a, m in zip(start[todo], size[todo], strict=True):
        if m < 3:
            continue
        own = grp[a : a + m].copy()
        own[np.isin(own, own[ok[a : a + m]])] = own[0]

        def pivots(a: int = a, m: int = m, own: np.ndarray = own) -> Iterator[tuple[int, np.ndarray]]:
            mine = left[a : a + m]
            mine = np.flatnonzero(mine & ~ok[a : a + m] if mine.all() else mine)
            mine = mine[np.argsort(n[a + mine], kind="stable")]
            for lo in range(0, len(mine), LEAF):
                leaf = mine[lo : lo + LEAF]
                box = v[a + leaf].max(axis=0)
                reach = np.where((box == 255).any() & full[a : a + m], 1 << 40, np.minimum(box, v[a : a + m]).sum(axis=1, dtype=np.int64))
                near = np.flatnonzero((p + q) * reach >= p * (n[a + leaf].min() + n[a : a + m]))
                for i, row in zip(leaf.tolist(), may_link(n[a + leaf], v[a + leaf], n[a + near], v[a + near], t), strict=True):
                    yield i, near[row]

        links = np.array(forest(own, pivots()), dtype=np.int64).reshape(-1, 2)
        out.append(links + a)
    return out


def fine_links(table: pa.Table, start: np.ndarray, t: Fraction) -> list[np.ndarray]:
    """Pairs of rows that join the groups of each unit of (..., sig, grp, left, n, fine), by sizes and fine vectors; of two lengths the longer is folded."""
    p, q = t.numerator, t.denominator
    grp, left, n, raw = table.column("grp").to_numpy(), table.column("left").to_numpy(), table.column("n").to_numpy(), table.column("fine").to_pylist()
    out = []
    for a, z in zip(start, np.append(start[1:], len(grp)), strict=True):
        if z - a < 2 or (grp[a:z] == grp[a]).all():
            continue
        width = np.array([len(x) for x in raw[a:z]])
        vectors = {w: np.frombuffer(b"".join(x for x in raw[a:z] if len(x) == w), dtype=np.uint8).reshape(-1, w) for w in np.unique(width).tolist()}
        rows = {w: np.flatnonzero(width == w) for w in vectors}
        full = {w: (v == 255).any(axis=1) for w, v in vectors.items()}
        place = np.empty(z - a, dtype=np.int64)
        for r in rows.values():
            place[r] = np.arange(len(r))

        def folded(v: np.ndarray, w: int) -> np.ndarray:
            return v.reshape(*v.shape[:-1], w, -1).sum(axis=-1, dtype=np.int32)

        def pivots(n=n[a:z], mine=np.flatnonzero(left[a:z]), width=width, vectors=vectors, rows=rows, full=full, place=place) -> Iterator[tuple[int, np.ndarray]]:
            for i in mine.tolist():
                own, found = vectors[width[i]][place[i]], [np.zeros(0, np.int64)]
                for w, v in vectors.items():
                    near = np.flatnonzero(q * np.minimum(n[i], n[rows[w]]) >= p * np.maximum(n[i], n[rows[w]]))
                    if not len(near):
                        continue
                    g = min(w, int(width[i]))
                    least = np.minimum(folded(own, g), folded(v[near], g)).sum(axis=1)
                    unbounded = full[w][near] & full[width[i]][place[i]]
                    found.append(rows[w][near[unbounded | ((p + q) * least >= p * (n[i] + n[rows[w][near]]))]])
                yield i, np.concatenate(found)

        out.append(np.array(forest(grp[a:z], pivots()), dtype=np.int64).reshape(-1, 2) + a)
    return out


def exact_links(table: pa.Table, start: np.ndarray, t: Fraction, shingle: int) -> list[np.ndarray]:
    """Pairs of rows that join the groups of each unit of (..., sig, grp, left, bytes, text), by the overlaps of their shingle sets."""
    p, q = t.numerator, t.denominator
    grp, left = table.column("grp").to_numpy(), table.column("left").to_numpy()
    texts, length = table.column("text").to_pylist(), table.column("bytes").to_pylist()
    out = []
    for a, z in zip(start, np.append(start[1:], len(grp)), strict=True):
        if z - a < 2 or (grp[a:z] == grp[a]).all():
            continue
        sets = list(shingle_sets([pa.decompress(x, m, "zstd", asbytes=True) for x, m in zip(texts[a:z], length[a:z], strict=True)], shingle))
        n = np.array([len(x) for x in sets])
        every, place = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(z - a), n)[np.argsort(place, kind="stable")]  # the postings: owners of each shingle
        count = np.bincount(place, minlength=len(every))
        first, at = np.cumsum(count) - count, np.concatenate(([0], np.cumsum(n)))

        def pivots(n=n, place=place, owner=owner, count=count, first=first, at=at, mine=np.flatnonzero(left[a:z])) -> Iterator[tuple[int, np.ndarray]]:
            for i in mine.tolist():
                own = place[at[i] : at[i + 1]]
                c = count[own]
                both = np.bincount(owner[np.repeat(first[own] - np.cumsum(c) + c, c) + np.arange(c.sum())], minlength=len(n))
                yield i, np.flatnonzero((both > 0) & (q * both >= p * (n[i] + n - both)))

        out.append(np.array(forest(grp[a:z], pivots()), dtype=np.int64).reshape(-1, 2) + a)
    return out


def whole_units(batches: Iterator[pa.RecordBatch], keys: int = 3) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, start of each unit) for batches sorted by their first columns: only the last unit of a batch waits for the next."""
    held, last = [], None

    def told(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts)
        return table, np.flatnonzero(np.concatenate(([True], changes([table.column(k).to_numpy() for k in range(keys)]))))

    def changes(columns: list[np.ndarray]) -> np.ndarray:
        return np.logical_or.reduce([c[1:] != c[:-1] for c in columns])

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in range(keys)]
        if held and last != [c[0] for c in columns]:
            yield told(held)
            held = []
        if len(cut := np.flatnonzero(changes(columns)) + 1):
            yield told([*held, batch.slice(0, cut[-1])])
            held = []
            batch = batch.slice(cut[-1])
        held.append(batch)
        last = [c[-1] for c in columns]
    if held:
        yield told(held)


def joining_links(rows: DataFrame, hot: DataFrame, limit: int, kernel, t: Fraction, tag: str) -> DataFrame:
    """(a, b): links that join all the nodes of a key that the kernel links, a forest for each unit of work.

    rows: (key, sig, weight, ...) with what the kernel reads; hot: (key, total, hub) of
    the keys that weigh more than the limit, hub being their least sig.
    """
    width = buckets(rows.sparkSession)
    payload = [c for c in rows.columns if c not in ("key", "sig", "weight")]

    def dealt(units: DataFrame) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table, start in whole_units(batches):
                sig = table.column("sig").to_numpy()
                links = np.concatenate([*kernel(table, start, t), np.zeros((0, 2), np.int64)])
                ends = np.sort(np.column_stack((sig[links[:, 0]], sig[links[:, 1]])), axis=1)
                ends = np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        ready = units.select("key", "i", "j", "sig", "grp", "left", *payload).repartition(width, "key", "i", "j").sortWithinPartitions("key", "i", "j", "sig")
        return ready.mapInArrow(work, "a bigint, b bigint")

    deal = lambda parts: F.pmod(F.hash("sig", F.lit(7)), parts)
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hot = stored(hot.select("key", "hub", F.ceil(F.col("total") / limit).cast("int").alias("parts")), "hot")
    plain = rows.withColumn("grp", F.col("sig")).withColumn("left", F.lit(True)).withColumn("j", F.lit(0))
    if not hot.take(1):
        return stored(dealt(plain.withColumn("i", F.lit(0))), tag)
    split = plain.join(small(hot, MOST_BROADCAST), "key", "left")
    own = split.withColumn("i", deal(F.coalesce("parts", F.lit(1))))
    hubs = split.where("sig = hub").withColumn("i", upto("parts"))
    first = stored(dealt(own.unionByName(hubs)), tag)
    # What the parts have left apart from the largest group of a key meets all of the key.
    group = components(first).withColumnRenamed("node", "sig")
    crowded = stored(rows.join(small(hot, MOST_BROADCAST), "key").join(group, "sig", "left").withColumn("grp", F.coalesce("component", "sig")), "crowded")
    weights = crowded.groupBy("key", "grp").agg(F.sum("weight").alias("w"))
    apart = weights.groupBy("key").agg(F.max(F.struct("w", "grp")).alias("top"), F.sum("w").alias("total")).where("top.w < total")
    blocks = lambda x: F.ceil(x / limit).cast("int")
    apart = stored(apart.select("key", F.col("top.grp").alias("main"), blocks(F.col("total")).alias("across"), blocks(F.col("total") - F.col("top.w")).alias("down")), "apart")
    if not apart.take(1):
        return first
    both = crowded.join(small(apart, MOST_BROADCAST), "key")
    rest = both.where("grp <> main").withColumn("left", F.lit(True)).withColumn("i", deal(F.col("down"))).withColumn("j", upto("across"))
    whole = both.withColumn("left", F.lit(False)).withColumn("j", deal(F.col("across"))).withColumn("i", upto("down"))
    return stored(first.unionAll(dealt(rest.unionByName(whole))), tag)


def crowds(cells: DataFrame, points: DataFrame, t: Fraction) -> DataFrame:
    """(sig, crowd): nodes that sizes and count vectors don't keep from links with each other; a crowd holds all links of its nodes.

    cells: what shared_cells gives, or plain (cell, sig). Points with a room stay out of
    that many of their cells, those that most share.
    """
    short = F.col("sig").bitwiseAND(F.lit(SHORT)).cast("int").alias("short")
    if "shorts" not in cells.columns:
        plain = cells.select("cell", short).distinct()
        cells = plain.groupBy("cell").agg(F.count("*").alias("total"), F.bit_xor("short").cast("bigint").alias("x"), F.bit_xor(F.xxhash64("short")).alias("y"), F.collect_list("short").alias("shorts"))
    # Of cells with just the same members one is enough.
    kept = cells.groupBy("total", "x", "y").agg(F.min("cell").alias("cell"), F.count("*").alias("copies"), F.any_value("shorts").alias("shorts")).select("cell", "total", "copies", "shorts")
    # Nodes of one short name share a cell of their own, which no room leaves out.
    placed = points.select(short, "sig", *(["room"] if "room" in points.columns else [F.lit(0).alias("room")]))
    alike = placed.groupBy("short").agg(F.count("*").alias("total")).where("total > 1")
    alike = alike.select((-1 - F.col("short")).cast("bigint").alias("cell"), "total", F.lit(1 << 40).alias("copies"), F.array("short").alias("shorts"))
    kept = stored(kept.unionByName(alike), "kept")
    order = Window.partitionBy("short", "sig").orderBy(F.desc("total"), "cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = kept.select("cell", "total", "copies", F.explode("shorts").alias("short")).join(placed, "short")
    met = met.withColumn("upto", F.sum("copies").over(order)).where("upto > room")
    cells_of = stored(met.groupBy("short", "sig").agg(F.collect_list("cell").alias("cells")).select("sig", "cells"), "cells_of")
    # A node meets its point once, with all its cells in one row.
    members = cells_of.join(points.select("sig", "n", "vec"), "sig").select("sig", "n", "vec", F.explode("cells").alias("cell"))
    rows = members.select(F.col("cell").alias("key"), "sig", F.lit(1).alias("weight"), "n", "vec")
    large = small(kept.where(F.col("total") > UNIT).select(F.col("cell").alias("key")), MOST_BROADCAST)
    hot = cells_of.select("sig", F.explode("cells").alias("key")).join(large, "key").groupBy("key").agg(F.count("*").alias("total"), F.min("sig").alias("hub")).where(F.col("total") > UNIT)
    near = joining_links(rows, hot, UNIT, bounded_links, t, "near")
    # Long sets differ little in a coarse vector: within the crowds each node's fine one tells more.
    members = stored(points.select("sig", "n", "fine").join(_with_heads(components(near)), "sig"), "members")
    rows = members.select(F.col("crowd").alias("key"), "sig", F.lit(1).alias("weight"), "n", "fine")
    hot = members.groupBy(F.col("crowd").alias("key")).agg(F.count("*").alias("total"), F.min("sig").alias("hub")).where(F.col("total") > UNIT)
    return _with_heads(components(joining_links(rows, hot, UNIT, fine_links, t, "nearer")))


def _with_heads(found: DataFrame) -> DataFrame:
    """(sig, crowd) of all nodes of the components, the least ones too."""
    found = found.select(F.col("node").alias("sig"), F.col("component").alias("crowd"))
    return found.unionAll(found.select("crowd", "crowd").distinct())


def links(docs: DataFrame, members: DataFrame, size: int, t: Fraction, names: dict[tuple[int, int], int], bits: int = 64) -> DataFrame:
    """(a, b): true links that join all linked nodes of each crowd. members: (crowd, sig, n, doc_id), one row a node."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            wanted, raw, blobs = batch.column(1).to_pylist(), [], as_bytes(batch.column(3), lower=True)
            for k, s in enumerate(shingle_sets(blobs, size)):
                sig = signature(s, bits)
                # a doc_id may stand on several rows: only the text that bears the node's name counts
                raw.append(pa.compress(blobs[k], "zstd", asbytes=True) if names.get(sig, sig[0]) == wanted[k] else None)
            out = pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(x) for x in blobs], pa.int64()), pa.array(raw, pa.binary())], names=["key", "sig", "weight", "bytes", "text"])
            yield out.filter(out.column(4).is_valid())

    wanted = pieces(members.select("doc_id", F.col("crowd").alias("key"), "sig", F.col("n").alias("weight")), MOST_BROADCAST)
    texts = reduce(DataFrame.unionAll, [docs.select("doc_id", "text").join(w, "doc_id").select("key", "sig", "weight", "text") for w in wanted])
    rows = stored(texts.mapInArrow(read, "key bigint, sig bigint, weight bigint, bytes bigint, text binary"), "texts")
    hot = members.groupBy(F.col("crowd").alias("key")).agg(F.sum("n").alias("total"), F.min("sig").alias("hub")).where(F.col("total") > UNIT_SHINGLES)
    return joining_links(rows, hot, UNIT_SHINGLES, partial(exact_links, shingle=size), t, "links")


def linked_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id), a row for each row of docs.

    Two documents link when den * |intersection| >= num * |union| of their sets of
    distinct `size`-word shingles; component_id is the least doc_id reachable. Names of
    nodes have `bits` bits.
    """
    t = Fraction(num, den)
    spark = docs.sparkSession
    named = stored(nodes(docs, size, t, bits), "nodes")
    names = clashes(named)
    if names:
        again = spark.createDataFrame([(*k, v) for k, v in names.items()], "sig bigint, check bigint, own bigint")
        named = stored(named.join(F.broadcast(again), ["sig", "check"], "left").withColumn("sig", F.coalesce("own", "sig")).drop("own"), "nodes")
    points = stored(named.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("vec").alias("vec"), F.first("fine").alias("fine"), F.first("room").alias("room")), "points")
    shingles = points.agg(F.sum("n")).first()[0] or 0
    cells = stored(shared_cells(docs, size, t, names, shingles, bits), "cells")
    crowd = crowds(cells, points, t)
    members = stored(points.select("sig", "n", "doc_id").join(crowd, "sig").where("doc_id IS NOT NULL"), "members")
    group = components(links(docs, members, size, t, names, bits)).withColumnRenamed("node", "sig")
    heads = points.select("sig", "doc_id").join(group, "sig", "left").withColumn("grp", F.coalesce("component", "sig"))
    least_doc = heads.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    found = heads.join(least_doc, "grp").select("sig", "component_id")
    out = named.select("doc_id", "n", "sig").join(found, "sig", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row left of each linked group: the row of its least doc_id, all columns kept.

    Of rows repeated under one doc_id the first by content stays; rows without a doc_id stay.
    """
    groups = linked_groups(docs, size, num, den).where("doc_id IS NOT NULL")
    per = stored(groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("head")), "groups")
    again = small(per.where("rows > 1 AND head").select("doc_id"), MOST_BROADCAST)
    order = Window.partitionBy("doc_id").orderBy(*(F.col(c).cast("string") for c in docs.columns if c != "doc_id"))
    row = spare_name(docs)
    firsts = docs.join(again, "doc_id", "left_semi").withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    # The lesser of what goes and what stays meets the texts.
    gone, stay = per.where("rows > 1 OR NOT head").select("doc_id"), per.where("rows = 1 AND head").select("doc_id")
    if gone.count() > stay.count():
        rest = [docs.join(p, "doc_id", "left_semi").select(docs.columns) for p in pieces(stay, MOST_BROADCAST)] + [docs.where("doc_id IS NULL")]
        return reduce(DataFrame.unionAll, [*rest, firsts.select(docs.columns)])
    rest = reduce(lambda left, p: left.join(p, "doc_id", "left_anti"), pieces(gone, MOST_BROADCAST), docs)
    return rest.select(docs.columns).unionAll(firsts.select(docs.columns))
