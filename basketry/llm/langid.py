"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its characteristic character n-grams. The filters
are kept bit-sliced: row r of one table is the bitmask of the languages whose filter has
bit r set, so AND-ing the rows an n-gram hashes to returns all languages containing it
at once. A text's n-grams give a popcount for each language, which is corrected for that
filter's false-positive rate; the largest decides.

The n-grams are counted in Spark over a bounded sample of labelled rows (at most about
`train_docs` a language, whole texts) and an n-gram belongs to a language if its share
there is at least `tau` of its largest share anywhere. The table has `rows` rows, each of
one 64-bit mask for every 64 languages, whatever the corpus.

A text is in no learned language if its best one knows too small a part of the text's own
n-grams; texts of a few n-grams are too short to tell and are not turned away.

Defined cases: a text that is null or has no letter is `und` with score 0; a text whose
n-grams are in no filter takes the language with most training rows and score 0; ties go
to the language first in alphabetical order; no labelled row at all makes every text
`und`; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketry.llm.common import GRAM, U, mix, slices

ORDERS = (2, 3, 4)
TRAIN_DOCS = 3000
TAU = 0.5
#: n-grams counted less often are left out. A language of fewer than ENOUGH_DOCS learned rows needs
#: less in proportion, so every n-gram of a language of a few documents is in its filter.
LEAST_COUNT = 5
ENOUGH_DOCS = 1000
#: A filter's size bounds its n-grams: the most frequent of a language, where there are more.
TOP_GRAMS = 20_000
ROWS = 1 << 19
PROBES = 3
SLAB_CHARS = 200_000
#: A text is in no language if the best one knows less of its n-grams, where it has so many.
LEAST_KNOWN = 0.1
LEAST_GRAMS = 40
UNDECIDED = "und"
_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "alpha" not in _tables:
        _tables["alpha"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _tables["alpha"]


def gram_hashes(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, hash of each n-gram, text it belongs to): lower-cased letters, with one blank for any run of others."""
    chars = [np.frombuffer((" " + t.lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    code = np.concatenate(chars) if chars else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(chars)), [len(c) for c in chars])
    solid = _letters()[code]
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    keep[0:1] = True
    keep[1:] |= owner[1:] != owner[:-1]
    code, owner = np.where(solid, code, 0)[keep].astype(np.uint64) + U(1), owner[keep]
    for n in ORDERS:
        m = len(code) - n + 1
        if m <= 0:
            continue
        g = np.full(m, U(n), dtype=np.uint64)
        for k in range(n):
            g += code[k : k + m] * GRAM[k]
        inside = owner[:m] == owner[n - 1 :]
        yield n, mix(g[inside]), owner[:m][inside]


def slabs_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, t in enumerate(texts):
        if total and total + len(t) > SLAB_CHARS:
            yield start, i
            start, total = i, 0
        total += len(t)
    if start < len(texts):
        yield start, len(texts)


class Filters:
    """The bit-sliced Bloom filters of all languages."""

    def __init__(self, languages: list[str], fallback: str | None, members: dict[str, np.ndarray], rows: int = ROWS):
        self.languages, self.fallback, self.rows = languages, fallback, rows
        self.table = np.zeros((-(-len(languages) // 64), rows), dtype=np.uint64)
        for k, lang in enumerate(languages):
            for r in self.places(members[lang]):
                self.table[k // 64, r] |= U(1) << U(k % 64)  # the mask of row r gains language k
        fill = [float((self.table[k // 64] >> U(k % 64) & U(1)).mean()) for k in range(len(languages))]
        self.false_rate = np.array([f**PROBES for f in fill])

    def places(self, g: np.ndarray) -> Iterator[np.ndarray]:
        for p in range(PROBES):
            yield ((g * GRAM[8 + p]) >> U(20)) % U(self.rows)

    def masks(self, g: np.ndarray) -> np.ndarray:
        """The languages of each n-gram, as bitmasks: a row of them for every 64 languages."""
        places = self.places(g)
        out = self.table[:, next(places)]
        for r in places:
            out &= self.table[:, r]
        return out

    def judge(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        """(language, its part of all popcounts, whether it may be in no language after all) of each text."""
        has_letter = [any(map(str.isalpha, t)) for t in texts]
        counts = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        for lo, hi in slabs_of(texts):
            for _, g, owner in gram_hashes(texts[lo:hi]):
                m = self.masks(g)
                total[lo:hi] += np.bincount(owner, minlength=hi - lo)
                for k in range(len(self.languages)):
                    counts[lo:hi, k] += np.bincount(owner, weights=(m[k // 64] >> U(k % 64) & U(1)).astype(float), minlength=hi - lo)
        true = np.maximum(0, (counts - total[:, None] * self.false_rate) / (1 - self.false_rate)) if self.languages else counts
        out = []
        for ok, row, n in zip(has_letter, true, total, strict=True):
            if not ok or not self.languages:
                out.append((UNDECIDED, 0.0, True))
                continue
            k = int(row.argmax())
            foreign = n >= LEAST_GRAMS and row[k] < LEAST_KNOWN * n
            out.append((self.languages[k], float(row[k] / row.sum()), foreign) if row[k] > 0 else (self.fallback, 0.0, foreign))
        return out


def train(labelled: DataFrame, train_docs: int = TRAIN_DOCS, rows: int = ROWS) -> Filters:
    """Filters from rows with text and lang; about train_docs rows a language at most, chosen by a hash of doc_id."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many rows as languages
    languages = sorted(sizes)
    if not languages:
        return Filters([], None, {}, rows)
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, train_docs / n)))))
    place = F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    sample = labelled.where(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, texts = (c.to_pylist() for c in batch.columns)
            for lang in sorted(set(langs)):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for lo, hi in slabs_of(own):
                    for n, g, _ in gram_hashes(own[lo:hi]):
                        values, times = np.unique(g, return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(values)), pa.array(np.full(len(values), n, np.int32)), pa.array(values.view(np.int64)), pa.array(times)],
                            names=["lang", "n", "gram", "times"],
                        )

    counted = sample.mapInArrow(count, "lang string, n int, gram bigint, times bigint").groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    of_lang, of_gram = Window.partitionBy("lang", "n"), Window.partitionBy("n", "gram")
    shares = counted.withColumn("share", F.col("times") / F.sum("times").over(of_lang))
    least = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(LEAST_COUNT * min(1.0, n / ENOUGH_DOCS)))))
    shares = shares.withColumn("top", F.max("share").over(of_gram)).where((F.col("times") >= F.element_at(least, F.col("lang"))) & (F.col("share") >= TAU * F.col("top")))
    best = shares.withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "gram"))).where(F.col("rn") <= TOP_GRAMS)
    found: dict[str, list[int]] = {lang: [] for lang in languages}
    for r in best.select("lang", "gram").toLocalIterator():  # at most TOP_GRAMS a language
        found[r.lang].append(r.gram)
    members = {lang: np.array(g, dtype=np.int64).view(np.uint64) for lang, g in found.items()}
    return Filters(languages, max(languages, key=lambda x: (sizes[x], x)), members, rows)


def identify(docs: DataFrame, filters: Filters, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score of each row's text."""
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = held.value.judge([t or "" for t in batch.column(len(keep)).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array([x for x, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64())],
                names=[*keep, "lang_pred", "score"],
            )

    head = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, "text").mapInArrow(judge, f"{head}, lang_pred string, score double")


def accepted(docs: DataFrame, filters: Filters, languages: tuple[str, ...] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text is in one of the languages (null: any learned one)."""
    held = docs.sparkSession.sparkContext.broadcast(filters)
    column = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = held.value.judge([t or "" for t in batch.column(column).to_pylist()])
            yield batch.filter(pa.array([x != UNDECIDED and not foreign and (languages is None or x in languages) for x, _, foreign in found], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
