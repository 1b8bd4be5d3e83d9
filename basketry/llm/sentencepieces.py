"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised, cut into single code points, and adjacent pairs merge in the order
of an agenda: the best score first, of equal scores the leftmost. What is left after the
last merge becomes ids, code points outside the vocabulary as their bytes. No piece of
such a vocabulary has a space mark after another character (the model is asked), so no
merge crosses the start of a word: words have agendas of their own, those of the short
words that a batch brings are served together, and a bounded memo keeps the words' ids.
In every Arrow batch the words that are new to the memo are encoded by the sentencepiece
library too (whole texts where the vocabulary doesn't part words), and whole texts are
decoded by it too; a difference is an error, never a silent choice. Map stages without
exchange.

Defined cases: null text is empty and has the begin and end ids alone; control symbols
written in a text are ordinary text; repeated rows give repeated results; other columns
aren't looked at.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import itertools
import operator
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from basketry.llm.common import slices

SPACE = "▁"
#: Words in the memo, beside those of the texts at hand; it starts afresh when full.
MOST_WORDS = 600_000
#: Longer words have an agenda of their own: the common rounds are as many as the longest word has merges.
LONG_WORD = 48
NONE = 1 << 30
#: Texts that are encoded together, and words that the library sees as one text.
AT_ONCE = 400
CHECKED = 100
#: Texts that tell whether the model's normaliser does more than to mark spaces.
PROBES = ("", " ", "a", "  a  b ", "\t\n x", " 　▁", "ﬁ é é Å Ａ", "​‍\x00\x7f")


def _one_by_one(e: UnicodeError) -> tuple[str, int]:
    return "�", e.start + 1


codecs.register_error("basketry-byte", _one_by_one)


def marked(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


class Vocabulary:
    """A merge-type model: pieces with scores, byte ids, and its library object for the checks."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
        self.known = {sp.id_to_piece(i): i for i in ids if i not in special}
        places = {x: r for r, x in enumerate(sorted({-sp.get_score(i) for i in self.known.values()}))}
        self.rank = {p: places[-sp.get_score(i)] for p, i in self.known.items()}
        names = {sp.id_to_piece(i): i for i in special if sp.is_byte(i)}
        self.bytes = [names.get(f"<0x{b:02X}>", sp.unk_id()) for b in range(256)]
        spelled = {i: bytes([b]) for b, i in enumerate(self.bytes) if i != sp.unk_id()}
        self.spelled = [spelled.get(i, b"") if i in special else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in ids]
        if sp.unk_id() >= 0:
            self.spelled[sp.unk_id()] = " ⁇ ".encode()
        self.leading = {i for p, i in self.known.items() if p.startswith(SPACE)}
        self.silent = {i for i in special if sp.is_control(i)}
        plain = all(sp.normalize(x) == marked(x) for x in PROBES)
        self.normal = marked if plain else sp.normalize
        self.words = self.splitter()
        # Line ends that stand alone let words be checked for themselves, each once.
        self.by_words = plain and "\n" in self.words.pattern
        self.pairs = self.table()
        self.single = np.full(0x110000, -1, dtype=np.int64)
        for p, i in self.known.items():
            if len(p) == 1:
                self.single[ord(p)] = i
        self.memo: dict[str, bytes] = {}

    def splitter(self) -> re.Pattern:
        """Finds the parts of a text that no merge crosses, as the vocabulary tells.

        Words start at space marks where no piece has one after another character, and line
        ends stand alone where no piece has one.
        """
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.known):
            return re.compile(r"(?s).+")
        ends = "" if any("\n" in p for p in self.known) else "\n"
        return re.compile(f"{SPACE}+[^{SPACE}{ends}]*|[^{SPACE}{ends}]+|\n+")

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pairs of pieces that make a piece, sorted: left * size + right, rank of the score, the piece."""
        size, found = len(self.spelled), []
        for p, i in self.known.items():
            found += ((self.known[p[:k]] * size + self.known[p[k:]], self.rank[p], i) for k in range(1, len(p)) if p[:k] in self.known and p[k:] in self.known)
        keys, ranks, merged = (np.array(x, dtype=np.int64) for x in zip(*sorted(found))) if found else (np.zeros(0, np.int64),) * 3
        return keys, ranks, merged

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words one after the other, symbols of each word): the agendas of many words served together.

        In a round the best pair of every word merges: least rank, leftmost of equals. Words
        without a pair leave. A code point that is no piece is its number below 0.
        """
        keys, ranks, merged = self.pairs
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4").astype(np.int64)
        symbol = self.single[points]
        symbol = np.where(symbol >= 0, symbol, -1 - points)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        word = np.arange(len(words))
        out_word, out_size, out_symbol = [], [], []

        def ranked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Rank (NONE without) and piece of the pairs that start at these places, whatever word the next symbol is of."""
            left, right = symbol[at], symbol[np.minimum(at + 1, len(symbol) - 1)]
            key = np.where((left >= 0) & (right >= 0), left * len(self.spelled) + right, -1)
            k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[k] == key, ranks[k], NONE), merged[k]

        rank, piece = ranked(np.arange(len(symbol))) if len(keys) else (np.full(len(symbol), NONE),) * 2
        rank[np.cumsum(sizes) - 1] = NONE
        while len(word):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank << 32 | np.arange(len(symbol)), starts)
            going = best >> 32 < NONE
            if not going.all():
                stays = np.repeat(going, sizes)
                out_word.append(word[~going])
                out_size.append(sizes[~going])
                out_symbol.append(symbol[~stays])
                best = best[going] - (np.cumsum(~stays) - ~stays)[best[going] & 0xFFFFFFFF]
                symbol, rank, piece, word, sizes = symbol[stays], rank[stays], piece[stays], word[going], sizes[going]
                if not len(word):
                    break
            at = best & 0xFFFFFFFF
            symbol[at] = piece[at]
            last = at + 1 == np.cumsum(sizes) - 1
            keep = np.ones(len(symbol), dtype=bool)
            keep[at + 1] = False
            symbol, rank, piece = symbol[keep], rank[keep], piece[keep]
            at = at - np.arange(len(at))  # one symbol went from each word before
            sizes = sizes - 1
            rank[at], piece[at] = ranked(at)
            rank[at[last]] = NONE
            inner = at[at > np.cumsum(sizes) - sizes] - 1
            rank[inner], piece[inner] = ranked(inner)
        order = np.argsort(np.concatenate(out_word), kind="stable")
        lengths, flat = np.concatenate(out_size), np.concatenate(out_symbol)
        begins = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        take = np.repeat(begins - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))
        return flat[take], lengths

    def merge(self, word: str) -> list[str]:
        """The pieces of a word: pairs leave the agenda by score, then from the left, until none is a piece.

        An entry is one number: rank of the score, place of the left symbol, length of the
        pair. It is out of date when the symbols there don't have that length any more.
        """
        parts, n, rank = list(word), len(word), self.rank.get
        shift = n.bit_length()
        low, places = (1 << shift) - 1, 2 * shift
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [r << places | i << shift | 2 for i, r in enumerate(map(rank, map(operator.add, word, word[1:]))) if r is not None]
        heapq.heapify(agenda)
        while agenda:
            entry = heapq.heappop(agenda)
            a = entry >> shift & low
            b = after[a]
            left = parts[a]
            if b == n or not left or len(left) + len(parts[b]) != entry & low:
                continue
            left += parts[b]
            parts[a], parts[b] = left, ""
            after[a] = c = after[b]
            if c < n:
                before[c] = a
                if (r := rank(left + parts[c])) is not None:
                    heapq.heappush(agenda, r << places | a << shift | len(left) + len(parts[c]))
            c = before[a]
            if c >= 0 and (r := rank(parts[c] + left)) is not None:
                heapq.heappush(agenda, r << places | c << shift | len(left) + len(parts[c]))
        return [p for p in parts if p]

    def ids_of(self, pieces: list[str]) -> bytes:
        ids = array("I")
        for p in pieces:
            found = self.known.get(p)
            ids.extend([self.bytes[b] for b in p.encode()] if found is None else [found])
        return ids.tobytes()

    def learn(self, words: set[str]) -> None:
        """Put the ids of these words into the memo; long ones are merged one by one."""
        short = [w for w in words if len(w) <= LONG_WORD]
        for w in words.difference(short):
            self.memo[w] = self.ids_of(self.merge(w))
        if short:
            symbols, sizes = self.merge_all(short)
            ends = np.cumsum(sizes)
            outside = np.zeros(len(short), dtype=bool)
            outside[np.searchsorted(ends, np.flatnonzero(symbols < 0), side="right")] = True
            data = symbols.astype("<u4").tobytes()
            for w, a, b, odd in zip(short, (4 * (ends - sizes)).tolist(), (4 * ends).tolist(), outside.tolist(), strict=True):
                self.memo[w] = self.ids_of(self.merge(w)) if odd else data[a:b]
        if words and self.by_words:
            self.check_words(list(words))

    def check_words(self, words: list[str]) -> None:
        """Hold new words, in texts of some with line ends between them, against the library."""
        apart, mark = self.ids_of(["\n"]), self.ids_of([SPACE])
        parts = [words[lo : lo + CHECKED] for lo in range(0, len(words), CHECKED)]
        theirs = self.library.encode(["\n" + "\n".join(p).replace(SPACE, " ") for p in parts], num_threads=1)
        for part, ids in zip(parts, theirs, strict=True):
            if mark + apart + apart.join(map(self.memo.__getitem__, part)) != array("I", ids).tobytes():
                raise ValueError("the agenda's ids of a word aren't the library's")

    def check_texts(self, texts: list[str], encoded: list[bytes]) -> None:
        """Hold whole texts against the library, where words can't stand for them."""
        if not self.by_words:
            for own, theirs in zip(encoded, self.library.encode(texts, num_threads=1, add_bos=True, add_eos=True), strict=True):
                if own != array("I", theirs).tobytes():
                    raise ValueError("the agenda's ids of a text aren't the library's")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Of each text begin id, ids and end id, each as a little-endian unsigned 32-bit integer."""
        found = [self.words.findall(self.normal(t)) for t in texts]
        if len(self.memo) > MOST_WORDS:
            self.memo.clear()
        self.learn(set(itertools.chain.from_iterable(found)).difference(self.memo))
        begin, end = (array("I", [x]).tobytes() for x in (self.begin, self.end))
        ids = self.memo.__getitem__
        return [b"".join((begin, *map(ids, words), end)) for words in found]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes that are no UTF-8 become replacement characters, the mark put before the first word goes."""
        data = b"".join(map(self.spelled.__getitem__, ids))
        first = next((i for i in ids if i not in self.silent), None)
        return data[first in self.leading :].decode("utf-8", "basketry-byte")


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    """The model of a file, once in a worker's life; its memo serves all tasks there."""
    return Vocabulary(path)


def encode(docs: DataFrame, model_path: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, ids array<int>, n_tokens, ids_sha256) of every row, begin and end ids included."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(model_path)
        for batch in slices(batches, AT_ONCE):
            whole = [t or "" for t in batch.column(1).to_pylist()]
            raw = model.encode(whole)
            model.check_texts(whole, raw)
            counts = np.array([len(b) // 4 for b in raw], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype="<i4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(counts), pa.array([hashlib.sha256(b).hexdigest() for b in raw])], names=[id_col, "ids", "n_tokens", "ids_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(work, f"`{id_col}` {kind}, ids array<int>, n_tokens bigint, ids_sha256 string")


def decode(encoded: DataFrame, model_path: str, keep: tuple[str, ...] = ("doc_id", "n_tokens", "ids_sha256"), ids: str = "ids") -> DataFrame:
    """The kept columns and the decoded text; a null array decodes to the empty text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(model_path)
        for batch in slices(batches, AT_ONCE):
            lists = [x or [] for x in batch.column(len(keep)).to_pylist()]
            own, theirs = [model.decode(x) for x in lists], model.library.decode(lists)
            if own != theirs:
                raise ValueError("a decoded text isn't the library's")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(own, pa.string())], names=[*keep, "decoded"])

    head = "".join(f"`{k}` {encoded.schema[k].dataType.simpleString()}, " for k in keep)
    return encoded.select(*keep, ids).mapInArrow(work, head + "decoded string")
