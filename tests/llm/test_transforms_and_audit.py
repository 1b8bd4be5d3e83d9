"""Fill-in-the-middle, sentencepiece and the source audit, through their registered queries and by brute force."""

import hashlib
import re
from array import array
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basketry.llm import divergence, fim, queries, sentencepieces

SF = Path("/root/testdata/sf0.001")
DOCS = "doc_id bigint, text string, lang string, source string, n string, form string, ids string, term string"
PASSAGE = "".join(f"line {i} of a passage that several documents share, word for word\n" for i in range(40))
TEXTS = [
    None, "", "one line", "one line\n", "\n", "\n\n\n", "a\nb\nc", "a\nb\nc\n", "été\nчай\n茶\n🍵", "has <P> in it\nx", "x" * 127 + "<S>" + "y" * 300, "z" * 4095 + "<M>" + "w" * 5000,
    "<P", "<S\n>", "a" * 20_000, "ab\n" * 9000, PASSAGE, "before\n" + PASSAGE + "after", "0" * 777 + PASSAGE, "tab\there\r\nand\x00null\n" * 50, "▁ ▁▁ mark", "  two  spaces  ", "<s>control</s> <unk> <0x41>", "​﻿ é ﬁ", "日本語のテキスト" * 200,
]


def rows_of(texts=TEXTS):
    return [(7 * i if i else None, t, "l", "s", "n", "f", "i", "t") for i, t in enumerate(texts)] + [(70, "a\nb\nc", None, None, "n", "f", "i", "t")] * 2


def written(spark, path, rows, schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plainly(doc_id, text, seed=7, rate=100, suffix_first=50):
    """The transformation as the contract words it."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in fim.SENTINELS) or h3 % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm = h4 % 100 < suffix_first
    return len(lines), "spm" if spm else "psm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}" if spm else f"<P>{pre}<S>{suf}<M>{mid}"


def test_fim_is_what_the_words_say(spark):
    rows = rows_of()
    docs = spark.createDataFrame(rows, DOCS)
    for how in (fim.Fim(), fim.Fim(seed=3, rate=60, suffix_first=20)):
        got = fim.restore(fim.transform(docs, how), how).collect()
        want = [(i, *plainly(i, t, *how[:3]), t or "") for i, t, *_ in rows]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "spm", "psm"}


def test_fim_with_other_sentinels_and_no_rows(spark):
    how = fim.Fim(sentinels=("[pre]", "[suf].*", "|mid|"))
    docs = spark.createDataFrame([(i, f"a{i}\n<P>b\n.*c") for i in range(20)], "doc_id bigint, text string")
    got = fim.restore(fim.transform(docs, how), how).collect()
    assert len(got) == 20 and all(r.restored == f"a{r.doc_id}\n<P>b\n.*c" and "|mid|" in r.output for r in got)
    assert fim.restore(fim.transform(docs.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "é", "茶", "\n", "<", "P", "S", "M", ">", "<P>", "q" * 90, "word " * 60, PASSAGE]), max_size=25).map("".join), min_size=1, max_size=4), st.integers(0, 2**40))
def test_chunks_add_up(texts, doc_id):
    reader = fim.Reader(most=3000)
    for text, read in zip(texts, fim.texts([t.encode() for t in texts], reader), strict=True):
        n, form, a, b, out = fim.rearranged(doc_id, read, fim.Fim())
        assert (n, form, a, b, out.decode()) == plainly(doc_id, text)


def test_chunks_are_cut_by_content(spark):
    reader = fim.Reader()
    shared = np.random.default_rng(1).integers(97, 122, 20_000).astype(np.uint8).tobytes()
    one, two = fim.texts([b"start " + shared, b"quite another beginning " + shared], reader)
    chunks = [{t.data[a:b] for a, b in zip(t.starts, t.starts[1:])} for t in (one, two)]
    assert len(chunks[0] & chunks[1]) > 0.8 * len(chunks[0])
    assert all(len(c) <= fim.MOST_CHUNK for x in chunks for c in x)
    assert all(reader.summary(c) == reader.read(c) for c in chunks[0])


def test_fim_query_and_its_sql(spark, tmp_path):
    path = written(spark, tmp_path, [r for r in rows_of() if "\x00" not in (r[1] or "")])
    got = queries.QUERIES["op11_fill_in_middle"](spark, path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['op11_fill_in_middle']})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_sentencepiece_query(spark, tmp_path):
    from sentencepiece import SentencePieceProcessor

    rows = rows_of()
    sp = SentencePieceProcessor(model_file=queries.piece_model())
    got = sorted(map(tuple, queries.QUERIES["op12_sentencepiece"](spark, written(spark, tmp_path, rows)).collect()), key=str)
    sha, want = lambda b: hashlib.sha256(b).hexdigest(), []
    for i, t, *_ in rows:
        ids = sp.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), sha(array("I", ids).tobytes()), sha(sp.decode(ids).encode())))
    assert got == sorted(want, key=str)
    empty = spark.createDataFrame([], DOCS)
    assert sentencepieces.decode(sentencepieces.encode(empty, queries.piece_model()), queries.piece_model()).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary(queries.piece_model())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.lists(st.sampled_from([" ", "  ", "\n", "the", "ing", "▁", "é", "0", "..", "aaaa", "zq", "\t", "un"]), max_size=40).map("".join))
def test_agenda_equals_the_library(vocabulary, text):
    ids = vocabulary.library.encode(text, add_bos=True, add_eos=True)
    assert [array("I", ids).tobytes()] == vocabulary.encode([text])
    assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 258), max_size=30))
def test_decoding_of_any_ids(vocabulary, ids):
    assert vocabulary.decode(ids) == vocabulary.library.decode(ids)


def test_words_together_and_one_by_one(vocabulary, monkeypatch):
    monkeypatch.setattr(sentencepieces, "MOST_WORDS", 3)
    texts = ["one two three four five six seven one two " + "long" * 40, "", "x", "aaaaaaaaaaa\n\n\nbé\U0001f375 ", "é\tq " * 30, "z" * 5000] * 2
    theirs = vocabulary.library.encode(texts, add_bos=True, add_eos=True)
    for longest in (0, 5, 48, 10_000):
        monkeypatch.setattr(sentencepieces, "LONG_WORD", longest)
        vocabulary.memo.clear()
        assert vocabulary.encode(texts) == [array("I", x).tobytes() for x in theirs]
    assert vocabulary.encode(["another"]) and len(vocabulary.memo) <= 3


def test_a_difference_is_an_error(vocabulary, monkeypatch):
    vocabulary.memo.clear()
    monkeypatch.setattr(vocabulary, "rank", {p: -r for p, r in vocabulary.rank.items()})
    monkeypatch.setattr(sentencepieces, "LONG_WORD", 0)
    with pytest.raises(ValueError, match="the library's"):
        vocabulary.encode(["some words that merge"])
    vocabulary.memo.clear()
    monkeypatch.setattr(vocabulary, "by_words", False)
    with pytest.raises(ValueError, match="the library's"):
        vocabulary.check_texts(["some words that merge"], vocabulary.encode(["some words that merge"]))
    vocabulary.memo.clear()


def brute_audit(rows, least=10, top=10):
    """The audit as the contract words it, in whole numbers of Python."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = Counter(x.translate({c: c + 32 for c in range(65, 91)}) for x in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or ""))
        docs[lang].update(found.keys())
        counts[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def prices(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: prices(counts[lang, s]) for s in sources}, prices(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(ordered, 1)]
    return sorted(map(str, out))


def audit_rows(n=400, sources=23, seed=5):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(90)] + ["Été", "ЧАЙ", "茶", "É", "a1b", "DON'T"]
    out = []
    for i in range(n):
        weight = rng.random(len(words)) ** 8
        text = " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weight / weight.sum()))
        source = "hot" if i % 3 == 0 else f"s{int(rng.integers(sources))}"
        out.append((text, ["en", "de", None][i % 7 % 3], source))
    return [*out, *[("same same words", "en", "hot")] * 30, (None, "en", "only null"), ("", "xx", "a"), ("once", "xx", "b"), ("alone", "yy", None), (None, None, None)]


@pytest.mark.parametrize("rows,cols", [(divergence.ROWS, divergence.COLS), (3, 16), (1000, 7)])
def test_audit_against_brute_force(spark, rows, cols):
    data = audit_rows()
    docs = spark.createDataFrame([(t, la, s, 1, "x") for t, la, s in data], "text string, lang string, source string, p int, term string").repartition(5)
    cells, groups = divergence.matrix(docs)
    sums = {(r.lang, *sorted((r.a, r.b))): r.value for r in divergence.pair_sums(cells, groups, rows, cols).collect()}
    want = [x for x in map(eval, brute_audit(data)) if x[2] == "pair"]
    assert {(la, *sorted((s, item))): v for la, s, _, item, v, _ in want} == sums
    if rows == divergence.ROWS:
        got = [tuple(r) for r in divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert sorted(map(str, got)) == brute_audit(data)


def test_audit_of_nothing(spark):
    schema = "text string, lang string, source string"
    assert divergence.audit(spark.createDataFrame([], schema)).count() == 0
    few = [("a b c", "en", "x"), ("a b", "en", "y"), (None, "de", "z")]
    assert sorted(map(str, map(tuple, divergence.audit(spark.createDataFrame(few, schema)).collect()))) == brute_audit(few)


def test_counts_are_handed_on_in_parts(spark, monkeypatch):
    data = audit_rows(900)
    docs = spark.createDataFrame(data, "text string, lang string, source string")
    monkeypatch.setattr(divergence, "HELD_TRIPLES", 50)
    told = divergence.term_counts(docs.coalesce(1)).collect()
    one = defaultdict(lambda: np.zeros(2, dtype=int))
    for r in told:
        one[r.lang, r.source, r.term] += (r.n, r.docs)
    assert len(told) > len(one)
    want = Counter()
    for t, la, s in data:
        for x, n in Counter(re.findall("[a-zA-Z\x80-\U0010ffff]+", t or "")).items():
            want[la or "", s or "", x.translate({c: c + 32 for c in range(65, 91)})] += n
    assert {k: v[0] for k, v in one.items() if k[2] is not None} == want
    assert sum(v[1] for k, v in one.items() if k[2] is None) == len(data)


def test_prices_are_exact(spark):
    cases = [(0, 1, 1), (10**12, 3 * 10**12, 7), (5 * 10**15, 9 * 10**15, 10**9), (2**53 + 1, 2**60, 3)]
    df = spark.createDataFrame(cases, "c bigint, t bigint, v bigint")
    got = [r[0] for r in df.select(divergence.price(df.c, df.t, df.v)).collect()]
    assert got == [1 + 10**9 * (c + 2) // (t + 2 * v) for c, t, v in cases]


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 40), st.integers(1, 40), st.integers(0, 90), st.floats(0, 0.3), st.integers(0, 10**6))
def test_joint_walk_equals_all_cells(na, nb, width, density, seed):
    rng = np.random.default_rng(seed)
    side, trees, dense = max(na, nb, width), [], []
    for n in (na, nb):
        zero = rng.integers(1, 10**9, n)
        full = rng.random((n, width)) < density
        price = np.where(full, rng.integers(1, 10**9, (n, width)), zero[:, None])
        rows, cols = np.nonzero(full)
        trees.append(divergence.Tree(rows, cols, price[rows, cols], zero, width, side))
        dense.append(price)
    f = lambda p, q: ((p[:, None] - q[None]) ** 2 // (p[:, None] + q[None])).sum(axis=2)
    assert (divergence.joint(*trees) == f(*dense)).all()
    assert (np.triu(divergence.joint(trees[0], trees[0]), 1) == np.triu(f(dense[0], dense[0]), 1)).all()


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op13_source_divergence"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.QUERIES[name](spark, str(SF))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
