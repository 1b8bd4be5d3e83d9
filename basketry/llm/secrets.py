"""Secret scans in DataFrame functions alone: fixed patterns and a battery of randomness tests.

Patterns give the base spans. Besides, every long token of an encoding's characters
(hexadecimal, base32 or base64) is tested for what random data show and language doesn't:
uniform use of the alphabet (chi-squared), runs above and below the middle of the
alphabet, and no correlation of neighbours. Each test is standardised for the token's
length; their squares add up to one statistic that is small for random data. Its
p-value is the share of ordinary letters of the same length class (windows over the whole
of every distinct text) that look as random, and the Benjamini-Hochberg step over all
tokens of the corpus, by the counts of a fixed grid of length classes and values, sets
the cut for each length class.

Spans are found in the row: positions come from alternating the pieces of a split with
its matches. Texts are exchanged once, to take equal ones as one for the reference. Only
the grid of counts, of fixed size, goes to the driver.

Defined cases: null texts are empty and have no spans; repeated rows give repeated
results; with no ordinary letters to compare with nothing is added; other columns aren't
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import spare_name

# The stated patterns, each with the least length that counts.
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_HINT = r"(?i)passw|secret|token|api_?key"
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
TOKEN = r"[A-Za-z0-9+/_-]{20,}+={0,2}"
#: Runs in no such encoding: words of lower case, numbers, rules.
PLAIN = r"(?:[A-Z]?[a-z]+|[0-9]+|[-_+/]+)"
#: The tokens that are tested; plain runs stay among the ordinary letters.
TESTED = r"(?=[A-Za-z0-9+/_-]{20})(?!" + PLAIN + r"(?![A-Za-z0-9+/_-]))" + TOKEN

KINDS = ("assign", "access", "hex", "random")
#: Least token lengths of the length classes.
LENGTHS = (20, 28, 40, 64)
#: The statistic is counted in steps of 1 / STEPS up to TOP.
STEPS = 4
TOP = 40
FALSE_SHARE = 0.05
#: Matches of a text whose places are added up at once.
CHUNK = 256
MASK = "[SECRET]"

_SPAN = "array<struct<start:int,ord:int,end:int>>"
_BASE32, _BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _lit(text: str) -> Column:
    return F.lit(text)


def _positions(text: Column, pattern: str, hint: Column) -> Column:
    """array<struct<start,end>> of the leftmost non-overlapping matches, in code points.

    Gaps and lengths are added up in chunks, and those from the chunks' first places, so
    that many matches in one text don't copy all that came before.
    """
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, _lit(pattern), F.lit(0))
    sizes = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(F.length(p).alias("gap"), F.length(h).alias("len")))
    none = F.array().cast("array<struct<start:int,end:int>>")
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK))
    chunks = F.flatten(F.transform(F.array(sizes), cut))

    def first_places(acc: Column, chunk: Column) -> Column:
        length = F.aggregate(chunk, F.lit(0), lambda n, x: n + x["gap"] + x["len"])
        return F.struct((acc["at"] + length).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        return F.struct((a + x["len"]).alias("at"), F.concat(acc["out"], F.array(F.struct(a.alias("start"), (a + x["len"]).alias("end")))).alias("out"))

    def added(chunk: Column, at: Column) -> Column:
        return F.aggregate(chunk, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def told(chunks: Column) -> Column:
        places = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), first_places, lambda acc: acc["out"])
        return F.flatten(F.zip_with(chunks, places, added))

    found = F.flatten(F.transform(F.array(chunks), told))  # through a one-element array, so that the chunks are made once
    return F.when(hint & text.rlike(pattern), found).otherwise(none)


def _kind(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("ord"), x["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """The pattern spans, array<struct<start,ord,end>> sorted; ord is the place in KINDS."""
    keyword = text.rlike(ASSIGN_HINT)
    values = F.when(keyword, F.regexp_extract_all(text, _lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    assign = F.zip_with(_positions(text, ASSIGN, keyword), values, lambda s, v: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.length(v).alias("n")))
    assign = F.filter(assign, lambda x: x["n"] >= ASSIGN_LEAST)
    access = _positions(text, ACCESS, F.contains(text, F.lit("AKIA")))
    hexes = _positions(text, HEX, text.rlike(HEX))
    return F.array_sort(F.concat(_kind(assign, 0), _kind(access, 1), _kind(hexes, 2)).cast(_SPAN))


def _fields(x: Column, *names: str) -> list[Column]:
    return [x[k].alias(k) for k in names]


def _alphabet(core: Column, hexadecimal: Column, base32: Column, base64: Column) -> Column:
    return F.when(core.rlike("^([0-9a-f]+|[0-9A-F]+)$"), hexadecimal).when(core.rlike("^[A-Z2-7]+$"), base32).otherwise(base64)


def _coded(tokens: Column) -> Column:
    """array<struct<start,end,a,v>>: alphabet size and character places under the inferred encoding of each core."""
    known = F.transform(
        tokens,
        lambda x: F.struct(
            *_fields(x, "start", "end"),
            _alphabet(x["core"], _lit("0123456789abcdef"), _lit(_BASE32), _lit(_BASE64)).alias("letters"),
            F.split(_alphabet(x["core"], F.lower(x["core"]), x["core"], F.translate(x["core"], "-_", "+/")), "").alias("chars"),
        ),
    )
    return F.transform(known, lambda x: F.struct(*_fields(x, "start", "end"), F.length(x["letters"]).cast("double").alias("a"), F.transform(x["chars"], lambda c: F.instr(x["letters"], c) - 1).alias("v")))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)


def _tested(coded: Column) -> Column:
    """array<struct<start,end,a,n,squares,high,runs,lag,var>>: what the three tests need, each array walked a fixed number of times."""
    more = lambda v: F.greatest(F.size(v) - 1, F.lit(0))
    known = F.transform(
        coded,
        lambda x: F.struct(
            *_fields(x, "start", "end", "a", "v"),
            (x["a"] / 2).alias("half"),
            (_total(F.transform(x["v"], lambda y: y.cast("double"))) / F.greatest(F.size(x["v"]), F.lit(1))).alias("mean"),
            F.array_distinct(x["v"]).alias("kinds"),
            F.zip_with(F.slice(x["v"], 1, more(x["v"])), F.slice(x["v"], 2, more(x["v"])), lambda p, q: F.struct(p.alias("p"), q.alias("q"))).alias("pairs"),
        ),
    )
    return F.transform(
        known,
        lambda x: F.struct(
            *_fields(x, "start", "end", "a"),
            F.size(x["v"]).cast("double").alias("n"),
            _total(F.transform(x["kinds"], lambda k: F.pow(F.size(F.filter(x["v"], lambda y: y == k)), 2.0))).alias("squares"),
            _total(F.transform(x["v"], lambda y: F.when(y >= x["half"], 1.0).otherwise(0.0))).alias("high"),
            (_total(F.transform(x["pairs"], lambda y: F.when((y["p"] >= x["half"]) != (y["q"] >= x["half"]), 1.0).otherwise(0.0))) + 1).alias("runs"),
            _total(F.transform(x["pairs"], lambda y: (y["p"] - x["mean"]) * (y["q"] - x["mean"]))).alias("lag"),
            _total(F.transform(x["v"], lambda y: F.pow(y - x["mean"], 2.0))).alias("var"),
        ),
    )


def _statistic(s: Column) -> Column:
    """Sum of squares of the three standardised tests."""
    n, a = s["n"], s["a"]
    chi = (a / n * s["squares"] - n - (a - 1)) / F.sqrt(2 * (a - 1) * (n - 1) / n)
    mixed = 2 * s["high"] * (n - s["high"])
    spread = mixed * (mixed - n) / (n * n * (n - 1))
    runs = F.when(spread > 0, (s["runs"] - 1 - mixed / n) / F.sqrt(spread)).otherwise(F.lit(float(TOP)))
    lag = F.when(s["var"] > 0, s["lag"] / s["var"] * F.sqrt(n)).otherwise(F.lit(float(TOP)))
    return F.pow(F.greatest(chi, F.lit(0.0)), 2.0) + F.pow(runs, 2.0) + F.pow(lag, 2.0)


def _grid(s: Column) -> tuple[Column, Column]:
    """(length class, step of the statistic)."""
    cls = sum(((s["n"] >= x).cast("int") for x in LENGTHS[1:]), F.lit(0))
    return cls, F.least(F.floor(_statistic(s) * STEPS), F.lit(TOP * STEPS)).cast("int")


def _graded(tested: Column) -> Column:
    def grade(x: Column) -> Column:
        cls, step = _grid(x)
        return F.struct(*_fields(x, "start", "end"), cls.alias("cls"), step.alias("step"))

    return F.transform(tested, grade)


def tested_tokens(text: Column) -> Column:
    """array<struct<start,end,cls,step>> of the tokens that an encoding could have made."""
    spans = F.filter(
        F.zip_with(
            _positions(text, TOKEN, text.rlike(TOKEN)),
            F.when(text.rlike(TOKEN), F.regexp_extract_all(text, _lit(TOKEN), F.lit(0))).otherwise(F.array().cast("array<string>")),
            lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.regexp_replace(t, "=+$", "").alias("core")),
        ),
        lambda x: ~x["core"].rlike(f"^{PLAIN}$"),
    )
    return _graded(_tested(_coded(spans)))


def _bits(x: Column) -> Column:
    return F.coalesce(F.bit_count(x), F.lit(0))


def _apart(df: DataFrame) -> DataFrame:
    """df through a one-row generator: what follows is compiled as a method of its own, as the JVM only interprets very long ones."""
    return df.select(F.inline(F.array(F.struct(*df.columns))))


def _bit_planes(cut: DataFrame, letter_bits: int = 5) -> DataFrame:
    """cut with p0, p1, ... for win, n letters of 64 at most: bit k of each letter (a is 1, z is 26, none is 0) as one number, the first letter's highest.

    Eight letters make a number; its bits are transposed in three swaps.
    """
    kept = [c for c in cut.columns if c != "win"]
    full = F.rpad("win", F.lit(64), F.lit(b"\0"))
    names = [f"e{k}" for k in range(8)]
    zero = F.lit(0).cast("bigint")
    eights = cut.select(*kept, *(F.when(F.col("n") > 8 * k, F.coalesce(F.conv(F.hex(F.substring(full, 8 * k + 1, 8)), 16, 10).cast("bigint"), zero)).otherwise(zero).alias(x) for k, x in enumerate(names)))
    for by, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        eights = eights.select(*kept, *names, *(F.col(x).bitwiseXOR(F.shiftrightunsigned(x, by)).bitwiseAND(F.lit(mask)).alias(f"t{x}") for x in names))
        eights = eights.select(*kept, *(F.col(x).bitwiseXOR(F.col(f"t{x}")).bitwiseXOR(F.shiftleft(f"t{x}", by)).alias(x) for x in names))

    def plane(b: int) -> Column:
        out = zero
        for k, x in enumerate(names):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(x, 8 * b).bitwiseAND(F.lit(0xFF).cast("bigint")), 56 - 8 * k))
        return out

    return eights.select(*kept, *(plane(b).alias(f"p{b}") for b in range(letter_bits)))


def _ordinary(docs: DataFrame) -> DataFrame:
    """(cls, step) of the windows, end to end, of each class's least length over the ordinary letters of every distinct text.

    Ordinary letters are those outside the runs that are tested. The sums that _tested
    makes by walking arrays come here from bit planes of up to 64 letters, in compiled code.
    """
    alphabet, bits = range(1, 27), range(5)
    rest = F.regexp_replace(F.lower(F.regexp_replace("text", TESTED, " ")), "[^a-z]+", "")
    letters = docs.where("text IS NOT NULL").select("text").distinct().select(rest.cast("binary").alias("w"))
    sizes = F.array(*(F.struct(F.lit(cls).alias("cls"), F.lit(n).alias("n")) for cls, n in enumerate(LENGTHS)))
    each = letters.select("w", F.explode(sizes).alias("x")).select("w", "x.cls", "x.n").where(F.octet_length("w") >= F.col("n"))
    placed = each.select("w", "cls", "n", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("w") / F.col("n")).cast("int") - 1)).alias("i"))
    cut = placed.select("cls", "n", F.substring("w", F.col("i") * F.col("n") + 1, F.col("n")).alias("win"))
    code = lambda at: F.ascii(F.substring("win", at, F.lit(1)).cast("string")) - 96
    planes = _apart(_bit_planes(_apart(cut.select("cls", "n", code(F.lit(1)).alias("u"), code(F.col("n")).alias("v"), "win"))))
    p, kept = [F.col(f"p{b}") for b in bits], ["cls", "n", "u", "v"]
    pairs = F.lit(0).cast("bigint")
    for cls, n in enumerate(LENGTHS):
        pairs = F.when(F.col("cls") == cls, F.lit(-(1 << (65 - n))).cast("bigint")).otherwise(pairs)
    is_bit = lambda b, x: p[b] if x else F.bitwise_not(p[b])
    after = lambda b: F.shiftleft(f"p{b}", 1)
    sums = _apart(planes.select(
        *kept,
        p[4].bitwiseOR(p[3].bitwiseAND(p[2]).bitwiseAND(p[1])).alias("upper"),  # n to z: 14 and more
        *(is_bit(4, k & 2).bitwiseAND(is_bit(3, k & 1)).alias(f"h{k}") for k in range(4)),
        *(is_bit(2, k & 4).bitwiseAND(is_bit(1, k & 2)).bitwiseAND(is_bit(0, k & 1)).alias(f"l{k}") for k in range(8)),
        sum((_bits(p[a]) * (1 << a) for a in bits), F.lit(0)).alias("first"),
        sum((_bits(p[a].bitwiseAND(p[b])) * (1 << a + b) for a in bits for b in bits), F.lit(0)).alias("second"),
        sum((_bits(p[a].bitwiseAND(after(b))) * (1 << a + b) for a in bits for b in bits), F.lit(0)).alias("next"),
    ))
    counted = sums.select(*kept, "upper", "first", "second", "next", *(_bits(F.col(f"h{x >> 3}").bitwiseAND(F.col(f"l{x & 7}"))).alias(f"c{x}") for x in alphabet))
    counted = _apart(counted)
    n, mean = F.col("n").cast("double"), F.col("first") / F.col("n")
    ready = counted.select(
        "cls", n.alias("n"), sum((F.col(f"c{x}") * F.col(f"c{x}") for x in alphabet), F.lit(0)).cast("double").alias("squares"),
        _bits(F.col("upper")).cast("double").alias("high"), (_bits(F.col("upper").bitwiseXOR(F.shiftleft("upper", 1)).bitwiseAND(pairs)) + 1).cast("double").alias("runs"),
        (F.col("next") - mean * (2 * F.col("first") - F.col("u") - F.col("v")) + (n - 1) * mean * mean).alias("lag"), (F.col("second") - F.col("first") * mean).alias("var"),
    )
    ready = _apart(ready)
    _, step = _grid({"a": F.lit(float(len(alphabet)))} | {c: F.col(c) for c in ready.columns})
    return ready.select("cls", step.alias("step"))


def cuts(docs: DataFrame, text: Column, false_share: float = FALSE_SHARE) -> list[int]:
    """For each length class the largest step that still counts as random (-1: none)."""
    tokens = docs.select(F.explode(tested_tokens(text)).alias("x")).select("x.cls", "x.step")
    grid = {True: {}, False: {}}
    for ref, df in ((True, _ordinary(docs)), (False, tokens)):
        for r in df.groupBy("cls", "step").agg(F.count("*").alias("n")).collect():  # a fixed number of cells at most
            grid[ref][r.cls, r.step] = r.n
    p_values = {}
    for cls in range(len(LENGTHS)):
        known = sum(n for (c, _), n in grid[True].items() if c == cls)
        below = 0
        for step in range(TOP * STEPS):
            below += grid[True].get((cls, step), 0)
            p_values[cls, step] = (1 + below) / (1 + known)
    tested = sum(grid[False].values())
    seen, bound = 0, -1.0
    for p, cell in sorted((p_values.get(cell, 1.0), cell) for cell in grid[False]):
        seen += grid[False][cell]
        if p * tested <= false_share * seen:
            bound = p
    return [max((step for step in range(TOP * STEPS) if p_values[cls, step] <= bound), default=-1) for cls in range(len(LENGTHS))]


def all_spans(base: Column, tokens: Column, cut: list[int]) -> Column:
    """Base spans and the random tokens that touch none of them, sorted."""
    limit = F.array(*map(F.lit, cut))
    new = F.filter(tokens, lambda x: (x["step"] <= F.element_at(limit, x["cls"] + 1)) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return F.array_sort(F.concat(base, _kind(new, 3).cast(_SPAN)))


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["ord"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, base: str = "base_spans", every: str = "all_spans") -> DataFrame:
    """docs with two more columns, array<struct<start,ord,end>>: the pattern spans and all spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = cuts(docs.select("text"), text)
    return docs.withColumn(base, base_spans(text)).withColumn(every, all_spans(F.col(base), tested_tokens(text), cut))


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans for each row of docs."""
    count = lambda k: F.size(F.filter("base_spans", lambda x: x["ord"] == k)).cast("bigint")
    return scan(docs.select("doc_id", "text")).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("all_spans")).alias("spans"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """docs with every span of the text replaced by MASK, overlapping ones by one, and n_chars to match; no column is lost to a like name."""
    base, every, new = (spare_name(docs, x) for x in ("base_spans", "all_spans", "new_text"))
    spans, text = F.col(every), F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<a:int,n:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:  # the text kept before each run of spans
        gap = F.array(F.struct((acc["at"] + 1).alias("a"), (x["start"] - acc["at"]).alias("n")))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    def told(done: Column) -> Column:
        kept = F.transform(done["out"], lambda g: text.substr(g["a"], g["n"]))
        return F.concat(F.array_join(kept, MASK), F.lit(MASK), text.substr(done["at"] + 1, F.length(text)))

    out = scan(docs, base, every)
    changed = F.element_at(F.transform(F.array(F.aggregate(spans, start, step)), told), 1)
    out = out.withColumn(new, F.when(F.size(spans) > 0, changed).otherwise(text))
    columns = {"text": F.col(new), "n_chars": F.when(F.size(spans) > 0, F.length(new).cast("bigint")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*(columns[c].alias(c) if columns.get(c) is not None else F.col(f"`{c}`") for c in docs.columns))
