"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Texts of documents and benchmark items become templates: numbers, units after
numbers, and names are replaced by typed placeholders, the rest by lower-case
words. In a document every capitalised word counts as a name, but for words in
capitals throughout. In an item one that
starts a sentence may be a name or just a word, so windows over it are there both
ways. Windows of five template tokens are hash-joined, those of documents behind
a bit filter of the items' hashes. Where a window has placeholders, the values
behind them must map to the item's values one to one along the alignment; windows
that break this don't count. What is left decides: most of an item's windows, or
a long aligned run of them, makes a document contaminated, whatever numbers and
names it puts in their places. Windows with too few words for that, and items
shorter than a window, are hash-joined with their values, so that only verbatim
copies match.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut

#: Tokens in a window, and how many of them must be words rather than placeholders.
WINDOW, LITERALS = 5, 3
#: Share of an item's windows, or aligned windows (13 tokens of running text), that make a leak.
SHARE, RUN = 0.8, 9
#: Rows that are broadcast at most; what is more is joined by a shuffle.
BROADCAST = 200_000
#: Bits of the filter for each window of the benchmark, at least, and logarithms of its least and largest size.
BITS, LEAST, LARGEST = 64, 16, 24

_NAME, _NUMBER, _UNIT, _START = "\ue000", "\ue001", "\ue002", "\ue003"  # private-use characters, which stand for nothing in a text
_HOLDERS = _NAME + _NUMBER + _UNIT
#: Units of measure, which count as such right after a number.
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t oz lb lbs gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds ml cl l liter liters litre litres gallon gallons cup cups "
    "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh w kw kwh v a hz kb mb gb tb"
).split()


def _marked(text: Column, starts: bool = False) -> Column:
    """The text as template tokens parted by single spaces, placeholders followed by their values. starts: capitalised words that may just start a sentence are marked as such."""
    raw = F.coalesce(text, F.lit(""))
    odd = reduce(Column.__or__, [F.contains(raw, F.lit(c)) for c in _HOLDERS + _START])
    named = F.when(odd, F.translate(raw, _HOLDERS + _START, "    ")).otherwise(raw)
    if starts:
        named = F.regexp_replace(named, r"(?<=[\p{Ll}\p{N},;:]\x20)\p{Lu}\p{Ll}\p{L}*", _NAME + "$0")
    # The look back comes after the capital, which is rarer.
    named = F.lower(F.regexp_replace(named, rf"\p{{Lu}}(?<![\p{{L}}\p{{N}}\p{{M}}{_NAME}]\p{{Lu}})\p{{Ll}}\p{{L}}*", (_START if starts else _NAME) + "$0"))

    # A number's point or comma would part it: values keep their digits only.
    numbers = F.regexp_replace(F.regexp_replace(named, r"\p{N}+(?:[.,]\p{N}+)*", f" {_NUMBER}$0 "), r"[.,](?<=\p{N}[.,])(?=\p{N})", "")
    after = rf"({_NUMBER}\p{{N}}+\x20)[\x20-]*[{_NAME}{_START}]?({'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
    counted = F.when(raw.rlike(r"\p{N}"), F.regexp_replace(numbers, after, f"$1{_UNIT}$2")).otherwise(named)
    return F.trim(F.regexp_replace(counted, rf"[^\p{{L}}\p{{N}}\p{{M}}{_HOLDERS}{_START}]+", " "))


def _tokens(template: Column) -> Column:
    """Tokens of a template; one empty token, which is in no window, if it has none."""
    return F.split(template, " ")


def _template(values: Column) -> Column:
    """The template of a text marked with its values."""
    return F.regexp_replace(values, rf"([{_HOLDERS}])[\p{{L}}\p{{N}}]+", "$1")


def _hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda x: F.xxhash64(x))


def _from(a: Column, n: int) -> Column:
    """An array without its first n values."""
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def _rolled(h: Column, n: int) -> Column:
    """Hashes of all n values in a row of an array of hashes, n being 1 to 5. What goes past the end is left in; it must be cut off."""
    both = lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))
    pair = lambda: both(h, _from(h, 1))
    match n:
        case 1:
            return F.transform(h, lambda x: F.xxhash64(x))
        case 2:
            return pair()
        case 3:
            return _let(pair(), lambda p: both(p, _from(h, 2)))
        case 4:
            return _let(pair(), lambda p: both(p, _from(p, 2)))
    return _let(_let(pair(), lambda p: both(p, _from(p, 2))), lambda q: both(q, _from(h, 4)))


def _rolled_sum(f: Column) -> Column:
    """Sums of WINDOW values in a row of an array of numbers, likewise."""
    both = lambda a, b: F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0)))
    return _let(both(f, _from(f, 1)), lambda p: both(both(p, _from(p, 2)), _from(f, 4)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _literal(token: Column) -> Column:
    """Whether a token of a template is a word."""
    return ~token.isin(*_HOLDERS)


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, exact, ipos, h, bvals, n_win, n_exact): windows of every distinct item that has a word.

    Those with enough words go by their template, n_win of them, the others by
    their values, n_exact of them. A window with words that may be names has a
    row for each way to read them, and counts once. An item shorter than a window
    is one of its size. Items of equal template and values go by their least id.
    """
    base = benchmark.select(F.col(id_col).alias("item"), _marked(F.col(text_col), starts=True).alias("v"))
    one = base.groupBy("v").agg(F.min("item").alias("item")).where("v <> ''")
    words = one.select("item", _tokens(F.col("v")).alias("v")).where(F.exists("v", lambda x: _literal(_template(x))))
    size = F.least(F.size("v"), F.lit(WINDOW))
    placed = words.select("item", size.alias("size"), "v", F.explode(F.sequence(F.lit(0), F.size("v") - size)).alias("ipos"))
    part = placed.select("item", "size", "ipos", F.slice("v", F.col("ipos") + 1, F.col("size")).alias("w"))
    # Bit k of a reading: token k, which starts a sentence, is a name.
    read = part.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(2**WINDOW - 1))))
    bit = lambda k: F.bit_get(F.col("m").cast("long"), k) == 1
    places = F.sequence(F.lit(0), F.lit(WINDOW - 1))
    start = lambda k: F.coalesce(F.startswith(F.get("w", k), F.lit(_START)), F.lit(False))
    sound = read.where(F.forall(places, lambda k: ~bit(k) | start(k)))
    form = lambda x, k: F.when(F.startswith(x, F.lit(_START)), F.concat(F.when(bit(k), F.lit(_NAME)).otherwise(F.lit("")), F.substring(x, F.lit(2), F.length(x)))).otherwise(x)
    forms = sound.select("item", "size", "ipos", F.transform("w", form).alias("v"))
    t = forms.withColumn("t", F.transform("v", _template))
    literals = F.size(F.filter("t", _literal))
    # An item that has no window with enough words makes do with fewer.
    place, item = Window.partitionBy("item", "ipos"), Window.partitionBy("item")
    t = t.withColumn("n", literals).withColumn("_least", F.min("n").over(place)).withColumn("_most", F.max("_least").over(item))
    verbatim = (F.col("size") < WINDOW) | (F.col("n") < F.when(F.col("_most") >= LITERALS, LITERALS).otherwise(LITERALS - 1))
    # The hash of the whole, as _rolled() has it at the first place.
    of = lambda c, n: F.get(_rolled(_hashes(F.col(c)), n), F.lit(0))
    own = reduce(lambda rest, n: F.when(F.col("size") == n, of("v", n)).otherwise(rest), range(1, WINDOW), of("v", WINDOW))
    h = F.when(verbatim, own).otherwise(of("t", WINDOW))
    slots = ~verbatim & F.exists("t", lambda x: ~_literal(x))
    out = t.select("item", "size", "ipos", verbatim.alias("verbatim"), h.alias("h"), F.when(slots, F.col("v")).alias("bvals"))
    marked = out.withColumn("exact", F.min("verbatim").over(place)).withColumn("_first", F.row_number().over(place.orderBy("h")) == 1)
    counted = marked.withColumn("n_win", F.count(F.when(F.col("_first") & ~F.col("exact"), 1)).over(item)).withColumn("n_exact", F.count(F.when(F.col("_first") & F.col("exact"), 1)).over(item))
    return counted.drop("_first", "verbatim")


def _filter_bits(wanted: DataFrame, n: int) -> tuple[Column, int]:
    """A bit filter of the hashes of n windows as one constant (its size grows with n up to a bound), and the logarithm of its size."""
    size = min(LARGEST, max(LEAST, (BITS * max(1, n) - 1).bit_length()))
    place = F.shiftrightunsigned("h", 64 - size)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    words = wanted.select(F.shiftright(place, 6).alias("k"), one.alias("b")).groupBy("k").agg(F.bit_or("b").alias("b"))
    bits = [0] * (1 << (size - 6))
    for r in words.collect():  # 2 ** (LARGEST - 6) rows at most
        bits[r["k"]] = r["b"]
    return F.from_json(F.lit(str(bits)), "array<bigint>"), size


def _in_filter(h: Column, bits: Column, size: int) -> Column:
    place = F.shiftrightunsigned(h, 64 - size)
    return F.bit_get(F.get(bits, F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1


def _found(v: Column, bits: Column, size: int, short: list[int]) -> Column:
    """(dpos, h, dvals) of the windows of a marked text that pass the filter."""
    holders = [xxhash.xxh64_intdigest(c.encode(), 42) for c in _HOLDERS]
    holders = [h - (1 << 64) if h >> 63 else h for h in holders]

    def kept(s: Column, found: Column, n: int) -> Column:
        """Of an array of hashes, one for each place or null, those that pass."""
        whole = F.slice(found, 1, F.greatest(F.size(s["v"]) - (n - 1), F.lit(0)))

        def passed(h: Column) -> Column:
            at = F.array_compact(F.transform(h, lambda x, i: F.when(_in_filter(x, bits, size), i)))
            dvals = lambda i: F.slice(s["v"], i + 1, F.lit(n)) if n == WINDOW else F.lit(None).cast("array<string>")
            return F.transform(at, lambda i: F.struct(i.alias("dpos"), F.get(h, i).alias("h"), dvals(i).alias("dvals")))

        return _let(whole, passed)

    def every(s: Column) -> Column:
        held = _rolled_sum(F.transform(s["hc"], lambda x: F.when(x.isin(*holders), 1).otherwise(0)))
        most = WINDOW - LITERALS + 1

        def of(x: Column) -> Column:
            # By template where an item's window may go by it, else by values; by both where that depends on the item.
            either = F.zip_with(F.zip_with(x["k"], x["c"], lambda k, h: F.when(k <= most, h)), x["v"], lambda c, v: F.coalesce(c, v))
            again = F.zip_with(x["k"], x["v"], lambda k, h: F.when(k == most, h))
            return F.concat(kept(s, either, WINDOW), kept(s, again, WINDOW))

        out = [_let(F.struct(held.alias("k"), _rolled(s["hc"], WINDOW).alias("c"), _rolled(s["hv"], WINDOW).alias("v")), of)]
        return F.concat(*out, *[kept(s, _rolled(s["hv"], n), n) for n in short])

    parts = lambda words: F.struct(words.alias("v"), _hashes(words).alias("hv"), _hashes(_tokens(_template(v))).alias("hc"))
    return _let(_tokens(v), lambda words: _let(parts(words), every))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, th, items): rows of docs, by id and hash of text, that hold benchmark items, and which.

    Null texts hold nothing. Items of fewer than WINDOW tokens match verbatim
    only; items without a word never match. Of equal items the least id is
    reported. Rows with equal id and text share one result row. Texts are read
    whole, of any length. Empty tables give an empty result; other columns are
    ignored.
    """
    wanted = cut(benchmark_windows(benchmark, item_col, item_text_col))
    sizes = {r["size"]: r["count"] for r in wanted.groupBy("size").count().collect()}  # WINDOW rows at most
    total = sum(sizes.values())
    bits, size = _filter_bits(wanted, total)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    windows = _let(_marked(F.col("t")), lambda v: _found(v, bits, size, sorted(set(sizes) - {WINDOW})))
    # The outer form, as for the other the optimizer would work the windows out again to look for empty ones.
    hashed = base.select("id", F.xxhash64(F.coalesce("t", F.lit(""))).alias("th"), F.inline_outer(windows)).where(F.col("h").isNotNull())
    matched = hashed.join(F.broadcast(wanted) if total <= BROADCAST else wanted, "h").select(
        "id", "th", "item", (F.col("dpos") - F.col("ipos")).alias("diag"), "ipos", "exact", "n_win", "n_exact", F.when(F.col("bvals").isNotNull(), F.col("dvals")).alias("dvals"), "bvals"
    )
    good = matched.where(_consistent())
    by_diag = good.groupBy("id", "th", "item", "diag").agg(
        F.collect_set("ipos").alias("at"), F.collect_set(F.when(F.col("exact"), F.col("ipos"))).alias("verbatim"),
        F.first("n_win").alias("n_win"), F.first("n_exact").alias("n_exact"), F.collect_list(F.when(F.col("dvals").isNotNull(), F.struct("ipos", "dvals", "bvals"))).alias("slots"),
    )
    left = _let(_broken(F.col("slots")), lambda bad: F.array_except("at", bad))
    settled = by_diag.select("id", "th", "item", left.alias("at"), "verbatim", "n_win", "n_exact")
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    by_item = settled.groupBy("id", "th", "item").agg(F.max(F.size("at")).alias("run"), distinct(F.array_except("at", "verbatim")).alias("covered"), distinct("verbatim").alias("verbatim"), F.first("n_win").alias("n_win"), F.first("n_exact").alias("n_exact"))
    # An item with templates is judged by them, so that windows by values take nothing from it.
    share = F.when(F.col("n_win") > 0, F.col("covered") >= SHARE * F.col("n_win")).otherwise(F.col("verbatim") >= SHARE * F.col("n_exact"))
    leaked = by_item.where(share | (F.col("run") >= RUN))
    return leaked.groupBy("id", "th").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _consistent() -> Column:
    """Each placeholder of a window stands over one of the same type."""
    kind = lambda x: F.when(x.substr(1, 1).isin(*_HOLDERS), x.substr(1, 1))
    types = lambda c: F.transform(F.col(c), lambda x: F.coalesce(kind(x), F.lit("")))
    return F.col("bvals").isNull() | (types("dvals") == types("bvals"))


def _broken(slots: Column) -> Column:
    """Item positions of windows with a value that doesn't map one to one along the alignment."""
    of = lambda s: F.arrays_zip(s["dvals"].alias("d"), s["bvals"].alias("b"))
    # What a value stands over, both ways: with more than one it is wrong. A pair is wrong with either of its values.
    pairs = F.array_distinct(F.flatten(F.transform(slots, lambda s: F.filter(of(s), lambda p: p["b"].substr(1, 1).isin(*_HOLDERS)))))

    def several(pairs: Column, side: str) -> Column:
        return _let(F.array_sort(F.transform(pairs, lambda p: p[side])), lambda x: F.array_distinct(F.filter(x, lambda v, i: (i > 0) & (v == F.get(x, i - 1)))))

    def windows(pairs: Column) -> Column:
        return _let(F.struct(several(pairs, "d").alias("d"), several(pairs, "b").alias("b")), lambda w: F.transform(F.filter(slots, lambda s: F.arrays_overlap(s["dvals"], w["d"]) | F.arrays_overlap(s["bvals"], w["b"])), lambda s: s["ipos"]))

    return _let(pairs, windows)


def flag(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, contaminated, items (ids, comma-joined) and kept (not contaminated) of every row of docs.

    A null text is clean. Repeated rows are flagged alike, each. An item held
    several times is named once, of equal items the one with the least id.
    """
    found = leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("_id"), F.col("th").alias("_th"), "items")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_h"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_th")), "left")
    return out.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"), F.col("items").isNull().alias("kept"))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without a leak, with all their columns; rows that are equal in id and text stay or go together.

    A null text is clean, an item held several times is held, an empty table
    gives an empty result.
    """
    found = cut(leaks(docs, benchmark, id_col, text_col).select(F.col("id").alias("_id"), F.col("th").alias("_th")))
    few = F.broadcast(found) if found.count() <= BROADCAST else found
    return docs.join(few, docs[id_col].eqNullSafe(few["_id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == few["_th"]), "left_anti")
