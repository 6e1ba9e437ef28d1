"""Quality classifier: an interpolated modified Kneser-Ney model of word pairs.

The model is trained on trusted text. Pairs and words are counted by 64-bit
hashes in shards: counts, continuation counts, totals of contexts and discounts
are groupings and joins by hash, and so is the finished model, a table of what
each known word and pair adds to a text's log probability. An unknown word has
what is left over for its spelling, by a Kneser-Ney model of characters of the
same kind, whose alphabet of 64 symbols bounds it.

A text's log probability is a sum over its words and pairs, so it is got by a
join with that table and a sum for each text. Perplexity is for each character. Two things keep that join small
without changing it: the most frequent entries (at most HEAVY) travel with the
code, and of the others only hashes that pass a bit filter of the model's are
sent. Texts whose perplexity is beyond what trusted texts of their language have
are rejected; those limits come from trusted texts that the model has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, repeated, sketch_bucket, sketch_quantiles

#: Symbols; spellings are judged by ORDER symbols at a time.
ALPHABET, ORDER = 64, 3
#: Trusted texts that the model is fitted on, at most: those with the smallest hash of their id in one half. All of the other half make the limits.
TRUSTED_TEXTS = 5_000
#: Quantile of the trusted texts of a language, and how far above it (in nats a character, and in nats times the root of the number of characters) a text may be.
QUANTILE, MARGIN, NOISE = 0.99, 0.01, 4.0
#: A language with fewer trusted texts is judged by the quantile of all.
MIN_TEXTS = 50
#: Entries of the model that travel with the code, at most; slots for them, and bits of the filter, as powers of two.
HEAVY, SLOTS, FILTER = 1_300_000, 20, 25
#: Words that a task keeps the hashes of.
CACHE_WORDS = 150_000
#: Rejected rows, and words of the model, that are broadcast, at most; more are joined by a shuffle.
BROADCAST, BROADCAST_WORDS = 200_000, 500_000

#: Plain punctuation parts words, and digits are alike; case and other signs are part of a word.
_PLAIN = bytes.maketrans(b"0123456789.,;:()\"", b"0000000000       ")
_BEGIN, _END = (np.uint64(xxhash.xxh64_intdigest(x, 42)) for x in (b" begin", b" end"))  # no word holds a space


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_PLAIN).split()


#: The constants of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of 64-bit numbers, each with its seed."""
    h = (seed + _P5 + np.uint64(8)) ^ (_rotated(x * _P2, 31) * _P1)
    h = _rotated(h, 27) * _P1 + _P4
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes, in order, as F.xxhash64(a, b) has them."""
    return _hash_long(b, _hash_long(a, np.full(len(a), 42, np.uint64)))


def symbol_table() -> np.ndarray:
    """Symbol of each code point below 0x250; others go by symbol_of_rest()."""
    out = np.full(0x250, 63, dtype=np.uint8)  # control characters
    for i in range(26):
        out[ord("a") + i], out[ord("A") + i] = 1 + i, 27 + i
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[ord("0") : ord("9") + 1] = 53
    for c in range(33, 127):
        if not chr(c).isalnum():
            out[c] = 58
    for s, chars in ((54, "."), (55, ","), (56, "'-"), (57, "!?:;\"()")):
        out[[ord(c) for c in chars]] = s
    for c in range(0xA1, 0x250):
        out[c] = 59 if chr(c).islower() else 60 if chr(c).isupper() else 61
    return out


_TABLE = symbol_table()


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts in a row, each text after ORDER - 1 blanks, and where each text starts."""
    pad = " " * (ORDER - 1)
    codes = np.frombuffer("".join([pad + t for t in texts]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    known = _TABLE[np.minimum(codes, len(_TABLE) - 1)]
    starts = np.cumsum([0, *(len(t) + ORDER - 1 for t in texts)])
    return np.where(codes < len(_TABLE), known, 62).astype(np.int64), starts


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram numbers, one for each character of texts, the index of its text, and each text's length."""
    s, starts = symbols(texts)
    code = np.zeros(max(0, len(s) - ORDER + 1), dtype=np.int64)
    for k in range(ORDER):
        code = code * ALPHABET + s[k : len(s) - ORDER + 1 + k]
    lengths = np.diff(starts) - (ORDER - 1)
    at = np.repeat(np.arange(len(texts)), lengths)
    first = np.repeat(starts[:-1], lengths) + (np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
    return code[first], at, lengths


def discounts(counts: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ (at indices 1 to 3) by the counts of counts."""
    n = [np.count_nonzero(counts == k) for k in range(1, 5)]
    out = np.array([0.0, 0.5, 0.75, 0.9])  # where there is nothing to estimate from
    if all(n):
        y = n[0] / (n[0] + 2 * n[1])
        est = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
        if 0 < est[0] < 1 and 0 < est[1] < 2 and 0 < est[2] < 3:
            out[1:] = est
    return out


def kneser_ney(counts: np.ndarray) -> np.ndarray:
    """Log probability of the last symbol of every n-gram after the others, from raw counts of shape (ALPHABET,) * ORDER."""
    levels = [counts]
    while levels[-1].ndim > 1:
        # Lower orders count the contexts that their n-grams are seen after, not the times.
        levels.append(np.count_nonzero(levels[-1], axis=0))
    prob = np.full(ALPHABET, 1.0 / ALPHABET)
    for c in reversed(levels):
        c = c.astype(np.float64)
        d = discounts(c)[np.minimum(c, 3).astype(np.int64)]
        total = c.sum(axis=-1, keepdims=True)
        seen = total > 0
        rest = np.where(seen, d.sum(axis=-1, keepdims=True) / np.where(seen, total, 1), 1.0)
        prob = np.where(seen, np.maximum(c - d, 0) / np.where(seen, total, 1), 0.0) + rest * prob
    return np.log(prob).astype(np.float32)


def _counted(trusted: DataFrame, text_col: str) -> np.ndarray:
    """Counts of symbol n-grams in the words of texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ALPHABET**ORDER, dtype=np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 64):
                words = [w for t in b.column(0).slice(k, 64).to_pylist() for w in words_of(t)]
                total += np.bincount(grams([w.decode("utf-8", "replace") + " " for w in words])[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])

    # Each task sends ALPHABET ** ORDER rows at most, and so does the sum of all, sharded by gram.
    summed = trusted.select(text_col).mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(ALPHABET**ORDER, dtype=np.int64)
    counts[summed.column("gram").to_numpy()] = summed.column("n").to_numpy()
    return counts


def spelling(words: list[bytes], model: np.ndarray) -> np.ndarray:
    """Log probability of each word's characters and its end."""
    code, at, _ = grams([w.decode("utf-8", "replace") + " " for w in words])
    return np.bincount(at, weights=model.ravel()[code].astype(np.float64), minlength=len(words))


class _Words:
    """Hashes of words and log probabilities of their spellings, kept for those seen last."""

    def __init__(self, model: np.ndarray | None = None) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.hash, self.spelt, self.length = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64)

    def look(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, which index hash and spelt; valid until the next call."""
        if len(self.number) > CACHE_WORDS:
            self._clear()
        number, old = self.number, len(self.number)
        out = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
        if len(number) > old:
            fresh = _last(number, len(number) - old)
            self.hash = np.concatenate([self.hash, np.array([xxhash.xxh64_intdigest(w, 42) for w in fresh], dtype=np.uint64)])
            self.length = np.concatenate([self.length, np.array([len(w.decode("utf-8", "replace")) + 1 for w in fresh])])
            self.spelt = np.concatenate([self.spelt, spelling(fresh, self.model) if self.model is not None else np.zeros(len(fresh))])
        return out


def _last(d: dict, n: int) -> list:
    """The last n keys of a dictionary, in order."""
    keys = reversed(d)
    return [next(keys) for _ in range(n)][::-1]


def _stream(words: list[list[bytes]], known: _Words) -> tuple[np.ndarray, ...]:
    """For texts given as words, with an end each: number of words and end of each, and of their characters, each word with one more; hash of every one and of the pair that it closes; the log probability of its spelling (0 for an end); its text."""
    counts = np.array([len(w) for w in words], dtype=np.int64)
    number = known.look([w for t in words for w in t])
    ends = np.cumsum(counts)
    h = np.insert(known.hash[number], ends, _END)
    spelt = np.insert(known.spelt[number], ends, 0.0)
    before = np.concatenate([[_BEGIN], h[:-1]]).astype(np.uint64)
    before[np.cumsum(counts + 1) - counts - 1] = _BEGIN
    chars = np.bincount(np.repeat(np.arange(len(words)), counts), weights=known.length[number], minlength=len(words)).astype(np.int64) + 1
    return counts + 1, chars, h, pair_hash(before, h), spelt, before


@dataclass
class Model:
    """The finished model: entries(h, v, n) on the cluster, and what travels with the code."""

    entries: DataFrame  # what a known word or pair adds to a text's log probability, and its count
    spellings: np.ndarray
    unknown: float  # log probability of leaving the known words
    begin: float  # what each text begins with
    slots: np.ndarray  # hashes of frequent entries in two tables, by their upper and their lower bits, 0 where there is none
    values: np.ndarray  # their v
    filter: np.ndarray  # bits of the hashes of the others
    least: int  # count from which on entries are frequent


def _discounts(of: DataFrame, n: str) -> np.ndarray:
    """Discounts by the counts of counts 1 to 4."""
    found = {r[n]: r["m"] for r in of.where(F.col(n) <= 4).groupBy(n).agg(F.count("*").alias("m")).collect()}
    return discounts(np.repeat(np.arange(1, 5), [found.get(k, 0) for k in range(1, 5)]))


def _left(n: str, d: np.ndarray) -> Column:
    """What a discount takes from a count."""
    return F.when(F.col(n) >= 3, float(d[3])).when(F.col(n) == 2, float(d[2])).otherwise(float(d[1]))


def train(trusted: DataFrame, text_col: str = "text") -> Model:
    """The model of a table of trusted texts; nulls count as empty. Without any text all words go by their spelling."""
    spark = trusted.sparkSession
    spellings = kneser_ney(_counted(trusted, text_col).reshape((ALPHABET,) * ORDER))
    shared = spark.sparkContext.broadcast(spellings)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words(shared.value)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                _, _, h, pairs, spelt, before = _stream([words_of(t) for t in b.column(0).slice(k, 256).to_pylist()], known)
                _, at, n = np.unique(pairs, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (before[at].view(np.int64), h[at].view(np.int64), spelt[at].astype(np.float32), n.astype(np.int32))], names=["a", "b", "p0", "n"])

    pairs = cut(trusted.select(text_col).mapInArrow(count, "a long, b long, p0 float, n int").groupBy("a", "b").agg(F.max("p0").alias("p0"), F.sum("n").alias("n")))
    shared.destroy()  # what uses it is checkpointed
    d2 = _discounts(pairs, "n")
    # A word's count is the number of words that it comes after.
    words = cut(pairs.groupBy("b").agg(F.max("p0").alias("p0"), F.count("*").alias("m"), F.sum("n").alias("n")))
    d1 = _discounts(words, "m")
    total, left, kinds = words.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(_left("m", d1)), F.lit(0.0)), F.count("*")).first()
    # There are no more contexts than words and the beginning.
    side = F.broadcast if kinds < BROADCAST_WORDS else lambda df: df
    unknown = float(np.log(left / total)) if total else 0.0
    contexts = pairs.groupBy("a").agg(F.sum("n").alias("all"), F.sum(_left("n", d2)).alias("rest")).select("a", "all", (F.col("rest") / F.col("all")).alias("w"))
    end = F.col("b") == int(_END.view(np.int64))
    # The end has no spelling: its share of what is left is that of a word of the mean probability, 0 (none).
    p1 = (F.col("m") - _left("m", d1)) / float(total or 1) + F.when(end, 0.0).otherwise(F.exp("p0") * float(np.exp(unknown)))
    ones = words.select("b", p1.alias("p1"), "n")
    as_context = contexts.select(F.col("a").alias("_a"), F.log("w").alias("lw"))
    first = ones.join(as_context, F.col("b") == F.col("_a"), "left").select(F.col("b").alias("h"), (F.log("p1") + F.coalesce("lw", F.lit(0.0))).alias("v"), "n")
    both = pairs.select("a", "b", F.col("n").alias("c")).join(side(contexts.withColumnRenamed("a", "_a")), F.col("a") == F.col("_a")).join(side(ones.select(F.col("b").alias("_b"), "p1")), F.col("b") == F.col("_b"))
    p2 = (F.col("c") - _left("c", d2)) / F.col("all") + F.col("w") * F.col("p1")
    second = both.select(F.xxhash64("a", "b").alias("h"), (F.log(p2) - F.log("w") - F.log("p1")).alias("v"), F.col("c").alias("n"))
    entries = cut(first.union(second))
    begun = contexts.where(F.col("a") == int(_BEGIN.view(np.int64))).select(F.log("w")).first()
    return _packed(entries, spellings, unknown, begun[0] if begun else 0.0)


def _slot(h: np.ndarray, table: int, slots: np.ndarray) -> np.ndarray:
    size = slots.shape[1]
    return ((h & np.uint64(size - 1)) if table else (h >> np.uint64(65 - size.bit_length()))).astype(np.int64)


def _in_filter(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = h >> np.uint64(65 - (64 * len(bits)).bit_length())
    return ((bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)


def _filter(entries: DataFrame, size: int) -> np.ndarray:
    """Bits of the entries' hashes, made block by block on the cluster: 2 ** size bits come here in all."""
    block = min(size, 18)

    def made(part: pa.Table) -> pa.Table:
        places = part.column("p").to_numpy()
        bits = np.zeros(1 << block, np.uint8)
        bits[places & ((1 << block) - 1)] = 1
        return pa.table({"k": pa.array([int(places[0]) >> block], pa.int32()), "b": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    place = F.shiftrightunsigned("h", 64 - size)
    out = np.zeros((1 << (size - block), 1 << (block - 3)), np.uint8)
    for r in entries.select(place.alias("p"), F.shiftright(place, block).alias("k")).groupBy("k").applyInArrow(made, "k int, b binary").collect():
        out[r["k"]] = np.frombuffer(r["b"], np.uint8)
    return out.ravel().view(np.uint64)


def _packed(entries: DataFrame, spellings: np.ndarray, unknown: float, begin: float) -> Model:
    """The model with the tables that travel with the code."""
    # Counts of counts up to a bound tell from which count on there are at most HEAVY entries.
    top = 1000
    sizes = {r["k"]: r["m"] for r in entries.groupBy(F.least("n", F.lit(top)).alias("k")).agg(F.count("*").alias("m")).collect()}
    least, held = top + 1, 0
    while least > 1 and held + sizes.get(least - 1, 0) <= HEAVY:
        least -= 1
        held += sizes.get(least, 0)
    # Of those that occur once less often as many as there is room for, by their hash.
    room = (HEAVY - held) / max(1, sizes.get(least - 1, 0))
    some = (F.col("n") == least - 1) & (F.pmod("h", F.lit(1 << 20)) < int(room * 0.95 * (1 << 20)))
    often = entries.where(((F.col("n") >= least) | some) & F.lit(least <= top)).select("h", F.col("v").cast("float").alias("v"), F.col("n").cast("int").alias("n")).toArrow()
    order = np.argsort(often.column("n").to_numpy(), kind="stable")
    h, v = often.column("h").to_numpy()[order].view(np.uint64), often.column("v").to_numpy()[order]
    del often, order
    slots, values = np.zeros((2, 1 << SLOTS), np.uint64), np.zeros((2, 1 << SLOTS), np.float32)
    for k in range(2):  # the most frequent one has the slot, the others may have one in the second table
        at = _slot(h, k, slots)
        slots[k, at], values[k, at] = h, v
        lost = slots[k, at] != h
        h, v = h[lost], v[lost]
    # Entries without a slot are found by the filter and the join, as the rest.
    return Model(entries, spellings, unknown, begin, slots, values, _filter(entries, FILTER), least)


def scores(docs: DataFrame, model: Model, keys: list[str], text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """(keys, nll, words, chars) of the rows of docs: negative log probability for each character, 0 without a word. Equal keys must have equal texts, and equal extra columns, which are handed on; they share a row, with their number as ``rows``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.spellings, model.unknown, model.begin, model.slots, model.values, model.filter))
    carried = [*keys, *extra]
    schema = ", ".join(f"{k} {docs.schema[k].dataType.simpleString()}" for k in carried)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spellings, unknown, begin, slots, values, bits = shared.value
        known = _Words(spellings)  # of this task alone: workers live on, and their memory is shared with other stages
        for b in batches:
            for k in range(0, b.num_rows, 256):
                rows = b.slice(k, 256)
                counts, chars, h, pairs, spelt, _ = _stream([words_of(t) for t in rows.column(len(carried)).to_pylist()], known)
                text = np.repeat(np.arange(len(counts)), counts)
                total = np.full(len(counts), begin)
                listed = []
                # A known word stands for itself, an unknown one for its spelling; an unknown pair adds nothing.
                for grams_, other in ((h, np.where(h == _END, 0.0, unknown + spelt)), (pairs, np.zeros(len(h)))):
                    there = np.zeros(len(grams_), dtype=bool)
                    for k in range(2):
                        slot = _slot(grams_, k, slots)
                        found = slots[k, slot] == grams_
                        total += np.bincount(text[found], weights=values[k, slot[found]], minlength=len(counts))
                        there |= found
                    maybe = ~there & _in_filter(grams_, bits)
                    gone = ~there & ~maybe
                    total += np.bincount(text[gone], weights=other[gone], minlength=len(counts))
                    listed.append((text[maybe], grams_[maybe], other[maybe]))
                at, rest, other = (np.concatenate(x) for x in zip(*listed))
                order = np.argsort(at, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(counts)))]).astype(np.int32)
                light = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(rest[order].view(np.int64)), pa.array(other[order].astype(np.float32))], names=["h", "o"]))
                sure = pa.StructArray.from_arrays([pa.array(total), pa.array(counts), pa.array(chars)], names=["sum", "words", "chars"])
                yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(len(carried))), sure, light], names=[*carried, "sure", "light"])

    made = docs.select(*carried, text_col).mapInArrow(score, f"{schema}, sure struct<sum:double,words:bigint,chars:bigint>, light array<struct<h:bigint,o:float>>")
    places = F.concat(F.array(F.lit(None).cast("struct<h:bigint,o:float>")), F.col("light"))
    long = made.select(*keys, F.struct("sure.*", *extra).alias("sure"), F.posexplode(places).alias("pos", "g")).select(*keys, "g.h", "g.o", F.when(F.col("pos") == 0, F.col("sure")).alias("sure"))
    joined = long.join(model.entries.select(F.col("h").alias("_h"), "v"), F.col("h") == F.col("_h"), "left")
    summed = joined.groupBy(*keys).agg(
        *[F.max(f"sure.{c}").alias(c) for c in extra], F.count("sure.words").alias("rows"), F.max("sure.words").alias("words"), F.max("sure.chars").alias("chars"), F.max("sure.sum").alias("sum"), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.coalesce(F.col("v"), F.col("o").cast("double")))), F.lit(0.0)).alias("rest")
    )
    nll = -(F.col("sum") + F.col("rest") / F.col("rows")) / F.col("chars")
    out = cut(summed.select(*carried, "rows", "words", "chars", F.when(F.col("words") == 1, 0.0).otherwise(nll).alias("nll")))
    shared.destroy()  # its users are done, and the driver's memory is bounded
    return out


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ids that are labelled good and not toxic, by all their labels. Null labels don't count as good."""
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_tid")).agg(F.min(good).alias("_good")).where("_good").select("_tid")


def _keyed(id_col: str, text_col: str, lang_col: str) -> list[Column]:
    """96 bits of a row's id, language and text."""
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(lang_col).isNull(), F.col(lang_col), F.coalesce(F.col(text_col), F.lit(""))]
    return [F.xxhash64(F.lit(1), *parts).alias("_k1"), F.xxhash64(F.lit(2), *parts).bitwiseAND((1 << 31) - 1).cast("int").alias("_k2")]


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(_k1, _k2, doc_id, lang, rows, words, chars, nll, limit) of rows that are distinct in these."""
    good = cut(trusted_ids(labels))
    seen = F.pmod(F.xxhash64(F.lit("half"), "_tid"), F.lit(2)) == 0
    some = good.where(seen).orderBy(F.xxhash64("_tid"), "_tid").limit(TRUSTED_TEXTS)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), *_keyed(id_col, text_col, lang_col))
    model = train(base.join(F.broadcast(some), F.col("doc_id") == F.col("_tid"), "left_semi"), "t")
    scored = scores(base, model, ["_k1", "_k2"], "t", ("doc_id", "lang"))
    del model
    trusted = scored.where("words > 1").join(good.where(~seen), F.col("doc_id") == F.col("_tid"), "left_semi").select("lang", "rows", (F.col("nll") - NOISE / F.sqrt("chars")).alias("x"))
    sketch = trusted.groupBy("lang", sketch_bucket(F.greatest(F.col("x"), F.lit(0.0))).alias("bucket")).agg(F.sum("rows").alias("n"))
    by_lang = sketch_quantiles(sketch, ["lang"], {"q": QUANTILE}).where(F.col("n") >= MIN_TEXTS).select(F.col("lang").alias("_l"), "q")
    whole = sketch.groupBy("bucket").agg(F.sum("n").alias("n")).withColumn("k", F.lit(1))
    every = sketch_quantiles(whole, ["k"], {"q": QUANTILE}).first()  # one row
    rows = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_l")), "left")
    return rows.withColumn("limit", F.coalesce("q", F.lit(every["q"] if every else None).cast("double")) + MARGIN + NOISE / F.sqrt("chars")).drop("_l", "q")


def _kept() -> Column:
    return F.coalesce((F.col("words") == 1) | (F.col("nll") <= F.col("limit")), F.lit(True))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row for each row of docs: doc_id, lang, perplexity for each character, limit (of its language and length), kept.

    A null text counts as empty; a text without a word is kept, as nothing
    speaks against it. A null language is a language of its own. Repeated rows
    are judged each. Without trusted texts in both halves all is kept. Other
    columns are ignored; empty tables give an empty result.
    """
    rows = _judged(docs, labels, id_col, text_col, lang_col)
    out = rows.select("doc_id", "lang", F.exp("nll").alias("perplexity"), F.exp("limit").alias("limit"), _kept().alias("kept"), F.col("rows").alias("_rows"))
    return repeated(out, "_rows").drop("_rows", "_nth")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts stay where they are unless very many are rejected."""
    gone = cut(_judged(docs, labels, id_col, text_col, lang_col).where(~_kept()).select(F.col("_k1").alias("_g1"), F.col("_k2").alias("_g2")).distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST else gone
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    keyed = packed.select("_row", *_keyed(f"_row.{id_col}", f"_row.{text_col}", f"_row.{lang_col}"))
    return keyed.join(few, (F.col("_k1") == F.col("_g1")) & (F.col("_k2") == F.col("_g2")), "left_anti").select("_row.*")
