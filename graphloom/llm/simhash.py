"""SimHash near-duplicates with a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint of its word shingles. Equal fingerprints
are put together first. Two fingerprints that differ in at most three of 64
bits agree in at least two of five blocks of bits, so each distinct fingerprint
is sent to one key for each two blocks. Where the keys meet, the fingerprints,
with the blocks of the key in front, are sorted by Gray rank, which puts those
with long common prefixes next to each other, and a tree is built over them:
a node holds the bits that all fingerprints below it share, less those that
its ancestors hold already. A search adds up differences on its way down and
drops a node with all below it as soon as the sum exceeds the limit. What is
linked at one place goes on as a star to its first member, never as all pairs,
and the stars are joined to components.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut
from graphloom.llm.components import components

BITS, LIMIT, SEED = 64, 3, 42
#: Words in a shingle.
SHINGLE = 3
#: Widths of the blocks; LIMIT differences leave at least two of them equal.
BLOCKS = (13, 13, 13, 13, 12)
#: Children of a node, and search paths followed at a time.
FAN, PATHS = 8, 2_000_000


def fingerprint(text: str | None) -> int:
    """Unsigned fingerprint. A bit is 1 if over half of the shingles' hashes have it; a text without words has 0."""
    words = (text or "").encode().lower().split()  # bytes: lower() is A-Z only and split() is on ASCII white space
    n = len(words)
    if not n:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(SHINGLE)])) if n >= SHINGLE else iter([b" ".join(words)])
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype="<u8", count=max(1, n - SHINGLE + 1))
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return prints(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Places of codes in the reflected Gray order."""
    for k in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(k))
    return x


class GrayIndex:
    """Tree over distinct fingerprints, given in Gray order."""

    def __init__(self, codes: np.ndarray) -> None:
        self.codes = codes
        ones, zeros = codes, ~codes  # bits that are 1 (or 0) everywhere below
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (pattern, own mask), from the leaves up
        shared = []
        while True:
            shared.append((ones, ones | zeros))
            if len(ones) <= FAN:
                break
            cuts = np.arange(0, len(ones), FAN)
            ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        self.roots: list[tuple[np.ndarray, np.ndarray]] | None = None
        for k, (pattern, mask) in enumerate(shared):
            above = np.repeat(shared[k + 1][1], FAN)[: len(mask)] if k + 1 < len(shared) else np.uint64(0)
            self.levels.append((pattern, mask & ~above))

    def note_roots(self, root: np.ndarray) -> None:
        """From now on pass over nodes whose codes all have the root of the code that is searched: nothing there is news."""
        self.roots = [(root, root)]
        for pattern, _ in self.levels[1:]:
            lo, hi = self.roots[-1]
            cuts = np.arange(0, len(lo), FAN)
            self.roots.append((np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts)))

    def later_within(self, at: np.ndarray, limit: int, strict: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i, j), i in at and i < j, of codes that differ in at most limit bits, none of them in strict."""
        if not len(at):
            return
        step = max(1, PATHS // (FAN * 4))
        for k in range(0, len(at), step):
            own = at[k : k + step]
            top = len(self.levels[-1][0])
            yield from self._descend(np.repeat(own, top), np.tile(np.arange(top), len(own)), np.zeros(len(own) * top, np.uint8), len(self.levels) - 1, limit, strict)

    def _descend(self, i: np.ndarray, node: np.ndarray, sums: np.ndarray, level: int, limit: int, strict: np.uint64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        while True:
            if len(i) > PATHS and len(i) > 1:  # in two, to bound memory
                half = len(i) // 2
                yield from self._descend(i[:half], node[:half], sums[:half], level, limit, strict)
                yield from self._descend(i[half:], node[half:], sums[half:], level, limit, strict)
                return
            pattern, mask = self.levels[level]
            differs = (self.codes[i] ^ pattern[node]) & mask[node]
            sums = sums + np.bitwise_count(differs)
            last = np.minimum((node + 1) * FAN**level, len(self.codes)) - 1
            keep = (sums <= limit) & (differs & strict == 0) & (last > i)
            if self.roots is not None:
                lo, hi, own = self.roots[level][0][node], self.roots[level][1][node], self.roots[0][0][i]
                keep &= (lo != own) | (hi != own)
            i, node, sums = i[keep], node[keep], sums[keep]
            if level == 0:
                yield i, node
                return
            below = len(self.levels[level - 1][0])
            child = (node[:, None] * FAN + np.arange(FAN)).ravel()
            i, sums = np.repeat(i, FAN), np.repeat(sums, FAN)
            real = child < below
            i, node, sums, level = i[real], child[real], sums[real], level - 1


def joined(root: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Roots of items after pairs link them; an item's root is the least item that it is linked to."""
    for i, j in pairs:
        while len(i):
            a, b = root[i], root[j]
            lo, hi = np.minimum(a, b), np.maximum(a, b)
            differ = lo < hi
            i, j, lo, hi = i[differ], j[differ], lo[differ], hi[differ]
            np.minimum.at(root, hi, lo)
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
    return root


def linked_roots(codes: np.ndarray, limit: int, strict: np.uint64) -> np.ndarray:
    """Roots of codes in Gray order that links of at most limit bits join.

    Codes are searched a few at first, then more at a time; what they have
    joined is passed over by the next, so that many near copies of one text
    cost a few searches of all of them and not one for each pair.
    """
    root, index = np.arange(len(codes)), GrayIndex(codes)
    at, step = 0, 64
    while at < len(codes):
        index.note_roots(root.copy())
        root = joined(root, index.later_within(np.arange(at, min(len(codes), at + step)), limit, strict))
        at, step = at + step, min(2 * step, PATHS)
    return root


def _front(codes: np.ndarray, chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """Codes with the chosen blocks moved to the top, and how many bits those have."""
    starts = np.cumsum((0, *BLOCKS))
    out, bits = np.zeros_like(codes), 0
    for k in (*chosen, *(k for k in range(len(BLOCKS)) if k not in chosen)):
        w = BLOCKS[k]
        part = (codes >> np.uint64(starts[k])) & np.uint64((1 << w) - 1)
        bits += w
        out |= part << np.uint64(BITS - bits)
    return out, sum(BLOCKS[k] for k in chosen)


_CHOICES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - LIMIT))


def stars(codes: np.ndarray, choice: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (code, first code linked to it) of codes that agree in the choice's blocks."""
    front, key_bits = _front(codes, _CHOICES[choice])
    order = np.argsort(gray_rank(front))
    front, codes = front[order], codes[order]
    key = front >> np.uint64(BITS - key_bits)
    same = key[1:] == key[:-1]
    shared = np.r_[same, False] | np.r_[False, same]  # alone under its key: nothing to link
    front, codes = front[shared], codes[shared]
    strict = np.uint64(((1 << key_bits) - 1) << (BITS - key_bits))
    root = linked_roots(front, LIMIT, strict) if len(front) else np.arange(0)
    moved = root != np.arange(len(root))
    return codes[moved], codes[root[moved]]


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if parts:
        choice, codes = (np.concatenate(x) for x in zip(*parts))
        for c in np.unique(choice):
            a, b = stars(codes[choice == c].astype(np.int64).view(np.uint64), int(c))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect exactly the distinct fingerprints in column fp that a chain of links joins."""
    starts = np.cumsum((0, *BLOCKS))
    block = lambda k: F.shiftrightunsigned("fp", int(starts[k])).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1))
    keys = F.array(*[F.struct(F.lit(n).cast("byte").alias("choice"), sum((block(k) * (1 << (13 * i)) for i, k in enumerate(c)), F.lit(0)).alias("key")) for n, c in enumerate(_CHOICES)])
    dealt = prints.select("fp", F.explode(keys).alias("k")).repartition("k.choice", "k.key").select(F.col("k.choice").alias("choice"), "fp")
    return dealt.mapInArrow(_link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    component_id is the smallest id reachable over links of at most LIMIT bits,
    the row's own included; null ids are passed over unless a component has no
    other. A text without words, or null, has fingerprint zero and links like
    any other. Repeated rows come out each. Other columns are ignored; an empty
    table gives an empty result. What is sent around is 16 bytes for each
    document and 16 for each distinct fingerprint and key; no text is.
    """
    prints = cut(docs.select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(links(distinct)).select(F.col("id").alias("fp"), "component")
    least = distinct.join(linked, "fp").groupBy("component").agg(F.min("least").alias("component_id"))
    # Only linked fingerprints and those of several rows differ from their own row.
    named = distinct.join(linked, "fp", "left").join(least, "component", "left").select(F.col("fp"), F.coalesce("component_id", "least").alias("component_id"))
    out = prints.join(named, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id, with all its columns. Of rows that share this id one stays."""
    found = cut(near_duplicates(docs, id_col, text_col).select("doc_id", "component_id"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("doc_id").alias("_kept")).agg(F.count("*").alias("_n"))
    ids = kept.select("_kept")
    out = docs.join(ids, docs[id_col].eqNullSafe(ids["_kept"]), "left_semi")
    # Only repeated ids need a second pass.
    return out.dropDuplicates([id_col]) if kept.where("_n > 1").limit(1).count() else out
