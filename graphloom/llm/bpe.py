"""Byte-level BPE encoding and decoding with a segment tree over pair ranks.

A piece (what the pre-tokenizer's pattern yields) is a sequence of symbols. A
segment tree holds at each leaf the rank of the pair that starts there; its
root is the least (rank, position), so it names the leftmost lowest-rank merge.
A merge changes the ranks of three pairs at most, each a logarithmic update.
Pieces repeat, so their ids are kept in a cache of bounded size.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the split pattern of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a task's cache holds before it is emptied, and the longest piece that it takes.
CACHE_PIECES, CACHE_CHARS = 600_000, 64
#: What an empty pair or node holds.
_NONE = 1 << 62


def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merge(symbols: list[int], ranks: dict[int, int], merged: list[int]) -> list[int]:
    """Merge until no pair has a rank. ranks: left id * 2^20 + right id -> rank; merged: the symbol that each rank's merge makes."""
    n = len(symbols)
    if n < 2:
        return list(symbols)
    size, bits = 1 << (n - 1).bit_length(), n.bit_length()
    get = ranks.get
    # A node holds rank * 2^bits + position, so that the least is the leftmost of the lowest rank.
    tree = [_NONE] * (2 * size)
    sym, nxt, prv = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    for i in range(n - 1):
        rank = get(sym[i] << 20 | sym[i + 1])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    position = (1 << bits) - 1
    while (root := tree[1]) != _NONE:
        i = root & position
        j = nxt[i]
        sym[i] = new = merged[root >> bits]
        after, before = nxt[j], prv[i]
        nxt[i] = after
        changed = [(j, _NONE), (i, _NONE)]
        if after < n:
            prv[after] = i
            rank = get(new << 20 | sym[after])
            if rank is not None:
                changed[1] = (i, rank << bits | i)
        if before >= 0:
            rank = get(sym[before] << 20 | new)
            changed.append((before, _NONE if rank is None else rank << bits | before))
        for at, value in changed:
            k = size + at
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                a, b = tree[k], tree[k ^ 1]
                k >>= 1
                least = a if a < b else b
                if tree[k] == least:
                    break
                tree[k] = least
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = nxt[i]
    return out


class Codec:
    """Encodes and decodes as the vocabulary file of a byte-level BPE tokenizer says."""

    def __init__(self, spec: dict) -> None:
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in spec["model"]["merges"]]
        self.ranks = {vocab[a] << 20 | vocab[b]: rank for rank, (a, b) in reversed(list(enumerate(pairs)))}
        self.merged = [vocab[a + b] for a, b in pairs]
        to_char = byte_chars()
        to_byte = {c: b for b, c in to_char.items()}
        self.byte_id = [vocab[to_char[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items() if all(c in to_byte for c in token)}
        self.bytes_of |= {i: token.encode() for token, i in self.special.items()}
        self.pieces = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def _piece(self, piece: str) -> list[int]:
        ids = self.byte_id
        return merge([ids[b] for b in piece.encode("utf-8")], self.ranks, self.merged)

    def encode(self, text: str) -> list[int]:
        """Ids of a text. Special tokens in it become their ids, as the tokenizers library does by default."""
        out: list[int] = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for piece in self.pieces.findall(part):
                    out += self._piece(piece)
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, special tokens included; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def _known(self, piece: str) -> tuple[int, str, bytes]:
        """Number of ids, ids in decimal, and the bytes that these ids decode to."""
        ids = [self.special[piece]] if piece in self.special else self._piece(piece)
        found = len(ids), ",".join(map(str, ids)), b"".join([self.bytes_of[i] for i in ids])
        if len(piece) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            self.cache[piece] = found
        return found

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal joined by commas, SHA-256 of the decoded text."""
        parts = self.specials.split(text) if self.specials and any(s in text for s in self.special) else [text]
        get, total = self.cache.get, 0
        ids, back = [], []
        for part in parts:
            for piece in [part] if part in self.special else self.pieces.findall(part):
                n, decimal, raw = get(piece) or self._known(piece)
                total += n
                ids.append(decimal)
                back.append(raw)
        decoded = b"".join(back).decode("utf-8", "replace").encode()
        return total, hashlib.sha256(",".join(ids).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()


@lru_cache(maxsize=2)
def _codec(spec: str) -> Codec:
    return Codec(json.loads(spec))


def load_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; a null text counts as empty and has no ids."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for texts in batches:
            yield pd.Series([codec.encode(t or "") for t in texts])

    return docs.select(F.col(id_col).alias("doc_id"), ids(F.col(text_col)).alias("ids"))


def decode(encoded: DataFrame, spec: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every row of ids; null ids count as none."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared.value)
        for rows in batches:
            yield pd.Series([codec.decode([] if ids is None else list(ids)) for ids in rows], dtype=object)

    return encoded.select(F.col(id_col).alias("doc_id"), text(F.col(ids_col)).alias("text"))


def digests(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Encodes and decodes as encode() and decode() do, without holding the ids of
    a whole batch. A null text counts as empty. Rows are handled each by itself,
    so ties, repeated rows and other columns don't matter; an empty table gives
    an empty result. The vocabulary file is one fixed file of under 2 MB,
    broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared.value)
        for texts in batches:
            yield pd.DataFrame([codec.digest(t or "") for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("doc_id"), both(F.col(text_col)).alias("_d")).select("doc_id", "_d.*")
