"""Language-model scoring with a causal self-attention model over subword ids.

Three things are learned from the training texts. Word counts, over all of
them, give a unigram score for comparison. From the same table come counts of
subwords and of subword pairs in words, over all of them too, which are the
model's output bias. The attention weights are fitted in numpy in one pass over
all of them as well, in three rounds over disjoint parts of growing size: each
task trains on its own texts of a part, and the weights are averaged after it.

The output is factored: a subword belongs to a leaf (frequent ones have their
own), leaves belong to equal groups of those with like neighbours, and log P(subword) =
log P(group) + log P(leaf in group) + log P(subword in leaf). Attention decides
on the first two; the last is by counts. The model sees windows of WINDOW
subwords that overlap; each subword is scored once, in the window that gives it
at least OVERLAP subwords of context. A word's probability is the product of its
subwords'; for words of the training texts it is mixed with their frequency, so
that the whole stays a probability.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.bpe import PATTERN
from graphloom.llm.common import cut, repeated

WINDOW, OVERLAP = 32, 8
WIDTH, GROUPS, LEAVES = 16, 32, 1024  # as many groups as leaves in each, so that both softmaxes are rows of one array
#: Parts of the training texts, by hash, that the attention weights are fitted on one after the other, each text being in one; the rate of the first.
PARTS, RATE = (1 / 64, 1 / 8, 1), 0.01
#: A word with at least this share of all tokens travels with the code, as a hash and a number; there can't be more than 1 / HEAVY of them.
HEAVY = 1 / 1_000_000
#: Words that a task counts before it hands them on.
COUNTED = 500_000
#: Words that a task keeps the subwords of.
CACHE_WORDS = 700_000
#: Windows per step of the first part's training, which doubles with each part, and of scoring.
TRAIN_BATCH, SCORE_BATCH = 64, 256
#: Texts, and bytes of them unless one alone has more, that are taken apart at a time.
PIECE_TEXTS, PIECE_BYTES = 256, 1 << 19
#: Part of the attention model in the probability of a word that the training texts have; the rest is the word's own frequency.
MIXED = 0.5
_PRIOR = 20.0  # weight of the unigram distribution in that of pairs


@dataclass
class Vocabulary:
    """Leaves of subwords. The id past the vocabulary's is the end. Leaves of a group are numbered in a row."""

    leaf: np.ndarray  # of each subword
    in_leaf: np.ndarray  # log P(subword in its leaf)
    group: np.ndarray | None = None  # of each leaf, ascending
    starts: np.ndarray | None = None  # first leaf of each group, and the end
    bias: np.ndarray | None = None  # by_group and then in_each

    @property
    def by_group(self) -> np.ndarray:
        """log P(group after leaf), for LEAVES + 1 contexts, the last a word's start."""
        return self.bias[: LEAVES + 1]

    @by_group.setter
    def by_group(self, value: np.ndarray) -> None:
        self.bias = np.concatenate([value, self.in_each])

    @property
    def in_each(self) -> np.ndarray:
        """log P(leaf in group after leaf), a row for each context and group."""
        return self.bias[LEAVES + 1 :]

    @property
    def in_group(self) -> list[np.ndarray]:
        """log P(leaf in group after leaf) for each group, contexts x leaves of the group."""
        return [self.in_each[g::GROUPS] for g in range(GROUPS)]


def pieces(texts: pa.Array) -> Iterator[slice]:
    """Rows in a row that are taken apart together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(ends):
        b = np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE_BYTES, side="right")
        yield slice(a, a := min(max(int(b), a + 1), a + PIECE_TEXTS))


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, A-Z in lower case, the place of each word of the texts among them, and words in each text."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    bounds, coded = parts.offsets.to_numpy(), parts.values.dictionary_encode()
    place, counts = coded.indices.to_numpy(), np.diff(bounds).astype(np.int64)
    _, offsets, data = coded.dictionary.buffers()
    offsets, data = np.frombuffer(offsets or bytes(4), np.int32)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    words = [data[a:b] for a, b in zip(offsets, offsets[1:])]
    if b"" in words:  # what stands before white space at the start of a text, or after that at its end
        words.pop(k := words.index(b""))
        empty = np.flatnonzero(place == k)
        counts -= np.bincount(np.searchsorted(bounds, empty, side="right") - 1, minlength=len(counts))
        place = np.delete(place, empty)
        place -= place > k
    return words, place, counts


class _Numbers(dict):
    """Words to numbers from 1; a new word gets the next one and is noted."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self) + 1
        self.fresh.append(word)
        return n


class Splitter:
    """Subwords of words, kept for those seen last. spec: a file of byte-pair ranks (base64 of a token, its rank)."""

    def __init__(self, spec: str, heavy: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line)}
        self._encode = tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.end = max(ranks.values()) + 1
        self._spaced = np.zeros(self.end, dtype=bool)  # subwords that begin with a space, as the first of each word and no other
        self._spaced[[n for x, n in ranks.items() if x[:1] == b" "]] = True
        self.heavy = heavy or (np.zeros(0, np.int64), np.zeros(0))  # hashes, ascending, and log10 of (count + 0.1)
        self._clear()

    def _clear(self) -> None:
        self.ids = _Numbers()
        self.used = self.filled = 1  # number 0 is the end of a text
        self.flat, self.start, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.hash, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14)
        self.flat[0], self.length[0] = self.end, 1

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of words in a row, and how many each word has."""
        # A few thousand at a time, as the encoder is slower on long texts.
        parts = [self._split(words[k : k + 2000]) for k in range(0, len(words), 2000)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        flat, lengths = zip(*parts)
        return np.concatenate(flat), np.concatenate(lengths)

    def _split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        text = b" ".join([b"", *words]).decode("utf-8", "replace")
        # All at once, unless a word has white space beyond ASCII in it, at which the pattern parts it.
        if len(text.split()) == len(words):
            flat = np.array(self._encode(text), dtype=np.int32)
            starts = np.flatnonzero(self._spaced[flat])
            if len(starts) == len(words):
                return flat, np.diff(starts, append=len(flat))
        parts = [self._encode(" " + w.decode("utf-8", "replace")) for w in words]
        lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        return np.fromiter(chain.from_iterable(parts), dtype=np.int32, count=int(lengths.sum())), lengths

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words, which index start, length, hash and known; valid until the next call."""
        if len(self.ids) > CACHE_WORDS:
            self._clear()
        out = np.fromiter(map(self.ids.__getitem__, words), dtype=np.int64, count=len(words))
        fresh = self.ids.fresh
        if fresh:
            flat, n = self.split(fresh)
            while self.filled + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            while self.used + len(fresh) > len(self.start):
                self.start, self.length, self.hash, self.known = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length, self.hash, self.known))
            at = slice(self.used, self.used + len(fresh))
            self.flat[self.filled : self.filled + len(flat)] = flat
            self.start[at], self.length[at] = self.filled + np.cumsum(n) - n, n
            self.hash[at] = np.array([xxhash.xxh64_intdigest(w, 42) for w in fresh], dtype=np.uint64).view(np.int64)
            hashes, values = self.heavy
            place = np.searchsorted(hashes, self.hash[at])
            self.known[at] = np.nan
            there = np.flatnonzero(place < len(hashes))
            there = there[hashes[place[there]] == self.hash[at][there]]
            self.known[self.used + there] = values[place[there]]
            self.used, self.filled = self.used + len(fresh), self.filled + len(flat)
            self.ids.fresh = []
        return out

    def stream(self, texts: pa.Array | list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Subwords of all texts, each text closed by the end; whether each starts a word; bounds of texts; word numbers; words in each text."""
        words, place, counts = words_of(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        number = self.numbers(words)[place]
        # One more, of number 0, for the end of each text.
        closing = np.cumsum(counts + 1) - 1
        own = np.ones(len(number) + len(counts), dtype=bool)
        own[closing] = False
        every = np.zeros(len(own), np.int64)
        every[own] = number
        length, start = np.take(self.length, every), np.take(self.start, every)
        cum = np.cumsum(length)
        begin = cum - length
        start -= begin
        at = np.repeat(start, length)
        at += np.arange(len(at))
        out = np.take(self.flat, at)
        first = np.zeros(len(out), dtype=bool)
        first[begin] = True
        return out, first, np.concatenate([[0], cum[closing]]), number, counts


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first subword, first to be scored) of each window over texts with these bounds."""
    n = np.diff(bounds)
    step = WINDOW - OVERLAP
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // step)), 0)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    begin = np.repeat(bounds[:-1], count) + nth * step
    return begin, np.where(nth == 0, begin, begin + OVERLAP)


def new_weights(seed: int = 7) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    make = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
    d = WIDTH
    # The output starts at nought, so that the model starts as its bias.
    return {"embed": make(LEAVES + 1, d, scale=0.3), "place": make(WINDOW, d, scale=0.1), "q": make(d, d, scale=d**-0.5), "k": make(d, d, scale=d**-0.5), "v": make(d, d, scale=d**-0.5), "o": make(d, d, scale=d**-0.5), "group": np.zeros((d, GROUPS), np.float32), "leaf": np.zeros((d, LEAVES), np.float32)}


_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def _hidden(w: dict[str, np.ndarray], before: np.ndarray, skip: int = 0) -> tuple[np.ndarray, ...]:
    """Masked attention over windows; before: leaf before each place (LEAVES: none). The first ``skip`` places of each are only looked at.

    q and k come as their product, which takes the place of both projections, and
    so do v and o: 1 and 1 product with the states instead of 3 and 1.
    """
    n, long = before.shape
    x = np.take(w["embed"], before, axis=0)
    x += w["place"][:long]
    own = np.ascontiguousarray(x[:, skip:]).reshape(-1, WIDTH)
    t = (own @ (w["q"] @ w["k"].T * np.float32(WIDTH**-0.5))).reshape(n, long - skip, WIDTH)
    a = np.matmul(t, x.transpose(0, 2, 1))
    seen, ones = _CAUSAL[skip:long, :long], np.ones(long, x.dtype)
    with np.errstate(over="ignore", invalid="ignore"):
        np.exp(a, out=a)
        a *= seen
        total = a.reshape(-1, long) @ ones
    if not np.isfinite(total).all() or not (total > 1e-30).all():
        a = np.where(seen > 0, np.matmul(t, x.transpose(0, 2, 1)), -np.inf).astype(x.dtype)
        a -= a.max(axis=-1, keepdims=True)
        np.exp(a, out=a)
        total = a.reshape(-1, long) @ ones
    part = (1 / total)[:, None]
    z = np.matmul(a, x).reshape(-1, WIDTH)
    z *= part
    h = z @ (w["v"] @ w["o"])
    h += own
    return h.reshape(n, long - skip, WIDTH), x, own, t, a, z, part


def _sorted(voc: Vocabulary, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts targets of one group together, and where each group starts in it."""
    g = voc.group[target]
    order = np.argsort(g, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(g, minlength=GROUPS))])


_ONES = np.ones(LEAVES, np.float32)


def log_probs(w: dict[str, np.ndarray], voc: Vocabulary, h: np.ndarray, context: np.ndarray, target: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """log P(target leaf) for places with hidden state h, bias context and target leaf; rows: the places' own of h, else all."""
    order, cuts = _sorted(voc, target)
    h, context, target = np.take(h, order if rows is None else rows[order], axis=0), np.take(context, order), np.take(target, order)
    out = np.empty(len(order), h.dtype)
    out[order] = _picked(_logits(_by_group(w), voc, h, context, target, cuts), _at(voc, target)).reshape(-1, 2).sum(axis=1)
    return out


def _by_group(w: dict[str, np.ndarray]) -> np.ndarray:
    """Output weights as a matrix for each group, with those of all groups and then those of its leaves, all in a row."""
    out = np.empty((GROUPS, WIDTH, 2 * GROUPS), w["leaf"].dtype)
    out[:, :, :GROUPS] = w["group"]
    out[:, :, GROUPS:] = w["leaf"].reshape(WIDTH, GROUPS, GROUPS).transpose(1, 0, 2)
    return out


def _logits(weights: np.ndarray, voc: Vocabulary, h: np.ndarray, context: np.ndarray, target: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Two rows for each place, logits of the groups and of the leaves of the target's, for places in order of groups; weights: by group."""
    out = np.empty((len(h), 2 * GROUPS), h.dtype)
    for a, b, own in zip(cuts, cuts[1:], weights):
        if a < b:
            np.matmul(h[a:b], own, out=out[a:b])
    row = np.empty((len(h), 2), np.int64)
    row[:, 0] = context
    row[:, 1] = context * GROUPS + voc.group[target] + (LEAVES + 1)
    out = out.reshape(-1, GROUPS)
    out += np.take(voc.bias, row.ravel(), axis=0)
    return out


def _at(voc: Vocabulary, target: np.ndarray) -> np.ndarray:
    """The targets' columns in the rows that _logits() gives."""
    at = np.empty((len(target), 2), np.int64)
    at[:, 0] = voc.group[target]
    at[:, 1] = target - voc.starts[at[:, 0]]
    return at.ravel()


def _picked(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log softmax of the rows of x, at one column each."""
    own = np.take(x, at + np.arange(0, x.size, x.shape[1]))
    with np.errstate(over="ignore"):
        total = np.exp(x) @ _ONES[: x.shape[1]]
    if not np.isfinite(total).all() or not total.all():
        top = x.max(axis=1)
        return own - top - np.log(np.exp(x - top[:, None]).sum(axis=1))
    return own - np.log(total)


def _leaves(voc: Vocabulary, ids: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each subword, the leaf before it (LEAVES: none; as many more as a window may reach past the end) and its bias context."""
    leaf = voc.leaf[ids]
    before = np.concatenate([[LEAVES], leaf[:-1], np.full(WINDOW, LEAVES)])
    before[bounds[:-1][np.diff(bounds) > 0]] = LEAVES
    return leaf, before, np.where(first, LEAVES, before[: len(ids)])


def _batches(bounds: np.ndarray, size: int, turn: Callable[[int], np.ndarray] = np.arange) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(places, how many of each row are only looked at, which of the others are due) of so many windows at a time; turn: the order for a number of them.

    A text's first OVERLAP places, where nothing stands before, are rows of their
    own, so that the first OVERLAP places of windows never are worked out in vain.
    """
    some = np.diff(bounds) > 0
    begin = windows(bounds)[0]
    stop = bounds[np.searchsorted(bounds, begin, side="right")]
    later = begin + OVERLAP < stop
    for start, end, long, skip, n in ((bounds[:-1][some], bounds[1:][some], OVERLAP, 0, size * (WINDOW - OVERLAP) // OVERLAP), (begin[later], stop[later], WINDOW, OVERLAP, size)):
        order = turn(len(start))
        for c in range(0, len(order), n):
            pick = order[c : c + n]
            at = start[pick, None] + np.arange(long)
            yield at, skip, at[:, skip:] < end[pick, None]


def score_stream(w: dict[str, np.ndarray], voc: Vocabulary, ids: np.ndarray, first: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of every subword of a stream."""
    out = voc.in_leaf[ids].astype(np.float64)
    leaf, before, context = _leaves(voc, ids, first, bounds)
    for at, skip, due in _batches(bounds, SCORE_BATCH):
        h = _hidden(w, before[at], skip)[0]
        pick = at[:, skip:][due]
        out[pick] += log_probs(w, voc, h.reshape(-1, WIDTH), context[pick], leaf[pick], np.flatnonzero(due))
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of rows. Their maxima are looked for only where sums can't be told without."""
    with np.errstate(over="ignore"):
        e = np.exp(x)
        total = e @ _ONES[: x.shape[1]].astype(x.dtype, copy=False)
    if not np.isfinite(total).all() or not (total > 1e-30).all():
        e = np.exp(x - x.max(axis=1)[:, None])
        total = e.sum(axis=1)
    e *= (1 / total)[:, None]
    return e


def gradients(w: dict[str, np.ndarray], voc: Vocabulary, before: np.ndarray, due: np.ndarray, context: np.ndarray, target: np.ndarray, skip: int = 0) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss and its gradients for a batch of windows, of which the first ``skip`` places are only looked at; due: which of the others count."""
    h, x, own, t, a, z, part = _hidden(w, before, skip)
    order, cuts = _sorted(voc, target)
    rows = np.flatnonzero(due)[order]
    scored, context, target = np.take(h.reshape(-1, WIDTH), rows, axis=0), context[order], target[order]
    n, weights, at = max(1, len(target)), _by_group(w), _at(voc, target)
    d = _softmax(_logits(weights, voc, scored, context, target, cuts))
    at += np.arange(0, d.size, GROUPS)
    likely = np.take(d, at)
    np.put(d, at, likely - 1)
    d = d.reshape(-1, 2 * GROUPS)
    d_weights, dh = np.zeros_like(weights), np.empty_like(scored)
    for i, j, own_weights, d_own in zip(cuts, cuts[1:], weights, d_weights):
        if i < j:
            np.matmul(scored[i:j].T, d[i:j], out=d_own)
            np.matmul(d[i:j], own_weights.T, out=dh[i:j])
    d_weights /= n
    out = {"group": d_weights[:, :, :GROUPS].sum(axis=0), "leaf": d_weights[:, :, GROUPS:].transpose(1, 0, 2).reshape(w["leaf"].shape)}
    dh /= n
    flat = np.zeros_like(own)
    flat[rows] = dh
    d_vo = z.T @ flat
    out["v"], out["o"] = d_vo @ w["o"].T, w["v"].T @ d_vo
    dz = flat @ (w["v"] @ w["o"]).T
    dz *= part  # a isn't divided by its sums
    less = np.einsum("ij,ij->i", dz, z)
    dz = dz.reshape(t.shape)
    da = np.matmul(dz, x.transpose(0, 2, 1))
    da -= less.reshape(*due.shape, 1)
    da *= a
    dt = np.matmul(da, x).reshape(-1, WIDTH)
    dx = np.matmul(a.transpose(0, 2, 1), dz)
    dx += np.matmul(da.transpose(0, 2, 1), t)
    scale = np.float32(WIDTH**-0.5)
    flat += dt @ (w["k"] @ w["q"].T * scale)
    dx[:, skip:] += flat.reshape(t.shape)
    d_qk = own.T @ dt * scale
    out["q"], out["k"] = d_qk @ w["k"], d_qk.T @ w["q"]
    out["place"] = np.zeros_like(w["place"])
    out["place"][: before.shape[1]] = dx.sum(axis=0)
    leaf = before.ravel().astype(np.int16)
    turn = np.argsort(leaf, kind="stable")
    leaf = leaf[turn]
    start = np.concatenate([[0], 1 + np.flatnonzero(leaf[1:] != leaf[:-1])])
    out["embed"] = np.zeros_like(w["embed"])
    out["embed"][leaf[start]] = np.add.reduceat(np.take(dx.reshape(-1, WIDTH), turn, axis=0), start, axis=0)
    return -float(np.log(likely).sum()) / n, out


def fit(w: dict[str, np.ndarray], voc: Vocabulary, streams: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], rate: float = RATE, batch: int = TRAIN_BATCH) -> tuple[dict[str, np.ndarray], int]:
    """One pass of Adam over streams (ids, first, bounds), so many windows a step: new weights and the number of windows seen."""
    # All weights stand in one array, so that a step is a few calls.
    every = _pack(w)
    w, d = _views(every, w), np.empty_like(every)
    grad, m1, m2 = _views(d, w), np.zeros_like(every), np.zeros_like(every)
    seen = step = 0
    r = np.random.default_rng(11)
    for ids, first, bounds in streams:
        leaf, before, context = _leaves(voc, ids, first, bounds)
        for at, skip, due in _batches(bounds, batch, r.permutation):
            pick = at[:, skip:][due]
            for n, a in gradients(w, voc, before[at], due, context[pick], leaf[pick], skip)[1].items():
                grad[n][...] = a
            step += 1
            one, two = rate / (1 - 0.9**step), 1 / (1 - 0.99**step)
            m1 *= 0.9
            m1 += 0.1 * d
            m2 *= 0.99
            d *= d
            d *= 0.01
            m2 += d
            np.multiply(m2, two, out=d)
            np.sqrt(d, out=d)
            d += 1e-6
            np.divide(m1, d, out=d)
            d *= one
            every -= d
        seen += len(windows(bounds)[0])
    return w, seen


def mixed(lp: np.ndarray, own: np.ndarray) -> np.ndarray:
    """log10 probability of words from the model's and that by frequency (both log10)."""
    a, b = lp + math.log10(MIXED), own + math.log10(1 - MIXED)
    return np.maximum(a, b) + np.log10(1 + np.power(10.0, -np.abs(a - b)))


def held_out(doc_id: Column) -> Column:
    """Whether a text is kept out of training. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _word_counts(train: DataFrame, text_col: str) -> DataFrame:
    """(word, c) of all words: tasks count theirs and hand on what they have when that is COUNTED words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[bytes] = Counter()

        def flushed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(found)).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "c"])
            found.clear()
            return out

        for b in batches:
            for rows in pieces(texts := b.column(0)):
                words, place, _ = words_of(texts[rows])
                for w, n in zip(words, np.bincount(place, minlength=len(words)).tolist()):
                    found[w] += n
                if len(found) > COUNTED:
                    yield flushed()
        if found:
            yield flushed()

    return train.select(text_col).mapInArrow(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def group_leaves(two: np.ndarray, groups: int, rounds: int = 12) -> np.ndarray:
    """Group of each leaf, from counts two (contexts x leaves), by what comes before and after it: k-means on directions, the same each time.

    Groups are of one size, so that a subword costs the same in each and those of
    all groups are worked out together. Frequent leaves choose first.
    """
    after = two[: two.shape[1]]
    x = np.hstack([np.sqrt(c / c.sum(axis=1, keepdims=True)) for c in (after, two.T)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    weight = two.sum(axis=0)[:, None]
    often = x[np.argsort(-weight[:, 0], kind="stable")[: 8 * groups]]
    centres = often[:1]
    while len(centres) < groups:  # next the frequent leaf that is furthest from all
        centres = np.vstack([centres, often[(often @ centres.T).max(axis=1).argmin()]])
    turn = np.argsort(-weight[:, 0], kind="stable").tolist()

    def nearest() -> np.ndarray:
        ranked = np.argsort(-(x @ centres.T), axis=1, kind="stable").tolist()
        out, room = np.empty(len(x), np.int64), [-(-len(x) // groups)] * groups
        for leaf in turn:
            out[leaf] = g = next(g for g in ranked[leaf] if room[g])
            room[g] -= 1
        return out

    for _ in range(rounds):
        group = nearest()
        sums = np.stack([(weight * x)[group == g].sum(axis=0) if (group == g).any() else centres[g] for g in range(groups)])
        centres = sums / np.linalg.norm(sums, axis=1, keepdims=True)
    return nearest()


def learn_vocabulary(counts: DataFrame, n_texts: int, spec: str) -> Vocabulary:
    """Leaves, groups and output bias from word counts (word, c). What comes to the driver has a row for each subword, or pair of leaves, at most."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(spec)
        size = splitter.end + 2
        for b in batches:
            # A few thousand words at a time: pairs are summed by Spark, not held here.
            for k in range(0, b.num_rows, 20_000):
                part = b.slice(k, 20_000)
                now, lengths = splitter.split([x.encode() for x in part.column(0).to_pylist()])
                now = now.astype(np.int64)
                before = np.concatenate([[size - 1], now[:-1]])
                before[np.cumsum(lengths) - lengths] = size - 1
                both, at = np.unique(before * size + now, return_inverse=True)
                n = np.bincount(at, weights=np.repeat(part.column(1).to_numpy(), lengths)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array((both // size).astype(np.int32)), pa.array((both % size).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])

    size = Splitter(spec).end + 1
    found = cut(counts.mapInArrow(pairs, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    n = np.zeros(size)
    single = found.groupBy("b").agg(F.sum("n").alias("n")).toPandas()
    n[single["b"].to_numpy(dtype=np.int64)] = single["n"].to_numpy(dtype=np.float64)
    n[size - 1] += n_texts
    order = np.argsort(-n, kind="stable")
    own = LEAVES - 64
    leaf = np.zeros(size, dtype=np.int64)
    leaf[order[:own]] = np.arange(own)
    leaf[order[own:]] = own + np.minimum(63, 64 * np.arange(size - own) // (size - own))
    weight = n + 0.1
    by_leaf = np.bincount(leaf, weights=weight, minlength=LEAVES)
    voc = Vocabulary(leaf, np.log(weight / by_leaf[leaf]).astype(np.float32))
    with_start = np.append(leaf, LEAVES)  # the id past all stands for a word's start

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array((with_start[b.column(0).to_numpy()] * LEAVES + leaf[b.column(1).to_numpy()]).astype(np.int32)), b.column(2)], names=["id", "n"])

    summed = found.mapInArrow(leaves, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    two = np.zeros((LEAVES + 1) * LEAVES)
    two[summed["id"].to_numpy(dtype=np.int64)] = summed["n"].to_numpy(dtype=np.float64)
    two = two.reshape(LEAVES + 1, LEAVES)
    two[LEAVES, leaf[size - 1]] += n_texts
    return with_bias(voc, two, by_leaf)


def with_bias(voc: Vocabulary, two: np.ndarray, by_leaf: np.ndarray) -> Vocabulary:
    """voc with groups and output bias from counts of pairs and of leaves."""
    two = two + _PRIOR * by_leaf / by_leaf.sum()
    group = group_leaves(two, GROUPS)
    # Leaves get their numbers by group.
    order = np.argsort(group, kind="stable")
    number = np.empty(LEAVES, np.int64)
    number[order] = np.arange(LEAVES)
    voc.leaf, voc.group = number[voc.leaf], group[order].astype(np.uint8)
    voc.starts = np.searchsorted(voc.group, np.arange(GROUPS + 1))
    two = two[np.append(order, LEAVES)][:, order]
    joint = two / two.sum(axis=1, keepdims=True)
    joint = joint.reshape(LEAVES + 1, GROUPS, LEAVES // GROUPS)
    by_group = joint.sum(axis=2)
    voc.bias = np.concatenate([np.log(by_group), (np.log(joint) - np.log(by_group)[:, :, None]).reshape(-1, GROUPS)]).astype(np.float32)
    return voc


def _pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def _views(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The arrays that _pack() put into flat, which they share."""
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape)
        at += like[n].size
    return out


def _unpack(flat: np.ndarray) -> dict[str, np.ndarray]:
    return {n: a.astype(np.float32) for n, a in _views(flat, new_weights()).items()}


def train_weights(texts: DataFrame, voc: Vocabulary, spec: str, parts: tuple[float, ...] = PARTS) -> dict[str, np.ndarray]:
    """Attention weights fitted on a table with one text column: every task fits its own texts of a part, the mean by windows goes on.

    parts: where, on the scale from 0 to 1 of the texts' hashes, each part ends.
    """
    spark = texts.sparkSession
    w = new_weights()
    shared_voc, run_id = spark.sparkContext.broadcast(voc), uuid.uuid4().hex
    # Of a seed of its own, as equal texts are alike in every hash.
    place = F.pmod(F.xxhash64(F.lit("part"), F.coalesce(F.col(texts.columns[0]), F.lit(""))), F.lit(1 << 20)) / float(1 << 20)
    for k, (low, high) in enumerate(zip((0.0, *parts), parts)):
        shared = spark.sparkContext.broadcast(w)
        rate, batch = RATE / (1 + k), TRAIN_BATCH << k

        def one(batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, batch=batch) -> Iterator[pa.RecordBatch]:
            splitter = _shared_splitter(run_id, spec)

            def streams() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
                for b in batches:
                    for rows in pieces(column := b.column(0)):
                        yield splitter.stream(column[rows])[:3]

            new, seen = fit(shared.value, shared_voc.value, streams(), rate, batch)
            if seen:
                flat = _pack(new).astype(np.float64) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat), pa.array(np.full(len(flat), seen, dtype=np.int64))], names=["i", "w", "n"])

        mean = texts.where((place >= low) & (place < high)).mapInArrow(one, "i int, w double, n long").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas()
        if not len(mean):
            continue
        flat = np.zeros(len(mean))
        flat[mean["i"].to_numpy()] = mean["w"].to_numpy()
        w = _unpack(flat)
    return w


_SPLITTERS: dict[str, Splitter] = {}


def _shared_splitter(run_id: str, spec: str, heavy: tuple[np.ndarray, np.ndarray] | None = None) -> Splitter:
    """A worker's splitter for one run, which its tasks share one after the other."""
    if run_id not in _SPLITTERS:
        # Once a large block has come and gone, glibc keeps freed memory of up to twice its size, so that the
        # arrays of each batch needn't be mapped and cleared anew. The block itself is never touched.
        np.empty(30 << 20, np.uint8)
        _SPLITTERS.clear()
        _SPLITTERS[run_id] = Splitter(spec, heavy)
    return _SPLITTERS[run_id]


_DOC = "struct<n_tokens:bigint,score:double,heavy:double,n_heavy:bigint,rows:bigint>"


def score(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability) of every row.

    A null text counts as empty and has the end as its one token. Rows with
    equal id and text are scored alike, each. Other columns are ignored. Without
    training texts every token is unknown and the model is its prior; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row goes by 128 bits of its id and text.
    key = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col).isNull(), F.col(id_col), text)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"), key("a").alias("k1"), key("b").alias("k2"))
    train = base.where(~held_out(F.col("doc_id")))
    counts = cut(_word_counts(train, "t"))
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_texts = train.select("doc_id").count()
    total, kinds = tokens + n_texts, distinct + (n_texts > 0)
    below = math.log10(total + 0.1 * (kinds + 1))
    least = max(1, total * HEAVY)
    often = counts.where(F.col("c") >= least).select(F.xxhash64("word").alias("h"), "c").toArrow()  # at most 1 / HEAVY rows
    order = np.argsort(often.column("h").to_numpy())
    heavy = often.column("h").to_numpy()[order], np.log10(often.column("c").to_numpy()[order] + 0.1)
    end_score = math.log10(n_texts + 0.1) - below
    voc = learn_vocabulary(counts, n_texts, spec)
    shared = spark.sparkContext.broadcast((train_weights(train.select("t"), voc, spec), voc, heavy))

    run_id = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, voc, heavy = shared.value
        splitter = _shared_splitter(run_id, spec, heavy)
        for b in batches:
            for part in pieces(b.column(1)):
                rows = b.slice(part.start, part.stop - part.start)
                ids, first, bounds, number, words = splitter.stream(rows.column(1))
                by_word = np.add.reduceat(score_stream(weights, voc, ids, first, bounds), np.flatnonzero(first)) / math.log(10)
                closing = np.cumsum(words + 1) - 1
                ends, by_word = by_word[closing], np.delete(by_word, closing)
                at = np.repeat(np.arange(len(words)), words)
                known = splitter.known[number]
                light = np.isnan(known)
                sure = mixed(by_word[~light], known[~light] - below)
                doc = {
                    "n_tokens": words + 1, "score": np.bincount(at[~light], weights=sure, minlength=len(words)) + (mixed(ends, np.full(len(ends), end_score)) if n_texts else ends),
                    "heavy": np.bincount(at[~light], weights=known[~light] - below, minlength=len(words)),
                    "n_heavy": np.bincount(at[~light], minlength=len(words)), "rows": np.ones(len(words), dtype=np.int64),
                }
                offsets = np.concatenate([[0], np.cumsum(np.bincount(at[light], minlength=len(words)))])
                pairs = pa.StructArray.from_arrays([pa.array(splitter.hash[number[light]]), pa.array(by_word[light].astype(np.float32))], names=["h", "lp"])
                listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pairs)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), rows.column(3), pa.StructArray.from_arrays([pa.array(v) for v in doc.values()], names=list(doc)), listed], names=["doc_id", "k1", "k2", "doc", "light"])

    kind = base.schema["doc_id"].dataType.simpleString()
    scored = base.select("doc_id", "t", "k1", "k2").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, doc {_DOC}, light array<struct<h:bigint,lp:float>>")
    # The row's own figures go with its first place, the hash of a rarer word with each later one.
    places = F.concat(F.array(F.lit(None).cast("struct<h:bigint,lp:float>")), F.col("light"))
    long = scored.select("k1", "k2", F.struct("doc_id", "doc.*").alias("doc"), F.posexplode(places).alias("pos", "w")).select("k1", "k2", "w.h", "w.lp", F.when(F.col("pos") == 0, F.col("doc")).alias("doc"))
    rare = counts.where(F.col("c") < least).select(F.xxhash64("word").alias("_h"), "c")
    joined = long.join(rare, F.col("h") == F.col("_h"), "left")
    word = F.when(F.col("h").isNotNull(), F.log10(F.coalesce("c", F.lit(0)) + 0.1) - below)
    a, b = F.col("lp").cast("double") + math.log10(MIXED), word + math.log10(1 - MIXED)
    model = F.when(F.col("c").isNull(), a).otherwise(F.greatest(a, b) + F.log10(1 + F.pow(F.lit(10.0), -F.abs(a - b))))
    d = lambda name: F.max(f"doc.{name}").alias(name)
    summed = joined.groupBy("k1", "k2").agg(
        F.sum("doc.rows").alias("rows"), *[d(n) for n in ("doc_id", "n_tokens", "score", "heavy", "n_heavy")],
        F.coalesce(F.sum(word), F.lit(0.0)).alias("rare"), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), model)), F.lit(0.0)).alias("rare_score"), F.count("c").alias("n_rare"),
    )
    return repeated(summed, "rows").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens",
        (F.col("n_heavy") + (F.col("n_rare") / F.col("rows")).cast("long") + int(n_texts > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("heavy") + F.col("rare") / F.col("rows") + end_score).alias("base_score"), (F.col("score") + F.col("rare_score") / F.col("rows")).alias("score"),
    )
