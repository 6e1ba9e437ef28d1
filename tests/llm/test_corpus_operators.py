"""Quality classifier, LM scoring, SimHash, sharding, decontamination and the pipeline against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphloom.llm import components, decontamination, lm_scoring, quality_classifier, sharding, simhash
from graphloom.llm.queries import TOKENIZERS

SPEC = open(f"{TOKENIZERS}/byte_bpe_50k.tiktoken", encoding="utf-8").read()
TINY = "/root/testdata/sf0.001"


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(*r, *[None] * (len(schema.split(",")) - len(r))) for r in rows], schema)


def union_find(ids, pairs):
    p = {i: i for i in ids}

    def root(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        p[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# Components.


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, k) for k in range(2001, 2100)] + [(7, 7)]
    want = union_find({x for e in edges for x in e}, edges)
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# SimHash.


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: chr(c + 32) for c in range(65, 91)}))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near(r, n, copies, words=60):
    vocabulary = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(words)]
        for _ in range(r.randint(1, copies)):
            own = list(base)
            for _ in range(r.randint(0, 2)):
                own[r.randrange(words)] = r.choice(vocabulary)
            out.append(" ".join(own))
    return out


def test_fingerprints():
    for t in [None, "", " ", "a", "A b", "É the Cat  sat\ton", "x y z x y z", "a\x85b c\x1cd e f", "w " * 70_000]:
        assert simhash.fingerprint(t) == (plain_fingerprint(t) if t is None or len(t) < 1000 else simhash.fingerprint("w w w w"))


def test_index_finds_every_pair():
    r = np.random.default_rng(2)
    codes = [0, 2**64 - 1]
    for base in r.integers(0, 2**63, 40, dtype=np.uint64).tolist():
        codes += [base ^ sum(1 << int(k) for k in r.choice(64, r.integers(0, 5), replace=False)) for _ in range(30)]
    codes = np.unique(np.array(codes, dtype=np.uint64))
    ordered = codes[np.argsort(simhash.gray_rank(codes))]
    want = {tuple(x) for x in np.argwhere(np.triu(np.bitwise_count(ordered[:, None] ^ ordered[None, :]) <= 3, 1)).tolist()}
    index = simhash.GrayIndex(ordered)
    assert {x for i, j in index.later_within(np.arange(len(ordered)), 3, np.uint64(0)) for x in zip(i.tolist(), j.tolist())} == want
    at = {int(c): n for n, c in enumerate(ordered)}
    linked = union_find(range(len(ordered)), want)
    edges = {(at[int(a)], at[int(b)]) for c in range(10) for a, b in zip(*simhash.stars(codes, c))}
    assert union_find(range(len(ordered)), edges) == linked and len(edges) < 10 * len(codes)
    # Neighbours in Gray order differ in one bit.
    small = np.arange(256, dtype=np.uint64)
    gray = small ^ (small >> np.uint64(1))
    assert (simhash.gray_rank(gray) == small).all()


def test_near_duplicates(spark):
    r = random.Random(3)
    rows = list(enumerate(near(r, 40, 6)))
    rows += [(1000, None), (1001, ""), (1002, " "), (1003, "one"), (1003, "one"), (None, "one"), (-5, rows[0][1])]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    codes = [plain_fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 3]
    group = union_find(range(len(rows)), pairs)
    least = defaultdict(list)
    for i, g in group.items():
        least[g] += [rows[i][0]] if rows[i][0] is not None else []
    want = sorted(((rows[i][0], f"{codes[i]:016x}", min(least[g], default=None)) for i, g in group.items()), key=repr)
    assert sorted((tuple(x) for x in got), key=repr) == want
    assert simhash.near_duplicates(frame(spark, rows).where("false")).count() == 0
    kept = simhash.keep_one(frame(spark, rows).withColumnRenamed("lang", "_kept"))
    assert kept.columns == ["doc_id", "text", "_kept", "source", "n_chars"]
    assert sorted(x["doc_id"] for x in kept.collect()) == sorted({c for _, _, c in want})


# Quality classifier.


def slow_kneser_ney(counts):
    """Probabilities of trigrams by the textbook, from raw counts of shape (A, A, A)."""
    a = counts.shape[0]

    def d_of(c):
        n = [int((c == k).sum()) for k in range(1, 5)]
        d = [0.0, 0.5, 0.75, 0.9]
        if all(n):
            y = n[0] / (n[0] + 2 * n[1])
            e = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
            if 0 < e[0] < 1 and 0 < e[1] < 2 and 0 < e[2] < 3:
                d = [0.0, *e]
        return lambda x: d[min(int(x), 3)]

    two = (counts > 0).sum(axis=0)
    one = (two > 0).sum(axis=0)

    def p(context, w, table, lower):
        row = table[context] if context else table
        d, total = d_of(table), row.sum()
        if not total:
            return lower(w)
        return max(row[w] - d(row[w]), 0) / total + sum(d(x) for x in row) / total * lower(w)

    p1 = lambda w: p((), w, one, lambda _: 1 / a)
    p2 = lambda v: lambda w: p((v,), w, two, p1)
    return np.array([[[p((u, v), w, counts, p2(v)) for w in range(a)] for v in range(a)] for u in range(a)])


def test_kneser_ney(monkeypatch):
    monkeypatch.setattr(quality_classifier, "ALPHABET", 5)
    r = np.random.default_rng(4)
    counts = r.poisson(r.exponential(1.2, (5, 5, 5)))
    counts[2, 3] = 0
    got = np.exp(quality_classifier.kneser_ney(counts))
    assert np.allclose(got.sum(axis=-1), 1, atol=1e-5) and np.allclose(got, slow_kneser_ney(counts), atol=1e-5)


def plain_perplexity(texts, train):
    """Mean negative log probability of each text under interpolated modified Kneser-Ney of word pairs, by the textbook."""
    split = lambda t: re.findall(rb"[^\s.,;:()\"]+", re.sub(rb"[0-9]", b"0", (t or "").encode()))
    c2 = Counter((a, b) for t in train for w in [[b"<", *split(t), b">"]] for a, b in zip(w, w[1:]))
    c1 = Counter(b for _, b in c2)
    chars = np.zeros(quality_classifier.ALPHABET**3, np.int64)
    for t in train:
        for w in split(t):
            np.add.at(chars, quality_classifier.grams([w.decode() + " "])[0], 1)
    spellings = quality_classifier.kneser_ney(chars.reshape((quality_classifier.ALPHABET,) * 3))

    def discount(c):
        d = quality_classifier.discounts(np.array(list(c.values())))
        return lambda n: d[min(n, 3)] if n else 0.0

    d2, d1 = discount(c2), discount(c1)
    follow = defaultdict(list)
    for (a, _), n in c2.items():
        follow[a].append(n)

    def p1(w):
        rest = 0.0 if w == b">" else math.exp(quality_classifier.spelling([w], spellings)[0])
        return (c1[w] - d1(c1[w])) / c1.total() + sum(map(d1, c1.values())) / c1.total() * rest

    def p2(a, b):
        if a not in follow:
            return p1(b)
        n = sum(follow[a])
        return (c2[a, b] - d2(c2[a, b])) / n + sum(map(d2, follow[a])) / n * p1(b)

    out = []
    for t in texts:
        w = [b"<", *split(t), b">"]
        out.append(-sum(math.log(p2(a, b)) for a, b in zip(w, w[1:])) / (sum(len(x.decode()) + 1 for x in w[1:-1]) + 1) if len(w) > 2 else 0.0)
    return out


def test_pair_hash(spark):
    a, b = (np.random.default_rng(k).integers(-(2**63), 2**63 - 1, 50) for k in (1, 2))
    got = spark.createDataFrame([(int(x), int(y)) for x, y in zip(a, b)], "a long, b long").select(F.xxhash64("a", "b")).collect()
    assert [x[0] for x in got] == list(quality_classifier.pair_hash(a.view(np.uint64), b.view(np.uint64)).view(np.int64))


@pytest.mark.parametrize("small", [False, True])
def test_perplexity_against_plain(spark, monkeypatch, small):
    if small:  # most entries have to be joined, and the filter lets strangers pass
        for name, value in (("HEAVY", 20), ("SLOTS", 3), ("FILTER", 8), ("CACHE_WORDS", 30)):
            monkeypatch.setattr(quality_classifier, name, value)
    r = random.Random(13)
    words = ["the", "The", "small", "house", "stood", "near", "a", "river,", "where", "people", "walked.", "Über", "naïve", "1999", "#$%", *[f"w{i}" + "xyz" * (i % 3) for i in range(80)]]
    pick = lambda: " ".join(words[min(int(r.expovariate(0.08)), len(words) - 1)] for _ in range(r.randint(1, 60)))
    train = [pick() for _ in range(80)] + [None, ""]
    texts = [pick() + r.choice(["", " unseen strangeword", " zzz qqq"]) for _ in range(60)] + [None, "", " . ", "unknown only", "word " * 3000]
    model = quality_classifier.train(frame(spark, list(enumerate(train))))
    docs = frame(spark, list(enumerate(texts)) + [(3, texts[3])]).select("doc_id", "text")
    got = {x["doc_id"]: x for x in quality_classifier.scores(docs, model, ["doc_id"], "text").collect()}
    assert got[3]["rows"] == 2 and got[4]["rows"] == 1
    for i, want in enumerate(plain_perplexity(texts, train)):
        assert abs(got[i]["nll"] - want) < 1e-4 * max(1, want), (i, texts[i])


def test_classifier(spark):
    r = random.Random(5)
    words = ["the", "small", "house", "stood", "near", "a", "river", "where", "people", "walked", "und", "haus", "wald"]
    good = lambda: " ".join(r.choice(words) for _ in range(60))
    rows = [(i, good(), "en" if i % 3 else None) for i in range(200)]
    bad = [(1000 + i, "".join(r.choice("XQZ#$%&@!{}~0123") for _ in range(300)), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", "xx"), (2002, good(), "xx"), (None, good(), "en"), (2003, good(), "en"), (2003, good(), "en")]
    labels = spark.createDataFrame([(i, 1 if i < 160 else None, 0) for i in range(200)] + [(1000, 0, 0), (1001, 1, 1), (1002, 1, 0), (1002, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + bad + odd)
    got = quality_classifier.judge(docs, labels).collect()
    assert len(got) == len(rows + bad + odd)
    kept = Counter(x["doc_id"] for x in got if x["kept"])
    assert set(kept) == {i for i, *_ in rows + odd} and kept[2003] == 2
    assert next(x for x in got if x["doc_id"] == 2001)["perplexity"] == 1
    left = quality_classifier.keep(docs, labels)
    assert left.columns == docs.columns and Counter(x["doc_id"] for x in left.collect()) == kept
    assert next(x for x in got if x["doc_id"] == 2000)["perplexity"] == 1
    assert quality_classifier.judge(docs, labels.where("false")).where("kept").count() == len(got)
    assert quality_classifier.judge(docs.where("false"), labels).count() == 0


# LM scoring.


def test_attention_gradients(monkeypatch):
    r = np.random.default_rng(6)
    leaf = np.arange(lm_scoring.LEAVES + 5) % lm_scoring.LEAVES
    voc = lm_scoring.with_bias(lm_scoring.Vocabulary(leaf, np.zeros(len(leaf))), r.random((lm_scoring.LEAVES + 1, lm_scoring.LEAVES)), np.ones(lm_scoring.LEAVES))
    voc.by_group = voc.by_group.astype(float)
    w = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.1 for k, v in lm_scoring.new_weights().items()}
    before = r.integers(0, lm_scoring.LEAVES, (3, lm_scoring.WINDOW))
    due = r.random(before.shape) < 0.8
    context, target = r.integers(0, lm_scoring.LEAVES, due.sum()), r.integers(0, lm_scoring.LEAVES, due.sum())
    _, grad = lm_scoring.gradients(w, voc, before, due, context, target)
    for n in w:
        at = tuple(r.integers(0, s) for s in w[n].shape) if n != "embed" else (before[0, 2], 1)
        w[n][at] += 1e-5
        up = lm_scoring.gradients(w, voc, before, due, context, target)[0]
        w[n][at] -= 2e-5
        down = lm_scoring.gradients(w, voc, before, due, context, target)[0]
        w[n][at] += 1e-5
        assert abs(grad[n][at] - (up - down) / 2e-5) < 1e-6
    # No place sees what comes after it.
    changed = before.copy()
    changed[:, 9:] = 3
    same = lm_scoring._hidden(w, before)[0][:, :9] == lm_scoring._hidden(w, changed)[0][:, :9]
    assert same.all()


def test_groups_are_of_one_size():
    """However alike most leaves are, a subword's group is small; groups are still of those with like neighbours."""
    r = np.random.default_rng(4)
    n, even = lm_scoring.LEAVES, lm_scoring.LEAVES // lm_scoring.GROUPS
    two = 0.01 * r.random((n + 1, n)) + np.where(np.arange(n) < n // 2, 50.0, 0.0)
    two[:n, -even:] += 200 * (np.arange(n) >= n - even)[:, None]  # these come after each other only
    voc = lm_scoring.with_bias(lm_scoring.Vocabulary(np.arange(n), np.zeros(n)), two, np.ones(n))
    assert (np.diff(voc.starts) == even).all() and sorted(voc.leaf) == list(range(n)) and len(set(voc.group[voc.leaf[-even:]])) == 1
    context, target = np.array([3, n]), np.array([5, 700])
    joint = [voc.by_group[c][voc.group[x]] + voc.in_group[voc.group[x]][c][x - voc.starts[voc.group[x]]] for c, x in zip(context, target)]
    got = lm_scoring.log_probs(lm_scoring.new_weights(), voc, np.zeros((2, lm_scoring.WIDTH), np.float32), context, target)
    assert np.allclose(got, joint, atol=1e-4)


def test_softmax_of_large_and_small_rows():
    x = np.array([[1000.0, 999.0], [-1000.0, -1001.0], [0.0, 1.0]], np.float32)
    want = np.exp([[0, -1], [0, -1], [-1, 0]]) / (1 + np.exp(-1))
    assert np.allclose(lm_scoring._softmax(x.copy()), want, rtol=1e-5) and np.allclose(lm_scoring._softmax(x[2:].copy()), want[2:], rtol=1e-5)


def test_each_subword_is_scored_once():
    for n in (0, 1, 5, 15, 16, 17, 28, 29, 100):
        bounds = np.array([0, n, n, n + 3])
        begin, scored = lm_scoring.windows(bounds)
        stop = bounds[np.searchsorted(bounds, begin, side="right")]
        times = Counter(at for b, s, e in zip(begin, scored, stop) for at in range(b, min(b + lm_scoring.WINDOW, e)) if at >= s)
        assert times == Counter(range(n + 3))


def test_lm_places_that_are_only_looked_at():
    """A window's first places need no states of their own: with and without them the rest have the same states and gradients; each place is due once."""
    r = np.random.default_rng(9)
    n, size, skip = lm_scoring.LEAVES, lm_scoring.WINDOW, lm_scoring.OVERLAP
    voc = lm_scoring.with_bias(lm_scoring.Vocabulary(np.arange(n), np.zeros(n)), r.random((n + 1, n)), np.ones(n))
    w = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.1 for k, v in lm_scoring.new_weights().items()}
    before = r.integers(0, n, (5, size))
    assert np.allclose(lm_scoring._hidden(w, before, skip)[0], lm_scoring._hidden(w, before)[0][:, skip:])
    due = r.random((5, size)) < 0.8
    due[:, :skip] = False
    context, target = r.integers(0, n, due.sum()), r.integers(0, n, due.sum())
    (loss, want), (same, got) = lm_scoring.gradients(w, voc, before, due, context, target), lm_scoring.gradients(w, voc, before, due[:, skip:], context, target, skip)
    assert np.isclose(loss, same) and all(np.allclose(want[k], got[k]) for k in want)
    large = {k: v * 100 if k in "qk" else v for k, v in w.items()}  # sums that no float holds
    assert np.isfinite(lm_scoring._hidden({k: v.astype(np.float32) for k, v in large.items()}, before)[0]).all()
    bounds = np.cumsum([0, 0, 1, 8, 9, 32, 33, 56, 57, 200, 0])
    places = np.concatenate([at[:, k:][here] for at, k, here in lm_scoring._batches(bounds, 4, r.permutation)])
    assert sorted(places.tolist()) == list(range(bounds[-1]))



def test_lm_words_are_taken_apart_together():
    """Whole columns at once give what each word gives alone, also beside white space that only Unicode knows."""
    r = random.Random(3)
    texts = [None, "", " ", "\n a", "It's 'S 12ab!! $$", "\x0b\x0c", "x" * 3000, "tail ", *("".join(r.choice([" ", "\n", "a", "B", "'s", "É", "1", "!", "\u200b", "日"]) for _ in range(30)) for _ in range(200))]
    for more in ([], ["a\x1cb \x85", "ｘ\u3000ｙ a\xa0 \u2003"]):
        splitter, rows = lm_scoring.Splitter(SPEC), texts + more
        words = [(t or "").encode().lower().split() for t in rows]
        # Words are encoded one by one only where one has such white space.
        calls, encode = [], splitter._encode
        splitter._encode = lambda x, calls=calls, encode=encode: calls.append(x) or encode(x)
        ids, first, bounds, number, counts = splitter.stream(rows)
        assert more or len(calls) < 10
        parts = [[*(encode(" " + w.decode()) for w in own), [splitter.end]] for own in words]
        assert ids.tolist() == [x for own in parts for p in own for x in p] and first.tolist() == [k == 0 for own in parts for p in own for k in range(len(p))]
        assert np.diff(bounds).tolist() == [sum(map(len, own)) for own in parts] and counts.tolist() == list(map(len, words)) and len(number) == sum(counts)
    column = pa.array([*rows, "y" * (2 * lm_scoring.PIECE_BYTES), *["a"] * 600])
    got = list(lm_scoring.pieces(column))
    assert [i for s in got for i in range(s.start, s.stop)] == list(range(len(column))) and all(s.stop - s.start <= lm_scoring.PIECE_TEXTS for s in got)


def test_lm_logits_of_groups_and_leaves():
    r = np.random.default_rng(15)
    n, d, places = lm_scoring.LEAVES, lm_scoring.WIDTH, 1000
    voc = lm_scoring.with_bias(lm_scoring.Vocabulary(np.arange(n), np.zeros(n)), r.random((n + 1, n)), np.ones(n))
    w = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.1 for k, v in lm_scoring.new_weights().items()}
    h, context, target, rows = r.standard_normal((2 * places, d)), r.integers(0, n + 1, places), r.integers(0, n, places), r.permutation(2 * places)[:places]
    one, two = h[rows] @ w["group"] + voc.by_group[context], h[rows] @ w["leaf"]
    for k, (c, x) in enumerate(zip(context, target)):
        g = voc.group[x]
        one[k, 0] = one[k, g] - np.log(np.exp(one[k]).sum())
        own = two[k, voc.group == g] + voc.in_group[g][c]
        one[k, 0] += own[x - voc.starts[g]] - np.log(np.exp(own).sum())
    assert np.allclose(lm_scoring.log_probs(w, voc, h, context, target, rows), one[:, 0])


def test_lm_scores(spark):
    r = random.Random(7)
    words = ["the", "river", "house", "Wald", "und", "xyzzy,", "É", "\x85", "naïve"]
    rows = [(i, " ".join(r.choice(words[:6] if i % 2 else words) for _ in range(r.randint(1, 60)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "unseenword " * 3), (1003, "the the"), (1003, "the the"), (None, "the")]
    got = lm_scoring.score(frame(spark, rows), SPEC).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    tokens = lambda t: [*(t or "").encode().lower().split(), "END"]
    c = Counter(x for i, t in rows if not out(i) for x in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, out(i), len(tokens(t)), sum(c[x] > 0 for x in tokens(t)), n) for i, t in rows), key=repr)
    assert sorted(((x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"]) for x in got), key=repr) == want
    texts = dict(rows)
    for x in got:
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(texts[x["doc_id"]]))
        assert abs(x["base_score"] - base) < 1e-8 * max(1, abs(base)) and x["score"] < 0 and math.isfinite(x["score"])
    assert lm_scoring.score(frame(spark, rows).where("false"), SPEC).count() == 0
    # Text of the corpus is likelier than the same letters in another order.
    again = {x["doc_id"]: x["score"] for x in lm_scoring.score(frame(spark, [*rows, (2000, "the river und house"), (2010, "eht revir dnu esuoh")]), SPEC).collect()}
    assert again[2000] > again[2010]


def plain_score(text, splitter, w, voc, frequency):
    """log10 of a text's probability: one place at a time, over all it may see, without batches."""
    words = (text or "").encode().lower().split()
    parts = [splitter._encode(" " + x.decode()) for x in words] + [[splitter.end]]
    ids = [x for p in parts for x in p]
    starts = {sum(map(len, parts[:k])) for k in range(len(parts))}
    leaf = [voc.leaf[x] for x in ids]
    before = [lm_scoring.LEAVES, *leaf[:-1]]
    w = {n: a.astype(np.float64) for n, a in w.items()}
    lp = []
    for i, x in enumerate(ids):
        begin = 0  # of the first window that scores place i
        while i >= begin + lm_scoring.WINDOW:
            begin += lm_scoring.WINDOW - lm_scoring.OVERLAP
        seen = [w["embed"][before[j]] + w["place"][j - begin] for j in range(begin, i + 1)]
        a = np.exp([seen[-1] @ w["q"] @ (s @ w["k"]) / lm_scoring.WIDTH**0.5 for s in seen])
        h = seen[-1] + sum(p * (s @ w["v"]) for p, s in zip(a / a.sum(), seen)) @ w["o"]
        context, g = lm_scoring.LEAVES if i in starts else before[i], voc.group[leaf[i]]
        one = h @ w["group"] + voc.by_group[context]
        two = h @ w["leaf"][:, voc.group == g] + voc.in_group[g][context]
        lp.append(one[g] - np.log(np.exp(one).sum()) + two[leaf[i] - voc.starts[g]] - np.log(np.exp(two).sum()) + voc.in_leaf[x])
    total, at = 0.0, 0
    for word, p in zip([*words, None], parts):
        model = sum(lp[at : at + len(p)]) / math.log(10)
        at += len(p)
        own = frequency(word)
        total += model + math.log10(lm_scoring.MIXED) if own is None and word is not None else math.log10(lm_scoring.MIXED * 10**model + (1 - lm_scoring.MIXED) * 10**own)
    return total


def test_scores_against_plain(spark, monkeypatch):
    kept = {}

    def fixed(texts, voc, spec):
        r = np.random.default_rng(4)
        kept["voc"] = voc
        kept["w"] = {n: (a + r.standard_normal(a.shape) * 0.1).astype(np.float32) for n, a in lm_scoring.new_weights().items()}
        return kept["w"]

    monkeypatch.setattr(lm_scoring, "train_weights", fixed)
    monkeypatch.setattr(lm_scoring, "HEAVY", 0.002)
    r = random.Random(11)
    words = ["the", "river", "house", "Wald", "und", "xyzzy,", "É", "\x85", "naïve", *[f"rare{i}" for i in range(300)]]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 9, 40, 200])))) for i in range(60)] + [(100, None), (101, ""), (102, "never seen " * 30), (None, "the"), (1, "the"), (None, "river"), (103, "x" * 3000), (103, "x" * 3000)]
    got = lm_scoring.score(frame(spark, rows), SPEC).collect()
    train = [t for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 10]
    c = Counter(x for t in train for x in (t or "").encode().lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    below = math.log10(n + 0.1 * (v + 1))
    frequency = lambda x: math.log10(len(train) + 0.1) - below if x is None else math.log10(c[x] + 0.1) - below if x in c else None
    splitter = lm_scoring.Splitter(SPEC)
    want = sorted((str(i), plain_score(t, splitter, kept["w"], kept["voc"], frequency)) for i, t in rows)
    have = sorted((str(x["doc_id"]), x["score"]) for x in got)
    for (i, a), (j, b) in zip(have, want, strict=True):
        assert i == j and abs(a - b) < 1e-4 * abs(b), (i, a, b)


def test_parts_are_disjoint_and_all():
    ends = lm_scoring.PARTS
    assert list(ends) == sorted(set(ends)) and ends[0] > 0 and ends[-1] == 1


def test_attention_decides_on_leaves():
    r = np.random.default_rng(9)
    n = lm_scoring.LEAVES
    voc = lm_scoring.with_bias(lm_scoring.Vocabulary(np.arange(n), np.zeros(n)), r.random((n + 1, n)), np.ones(n))
    w = {k: v.astype(np.float64) + r.standard_normal(v.shape) * 0.1 for k, v in lm_scoring.new_weights().items()}
    h, context = r.standard_normal((1, lm_scoring.WIDTH)), np.array([5])
    every = lambda weights: np.array([lm_scoring.log_probs(weights, voc, h, context, np.array([x]))[0] for x in range(n)])
    lp = every(w)
    assert abs(np.exp(lp).sum() - 1) < 1e-5
    # Which leaf of a group comes next depends on the attention's state, not on counts alone.
    flat = every(w | {"leaf": np.zeros_like(w["leaf"])})
    same = np.flatnonzero(voc.group == np.bincount(voc.group).argmax())
    assert np.ptp((lp - flat)[same]) > 0.05
    assert lm_scoring.WINDOW >= 32 and lm_scoring.OVERLAP >= 8


def test_attention_is_fitted_on_all_training_texts(spark, monkeypatch):
    seen = []
    fitted = lm_scoring.train_weights

    def noted(texts, voc, spec):
        seen.extend(x[0] for x in texts.collect())
        w = fitted(texts, voc, spec)
        seen.append(bool(w["group"].any() and w["leaf"].any()))
        return w

    monkeypatch.setattr(lm_scoring, "train_weights", noted)
    rows = [(i, f"the river and house number{i}") for i in range(12)]
    lm_scoring.score(frame(spark, rows), SPEC).collect()
    assert seen.pop()
    assert sorted(seen) == sorted(t for i, t in rows if zlib.crc32(str(i).encode()) % 10)


def test_training_lowers_the_loss():
    splitter = lm_scoring.Splitter(SPEC)
    r = random.Random(8)
    halves = [["alpha", "beta", "gamma"], ["one", "two", "three"]]
    texts = [" ".join(r.choice(halves[i % 2]) for _ in range(40)) for i in range(120)]
    ids, first, bounds, *_ = splitter.stream(texts)
    size = splitter.end + 1
    leaf = np.zeros(size, np.int64)
    leaf[np.unique(ids)] = np.arange(len(np.unique(ids)))
    now, before = leaf[ids], np.concatenate([[lm_scoring.LEAVES], leaf[ids][:-1]])
    before[first] = lm_scoring.LEAVES
    two = np.bincount(before * lm_scoring.LEAVES + now, minlength=(lm_scoring.LEAVES + 1) * lm_scoring.LEAVES).reshape(-1, lm_scoring.LEAVES).astype(float)
    voc = lm_scoring.with_bias(lm_scoring.Vocabulary(leaf, np.zeros(size, np.float32)), two, np.bincount(now, minlength=lm_scoring.LEAVES) + 0.1)
    w = lm_scoring.new_weights()
    start = lm_scoring.score_stream(w, voc, ids, first, bounds).mean()
    for _ in range(6):
        w, _ = lm_scoring.fit(w, voc, iter([(ids, first, bounds)]))
    # Which half a text draws from shows in its earlier words only, which counts of pairs can't see.
    assert lm_scoring.score_stream(w, voc, ids, first, bounds).mean() > start + 0.2


# Sharding.


def plain_shard(doc_id, tree):
    key = "null" if doc_id is None else f"#{doc_id}"

    def draw(path, weight):
        h = xxhash.xxh64_intdigest(f"{key}|{path}", 42) & ((1 << 52) - 1)
        return math.log((h + 0.5) / (1 << 52)) / weight

    region = max(tree, key=lambda g: draw(g, sum(sum(s.values()) for s in tree[g].values())) if len(tree) > 1 else 0)
    rack = max(tree[region], key=lambda k: draw(f"{region}/{k}", sum(tree[region][k].values())))
    return max(tree[region][rack], key=lambda s: draw(f"{region}/{rack}/{s}", tree[region][rack][s]))


def test_sharding(spark):
    tree = sharding.balanced_tree(16)
    grown = sharding.grown_tree(tree, 16)
    rows = [(i, "é" * (i % 7)) for i in range(3000)] + [(None, None), (5, "é" * 5), (5, "é" * 5), (5, "other"), (-1, "x" * 100_000)]
    got = sharding.assign(frame(spark, rows), tree, grown).collect()
    assert len(got) == len(rows)
    for x in got:
        assert x["shard"] == plain_shard(x["doc_id"], tree) and x["grown_shard"] == plain_shard(x["doc_id"], grown)
        assert x["grown_shard"] in (x["shard"], 16) and x["law"] == "key"
    for s in range(16):
        slots = sorted(x["slot"] for x in got if x["shard"] == s)
        assert slots == list(range(len(slots)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == want
    counts = Counter(x["shard"] for x in got)
    assert len(counts) == 16 and max(counts.values()) < 1.4 * min(counts.values())
    assert sharding.assign(frame(spark, rows).where("false"), tree).count() == 0


def test_only_changed_subtrees_lose_or_gain(spark):
    tree = sharding.balanced_tree(16)
    heavier = {g: {k: dict(s) for k, s in racks.items()} for g, racks in tree.items()}
    heavier["region2"]["rack5"][11] = 3.0
    ids = spark.range(20_000)
    at = ids.select(sharding.shard_of(ids["id"], tree).alias("a"), sharding.shard_of(ids["id"], heavier).alias("b")).collect()
    region = {s: g for g, racks in tree.items() for k, shards in racks.items() for s in shards}
    moved = [(a, b) for a, b in at if a != b]
    assert moved and all(region[b] == "region2" for _, b in moved)
    share = sum(b == 11 for _, b in at) / len(at)
    assert abs(share - 3 / 18) < 0.02


# Decontamination.


def test_templates(spark):
    quiz = "If Alice has 12 apples and gives Bob 5 apples then how many kg does Alice have left after 3.5 hours of walking with Bob"
    item = "plain words that make up one longer benchmark passage which has neither names nor numbers in any of its lines at all"
    bench = spark.createDataFrame([(1, quiz), (2, "short one"), (3, item), (4, item), (5, None), (6, "1 2 3 4 5 6 7 8 9")], "item_id long, text string")
    said = lambda a, b, x, y, z: f"intro. if {a} has {x} apples and gives {b} {y} apples then how many kg does {a} have left after {z} hours of walking with {b}. more"
    clash = "intro. if Carol has 9 apples and gives Dan 7 apples then how many kg does Eve have left after 2 hours of walking with Zed. more"
    rows = {
        1: quiz, 2: said("Carol", "Dan", 99, 7, 2), 3: clash, 4: None, 5: "", 6: "before it " + item.upper() + " after it", 7: "words that make up nothing which has numbers 1 2 3 4 5 6 7 8 9",
        8: " ".join(item.split()[:6]) + " and then it goes on in another way", 9: "x " * 5000 + item, 10: said("Ann", "Ann", 1, 2, 3),
    }
    docs = frame(spark, [*rows.items(), (6, rows[6]), (6, "clean text under the same id"), (None, item)]).withColumnsRenamed({"lang": "_id", "source": "_th", "n_chars": "items"})
    got = decontamination.flag(docs, bench).collect()
    assert len(got) == 13
    assert sorted(x["doc_id"] or 0 for x in got if x["contaminated"]) == [0, 1, 2, 6, 6, 9]
    assert {x["items"] for x in got if x["doc_id"] in (6, 9)} == {"3", ""}
    left = decontamination.clean(docs, bench)
    assert left.columns == docs.columns and sorted(x["doc_id"] for x in left.collect()) == [3, 4, 5, 6, 7, 8, 10]
    assert decontamination.flag(docs.where("false"), bench).count() == 0
    assert decontamination.flag(docs, bench.where("false")).where("contaminated").count() == 0


def test_items_of_one_template(spark):
    said = lambda x, y: f"the farmer of the old village has {x} apples and gives {y} apples to the people who live next door to him"
    bench = spark.createDataFrame([(1, said(12, 5)), (2, said(7, 7)), (3, said(12, 5))], "item_id long, text string")
    got = {x["doc_id"]: x["items"] for x in decontamination.flag(frame(spark, [(1, said(12, 5)), (2, said(7, 7)), (3, said(3, 4)), (4, "the farmer of the old village")]), bench).collect()}
    assert "1" in got[1].split(",") and "2" in got[2].split(",") and "1" in got[3].split(",") and got[4] == ""


def test_verbatim_copies_of_items_with_few_words(spark):
    bench = spark.createDataFrame([(1, "compute 12 * 7 + 45 - 9 / 3"), (2, "name the capital"), (3, "in 3 4 5 6"), (4, "Oslo, Rome")], "item_id long, text string")
    texts = ["so compute 12 * 7 + 45 - 9 / 3 now", "so compute 12 * 7 + 45 - 8 / 2 now", "please name the capital of it", "name a capital", "in 3 4 5 6 steps", "in 3 4 5 7 steps", "x. Oslo, Rome", None]
    got = [x["items"] for x in decontamination.flag(frame(spark, list(enumerate(texts))), bench).orderBy("doc_id").collect()]
    assert got == ["1", "", "2", "", "3", "", "4", ""]


def test_large_benchmarks_are_joined_by_a_shuffle(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(tuple(x) for x in decontamination.flag(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BROADCAST", 0)
    monkeypatch.setattr(decontamination, "BITS", 1)
    monkeypatch.setattr(decontamination, "LEAST", 6)
    assert sorted(tuple(x) for x in decontamination.flag(docs, bench).collect()) == one
    assert decontamination.clean(docs, bench).count() == sum(not x[1] for x in one)


def test_names_at_the_start_of_sentences(spark):
    bench = spark.createDataFrame([(1, "Alice has 12 apples and buys 5 more"), (2, "Alice ran 5 km today"), (3, "The red cat sat on the mat. Bob saw 7 dogs.")], "item_id long, text string")
    texts = {
        "Bob has 90 apples and buys 7 more.": "1", "so then Bob has 90 apples and buys 7 more": "1", "Bob has 9 apples and buys 9 more": "", "Bob ran 9 km today": "2", "yes, Carl ran 11 km today": "2",
        "the red cat sat on the mat. Carl saw 9 dogs.": "3", "Bob ran 9 miles home": "", "ALICE HAS 12 APPLES": "",
    }
    got = [x["items"] for x in decontamination.flag(frame(spark, list(enumerate(texts))), bench).orderBy("doc_id").collect()]
    assert got == list(texts.values())


def plain_windows(text, item):
    """Windows of a text, each as all its readings: template or values, and the values of slots."""
    tokens = []
    for m in re.finditer(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+", text):
        x, before = m[0], text[: m.start()]
        if x[0].isdigit():
            tokens.append([("#" + re.sub("[.,]", "", x), "#")])
        elif x.lower() in decontamination.UNITS and tokens and tokens[-1][0][1] == "#" and re.search(r"[0-9][ -]*$", before):
            tokens.append([("%" + x.lower(), "%")])
        elif len(x) > 1 and x[0].isupper() and x[1].islower():
            inside = re.search(r"[a-z0-9,;:] $", before)
            tokens.append([("@" + x.lower(), "@")] + ([] if inside or not item else [(x.lower(), x.lower())]))
        else:
            tokens.append([(x.lower(), x.lower())])
    return [list(product(*tokens[k : k + 5])) for k in range(len(tokens) - 4)]


def plain_flag(texts, items):
    """For texts of ASCII letters and items of five tokens or more."""
    out = []
    for text in texts:
        mine, found = [w[0] for w in plain_windows(text, False)], []
        for i, item in items:
            theirs = plain_windows(item, True)
            literals = lambda w: sum(t not in "#%@" for _, t in w)
            needed = 3 if max(min(map(literals, w)) for w in theirs) >= 3 else 2
            exact = [all(literals(r) < needed for r in w) for w in theirs]
            by_diag = defaultdict(list)
            for d, w in enumerate(mine):
                for b, readings in enumerate(theirs):
                    for r in readings:
                        k = 1 if literals(r) >= needed else 0
                        if [x[k] for x in w] == [x[k] for x in r] and [x[1] if x[1] in "#%@" else "" for x in w] == [x[1] if x[1] in "#%@" else "" for x in r]:
                            by_diag[d - b].append((b, [(p[0], q[0]) for p, q in zip(w, r) if q[1] in "#%@"] if k else []))
            covered, verbatim, run = set(), set(), 0
            for hits in by_diag.values():
                pairs = {p for _, slots in hits for p in slots}
                bad = {p for p in pairs for q in pairs if (p[0] == q[0]) != (p[1] == q[1])}
                at = {b for b, slots in hits if not bad & set(slots)}
                run = max(run, len(at))
                covered |= {b for b in at if not exact[b]}
                verbatim |= {b for b, _ in hits if exact[b]}
            n = exact.count(False)
            if run >= 9 or (len(covered) >= 0.8 * n if n else len(verbatim) >= 0.8 * len(exact)):
                found.append(i)
        out.append(",".join(map(str, found)))
    return out


def test_reparameterised_questions_against_plain(spark):
    r = random.Random(12)
    names, words = ["Alice", "Bob", "Carol", "Dan", "Eve", "Zed"], "the a old red boat house buys sells walks eats finds apples pears stones and then of with more left today slowly".split()
    units = ["km", "kg", "hours", "days"]

    def question():
        out = [r.choice(["{n0}", "The", "When {n0}"])]
        for _ in range(r.randint(6, 30)):
            out.append(r.choice(words) if r.random() < 0.75 else r.choice(["{n0}", "{n1}", "{x0}", "{x1}", "{x0} {u0}", ". {n1}"]))
        return " ".join(out).replace(" .", ".")

    def fill(q, n=None, x=None):
        n, x = n or r.sample(names, 2), x or r.sample(range(2, 99), 2)
        return q.format(n0=n[0], n1=n[1], x0=x[0], x1=x[1], u0=r.choice(units))

    questions = [question() for _ in range(40)]
    items = [(i, fill(q)) for i, q in enumerate(questions)]
    texts, origin = [], []
    for i, q in enumerate(questions):
        for before in ("", "so then ", " ".join(r.choice(words) for _ in range(20)) + ". "):
            texts.append(before + fill(q) + r.choice(["", ".", " and more of the old red house"]))
            origin.append(i)
    texts += [" ".join(r.choice(words) for _ in range(60)) for _ in range(40)]
    texts += [fill(q, ["Alice", "Alice"], [5, 5]) for q in questions]
    got = [x["items"] for x in decontamination.flag(frame(spark, list(enumerate(texts))), spark.createDataFrame(items, "item_id long, text string")).orderBy("doc_id").collect()]
    want = plain_flag(texts, items)
    as_text = lambda x: sorted(x.split(","))
    assert [as_text(x) for x in got] == [as_text(x) for x in want]
    assert sum(str(i) in x.split(",") for i, x in zip(origin, got)) >= 0.9 * len(origin)
    assert not any(got[len(origin) : len(origin) + 40])


def test_leaks_against_plain(spark):
    docs, bench = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"\w+", t.lower())
    index = {}
    for b in bench.collect():
        w = words(b["text"])
        for k in range(len(w) - 7):
            index.setdefault(tuple(w[k : k + 8]), set()).add(b["item_id"])
    want = {d["doc_id"] for d in docs.collect() for w in [words(d["text"])] for k in range(len(w) - 7) if tuple(w[k : k + 8]) in index}
    got = {x["doc_id"] for x in decontamination.flag(docs, bench).where("contaminated").collect()}
    assert got == want and got


# The pipeline.


def test_pipeline_against_its_operators(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontaminate", "tokens"]
    good = {x["doc_id"] for x in quality_classifier.judge(docs, labels).where("kept").collect()}
    now = corpus_pipeline.STAGES[0][1](spark, docs, TINY)
    assert {x["doc_id"] for x in now.collect()} == good
    from tests.llm.test_text_operators import plain_dedup

    texts = plain_dedup([(x["doc_id"], x["text"]) for x in now.collect()])
    now = corpus_pipeline.STAGES[1][1](spark, now, TINY)
    assert {x["doc_id"]: x["text"] for x in now.collect()} == texts and now.columns == docs.columns
    assert all(x["n_chars"] == len(x["text"]) for x in now.collect())
    ids = sorted(texts)
    codes = {i: plain_fingerprint(texts[i]) for i in ids}
    group = union_find(ids, [(a, b) for a, b in product(ids, ids) if a < b and (codes[a] ^ codes[b]).bit_count() <= 3])
    now = corpus_pipeline.STAGES[2][1](spark, now, TINY)
    assert sorted(x["doc_id"] for x in now.collect()) == sorted(set(group.values()))
    dirty = {x["doc_id"] for x in decontamination.flag(now, bench).where("contaminated").collect()}
    now = corpus_pipeline.STAGES[3][1](spark, now, TINY)
    left = sorted(set(group.values()) - dirty)
    assert sorted(x["doc_id"] for x in now.collect()) == left
    assert sorted(x["doc_id"] for x in corpus_pipeline.run(spark, TINY).collect()) == left
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), TINY).count() == 0


def test_registered_queries():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names


@pytest.mark.parametrize("name", ["op1_line_dedup", "op3_quality_rules"])
def test_oracles(spark, name):
    import duckdb

    from graphloom.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{TINY}/documents.parquet'")
    df = queries.queries()[name](spark, TINY)
    cols = sorted(df.columns)
    found = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
