"""Line dedup, BPE, quality rules, PII and license scans against plain versions of the same rules."""

import hashlib
import json
import random
import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import bpe, license_scan, line_dedup, pii, quality_rules
from graphloom.llm.queries import TOKENIZERS

SPEC = bpe.load_spec(f"{TOKENIZERS}/byte_bpe_50k.json")
ODD = ["", " ", "\n\n", "a", "don't  stop\t\n\n x ", "日本語 🎉🎉 éà́", "a\x00b\x85 c", "<|endoftext|>x<|endoftext|><|endo", "'ll'LL", "9" * 300, "x" * 5000, "ab " * 3000, "+++---***", " line "]


def frame(spark, rows, schema="doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame([(*r, *[None] * (len(schema.split(",")) - len(r))) for r in rows], schema)


# Line dedup.


def plain_dedup(rows):
    """rows: (id, text), ids distinct."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        solid = [k for k, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        width = min(3, len(solid))
        gone = set()
        for k in range(len(solid) - width + 1 if solid else 0):
            key = tuple(lines[q].strip(" \t\r\x0b\x0c") for q in solid[k : k + width])
            if key in seen:
                gone |= set(range(k, k + width))
        for k in range(len(solid) - width + 1 if solid else 0):
            key = tuple(lines[q].strip(" \t\r\x0b\x0c") for q in solid[k : k + width])
            if key in seen:
                continue
            # within a text too, only the first occurrence stays
            places = [j for j in range(len(solid) - width + 1) if tuple(lines[q].strip(" \t\r\x0b\x0c") for q in solid[j : j + width]) == key]
            for j in places[1:]:
                gone |= set(range(j, j + width))
        for k in range(len(solid) - width + 1 if solid else 0):
            seen.add(tuple(lines[q].strip(" \t\r\x0b\x0c") for q in solid[k : k + width]))
        if not gone:
            out[i] = text
        elif len(gone) == len(solid):
            out[i] = ""
        else:
            kept, n = [], 0
            for x in lines:
                n += bool(x.strip(" \t\r\x0b\x0c"))
                if max(n - 1, 0) not in gone:
                    kept.append(x)
            out[i] = "\n".join(kept)
    return out


def test_line_dedup_against_plain(spark):
    r = random.Random(3)
    rows = [(i, "\n".join(r.choice(["a b", "c", "  d ", "", "e", "f f", "g", "h\t", "\t"]) for _ in range(r.randint(0, 14)))) for i in range(120)]
    rows += [(500, "one\ntwo\nthree\nfour"), (501, "zero\none\ntwo\nthree\nfive"), (502, "one\ntwo\nthree")]
    rows += [(600, "q\u2028r\x85s\rt\n\n \u00a0\n\t"), (601, "\r\n")]
    out = line_dedup.dedup(frame(spark, rows)).collect()
    got = {x["doc_id"]: x["text"] for x in out}
    assert got == plain_dedup(rows)
    assert {x["doc_id"]: x["_n_lines"] for x in out} == {i: sum(bool(x.strip(" \t\r\x0b\x0c")) for x in t.split("\n")) for i, t in rows}
    assert got[501] == "zero\nfive" and got[502] == ""


def test_line_dedup_edges(spark):
    rows = [(None, "p\nq\nr"), (1, "p\nq\nr"), (1, "p\nq\nr"), (2, None), (3, ""), (4, "s\nt\nu"), (4, "s\nt\nu"), (5, "v\n" * 4000)]
    df = frame(spark, rows).withColumnsRenamed({"lang": "_at", "source": "_lines", "n_chars": "_id"})  # names the operator uses itself
    out = line_dedup.dedup(df)
    assert out.columns == [*df.columns, "_n_lines", "_n_removed"]
    got = sorted(((x["doc_id"] or 0, x["text"]) for x in out.collect()), key=repr)
    # In a run of one line every later window covers the next lines too, so one line stays.
    assert got == sorted([(0, "p\nq\nr"), (1, ""), (1, ""), (2, None), (3, ""), (4, "s\nt\nu"), (4, "s\nt\nu"), (5, "v")], key=repr)
    assert line_dedup.dedup(df.where("false")).count() == 0


# BPE.


def slow_merge(symbols, ranks, merged):
    out = list(symbols)
    while True:
        found = [(ranks[k], i) for i in range(len(out) - 1) if (k := out[i] << 20 | out[i + 1]) in ranks]
        if not found:
            return out
        rank, i = min(found)
        out[i : i + 2] = [merged[rank]]


def test_merge_against_plain():
    r = random.Random(1)
    ranks, merged = {}, []
    for rank in range(60):
        ranks.setdefault(r.randrange(4 + rank) << 20 | r.randrange(4 + rank), len(merged))
        merged.append(4 + len(merged))
    for _ in range(400):
        s = [r.randrange(4) for _ in range(r.randint(0, 40))]
        assert bpe.merge(s, ranks, merged) == slow_merge(s, ranks, merged)


def test_bpe_as_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    known = Tokenizer.from_str(SPEC)
    r = random.Random(2)
    texts = ODD + ["".join(r.choice("aeth 0\n.é🎉'") for _ in range(80)) for _ in range(60)]
    rows = [*enumerate(texts), (998, None), (998, None)]
    got = bpe.digests(frame(spark, rows), SPEC).collect()
    assert len(got) == len(rows)
    want = {}
    for i, t in rows:
        ids = known.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(known.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert all((x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) == want[x["doc_id"]] for x in got)
    ids = bpe.encode(frame(spark, rows), SPEC)
    back = {x["doc_id"]: x["text"] for x in bpe.decode(ids, SPEC).collect()}
    assert all(back[i] == (t or "") for i, t in rows)
    assert bpe.digests(frame(spark, rows).where("false"), SPEC).count() == 0


def test_bpe_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 5)
    codec = bpe.Codec(json.loads(SPEC))
    first = [codec.digest(t) for t in ODD]
    assert len(codec.cache) <= 5 and first == [bpe.Codec(json.loads(SPEC)).digest(t) for t in ODD]


# Quality rules.


def plain_measure(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if re.search(r"[^\x20\x09-\x0D]", x) and x in lines[:i])
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), sum(w.isupper() for w in words)


def test_measure_against_plain():
    r = random.Random(4)
    for t in ODD[:-4] + ["".join(r.choice("ab \n#É|") for _ in range(r.randint(0, 120))) for _ in range(200)]:
        assert quality_rules.measure(t) == plain_measure(t)


def good_text(r, n=80):
    return " ".join(r.choice(["the", "cat", "sat", "on", "mat", "dog", "ran", "by", "tree", "blue", "sky", "fell", "down", "house", "river"]) + str(r.randrange(50)) for _ in range(n))


def test_quality_rules(spark):
    r = random.Random(5)
    rows = [(i, good_text(r), "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None) for i in range(300)]
    rows += [(900, "### ".join(good_text(r).split(" ")), "en", "s1"), (901, good_text(r, 20), "en", "s1"), (902, None, None, None), (903, "spam " * 200, "en", "s0"), (903, "spam " * 200, "en", "s0")]
    got = quality_rules.judge(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {x["doc_id"]: x for x in got}
    assert all(by[i]["kept"] for i in range(300))
    assert not by[900]["kept"] and not by[900]["base_failed"] and "symbol_ratio" in by[900]["failed"]
    assert by[901]["base_failed"] and by[902]["base_failed"] and by[903]["base_failed"] and by[902]["n_words"] == 0
    assert quality_rules.judge(frame(spark, rows).where("false")).count() == 0


def test_thresholds_come_from_the_group(spark):
    r = random.Random(6)

    def text(rate, n):
        return " ".join(f"word{r.randrange(10**6)}" + ("#" if r.random() < rate else "") for _ in range(n))

    # Symbols are common in one source, absent in another, whose texts differ in length.
    rows = [(i, text(r.uniform(0.1, 0.5), 200), "en", "code") for i in range(120)] + [(200 + i, text(0, r.randint(100, 300)), "en", "news") for i in range(120)]
    rows += [(900, text(0.5, 200), "en", "code"), (901, text(0.5, 200), "en", "news"), (902, text(0.01, 200), "en", "news"), (903, text(0, 200), "en", "few"), (904, text(0.5, 20_000), "en", "news")]
    by = {x["doc_id"]: x for x in quality_rules.judge(frame(spark, rows)).collect()}
    assert by[900]["kept"] and by[902]["kept"] and by[903]["kept"]
    assert "symbol_ratio" in by[901]["failed"] and "symbol_ratio" in by[904]["failed"]
    assert all(by[i]["kept"] for i, *_ in rows[:240])
    counts = frame(spark, rows).transform(quality_rules.measured).select("lang", "source", "_m.*")
    limits = {x["source"]: x for x in quality_rules.fences(quality_rules.sketches(counts.withColumns(quality_rules._values()))).collect()}
    assert limits["code"]["symbol_ratio_hi"] > 0 > limits["news"]["symbol_ratio_hi"]  # logarithms
    assert limits["code"]["word_length_hi"] != limits["news"]["word_length_hi"]


def test_quality_rules_on_long_texts_and_clashing_columns(spark):
    r = random.Random(7)
    long = "\n".join(" ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(60)) for _ in range(2000))
    assert quality_rules.measure(long) == plain_measure(long)
    docs = frame(spark, [(1, long, "en", "s"), (2, "x", "en", "s")]).selectExpr("doc_id", "text", "lang", "source", "1 AS _m", "2 AS n_words", "3 AS measure", "4 AS bucket", "5 AS _l", "'k' AS kept")
    assert {x["doc_id"]: x["n_words"] for x in quality_rules.judge(docs).collect()} == {1: 120_000, 2: 1}


def test_sketches_merge_exactly(spark):
    from pyspark.sql import functions as F

    from graphloom.llm.common import ALPHA, sketch_bucket, sketch_quantiles

    r = np.random.default_rng(0)
    x = np.concatenate([r.exponential(3, 700), np.zeros(50)])
    df = spark.createDataFrame([(float(v), i % 7) for i, v in enumerate(x)], "x double, part int")
    whole = df.groupBy(F.lit(1).alias("k"), sketch_bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))
    parts = df.groupBy("part", sketch_bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n")).groupBy(F.lit(1).alias("k"), "bucket").agg(F.sum("n").alias("n"))
    q = {"a": 0.05, "b": 0.5, "c": 0.99}
    one, two = sketch_quantiles(whole, ["k"], q).first(), sketch_quantiles(parts, ["k"], q).first()
    assert one == two
    for name, level in q.items():
        exact = np.sort(x)[max(0, int(np.ceil(level * len(x))) - 1)]
        assert abs(one[name] - exact) <= ALPHA * exact + 1e-6


# PII.


@pytest.fixture(scope="module")
def weights():
    return pii.default_weights()


def plain_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        luhn = sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and luhn % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0]), x[2]))


def test_base_spans_against_plain():
    r = random.Random(6)
    parts = ["a@b.co", "x.y+z@sub.dom.org", "1.2.3.4", "256.1.1.1", "001.002.003.004", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 123-4567", "+49 30 1234567", "@", ".", "-", " ", "a", "9", "é", "+", "00", "@@a.b", "\n"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.base_spans("a" * 200_000) == [] and pii.base_spans("1" * 200_000) == []


def test_tagger_gradients():
    w = {k: v.astype(np.float64) for k, v in pii.new_weights().items()}
    r = random.Random(1)
    made = [pii.labelled_window(r) for _ in range(3)]
    x, y = np.stack([pii.encode(t) for t, _ in made], axis=1), np.stack([t for _, t in made], axis=1)
    _, grad = pii.loss_and_gradients(w, x, y)
    pick = np.random.default_rng(0)
    for n in w:
        at = tuple(pick.integers(0, s) for s in w[n].shape) if n != "embed" else (x[5, 0], 2)
        w[n][at] += 1e-5
        up = pii.loss_and_gradients(w, x, y)[0]
        w[n][at] -= 2e-5
        down = pii.loss_and_gradients(w, x, y)[0]
        w[n][at] += 1e-5
        assert abs(grad[n][at] - (up - down) / 2e-5) < 1e-5


def test_tagger_on_held_out_windows(weights):
    r = random.Random(99)
    hit = found = wanted = 0

    def spans(tags):
        k = (np.asarray(tags) + 1) // 2
        e = np.flatnonzero(np.diff(k, prepend=0, append=0))
        return {(int(k[a]), int(a), int(b)) for a, b in zip(e[:-1], e[1:]) if k[a]}

    for _ in range(300):
        t, tag = pii.labelled_window(r)
        got, want = spans(pii.viterbi(weights, pii.encode(t)[:, None])[:, 0]), spans(tag)
        hit, found, wanted = hit + len(got & want), found + len(got), wanted + len(want)
    assert hit / found > 0.85 and hit / wanted > 0.8


def test_pruning_changes_nothing(weights):
    r = random.Random(8)
    texts = ["", "plain words only " * 30] + [" ".join(pii._word(r) if r.random() < 0.95 else pii._entity(r)[0] for _ in range(r.randint(1, 120))) for _ in range(30)]
    for t, a, b in zip(texts, pii.tag_texts(weights, texts), pii.tag_texts(weights, texts, prune=False)):
        assert pii.spans_of(t, a) == pii.spans_of(t, b)


def test_pii_query(spark, weights):
    text = 'words here token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and a@b.org then +1 (555) 123-4567 190.1.2.3 end'
    rows = [(1, text), (2, None), (3, ""), (4, "nothing to see"), (1, text)]
    got = pii.find(frame(spark, rows), weights=weights).collect()
    one = next(x for x in got if x["doc_id"] == 1)
    base = plain_base(text)
    assert one["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
    spans = one["spans"].split(",")
    assert all(f"{k}:{s}:{e}" in spans for k, s, e in base)
    secret = text.index("24be")
    assert f"secret:{secret}:{secret + 40}" in spans and one["n_email"] == 1 and one["n_ip"] == 1
    empty = hashlib.sha256(b"").hexdigest()
    assert [(x["base_sha256"], x["spans"]) for x in got if x["doc_id"] in (2, 3, 4)] == [(empty, "")] * 3
    assert len(got) == 5 and pii.find(frame(spark, rows).where("false"), weights=weights).count() == 0


# License scan.


def words_of(text):
    low = text.translate({c: chr(c + 32) for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_places(text):
    words, out = words_of(text), []
    for phrase, label in license_scan.BASE.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return out


def test_license_base_against_plain(spark):
    r = random.Random(9)
    pieces = ["\u2028", "x\u0085y", "Under the MIT-License", "apache license, VERSION 2", "cc by nc", "cc", "by", "nc", "mit", "under the", "License", "é", "\n", "x1", "apache", "--"]
    rows = [(i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 12)))) for i in range(250)] + [(900, None), (901, ""), (902, "under the mit license"), (902, "under the mit license"), (903, "cc " * 5000)]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for x in got:
        places = plain_places(texts[x["doc_id"]] or "")
        labels = sorted({label for _, label in places})
        assert (x["n_words"], x["n_base"]) == (len(words_of(texts[x["doc_id"]] or "")), len(places))
        assert (x["first_word"], x["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert x["base_labels"] == ",".join(labels) and set(labels) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert license_scan.scan(frame(spark, rows).where("false")).count() == 0


def test_license_rules(spark):
    rules = license_scan.default_rules()
    assert len(rules) > 300
    texts = {
        1: "This work is licensed under the GNU Lesser General Public License, version 2.1.", 2: "SPDX-License-Identifier: BSD 3-Clause BSD License", 3: "Copyright X. All rights reserved.",
        4: "a general election under the public eye", 5: "Licensed under CC BY-NC-SA 4.0 and the Mozilla Public License 2.0",
    }
    got = {x["doc_id"]: x for x in license_scan.scan(frame(spark, list(texts.items()))).collect()}
    assert got[1]["labels"] == "lgpl-2.1"  # the plainer gpl rules lie within
    assert got[3]["labels"] == "proprietary" and got[4]["labels"] == "" and got[4]["score"] == 0
    assert {"cc-by-nc-sa", "mpl-2"} <= set(got[5]["labels"].split(","))
    for x in got.values():
        spans = [(h["s"], h["e"]) for h in x["hits"]]
        assert all(not (a != b and b[0] <= a[0] and a[1] <= b[1]) for a in spans for b in spans)
        for h in x["hits"]:
            part = " ".join(words_of(texts[x["doc_id"]])[h["s"] : h["e"]])
            assert re.fullmatch(rules[h["p"]].regex, part)


def forms(parsed):
    """Texts of a parsed regex, with each of its alternatives; a set of characters gives each of them."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            here = [chr(arg)]
        elif name == "IN":
            here = [chr(c) for kind, a in arg for c in ([a] if str(kind) == "LITERAL" else range(a[0], a[1] + 1))]
        elif name == "BRANCH":
            here = [f for branch in arg[1] for f in forms(branch)]
        elif name == "SUBPATTERN":
            here = forms(arg[3])
        elif name == "MAX_REPEAT":
            here = [f for n in range(arg[0], arg[1] + 1) for f in (forms(arg[2]) if n else [""])]
        else:
            raise ValueError(name)
        out = [a + b for a in out for b in here]
    return out


def test_every_form_of_a_license_passes_the_gate():
    rules = [*[x[:3] for x in license_scan.FAMILIES], *[x[:3] for x in license_scan.SINGLE]]
    missed = [(kw, f) for _, kw, regex in rules for f in forms(re._parser.parse(regex)) if license_scan._needle(kw) not in f" {f} "]
    assert not missed
    assert all(r.keyword == "spdx" or r.keyword in r.regex for r in license_scan.default_rules())


def test_license_forms_and_identifiers(spark):
    want = {
        "Creative Commons Attribution-Share Alike 3.0": "cc-by-sa", "Creative Commons Attribution-Non-Commercial 4.0": "cc-by-nc", "the FreeBSD License": "bsd-2", "Simplified License": "bsd-2",
        "it may not be copied without prior written permission": "proprietary", "you may not use this file except in compliance with the License": "apache-2",
        "SPDX-License-Identifier: MIT": "mit", "SPDX-License-Identifier: Apache-2.0": "apache-2", "SPDX-License-Identifier: MPL-2.0": "mpl-2", "SPDX-License-Identifier: GPL-3.0-or-later": "gpl-3",
        "SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause": "apache-2,bsd-3,mit", "he came mit and isc": "",
    }
    got = license_scan.scan(frame(spark, list(enumerate(want)))).orderBy("doc_id").collect()
    assert {t: x["labels"] for t, x in zip(want, got)} == want


def plain_hits(text, rules, compiled={}):
    """Word intervals of all rules' matches, then without those within another, then without the later rule of two that overlap."""
    words = words_of(text)
    norm = " " + " ".join(words) + " "
    hits = set()
    for p, r in enumerate(rules):
        # A rule whose match doesn't hold its keyword works near one only.
        near = [0] if r.keyword in r.regex else [max(0, k - license_scan.REACH) for k, w in enumerate(words) if w == r.keyword]
        for k in near:
            part = norm if r.keyword in r.regex else " " + " ".join(words[k : k + 2 * license_scan.REACH + 1]) + " "
            for m in compiled.setdefault(r.regex, re.compile(f"(?<= )(?:{r.regex})(?= )")).finditer(part):
                s = k + part[: m.start()].count(" ") - 1
                hits.add((s, s + m[0].count(" ") + 1, p))
    left = [a for a in hits if not any(b[:2] != a[:2] and b[0] <= a[0] and a[1] <= b[1] or b[:2] == a[:2] and b[2] < a[2] for b in hits)]
    kept = []
    for h in sorted(left):
        if not kept or h[0] >= kept[-1][1]:
            kept.append(h)
        elif h[2] < kept[-1][2]:
            kept[-1] = h
    return kept


def test_rules_and_suppression_against_plain(spark):
    rules = license_scan.default_rules()
    r = random.Random(10)
    names = [f for _, _, regex in license_scan.FAMILIES for f in r.sample(forms(re._parser.parse(regex)), 1)]
    pieces = [*names, *[x[1] for x in license_scan.SPDX if "[" not in x[1]], "licensed under the", "released under the terms of the", "this file is distributed under", "see the", "spdx license identifier", "or", "and", "all rights reserved", "permission", "the", "x"]
    rows = [(i, ". ".join(r.choice(pieces) for _ in range(r.randint(1, 14)))) for i in range(120)] + [(900, "filler words " * 4000 + "licensed under the MIT license")]
    got = {x["doc_id"]: x["hits"] for x in license_scan.scan(frame(spark, rows)).collect()}
    for i, text in rows:
        assert [(h["s"], h["e"], h["p"]) for h in got[i]] == plain_hits(text, rules), text


def test_rules_are_bounded(spark):
    assert license_scan.span("a (?:b c )?d[ x]e") == 5 and license_scan.span("(?:a|b c d) e") == 4
    with pytest.raises(ValueError):
        license_scan.scan(frame(spark, [(1, "x")]), [license_scan.Rule("l", "mit", "mit(?: [a-z]+)* license", 1.0)])
    wide = license_scan.Rule("wide", "mit", " ".join(["mit", *["w"] * 60]), 1.0)
    assert [x["labels"] for x in license_scan.scan(frame(spark, [(1, "MIT " + "w " * 60)]), [wide]).collect()] == ["wide"]
