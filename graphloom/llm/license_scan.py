"""License scan by ordered signature rules, in DataFrame functions only and without a shuffle.

Texts are reduced to their words, lower-cased and parted by single spaces. A
text without any rule's keyword is done at once. Otherwise each rule whose own
keyword occurs is matched against the words around it; a hit is an interval of
words.
Hits inside another hit's interval are suppressed (of equal intervals the one
of the earlier rule stays), then of two overlapping neighbours the one of the
later rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ascii_lower

_NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, keyword, name as a regex over words. Earlier lines have priority.
FAMILIES = [
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("agpl-3", "agpl", r"(?:gnu )?agpl ?(?:version |v)?3(?: 0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("lgpl-3", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?3(?: 0)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[cs]e(?: version| v)? ?2 1"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?(?:version |v)?2 1"),
    ("lgpl-2", "library", r"(?:gnu )?library general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("gpl-3", "general", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?3(?: 0)?"),
    ("gpl-3", "gpl", r"(?:gnu )?gpl ?(?:version |v)?3(?: 0)?"),
    ("gpl-2", "general", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("gpl-2", "gpl", r"(?:gnu )?gpl ?(?:version |v)?2(?: 0)?"),
    ("gpl-1", "general", r"(?:gnu )?general public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("gpl", "general", r"gnu general public licen[cs]e"),
    ("gpl", "gpl", r"gnu gpl"),
    ("fdl-1.3", "documentation", r"(?:gnu )?free documentation licen[cs]e(?: version| v)? ?1 3"),
    ("fdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("apache-2", "apache", r"(?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)? licen[cs]e(?: version| v)? ?1 1"),
    ("apache", "apache", r"(?:the )?apache(?: software)? licen[cs]e"),
    ("mit-0", "mit", r"mit no attribution(?: licen[cs]e)?"),
    ("mit", "mit", r"(?:the )?mit(?: x11)? licen[cs]e"),
    ("x11", "x11", r"x11 licen[cs]e"),
    ("expat", "expat", r"expat licen[cs]e"),
    ("bsd-4", "bsd", r"(?:4|four) clause bsd licen[cs]e"),
    ("bsd-3", "bsd", r"(?:3|three) clause bsd licen[cs]e"),
    ("bsd-3", "bsd", r"(?:new|modified|revised) bsd licen[cs]e"),
    ("bsd-2", "bsd", r"(?:2|two) clause bsd licen[cs]e"),
    ("bsd-2", "simplified", r"simplified (?:bsd )?licen[cs]e"),
    ("bsd-2", "freebsd", r"freebsd (?:bsd )?licen[cs]e"),
    ("bsd-0", "bsd", r"(?:0|zero) clause bsd licen[cs]e"),
    ("bsd", "bsd", r"(?:the )?bsd(?: style)? licen[cs]e"),
    ("isc", "isc", r"(?:the )?isc licen[cs]e"),
    ("mpl-2", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[cs]e(?: version| v)? ?1 1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("cddl-1", "distribution", r"common development and distribution licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "european", r"european union public licen[cs]e(?: version| v)? ?1 2"),
    ("artistic-2", "artistic", r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("artistic-1", "artistic", r"artistic licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("bsl-1", "boost", r"boost software licen[cs]e(?: version| v)? ?1(?: 0)?"),
    ("busl-1.1", "business", r"business source licen[cs]e(?: version| v)? ?1 1"),
    ("sspl-1", "server", r"server side public licen[cs]e(?: version| v)? ?1?"),
    ("elastic-2", "elastic", r"elastic licen[cs]e(?: version| v)? ?2(?: 0)?"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)? licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("python-2", "python", r"python software foundation licen[cs]e(?: version| v)? ?2?"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e(?: version| v)? ?1 1"),
    ("odbl-1", "database", r"open database licen[cs]e(?: version| v)? ?1?(?: 0)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl(?: licen[cs]e)?"),
    ("cc0-1", "cc0", r"cc0(?: 1(?: 0)?)?(?: universal)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: [1-4] [05])?"),
    ("cc-by-nc", "cc", r"cc by nc(?: [1-4] [05])?"),
    ("cc-by-nd", "cc", r"cc by nd(?: [1-4] [05])?"),
    ("cc-by-sa", "cc", r"cc by sa(?: [1-4] [05])?"),
    ("cc-by", "cc", r"cc by(?: [1-4] [05])?"),
    ("cc-by-nc-nd", "creative", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative", r"creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative", r"creative commons attribution(?: [1-4] [05])?"),
    ("cc", "creative", r"creative commons licen[cs]e"),
]

#: How a text invokes a family, most telling first, with the confidence of a hit.
FRAMES = [
    (r"spdx licen[cs]e identifier NAME", 1.0),
    (r"(?:this|the) (?:work|file|program|software|project|document|text|material|code|library) is (?:licensed|released|distributed|published|provided|available) under (?:the )?(?:terms of )?(?:the )?NAME", 1.0),
    (r"(?:dual )?(?:licensed|released|distributed|published|relicensed) (?:under|subject to) (?:the )?(?:terms of )?(?:the )?NAME", 0.95),
    (r"(?:under|subject to|see|governed by) (?:the )?(?:terms (?:of|and conditions of) )?(?:the )?NAME", 0.8),
    (r"NAME", 0.6),
]

#: Rules of their own, before (priority 0) the families.
SINGLE = [
    ("mit", "permission", r"permission is hereby granted free of charge to any person obtaining a copy", 1.0),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("isc", "permission", r"permission to use copy modify and or distribute this software for any purpose", 1.0),
    ("gpl", "redistribute", r"you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("apache-2", "compliance", r"you may not use this file except in compliance with the licen[cs]e", 0.7),
    ("public-domain", "domain", r"(?:released|placed|dedicated|is) (?:into|in|to) the public domain", 0.9),
    ("proprietary", "reserved", r"all rights (?:are )?reserved", 0.7),
    ("proprietary", "proprietary", r"proprietary and confidential", 0.8),
    ("proprietary", "permission", r"(?:may|must) not be (?:copied|reproduced|redistributed) without (?:prior )?(?:written )?permission", 0.8),
]

#: label and SPDX identifiers as words; a regex of fixed length each.
SPDX = [
    ("mit", "mit"), ("mit-0", "mit 0"), ("apache-2", "apache 2 0"), ("apache-1.1", "apache 1 1"), ("mpl-2", "mpl 2 0"), ("mpl-1.1", "mpl 1 1"),
    *[(label, name + end) for label, name in (("gpl-1", "gpl 1 0"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2", "lgpl 2 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("fdl-1.3", "gfdl 1 3")) for end in ("", " only", " or later")],
    ("bsd-0", "0bsd"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("bsd-4", "bsd 4 clause"), ("isc", "isc"), ("x11", "x11"), ("epl-1", "epl 1 0"), ("epl-2", "epl 2 0"),
    ("cddl-1", "cddl 1 0"), ("eupl-1.2", "eupl 1 2"), ("artistic-1", "artistic 1 0"), ("artistic-2", "artistic 2 0"), ("bsl-1", "bsl 1 0"), ("busl-1.1", "busl 1 1"), ("sspl-1", "sspl 1 0"), ("elastic-2", "elastic 2 0"),
    ("zlib", "zlib"), ("openssl", "openssl"), ("python-2", "python 2 0"), ("python-2", "psf 2 0"), ("ofl-1.1", "ofl 1 1"), ("odbl-1", "odbl 1 0"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"), ("cc0-1", "cc0 1 0"),
    *[(f"cc-{name.replace(' ', '-')}", f"cc {name} [1-4] [05]") for name in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")],
]


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    regex: str
    confidence: float


def default_rules() -> list[Rule]:
    """Some 480 rules in order of priority: SINGLE, then SPDX, after the tag or after another identifier near one, then FRAMES by FAMILIES."""
    after = "|".join(f"(?<= {name} )" for _, name in SPDX)
    tagged = [Rule(label, "spdx", f"spdx licen[cs]e identifier {name}", 1.0) for label, name in SPDX]
    joined = [Rule(label, "spdx", f"(?:{after})(?:or|and) {name}", 1.0) for label, name in SPDX]
    framed = [Rule(label, kw, frame.replace("NAME", f"(?:{name})"), c) for frame, c in FRAMES for label, kw, name in FAMILIES]
    return [Rule(*x) for x in SINGLE] + tagged + joined + framed


#: Keywords that may go on within their word, as in gplv3.
_OPEN = ("gpl", "lgpl", "agpl")


def _needle(keyword: str) -> str:
    """What a padded text holds if the keyword occurs as a word."""
    return f" {keyword}" if keyword in _OPEN else f" {keyword} "


def _n_words(piece: Column) -> Column:
    return F.regexp_count(piece, F.lit(r"[^ ]+")).cast("long")


def _intervals(norm: Column, offset: Column, rule: Column) -> Column:
    """Word intervals (s, e, p, label, c) of a rule's matches in a padded text whose first word has the number offset."""
    regex = F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )"))
    pieces = F.split(norm, regex, -1)
    found = F.regexp_extract_all(norm, regex, F.lit(0))
    hit = lambda s, m: F.struct(s.alias("s"), (s + _n_words(m)).alias("e"), rule["p"].alias("p"), rule["label"].alias("label"), rule["c"].alias("c"))
    start = F.struct(offset.alias("at"), F.array().cast("array<struct<s:bigint,e:bigint,p:int,label:string,c:double>>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + _n_words(x["piece"])
        return F.struct((s + _n_words(x["m"])).alias("at"), F.concat(acc["hits"], F.array(hit(s, x["m"]))).alias("hits"))

    pairs = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(found)).alias("piece"), found.alias("m"))
    return F.aggregate(pairs, start, step, lambda acc: acc["hits"])


def _suppress(hits: Column) -> Column:
    """What containment, then priority between overlapping neighbours, leaves of hits."""
    order = lambda a, b: (
        F.when(a["s"] != b["s"], F.when(a["s"] < b["s"], -1).otherwise(1)).when(a["e"] != b["e"], F.when(a["e"] > b["e"], -1).otherwise(1)).when(a["p"] != b["p"], F.when(a["p"] < b["p"], -1).otherwise(1)).otherwise(0)
    )
    # In this order a hit lies in an earlier one exactly if it ends no later than the last hit kept.
    none = F.slice(hits, 1, 0)

    def step(kept: Column, h: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        better = F.concat(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), F.array(h))
        return (
            F.when(last.isNull() | (h["s"] >= last["e"]), F.concat(kept, F.array(h)))
            .when(h["e"] <= last["e"], kept)
            .when(h["p"] < last["p"], better)
            .otherwise(kept)
        )

    return F.aggregate(F.array_sort(hits, order), none, step)


#: Words on each side of a keyword that are looked at, at least: how far from the tag an identifier of its expression can be. Rules that span more widen it.
REACH = 32


def span(regex: str) -> int:
    """Words that a rule's match can have at most, with what it looks back at. Rules without such a bound are refused."""

    def gaps(parsed: object) -> int:
        total = 0
        for op, arg in parsed:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL"):
                total += (arg == 32) == (name == "LITERAL")
            elif name == "IN":
                total += any(str(k) != "LITERAL" or a == 32 for k, a in arg)
            elif name == "BRANCH":
                total += max(gaps(x) for x in arg[1])
            elif name == "SUBPATTERN":
                total += gaps(arg[3])
            elif name == "ASSERT":
                total += gaps(arg[1])
            elif name in ("MAX_REPEAT", "MIN_REPEAT"):
                inner = gaps(arg[2])
                if inner and arg[1] > 1000:
                    raise ValueError(f"a rule without a bound on its words: {regex}")
                total += inner * arg[1]
            elif name == "ANY":
                total += 1
        return total

    return gaps(re._parser.parse(regex)) + 1


def _regions(norm: Column, keywords: list[str], around: int) -> Column:
    """(k, at, region) for each place of a keyword: the padded words around it, so many on each side, and the number of the first."""
    words = F.split(F.trim(norm), " ")
    open_ = "^(" + "|".join(_OPEN) + ")"
    known = F.array(*[F.lit(k) for k in keywords])
    key = lambda w: F.when(w.rlike(open_), F.regexp_extract(w, open_, 1)).when(F.array_contains(known, w), w)
    places = F.filter(F.transform(words, lambda w, i: F.struct(key(w).alias("k"), F.greatest(i - around, F.lit(0)).alias("at"))), lambda x: x["k"].isNotNull())
    part = lambda x: F.concat(F.lit(" "), F.array_join(F.slice(words, x["at"] + 1, F.lit(2 * around + 1)), " "), F.lit(" "))
    return F.transform(places, lambda x: F.struct(x["k"].alias("k"), x["at"].cast("long").alias("at"), part(x).alias("region")))


def scan(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labels of every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, hits.

    ``hits`` are the rule hits that stay, as word intervals. A null text counts
    as empty; texts without a hit get empty labels and score 0. Rows are
    handled each by itself, so repeated rows and other columns don't matter, and
    an empty table gives an empty result. Texts are read whole, of any length; of
    matches at one place the longest stays, of equal ones that of the earlier
    rule. A rule looks at the words around its keyword, as many as any rule can
    span, REACH at least; one without a bound raises ValueError. score is the largest confidence of
    the hits that stay; a base phrase counts with 0.9.
    """
    rules = default_rules() if rules is None else rules
    gates = sorted({_needle(r.keyword) for r in rules} | {" mit ", " apache ", " cc "})
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), _NOT_WORD, " ")), F.lit(" "))
    raw = docs.select(F.col(id_col).alias("doc_id"), norm.alias("_t"))
    gated = F.lit(False)
    for word in gates:
        gated = gated | F.contains(F.col("_t"), F.lit(word))
    spaces = F.octet_length("_t") - F.octet_length(F.replace(F.col("_t"), F.lit(" "), F.lit("")))
    base = raw.select("doc_id", F.when(F.col("_t") == "  ", 0).otherwise(spaces - 1).cast("long").alias("n_words"), F.when(gated, F.col("_t")).alias("_n"))
    phrase = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    n = F.col("_n")
    counted = base.withColumn("n_base", F.coalesce(F.regexp_count(n, F.lit(phrase)), F.lit(0)).cast("long"))
    some = F.col("n_base") > 0
    first = F.when(some, _n_words(F.substring(n, F.lit(1), F.regexp_instr(n, F.lit(phrase)) - 1)))
    last = F.when(some, _n_words(F.regexp_extract(n, f"(?s)^(.*){phrase}", 1)))
    base_labels = F.when(some, F.array_compact(F.array(*[F.when(F.contains(n, F.lit(f" {p} ")), F.lit(label)) for p, label in sorted(BASE.items(), key=lambda x: x[1])])))
    empty = F.array().cast("array<struct<s:bigint,e:bigint,p:int,label:string,c:double>>")
    if rules:
        listed = F.array(*[F.struct(F.lit(r.keyword).alias("kw"), F.lit(r.regex).alias("regex"), F.lit(i).alias("p"), F.lit(r.label).alias("label"), F.lit(r.confidence).alias("c")) for i, r in enumerate(rules)])
        in_region = lambda x: F.flatten(F.transform(F.filter(listed, lambda r: r["kw"] == x["k"]), lambda r: _intervals(x["region"], x["at"], r)))
        hits = F.when(n.isNotNull(), _suppress(F.array_distinct(F.flatten(F.transform(_regions(n, sorted({r.keyword for r in rules}), max(REACH, *(span(r.regex) for r in rules))), in_region)))))
    else:
        hits = F.lit(None).cast("array<struct<s:bigint,e:bigint,p:int,label:string,c:double>>")
    found = counted.select(
        "doc_id", "n_words", "n_base", first.alias("first_word"), last.alias("last_word"),
        F.coalesce(base_labels, F.array().cast("array<string>")).alias("_b"), F.coalesce(hits, empty).alias("hits"),
    )
    labels = F.array_sort(F.array_union(F.col("_b"), F.transform("hits", lambda h: h["label"])))
    score = F.greatest(F.coalesce(F.array_max(F.transform("hits", lambda h: h["c"])), F.lit(0.0)), F.when(F.size("_b") > 0, F.lit(0.9)).otherwise(F.lit(0.0)))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_b", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "hits")
