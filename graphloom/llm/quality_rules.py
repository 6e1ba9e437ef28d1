"""Quality rules with adaptive thresholds.

Each text is measured once. The measures' distribution in each (language,
source) is kept as a mergeable quantile sketch: counts of logarithmic buckets,
which add up over tasks in any order to the same sketch. Thresholds are outer
fences of those quantiles on the logarithmic scale, with the language's own
sketch, which is the sum of its sources', standing in for sources with few
texts. They are joined to the texts and decide.

A measure is a count per word, as half an occurrence in one word more (the usual
estimate of a rate from a count). So a text without any still has a value, which
says how little that means in a text of its length, and the sketch has a spread
where most texts have none. No threshold has a part that isn't learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import LOG_GAMMA, WORD, cut, sketch_bucket, sketch_buckets

_WORDS = re.compile(WORD)
_SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Measure -> the count it is made of. Too small a value speaks against a text only where it says so.
MEASURES = {"symbol_ratio": "n_symbols", "dup_line_ratio": "n_dup_lines", "repeat_ratio": "n_repeat_words", "upper_ratio": "n_upper_words", "word_length": "word_chars"}
TWO_SIDED = ("word_length",)
#: Fences lie so many spreads (distances of quartiles, in buckets) beyond the quartiles.
FENCE = 3.0
#: Sources with fewer texts use the thresholds of their language.
MIN_TEXTS = 50

_STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper_words long"


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, all-capital words."""
    words = _WORDS.findall(text)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line in seen:
            dup_lines += _WORDS.search(line) is not None
        else:
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        end = 0  # first word not yet counted
        for i, w in enumerate(windows):
            if count[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    symbols = len(_SYMBOLS.findall(text))
    upper = sum(map(str.isupper, words))
    return len(words), sum(map(len, words)), symbols, dup_lines, repeated, upper


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct column ``_m`` of the counts of measure(); a null text counts as empty."""

    @F.pandas_udf(_STATS)
    def stats(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _STATS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([measure(t or "") for t in texts], columns=names)

    return docs.withColumn("_m", stats(F.col(text_col)))


def _values() -> dict[str, Column]:
    return {m: (F.col(c) + 0.5) / (F.col("n_words") + 1) for m, c in MEASURES.items()}


def sketches(values: DataFrame) -> DataFrame:
    """Sketch rows (lang, source, measure, bucket, n) of rows with lang, source and a column for each measure."""
    pairs = ", ".join(f"'{m}', {m}" for m in MEASURES)
    long = values.select("lang", "source", F.expr(f"stack({len(MEASURES)}, {pairs}) AS (measure, x)"))
    return long.groupBy("lang", "source", "measure", sketch_bucket(F.col("x")).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row for each (lang, source) with <measure>_lo and <measure>_hi, as logarithms."""
    quartiles = {"b1": 0.25, "b3": 0.75}
    own = sketch_buckets(sketch, ["lang", "source", "measure"], quartiles)
    lang = sketch_buckets(sketch.groupBy("lang", "measure", "bucket").agg(F.sum("n").alias("n")), ["lang", "measure"], quartiles)
    lang = lang.select(F.col("lang").alias("_l"), F.col("measure").alias("_ms"), F.col("b1").alias("_b1"), F.col("b3").alias("_b3"))
    both = own.join(lang, own["lang"].eqNullSafe(F.col("_l")) & (own["measure"] == F.col("_ms")))
    few = F.col("n") < MIN_TEXTS
    b1, b3 = F.when(few, F.col("_b1")).otherwise(F.col("b1")), F.when(few, F.col("_b3")).otherwise(F.col("b3"))
    # The middle half lies between the start of one bucket and the end of the other.
    spread = b3 - b1 + 1
    limits = both.select("lang", "source", "measure", ((b1 - 1 - FENCE * spread) * LOG_GAMMA).alias("lo"), ((b3 + FENCE * spread) * LOG_GAMMA).alias("hi"))
    picked = [F.max(F.when(F.col("measure") == m, F.col(side))).alias(f"{m}_{side}") for m in MEASURES for side in ("lo", "hi")]
    return limits.groupBy("lang", "source").agg(*picked)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row for each row of docs: doc_id, the counts, base_failed, failed (the measures beyond a fence), kept.

    base_failed: under 50 words, or more than half of the words in repeated
    windows. kept: not base_failed and no measure beyond its fences; values in
    the quartiles' own buckets never are, so equal texts are all kept. Null
    languages and sources are groups of their own, a null text counts as empty.
    Repeated rows are judged and counted each. Other columns are ignored; an
    empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("_t"))
    # The texts are read and measured once; what follows runs over a few numbers for each.
    stats = cut(measured(base, "_t").select("doc_id", "lang", "source", "_m.*"))
    values = stats.withColumns(_values())
    limits = fences(sketches(values)).withColumnsRenamed({"lang": "_l", "source": "_s"})
    joined = values.join(limits, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    out_of = {m: F.log(m) > F.col(f"{m}_hi") for m in MEASURES}
    out_of |= {m: out_of[m] | (F.log(m) < F.col(f"{m}_lo")) for m in TWO_SIDED}
    beyond = F.array_compact(F.array(*[F.when(out, F.lit(m)) for m, out in out_of.items()]))
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"), F.array_join(beyond, ",").alias("failed"), "lang", "source",
    )
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == ""))
