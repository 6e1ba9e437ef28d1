"""Line dedup over overlapping three-line windows.

Lines without a word are passed over; each three consecutive lines of the rest
are a window, and a text with fewer lines is one window by itself. Windows are
compared by two 64-bit hashes of their trimmed lines. The first occurrence of a
window (by document id, then text hash, then line) stays; the lines that later
occurrences cover, merged over overlapping windows, are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lines in a window.
WINDOW = 3
_SPACE = " \t\x0b\x0c\r"


def windows(docs: DataFrame, id_col: str, text_col: str, width: int = WINDOW) -> DataFrame:
    """(id, th, pos, a, b): window hashes of every row; pos is the number of the window's first line among the lines with a word."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(_SPACE))), lambda x: x != "")
    hashed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.transform(lines, lambda x: F.xxhash64(x)).alias("a"), F.transform(lines, lambda x: F.xxhash64(F.lit("second"), x)).alias("b"))
    whole = F.size("a") <= width
    fold = lambda c: F.when(whole, F.array(F.xxhash64(c))).otherwise(
        F.transform(F.arrays_zip(*[F.slice(c, F.lit(k + 1), F.size(c) - (width - 1)).alias(f"x{k}") for k in range(width)]), lambda w: F.xxhash64(*[w[f"x{k}"] for k in range(width)]))
    )
    both = hashed.where(F.size("a") > 0).select("id", "th", F.posexplode(F.arrays_zip(fold(F.col("a")).alias("a"), fold(F.col("b")).alias("b"))).alias("pos", "w"))
    return both.select("id", "th", "pos", "w.a", "w.b")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """docs with repeated lines removed from text_col, and with ``_n_lines`` and ``_n_removed`` (lines with a word).

    Rows stay, even if nothing of their text does. Rows with equal id and equal
    text are one occurrence: if another row has their lines first, all lose
    them, else none does. A null text stays null. Null ids come first. Lines
    without a word go with the line before them. Other columns pass through,
    whatever their names (``_n_lines`` and ``_n_removed`` excepted). An empty
    table gives an empty result.
    """
    found = windows(docs, id_col, text_col, width)
    at = F.struct("id", "th", "pos")
    firsts = found.groupBy("a", "b").agg(F.min(at).alias("first"), F.min(F.struct("id", "th", "pos")).alias("lo"), F.max(at).alias("hi"))
    # A window with one occurrence has equal least and largest places.
    repeated = firsts.where(~F.col("lo").eqNullSafe(F.col("hi"))).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first")
    later = found.join(repeated, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).where(~F.col("first").eqNullSafe(at))
    # A document's own window numbers, as many as it has lines at most.
    covered = later.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_at"))
    # Rows travel as one column, so that their own columns may have any names.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"))
    text = F.col(f"_row.{text_col}")
    joined = rows.join(covered, F.col(f"_row.{id_col}").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("_th")), "left")
    lines = F.split(text, "\n", -1)
    # Numbers of the lines with a word; the lines without one that follow belong to them.
    solid = F.array_compact(F.transform(lines, lambda x, i: F.when(F.trim(x, F.lit(_SPACE)) != "", i)))
    changed = joined.withColumn("_solid", F.when(F.col("_at").isNotNull(), solid)).withColumn("_lines", F.when(F.col("_at").isNotNull(), lines))
    gaps = changed.withColumn("_gaps", _gaps(F.array_sort("_at"), F.size("_solid"), width))
    left = F.aggregate("_gaps", F.lit(0), lambda n, g: n + g["b"] - g["a"])
    edge = lambda k: F.when(k <= 0, 0).when(k >= F.size("_solid"), F.size("_lines")).otherwise(F.try_element_at("_solid", k + 1))
    kept = F.flatten(F.transform("_gaps", lambda g: F.slice(F.col("_lines"), edge(g["a"]) + 1, edge(g["b"]) - edge(g["a"]))))
    new_text = F.when(F.col("_at").isNull(), text).when(left == 0, "").otherwise(F.array_join(kept, "\n"))
    full = F.coalesce(F.regexp_count(text, F.lit(r"(?md)^[^\n]*?[^ \t\x0B\f\r\n]")), F.lit(0))
    out = [new_text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return gaps.select(*out, full.alias("_n_lines"), F.when(F.col("_at").isNull(), 0).otherwise(F.size("_solid") - left).alias("_n_removed"))


def _gaps(starts: Column, n: Column, width: int) -> Column:
    """The runs [a, b) of n lines that windows at the sorted starts leave."""
    before = F.concat(F.array(F.lit(0)), F.transform(starts, lambda s: s + width))
    after = F.concat(starts, F.array(n))
    runs = F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda g: F.struct(F.least(g["a"], n).alias("a"), F.least(g["b"], n).alias("b")))
    return F.filter(runs, lambda g: g["a"] < g["b"])
