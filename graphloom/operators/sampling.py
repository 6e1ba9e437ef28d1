"""Random rows of patterns, random walks over joins, and estimates from them.

Rows get a number from 0 within their key, and the key's count; of a table that
is entered by a key only the rows of keys that a walk has reached. A draw is then
an equi-join on (key, number). Walks are rows (walk, bindings, p), p being the
probability of the walk so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut
from graphloom.plans.algebra import BGP, Node, Triple, triple_vars
from graphloom.plans.optimizer import greedy_order
from graphloom.sources.dataset import Dataset


def ranked(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with ``_rank`` (from 0, by order) and ``_cnt`` within keys, or of the whole table without keys. order must tell rows apart.

    Range parts are numbered by themselves and shifted by the rows of their key
    in earlier parts, so no task sees all rows of a frequent key. A key that
    lies in several parts holds a border between two of them: there are at most
    two rows for each part to tell about such keys.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *keys)
    sizes = placed.groupBy("_part", *keys).agg(F.count("*").alias("_n"))
    if keys:
        spread = sizes.withColumn("_parts", F.count("*").over(Window.partitionBy(*keys))).where("_parts > 1")
    else:
        spread = sizes
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = spread.select(
        F.col("_part").alias("_bp"), *[F.col(k).alias(f"_b_{k}") for k in keys],
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total"),
    )
    own = placed.withColumn("_own", F.row_number().over(here.orderBy(*order)) - 1).withColumn("_here", F.count("*").over(here))
    on = [F.col("_part") == F.col("_bp"), *[F.col(k).eqNullSafe(F.col(f"_b_{k}")) for k in keys]]
    joined = own.join(F.broadcast(before), on, "left")
    return joined.select(*df.columns, (F.col("_own") + F.coalesce("_before", F.lit(0))).alias("_rank"), F.coalesce("_total", "_here").alias("_cnt"))


def walkers(spark: SparkSession, n: int) -> DataFrame:
    """n walks at their start: walk, p = 1."""
    return spark.range(n).select(F.col("id").alias("walk"), F.lit(1.0).alias("p"))


def seeded(seed: int) -> Column:
    """A uniform draw from [0, 1) for each row."""
    return F.rand(seed)


def arithmetic(walk: str, factor: int, shift: int, modulus: int = 1_000_003) -> Column:
    """A reproducible stand-in for a draw, which other engines can repeat. Not independent for walks that follow each other."""
    return F.pmod(F.col(walk) * factor + shift, F.lit(modulus)) / float(modulus)


def step(walks: DataFrame, table: DataFrame, on: list[tuple[str, str]], draw: Column, keep_failed: bool = False, order: list[str] | None = None) -> DataFrame:
    """One step of a walk: a random row of a table among those whose key equals the walk's columns.

    on: (walk's column, key of the table); none draws from the whole table, which
    must be ranked. With keys a table needn't be: order, which must tell rows
    apart, ranks the rows of the keys that walks have reached, and only those. p
    is multiplied by 1 / count. Walks without a row are dropped, or kept with p
    null.
    """
    keys = [k for _, k in on]
    if keys and order is not None:
        reached = cut(walks)
        walks = reached
        wanted = reached.select(*[F.col(a).alias(f"_w_{k}") for a, k in on]).distinct()
        table = ranked(table.join(wanted, [F.col(k) == F.col(f"_w_{k}") for k in keys], "left_semi"), keys, order)
    if keys:
        counts = table.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.first("_cnt").alias("_n"))
        sized = walks.join(counts, [F.col(a) == F.col(f"_k_{k}") for a, k in on], "left" if keep_failed else "inner").drop(*[f"_k_{k}" for k in keys])
    else:
        total = table.agg(F.max("_cnt").alias("_n"))  # one row
        sized = walks.join(F.broadcast(total), F.col("_n").isNotNull(), "left" if keep_failed else "inner")
    # The draw is fixed by a column of its own before anything joins on it.
    drawn = sized.withColumn("_r", F.least(F.floor(draw * F.col("_n")), F.col("_n") - 1))
    renamed = table.select(*[F.col(c).alias(f"_t_{c}") for c in table.columns])
    cond = [F.col("_r") == F.col("_t__rank"), *[F.col(a) == F.col(f"_t_{k}") for a, k in on]]
    out = drawn.join(renamed, cond, "left" if keep_failed else "inner")
    bound = {c: F.col(f"_t_{c}") for c in table.columns if c not in ("_rank", "_cnt") and c not in walks.columns}
    p = F.when(F.col("_t__rank").isNotNull(), F.col("p") / F.col("_n"))
    return out.select(*[F.col(c) for c in walks.columns if c != "p"], *[c.alias(n) for n, c in bound.items()], p.alias("p"))


def uniform_sample(df: DataFrame, order: list[str], n: int, draw: Column) -> DataFrame:
    """n uniform draws (with replacement) from a table: its columns, walk and p = 1 / size."""
    return step(walkers(df.sparkSession, n), ranked(df, [], order), [], draw)


def estimate(walks: DataFrame, n: int) -> DataFrame:
    """Estimated number of results: the mean of 1 / p over n walks, failed ones counting 0. One row."""
    return walks.agg((F.coalesce(F.sum(1 / F.col("p")), F.lit(0.0)) / n).alias("estimate"))


def distinct_uniform(sample: DataFrame, frequency: DataFrame, on: str, total: int) -> DataFrame:
    """Estimated distinct values from a uniform sample: total / n times the sum of 1 / F. frequency: (on, f)."""
    joined = sample.join(frequency, on)
    return joined.agg((F.lit(float(total)) / F.count("*") * F.sum(1 / F.col("f"))).alias("estimate"))


def distinct_weighted(sample: DataFrame, frequency: DataFrame, on: str, total: int) -> DataFrame:
    """The same from a sample with unequal p, each draw weighing 1 / p."""
    joined = sample.join(frequency, on)
    return joined.agg((F.lit(float(total)) / F.sum(1 / F.col("p")) * F.sum(1 / F.col("p") / F.col("f"))).alias("estimate"))


def accept(walks: DataFrame, total: int, draw: Column) -> DataFrame:
    """Accept or reject walks so that those left are uniform: with probability (1 / total) / p."""
    return walks.where(draw <= (1.0 / total) / F.col("p"))


def walk_pattern(data: Dataset, triples: tuple[Triple, ...], n: int, seed: int = 1, graph: Node | str | None = None) -> DataFrame:
    """n random walks through a pattern: each triple in turn draws among the rows that fit what is bound. Failed walks are dropped.

    Variables are in columns v_NAME. A walk's p is the probability with which it
    was drawn, so 1 / p weighs it.
    """
    walks = walkers(data.spark, n)
    known: list[str] = []
    for k, unit in enumerate(greedy_order(data.units(triples), lambda u: data.cardinality(u, graph), lambda u: set().union(*[triple_vars(t) for t in u]))):
        rel = data.scan(unit, graph, False)
        shared = [v for v in rel.vars if v in known]
        fresh = [v for v in rel.vars if v not in known]
        named = {v: f"v_{v}" if v in fresh else f"_on_{v}" for v in rel.vars}
        rows = rel.df.select(*[F.col(v).alias(n) for v, n in named.items()])
        order = [named[v] for v in fresh or shared]
        walks = step(walks, rows if shared else ranked(rows, [], order), [(f"v_{v}", f"_on_{v}") for v in shared], seeded(seed + k), order=order)
        walks = walks.drop(*[f"_on_{v}" for v in shared])
        known += fresh
    return walks


def estimate_pattern(data: Dataset, triples: tuple[Triple, ...], n: int | None, seed: int = 1, graph: Node | str | None = None) -> float:
    """Estimated number of solutions of a pattern from n walks; exact if n is None."""
    if n is None:
        from graphloom.plans.compiler import compile_select

        return float(compile_select(BGP(triples, graph), data, decode=False).df.count())
    return float(estimate(walk_pattern(data, triples, n, seed, graph), n).first()[0])
