"""Pieces the training-data operators share: table access, lineage cuts and a mergeable quantile sketch."""

from __future__ import annotations

import math
import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder named by spark.checkpoint.dir.

    Only in local mode, where driver and executors are one process, a temporary
    folder is set where that setting is absent; on a cluster it is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
    return df.checkpoint()


#: Rows that a row is repeated as at a time.
_REPEATS = 100_000


def repeated(df: DataFrame, n_col: str) -> DataFrame:
    """Each row as often as its column n_col says, numbered from 0 by ``_nth``, in steps, so that no row makes a long array."""
    n = F.col(n_col)
    blocks = df.withColumn("_block", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / _REPEATS).cast("long")), lambda x: x * _REPEATS)))
    last = F.least(F.lit(_REPEATS - 1).cast("long"), n - F.col("_block") - 1)
    return blocks.withColumn("_nth", F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn("_nth", F.col("_block") + F.col("_nth")).drop("_block")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


#: Relative width of a sketch's buckets.
ALPHA = 0.005
_GAMMA = (1 + ALPHA) / (1 - ALPHA)
LOG_GAMMA = math.log(_GAMMA)
#: Values up to this share the lowest bucket, which stands for zero.
_TINY = 1e-6


def sketch_bucket(x: Column) -> Column:
    """Bucket of a non-negative value. Bucket counts are the sketch: adding them merges sketches exactly."""
    return F.when(x <= _TINY, F.lit(-(10**6))).otherwise(F.ceil(F.log(x) / LOG_GAMMA)).cast("int")


def bucket_value(b: Column) -> Column:
    """The value that stands for a bucket, within ALPHA of everything in it."""
    return F.when(b == -(10**6), F.lit(0.0)).otherwise(2 * F.pow(F.lit(_GAMMA), b.cast("double")) / (1 + _GAMMA))


def sketch_buckets(counts: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """Buckets of quantiles out of sketches given as rows (keys, bucket, n): one row per key, with its total as ``n``."""
    w = Window.partitionBy(*keys)
    run = counts.withColumn("_cum", F.sum("n").over(w.orderBy("bucket"))).withColumn("_all", F.sum("n").over(w))
    aggs = [F.min(F.when(F.col("_cum") >= F.greatest(F.lit(1.0), q * F.col("_all")), F.col("bucket"))).alias(name) for name, q in quantiles.items()]
    return run.groupBy(*keys).agg(F.max("_all").alias("n"), *aggs)


def sketch_quantiles(counts: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """The same with the values that stand for the buckets."""
    found = sketch_buckets(counts, keys, quantiles)
    return found.withColumns({name: bucket_value(F.col(name)) for name in quantiles})
