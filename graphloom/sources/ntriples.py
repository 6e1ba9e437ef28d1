"""N-Triples and N-Quads, quoted triples included, read and written by Spark."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.dataset import TripleStore

_SUBJECT = r"(<<.*?>>(?=\s)|<[^<>\s]*>|_:\S+)"
_LINE = rf'^\s*{_SUBJECT}\s*(<[^<>\s]*>)\s*(<<.*?>>|<[^<>\s]*>|_:[^\s.]+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)\s*(<[^<>\s]*>|_:[^\s.]+)?\s*\.\s*(?:#.*)?$'


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """(s, p, o, g) of N-Triples or N-Quads lines; g is null in the default graph. Comments and empty lines are passed over; anything else raises."""
    kept = lines.where(~F.col(column).rlike(r"^\s*(#.*)?$"))
    part = lambda k: F.regexp_extract(column, _LINE, k)
    checked = F.when(F.col(column).rlike(_LINE), part(1)).otherwise(F.raise_error(F.concat(F.lit("not N-Triples: "), F.col(column))))
    # Datatypes that mean the same as none are left off, so that equal terms are equal strings.
    o = F.regexp_replace(part(3), r"\^\^<http://www\.w3\.org/2001/XMLSchema#string>$", "")
    return kept.select(checked.alias("s"), part(2).alias("p"), o.alias("o"), F.when(part(4) != "", part(4)).alias("g"))


def read(spark: SparkSession, path: str | list[str], graph: str | None = None, name: str | None = None) -> TripleStore:
    """A store of files (plain, gzip or bzip2). graph: put default-graph statements into this named graph."""
    found = parse_lines(spark.read.text(path))
    if graph is not None:
        found = found.withColumn("g", F.coalesce("g", F.lit(graph)))
    return TripleStore.from_terms(spark, found.where("g is null"), found.where("g is not null"), name or str(path))


def bulk_load(spark: SparkSession, source: str | list[str], target: str) -> TripleStore:
    """Files to Parquet tables at target, and the store that reads them."""
    read(spark, source).save(target)
    return TripleStore.load(spark, target)


def write(store: TripleStore, path: str) -> None:
    """The store as N-Quads text."""
    both = store.quads.select("s", "p", "o", "g").union(store.triples.select("s", "p", "o", F.lit(None).cast("long")))
    for c in ("s", "p", "o", "g"):
        looked = store.nodes.select(F.col("id").alias("_i"), F.col("term").alias(f"_{c}"))
        both = both.join(looked, F.col(c) == F.col("_i"), "left").drop("_i")
    both.select(F.concat(F.concat_ws(" ", "_s", "_p", "_o", "_g"), F.lit(" ."))).write.mode("overwrite").text(path)


def query_folder(path: str, blacklist: tuple[str, ...] = (), suffix: str = ".sparql") -> dict[str, str]:
    """Queries of a folder by file name, each on one line."""
    return {f.stem: " ".join(f.read_text().split()) for f in sorted(Path(path).glob(f"*{suffix}")) if f.stem not in blacklist and f.name not in blacklist}
