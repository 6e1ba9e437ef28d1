"""The benchmark tables as a virtual graph."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.sources.dataset import TableGraph

#: Keys of the tables; lineitem has none.
KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
    "lineitem": [], "events": ["event_id"], "documents": ["doc_id"], "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"],
}
REFS = {
    "o_custkey": "customer", "c_nationkey": "nation", "s_nationkey": "nation", "n_regionkey": "region", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier", "labels.doc_id": "documents",
}
PREFIXES = {"": "urn:t:", "xsd": "http://www.w3.org/2001/XMLSchema#"}


_OPEN: dict[tuple[str, str], TableGraph] = {}


def table_graph(spark: SparkSession, sf_dir: str) -> TableGraph:
    """All tables of a folder; documents are in named graphs by source, orders by year.

    A folder is opened once in a session, which fixes its schemas and row counts.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _OPEN:
        _OPEN[key] = _open(spark, sf_dir)
    return replace(_OPEN[key])


def _open(spark: SparkSession, sf_dir: str) -> TableGraph:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in KEYS}
    return TableGraph(spark, tables, KEYS, REFS, {"documents": F.col("source"), "orders": F.year("o_orderdate").cast("string")}, name=sf_dir)
