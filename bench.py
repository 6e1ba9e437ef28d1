"""Times the headline queries and prints one JSON line. BENCH_SF_DIR: input; BENCH_CPUS: cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from graphloom import catalogue, engine
from graphloom.sources.tables import PREFIXES, table_graph
from graphloom.streaming.paging import Budget, run_page

HEADLINE = [
    "bgp_const_object", "bgp_star", "bgp_chain", "bgp_repeated_var", "full_scan_spo", "filter_range", "filter_string", "join_groups", "optional_simple", "optional_filter_on",
    "optional_nested", "optional_shared_unbound", "union_in_join", "order_topk", "distinct", "graph_var", "graph_union", "provenance_join", "group_agg", "having", "count_distinct",
    "exists", "not_exists", "minus", "subquery", "path_seq", "path_plus", "page_first", "sample_walk", "estimate_card",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known, times = catalogue.queries(), {}

    def clock(name: str, f: object, runs: int = 2) -> None:
        best = None
        for _ in range(runs):
            began = time.time()
            f()
            best = min(best or 1e9, time.time() - began)
        times[name] = round(best, 3)

    for name in HEADLINE:
        clock(name, lambda: known[name](spark, sf).write.format("noop").mode("overwrite").save())

    # What pausing costs: a join whole, and in ten pages.
    data = table_graph(spark, sf)
    text = 'SELECT ?o ?q { ?o :o_orderstatus "P" . ?l :ref-l_orderkey ?o ; :l_quantity ?q }'

    def whole() -> int:
        return len(engine.select(data, text, PREFIXES).collect())

    def paged(limit: int) -> None:
        token = None
        while True:
            page = run_page(data, text, Budget(limit=limit), token, prefixes=PREFIXES)
            token = page.token
            if token is None:
                return

    rows = whole()
    clock("resumable_whole", whole)
    clock("resumable_in_10_pages", lambda: paged(-(-rows // 10)), 1)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
