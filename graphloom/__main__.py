"""python -m graphloom load FILES... TARGET | query DATABASE TEXT | serve DATABASE."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom.server import answer, make_server
from graphloom.sources import ntriples
from graphloom.sources.dataset import TripleStore
from graphloom.streaming.paging import Budget


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="graphloom")
    sub = p.add_subparsers(dest="command", required=True)
    load = sub.add_parser("load", help="N-Triples or N-Quads files to a database folder")
    load.add_argument("files", nargs="+")
    load.add_argument("target")
    query = sub.add_parser("query", help="print one page of a query as JSON")
    query.add_argument("database")
    query.add_argument("text")
    query.add_argument("--token")
    serve = sub.add_parser("serve", help="answer queries over HTTP")
    serve.add_argument("database")
    serve.add_argument("--port", type=int, default=3330)
    for x in (query, serve):
        x.add_argument("--limit", type=int, default=100_000)
        x.add_argument("--timeout", type=int, default=5000, help="milliseconds")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("graphloom").getOrCreate()
    if a.command == "load":
        ntriples.bulk_load(spark, a.files, a.target)
        return
    data, budget = TripleStore.load(spark, a.database), Budget(a.limit, a.timeout)
    if a.command == "query":
        print(answer(data, a.text, Budget(), a.token, budget))
    else:
        make_server(data, a.port, budget).serve_forever()


if __name__ == "__main__":
    main()
