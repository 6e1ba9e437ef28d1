"""Running queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.exprs import as_term
from graphloom.plans.algebra import Const, Node, Query, Triple, Var
from graphloom.plans.compiler import compile_select
from graphloom.plans.parser import parse
from graphloom.sources.dataset import Dataset, Rel


def solutions(data: Dataset, query: str | Query, prefixes: dict[str, str] | None = None, optimize: bool = True) -> Rel:
    q = parse(query, prefixes) if isinstance(query, str) else query
    return compile_select(q.op, data.with_graphs(q.default_graphs, q.named_graphs), optimize=optimize)


def select(data: Dataset, query: str | Query, prefixes: dict[str, str] | None = None, optimize: bool = True) -> DataFrame:
    """Solutions of a SELECT query: a column for each variable, null where unbound."""
    rel = solutions(data, query, prefixes, optimize)
    return rel.df.select(*[F.col(v) for v in rel.vars])


def ask(data: Dataset, query: str | Query, prefixes: dict[str, str] | None = None) -> bool:
    """Whether a query has a solution."""
    q = parse(query, prefixes) if isinstance(query, str) else query
    return not compile_select(q.op, data.with_graphs(q.default_graphs, q.named_graphs), decode=False).df.isEmpty()


def construct(data: Dataset, query: str | Query, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Distinct triples (s, p, o) that a CONSTRUCT query's template makes; with unbound parts none."""
    q = parse(query, prefixes) if isinstance(query, str) else query
    rel = compile_select(q.op, data.with_graphs(q.default_graphs, q.named_graphs))

    def part(n: Node) -> object:
        if isinstance(n, Const):
            return F.lit(n.term)
        assert isinstance(n, Var)
        if n.name.startswith("?"):  # a blank node of the template, one for each solution
            return F.concat(F.lit("_:"), F.md5(F.to_json(F.struct(F.lit(n.name).alias("_n"), *rel.vars))))
        return as_term(data.value(rel, n.name))

    def one(t: Triple) -> DataFrame:
        return rel.df.select(part(t.s).alias("s"), part(t.p).alias("p"), part(t.o).alias("o"))

    out = one(q.template[0])
    for t in q.template[1:]:
        out = out.unionByName(one(t))
    return out.dropna().distinct()


def describe(data: Dataset, query: str | Query, prefixes: dict[str, str] | None = None) -> DataFrame:
    """Triples (s, p, o) with a target as subject or object."""
    q = parse(query, prefixes) if isinstance(query, str) else query
    rel = compile_select(q.op, data, decode=False)
    wanted = [data.spark.range(1).select(F.xxhash64(F.lit(t.term)).alias("id")) for t in q.targets if isinstance(t, Const)]
    wanted += [rel.df.select(F.col(t.name).alias("id")) for t in q.targets if isinstance(t, Var)]
    ids = wanted[0]
    for w in wanted[1:]:
        ids = ids.union(w)
    ids = ids.distinct()
    hit = data.triples.join(ids, F.col("s") == F.col("id"), "left_semi").union(data.triples.join(ids, F.col("o") == F.col("id"), "left_semi")).distinct()
    found = Rel(hit, {"s": "id", "p": "id", "o": "id"}, frozenset("spo"))
    return data.decode(found, ["s", "p", "o"]).df.select("s", "p", "o")
