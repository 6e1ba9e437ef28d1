"""Property paths as tables of pairs (a, b)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.lineage import cut
from graphloom.plans.algebra import Node, Path
from graphloom.sources.dataset import Dataset, Rel


def closure(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) with a path of at least one edge from a to b: semi-naive, each round extends the newest pairs only."""
    step = cut(edges.select("a", "b").distinct())
    known, new = step, step
    while not new.isEmpty():
        longer = new.join(step.select(F.col("a").alias("_m"), F.col("b").alias("_to")), F.col("b") == F.col("_m")).select("a", F.col("_to").alias("b")).distinct()
        new = cut(longer.join(known, ["a", "b"], "left_anti"))
        known = cut(known.union(new))
    return known


def _swap(r: Rel) -> Rel:
    return replace(r, df=r.df.select(F.col("b").alias("a"), F.col("a").alias("b")), kinds={"a": r.kinds["b"], "b": r.kinds["a"]})


def path_pairs(path: Path | Node, graph: Node | str | None, data: Dataset) -> Rel:
    """Pairs that a path links. Sequences, alternatives and inverses keep duplicates; ?, + and * don't, as the language has it."""
    if not isinstance(path, Path):
        return data.links(path.term, graph)
    match path.op:
        case "link":
            return data.links(path.args[0].term, graph)
        case "inv":
            return _swap(path_pairs(path.args[0], graph, data))
        case "seq":
            out = path_pairs(path.args[0], graph, data)
            for p in path.args[1:]:
                nxt = path_pairs(p, graph, data)
                if out.kinds["b"] != nxt.kinds["a"]:
                    return replace(out, df=out.df.where("false"), kinds={"a": out.kinds["a"], "b": nxt.kinds["b"]})
                right = nxt.df.select(F.col("a").alias("_m"), F.col("b").alias("_to"))
                df = out.df.join(right, F.col("b") == F.col("_m")).select("a", F.col("_to").alias("b"))
                out = Rel(df, {"a": out.kinds["a"], "b": nxt.kinds["b"]}, out.certain)
            return out
        case "alt":
            branches = [path_pairs(p, graph, data) for p in path.args]
            df = branches[0].df.select("a", "b")
            for b in branches[1:]:
                if b.kinds != branches[0].kinds:
                    raise ValueError("the branches of a path end in different kinds of things")
                df = df.union(b.df.select("a", "b"))
            return replace(branches[0], df=df)
        case "not":
            there = [p.args[0].term for p in path.args if p.op == "link"]
            back = [p.args[0].args[0].term for p in path.args if p.op == "inv"]
            found = [data.links_except(there, graph)] if there else []
            found += [_swap(data.links_except(back, graph))] if back else []
            return found[0] if len(found) == 1 else replace(found[0], df=found[0].df.union(found[1].df))
        case "opt" | "plus" | "star":
            inner = path_pairs(path.args[0], graph, data)
            if inner.kinds["a"] != inner.kinds["b"]:
                df = inner.df.select("a", "b").distinct()  # nothing to repeat
            else:
                df = inner.df.select("a", "b").distinct() if path.op == "opt" else closure(inner.df)
            if path.op == "plus":
                return replace(inner, df=df)
            same = data.all_nodes(graph)
            return Rel(df.union(same.df).distinct(), inner.kinds, inner.certain)
    raise ValueError(path.op)
