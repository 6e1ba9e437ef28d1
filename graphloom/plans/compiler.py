"""Algebra to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from graphloom.functions.exprs import Val, as_term, compile_expr, null_, num, text, truth
from graphloom.functions.terms import node_id
from graphloom.operators.paths import path_pairs
from graphloom.plans.algebra import (
    BGP, Const, Distinct, Extend, Filter, Group, Join, LeftJoin, Minus, Op, OrderBy, Path, Project, Slice, Triple, Union, Values, triple_vars, visible,
)
from graphloom.plans.optimizer import greedy_order
from graphloom.sources.dataset import Dataset, Key, Rel

#: Compile functions of further operators: class -> function of (compiler, operator).
OPERATORS: dict[type, Callable[[Compiler, Op], Rel]] = {}


def _rename(rel: Rel, tag: str) -> DataFrame:
    """The frame with every column prefixed, so that a join never meets a name twice."""
    return rel.df.select(*[F.col(c).alias(tag + c) for c in rel.df.columns])


def sort_columns(keys: tuple[Key, ...]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in keys]


def expr_vars(e: object) -> set[str]:
    if isinstance(e, tuple):
        if len(e) == 2 and e[0] == "var":
            return {e[1]}
        if e and e[0] == "exists":
            return set(visible(e[1]))
        return set().union(*[expr_vars(x) for x in e]) if e else set()
    return set()


class Compiler:
    """keys: whether rows carry hidden columns that order them totally, as paging needs. optimize: whether patterns are reordered."""

    def __init__(self, data: Dataset, keys: bool = False, optimize: bool = True) -> None:
        self.data, self.keys, self.optimize = data, keys, optimize
        self._fresh = 0

    def _tag(self) -> str:
        self._fresh += 1
        return f"_{self._fresh}_"

    def compile(self, op: Op) -> Rel:
        if type(op) in OPERATORS:
            return OPERATORS[type(op)](self, op)
        match op:
            case BGP():
                return self.bgp(op)
            case Join(a, b):
                return self.join(self.compile(a), self.compile(b))
            case LeftJoin(a, b, e):
                return self.left_join(self.compile(a), self.compile(b), e)
            case Union(branches):
                return self.union([self.compile(b) for b in branches])
            case Minus(a, b):
                return self.minus(self.compile(a), self.compile(b))
            case Filter(e, child):
                return self.filter(e, self.compile(child))
            case Extend(v, e, child):
                return self.extend(v, e, self.compile(child))
            case Values():
                return self.values(op)
            case Group():
                return self.group(op)
            case Project(names, child):
                return self.project(names, self.compile(child))
            case Distinct(child):
                r = self.compile(child)
                df = r.df.select(*r.vars).distinct()
                return Rel(df, r.kinds, r.certain, tuple((v, True) for v in r.vars) if self.keys else ())
            case OrderBy(keys, child):
                return self.order_by(keys, self.compile(child))
            case Slice(offset, limit, child):
                return self.slice(offset, limit, child)
        raise ValueError(f"no such operator: {op!r}")

    # Patterns.

    def bgp(self, op: BGP) -> Rel:
        if not op.triples:
            key = [F.lit(0).alias("_key_unit")] if self.keys else []
            return Rel(self.data.spark.range(1).select(*key), {}, frozenset(), (("_key_unit", True),) if self.keys else ())
        plain = tuple(t for t in op.triples if not isinstance(t.p, Path))
        units: list[tuple[Triple, ...]] = self.data.units(plain) + [(t,) for t in op.triples if isinstance(t.p, Path)]
        variables = lambda u: set().union(*[triple_vars(t) for t in u])
        if self.optimize and len(units) > 1:
            cost = lambda u: float("inf") if isinstance(u[0].p, Path) else self.data.cardinality(u, op.graph)
            units = greedy_order(units, cost, variables)
        rels = [self.path(u[0], op.graph) if isinstance(u[0].p, Path) else self.data.scan(u, op.graph, self.keys) for u in units]
        return reduce(self.join, rels)

    def path(self, t: Triple, graph: object) -> Rel:
        pairs = path_pairs(t.p, graph, self.data)
        df, kinds = pairs.df, {}
        if self.keys:
            df = df.groupBy("a", "b").agg(F.count("*").alias("_n")).select("a", "b", F.explode(F.sequence(F.lit(1), "_n")).alias("_key_n")).select("a", "b", F.col("a").alias("_key_a"), F.col("b").alias("_key_b"), "_key_n")
        key = tuple((c, True) for c in ("_key_a", "_key_b", "_key_n")) if self.keys else ()
        columns: dict[str, Column] = {}
        for c, n in (("a", t.s), ("b", t.o)):
            if isinstance(n, Const):
                col, kind = self.data.constant(n.term)
                own = pairs.kinds[c]
                df = df.where(F.col(c) == (node_id(col) if own == "id" else col)) if own == "id" or own == kind else df.where("false")
            elif n.name in columns:
                df = df.where(F.col(c) == columns[n.name])
            else:
                columns[n.name], kinds[n.name] = F.col(c), pairs.kinds[c]
        return Rel(df.select(*[c.alias(n) for n, c in columns.items()], *[k for k, _ in key]), kinds, frozenset(columns), key)

    # Joins.

    def _same(self, l: Rel, r: Rel, v: str, lt: str, rt: str) -> Column | None:  # noqa: E741
        """Equality of a variable of both sides; None if its two kinds never are equal."""
        a, b = l.kinds[v], r.kinds[v]
        x, y = F.col(lt + v), F.col(rt + v)
        if a == b:
            if a == "value" and len(types := {l.df.schema[v].dataType, r.df.schema[v].dataType}) > 1 and StringType() in types:
                return x.cast("string") == y.cast("string")  # one side has lexical forms
            return x == y
        if "id" in (a, b):
            hashed = lambda c, k: c if k == "id" else node_id(as_term(Val(c, k)))
            return hashed(x, a) == hashed(y, b)
        if {a, b} <= {"iri", "term"}:
            return x == y
        for k, c, other, oc in ((a, x, b, y), (b, y, a, x)):
            if k.startswith("ref:") and other == "iri":
                return self.data.iri_of(k[4:], c) == oc
        return None

    def _condition(self, l: Rel, r: Rel, lt: str, rt: str, loose_l: frozenset[str], loose_r: frozenset[str]) -> Column:  # noqa: E741
        """Compatibility: shared variables are equal, or unbound where a side's loose ones may be."""
        out = F.lit(True)
        for v in [v for v in l.vars if v in r.kinds]:
            same = self._same(l, r, v, lt, rt)
            part = F.lit(False) if same is None else same
            if v in loose_l:
                part = part | F.col(lt + v).isNull()
            if v in loose_r:
                part = part | F.col(rt + v).isNull()
            out = out & part
        return out

    def _merged(self, l: Rel, r: Rel, lt: str, rt: str) -> tuple[dict[str, Column], dict[str, str]]:  # noqa: E741
        cols: dict[str, Column] = {}
        kinds: dict[str, str] = {}
        for v in l.vars:
            cols[v], kinds[v] = F.col(lt + v), l.kinds[v]
            if v in r.kinds and v not in l.certain:
                if l.kinds[v] == r.kinds[v]:
                    cols[v] = F.coalesce(F.col(lt + v), F.col(rt + v))
                elif "id" not in (l.kinds[v], r.kinds[v]):
                    raise ValueError(f"?{v} is a {l.kinds[v]} on one side and a {r.kinds[v]} on the other")
        for v in r.vars:
            if v not in cols:
                cols[v], kinds[v] = F.col(rt + v), r.kinds[v]
        return cols, kinds

    def _align(self, l: Rel, r: Rel) -> tuple[Rel, Rel]:  # noqa: E741
        """Ids become terms where the other side has terms and a side may be unbound."""
        mixed = [v for v in l.vars if v in r.kinds and {l.kinds[v], r.kinds[v]} in ({"id", "term"}, {"id", "iri"}) and v not in (l.certain & r.certain)]
        return (self.data.decode(l, mixed), self.data.decode(r, mixed)) if mixed else (l, r)

    def join(self, l: Rel, r: Rel) -> Rel:  # noqa: E741
        l, r = self._align(l, r)  # noqa: E741
        shared = [v for v in l.vars if v in r.kinds]
        loose_l, loose_r = frozenset(v for v in shared if v not in l.certain), frozenset(v for v in shared if v not in r.certain)
        lt, rt = self._tag(), self._tag()
        cols, kinds = self._merged(l, r, lt, rt)
        keys = tuple((lt + c, up) for c, up in l.keys) + tuple((rt + c, up) for c, up in r.keys)

        def one(a: DataFrame, b: DataFrame, x: frozenset[str], y: frozenset[str]) -> DataFrame:
            on = self._condition(l, r, lt, rt, x, y)
            df = a.join(b, on) if shared else a.crossJoin(b)
            return df.select(*[c.alias(v) for v, c in cols.items()], *[c for c, _ in keys])

        a, b = _rename(l, lt), _rename(r, rt)
        parts = self._split(a, loose_l, lt)
        frames = [one(x, y, lx, ly) for x, lx in parts for y, ly in self._split(b, loose_r, rt)]
        certain = l.certain | r.certain
        return Rel(reduce(DataFrame.unionByName, frames), kinds, certain, keys)

    def _split(self, df: DataFrame, loose: frozenset[str], tag: str) -> list[tuple[DataFrame, frozenset[str]]]:
        """Rows that bind all loose variables, which take the equi-join, and the rest."""
        if not loose:
            return [(df, frozenset())]
        bound = reduce(lambda a, b: a & b, [F.col(tag + v).isNotNull() for v in sorted(loose)])
        return [(df.where(bound), frozenset()), (df.where(~bound), loose)]

    def left_join(self, l: Rel, r: Rel, e: tuple | None) -> Rel:  # noqa: E741
        l, r = self._align(l, r)  # noqa: E741
        if e is not None:
            need = sorted(expr_vars(e))
            l, r = self.data.decode(l, need), self.data.decode(r, need)  # noqa: E741
        shared = [v for v in l.vars if v in r.kinds]
        loose_l, loose_r = frozenset(v for v in shared if v not in l.certain), frozenset(v for v in shared if v not in r.certain)
        lt, rt = self._tag(), self._tag()
        cols, kinds = self._merged(l, r, lt, rt)
        keys = tuple((lt + c, up) for c, up in l.keys) + tuple((rt + c, up) for c, up in r.keys)
        a, b = _rename(l, lt), _rename(r, rt)
        frames = []
        for x, lx in self._split(a, loose_l, lt):
            on = self._condition(l, r, lt, rt, lx, loose_r)
            if e is not None:
                on = on & F.coalesce(truth(compile_expr(e, self._env(l, r, lt, rt), self.data.as_terms)), F.lit(False))
            frames.append(x.join(b, on, "left").select(*[c.alias(v) for v, c in cols.items()], *[c for c, _ in keys]))
        return Rel(reduce(DataFrame.unionByName, frames), kinds, l.certain, keys)

    def _env(self, l: Rel, r: Rel, lt: str, rt: str) -> Callable[[str], Val]:  # noqa: E741
        """Values of the variables of a merged row, before the merge."""

        def value(rel: Rel, tag: str, v: str) -> Val:
            if rel.kinds[v].startswith("ref:"):
                return Val(self.data.iri_of(rel.kinds[v][4:], F.col(tag + v)), "iri")
            return Val(F.col(tag + v), self.data.value(rel, v).kind)

        def get(v: str) -> Val:
            if v in l.kinds:
                out = value(l, lt, v)
                return Val(F.coalesce(out.col, value(r, rt, v).col), out.kind) if v in r.kinds and v not in l.certain else out
            return value(r, rt, v) if v in r.kinds else null_()

        return get

    def minus(self, l: Rel, r: Rel) -> Rel:  # noqa: E741
        l, r = self._align(l, r)  # noqa: E741
        shared = [v for v in l.vars if v in r.kinds]
        if not shared:
            return l
        lt, rt = self._tag(), self._tag()
        loose_l, loose_r = frozenset(v for v in shared if v not in l.certain), frozenset(v for v in shared if v not in r.certain)
        on = self._condition(l, r, lt, rt, loose_l, loose_r)
        if loose_l or loose_r:  # something shared must be bound
            on = on & reduce(lambda a, b: a | b, [F.col(lt + v).isNotNull() & F.col(rt + v).isNotNull() for v in shared])
        b = _rename(r, rt).select(*[rt + v for v in shared]).distinct()
        return self._back(l, _rename(l, lt).join(b, on, "left_anti"), lt)

    def _back(self, rel: Rel, df: DataFrame, tag: str) -> Rel:
        return replace(rel, df=df.select(*[F.col(tag + c).alias(c) for c in rel.df.columns]))

    def union(self, rels: list[Rel]) -> Rel:
        names = list(dict.fromkeys(v for r in rels for v in r.vars))
        kinds: dict[str, str] = {}
        for v in names:
            found = {r.kinds[v] for r in rels if v in r.kinds}
            if len(found) > 1:
                if found <= {"id", "term", "iri"}:
                    rels = [self.data.decode(r, [v]) for r in rels]
                    kinds[v] = "term"
                elif any(k.startswith("ref:") for k in found) and all(k.startswith("ref:") or k == "iri" for k in found):
                    rels = [self._as_iri(r, v) for r in rels]
                    kinds[v] = "iri"
                else:
                    raise ValueError(f"?{v} is of several kinds in a union: {', '.join(sorted(found))}")
            else:
                kinds[v] = found.pop()
        width = max(len(r.keys) for r in rels)
        types = self._key_types(rels, width)
        frames = []
        for n, r in enumerate(rels):
            cols = [F.col(v) if v in r.kinds else F.lit(None).alias(v) for v in names]
            key = [F.lit(n).alias("_key_branch")] + [(F.col(r.keys[k][0]) if k < len(r.keys) else F.lit(None)).cast(types[k]).alias(f"_key_u{k}") for k in range(width)] if self.keys else []
            frames.append(r.df.select(*cols, *key))
        certain = frozenset.intersection(*[r.certain for r in rels])
        keys = (("_key_branch", True), *((f"_key_u{k}", True) for k in range(width))) if self.keys else ()
        if self.keys and any(not up for r in rels for _, up in r.keys):
            raise ValueError("an ordered subquery in a union can't be paged")
        return Rel(reduce(DataFrame.unionByName, frames), kinds, certain, keys)

    def _key_types(self, rels: list[Rel], width: int) -> list[str]:
        out = []
        for k in range(width):
            own = {r.df.schema[r.keys[k][0]].dataType.simpleString() for r in rels if k < len(r.keys)}
            out.append(own.pop() if len(own) == 1 else "bigint" if own <= {"int", "bigint"} else "string")
        return out

    def _as_iri(self, r: Rel, v: str) -> Rel:
        if v not in r.kinds or not r.kinds[v].startswith("ref:"):
            return r
        return replace(r, df=r.df.withColumn(v, self.data.iri_of(r.kinds[v][4:], F.col(v))), kinds={**r.kinds, v: "iri"})

    # Rows.

    def _values_env(self, rel: Rel) -> Callable[[str], Val]:
        return lambda v: self.data.value(rel, v) if v in rel.kinds else null_()

    def _expr(self, e: tuple, rel: Rel) -> Val:
        return compile_expr(e, self._values_env(rel), self.data.as_terms)

    def filter(self, e: tuple, rel: Rel) -> Rel:
        if e[0] == "&&":
            return self.filter(e[2], self.filter(e[1], rel))
        negated = e[0] == "!" and e[1][0] == "exists"
        if e[0] == "exists" or negated:
            return self.exists(rel, e[1][1] if negated else e[1], negated)
        need = [v for v in sorted(expr_vars(e)) if v in rel.kinds]
        bound_only = e[0] == "call" and e[1] == "BOUND" or e[0] == "!" and e[1][0] == "call" and e[1][1] == "BOUND"
        if not bound_only:
            rel = self.data.decode(rel, need)
        cond = truth(self._expr(e, rel))
        return replace(rel, df=rel.df.where(cond))

    def exists(self, rel: Rel, pattern: Op, negated: bool) -> Rel:
        conds = []
        while isinstance(pattern, Filter):  # its filters may speak of the outer row
            conds.append(pattern.expr)
            pattern = pattern.child
        inner = Compiler(self.data, False, self.optimize).compile(pattern)
        rel, inner = self._align(rel, inner)
        for e in conds:
            need = sorted(expr_vars(e))
            rel, inner = self.data.decode(rel, need), self.data.decode(inner, need)
        lt, rt = self._tag(), self._tag()
        shared = [v for v in rel.vars if v in inner.kinds]
        on = self._condition(rel, inner, lt, rt, frozenset(v for v in shared if v not in rel.certain), frozenset(v for v in shared if v not in inner.certain))
        for e in conds:
            on = on & F.coalesce(truth(compile_expr(e, self._env(rel, inner, lt, rt), self.data.as_terms)), F.lit(False))
        used = [*shared, *sorted({v for e in conds for v in expr_vars(e)} & set(inner.vars) - set(shared))]
        b = _rename(inner, rt).select(*[rt + v for v in used]).distinct() if used else _rename(inner, rt).limit(1)
        return self._back(rel, _rename(rel, lt).join(b, on, "left_anti" if negated else "left_semi"), lt)

    def extend(self, v: str, e: tuple, rel: Rel) -> Rel:
        if e[0] == "var":
            if e[1] not in rel.kinds:
                return replace(rel, df=rel.df.withColumn(v, F.lit(None).cast("string")), kinds={**rel.kinds, v: "term" if self.data.as_terms else "value"})
            certain = rel.certain | ({v} if e[1] in rel.certain else set())
            return replace(rel, df=rel.df.withColumn(v, F.col(e[1])), kinds={**rel.kinds, v: rel.kinds[e[1]]}, certain=frozenset(certain))
        rel = self.data.decode(rel, [x for x in sorted(expr_vars(e)) if x in rel.kinds])
        out = self._expr(e, rel)
        if self.data.as_terms:
            return replace(rel, df=rel.df.withColumn(v, as_term(out)), kinds={**rel.kinds, v: "term"})
        return replace(rel, df=rel.df.withColumn(v, out.col), kinds={**rel.kinds, v: out.kind if out.kind in ("iri", "term") else "value"})

    def values(self, op: Values) -> Rel:
        frames, kinds, certain = [], {}, set(op.vars)
        for k, v in enumerate(op.vars):
            found = {self.data.constant(row[k])[1] for row in op.rows if row[k] is not None}
            if len(found) > 1:
                raise ValueError(f"VALUES mixes kinds for ?{v}: {', '.join(sorted(found))}")
            kinds[v] = found.pop() if found else "term" if self.data.as_terms else "value"
            if any(row[k] is None for row in op.rows):
                certain.discard(v)
        for n, row in enumerate(op.rows):
            cols = [(F.lit(None) if x is None else self.data.constant(x)[0]).alias(v) for v, x in zip(op.vars, row)]
            frames.append(F.struct(*cols, F.lit(n).alias("_key_row")))
        if not frames:
            empty = self.data.spark.createDataFrame([], ", ".join([*(f"`{v}` string" for v in op.vars), "_key_row int"]))
            return Rel(empty, kinds, frozenset(op.vars), (("_key_row", True),) if self.keys else ())
        df = self.data.spark.range(1).select(F.explode(F.array(*frames)).alias("r")).select("r.*")
        if not self.keys:
            df = df.drop("_key_row")
        return Rel(df, kinds, frozenset(certain), (("_key_row", True),) if self.keys else ())

    # Aggregates.

    def group(self, op: Group) -> Rel:
        # A group's key is its own: the rows' keys end here.
        rel = Compiler(self.data, False, self.optimize).compile(op.child)
        plain = {k for k, e in op.keys if e == ("var", k)}
        for k, e in op.keys:
            if k not in plain:
                rel = self.extend(k, e, rel)
        needed = {v for _, f, arg, distinct, _ in op.aggregates if arg is not None and not (f == "COUNT" and arg[0] == "var") for v in expr_vars(arg)}
        rel = self.data.decode(rel, [v for v in sorted(needed) if v in rel.kinds])
        aggs, kinds = [], {}
        for name, f, arg, distinct, separator in op.aggregates:
            col, kind = self._aggregate(rel, f, arg, distinct, separator)
            if self.data.as_terms and kind != "term":
                col, kind = as_term(Val(col, kind)), "term"
            aggs.append(col.alias(name))
            kinds[name] = "term" if self.data.as_terms else "value" if kind != "iri" else "iri"
        names = [k for k, _ in op.keys]
        df = rel.df.groupBy(*[F.col(k) if k in rel.kinds else F.lit(None).cast("string").alias(k) for k in names]).agg(*aggs) if aggs else rel.df.select(*names).distinct()
        key_kinds = {k: rel.kinds.get(k, "term" if self.data.as_terms else "value") for k in names}
        keys = (tuple((k, True) for k in names) or ((op.aggregates[0][0], True),)) if self.keys else ()
        counted = {a[0] for a in op.aggregates if a[1] == "COUNT"}
        return Rel(df, {**key_kinds, **kinds}, frozenset({k for k in names if k in rel.certain} | counted), keys)

    def _aggregate(self, rel: Rel, f: str, arg: tuple | None, distinct: bool, separator: str) -> tuple[Column, str]:
        if arg is None:
            return (F.count_distinct(F.struct(*rel.vars)) if distinct and rel.vars else F.count(F.lit(1))), "num"
        if f == "COUNT" and arg[0] == "var" and arg[1] in rel.kinds:
            return (F.count_distinct(arg[1]) if distinct else F.count(arg[1])), "num"
        v = self._expr(arg, rel)
        pick = F.collect_set if distinct else F.collect_list
        match f:
            case "COUNT":
                return (F.count_distinct(v.col) if distinct else F.count(v.col)), "num"
            case "SUM" | "AVG":
                x = num(v)
                total = (F.sum_distinct(x) if distinct else F.sum(x)) if f == "SUM" else F.avg(x) if not distinct else F.sum_distinct(x) / F.count_distinct(x)
                # A value that isn't a number voids the result; an empty group gives 0.
                return F.when(F.coalesce(F.bool_or(x.isNull()), F.lit(False)), F.lit(None)).otherwise(F.coalesce(total, F.lit(0))), "num"
            case "MIN" | "MAX":
                best = F.min if f == "MIN" else F.max
                if v.kind == "term":  # by value where there are numbers, else as written
                    by = F.min_by if f == "MIN" else F.max_by
                    return by(v.col, F.struct(num(v).isNotNull(), num(v), v.col)), "term"
                return best(v.col), v.kind
            case "SAMPLE":
                return F.any_value(v.col, F.lit(True)), v.kind
            case "GROUP_CONCAT":
                return F.array_join(F.array_sort(pick(text(v))), separator), "str"
        raise ValueError(f)

    # Shape.

    def project(self, names: tuple[str, ...], rel: Rel) -> Rel:
        cols = [F.col(v) if v in rel.kinds else F.lit(None).cast("string").alias(v) for v in names]
        extra = [c for c, _ in rel.keys if c not in names]
        kinds = {v: rel.kinds.get(v, "term" if self.data.as_terms else "value") for v in names}
        # A group's key that isn't projected goes on hidden.
        hidden = [F.col(c) if c.startswith("_") else F.col(c).alias(f"_hid_{c.replace('?', '')}") for c in extra]
        keys = tuple((c if c in names or c.startswith("_") else f"_hid_{c.replace('?', '')}", up) for c, up in rel.keys)
        return Rel(rel.df.select(*cols, *hidden), kinds, rel.certain & set(names), keys)

    def order_by(self, conds: tuple[tuple[tuple, bool], ...], rel: Rel) -> Rel:
        rel = self.data.decode(rel, [v for e, _ in conds for v in sorted(expr_vars(e)) if v in rel.kinds])
        df, keys = rel.df, []
        at = 0
        for e, up in conds:
            v = self._expr(e, rel)
            if v.kind == "term":
                # Unbound, blank nodes, IRIs, then literals; numbers by value.
                rank = F.when(v.col.startswith("_:"), 1).when(v.col.startswith("<"), 2).when(v.col.isNotNull(), 3)
                parts = [rank, num(v), v.col]
            elif e[0] == "var" and rel.kinds.get(e[1], "").startswith("ref:"):
                parts = [F.col(e[1])]
            else:
                parts = [v.col]
            for p in parts:
                df = df.withColumn(f"_sort{at}", p)
                keys.append((f"_sort{at}", up))
                at += 1
        total = tuple(keys) + rel.keys
        return replace(rel, df=df.orderBy(*sort_columns(total)), keys=total)

    def slice(self, offset: int, limit: int | None, child: Op) -> Rel:
        # Rows of an unordered child are cut in their key order, so that every call cuts the same.
        rel = Compiler(self.data, True, self.optimize).compile(child)
        df = rel.df.orderBy(*sort_columns(rel.keys)) if rel.keys else rel.df
        if offset:
            df = df.offset(offset)
        return replace(rel, df=df.limit(limit) if limit is not None else df)


def compile_select(op: Op, data: Dataset, keys: bool = False, optimize: bool = True, decode: bool = True) -> Rel:
    """Solutions of an operator, with terms for ids."""
    rel = Compiler(data, keys, optimize).compile(op)
    return data.decode(rel, rel.vars) if decode else rel
