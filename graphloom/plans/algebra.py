"""Query algebra: immutable nodes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    """A term in N-Triples form."""

    term: str


@dataclass(frozen=True)
class Quoted:
    """A triple as a term, possibly with variables inside."""

    s: Node
    p: Node
    o: Node


@dataclass(frozen=True)
class Path:
    """op: seq, alt, inv, not, opt, plus, star (args are paths), or link (args is one predicate)."""

    op: str
    args: tuple


Node = Var | Const | Quoted


@dataclass(frozen=True)
class Triple:
    s: Node
    p: Node | Path
    o: Node


#: Graph of a pattern: None is the default graph, UNION_GRAPH all named graphs as one.
UNION_GRAPH = "union"


@dataclass(frozen=True)
class BGP:
    triples: tuple[Triple, ...]
    graph: Node | str | None = None


@dataclass(frozen=True)
class Join:
    left: Op
    right: Op


@dataclass(frozen=True)
class LeftJoin:
    left: Op
    right: Op
    expr: tuple | None = None


@dataclass(frozen=True)
class Union:
    branches: tuple[Op, ...]


@dataclass(frozen=True)
class Minus:
    left: Op
    right: Op


@dataclass(frozen=True)
class Filter:
    expr: tuple
    child: Op


@dataclass(frozen=True)
class Extend:
    var: str
    expr: tuple
    child: Op


@dataclass(frozen=True)
class Values:
    vars: tuple[str, ...]
    rows: tuple[tuple[str | None, ...], ...]


@dataclass(frozen=True)
class Group:
    """keys: (name, expr); aggregates: (name, function, argument or None, distinct, separator)."""

    keys: tuple[tuple[str, tuple], ...]
    aggregates: tuple[tuple[str, str, tuple | None, bool, str], ...]
    child: Op


@dataclass(frozen=True)
class Project:
    vars: tuple[str, ...]
    child: Op


@dataclass(frozen=True)
class Distinct:
    child: Op


@dataclass(frozen=True)
class OrderBy:
    """keys: (expr, ascending)."""

    keys: tuple[tuple[tuple, bool], ...]
    child: Op


@dataclass(frozen=True)
class Slice:
    offset: int
    limit: int | None
    child: Op


Op = BGP | Join | LeftJoin | Union | Minus | Filter | Extend | Values | Group | Project | Distinct | OrderBy | Slice

UNIT = BGP(())


@dataclass(frozen=True)
class Query:
    """form: select, ask, construct or describe."""

    form: str
    op: Op
    template: tuple[Triple, ...] = ()
    targets: tuple[Node, ...] = ()
    default_graphs: tuple[str, ...] = ()
    named_graphs: tuple[str, ...] = ()


def node_vars(n: object) -> set[str]:
    if isinstance(n, Var):
        return {n.name}
    if isinstance(n, Quoted):
        return node_vars(n.s) | node_vars(n.p) | node_vars(n.o)
    return set()


def triple_vars(t: Triple) -> set[str]:
    return node_vars(t.s) | node_vars(t.p) | node_vars(t.o)


def visible(op: Op) -> list[str]:
    """Variables that an operator's solutions may bind, in order of appearance."""
    out: dict[str, None] = {}

    def add(names: object) -> None:
        for n in names:
            if not n.startswith("?"):  # blank nodes of a query
                out[n] = None

    match op:
        case BGP(triples, graph):
            for t in triples:
                for n in (t.s, t.p, t.o):
                    add(sorted(node_vars(n)))
            add(node_vars(graph))
        case Join(a, b) | LeftJoin(a, b):
            add(visible(a))
            add(visible(b))
        case Union(branches):
            for b in branches:
                add(visible(b))
        case Minus(a, _):
            add(visible(a))
        case Extend(var, _, child):
            add(visible(child))
            add([var])
        case Values(names, _):
            add(names)
        case Group(keys, aggregates, _):
            add([k for k, _ in keys])
            add([a[0] for a in aggregates])
        case Project(names, _):
            add(names)
        case Filter(_, child) | Distinct(child) | OrderBy(_, child) | Slice(_, _, child):
            add(visible(child))
    return list(out)
