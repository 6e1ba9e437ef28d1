"""What a query runs over: a store of triples, or tables seen as a graph."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.exprs import Val, kind_of
from graphloom.functions.terms import native, node_id, parts
from graphloom.plans.algebra import UNION_GRAPH, Const, Node, Quoted, Triple, Var, triple_vars

#: Tag of a hidden key column and whether it goes up.
Key = tuple[str, bool]


@dataclass(frozen=True)
class Rel:
    """Solutions: a column for each variable, hidden key columns that tell rows apart and order them.

    kinds: variable -> id (hash of a term), term, iri, value (native) or ref:TABLE (key of a row).
    certain: variables bound in every row.
    """

    df: DataFrame
    kinds: dict[str, str]
    certain: frozenset[str]
    keys: tuple[Key, ...] = ()

    @property
    def vars(self) -> list[str]:
        return list(self.kinds)


class Dataset(Protocol):
    spark: SparkSession
    as_terms: bool

    def units(self, triples: tuple[Triple, ...]) -> list[tuple[Triple, ...]]:
        """Parts of a pattern that one scan answers."""

    def cardinality(self, unit: tuple[Triple, ...], graph: Node | str | None) -> float:
        """Rows that a unit is expected to have; 0 if a constant is unknown."""

    def scan(self, unit: tuple[Triple, ...], graph: Node | str | None, keys: bool) -> Rel:
        """Solutions of a unit."""

    def links(self, predicate: str, graph: Node | str | None) -> Rel:
        """Pairs (a, b) that a predicate links."""

    def fingerprint(self) -> str:
        """Tells snapshots apart."""


def _named(df: DataFrame, columns: dict[str, Column], extra: dict[str, Column]) -> DataFrame:
    return df.select(*[c.alias(n) for n, c in columns.items()], *[c.alias(n) for n, c in extra.items()])


def snapshot(*frames: DataFrame) -> str:
    """Tells states of data apart: by plans and files' names, sizes and times of change where it is read from files, else by rows."""
    found: list[str] = []
    files: set[str] = set()
    listed = frames[0].sparkSession.read.format("binaryFile")

    def add(rows: DataFrame) -> None:
        every = [F.col(c) for c in rows.columns]
        found.append(str(tuple(rows.agg(F.count("*"), F.sum(F.xxhash64(*every).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit("second"), *every))).first())))

    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        leaves = plan.collectLeaves()
        if all(leaves.apply(k).getClass().getSimpleName() == "LogicalRelation" for k in range(leaves.size())) and (own := df.inputFiles()):
            found.append(plan.canonicalized().toString())
            files.update(own)
        else:
            add(df)
    if files:  # no content is read
        add(listed.load(sorted(files)).select("path", "length", "modificationTime"))
    return hashlib.sha256("|".join(found).encode()).hexdigest()[:16]


#: A quoted triple and its parts; how deep they may be nested.
QUOTED_TRIPLE = r"^<< (<[^<>]*>|_:\S+|<<.*>>) (<[^<>]*>) (.*) >>$"
QUOTE_DEPTH = 3


@dataclass
class TripleStore:
    """Triples and quads of term ids, and the terms. An id is its term's hash, so constants need no lookup.

    triples(s, p, o), quads(g, s, p, o): sets. nodes(id, term).
    """

    spark: SparkSession
    triples: DataFrame
    quads: DataFrame
    nodes: DataFrame
    name: str = "memory"
    as_terms: bool = field(default=True, init=False)

    @staticmethod
    def from_terms(spark: SparkSession, triples: DataFrame | None = None, quads: DataFrame | None = None, name: str = "memory") -> TripleStore:
        """From columns s, p, o (and g) of N-Triples terms. Repeated statements count once."""
        triples = spark.createDataFrame([], "s string, p string, o string") if triples is None else triples.select("s", "p", "o").distinct()
        quads = spark.createDataFrame([], "g string, s string, p string, o string") if quads is None else quads.select("g", "s", "p", "o").distinct()
        every = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).union(quads.select(F.explode(F.array("g", "s", "p", "o")).alias("term"))).distinct()
        inner = every
        for _ in range(QUOTE_DEPTH):  # the terms within quoted triples are terms too
            quoted = inner.where(F.startswith("term", F.lit("<<")))
            inner = quoted.select(F.explode(F.array(*[F.regexp_extract("term", QUOTED_TRIPLE, k) for k in (1, 2, 3)])).alias("term"))
            every = every.union(inner)
        every = every.distinct()
        ids = lambda df, cols: df.select(*[node_id(F.col(c)).alias(c) for c in cols])
        return TripleStore(spark, ids(triples, ["s", "p", "o"]), ids(quads, ["g", "s", "p", "o"]), every.select(node_id(F.col("term")).alias("id"), "term"), name)

    def save(self, path: str) -> None:
        """Bulk load into Parquet, parted by predicate so that a constant one prunes files, and sorted by subject within."""
        clash = self.nodes.groupBy("id").agg(F.count_distinct("term").alias("n")).where("n > 1").limit(1).collect()
        if clash:
            raise ValueError(f"two terms share the id {clash[0]['id']}")
        for table, name in ((self.triples, "triples"), (self.quads, "quads")):
            # A frequent predicate is spread over 16 files by subject.
            spread = table.repartition(F.col("p"), F.pmod(F.col("s"), F.lit(16))).sortWithinPartitions("p", "s")
            spread.write.mode("overwrite").partitionBy("p").parquet(f"{path}/{name}")
        self.nodes.repartition("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/nodes")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TripleStore:
        read = lambda name, schema: spark.read.schema(schema).parquet(f"{path}/{name}")
        return TripleStore(spark, read("triples", "s long, o long, p long").select("s", "p", "o"), read("quads", "g long, s long, o long, p long").select("g", "s", "p", "o"), read("nodes", "id long, term string"), path)

    def get_id(self, term: str) -> int:
        """Id of a term of the store; KeyError if it has none."""
        found = self.nodes.where(F.col("term") == term).limit(1).collect()
        if not found:
            raise KeyError(term)
        return found[0]["id"]

    def get_value(self, node: int) -> str:
        found = self.nodes.where(F.col("id") == node).limit(1).collect()
        if not found:
            raise KeyError(node)
        return found[0]["term"]

    def with_graphs(self, default: tuple[str, ...], named: tuple[str, ...]) -> TripleStore:
        """FROM and FROM NAMED."""
        pick = lambda terms: self.quads.where(F.col("g").isin(*[node_id(F.lit(t)) for t in terms]) if terms else F.lit(False))
        if not default and not named:
            return self
        return replace_store(self, pick(default).select("s", "p", "o").distinct(), pick(named))

    def union_default_graph(self) -> TripleStore:
        """The default graph becomes the union of the named ones."""
        return replace_store(self, self.quads.select("s", "p", "o").distinct(), self.quads)

    def filtered(self, condition: Column) -> TripleStore:
        """A view that holds only the triples and quads that satisfy a condition on their ids."""
        return replace_store(self, self.triples.where(condition), self.quads.where(condition))

    @cached_property
    def _hashes(self) -> dict[str, int]:
        return {}

    def _hash(self, term: str) -> int:
        """A term's id here on the driver, for looking up statistics."""
        if term not in self._hashes:
            self._hashes[term] = self.spark.range(1).select(node_id(F.lit(term))).first()[0]
        return self._hashes[term]

    def _source(self, graph: Node | str | None) -> DataFrame:
        if graph is None:
            return self.triples
        if graph == UNION_GRAPH:
            return self.quads.select("s", "p", "o").distinct()
        return self.quads

    def _quoted(self) -> DataFrame:
        """Ids of quoted triples and of their parts."""
        q = self.nodes.where(F.startswith("term", F.lit("<<")))
        return q.select(F.col("id").alias("_q"), *[node_id(F.regexp_extract("term", QUOTED_TRIPLE, k)).alias(n) for k, n in ((1, "_qs"), (2, "_qp"), (3, "_qo"))])

    def units(self, triples: tuple[Triple, ...]) -> list[tuple[Triple, ...]]:
        return [(t,) for t in triples]

    @cached_property
    def _counts(self) -> dict[int, int]:
        """Triples of the most frequent predicates; others have fewer than any of these."""
        both = self.triples.select("p").union(self.quads.select("p"))
        return {r["p"]: r["n"] for r in both.groupBy("p").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(10_000).collect()}

    def cardinality(self, unit: tuple[Triple, ...], graph: Node | str | None) -> float:
        t = unit[0]
        if isinstance(t.p, Const):
            n = float(self._counts.get(self._hash(t.p.term), 0 if len(self._counts) < 10_000 else min(self._counts.values())))
        else:
            n = float(sum(self._counts.values()))
        return n * 0.01 ** sum(isinstance(x, Const) for x in (t.s, t.o))

    def count(self, t: Triple, graph: Node | str | None = None) -> int:
        """Exact number of rows of a pattern."""
        return self.scan((t,), graph, False).df.count()

    def scan(self, unit: tuple[Triple, ...], graph: Node | str | None, keys: bool) -> Rel:
        (t,) = unit
        df = self._source(graph)
        places: list[tuple[str, object]] = [("s", t.s), ("p", t.p), ("o", t.o)]
        if isinstance(graph, (Var, Const)):
            places.insert(0, ("g", graph))
        columns: dict[str, Column] = {}
        pending = [(F.col(c), n) for c, n in places]  # grows by the parts of quoted patterns
        for k, (col, n) in enumerate(pending):
            if isinstance(n, Const):
                df = df.where(col == node_id(F.lit(n.term)))  # folded to a constant, and pushed down
            elif isinstance(n, Var):
                if n.name in columns:
                    df = df.where(col == columns[n.name])
                else:
                    columns[n.name] = col
            elif isinstance(n, Quoted):
                own = {c: f"{c}{k}" for c in ("_q", "_qs", "_qp", "_qo")}
                df = df.join(self._quoted().withColumnsRenamed(own), col == F.col(own["_q"]))
                pending += [(F.col(own["_qs"]), n.s), (F.col(own["_qp"]), n.p), (F.col(own["_qo"]), n.o)]
        key_cols = {f"_key_{c}": F.col(c) for c, _ in places} if keys else {}
        return Rel(_named(df, columns, key_cols), dict.fromkeys(columns, "id"), frozenset(columns), tuple((c, True) for c in key_cols))

    def links(self, predicate: str, graph: Node | str | None) -> Rel:
        df = self._source(graph)
        if isinstance(graph, Const):
            df = df.where(F.col("g") == node_id(F.lit(graph.term)))
        df = df.where(F.col("p") == node_id(F.lit(predicate))).select(F.col("s").alias("a"), F.col("o").alias("b"))
        return Rel(df, {"a": "id", "b": "id"}, frozenset("ab"))

    def links_except(self, predicates: list[str], graph: Node | str | None) -> Rel:
        df = self._source(graph).where(~F.col("p").isin(*[node_id(F.lit(p)) for p in predicates])).select(F.col("s").alias("a"), F.col("o").alias("b"))
        return Rel(df, {"a": "id", "b": "id"}, frozenset("ab"))

    def all_nodes(self, graph: Node | str | None) -> Rel:
        df = self._source(graph).select(F.explode(F.array("s", "o")).alias("a")).distinct()
        return Rel(df.select("a", F.col("a").alias("b")), {"a": "id", "b": "id"}, frozenset("ab"))

    def decode(self, rel: Rel, names: list[str]) -> Rel:
        """Terms instead of ids for these variables: one join for each, at the last moment."""
        df, kinds = rel.df, dict(rel.kinds)
        for v in names:
            if kinds.get(v) == "id":
                looked = self.nodes.select(F.col("id").alias("_id"), F.col("term").alias("_term"))
                df = df.join(looked, F.col(v) == F.col("_id"), "left").withColumn(v, F.col("_term")).drop("_id", "_term")
                kinds[v] = "term"
        return replace(rel, df=df, kinds=kinds)

    def value(self, rel: Rel, v: str) -> Val:
        return Val(F.col(v), "term" if rel.kinds[v] == "term" else rel.kinds[v])

    def constant(self, term: str) -> tuple[Column, str]:
        return F.lit(term), "term"

    @cached_property
    def _mark(self) -> str:
        return f"{self.name}|{snapshot(self.triples, self.quads)}"

    def fingerprint(self) -> str:
        """Name, and snapshot of triples and quads."""
        return self._mark


def replace_store(store: TripleStore, triples: DataFrame, quads: DataFrame) -> TripleStore:
    return TripleStore(store.spark, triples, quads, store.nodes, store.name)


BASE = "urn:t:"


@dataclass
class TableGraph:
    """Tables as a virtual graph.

    A row is a subject <urn:t:TABLE/KEY>; each column is a predicate
    <urn:t:COLUMN> with a literal object, unless null; a foreign key is a second
    predicate <urn:t:ref-COLUMN> to the other row. <urn:t:TABLE.COLUMN> says
    which table is meant where several have the column. Patterns with one subject
    become one scan, and values stay native.
    """

    spark: SparkSession
    tables: dict[str, DataFrame]
    keys: dict[str, list[str]]
    refs: dict[str, str]
    graphs: dict[str, Column] = field(default_factory=dict)
    name: str = "tables"
    sizes: dict[str, int] = field(default_factory=dict)  # row counts known so far, shared by copies
    places: dict[str, bool] = field(default_factory=dict)  # whether tables are in files, likewise
    marks: dict[tuple[str, ...], tuple[list[DataFrame], str]] = field(default_factory=dict)  # tables and their snapshot, likewise
    as_terms: bool = field(default=False, init=False)

    def with_graphs(self, default: tuple[str, ...], named: tuple[str, ...]) -> TableGraph:
        if not default and not named:
            return self
        names = lambda xs: [parts(x)[1].removeprefix(BASE) for x in xs]
        kept = {t: df.where(self.graphs[t].isin(names(named))) if named else df.where("false") for t, df in self.tables.items() if t in self.graphs}
        return replace(self, tables=kept)

    def _column(self, predicate: str) -> tuple[str | None, str, bool]:
        """(table or None, column, is a link) of a predicate."""
        local = parts(predicate)[1].removeprefix(BASE)
        table, _, column = local.rpartition(".")
        link = column.startswith("ref-")
        return table or None, column.removeprefix("ref-"), link

    def _ref(self, table: str, column: str) -> str | None:
        return self.refs.get(f"{table}.{column}") or self.refs.get(column)

    def _has(self, table: str, predicate: str) -> bool:
        own, column, link = self._column(predicate)
        return own in (None, table) and column in self.tables[table].columns and (not link or self._ref(table, column) is not None)

    def candidates(self, unit: tuple[Triple, ...]) -> list[str]:
        out = []
        for table in self.tables:
            if isinstance(unit[0].s, Const) and parts(unit[0].s.term)[1].removeprefix(BASE).partition("/")[0] != table:
                continue
            if all(not isinstance(t.p, Const) or self._has(table, t.p.term) for t in unit):
                out.append(table)
        return out

    def row_key(self, table: str) -> Column:
        """What stands for a row: its key, or a hash of all its columns where it has none."""
        key = self.keys.get(table)
        if not key:
            return F.md5(F.to_json(F.struct(*[F.col(c) for c in self.tables[table].columns]), {"ignoreNullFields": "false"}))
        return F.col(key[0]) if len(key) == 1 else F.concat_ws("/", *[F.col(c).cast("string") for c in key])

    def _in_files(self, table: str) -> bool:
        """Whether rows can be told apart by their place in Parquet files."""
        known = self.places
        if table not in known:
            df = self.tables[table]
            exposed = "_metadata" in df._jdf.queryExecution().analyzed().metadataOutput().mkString(",")
            known[table] = exposed and "row_index" in df.select("_metadata").schema[0].dataType.names
        return known[table]

    def _numbered(self, table: str) -> DataFrame:
        """The table; where it isn't Parquet, with a number ``_nth`` among rows that are equal."""
        df = self.tables[table]
        if self._in_files(table):
            return df
        every = [F.col(c) for c in df.columns]
        hashes = df.withColumns({"_h1": F.xxhash64(*every), "_h2": F.xxhash64(F.lit("second"), *every)})
        return hashes.withColumn("_nth", F.row_number().over(Window.partitionBy("_h1", "_h2").orderBy("_h1")))

    def _position(self, table: str) -> list[Column]:
        """Two columns that tell apart rows of _numbered() whatever they hold: file and row number, or hash and number among equals."""
        if self._in_files(table):
            return [F.col("_metadata.file_path"), F.col("_metadata.row_index")]
        return [F.concat_ws("/", "_h1", "_h2"), F.col("_nth")]

    def page_key(self, table: str) -> list[Column]:
        """Columns that order the rows of _numbered() and tell them apart: the key, if any, and the position, as a key may repeat or be null."""
        return [*[F.col(c) for c in self.keys.get(table) or []], *self._position(table)]

    def iri_of(self, table: str, key: Column) -> Column:
        return F.concat(F.lit(f"<{BASE}{table}/"), key.cast("string"), F.lit(">"))

    def units(self, triples: tuple[Triple, ...]) -> list[tuple[Triple, ...]]:
        stars: dict[object, list[Triple]] = {}
        for t in triples:
            stars.setdefault(t.s if isinstance(t.p, Const) else t, []).append(t)
        return [tuple(x) for x in stars.values()]

    def size(self, table: str) -> int:
        if table not in self.sizes:
            self.sizes[table] = self.tables[table].count()
        return self.sizes[table]

    def cardinality(self, unit: tuple[Triple, ...], graph: Node | str | None) -> float:
        if isinstance(unit[0].s, Const):
            return float(len(self.candidates(unit)))
        n = sum(self.size(t) for t in self.candidates(unit))
        return n * 0.1 ** sum(isinstance(t.o, Const) for t in unit)

    def scan(self, unit: tuple[Triple, ...], graph: Node | str | None, keys: bool) -> Rel:
        tables = [t for t in self.candidates(unit) if graph is None or t in self.graphs]
        names = sorted({v for t in unit for v in triple_vars(t)} | ({graph.name} if isinstance(graph, Var) else set()))
        if not tables:
            empty = self.spark.createDataFrame([], ", ".join(f"`{v}` string" for v in names) or "_none int")
            return Rel(empty if names else empty.drop("_none"), dict.fromkeys(names, "value"), frozenset(names))
        if any(isinstance(t.p, Var) for t in unit):
            return self._unpivot(unit[0], tables, graph, keys)
        parts_ = [self._scan_table(table, unit, graph, keys, len(tables) > 1) for table in tables]
        if len(parts_) == 1:
            return parts_[0]
        key_cols = [f"_key_{k}" for k in range(max(len(p.keys) for p in parts_))]
        frames = []
        for n, p in enumerate(parts_):
            extra = [F.lit(n).alias("_key_table"), *[(F.col(p.keys[k][0]) if k < len(p.keys) else F.lit(None)).cast("string").alias(c) for k, c in enumerate(key_cols)]] if keys else []
            frames.append(p.df.select(*p.vars, *extra))
        df = frames[0]
        for f in frames[1:]:
            df = df.unionByName(f)
        return Rel(df, parts_[0].kinds, parts_[0].certain, (("_key_table", True), *((c, True) for c in key_cols)) if keys else ())

    def _graph(self, df: DataFrame, table: str, graph: Node | str | None, columns: dict[str, Column]) -> DataFrame:
        if isinstance(graph, Const):
            return df.where(self.graphs[table] == parts(graph.term)[1].removeprefix(BASE))
        if isinstance(graph, Var):
            columns[graph.name] = self.graphs[table]
            return df.where(self.graphs[table].isNotNull())
        return df if graph is None else df.where(self.graphs[table].isNotNull())

    def _scan_table(self, table: str, unit: tuple[Triple, ...], graph: Node | str | None, keys: bool, several: bool) -> Rel:
        df = self._numbered(table) if keys else self.tables[table]
        columns: dict[str, Column] = {}
        kinds: dict[str, str] = {}
        s, own = unit[0].s, self.row_key(table)
        if isinstance(s, Const):
            key = parts(s.term)[1].removeprefix(BASE).partition("/")[2]
            df = df.where(own == F.lit(key).cast(df.select(own).schema[0].dataType))
        else:
            columns[s.name] = self.iri_of(table, own) if several else own
            kinds[s.name] = "iri" if several else f"ref:{table}"
        seen: set[str] = set()
        for t in unit:
            _, column, link = self._column(t.p.term)
            c = F.col(column)
            target = self._ref(table, column) if link else None
            if isinstance(t.o, Const):
                kind, lex, _, _ = parts(t.o.term)
                if link != (kind == "iri"):
                    df = df.where("false")
                elif link:
                    owner, _, key = lex.removeprefix(BASE).partition("/")
                    df = df.where(c.cast("string") == key) if owner == target and not key.isdigit() else df.where(c == int(key)) if owner == target else df.where("false")
                else:
                    value = native(t.o.term)
                    same = kind_of(df.schema[column].dataType) == ("bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num")
                    dated = kind_of(df.schema[column].dataType) == "time" and isinstance(value, str)
                    df = df.where(c == F.lit(value)) if same else df.where(c == F.lit(value).cast("timestamp_ntz")) if dated else df.where("false")
                continue
            if not isinstance(t.o, Var):
                raise ValueError("tables hold no quoted triples")
            if t.o.name in columns:
                other = kinds[t.o.name]
                df = df.where(c == columns[t.o.name]) if other == (f"ref:{target}" if link else "value") else df.where("false")
            else:
                columns[t.o.name], kinds[t.o.name] = c, f"ref:{target}" if link else "value"
            seen.add(column)
        for column in seen:
            df = df.where(F.col(column).isNotNull())
        df = self._graph(df, table, graph, columns)
        if isinstance(graph, Var):
            kinds[graph.name] = "value"
        key_cols = {f"_key_{k}": c for k, c in enumerate(self.page_key(table))} if keys else {}
        return Rel(_named(df, columns, key_cols), kinds, frozenset(columns), tuple((c, True) for c in key_cols))

    def _unpivot(self, t: Triple, tables: list[str], graph: Node | str | None, keys: bool) -> Rel:
        """A pattern with a variable predicate: every column of every row, objects in lexical form."""
        places = 2 if keys else 0  # subjects repeat where a key does
        frames = []
        for table in tables:
            df = self._numbered(table) if keys else self.tables[table]
            extra: dict[str, Column] = {}
            df = self._graph(df, table, graph, extra)
            cells = F.explode(F.array(*[F.struct(F.lit(f"<{BASE}{c}>").alias("p"), F.col(c).cast("string").alias("o")) for c in self.tables[table].columns if "<" not in df.schema[c].dataType.simpleString()]))
            at = [c.cast("string").alias(f"_at{k}") for k, c in enumerate([*self._position(table), F.lit(None), F.lit(None)][:places])]
            frames.append(df.select(self.iri_of(table, self.row_key(table)).alias("_s"), cells.alias("_c"), *[c.alias("_g") for c in extra.values()], *at).select("_s", F.col("_c.p").alias("_p"), F.col("_c.o").alias("_o"), *["_g" for _ in extra], *[f"_at{k}" for k in range(places)]))
        df = frames[0]
        for f in frames[1:]:
            df = df.union(f)
        df = df.where(F.col("_o").isNotNull())
        columns: dict[str, Column] = {}
        kinds: dict[str, str] = {}
        for c, n in (("_s", t.s), ("_p", t.p), ("_o", t.o), *((("_g", graph),) if isinstance(graph, Var) else ())):
            kind = "iri" if c in ("_s", "_p") else "value"
            if isinstance(n, Const):
                df = df.where(F.col(c) == (parts(n.term)[1] if c == "_o" else n.term))
            elif n.name in columns:
                df = df.where(F.col(c) == columns[n.name] if kinds[n.name] == kind else F.lit(False))
            else:
                columns[n.name], kinds[n.name] = F.col(c), kind
        key_cols = {f"_key{c}": F.col(c) for c in ("_s", "_p", "_o", *[f"_at{k}" for k in range(places)])} if keys else {}
        return Rel(_named(df, columns, key_cols), kinds, frozenset(columns), tuple((c, True) for c in key_cols))

    def links(self, predicate: str, graph: Node | str | None) -> Rel:
        rel = self.scan((Triple(Var("a"), Const(predicate), Var("b")),), graph, False)
        return rel

    def links_except(self, predicates: list[str], graph: Node | str | None) -> Rel:
        raise NotImplementedError("negated property sets need a triple store")

    def all_nodes(self, graph: Node | str | None) -> Rel:
        raise NotImplementedError("zero-length paths between unbound ends need a triple store")

    def decode(self, rel: Rel, names: list[str]) -> Rel:
        return rel

    def value(self, rel: Rel, v: str) -> Val:
        kind = rel.kinds[v]
        if kind.startswith("ref:"):
            return Val(self.iri_of(kind[4:], F.col(v)), "iri")
        return Val(F.col(v), kind if kind in ("iri", "term") else kind_of(rel.df.schema[v].dataType))

    def constant(self, term: str) -> tuple[Column, str]:
        kind, lex, _, _ = parts(term)
        if kind == "iri" and "/" in lex:
            table, _, key = lex.removeprefix(BASE).partition("/")
            if table in self.tables:
                return F.lit(int(key) if key.isdigit() else key), f"ref:{table}"
        return (F.lit(term), "iri") if kind == "iri" else (F.lit(native(term)), "value")

    def fingerprint(self) -> str:
        """Name, and snapshot of the tables."""
        tables = tuple(sorted(self.tables))
        frames = [self.tables[t] for t in tables]
        if tables not in self.marks or any(a is not b for a, b in zip(self.marks[tables][0], frames)):
            self.marks[tables] = frames, snapshot(*frames)
        return f"{self.name}|{self.marks[tables][1]}"
