"""The query catalogue: one query for each operator, with the same question in SQL where SQL can ask it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import engine
from graphloom.operators import sampling
from graphloom.plans.compiler import compile_select
from graphloom.plans.optimizer import graph_per_pattern, union_default_graph
from graphloom.plans.parser import parse
from graphloom.sources.dataset import TableGraph, TripleStore
from graphloom.sources.results import bindings
from graphloom.sources.tables import PREFIXES, table_graph
from graphloom.streaming.paging import Budget, joined, progress, run_page

Run = Callable[[SparkSession, str], DataFrame]

#: name -> (query over the tables, SQL).
SELECTS: dict[str, tuple[str, str]] = {
    # Scans.
    "bgp_single": ("SELECT ?o ?c { ?o :o_custkey ?c }", "SELECT o_orderkey AS o, o_custkey AS c FROM orders"),
    "bgp_const_object": ('SELECT ?c { ?c :c_mktsegment "BUILDING" }', "SELECT c_custkey AS c FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "bgp_bound_subject": ("SELECT ?t { <urn:t:orders/7> :o_totalprice ?t }", "SELECT o_totalprice AS t FROM orders WHERE o_orderkey = 7"),
    "triple_exists": ('SELECT ?n { <urn:t:region/1> :r_regionkey 1 . ?n :n_regionkey 1 }', "SELECT n_nationkey AS n FROM nation WHERE n_regionkey = 1 AND EXISTS (SELECT 1 FROM region WHERE r_regionkey = 1)"),
    "unknown_term": ('SELECT ?n { ?n :n_name "ATLANTIS" }', "SELECT n_nationkey AS n FROM nation WHERE n_name = 'ATLANTIS'"),
    "bgp_star": ("SELECT ?o ?s ?d ?p ?t { ?o :o_orderstatus ?s ; :o_orderdate ?d ; :o_orderpriority ?p ; :o_totalprice ?t }", "SELECT o_orderkey AS o, o_orderstatus AS s, o_orderdate AS d, o_orderpriority AS p, o_totalprice AS t FROM orders"),
    "bgp_chain": (
        "SELECT ?o ?cn ?nn ?rn { ?o :ref-o_custkey ?c . ?c :c_name ?cn ; :ref-c_nationkey ?n . ?n :n_name ?nn ; :ref-n_regionkey ?r . ?r :r_name ?rn }",
        "SELECT o_orderkey AS o, c_name AS cn, n_name AS nn, r_name AS rn FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    ),
    "bgp_cartesian": ("SELECT ?x ?y { ?a :r_name ?x . ?b :r_name ?y }", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    "bgp_repeated_var": ("SELECT ?v ?q { ?l :l_suppkey ?v ; :l_linenumber ?v ; :l_quantity ?q }", "SELECT l_suppkey AS v, l_quantity AS q FROM lineitem WHERE l_suppkey = l_linenumber"),
    # Filters.
    "filter_range": ("SELECT ?o ?t { ?o :o_totalprice ?t FILTER(?t > 100000 && ?t <= 200000.5) }", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders WHERE o_totalprice > 100000 AND o_totalprice <= 200000.5"),
    "filter_string": ('SELECT ?p ?n { ?p :p_name ?n FILTER(CONTAINS(?n, "a") && STRSTARTS(STR(?n), "p")) }', "SELECT p_partkey AS p, p_name AS n FROM part WHERE contains(p_name, 'a') AND starts_with(p_name, 'p')"),
    "filter_logic": ('SELECT ?o { ?o :o_orderstatus ?s ; :o_orderpriority ?p FILTER((?s = "F" || ?s = "P") && !(?p = "1-URGENT")) }', "SELECT o_orderkey AS o FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT'"),
    "filter_in": ("SELECT ?n { ?n :n_regionkey ?r FILTER(?r IN (1, 3)) }", "SELECT n_nationkey AS n FROM nation WHERE n_regionkey IN (1, 3)"),
    "filter_regex": ('SELECT ?c ?n { ?c :c_name ?n FILTER(REGEX(?n, "1[0-9]*$")) }', "SELECT c_custkey AS c, c_name AS n FROM customer WHERE regexp_matches(c_name, '1[0-9]*$')"),
    "filter_date": ('SELECT ?o { ?o :o_orderdate ?d FILTER(?d >= "1997-01-01T00:00:00"^^xsd:dateTime) }', "SELECT o_orderkey AS o FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'"),
    # Joins.
    "join_groups": ("SELECT ?c ?n ?o { { ?c :c_name ?n } { ?o :ref-o_custkey ?c } }", "SELECT c_custkey AS c, c_name AS n, o_orderkey AS o FROM customer JOIN orders ON o_custkey = c_custkey"),
    "optional_simple": ("SELECT ?o ?q { ?o :o_custkey ?c OPTIONAL { ?l :ref-l_orderkey ?o ; :l_quantity ?q } }", "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey"),
    "optional_filter_on": ("SELECT ?o ?q { ?o :o_totalprice ?t OPTIONAL { ?l :ref-l_orderkey ?o ; :l_quantity ?q FILTER(?q > 40 && ?t > 1000) } }", "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 AND o_totalprice > 1000"),
    "optional_nested": (
        "SELECT ?c ?o ?q { ?c :c_name ?n OPTIONAL { ?o :ref-o_custkey ?c OPTIONAL { ?l :ref-l_orderkey ?o ; :l_quantity ?q } } }",
        "SELECT c_custkey AS c, o_orderkey AS o, l_quantity AS q FROM customer LEFT JOIN (orders LEFT JOIN lineitem ON l_orderkey = o_orderkey) ON o_custkey = c_custkey",
    ),
    "optional_two": (
        "SELECT ?d ?q ?t { ?d :documents.lang ?l OPTIONAL { ?x :ref-labels.doc_id ?d } OPTIONAL { ?y :labels.ref-doc_id ?d ; :quality ?q ; :toxic ?t } }",
        "SELECT d.doc_id AS d, quality AS q, toxic AS t FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "optional_shared_unbound": (
        "SELECT ?d ?q ?k ?r { ?d :documents.n_chars ?z FILTER(?z < 300) OPTIONAL { ?y :labels.ref-doc_id ?d ; :quality ?q } OPTIONAL { ?k :r_regionkey ?q ; :r_name ?r } }",
        "WITH x AS (SELECT d.doc_id AS d, quality AS q FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE n_chars < 300) SELECT d, coalesce(q, r_regionkey) AS q, r_regionkey AS k, r_name AS r FROM x LEFT JOIN region ON x.q = r_regionkey OR x.q IS NULL",
    ),
    "union_two": ('SELECT ?c ?s { { ?c :c_mktsegment "BUILDING" } UNION { ?s :s_name ?n } }', "SELECT c_custkey AS c, NULL::BIGINT AS s FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT NULL, s_suppkey FROM supplier"),
    "union_nested": ("SELECT ?x { { ?r :r_name ?x } UNION { { ?n :n_name ?x } UNION { ?s :s_name ?x } } }", "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier"),
    "union_in_join": ("SELECT ?n ?name { ?n :n_name ?name { ?c :ref-c_nationkey ?n ; :c_acctbal ?b FILTER(?b > 9000) } UNION { ?s :ref-s_nationkey ?n } }", "SELECT n_nationkey AS n, n_name AS name FROM nation JOIN (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 UNION ALL SELECT s_nationkey FROM supplier) ON k = n_nationkey"),
    # Order and cuts.
    "slice_limit": ("SELECT ?o ?t { ?o :o_totalprice ?t } ORDER BY DESC(?t) ?o LIMIT 10", "SELECT o_orderkey AS o, o_totalprice AS t FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10"),
    "slice_offset": ("SELECT ?o { ?o :o_custkey ?c } ORDER BY ?o LIMIT 7 OFFSET 20", "SELECT o_orderkey AS o FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 20"),
    "order_topk": ("SELECT ?p ?v { ?p :p_retailprice ?v } ORDER BY DESC(?v) DESC(?p) LIMIT 25", "SELECT p_partkey AS p, p_retailprice AS v FROM part ORDER BY p_retailprice DESC, p_partkey DESC LIMIT 25"),
    "distinct": ("SELECT DISTINCT ?s ?p { ?o :o_orderstatus ?s ; :o_orderpriority ?p }", "SELECT DISTINCT o_orderstatus AS s, o_orderpriority AS p FROM orders"),
    "reduced": ("SELECT REDUCED ?l { ?d :documents.lang ?l }", "SELECT DISTINCT lang AS l FROM documents"),
    # Named graphs.
    "graph_named": ("SELECT ?d ?l { GRAPH :src1 { ?d :documents.lang ?l } }", "SELECT doc_id AS d, lang AS l FROM documents WHERE source = 'src1'"),
    "graph_var": ("SELECT ?g ?o ?s { GRAPH ?g { ?o :o_orderstatus ?s } }", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS g, o_orderkey AS o, o_orderstatus AS s FROM orders"),
    "graph_from_named": ("SELECT ?g ?d FROM NAMED :src1 FROM NAMED :src2 { GRAPH ?g { ?d :documents.lang \"en\" } }", "SELECT source AS g, doc_id AS d FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en'"),
    # Counts and aggregates.
    "count_pattern": ("SELECT (COUNT(*) AS ?n) { ?l :l_orderkey ?o }", "SELECT count(*) AS n FROM lineitem"),
    "group_agg": (
        "SELECT ?f ?s (COUNT(*) AS ?n) (SUM(?q) AS ?sum_q) (MIN(?q) AS ?lo) (MAX(?q) AS ?hi) (ROUND(AVG(?p)) AS ?avg_p) { ?l :l_returnflag ?f ; :l_linestatus ?s ; :l_quantity ?q ; :l_extendedprice ?p } GROUP BY ?f ?s",
        "SELECT l_returnflag AS f, l_linestatus AS s, count(*) AS n, sum(l_quantity) AS sum_q, min(l_quantity) AS lo, max(l_quantity) AS hi, CAST(floor(avg(l_extendedprice) + 0.5) AS BIGINT) AS avg_p FROM lineitem GROUP BY ALL",
    ),
    "having": ("SELECT ?c (COUNT(?o) AS ?n) { ?o :o_custkey ?c } GROUP BY ?c HAVING (COUNT(?o) > 12)", "SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "count_distinct": ("SELECT (COUNT(DISTINCT ?c) AS ?n) (COUNT(DISTINCT ?s) AS ?m) { ?o :o_custkey ?c ; :o_orderstatus ?s }", "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_orderstatus) AS m FROM orders"),
    "group_concat": ('SELECT ?r (GROUP_CONCAT(?x; SEPARATOR="|") AS ?names) { ?n :n_regionkey ?r ; :n_name ?x } GROUP BY ?r', "SELECT n_regionkey AS r, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1"),
    "sum_empty": ('SELECT (SUM(?t) AS ?s) (COUNT(?t) AS ?n) { ?o :o_orderstatus "none" ; :o_totalprice ?t }', "SELECT coalesce(sum(o_totalprice), 0.0) AS s, count(*) AS n FROM orders WHERE o_orderstatus = 'none'"),
    "group_expr": ("SELECT ?y (COUNT(*) AS ?n) { ?o :o_orderdate ?d } GROUP BY (YEAR(?d) AS ?y)", "SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1"),
    "subquery": ("SELECT ?n ?m { ?c :c_name ?n { SELECT ?c (COUNT(*) AS ?m) { ?o :ref-o_custkey ?c } GROUP BY ?c } FILTER(?m > 12) }", "SELECT c_name AS n, m FROM customer JOIN (SELECT o_custkey AS k, count(*) AS m FROM orders GROUP BY 1) ON k = c_custkey WHERE m > 12"),
    # Other operators.
    "bind": ('SELECT ?o ?x { ?o :o_totalprice ?t BIND(?t * 2 AS ?x) FILTER(?x > 500000) }', "SELECT o_orderkey AS o, o_totalprice * 2 AS x FROM orders WHERE o_totalprice * 2 > 500000"),
    "values_join": ('SELECT ?o ?s { VALUES ?s { "F" "P" } ?o :o_orderstatus ?s }', "SELECT o_orderkey AS o, o_orderstatus AS s FROM orders WHERE o_orderstatus IN ('F', 'P')"),
    "values_undef": ('SELECT ?r ?x ?m { VALUES (?x ?m) { ("ASIA" 1) (UNDEF 2) } ?r :r_name ?x }', "SELECT r_regionkey AS r, r_name AS x, m FROM region JOIN (VALUES ('ASIA', 1), (NULL, 2)) v(x, m) ON v.x IS NULL OR v.x = r_name"),
    "exists": ("SELECT ?o { ?o :o_custkey ?c FILTER EXISTS { ?l :ref-l_orderkey ?o ; :l_quantity ?q FILTER(?q > 49) } }", "SELECT o_orderkey AS o FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)"),
    "not_exists": ("SELECT ?o { ?o :o_custkey ?c FILTER NOT EXISTS { ?l :ref-l_orderkey ?o } }", "SELECT o_orderkey AS o FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"),
    "minus": ("SELECT ?d { ?d :documents.lang ?l MINUS { ?x :labels.ref-doc_id ?d } }", "SELECT doc_id AS d FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "minus_disjoint": ("SELECT ?r { ?r :r_name ?x MINUS { ?n :n_name ?y } }", "SELECT r_regionkey AS r FROM region"),
    # Paths.
    "path_seq": ("SELECT ?o ?n { ?o :ref-o_custkey/:ref-c_nationkey/:n_name ?n }", "SELECT o_orderkey AS o, n_name AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"),
    "path_inverse": ("SELECT ?r ?n { ?r ^:ref-n_regionkey ?n }", "SELECT n_regionkey AS r, n_nationkey AS n FROM nation"),
    "path_alt": ("SELECT ?o ?x { ?o (:o_orderstatus|:o_orderpriority) ?x }", "SELECT o_orderkey AS o, o_orderstatus AS x FROM orders UNION ALL SELECT o_orderkey, o_orderpriority FROM orders"),
    # Functions.
    "fn_string": (
        'SELECT ?n (STRLEN(?x) AS ?len) (UCASE(?x) AS ?up) (LCASE(?x) AS ?low) (SUBSTR(?x, 2, 3) AS ?sub) (CONCAT(?x, "-", ?x) AS ?cat) (REPLACE(?x, "[AEIOU]", "_") AS ?rep) (STRBEFORE(?x, "A") AS ?bef) (STRAFTER(?x, "A") AS ?aft) { ?n :n_name ?x }',
        "SELECT n_nationkey AS n, CAST(length(n_name) AS INTEGER) AS len, upper(n_name) AS up, lower(n_name) AS low, substr(n_name, 2, 3) AS sub, n_name || '-' || n_name AS cat, regexp_replace(n_name, '[AEIOU]', '_', 'g') AS rep, "
        "CASE WHEN contains(n_name, 'A') THEN split_part(n_name, 'A', 1) ELSE '' END AS bef, CASE WHEN contains(n_name, 'A') THEN substr(n_name, instr(n_name, 'A') + 1) ELSE '' END AS aft FROM nation",
    ),
    "fn_numeric": (
        "SELECT ?c (ABS(?b) AS ?a) (CEIL(?b) AS ?up) (FLOOR(?b) AS ?down) (ROUND(?b) AS ?near) (-?b AS ?neg) (?b / 4 AS ?quarter) (?b / 0 AS ?none) { ?c :c_acctbal ?b }",
        "SELECT c_custkey AS c, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS up, CAST(floor(c_acctbal) AS BIGINT) AS down, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS near, -c_acctbal AS neg, c_acctbal / 4 AS quarter, NULL::DOUBLE AS none FROM customer",
    ),
    "fn_date": (
        "SELECT ?o (YEAR(?d) AS ?y) (MONTH(?d) AS ?m) (DAY(?d) AS ?dd) (HOURS(?d) AS ?h) (STR(?d) AS ?s) { ?o :o_orderdate ?d }",
        "SELECT o_orderkey AS o, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS dd, CAST(hour(o_orderdate) AS INTEGER) AS h, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS s FROM orders",
    ),
    "fn_hash": ("SELECT ?n (MD5(?x) AS ?a) (SHA1(?x) AS ?b) (SHA256(?x) AS ?c) { ?n :n_name ?x }", "SELECT n_nationkey AS n, md5(n_name) AS a, sha1(n_name) AS b, sha256(n_name) AS c FROM nation"),
    "fn_logic": (
        'SELECT ?d (IF(?z > 1000, "long", "short") AS ?k) (COALESCE(?q, -1) AS ?v) (BOUND(?q) AS ?b) { ?d :documents.n_chars ?z OPTIONAL { ?y :labels.ref-doc_id ?d ; :quality ?q } }',
        "SELECT d.doc_id AS d, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END AS k, coalesce(quality, -1) AS v, quality IS NOT NULL AS b FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    ),
    "fn_term": (
        "SELECT ?n (STR(?n) AS ?s) (ISIRI(?n) AS ?i) (ISLITERAL(?x) AS ?l) (ISNUMERIC(?r) AS ?num) (xsd:integer(?z) AS ?whole) (ENCODE_FOR_URI(CONCAT(?x, \" &\")) AS ?u) { ?n :n_name ?x ; :n_regionkey ?r BIND(\"12\" AS ?z) }",
        "SELECT n_nationkey AS n, 'urn:t:nation/' || n_nationkey AS s, true AS i, true AS l, true AS num, 12::BIGINT AS whole, replace(n_name, ' ', '%20') || '%20%26' AS u FROM nation",
    ),
}

_EDGES = "SELECT n_nationkey AS a, (n_nationkey * n_nationkey + 3 * n_regionkey + 1) % 25 AS b FROM nation"
_ORDER_LINES = "SELECT ?o ?q { ?o :o_orderstatus \"P\" OPTIONAL { ?l :ref-l_orderkey ?o ; :l_quantity ?q } }"
_ORDER_LINES_SQL = "SELECT o_orderkey AS o, l_quantity AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'"


def _select(text: str) -> Run:
    return lambda spark, d: engine.select(table_graph(spark, d), text, PREFIXES)


def _paged(text: str, schema: str, limit: int) -> Run:
    """All pages of a query, put together."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return joined(table_graph(spark, d), text, limit, schema, PREFIXES)

    return run


def _page(n: int) -> Run:
    """The n-th page of 50 orders by customer."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        data, token = table_graph(spark, d), None
        for _ in range(n):
            page = run_page(data, "SELECT ?o ?c { ?o :o_custkey ?c }", Budget(limit=50), token, prefixes=PREFIXES)
            token = page.token
        return spark.createDataFrame([tuple(r) for r in page.rows], "o long, c long")

    return run


def _full_scan(spark: SparkSession, d: str) -> DataFrame:
    data = table_graph(spark, d)
    data.tables = {t: data.tables[t] for t in ("region", "nation")}
    return engine.select(data, "SELECT ?s ?p ?o { ?s ?p ?o }", PREFIXES)


def _edges(spark: SparkSession, d: str) -> TripleStore:
    nation = spark.read.parquet(f"{d}/nation.parquet")
    node = lambda c: F.concat(F.lit("<urn:n:"), c.cast("string"), F.lit(">"))
    return TripleStore.from_terms(spark, nation.select(node(F.col("n_nationkey")).alias("s"), F.lit("<urn:link>").alias("p"), node((F.col("n_nationkey") * F.col("n_nationkey") + 3 * F.col("n_regionkey") + 1) % 25).alias("o")))


def _path(op: str) -> Run:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = engine.select(_edges(spark, d), f"SELECT ?a ?b {{ ?a <urn:link>{op} ?b }}")
        return out.select(*[F.regexp_extract(c, r"(\d+)", 1).cast("int").alias(c) for c in ("a", "b")])

    return run


def _order_quads(spark: SparkSession, d: str) -> TripleStore:
    """Customers and status of orders, each statement in a graph by year and, for every third order, in a second one."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    g = F.explode(F.when(F.col("o_orderkey") % 3 == 0, F.array(F.year("o_orderdate").cast("string"), F.lit("all"))).otherwise(F.array(F.year("o_orderdate").cast("string"))))
    base = orders.select("o_orderkey", "o_custkey", "o_orderstatus", g.alias("g"))
    tag = lambda kind, c: F.concat(F.lit(f"<urn:{kind}:"), c.cast("string"), F.lit(">"))
    facts = F.explode(F.array(F.struct(F.lit("<urn:cust>").alias("p"), tag("c", F.col("o_custkey")).alias("o")), F.struct(F.lit("<urn:status>").alias("p"), F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit('"')).alias("o"))))
    quads = base.select(tag("g", F.col("g")).alias("g"), tag("o", F.col("o_orderkey")).alias("s"), facts.alias("f")).select("g", "s", "f.p", "f.o")
    return TripleStore.from_terms(spark, quads=quads)


_QUADS_SQL = "WITH q AS (SELECT o_orderkey AS o, o_custkey AS c, o_orderstatus AS s, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [CAST(year(o_orderdate) AS VARCHAR), 'all'] ELSE [CAST(year(o_orderdate) AS VARCHAR)] END) AS g FROM orders) "


def _graph_union(spark: SparkSession, d: str) -> DataFrame:
    q = parse('SELECT ?o ?c { ?o <urn:cust> ?c ; <urn:status> "P" }')
    rel = compile_select(union_default_graph(q.op), _order_quads(spark, d))
    return rel.df.select(*[F.regexp_extract(v, r"(\d+)", 1).cast("long").alias(v) for v in ("o", "c")])


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    q = parse('SELECT * { ?o <urn:cust> ?c ; <urn:status> "P" }')
    rel = compile_select(graph_per_pattern(q.op.child), _order_quads(spark, d))
    n = {v: F.regexp_extract(v, r"(\d+)", 1).cast("long") for v in ("o", "c")}
    return rel.df.select(*[c.alias(v) for v, c in n.items()], *[F.regexp_extract(g, r"<urn:g:(.*)>", 1).alias(g) for g in ("g1", "g2")])


def _count_by_predicate(spark: SparkSession, d: str) -> DataFrame:
    data = table_graph(spark, d)
    data.tables = {t: data.tables[t] for t in ("region", "nation", "customer")}
    return engine.select(data, "SELECT ?p (COUNT(*) AS ?n) { ?s ?p ?o } GROUP BY ?p", PREFIXES)


_FLAT = {"region": ("r_regionkey", "r_name"), "nation": ("n_nationkey", "n_name", "n_regionkey"), "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")}


def _flat_sql(tables: tuple[str, ...], value: str) -> str:
    return " UNION ALL ".join(value.format(t=t, k=_FLAT[t][0], c=c) for t in tables for c in _FLAT[t])


# Sampling. Orders and lineitem; draws are arithmetic, so that SQL can repeat them.

_WALKS = 2000
_LINE_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
_DRAW1 = "least(CAST(floor((w * 48271 + 12345) % 1000003 / 1000003.0 * n) AS BIGINT), n - 1)"
_DRAW2 = "least(CAST(floor((w * 69621 + 777) % 1000003 / 1000003.0 * m) AS BIGINT), m - 1)"
_WALK_SQL = (
    "WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders), "
    f"l AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) - 1 AS r, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem), "
    f"w AS (SELECT range AS w FROM range({_WALKS})), s AS (SELECT w, (SELECT count(*) FROM orders) AS n FROM w), "
    f"a AS (SELECT w, o_orderkey AS o, s.n FROM s JOIN o ON o.r = {_DRAW1.replace('n)', 's.n)').replace('n - 1', 's.n - 1')}), "
    "k AS (SELECT DISTINCT l_orderkey, m FROM l), b AS (SELECT w, o, a.n, k.m FROM a JOIN k ON k.l_orderkey = o), "
    f"c AS (SELECT w AS walk, o, l_linenumber AS line, l_quantity AS q, 1.0::DOUBLE / b.n / b.m AS p, b.n AS n, b.m AS m FROM b JOIN l ON l.l_orderkey = o AND l.r = {_DRAW2.replace('m)', 'b.m)').replace('m - 1', 'b.m - 1')}) "
)


def _walks(spark: SparkSession, d: str) -> DataFrame:
    orders = sampling.ranked(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("o")), [], ["o"])
    first = sampling.step(sampling.walkers(spark, _WALKS), orders, [], sampling.arithmetic("walk", 48271, 12345))
    out = sampling.step(first, spark.read.parquet(f"{d}/lineitem.parquet"), [("o", "l_orderkey")], sampling.arithmetic("walk", 69621, 777), order=_LINE_ORDER)
    return out.select("walk", "o", "l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("q"), "p")


def _sample_walk(spark: SparkSession, d: str) -> DataFrame:
    return _walks(spark, d).select("walk", "o", "line", "q", F.round(1 / F.col("p")).cast("long").alias("weight"))


def _estimate_card(spark: SparkSession, d: str) -> DataFrame:
    return sampling.estimate(_walks(spark, d), _WALKS).select(F.round("estimate", 3).alias("estimate"))


def _count_distinct_ht(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    f = lines.groupBy(F.col("l_orderkey").alias("o")).agg(F.count("*").alias("f"))
    return sampling.distinct_weighted(_walks(spark, d), f, "o", lines.count()).select(F.round("estimate", 3).alias("estimate"))


def _distinct_uniform(spark: SparkSession, d: str) -> DataFrame:
    orders = spark.read.parquet(f"{d}/orders.parquet")
    sample = sampling.uniform_sample(orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], _WALKS, sampling.arithmetic("walk", 48271, 12345))
    f = orders.groupBy("o_custkey").agg(F.count("*").alias("f"))
    return sampling.distinct_uniform(sample, f, "o_custkey", orders.count()).select(F.round("estimate", 3).alias("estimate"))


_UNIFORM_SQL = (
    "WITH o AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders), s AS (SELECT range AS w, (SELECT count(*) FROM orders) AS n FROM range(2000)), "
    f"x AS (SELECT o_custkey, s.n FROM s JOIN o ON o.r = {_DRAW1.replace('n)', 's.n)').replace('n - 1', 's.n - 1')}), f AS (SELECT o_custkey, count(*) AS f FROM orders GROUP BY 1) "
    "SELECT round(max(n)::DOUBLE / count(*) * sum(1.0::DOUBLE / f), 3) AS estimate FROM x JOIN f USING (o_custkey)"
)


# What SQL can't ask.


def _ask(spark: SparkSession, d: str) -> DataFrame:
    data = table_graph(spark, d)
    return spark.createDataFrame([(engine.ask(data, 'ASK { ?n :n_regionkey 1 }', PREFIXES), engine.ask(data, 'ASK { ?n :n_name "ATLANTIS" }', PREFIXES))], "yes boolean, no boolean")


def _json_results(spark: SparkSession, d: str) -> DataFrame:
    data = table_graph(spark, d)
    return bindings(data, engine.solutions(data, "SELECT ?n ?x ?q { ?n :n_name ?x OPTIONAL { ?r :r_regionkey ?q FILTER(?q > 99) } }", PREFIXES))


def _rdfstar(spark: SparkSession, d: str) -> DataFrame:
    facts = spark.read.parquet(f"{d}/nation.parquet").select(F.concat(F.lit("<< <urn:n:"), F.col("n_nationkey").cast("string"), F.lit("> <urn:in> <urn:r:"), F.col("n_regionkey").cast("string"), F.lit("> >>")).alias("s"), F.lit("<urn:says>").alias("p"), F.concat(F.lit('"'), F.col("n_name"), F.lit('"')).alias("o"))
    return engine.select(TripleStore.from_terms(spark, facts), "SELECT ?n ?r ?x { << ?n <urn:in> ?r >> <urn:says> ?x }")


def _construct(spark: SparkSession, d: str) -> DataFrame:
    return engine.construct(table_graph(spark, d), "CONSTRUCT { ?r :has ?n . ?n :name ?x } WHERE { ?n :ref-n_regionkey ?r ; :n_name ?x }", PREFIXES)


def _describe(spark: SparkSession, d: str) -> DataFrame:
    return engine.describe(_edges(spark, d), "DESCRIBE <urn:n:1>")


def _progress(spark: SparkSession, d: str) -> DataFrame:
    data = table_graph(spark, d)
    total = data.tables["orders"].count()
    page = run_page(data, "SELECT ?o { ?o :o_custkey ?c }", Budget(limit=100), prefixes=PREFIXES)
    return spark.createDataFrame([(page.emitted, total, progress(page, total))], "emitted long, total long, progress double")


def _repeated_rows(spark: SparkSession, d: str) -> DataFrame:
    """Pages over a table of a few distinct rows, each there thousands of times."""
    data = TableGraph(spark, {"flags": spark.read.parquet(f"{d}/lineitem.parquet").select("l_returnflag", "l_linestatus")}, {}, {})
    return joined(data, "SELECT ?f ?s { ?x :l_returnflag ?f ; :l_linestatus ?s }", 20_000, "f string, s string", PREFIXES)


def _unions(spark: SparkSession, d: str) -> DataFrame:
    return _paged("SELECT ?x { { ?r :r_name ?x } UNION { ?n :n_name ?x } }", "x string", 7)(spark, d)


OTHERS: dict[str, tuple[Run, str | None]] = {
    "full_scan_spo": (_full_scan, _flat_sql(("region", "nation"), "SELECT '<urn:t:{t}/' || {k} || '>' AS s, '<urn:t:{c}>' AS p, CAST({c} AS VARCHAR) AS o FROM {t}")),
    "count_by_predicate": (_count_by_predicate, _flat_sql(("region", "nation", "customer"), "SELECT '<urn:t:{c}>' AS p, count({c}) AS n FROM {t}")),
    "page_first": (_page(1), "SELECT o_orderkey AS o, o_custkey AS c FROM orders ORDER BY o_orderkey LIMIT 50"),
    "page_second": (_page(2), "SELECT o_orderkey AS o, o_custkey AS c FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 50"),
    "page_all": (_paged('SELECT ?c ?n { ?c :c_mktsegment "BUILDING" ; :c_name ?n }', "c long, n string", 150), "SELECT c_custkey AS c, c_name AS n FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "page_optional": (_paged(_ORDER_LINES, "o long, q double", 1000), _ORDER_LINES_SQL),
    "page_union": (_unions, "SELECT r_name AS x FROM region UNION ALL SELECT n_name FROM nation"),
    "page_group": (_paged("SELECT ?s (COUNT(*) AS ?n) { ?o :o_orderpriority ?s } GROUP BY ?s", "s string, n long", 2), "SELECT o_orderpriority AS s, count(*) AS n FROM orders GROUP BY 1"),
    "page_slice": (_paged("SELECT ?o { ?o :o_custkey ?c } LIMIT 30 OFFSET 5", "o long", 8), "SELECT o_orderkey AS o FROM orders ORDER BY 1 LIMIT 30 OFFSET 5"),
    "page_nokey": (_paged("SELECT ?k ?q { ?l :l_orderkey ?k ; :l_quantity ?q FILTER(?q > 45) }", "k long, q double", 700), "SELECT l_orderkey AS k, l_quantity AS q FROM lineitem WHERE l_quantity > 45"),
    "page_duplicates": (_repeated_rows, "SELECT l_returnflag AS f, l_linestatus AS s FROM lineitem"),
    "graph_union": (_graph_union, "SELECT DISTINCT o_orderkey AS o, o_custkey AS c FROM orders WHERE o_orderstatus = 'P'"),
    "provenance_join": (_provenance, _QUADS_SQL + "SELECT a.o AS o, a.c AS c, a.g AS g1, b.g AS g2 FROM q a JOIN q b ON a.o = b.o WHERE a.s = 'P'"),
    "path_plus": (_path("+"), f"WITH RECURSIVE e AS ({_EDGES}), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM p"),
    "path_star": (_path("*"), f"WITH RECURSIVE e AS ({_EDGES}), p AS (SELECT a, b FROM e UNION SELECT p.a, e.b FROM p JOIN e ON p.b = e.a) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM (SELECT a, b FROM p UNION SELECT a, a FROM e UNION SELECT b, b FROM e)"),
    "path_optional": (_path("?"), f"WITH e AS ({_EDGES}) SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM (SELECT a, b FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e)"),
    "sample_walk": (_sample_walk, _WALK_SQL + "SELECT walk, o, line, q, CAST(round(1 / p) AS BIGINT) AS weight FROM c"),
    "estimate_card": (_estimate_card, _WALK_SQL + f"SELECT round(sum(1 / p) / {_WALKS}, 3) AS estimate FROM c"),
    "count_distinct_ht": (_count_distinct_ht, _WALK_SQL + "SELECT round((SELECT count(*) FROM lineitem)::DOUBLE / sum(1 / p) * sum(1 / p / m), 3) AS estimate FROM c"),
    "count_distinct_uniform": (_distinct_uniform, _UNIFORM_SQL),
    "ask": (_ask, "SELECT true AS yes, false AS no"),
    "json_results": (_json_results, None),
    "rdfstar_pattern": (_rdfstar, "SELECT '<urn:n:' || n_nationkey || '>' AS n, '<urn:r:' || n_regionkey || '>' AS r, '\"' || n_name || '\"' AS x FROM nation"),
    "construct": (_construct, "SELECT '<urn:t:region/' || n_regionkey || '>' AS s, '<urn:t:has>' AS p, '<urn:t:nation/' || n_nationkey || '>' AS o FROM nation UNION ALL SELECT '<urn:t:nation/' || n_nationkey || '>', '<urn:t:name>', '\"' || n_name || '\"' FROM nation"),
    "describe": (_describe, f"WITH e AS ({_EDGES}) SELECT '<urn:n:' || a || '>' AS s, '<urn:link>' AS p, '<urn:n:' || b || '>' AS o FROM e WHERE a = 1 OR b = 1"),
    "progress": (_progress, "SELECT 100::BIGINT AS emitted, count(*) AS total, 100.0::DOUBLE / count(*) AS progress FROM orders"),
}


def queries() -> dict[str, Run]:
    return {name: _select(text) for name, (text, _) in SELECTS.items()} | {name: run for name, (run, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in SELECTS.items()} | {name: sql for name, (_, sql) in OTHERS.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer and nation of each order: two links and three stars."""
    text = "SELECT ?o ?t ?cn ?nn { ?o :o_totalprice ?t ; :ref-o_custkey ?c . ?c :c_name ?cn ; :ref-c_nationkey ?n . ?n :n_name ?nn }"
    return engine.select(table_graph(spark, sf_dir), text, PREFIXES)
