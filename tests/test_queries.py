"""Operators over RDF fixtures, whole and in pages."""

import time

import pytest
from pyspark.sql import functions as F

from graphloom import engine
from graphloom.sources.dataset import TableGraph
from graphloom.streaming import paging
from graphloom.streaming.paging import Budget, TokenError, pages, progress, run_page
from tests.fixtures import CITIES, CITY_QUADS, P, PETS, bag, short, store

INT = "^^<http://www.w3.org/2001/XMLSchema#integer>"


@pytest.fixture(scope="module")
def cities(spark):
    return store(spark, CITIES, CITY_QUADS)


@pytest.fixture(scope="module")
def pets(spark):
    return store(spark, PETS)


@pytest.fixture(scope="module")
def mixed(spark):
    return store(
        spark,
        f"""a|link|b
b|link|c
c|link|a
c|link|d
d|self|d
a|age|"30"{INT}
b|age|"7"{INT}
c|age|"old"
a|name|"Ann"@en
b|name|"Bö"
_:x|name|"blank"
<< <http://e/a> <http://e/knows> <http://e/b> >>|since|"2001"{INT}
<< <http://e/a> <http://e/knows> <http://e/c> >>|since|"2005"{INT}""",
    )


def run(data, q):
    return short(tuple(r) for r in engine.select(data, q, P).collect())


CITY_QUERIES = [
    ("SELECT * { ?s ?p ?o }", 10),
    ("SELECT * { ?s :parentCountry ?o }", 10),
    ("SELECT * { :City0 :parentCountry :Country6 }", 1),
    ("SELECT * { :City0 :parentCountry :Country6 . ?s :parentCountry ?o }", 10),
    ("SELECT * { :Nowhere :parentCountry ?o }", 0),
    ("SELECT * { { ?s ?p :Country1 } UNION { :City0 :parentCountry ?o } }", 3),
    ("SELECT * { { ?s ?p :Country1 } UNION { :City0 :parentCountry ?o } UNION { ?s :parentCountry :Country2 } }", 5),
    ("SELECT * { ?s ?p :Country1 { { ?s :parentCountry :Country1 } UNION { ?s :none ?x } } }", 2),
    ("SELECT * { ?s ?p :Country1 OPTIONAL { ?s :none ?x } }", 2),
    ("SELECT * { GRAPH :graphA { ?s ?p ?o } }", 3),
    ("SELECT * { GRAPH ?g { ?s ?p ?o } }", 4),
    ("SELECT * FROM NAMED :graphB { GRAPH ?g { ?s ?p ?o } }", 1),
    ("SELECT * FROM :graphA FROM :graphB { ?s ?p ?o }", 4),
]


@pytest.mark.parametrize(("q", "n"), CITY_QUERIES)
def test_counts_and_pages(cities, q, n):
    whole = bag(engine.select(cities, q, P))
    assert len(whole) == n
    for size in (1, 3) if n < 6 else (3,):
        paged = [tuple(r) for p in pages(cities, q, size, P) for r in p.rows]
        assert sorted(paged, key=repr) == whole


def test_limit_counts_over_pages(cities):
    got, token = [], None
    for size in (1, 1, 1, 10):
        page = run_page(cities, "SELECT ?s { ?s :parentCountry ?o } LIMIT 5", Budget(limit=size), token, prefixes=P)
        got, token = [*got, len(page.rows)], page.token
    assert got == [1, 1, 1, 2] and token is None
    out = pages(cities, "SELECT ?s { ?s :parentCountry ?o } LIMIT 4 OFFSET 3", 2, P)
    assert [len(p.rows) for p in out] == [2, 2] and len({r for p in out for r in p.rows}) == 4


PET_QUERIES = {
    "SELECT * { ?p :address :nantes OPTIONAL { ?p :own ?o FILTER(?o != :cat) } }": [("alice", "dog"), ("alice", "snake"), ("carol", None)],
    "SELECT ?p { ?p :address ?a FILTER NOT EXISTS { ?p :own ?x } }": [("bob",), ("carol",)],
    "SELECT ?p { ?p :address ?a FILTER EXISTS { ?p :own ?x FILTER(?x = :cat) } }": [("alice",)],
    "SELECT ?p { ?p :address ?a MINUS { ?p :own ?x } }": [("bob",), ("carol",)],
    "SELECT ?p { ?p :address ?a MINUS { ?y :own ?x } }": [("alice",), ("bob",), ("carol",)],
    "SELECT DISTINCT ?a { ?p :address ?a }": [("nantes",), ("paris",)],
    "SELECT ?a ?b { ?p :address ?a { SELECT (COUNT(*) AS ?b) { ?z :own ?y } } FILTER(?p = :bob) }": [('"3"' + INT, "paris")],
}


@pytest.mark.parametrize("q", PET_QUERIES)
def test_pets(pets, q):
    want = PET_QUERIES[q]
    got = run(pets, q)
    assert sorted(map(sorted, ([str(x) for x in r] for r in got))) == sorted(map(sorted, ([str(x) for x in r] for r in want)))
    paged = short(tuple(r) for p in pages(pets, q, 2, P) for r in p.rows)
    assert paged == got


def test_partial_bindings_against_brute_force(pets):
    own = [("alice", x) for x in ("cat", "dog", "snake")]
    want = []
    for p, a in (("alice", "nantes"), ("bob", "paris"), ("carol", "nantes")):
        for x in [x for q, x in own if q == p] or [None]:
            second = [(q, y) for q, y in own if x is None or x == y]
            want += [(p, a, y, q) for q, y in second] or [(p, a, x, None)]
    q = "SELECT ?p ?a ?x ?q { ?p :address ?a OPTIONAL { ?p :own ?x } OPTIONAL { ?q :own ?x } }"
    assert run(pets, q) == sorted(want, key=repr) and len(want) == 9
    assert short(tuple(r) for p in pages(pets, q, 2, P) for r in p.rows) == sorted(want, key=repr)


def test_join_sees_every_right_row(pets):
    assert len(run(pets, "SELECT * { { ?p :address ?a } { ?p :own ?o } }")) == 3


def test_repeated_variable(mixed):
    assert run(mixed, "SELECT ?x { ?x :self ?x }") == [("d",)]


def test_paths(mixed):
    plus = {(x, y) for x in "abc" for y in "abcd"}
    assert set(run(mixed, "SELECT ?x ?y { ?x :link+ ?y }")) == plus
    star = set(run(mixed, "SELECT ?x ?y { ?x :link* ?y }"))
    assert plus <= star and ("d", "d") in star and ('"Bö"', '"Bö"') in star
    assert run(mixed, "SELECT ?y { :a :link/:link ?y }") == [("c",)]
    assert run(mixed, "SELECT ?y { :a ^:link ?y }") == [("c",)]
    assert run(mixed, "SELECT ?y { :a (:link|:age) ?y }") == sorted([("b",), ('"30"' + INT,)], key=repr)
    assert run(mixed, "SELECT ?y { :d :self? ?y }") == [("d",)]
    assert ("b",) in run(mixed, "SELECT ?y { :a !(:age|:name) ?y }")
    assert run(mixed, "SELECT ?x { ?x :link+ :d }") == [("a",), ("b",), ("c",)]


def test_quoted_triples(mixed):
    assert run(mixed, "SELECT ?y ?w { << :a :knows ?y >> :since ?w FILTER(?w > 2003) }") == [("c", '"2005"' + INT)]


def test_expressions(mixed):
    assert run(mixed, "SELECT ?x { ?x :age ?n FILTER(?n > 8) }") == [("a",)]  # a string isn't a number: an error, so no
    assert run(mixed, "SELECT ?x ?m { ?x :age ?n BIND(?n * 2 + 1 AS ?m) } ORDER BY ?x") == [("a", '"61"' + INT), ("b", '"15"' + INT), ("c", None)]
    assert run(mixed, 'SELECT ?x { ?x :name ?n FILTER(LANGMATCHES(LANG(?n), "en")) }') == [("a",)]
    assert len(run(mixed, "SELECT ?x { ?x :name ?n FILTER(ISBLANK(?x)) }")) == 1
    got = engine.select(mixed, "SELECT (SUM(?n) AS ?s) { ?x :age ?n }", P).collect()
    assert got[0]["s"] is None  # one value that isn't a number voids the sum
    assert engine.select(mixed, "SELECT (SUM(?n) AS ?s) (COUNT(?n) AS ?c) { ?x :nothing ?n }", P).collect()[0]["s"] == '"0"' + INT


def test_order_of_kinds(mixed):
    got = [r["v"] for r in engine.select(mixed, "SELECT ?v { { :a :age ?v } UNION { :a :link ?v } UNION { ?v :name \"blank\" } UNION { :b :age ?v } UNION { :a :none ?w } } ORDER BY ?v", P).collect()]
    assert [x[0] for x in got] == ["_", "<", '"', '"'] and got[2].startswith('"7"') and got[3].startswith('"30"')


def test_values_with_undef(pets):
    got = run(pets, "SELECT ?p ?k { VALUES (?p ?k) { (:alice 1) (UNDEF 2) } ?p :address ?a }")
    assert len(got) == 4


def test_forms(pets):
    assert engine.ask(pets, "ASK { :alice :own :cat }", P) and not engine.ask(pets, "ASK { :bob :own ?x }", P)
    made = bag(engine.construct(pets, "CONSTRUCT { ?a :home ?p } WHERE { ?p :address ?a }", P))
    assert len(made) == 3
    assert len(bag(engine.describe(pets, "DESCRIBE :cat", P))) == 1


def test_budget_is_the_lesser_and_time_stops_between_chunks(cities):
    assert Budget(5, None).within(Budget(3, 100)) == Budget(3, 100)
    page = run_page(cities, "SELECT * { ?s ?p ?o }", Budget(timeout_ms=0), prefixes=P, chunk=4)
    assert len(page.rows) == 4 and page.token
    rest = run_page(cities, "SELECT * { ?s ?p ?o }", token=page.token, prefixes=P)
    assert len(rest.rows) == 6 and rest.token is None and progress(rest, 10) == 1.0


def test_tokens_are_checked(cities, pets):
    page = run_page(cities, "SELECT * { ?s ?p ?o }", Budget(limit=2), prefixes=P)
    with pytest.raises(TokenError):
        run_page(cities, "SELECT ?s { ?s ?p ?o }", token=page.token, prefixes=P)
    for bad in ("", "[]", '{"query": 1}', page.token.replace('"emitted": 2', '"emitted": -1')):
        with pytest.raises(TokenError):
            run_page(cities, "SELECT * { ?s ?p ?o }", token=bad, prefixes=P)


@pytest.fixture(params=["files", "memory"])
def repeated(spark, request, tmp_path):
    """Equal rows, null keys, and a key that repeats."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "a"), (2, None), (2, "c")]
    df = spark.createDataFrame(rows, "k int, v string")
    if request.param == "files":
        df.write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    return df


@pytest.mark.parametrize("keys", [{}, {"t": ["k"]}])
@pytest.mark.parametrize("query", ["SELECT ?v { ?s :v ?v }", "SELECT ?v ?w { { ?s :v ?v } { ?x :v ?w } }", "SELECT ?p ?o { ?s ?p ?o }", "SELECT ?v { { ?s :v ?v } UNION { ?s :k ?v2 } }"])
def test_no_row_is_lost_in_pages(spark, repeated, keys, query, monkeypatch):
    data = TableGraph(spark, {"t": repeated}, keys, {})
    whole = bag(engine.select(data, query, {"": "urn:t:"}))
    for ahead in (0, 4):
        monkeypatch.setattr(paging, "AHEAD", ahead)
        got = [tuple(r) for p in pages(data, query, 5 if len(whole) > 20 else 1, {"": "urn:t:"}) for r in p.rows]
        assert sorted(got, key=repr) == whole and whole


def test_ranges_of_the_first_key(spark, monkeypatch):
    monkeypatch.setattr(paging, "AHEAD", 0)
    numbers = sorted({int(1.3**k) for k in range(60)} | {0})
    data = TableGraph(spark, {"t": spark.createDataFrame([(n, f"v{n}") for n in numbers], "k long, v string")}, {"t": ["k"]}, {})
    got = [r.s for p in pages(data, "SELECT ?s { ?s :v ?v }", 3, {"": "urn:t:"}) for r in p.rows]
    assert got == numbers


def test_foreign_tokens_are_refused(spark, tmp_path):
    q, prefix = "SELECT ?v { ?s :v ?v }", {"": "urn:t:"}
    table = lambda rows: TableGraph(spark, {"t": spark.createDataFrame(rows, "k int, v string")}, {"t": ["k"]}, {})
    token = run_page(table([(1, "a"), (2, "b")]), q, Budget(limit=1), prefixes=prefix).token
    assert [r.v for r in run_page(table([(1, "a"), (2, "b")]), q, token=token, prefixes=prefix).rows] == ["b"]
    with pytest.raises(TokenError):
        run_page(table([(1, "a"), (3, "c")]), q, token=token, prefixes=prefix)
    for rows in ([(1, "a"), (2, "b")], [(1, "a"), (2, "c"), (3, "d")]):
        spark.createDataFrame(rows, "k int, v string").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "t"))
        data = TableGraph(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, {"t": ["k"]}, {})
        if len(rows) == 2:
            token = run_page(data, q, Budget(limit=1), prefixes=prefix).token
    with pytest.raises(TokenError):
        run_page(data, q, token=token, prefixes=prefix)
    a, b = store(spark, "x|p|y\nx|p|z"), store(spark, "x|p|y\nx|p|w")
    with pytest.raises(TokenError):
        run_page(b, "SELECT ?o { ?s ?p ?o }", token=run_page(a, "SELECT ?o { ?s ?p ?o }", Budget(limit=1)).token)


def test_a_running_chunk_is_cancelled_at_the_deadline(spark):
    slow = F.udf(lambda k: __import__("time").sleep(0 if k < 4 else 30) or k, "long").asNondeterministic()
    data = TableGraph(spark, {"t": spark.range(40, numPartitions=4).select(F.col("id").alias("k"), F.col("id").alias("v"))}, {"t": ["k"]}, {})
    rel = engine.solutions(data, "SELECT ?s { ?s :v ?v }", {"": "urn:t:"})
    began = time.monotonic()
    assert paging._within(data, lambda: rel.df.select(slow("s")).collect(), began + 1) is None
    assert time.monotonic() - began < 15
    assert paging._within(data, lambda: [1], time.monotonic() + 5) == [1]


def one(data, select, where="{ :a :age ?n }"):
    return tuple(engine.select(data, f"SELECT {select} {where}", P).first())


def test_aggregates(mixed):
    where = "{ VALUES ?n { 4 1 4 2.5 } }"
    got = one(mixed, "(SUM(?n) AS ?a) (AVG(?n) AS ?b) (MIN(?n) AS ?c) (MAX(?n) AS ?d) (SUM(DISTINCT ?n) AS ?e) (COUNT(DISTINCT ?n) AS ?f) (SAMPLE(?n) AS ?g)", where)
    number = lambda t: float(t[1:].partition('"')[0])
    assert [number(t) for t in got[:6]] == [11.5, 2.875, 1, 4, 7.5, 3] and number(got[6]) in (4, 1, 2.5)
    assert one(mixed, '(GROUP_CONCAT(?x; SEPARATOR="+") AS ?a)', '{ VALUES ?x { "b" "a" } }') == ('"a+b"',)
    assert one(mixed, "(COUNT(*) AS ?n)", "{ :nobody :age ?x }") == ('"0"' + INT,)


FUNCTION_CASES = [
    ("STR(:a)", '"http://e/a"'), ('STRLEN("añb")', '"3"' + INT), ('SUBSTR("hello", 2, 3)', '"ell"'), ('UCASE("aé")', '"AÉ"'), ('STRBEFORE("abc", "b")', '"a"'), ('STRAFTER("abc", "x")', '""'),
    ('CONTAINS("abc", "bc")', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ('REGEX("ABC", "b", "i")', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ('REPLACE("abcb", "b", "Z")', '"aZcZ"'),
    ('LANG("x"@en)', '"en"'), ("DATATYPE(5)", "<http://www.w3.org/2001/XMLSchema#double>"), ("DATATYPE(?n)", "<http://www.w3.org/2001/XMLSchema#integer>"), ('STRLANG("x", "FR")', '"x"@fr'), ('STRDT("5", xsd:byte)', '"5"^^<http://www.w3.org/2001/XMLSchema#byte>'),
    ('IRI("http://e/z")', "<http://e/z>"), ("ISIRI(:a)", '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ("ISNUMERIC(?n)", '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ("SAMETERM(?n, 30)", '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ("ABS(-3)", '"3"' + INT), ("ROUND(2.5)", '"3"' + INT), ("ROUND(-2.5)", '"-2"' + INT), ("CEIL(1.2)", '"2"' + INT), ("FLOOR(-1.2)", '"-2"' + INT), ("7 / 2", '"3.5"^^<http://www.w3.org/2001/XMLSchema#double>'), ("1 / 0", None),
    ('IF(?n > 3, "y", 0)', '"y"'), ("COALESCE(?none, 1 / 0, 9)", '"9"' + INT), ("?n IN (1, 30)", '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ("?n NOT IN (1, 30)", '"false"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('xsd:integer("12")', '"12"' + INT), ('xsd:integer("x")', None), ('xsd:boolean("1")', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ("xsd:string(?n)", '"30"'),
    ('YEAR("2001-02-03T04:05:06"^^xsd:dateTime)', '"2001"' + INT), ('TZ("2001-02-03T04:05:06Z"^^xsd:dateTime)', '"Z"'), ('TIMEZONE("2001-02-03T04:05:06-05:00"^^xsd:dateTime)', '"-PT5H"'),
    ('ENCODE_FOR_URI("a b/ü*")', '"a%20b%2F%C3%BC%2A"'), ('MD5("abc")', '"900150983cd24fb0d6963f7d28e17f72"'), ('SHA512("a")', None), ('LANGMATCHES("en-GB", "EN")', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
    ('1 = 1.0', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ('"a" < "b"', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ('!("" || false)', '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'), ("(1/0 = 1) || true", '"true"^^<http://www.w3.org/2001/XMLSchema#boolean>'),
]


def test_functions(mixed):
    select = " ".join(f"({e} AS ?x{k})" for k, (e, _) in enumerate(FUNCTION_CASES))
    got = one(mixed, select)
    wrong = [(e, want, x) for (e, want), x in zip(FUNCTION_CASES, got) if x != want and not (e.startswith("SHA512") and len(x) == 130)]
    assert not wrong
    made = one(mixed, "(UUID() AS ?a) (STRUUID() AS ?b) (BNODE() AS ?c) (RAND() AS ?d) (NOW() AS ?e)")
    assert made[0].startswith("<urn:uuid:") and made[2].startswith("_:") and all(made)


def test_pages_from_a_stream_hold_little_in_the_driver(spark, tmp_path, monkeypatch):
    """Where the read-ahead would be large, pages come out of a sorted stream: the same rows in the same order, and no list of them is held."""
    for name, value in (("STREAMED", 3), ("STREAM_PART", 2), ("JOINED", 3)):
        monkeypatch.setattr(paging, name, value)
    want = [(n // 3, None if n == 5 else f"v{n % 4}") for n in range(16)]
    spark.createDataFrame(want[::-1], "k int, v string").coalesce(1).write.parquet(str(tmp_path / "t"))
    data = TableGraph(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, {"t": ["k"]}, {})
    query, prefix = "SELECT ?k ?v { ?s :k ?k OPTIONAL { ?s :v ?v } }", {"": "urn:t:"}
    whole = sorted(map(tuple, engine.select(data, query, prefix).collect()), key=repr)
    put, token, got, noted = paging._AHEAD.put, None, [], []
    monkeypatch.setattr(paging._AHEAD, "put", lambda t, rows, last, stream=None: (noted.append((len(rows), stream is not None)), put(t, rows, last, stream)))
    while token is not None or not got:
        page = run_page(data, query, Budget(limit=2), token, prefixes=prefix)
        got, token = got + [tuple(r) for r in page.rows], page.token
        if len(got) == 8:  # a stream that is gone: the data answers
            paging._AHEAD.take(token)
    assert sorted(got, key=repr) == whole and [k for k, _ in got] == sorted(k for k, _ in got) and len(got) >= 16
    assert any(s for _, s in noted) and max(n for n, _ in noted) <= 3
    out = paging.joined(data, query, 4, "k int, v string", prefix)
    assert sorted(map(tuple, out.collect()), key=repr) == whole and out.schema.simpleString() == "struct<k:int,v:string>"
    assert paging.joined(data, 'SELECT ?v { ?s :v ?v FILTER(?v = "none") }', 2, "v string", prefix).count() == 0
    assert [tuple(r) for p in pages(data, query + " LIMIT 7 OFFSET 5", 4, prefix) for r in p.rows] == got[5:12]


def test_a_held_page_makes_no_condition(spark, monkeypatch):
    """A page whose rows are held already is given out without the condition that would ask the data for them."""
    data = TableGraph(spark, {"t": spark.createDataFrame([(n,) for n in range(9)], "k int")}, {"t": ["k"]}, {})
    pages_of = paging.each_page(data, "SELECT ?k { ?s :k ?k }", 1, {"": "urn:t:"})
    next(pages_of), next(pages_of)  # the second reads four rows ahead
    monkeypatch.setattr(paging, "after", None)
    assert [next(pages_of).rows[0].k for _ in range(4)] == [2, 3, 4, 5]


def test_a_top_k_is_merged_by_an_executor(spark, tmp_path):
    """A page of a table without a key is a top-k over all its files. Only the page's rows come to the driver, not those of each task."""
    spark.range(30_000, numPartitions=30).select((F.col("id") * 7919 % 30_011).alias("v")).write.parquet(str(tmp_path / "t"))
    data = TableGraph(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, {}, {})
    query, prefix, conf = "SELECT ?v { ?s :v ?v }", {"": "urn:t:"}, spark.sparkContext._jsc.sc().conf()
    split = spark.conf.get("spark.sql.files.maxPartitionBytes")
    paging.fingerprint(paging.parse(query, prefix), data)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    conf.set("spark.driver.maxResultSize", "600k")
    try:
        page = run_page(data, query, Budget(limit=1000), prefixes=prefix)
    finally:
        conf.remove("spark.driver.maxResultSize")
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    assert len({r.v for r in page.rows}) == len(page.rows) == 1000


def test_values_of_pages_are_those_of_rows(spark, tmp_path, monkeypatch):
    """Whatever its type, a value in a page or in the joined pages is the one that collect() gives; bytes alone can end a part of joined()."""
    spark.sql(
        "SELECT id AS k, IF(id % 3 = 0, NULL, cast(id / 8 AS double)) AS d, cast('nan' AS double) AS nan, cast(id AS decimal(20, 3)) AS c, id % 2 = 0 AS b, timestamp_seconds(id * 9999999) AS t, "
        "cast(timestamp_seconds(id) AS timestamp_ntz) AS n, date_from_unix_date(id) AS y, array(id, NULL) AS a, named_struct('x', id, 's', 'é') AS s, map('m', id) AS m, cast('q' AS binary) AS z, cast(NULL AS string) AS e FROM range(40)"
    ).write.parquet(str(tmp_path / "t"))
    data = TableGraph(spark, {"t": spark.read.parquet(str(tmp_path / "t"))}, {"t": ["k"]}, {})
    names = [c for c in data.tables["t"].columns if c != "e"]
    query, prefix = f"SELECT {' '.join('?' + c for c in names)} ?e {{ ?r {' ; '.join(f':{c} ?{c}' for c in names if c != 'd')} OPTIONAL {{ ?r :d ?d }} OPTIONAL {{ ?r :e ?e }} }}", {"": "urn:t:"}
    want = engine.select(data, query, prefix).orderBy("k")
    whole = [repr(r) for r in want.collect()]
    assert [repr(r) for p in pages(data, query, 7, prefix) for r in p.rows] == whole and len(whole) == 40
    page = run_page(data, query, Budget(timeout_ms=60_000), prefixes=prefix, chunk=9)  # of several fetches
    assert [repr(r) for r in page.rows] == whole and page.token is None
    monkeypatch.setattr(paging, "STREAMED", 3)
    assert [repr(r) for p in pages(data, query, 7, prefix) for r in p.rows] == whole
    simple = "SELECT ?k ?d ?b ?e { ?r :k ?k ; :b ?b OPTIONAL { ?r :d ?d } OPTIONAL { ?r :e ?e } }"
    cuts = []
    monkeypatch.setattr(paging, "JOINED_BYTES", 100)
    monkeypatch.setattr(paging, "cut", lambda df: cuts.append(df.count()) or df)
    out = paging.joined(data, simple, 7, "k long, d double, b boolean, e string", prefix)
    assert [repr(r) for r in out.orderBy("k").collect()] == [repr(r) for r in want.select("k", "d", "b", "e").collect()] and cuts == [7, 7, 7, 7, 7, 5]
    # A pattern without variables has rows without columns.
    assert [len(p.rows) for p in pages(data, "SELECT * { <urn:t:t/5> :b false }", 1, prefix)] == [1]
