"""Readers, writers, stores, optimizer and sampling."""

import json
import random
import threading
import urllib.error
import urllib.parse
import urllib.request

import duckdb
import pytest
from pyspark.sql import functions as F

from graphloom import catalogue, engine
from graphloom.functions import exprs, terms
from graphloom.operators import sampling
from graphloom.plans.algebra import BGP, Const, Triple, Var, node_vars, triple_vars
from graphloom.plans.compiler import compile_select
from graphloom.plans.optimizer import graph_per_pattern, greedy_order, union_default_graph
from graphloom.plans.parser import ParseError, parse
from graphloom.server import make_server
from graphloom.sources import ntriples, results
from graphloom.sources.dataset import TripleStore
from graphloom.sources.tables import PREFIXES, table_graph
from graphloom.streaming.paging import Budget, run_page
from tests.fixtures import CITIES, CITY_QUADS, P, PETS, bag, short, store

TINY = "/root/testdata/sf0.001"


def test_ntriples_round_trip(spark, tmp_path):
    lines = ['# comment', '<http://e/a> <http://e/p> "x \\"y\\" z"@en .', "_:b <http://e/p> <http://e/a> .", "", '<< <http://e/a> <http://e/p> _:b >> <http://e/q> "1"^^<http://www.w3.org/2001/XMLSchema#integer> .', '<http://e/a> <http://e/p> "s"^^<http://www.w3.org/2001/XMLSchema#string> <http://e/g> .']
    (tmp_path / "in.nq").write_text("\n".join(lines))
    data = ntriples.bulk_load(spark, str(tmp_path / "in.nq"), str(tmp_path / "db"))
    assert data.triples.count() == 3 and data.quads.count() == 1
    assert bag(engine.select(data, "SELECT ?o { GRAPH ?g { ?s ?p ?o } }")) == [('"s"',)]
    ntriples.write(data, str(tmp_path / "out"))
    again = ntriples.read(spark, str(tmp_path / "out"))
    assert bag(again.nodes) == bag(data.nodes) and bag(again.triples) == bag(data.triples)
    (tmp_path / "bad.nt").write_text("not a triple\n")
    with pytest.raises(Exception, match="not N-Triples"):
        ntriples.read(spark, str(tmp_path / "bad.nt")).triples.collect()


def test_dictionary(spark):
    data = store(spark, PETS)
    node = data.get_id("<http://e/cat>")
    assert data.get_value(node) == "<http://e/cat>"
    with pytest.raises(KeyError):
        data.get_id("<http://e/unicorn>")
    with pytest.raises(KeyError):
        data.get_value(12345)


def test_constant_predicate_prunes_files_and_ids_are_pushed(spark, tmp_path):
    store(spark, PETS).save(str(tmp_path / "db"))
    data = TripleStore.load(spark, str(tmp_path / "db"))
    plan = compile_select(parse("SELECT ?x { :alice :own ?x }", P).op, data, decode=False).df._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "EqualTo(s," in plan


def test_star_is_one_scan(spark):
    data = table_graph(spark, TINY)
    plan = engine.select(data, "SELECT ?a ?b { ?o :o_orderstatus ?a ; :o_totalprice ?b ; :o_orderstatus \"F\" }", PREFIXES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "EqualTo(o_orderstatus,F)" in plan and "o_custkey" not in plan


def test_filtered_view(spark):
    data = store(spark, PETS)
    hidden = data.get_id("<http://e/cat>")
    assert len(bag(engine.select(data.filtered(F.col("o") != hidden), "SELECT ?x { ?s :own ?x }", P))) == 2


def test_union_graph_is_a_set(spark):
    data = store(spark, quads="g1|a|p|b\ng2|a|p|b\ng2|a|p|c")
    assert len(bag(engine.select(data, "SELECT * { GRAPH ?g { ?s ?p ?o } }"))) == 3
    op = union_default_graph(parse("SELECT * { ?s ?p ?o }").op)
    assert compile_select(op, data).df.count() == 2
    assert data.union_default_graph().triples.count() == 2
    both = compile_select(graph_per_pattern(parse("SELECT * { ?s :p ?x . ?s :p ?y }", P).op.child), data)
    assert {"g1", "g2"} <= set(both.vars) and both.df.count() == 9


def test_greedy_order(spark):
    data = store(spark, CITIES, CITY_QUADS)
    a, b, c = (Triple(Var("s"), Const("<http://e/parentCountry>"), Var("o")), Triple(Var("s"), Var("p"), Const("<http://e/Country2>")), Triple(Var("x"), Const("<http://e/parentCountry>"), Const("<http://e/Country6>")))
    assert greedy_order([a, b], data.count, triple_vars) == [b, a]
    assert greedy_order([b, a, c], data.count, triple_vars) == [c, b, a]
    d = Triple(Var("q"), Var("r"), Const("<http://e/Country17>"))
    assert greedy_order([d, a], data.count, triple_vars, bound={"s"})[0] is a
    assert node_vars(Var("x")) == {"x"} and data.cardinality((Triple(Var("s"), Const("<http://e/none>"), Var("o")),), None) == 0


def test_same_result_in_any_order(spark):
    data = store(spark, PETS)
    q = "SELECT * { ?p :address ?a . ?p :own ?o . ?z :address ?a }"
    assert bag(engine.select(data, q, P, optimize=False)) == bag(engine.select(data, q, P))


def test_json(spark):
    data = store(spark, PETS + '\nalice|name|"A"@en')
    got = sorted(json.loads(r[0])["n"]["xml:lang"] for r in results.bindings(data, engine.solutions(data, "SELECT ?n ?m { ?s :name ?n OPTIONAL { ?s :none ?m } }", P)).collect())
    assert got == ["en"]
    page = run_page(data, "SELECT ?p ?a { ?p :address ?a }", Budget(limit=1), prefixes=P)
    out = json.loads(results.page_json(page))
    assert out["head"] == {"vars": ["p", "a"]} and out["results"]["bindings"][0]["p"]["type"] == "uri" and out["next"] == page.token
    assert json.loads(results.boolean_json(True))["boolean"] is True


def test_terms():
    for t in (terms.literal('a"b\n\\'), terms.literal("x", lang="EN"), terms.literal("1", terms.XSD + "integer"), "<http://e/a>", "_:b"):
        kind, lex, datatype, lang = terms.parts(t)
        assert kind != "literal" or terms.literal(lex, datatype, lang) == t
    assert terms.native(terms.literal("1.5", terms.XSD + "decimal")) == 1.5


def test_user_functions(spark):
    @exprs.register("TWICE")
    def twice(v):
        return exprs.Val(exprs.num(v) * 2, "num")

    data = table_graph(spark, TINY)
    assert [float(r[0]) for r in engine.select(data, "SELECT (TWICE(?k) AS ?x) { <urn:t:region/2> :r_regionkey ?k }", PREFIXES).collect()] == [4.0]


def test_parser_rejects():
    for bad in ("SELECT", "SELECT * { ?s ?p }", "SELECT * { ?s x:y ?o }", "FETCH * {}", "SELECT * { ?s ?p ?o } garbage"):
        with pytest.raises(ParseError):
            parse(bad)
    assert isinstance(parse("SELECT * { ?s ?p ?o }").op.child, BGP)


def test_query_folder(tmp_path):
    (tmp_path / "a.sparql").write_text("SELECT *\n{ ?s ?p ?o }\n")
    (tmp_path / "b.sparql").write_text("x")
    assert ntriples.query_folder(str(tmp_path), blacklist=("b",)) == {"a": "SELECT * { ?s ?p ?o }"}


def _skewed(spark, distinct=40, seed=5):
    r, out = random.Random(seed), []
    for i in range(distinct):
        out.append(f"prof{i}|is_a|Prof")
        for j in range(r.randint(1, 12)):
            out.append(f"prof{i}|teaches|student{i}_{j}")
            if j % 2 == 0:
                out.append(f"student{i}_{j}|belongs_to|group{i}")
    return store(spark, "\n".join(out)), len([x for x in out if "belongs_to" in x])


def test_walks_and_estimates(spark):
    data, chain = _skewed(spark)
    pairs = lambda p: engine.select(data, f"SELECT ?s ?o {{ ?s :{p} ?o }}", P)
    profs = sampling.ranked(pairs("is_a").select(F.col("s").alias("prof")), [], ["prof"])
    assert sorted(r["_rank"] for r in profs.collect()) == list(range(40)) and {r["_cnt"] for r in profs.collect()} == {40}
    drawn = sampling.step(sampling.walkers(spark, 4000), profs, [], sampling.seeded(1))
    assert drawn.select("prof").distinct().count() == 40 and {round(r["p"], 9) for r in drawn.collect()} == {0.025}
    teaches = sampling.ranked(pairs("teaches").toDF("prof", "student"), ["prof"], ["student"])
    groups = sampling.ranked(pairs("belongs_to").toDF("student", "group"), ["student"], ["group"])
    two = sampling.step(drawn, teaches, [("prof", "prof")], sampling.seeded(2))
    three = sampling.step(two, groups, [("student", "student")], sampling.seeded(3)).cache()
    estimate = sampling.estimate(three, 4000).first()[0]
    assert abs(estimate - chain) < 0.1 * chain
    frequency = pairs("belongs_to").toDF("student", "group").groupBy("group").agg(F.count("*").alias("f"))
    got = sampling.distinct_weighted(three, frequency, "group", chain).first()[0]
    assert abs(got - 40) < 4
    kept = sampling.accept(two, pairs("teaches").count(), sampling.seeded(4))
    assert 0 < kept.count() < two.count()
    empty = sampling.ranked(pairs("nothing").toDF("prof", "x"), [], ["prof"])
    assert sampling.step(sampling.walkers(spark, 10), empty, [], sampling.seeded(1)).count() == 0
    every = pairs("belongs_to").toDF("student", "group").join(frequency, "group")
    assert abs(every.agg(F.sum(1 / F.col("f"))).first()[0] - 40) < 1e-9


def test_ranks_of_a_frequent_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 40}", i) for i in range(3000)]
    got = sampling.ranked(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"]).collect()
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key)
        assert [(x["v"], x["_rank"], x["_cnt"]) for x in sorted(got, key=lambda x: x["v"]) if x["k"] == key] == [(v, n, len(values)) for n, v in enumerate(values)]


def test_estimates_of_patterns(spark):
    data, chain = _skewed(spark)
    q = parse("SELECT * { ?p :is_a :Prof . ?p :teaches ?s . ?s :belongs_to ?g }", P).op.child.triples
    assert sampling.estimate_pattern(data, q, None) == chain
    assert abs(sampling.estimate_pattern(data, q, 4000, seed=5) - chain) < 0.15 * chain
    none = parse("SELECT * { ?p :is_a :Dean }", P).op.child.triples
    assert sampling.estimate_pattern(data, none, 50) == 0
    single = parse("SELECT * { :prof3 :is_a ?x }", P).op.child.triples
    assert sampling.estimate_pattern(data, single, 50) == 1


def test_server(spark):
    data = store(spark, PETS)
    with make_server(data, 0, Budget(2, None), P) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_address[1]}/query?"
        ask = lambda **x: json.load(urllib.request.urlopen(url + urllib.parse.urlencode(x)))
        rows, token = [], None
        while True:
            got = ask(query="SELECT * { ?p :own ?o }", limit=100, **({"token": token} if token else {}))
            rows += got["results"]["bindings"]
            token = got.get("next")
            if token is None:
                break
        assert sorted(r["o"]["value"] for r in rows) == ["http://e/cat", "http://e/dog", "http://e/snake"]
        assert ask(query="ASK { :alice :own :cat }")["boolean"] is True
        assert len(ask(query="CONSTRUCT { ?o :of ?p } WHERE { ?p :own ?o }")["triples"]) == 2
        for bad in ({"query": "nonsense"}, {"query": "SELECT * { ?p :own ?o }", "token": "x"}):
            with pytest.raises(urllib.error.HTTPError) as e:
                ask(**bad)
            assert e.value.code == 400
        server.shutdown()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from graphloom import __main__ as cli

    (tmp_path / "a.nt").write_text("<http://e/a> <http://e/p> <http://e/b> .\n<http://e/a> <http://e/p> \"x\" .\n")
    cli.main(["load", str(tmp_path / "a.nt"), str(tmp_path / "db")])
    cli.main(["query", str(tmp_path / "db"), "SELECT ?o { ?s ?p ?o }", "--limit", "1"])
    out = json.loads(capsys.readouterr().out)
    assert len(out["results"]["bindings"]) == 1 and out["next"]


def _norm(v):
    return format(v, ".9g") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_catalogue_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem documents labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TINY}/{t}.parquet'")
    df = catalogue.queries()[name](spark, TINY)
    cols = sorted(df.columns)
    found = con.execute(catalogue.oracle_sql()[name])
    assert cols == sorted(d[0] for d in found.description)
    at = [[d[0] for d in found.description].index(c) for c in cols]
    assert sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(_norm(r[i]) for i in at) for r in found.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 1500
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert short([("<http://e/a>",)]) == [("a",)]
