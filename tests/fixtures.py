"""Small RDF graphs."""

from graphloom.sources.dataset import TripleStore

P = {"": "http://e/", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def term(x):
    return x if x[0] in '<"_' else f"<http://e/{x}>"


def rows(text):
    return [tuple(term(x) for x in line.split("|")) for line in text.strip().splitlines()]


def store(spark, triples="", quads="", name="t"):
    t = spark.createDataFrame(rows(triples), "s string, p string, o string") if triples else None
    q = spark.createDataFrame(rows(quads), "g string, s string, p string, o string") if quads else None
    return TripleStore.from_terms(spark, t, q, name)


CITIES = "\n".join(f"City{a}|parentCountry|Country{b}" for a, b in [(0, 6), (100, 2), (101, 2), (102, 17), (103, 3), (104, 1), (105, 0), (106, 10), (107, 23), (108, 1)])
CITY_QUADS = "graphA|City0|parentCountry|Country6\ngraphA|City100|parentCountry|Country2\ngraphA|City101|parentCountry|Country2\ngraphB|City102|parentCountry|Country17"
PETS = "alice|address|nantes\nbob|address|paris\ncarol|address|nantes\nalice|own|cat\nalice|own|dog\nalice|own|snake"


def bag(df):
    return sorted([tuple(r) for r in df.collect()], key=repr)


def short(rows_):
    """Terms without the example prefix."""
    return sorted([tuple(None if x is None else x.replace("<http://e/", "").rstrip(">") if x.startswith("<") else x for x in r) for r in rows_], key=repr)
