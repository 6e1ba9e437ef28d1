"""RDF terms in N-Triples form, in Python and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"
#: The numeric datatypes.
NUMERIC = ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "unsignedInt", "unsignedLong")
_ESCAPE = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def iri(value: str) -> str:
    return f"<{value}>"


def literal(lex: str, datatype: str | None = None, lang: str | None = None) -> str:
    body = '"' + "".join(_ESCAPE.get(c, c) for c in lex) + '"'
    if lang:
        return f"{body}@{lang.lower()}"
    return body if datatype in (None, XSD + "string") else f"{body}^^<{datatype}>"


_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^<([^>]*)>)?', re.S)


def parts(term: str) -> tuple[str, str, str | None, str | None]:
    """(kind, lexical form, datatype, language); kind is iri, bnode, literal or triple."""
    if term.startswith("<<"):
        return "triple", term, None, None
    if term.startswith("<"):
        return "iri", term[1:-1], None, None
    if term.startswith("_:"):
        return "bnode", term[2:], None, None
    m = _LITERAL.fullmatch(term)
    if not m:
        raise ValueError(f"not a term: {term!r}")
    back = {v[1]: k for k, v in _ESCAPE.items()}
    return "literal", re.sub(r"\\(.)", lambda x: back.get(x[1], x[1]), m[1]), m[3], m[2]


def native(term: str) -> object:
    """A literal's value in Python: int, float, bool or str (dates stay strings)."""
    kind, lex, datatype, _ = parts(term)
    name = (datatype or "").removeprefix(XSD)
    if kind == "literal" and name in NUMERIC:
        return float(lex) if name in ("decimal", "double", "float") else int(lex)
    return lex == "true" if kind == "literal" and name == "boolean" else lex


# The same as columns.


def term_kind(t: Column) -> Column:
    return F.when(t.startswith("<<"), "triple").when(t.startswith("<"), "iri").when(t.startswith("_:"), "bnode").when(t.startswith('"'), "literal")


def lexical(t: Column) -> Column:
    body = F.regexp_extract(t, r'(?s)^"((?:[^"\\]|\\.)*)"', 1)
    plain = F.replace(F.replace(F.replace(F.replace(F.replace(body, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\\r"), F.lit("\r")), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return F.when(t.startswith('"'), F.when(body.contains("\\"), plain).otherwise(body)).when(t.startswith("<<"), t).when(t.startswith("<"), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(F.substring(t, F.lit(3), F.length(t)))


def datatype(t: Column) -> Column:
    """Datatype IRI of a literal; null for others."""
    named = F.regexp_extract(t, r'"\^\^<([^>]*)>$', 1)
    tagged = t.rlike(r'"@[\w-]+$')
    return F.when(t.startswith('"'), F.when(named != "", named).when(tagged, "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString").otherwise(XSD + "string"))


def language(t: Column) -> Column:
    return F.when(t.startswith('"'), F.regexp_extract(t, r'"@([\w-]+)$', 1))


def number(t: Column) -> Column:
    """Value of a numeric literal, else null."""
    return F.when(datatype(t).isin([XSD + n for n in NUMERIC]), lexical(t).try_cast("double"))


def quote(lex: Column) -> Column:
    escaped = lex
    for a, b in _ESCAPE.items():
        escaped = F.replace(escaped, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def typed(lex: Column, name: str) -> Column:
    return F.concat(quote(lex), F.lit(f"^^<{XSD}{name}>"))


def node_id(t: Column) -> Column:
    """The id of a term: its 64-bit hash, the same on every machine and in every load."""
    return F.xxhash64(t)
