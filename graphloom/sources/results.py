"""Query results as JSON in the SPARQL format, one binding for each row."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import terms
from graphloom.functions.exprs import as_term
from graphloom.sources.dataset import Dataset, Rel
from graphloom.streaming.paging import Page

#: What adds members to a page's JSON: functions of a page.
MODULES: list[Callable[[Page], dict]] = []


def term_json(t: Column) -> Column:
    """A term as the JSON of a binding; null for unbound."""
    lang, datatype = terms.language(t), terms.datatype(t)
    simple = datatype.isin(terms.XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
    return F.when(
        t.isNotNull(),
        F.struct(
            F.when(terms.term_kind(t) == "iri", "uri").otherwise(terms.term_kind(t)).alias("type"),
            terms.lexical(t).alias("value"),
            F.when(lang != "", lang).alias("xml:lang"),
            F.when(~simple, datatype).alias("datatype"),
        ),
    )


def bindings(data: Dataset, rel: Rel) -> DataFrame:
    """One JSON string (binding) for each solution; unbound variables are left out."""
    rel = data.decode(rel, rel.vars)
    columns = [term_json(as_term(data.value(rel, v))).alias(v) for v in rel.vars]
    return rel.df.select(F.to_json(F.struct(*columns)).alias("binding"))


def page_json(page: Page) -> str:
    """A page with its token under "next", if there is one."""
    rows = [{v: x for v, x in zip(page.columns, r) if x is not None} for r in page.rows]

    def one(x: object) -> dict:
        if isinstance(x, str) and x[:1] in ('"', "<", "_"):
            try:
                kind, lex, datatype, lang = terms.parts(x)
            except ValueError:
                return {"type": "literal", "value": x}
            return {"type": "uri" if kind == "iri" else kind, "value": lex} | ({"xml:lang": lang} if lang else {}) | ({"datatype": datatype} if datatype else {})
        return {"type": "literal", "value": str(x)}

    out = {"head": {"vars": page.columns}, "results": {"bindings": [{v: one(x) for v, x in r.items()} for r in rows]}}
    if page.token is not None:
        out["next"] = page.token
    for module in MODULES:
        out |= module(page)
    return json.dumps(out, ensure_ascii=False)


def boolean_json(value: bool) -> str:
    return json.dumps({"head": {}, "boolean": value})
