"""Query expressions as columns. An error in an expression is a null, as the three-valued logic wants it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.functions import terms
from graphloom.functions.terms import NUMERIC, XSD


@dataclass(frozen=True)
class Val:
    """A column and what it holds: num, str, bool, time, iri (an IRI in angle brackets), or term (any, in N-Triples form)."""

    col: Column
    kind: str


#: Functions added by users: name or IRI -> function of Vals.
REGISTRY: dict[str, Callable[..., Val]] = {}


def register(name: str) -> Callable[[Callable[..., Val]], Callable[..., Val]]:
    """Make a function callable in queries by a name or an IRI in angle brackets."""

    def add(f: Callable[..., Val]) -> Callable[..., Val]:
        REGISTRY[name if name.startswith("<") else name.upper()] = f
        return f

    return add


def null_() -> Val:
    return Val(F.lit(None).cast("string"), "any")


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "num" if isinstance(t, T.NumericType) else "str"


def num(v: Val) -> Column:
    match v.kind:
        case "num":
            return v.col
        case "term":
            return terms.number(v.col)
        case "any":
            return v.col.cast("double")
    return F.lit(None).cast("double")


def text(v: Val) -> Column:
    """STR(): lexical form of a literal, or an IRI without brackets."""
    match v.kind:
        case "term":
            return F.when(~v.col.startswith("_:"), terms.lexical(v.col))
        case "iri":
            return F.substring(v.col, F.lit(2), F.length(v.col) - 2)
        case "time":
            return F.date_format(v.col, "yyyy-MM-dd'T'HH:mm:ss")
    return v.col.cast("string")


def string(v: Val) -> Column:
    """A string argument: null for what isn't a string literal."""
    if v.kind in ("str", "any"):
        return v.col
    if v.kind == "term":
        plain = terms.datatype(v.col).isin(XSD + "string", "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString")
        return F.when(plain, terms.lexical(v.col))
    return F.lit(None).cast("string")


def time(v: Val) -> Column:
    if v.kind == "time":
        return v.col
    return (terms.lexical(v.col) if v.kind == "term" else v.col.cast("string")).try_cast("timestamp_ntz")


def truth(v: Val) -> Column:
    """Effective boolean value."""
    match v.kind:
        case "bool":
            return v.col
        case "num":
            return (v.col != 0) & ~F.isnan(v.col.cast("double"))
        case "str":
            return v.col != ""
        case "term":
            kind, lex = terms.datatype(v.col), terms.lexical(v.col)
            n = terms.number(v.col)
            return F.when(kind == XSD + "boolean", lex.isin("true", "1")).when(kind == XSD + "string", lex != "").when(n.isNotNull(), (n != 0) & ~F.isnan(n))
        case "any":
            return v.col.cast("boolean")
    return F.lit(None).cast("boolean")


def as_term(v: Val) -> Column:
    """N-Triples form."""
    match v.kind:
        case "term" | "iri" | "any":
            return v.col.cast("string")
        case "num":
            d = v.col.cast("double")
            whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
            return F.when(whole, terms.typed(d.cast("long").cast("string"), "integer")).otherwise(terms.typed(d.cast("string"), "double"))
        case "bool":
            return terms.typed(v.col.cast("string"), "boolean")
        case "time":
            return terms.typed(text(v), "dateTime")
    return terms.quote(v.col)


def equal(a: Val, b: Val) -> Column:
    if "any" in (a.kind, b.kind):
        return F.lit(None).cast("boolean")
    if a.kind == "term" and b.kind == "term":
        same = a.col == b.col
        x, y = terms.number(a.col), terms.number(b.col)
        return F.when(same, True).when(x.isNotNull() & y.isNotNull(), x == y).otherwise(same)
    if b.kind == "term":
        a, b = b, a
    if a.kind == "term":
        if b.kind in ("iri", "str"):
            return a.col == as_term(b)
        if b.kind == "bool":
            return F.when(terms.datatype(a.col) == XSD + "boolean", truth(a) == b.col)
        return num(a) == num(b) if b.kind == "num" else time(a) == b.col
    if a.kind == b.kind:
        return a.col == b.col
    if "time" in (a.kind, b.kind) and "str" in (a.kind, b.kind):
        return time(a) == time(b)
    if "iri" in (a.kind, b.kind):
        return F.when(a.col.isNotNull() & b.col.isNotNull(), False)
    return F.lit(None).cast("boolean")


def _ordered(a: Val, b: Val) -> tuple[Column, Column] | None:
    """What < and > compare; null sides where the types can't be ordered."""
    kinds = {a.kind, b.kind}
    if kinds == {"term"}:
        # Numbers go by value; of other literals only strings and dates are ordered, both as written.
        x, y = terms.number(a.col), terms.number(b.col)
        return (F.struct(x.isNull().alias("k"), x.alias("n"), F.when(x.isNull(), terms.lexical(a.col)).alias("s")), F.struct(y.isNull().alias("k"), y.alias("n"), F.when(y.isNull(), terms.lexical(b.col)).alias("s")))
    if "num" in kinds:
        return num(a), num(b)
    if "time" in kinds:
        return time(a), time(b)
    if kinds <= {"str", "term"}:
        return string(a), string(b)
    return (a.col, b.col) if a.kind == b.kind and a.kind != "any" else None


def _less(a: Val, b: Val) -> Column:
    sides = _ordered(a, b)
    if sides is None:
        return F.lit(None).cast("boolean")
    out = sides[0] < sides[1]
    if a.kind == b.kind == "term":
        out = F.when(a.col.startswith('"') & b.col.startswith('"') & (sides[0]["k"] == sides[1]["k"]), out)
    return out


def _unary(f: Callable[[Column], Column], take: Callable[[Val], Column], kind: str) -> Callable[[Val], Val]:
    return lambda v: Val(f(take(v)), kind)


def _round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def _cast(kind: str, to: str) -> Callable[[Val], Val]:
    def f(v: Val) -> Val:
        if to == "boolean":
            return Val(truth(v) if v.kind in ("bool", "num") else F.when(text(v).isin("true", "1"), True).when(text(v).isin("false", "0"), False), "bool")
        source = v.col if v.kind in ("num", "time") else text(v)
        if to == "bigint" and v.kind not in ("num",):
            source = source.try_cast("double")
        return Val(source.try_cast(to), kind)

    return f


def _kinds(*names: str) -> Callable[[Val], Val]:
    def f(v: Val) -> Val:
        if v.kind == "term":
            return Val(terms.term_kind(v.col).isin(*names), "bool")
        own = "iri" if v.kind == "iri" else "literal"
        return Val(F.when(v.col.isNotNull(), F.lit(own in names)), "bool")

    return f


def _before(s: Val, x: Val) -> Val:
    a, b = string(s), string(x)
    return Val(F.when(F.instr(a, b) > 0, F.substring(a, F.lit(1), F.instr(a, b) - 1)).when(a.isNotNull() & b.isNotNull(), ""), "str")


def _after(s: Val, x: Val) -> Val:
    a, b = string(s), string(x)
    return Val(F.when(F.instr(a, b) > 0, F.substring(a, F.instr(a, b) + F.length(b), F.length(a))).when(a.isNotNull() & b.isNotNull(), ""), "str")


def _substring(s: Val, start: Val, length: Val | None = None) -> Val:
    a = string(s)
    return Val(F.substring(a, num(start).cast("int"), num(length).cast("int") if length else F.length(a)), "str")


def _pattern(p: Val, flags: Val | None) -> Column:
    return F.concat(F.lit("(?"), string(flags), F.lit(")"), string(p)) if flags else string(p)


def _datatype(v: Val) -> Val:
    if v.kind == "term":
        return Val(F.concat(F.lit("<"), terms.datatype(v.col), F.lit(">")), "iri")
    name = {"str": "string", "bool": "boolean", "time": "dateTime", "num": "double"}.get(v.kind)
    return Val(F.when(v.col.isNotNull(), F.lit(f"<{XSD}{name}>")), "iri") if name else null_()


def _lang_matches(tag: Val, rng: Val) -> Val:
    a, b = F.lower(string(tag)), F.lower(string(rng))
    return Val(F.when(b == "*", a != "").otherwise((a == b) | a.startswith(F.concat(b, F.lit("-")))), "bool")


FUNCTIONS: dict[str, Callable[..., Val]] = {
    "BOUND": lambda v: Val(v.col.isNotNull(), "bool"),
    "STR": lambda v: Val(text(v), "str"),
    "LANG": lambda v: Val(terms.language(v.col) if v.kind == "term" else F.when(v.col.isNotNull(), ""), "str"),
    "DATATYPE": _datatype,
    "IRI": lambda v: v if v.kind == "iri" else Val(F.concat(F.lit("<"), text(v), F.lit(">")), "iri"),
    "URI": lambda v: FUNCTIONS["IRI"](v),
    "BNODE": lambda v=None: Val(F.concat(F.lit("_:"), F.uuid() if v is None else F.md5(text(v))), "term"),
    "STRDT": lambda s, d: Val(F.concat(terms.quote(string(s)), F.lit("^^"), as_term(d)), "term"),
    "STRLANG": lambda s, t: Val(F.concat(terms.quote(string(s)), F.lit("@"), F.lower(string(t))), "term"),
    "UUID": lambda: Val(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")), "iri"),
    "STRUUID": lambda: Val(F.uuid(), "str"),
    "ISIRI": _kinds("iri"), "ISURI": _kinds("iri"), "ISBLANK": _kinds("bnode"), "ISLITERAL": _kinds("literal"),
    "ISNUMERIC": lambda v: Val(F.when(v.col.isNotNull(), F.lit(True) if v.kind == "num" else terms.number(v.col).isNotNull() if v.kind == "term" else F.lit(False)), "bool"),
    "SAMETERM": lambda a, b: Val(as_term(a) == as_term(b), "bool"),
    "STRLEN": _unary(F.char_length, string, "num"),
    "UCASE": _unary(F.upper, string, "str"), "LCASE": _unary(F.lower, string, "str"),
    "SUBSTR": _substring,
    "STRSTARTS": lambda a, b: Val(F.startswith(string(a), string(b)), "bool"),
    "STRENDS": lambda a, b: Val(F.endswith(string(a), string(b)), "bool"),
    "CONTAINS": lambda a, b: Val(F.contains(string(a), string(b)), "bool"),
    "STRBEFORE": _before, "STRAFTER": _after,
    "CONCAT": lambda *v: Val(F.concat(*[string(x) for x in v]), "str"),
    "REGEX": lambda a, p, f=None: Val(F.regexp_like(string(a), _pattern(p, f)), "bool"),
    "REPLACE": lambda a, p, r, f=None: Val(F.regexp_replace(string(a), _pattern(p, f), string(r)), "str"),
    "ENCODE_FOR_URI": lambda v: Val(F.replace(F.replace(F.url_encode(string(v)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), "str"),
    "LANGMATCHES": _lang_matches,
    "ABS": _unary(F.abs, num, "num"), "ROUND": _unary(_round, num, "num"), "CEIL": _unary(F.ceil, num, "num"), "FLOOR": _unary(F.floor, num, "num"),
    "RAND": lambda: Val(F.rand(), "num"),
    "NOW": lambda: Val(F.localtimestamp(), "time"),
    "YEAR": _unary(F.year, time, "num"), "MONTH": _unary(F.month, time, "num"), "DAY": _unary(F.day, time, "num"),
    "HOURS": _unary(F.hour, time, "num"), "MINUTES": _unary(F.minute, time, "num"), "SECONDS": _unary(F.second, time, "num"),
    "TZ": lambda v: Val(F.regexp_extract(text(v), r"(Z|[+-]\d\d:\d\d)$", 1), "str"),
    "TIMEZONE": lambda v: Val(F.when(FUNCTIONS["TZ"](v).col != "", F.when(FUNCTIONS["TZ"](v).col == "Z", "PT0S").otherwise(F.regexp_replace(FUNCTIONS["TZ"](v).col, r"\+?(-?)0?(\d+):(\d\d)", "$1PT$2H"))), "str"),
    "MD5": lambda v: Val(F.md5(string(v).cast("binary")), "str"), "SHA1": lambda v: Val(F.sha1(string(v).cast("binary")), "str"),
    "SHA256": lambda v: Val(F.sha2(string(v).cast("binary"), 256), "str"), "SHA384": lambda v: Val(F.sha2(string(v).cast("binary"), 384), "str"), "SHA512": lambda v: Val(F.sha2(string(v).cast("binary"), 512), "str"),
}
for _name in NUMERIC:
    FUNCTIONS[f"<{XSD}{_name}>"] = _cast("num", "double" if _name in ("double", "float") else "decimal(38,18)" if _name == "decimal" else "bigint")
FUNCTIONS |= {f"<{XSD}string>": lambda v: Val(text(v), "str"), f"<{XSD}boolean>": _cast("bool", "boolean"), f"<{XSD}dateTime>": _cast("time", "timestamp_ntz"), f"<{XSD}date>": _cast("time", "date")}


def _common(values: list[Val]) -> list[Val]:
    """The same values in one kind: their own if they share it, else terms."""
    kinds = {v.kind for v in values} - {"any"}
    if len(kinds) <= 1:
        return [Val(v.col, kinds.pop() if kinds else "any") for v in values] if kinds else values
    return [Val(as_term(v), "term") for v in values]


def const(term: str, as_terms: bool) -> Val:
    kind, lex, datatype, lang = terms.parts(term)
    if kind == "iri":
        return Val(F.lit(term), "iri")
    name = (datatype or "").removeprefix(XSD)
    if kind != "literal" or lang or (as_terms and datatype and name not in (*NUMERIC, "boolean")):
        return Val(F.lit(term), "term") if as_terms or kind != "literal" else Val(F.lit(lex), "str")
    if name in ("dateTime", "date"):
        return Val(F.lit(lex).cast("timestamp_ntz"), "time")
    value = terms.native(term)
    return Val(F.lit(value), "bool" if isinstance(value, bool) else "str" if isinstance(value, str) else "num")


def compile_expr(e: tuple, env: Callable[[str], Val], as_terms: bool) -> Val:
    """env gives the value of a variable; as_terms: whether the dataset holds terms rather than native values."""
    go = lambda x: compile_expr(x, env, as_terms)
    op = e[0]
    match op:
        case "var":
            return env(e[1])
        case "const":
            return const(e[1], as_terms)
        case "||":
            return Val(truth(go(e[1])) | truth(go(e[2])), "bool")
        case "&&":
            return Val(truth(go(e[1])) & truth(go(e[2])), "bool")
        case "!":
            return Val(~truth(go(e[1])), "bool")
        case "=":
            return Val(equal(go(e[1]), go(e[2])), "bool")
        case "!=":
            return Val(~equal(go(e[1]), go(e[2])), "bool")
        case "<":
            return Val(_less(go(e[1]), go(e[2])), "bool")
        case ">":
            return Val(_less(go(e[2]), go(e[1])), "bool")
        case "<=":
            return Val(~_less(go(e[2]), go(e[1])), "bool")
        case ">=":
            return Val(~_less(go(e[1]), go(e[2])), "bool")
        case "in":
            own, out = go(e[1]), F.lit(False)
            for x in e[2]:
                out = out | equal(own, go(x))
            return Val(out, "bool")
        case "+" | "-" | "*" | "/":
            a, b = num(go(e[1])), num(go(e[2]))
            if op == "/":
                return Val(F.try_divide(a.cast("double"), b.cast("double")), "num")
            return Val({"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op](a, b), "num")
        case "neg":
            return Val(-num(go(e[1])), "num")
        case "call":
            name, args = e[1], e[2:]
            if name == "COALESCE":
                values = _common([go(x) for x in args])
                return Val(F.coalesce(*[v.col for v in values]), values[0].kind)
            if name == "IF":
                yes, no = _common([go(args[1]), go(args[2])])
                t = truth(go(args[0]))
                return Val(F.when(t, yes.col).when(~t, no.col), yes.kind)
            f = REGISTRY.get(name) or FUNCTIONS.get(name)
            if f is None:
                raise ValueError(f"unknown function {name}")
            return f(*[go(x) for x in args])
    raise ValueError(f"unknown expression {op}")
