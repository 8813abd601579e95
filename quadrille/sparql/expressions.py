"""SPARQL expressions as columns. An error is null; a filter keeps a row only if its condition is true."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadrille.functions.iri import encode_for_uri
from quadrille.model import node_term, term
from quadrille.sparql.parser import RDF, XSD, SparqlError

NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "long", "int", "short", "byte", "nonNegativeInteger", "positiveInteger", "nonPositiveInteger", "negativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte")]
INTEGRAL = [t for t in NUMERIC if t.rpartition("#")[2] not in ("decimal", "double", "float")]
DATED = [XSD + "dateTime", XSD + "date"]


@dataclass
class Val:
    """A column and what it holds: bool, int, num, str, iri (IRI or blank node), time, or term (any, as a struct)."""

    t: str
    c: Column


def number_text(c: Column) -> Column:
    return F.when((c == F.floor(c)) & (F.abs(c) < 1e15), c.cast("long").cast("string")).otherwise(c.cast("string"))


def time_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_term(x: Val) -> Column:
    if x.t == "term":
        return x.c
    if x.t == "iri":
        return node_term(x.c)
    if x.t == "bool":
        return term("lit", x.c.cast("string"), XSD + "boolean")
    if x.t == "int":
        return term("lit", x.c.cast("string"), XSD + "integer")
    if x.t == "num":
        return term("lit", number_text(x.c), F.when(x.c == F.floor(x.c), XSD + "integer").otherwise(XSD + "double"))
    if x.t == "time":
        return term("lit", time_text(x.c), XSD + "dateTime")
    return term("lit", x.c, XSD + "string")


def text(x: Val) -> Column:
    """The lexical form (STR)."""
    return x.c if x.t in ("str", "iri") else x.c["v"] if x.t == "term" else x.c.cast("string") if x.t in ("bool", "int") else number_text(x.c) if x.t == "num" else time_text(x.c)


def number(x: Val) -> Column:
    if x.t in ("int", "num"):
        return x.c
    if x.t == "term":
        return F.when(x.c["dt"].isin(NUMERIC), x.c["v"].try_cast("double"))
    return F.lit(None).cast("double")


def whole(x: Val) -> Column:
    """The value of an integer of up to 64 bits, which a double does not always hold; else null."""
    if x.t == "int":
        return x.c.cast("long")
    if x.t == "term":
        return F.when(x.c["dt"].isin(INTEGRAL), x.c["v"].try_cast("long"))
    return F.lit(None).cast("long")


def compare_numbers(f, a: Val, b: Val) -> Column:
    """Integers by their exact values, other numbers as doubles."""
    if "num" in (a.t, b.t):
        return f(number(a), number(b))
    if a.t == b.t == "int":
        return f(a.c, b.c)
    return F.when(whole(a).isNotNull() & whole(b).isNotNull(), f(whole(a), whole(b))).otherwise(f(number(a), number(b)))


def instant(x: Val) -> Column:
    if x.t == "time":
        return x.c
    if x.t == "term":
        return F.when(x.c["dt"].isin(DATED), x.c["v"].try_cast("timestamp"))
    return F.lit(None).cast("timestamp")


def boolean(x: Val) -> Column:
    """Effective boolean value."""
    if x.t == "bool":
        return x.c
    if x.t in ("int", "num"):
        return x.c != 0
    if x.t == "str":
        return F.length(x.c) > 0
    if x.t == "term":
        plain = F.when(x.c["dt"].isin(XSD + "string", RDF + "langString"), F.length(x.c["v"]) > 0)
        return F.when(x.c["dt"] == XSD + "boolean", x.c["v"].isin("true", "1")).when(x.c["dt"].isin(NUMERIC), number(x) != 0).otherwise(plain)
    return F.lit(None).cast("boolean")


def order_key(x: Val) -> Column:
    """Sorts unbound < blank nodes < IRIs < literals, numbers by value, other terms by code point."""
    t = to_term(x)
    rank = F.when(t["k"] == "bnode", 1).when(t["k"] == "iri", 2).when(t["dt"].isin(NUMERIC), 3).otherwise(4)
    return F.when(t.isNotNull(), F.struct(rank.alias("r"), F.coalesce(number(Val("term", t)), F.lit(0.0)).alias("n"), t["v"].alias("v")))


def compare(op: str, a: Val, b: Val) -> Column:
    ops = {"=": lambda x, y: x == y, "!=": lambda x, y: x != y, "<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}
    f = ops[op]
    kinds = {a.t, b.t}
    if kinds <= {"int", "num"} or kinds & {"int", "num"}:
        return compare_numbers(f, a, b)
    if "bool" in kinds:
        return f(boolean(a), boolean(b))
    if "time" in kinds:
        return f(instant(a), instant(b))
    if kinds == {"iri"} or kinds == {"str"}:
        return f(a.c, b.c)
    ta, tb = to_term(a), to_term(b)
    numbers = compare_numbers(f, Val("term", ta), Val("term", tb))
    ia, ib = instant(Val("term", ta)), instant(Val("term", tb))
    if op in ("=", "!="):
        return F.when(ta["dt"].isin(NUMERIC) & tb["dt"].isin(NUMERIC), numbers).when(ta["dt"].isin(DATED) & tb["dt"].isin(DATED), f(ia, ib)).otherwise(f(ta, tb))
    alike = (ta["k"] == tb["k"]) & (ta["dt"] == tb["dt"])
    return F.when(ta["dt"].isin(NUMERIC) & tb["dt"].isin(NUMERIC), numbers).when(ta["dt"].isin(DATED) & tb["dt"].isin(DATED), f(ia, ib)).when(alike, f(ta["v"], tb["v"]))


def comparable(x: Val) -> tuple[Column, Column]:
    """The class of terms that this one can be ordered with, and its place in it."""
    t = to_term(x)
    v = Val("term", t)
    kind = F.when(t["dt"].isin(NUMERIC), "number").when(t["dt"].isin(DATED), "time").otherwise(F.concat(t["k"], F.lit(" "), t["dt"]))
    return kind, F.struct(number(v).alias("n"), whole(v).alias("w"), instant(v).alias("i"), t["v"].alias("v"))


def like(result: Val, first: Val) -> Val:
    """A string result keeps the language of its first argument."""
    if first.t == "term":
        return Val("term", term("lit", result.c, F.when(first.c["lang"] != "", RDF + "langString").otherwise(XSD + "string"), first.c["lang"]))
    return result


def _pattern(x: Val, flags: Val | None) -> Column:
    return F.concat(F.lit("(?"), text(flags), F.lit(")"), text(x)) if flags else text(x)


def _cast(dt: str, x: Val) -> Val:
    s = text(x)
    if dt in (XSD + "integer", XSD + "long", XSD + "int"):
        return Val("int", F.coalesce(s.try_cast("long"), F.floor(s.try_cast("double")).cast("long")))
    if dt in NUMERIC:
        return Val("num", s.try_cast("double"))
    if dt == XSD + "boolean":
        return Val("bool", F.when(F.lower(s).isin("true", "1"), True).when(F.lower(s).isin("false", "0"), False))
    if dt in DATED:
        return Val("time", s.try_cast("timestamp"))
    if dt == XSD + "string":
        return Val("str", s)
    raise SparqlError(f"unknown function <{dt}>")


def call(name: str, a: list[Val]) -> Val:
    """A built-in function by its upper-case name, or a cast by its IRI."""
    if ":" in name:
        return _cast(name, a[0])
    s = lambda k: text(a[k])
    if name in ("STR",):
        return Val("str", s(0))
    if name in ("IRI", "URI"):
        return Val("iri", s(0))
    if name == "BOUND":
        return Val("bool", a[0].c.isNotNull())
    if name == "COALESCE":
        if len({x.t for x in a}) == 1:
            return Val(a[0].t, F.coalesce(*(x.c for x in a)))
        return Val("term", F.coalesce(*map(to_term, a)))
    if name == "IF":
        if a[1].t == a[2].t:
            return Val(a[1].t, F.when(boolean(a[0]), a[1].c).when(~boolean(a[0]), a[2].c))
        return Val("term", F.when(boolean(a[0]), to_term(a[1])).when(~boolean(a[0]), to_term(a[2])))
    if name == "CONCAT":
        return Val("str", F.concat(*(text(x) for x in a)) if a else F.lit(""))
    if name in ("ISIRI", "ISURI"):
        return Val("bool", to_term(a[0])["k"] == "iri")
    if name == "ISBLANK":
        return Val("bool", to_term(a[0])["k"] == "bnode")
    if name == "ISLITERAL":
        return Val("bool", to_term(a[0])["k"] == "lit")
    if name == "ISNUMERIC":
        return Val("bool", number(Val("term", to_term(a[0]))).isNotNull() & a[0].c.isNotNull())
    if name == "LANG":
        return Val("str", F.when(to_term(a[0])["k"] == "lit", to_term(a[0])["lang"]))
    if name == "DATATYPE":
        return Val("iri", F.when(to_term(a[0])["k"] == "lit", to_term(a[0])["dt"]))
    if name == "LANGMATCHES":
        return Val("bool", F.when(s(1) == "*", F.length(s(0)) > 0).otherwise((F.lower(s(0)) == F.lower(s(1))) | F.lower(s(0)).startswith(F.concat(F.lower(s(1)), F.lit("-")))))
    if name == "SAMETERM":
        return Val("bool", to_term(a[0]) == to_term(a[1]))
    if name == "STRDT":
        return Val("term", term("lit", s(0), s(1)))
    if name == "STRLANG":
        return Val("term", term("lit", s(0), RDF + "langString", F.lower(s(1))))
    texts = {"UCASE": F.upper, "LCASE": F.lower}
    if name in texts:
        return like(Val("str", texts[name](s(0))), a[0])
    if name == "STRLEN":
        return Val("int", F.length(s(0)).cast("long"))
    if name == "SUBSTR":
        start = number(a[1]).cast("int")
        return like(Val("str", F.substr(s(0), start, number(a[2]).cast("int")) if len(a) > 2 else F.substr(s(0), start)), a[0])
    if name == "CONTAINS":
        return Val("bool", F.contains(s(0), s(1)))
    if name == "STRSTARTS":
        return Val("bool", F.startswith(s(0), s(1)))
    if name == "STRENDS":
        return Val("bool", F.endswith(s(0), s(1)))
    if name in ("STRBEFORE", "STRAFTER"):
        at = F.instr(s(0), s(1))
        got = F.substr(s(0), F.lit(1), at - 1) if name == "STRBEFORE" else F.substr(s(0), at + F.length(s(1)))
        return like(Val("str", F.when(at > 0, got).otherwise(F.when(s(0).isNotNull() & s(1).isNotNull(), ""))), a[0])
    if name == "ENCODE_FOR_URI":
        return Val("str", encode_for_uri(s(0)))
    if name == "REGEX":
        return Val("bool", F.regexp(s(0), _pattern(a[1], a[2] if len(a) > 2 else None)))
    if name == "REPLACE":
        return like(Val("str", F.regexp_replace(s(0), _pattern(a[1], a[3] if len(a) > 3 else None), s(2))), a[0])
    hashes = {"MD5": F.md5, "SHA1": F.sha1, "SHA256": lambda c: F.sha2(c, 256), "SHA384": lambda c: F.sha2(c, 384), "SHA512": lambda c: F.sha2(c, 512)}
    if name in hashes:
        return Val("str", hashes[name](s(0)))
    if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
        f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + 0.5)}[name]
        n = number(a[0])
        return Val(a[0].t if a[0].t == "int" else "num", a[0].c if a[0].t == "int" and name != "ABS" else f(n).cast("long" if a[0].t == "int" else "double"))
    parts = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}
    if name in parts:
        return Val("int", parts[name](instant(a[0])).cast("long"))
    if name == "SECONDS":
        return Val("num", F.second(instant(a[0])).cast("double"))
    if name == "TZ":
        return Val("str", F.when(instant(a[0]).isNotNull(), F.regexp_extract(s(0), r"(Z|[+-]\d\d:\d\d)$", 1)))
    if name == "NOW":
        return Val("time", F.current_timestamp())
    if name == "RAND":
        return Val("num", F.rand())
    if name == "UUID":
        return Val("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))
    if name == "STRUUID":
        return Val("str", F.uuid())
    if name == "BNODE":
        return Val("iri", F.concat(F.lit("_:b"), F.sha2(s(0), 256) if a else F.uuid()))
    raise SparqlError(f"unknown function {name}")
