"""The SPARQL engine on small quads."""

import pytest

from quadrille.model import FlatQuads, quads_of
from quadrille.sparql.engine import Engine
from quadrille.sparql.parser import XSD, SparqlError, parse, parse_update

I, S = XSD + "integer", XSD + "string"
X = "http://x/"


@pytest.fixture(scope="module")
def eng(spark):
    rows = [("full", "http://g/1", X + s, X + p, o, k, d) for s, p, o, k, d in [
        ("a", "next", X + "b", "iri", ""), ("b", "next", X + "c", "iri", ""), ("c", "next", X + "a", "iri", ""), ("c", "next", X + "d", "iri", ""),
        ("a", "v", "3", "lit", I), ("b", "v", "10", "lit", I), ("c", "v", "7", "lit", XSD + "double"), ("d", "l", "dee", "lit", S), ("a", "l", "ay", "lit", S),
        ("a", "t", "2024-01-01T00:00:00Z", "lit", XSD + "dateTime"), ("b", "t", "2024-01-01T01:00:00+01:00", "lit", XSD + "dateTime"), ("e", "bad", "x", "lit", I),
    ]]
    rows += [("other", "http://g/2", X + "a", X + "next", X + "z", "iri"), ("other", "http://g/2", "_:b1", X + "next", X + "a", "iri"), ("full", "http://g/1", X + "a", X + "name", "ami", "lit", XSD + "x", "fr"), ("full", "http://g/1", X + "a", X + "name", "friend", "lit", XSD + "x", "en")]
    return Engine(spark, FlatQuads(quads_of(spark, rows)), prefixes={"": X})


CASES = [
    ("SELECT ?y { :a :next+ ?y }", "a b c d z"),
    ("SELECT ?y { GRAPH <http://g/1> { :a :next+ ?y } }", "a b c d"),
    ("SELECT ?y { GRAPH ?g { :b :next+ ?y } }", "a b c d"),
    ("SELECT ?y { :d :next* ?y }", "d"),
    ("SELECT ?y { :d :next? ?y }", "d"),
    ("SELECT ?x { ?x :next+ :d }", "a b c _:b1"),
    ("SELECT ?x { ?x (:next/:next)+ :d }", "a b c _:b1"),
    ("SELECT ?x { :d ^:next ?x }", "c"),
    ("SELECT ?x { ?x :v ?v FILTER(?v > 3) }", "b c"),
    ("SELECT ?x { ?x :v ?v FILTER(?v = 7.0) }", "c"),
    ("SELECT ?x { ?x :v ?v FILTER(?v IN (3, 10)) }", "a b"),
    ("SELECT ?x { ?x :v ?v FILTER(?v NOT IN (3, 10)) }", "c"),
    ("SELECT ?x { ?x :bad ?v FILTER(?v > 1) }", ""),
    ("SELECT ?x { ?x :bad ?v FILTER(!(?v > 1)) }", ""),
    ("SELECT ?x { ?x :bad ?v FILTER(?v > 1 || true) }", "e"),
    ("SELECT ?x { ?x :t ?t . ?y :t ?u FILTER(?t = ?u && ?x != ?y) }", "a b"),
    ("SELECT ?x { ?x :v ?v OPTIONAL { ?x :l ?l } FILTER(!BOUND(?l)) }", "b c"),
    ("SELECT ?x { ?x :v ?v FILTER NOT EXISTS { ?y :v ?w FILTER(?w > ?v) } }", "b"),
    ("SELECT ?x { ?x :v ?v FILTER NOT EXISTS { ?x :next ?y FILTER NOT EXISTS { ?y :v ?w FILTER(?w > ?v) } } }", ""),
    ("SELECT ?x { ?x :v ?v FILTER(EXISTS { ?x :next :d } || ?v = 3) }", "a c"),
    ("SELECT ?x { ?x :next ?y MINUS { ?x :l ?z } }", "_:b1 b c c"),
    ("SELECT ?x { ?x :next ?y MINUS { ?p :l ?q } }", "_:b1 a a b c c"),
    ("SELECT ?x { ?x :name ?n FILTER(LANG(?n) = 'fr') }", "a"),
    ("SELECT ?x { ?x :name 'ami'@fr }", ""),
    ("SELECT ?x { VALUES (?x ?n) { (:a UNDEF) (:b 1) } ?x :v ?v OPTIONAL { ?x :v ?n } }", "a b"),
    ("SELECT ?x { { ?x :l ?l } UNION { ?x :v ?v FILTER(?v = 7) } }", "a c d"),
    ("SELECT ?x { ?x :next [ :v 10 ] }", "a"),
    ("SELECT ?x { ?x !(:next|:v|^:next) ?o FILTER(isLITERAL(?o)) }", "a a a a d e b"),
    ("SELECT ?x { SERVICE <https://query.example.org/repo/other> { ?x :next ?y } }", "_:b1 a"),
    ("SELECT ?x { ?x :next ?y FILTER(isBLANK(?x)) }", "_:b1"),
    ("SELECT DISTINCT ?x { ?x :next ?y } ORDER BY DESC(?x) LIMIT 2", "b c"),
    ("SELECT ?x { { SELECT ?x (MAX(?v) AS ?m) { ?x :v ?v } GROUP BY ?x HAVING(MAX(?v) > 5) } }", "b c"),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_patterns(eng, text, want):
    got = sorted(r[0].removeprefix(X) for r in eng.query(text).collect())
    assert got == sorted(want.split())


def test_values_and_forms(spark, eng, rows):
    one = lambda e: eng.query(f"SELECT ({e} AS ?r) {{}}").first()[0]
    for e, want in {
        "STRLEN('héé')": "3", "UCASE('a')": "A", "SUBSTR('hello', 2, 3)": "ell", "STRBEFORE('a#b', '#')": "a", "STRAFTER('ab', '#')": "", "REPLACE('aXb', 'x', '-', 'i')": "a-b", "CONCAT('a', STR(1))": "a1",
        "ENCODE_FOR_URI('a b~*+é')": "a%20b~%2A%2B%C3%A9", "IF(1 < 2, 'y', 'n')": "y", "COALESCE(?z, 'd')": "d", "1 + 2 * 3": "7", "7 / 2": "3.5", "1 / 0": None, "ABS(-3)": "3", "ROUND(2.5)": "3", "CEIL(2.1)": "3", "-(2 + 3)": "-5",
        "YEAR('2024-05-06T07:08:09Z'^^<http://www.w3.org/2001/XMLSchema#dateTime>)": "2024", "MD5('a')": "0cc175b9c0f1b6a831c399e269772661", "<http://www.w3.org/2001/XMLSchema#integer>('42')": "42", "DATATYPE(1)": I, "LANGMATCHES('en-GB', 'en')": "true", "sameTerm(1, 1.0)": "false", "1 = 1.0": "true",
    }.items():
        assert one(e) == want, e
    assert rows(eng.query("SELECT (COUNT(*) AS ?n) (SUM(?v) AS ?s) (MIN(?v) AS ?l) (MAX(?v) AS ?h) (GROUP_CONCAT(STR(?v); separator=',') AS ?g) { ?x :v ?v }")) == [("3", "20", "3", "10", "10,3,7")]
    assert rows(eng.query("SELECT (COUNT(?x) AS ?n) (MAX(?x) AS ?m) (SUM(?x) AS ?s) { ?x :nothing ?y }")) == [("0", None, "0")]
    assert eng.query("ASK { :a :next :b }").first()[0] is True and eng.query("ASK { :a :next :q }").first()[0] is False
    assert rows(eng.query("CONSTRUCT { ?y :prev ?x } WHERE { ?x :next ?y FILTER(?x = :b) }").select("s", "p", "o")) == [(X + "c", X + "prev", X + "b")]
    assert eng.query("DESCRIBE :d").count() == 1
    assert eng.query("SELECT ?x ?n { ?x :name ?n }", terms=True).first().n.lang in ("fr", "en")
    assert eng.query("SELECT ?missing { ?x :v ?v }").first()[0] is None
    assert eng.query("SELECT * { ?x :v ?v }").columns == ["x", "v"]


def test_updates_change_nothing_in_place(spark, eng, rows):
    e = Engine(spark, eng.source, prefixes={"": X})
    before = e.query("SELECT ?x { ?x ?p ?o }").count()
    e.update("DELETE { GRAPH ?g { ?x :v ?v } } INSERT { GRAPH ?g { ?x :w ?v } } WHERE { GRAPH ?g { ?x :v ?v } FILTER(?v > 5) } ; INSERT DATA { GRAPH <http://g/3> { :q :v 1 . :q :v 1 } }")
    assert rows(e.query("SELECT ?x { ?x :v ?v }")) == [(X + "a",), (X + "q",)]
    assert e.query("SELECT ?x { ?x :w ?v }").count() == 2
    e.update("DELETE WHERE { GRAPH <http://g/3> { ?s ?p ?o } } ; DROP GRAPH <http://g/2>")
    assert e.query("SELECT ?x { ?x ?p ?o }").count() == before - 2
    assert eng.query("SELECT ?x { ?x :v ?v }").count() == 3
    e.update("DROP ALL")
    assert e.query("SELECT ?x { ?x ?p ?o }").count() == 0


@pytest.mark.parametrize("text", ["SELECT", "SELECT ?x { ?x ?y", "SELECT ?x { ?x no:prefix ?y }", "SELECT ?x { ?x :p ?y } LIMIT", "SELECT ?x { FILTER(FOO(?x)) }", "FROB { }", "SELECT ?x { ?x :p ?y . } garbage"])
def test_errors(eng, text):
    with pytest.raises((SparqlError, ValueError)):
        eng.query(text)


def test_parser_details():
    q = parse('PREFIX a: <http://x/> # comment\nSELECT ?s WHERE { ?s a a:T ; a:p "x\\ty"@EN-gb , """l"o"ng""" ; . }')
    assert [o[1] for _, _, o in q.where[0][1]] == ["http://x/T", "x\ty", 'l"o"ng']
    assert parse_update("CLEAR ALL")[0] == ("drop", None)


def test_star_is_one_scan(spark):
    from conftest import SF

    from quadrille.queries.reference import engine

    df = engine(spark, SF).query("SELECT ?c ?n ?b { ?c col:c_name ?n ; col:c_acctbal ?b ; col:c_mktsegment ?s }")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("FileScan") == 1
    cut = engine(spark, SF).query('SELECT ?c { ?c col:c_mktsegment "BUILDING" }')._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_mktsegment,BUILDING)" in cut and "c_name" not in cut
