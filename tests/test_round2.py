"""Templates, datasets, joins on loose variables, extremes, text search, closure by jumps, loader, answers in pieces."""

import io
import random
import subprocess
import sys
from contextlib import redirect_stdout
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quadrille.model import FlatQuads, quads_of
from quadrille.operators.closure import best_below, closure
from quadrille.plans import reconcile, textsearch
from quadrille.plans.state import LoaderStatus
from quadrille.plans.templates import Template, TemplateError
from quadrille.sparql.engine import Engine
from quadrille.sparql.parser import XSD, SparqlError
from quadrille.streaming.loader import Loader, Reading, Schedule

X, I, S = "http://x/", XSD + "integer", XSD + "string"
CODE = "RA" + "t" * 43


@pytest.fixture(scope="module")
def eng(spark):
    rows = [("r", f"http://g/{g}", X + s, X + p, o if k == "lit" else X + o, k, d) for g, s, p, o, k, d in [
        (1, "a", "k", "u", "iri", ""), (1, "b", "k", "v", "iri", ""), (1, "c", "n", "1", "lit", I), (1, "a", "n", "5", "lit", I), (1, "b", "n", "9223372036854775806", "lit", I), (2, "a", "k", "u", "iri", ""),
        (2, "u", "w", "9223372036854775807", "lit", I), (2, "v", "w", "4", "lit", I), (2, "v", "w", "8", "lit", I), (3, "u", "t", "find me here, find", "lit", S), (3, "v", "t", "nothing to see", "lit", S), (3, "u", "l", "me", "lit", S), (3, "e", "w", "x", "lit", I),
    ]]
    return Engine(spark, FlatQuads(quads_of(spark, rows)), prefixes={"": X})


CASES = [
    ("SELECT ?x FROM <http://g/none> { ?x :k ?y }", ""),
    ("SELECT ?x { ?x :k ?y }", "a a b"),
    ("SELECT ?x FROM <http://g/1> FROM <http://g/2> { ?x :k ?y }", "a b"),
    ("SELECT ?x FROM <http://g/1> { GRAPH ?g { ?x :k ?y } }", ""),
    ("SELECT ?x FROM NAMED <http://g/2> { GRAPH ?g { ?x :k ?y } }", "a"),
    ("SELECT ?x FROM NAMED <http://g/2> { ?x :k ?y }", ""),
    ("SELECT ?x FROM <http://g/1> FROM NAMED <http://g/2> { ?x :k ?y GRAPH <http://g/2> { ?y :w ?z } }", "a b b"),
    ("SELECT ?x FROM NAMED <http://g/2> { GRAPH <http://g/1> { ?x :k ?y } }", ""),
    ("SELECT ?y FROM <http://g/1> { :a :k+ ?y }", "u"),
    ("SELECT ?x { ?x :n ?n OPTIONAL { ?x :k ?y } OPTIONAL { ?y :w ?z } }", "a a b b c c c c"),
    ("SELECT ?x { ?x :n ?n OPTIONAL { GRAPH <http://g/1> { ?x :k ?y } } MINUS { ?y :w 4 } }", "a c"),
    ("SELECT ?x { ?x :n ?n OPTIONAL { GRAPH <http://g/1> { ?x :k ?y } } { SELECT ?y { ?y :w 8 } } }", "b c"),
    ("SELECT ?x { ?x :n ?n FILTER EXISTS { GRAPH <http://g/1> { ?x :k ?y } } }", "a b"),
    ("SELECT ?x { ?x :n ?n . FILTER NOT EXISTS { ?x :k ?y . ?y :w ?w FILTER(?w > ?n) } }", "b c"),
    ("SELECT ?x { ?x :n ?n . ?x :k ?y FILTER EXISTS { ?y :w ?w FILTER(?w <= ?n) } }", "b"),
    ("SELECT ?x { ?x :n ?n FILTER(?n < 9223372036854775807) }", "a b c"),
    ("SELECT ?x { ?x :n ?n . ?y :w ?w FILTER(?n = ?w) }", ""),
    ("PREFIX q: <http://www.openrdf.org/contrib/lucenesail#> SELECT ?x { ?x q:matches [ q:query 'find me' ] }", "u u"),
    ("PREFIX q: <http://www.openrdf.org/contrib/lucenesail#> SELECT ?x { ?x q:matches [ q:query 'me' ; q:property :l ; q:score ?s ] }", "u"),
    ("PREFIX q: <http://www.openrdf.org/contrib/lucenesail#> SELECT ?x { ?y q:matches [ q:query 'find' ; q:snippet ?z ] . ?x :k ?y }", "a a"),
    ("PREFIX q: <http://www.openrdf.org/contrib/lucenesail#> SELECT ?x { ?x q:matches [ q:query '...' ] }", ""),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_queries(eng, text, want):
    assert sorted((r[0] or "").removeprefix(X) for r in eng.query(text).collect()) == want.split()


def test_plans_without_nested_loops(eng):
    out = io.StringIO()
    with redirect_stdout(out):
        eng.query("SELECT ?x { ?x :n ?n OPTIONAL { ?x :k ?y } { SELECT ?x ?y { ?y :w ?z . ?x :k ?y } } }").explain("formatted")
        eng.query("SELECT ?x { ?x :n ?n FILTER NOT EXISTS { ?x :k ?y . ?y :w ?w FILTER(?w > ?n) } }").explain("formatted")
    assert "NestedLoop" not in out.getvalue() and "Cartesian" not in out.getvalue()


def test_search_needs_a_constant(eng):
    with pytest.raises(SparqlError):
        eng.query("PREFIX q: <http://www.openrdf.org/contrib/lucenesail#> SELECT ?x { ?x q:matches [ q:query ?y ] }")


def test_values_stay_values():
    t = Template(CODE, "q", """SELECT * { ?s :a ?_a ; :b ?_b ; :c "?_a" ; :d <http://x/?_a> . VALUES ?__m_multi {} # ?_z
      ?s :e ?__m_multi , ?__opt }""")  # fmt: skip
    assert [p.name for p in t.parameters] == ["a", "b", "m", "opt"]
    out = t.expand({"a": "see ?_b and $__m_multi", "b": '" } DROP ALL #', "m": ["?_a", "x"]})
    assert ':a "see ?_b and $__m_multi" ; :b "\\" } DROP ALL #" ; :c "?_a" ; :d <http://x/?_a>' in out
    assert 'VALUES ?__m_multi { "?_a" "x" }' in out and "?__opt" in out
    assert "VALUES" not in t.expand({"a": "1", "b": "2"})
    for bad in ({"a": "1"}, {"a": ["1", "2"], "b": "2"}):
        with pytest.raises(TemplateError):
            t.expand(bad)


def test_stored_index(spark, rows, tmp_path):
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} all") for k in range(60)] + [(100, None), (101, "")], "id long, text string")
    index = textsearch.build_index(docs, "id", "text")
    textsearch.store_index(index, f"file://{tmp_path}/index")
    stored = textsearch.read_index(spark, f"file://{tmp_path}/index")
    want = rows(textsearch.search(index, "w1 W3", "id").select("id", F.round("score", 9)))
    assert rows(textsearch.search(stored, "w1 W3", "id").select("id", F.round("score", 9))) == want and want
    assert textsearch.search(stored, "", "id").count() == textsearch.search(stored, "absent", "id").count() == 0
    out = io.StringIO()
    with redirect_stdout(out):
        textsearch.search(stored, "w1", "id").explain("formatted")
    assert "PartitionFilters: [bucket" in out.getvalue().replace("isnotnull(bucket", "bucket")


@pytest.mark.parametrize("seed", range(3))
def test_jumps(spark, seed):
    """Forests and graphs with cycles: pairs, and the best of what reaches a node, as by walking."""
    rng = random.Random(seed)
    nxt = {k: rng.randint(0, k - 1) for k in range(1, 40) if rng.random() < 0.9}
    if seed == 2:
        nxt[0] = 30
    reach = {}
    for k in range(40):
        at, seen = k, []
        while at in nxt and nxt[at] not in seen:
            at = nxt[at]
            seen.append(at)
        reach[k] = set(seen)
    edges = spark.createDataFrame([*nxt.items(), *list(nxt.items())[:3], (None, 1), (2, None)], "src int, dst int")
    assert {tuple(r) for r in closure(edges).collect()} == {(k, v) for k, vs in reach.items() for v in vs}
    values = [(k, k % 2, rng.randint(0, 99)) for k in range(40)]
    got = best_below(edges, spark.createDataFrame(values, "node int, by int, val int"), ["by"])
    if seed == 2 and any(k in reach[k] for k in reach):
        assert got is None
        return
    want = {}
    for k, b, v in values:
        for n in reach[k] | {k}:
            want[n, b] = max(v, want.get((n, b), -1))
    assert {(r.node, r.by): r.val for r in got.collect()} == want
    assert best_below(edges.unionByName(spark.createDataFrame([(5, 39)], "src int, dst int")), edges.select(F.col("src").alias("node"), F.lit(1).alias("by"), F.lit(1).alias("val")), ["by"]) is None
    assert closure(edges.limit(0)).count() == 0


class Registry:
    """A feed in memory whose probe and sink fail on demand."""

    def __init__(self, spark):
        self.spark, self.n, self.setup, self.down, self.broken, self.got, self.now = spark, 10, 1, 0, 0, {}, 0.0

    def probe(self):
        if self.down:
            self.down -= 1
            raise OSError("no answer")
        return Reading(self.n, self.setup)

    def feed(self, low, high):
        return self.spark.range(low + 1, high + 1).select(F.col("id").alias("counter"))

    def sink(self, batch, epoch):
        self.got[epoch] = [r.counter for r in batch.collect()]
        if self.broken:
            self.broken -= 1
            raise OSError("lost")

    def loader(self, path):
        return Loader(LoaderStatus(self.spark, path), self.probe, self.feed, self.sink, self.got.clear, 4, 2, sleep=lambda s: setattr(self, "now", self.now + s), clock=lambda: self.now)


def test_loader(spark, tmp_path):
    r, path = Registry(spark), f"file://{tmp_path}/status"
    assert r.loader(path).tick() == "load" and sorted(sum(r.got.values(), [])) == list(range(0, 11))
    assert r.loader(path).tick() == "idle"
    r.n, r.broken = 13, 1  # a batch that fails once is repeated under its epoch
    assert r.loader(path).tick() == "load" and sorted(sum(r.got.values(), [])) == list(range(0, 14))
    r.n, r.broken = 15, 9  # one that keeps failing leaves the counter where it was
    with pytest.raises(OSError):
        r.loader(path).tick()
    r.broken = 0
    state = LoaderStatus(spark, path).state
    assert (state.load_counter, state.status) == (13, "loading_updates")
    l = r.loader(path)
    l.run(2.0, 3)
    assert LoaderStatus(spark, path).state.load_counter == 15 and sorted(sum(r.got.values(), [])) == list(range(0, 16))
    r.down = 6  # three failed probes open the breaker
    assert [l.tick() for _ in range(4)] == ["wait", "wait", "wait", "open"]
    r.now += 60
    r.setup, r.n = 2, 3
    assert l.tick() == "resync" and sorted(sum(r.got.values(), [])) == [0, 1, 2, 3]
    assert LoaderStatus(spark, path).state.setup_id == 2


def test_schedule():
    now, ran = [0.0], []

    def bad():
        raise ValueError

    s = Schedule({"a": (2, lambda: ran.append("a")), "b": (5, bad)}, lambda: now[0])
    assert s.run_due() == ["a", "b"] and isinstance(s.failed["b"], ValueError)
    now[0] = 2
    assert s.run_due() == ["a"]
    now[0] = 5
    assert s.run_due() == ["a", "b"] and ran == ["a"] * 3


def test_retro_pages_reach_all(spark, rows):
    n = spark.range(20).select(F.concat(F.lit("n"), "id").alias("np"), F.col("id").alias("load_number"), F.lit("2024-01-02").cast("timestamp").alias("loaded_at"), F.lit("k").alias("pubkey"), F.array().cast("array<string>").alias("types"))
    actual, now = spark.createDataFrame([], "repo string, np string"), F.lit("2024-01-02 10:00").cast("timestamp")
    whole = rows(reconcile.retro_sweep(n, actual, 15, now))
    pages, below = [], None
    while (end := reconcile.page_end(n, 15, now, limit=7, below=below)) is not None:
        pages += rows(reconcile.retro_sweep(n, actual, 15, now, limit=7, below=below))
        below = end
    assert sorted(pages) == whole and len({r[1] for r in whole}) == 16
    gate = reconcile.completion_gate(n, spark.createDataFrame([("meta", "n3")], "repo string, np string"), F.lit("2024-01-02 00:10").cast("timestamp"))
    assert gate.count() == 19
    assert reconcile.forward_sweep(n, actual, -1, None, F.lit("2024-01-02 00:10").cast("timestamp"))[0].count() == 0  # all still on their way


def test_answers_in_pieces(spark, eng, tmp_path):
    from quadrille.api import Api

    api = Api(spark, eng)
    q = "/repo/r?query=CONSTRUCT%20%7B%3Fa%20%3Chttp%3A%2F%2Fx%2Fk%3E%20%3Fb%7D%20WHERE%20%7B%3Fa%20%3Chttp%3A%2F%2Fx%2Fn%3E%20%3Fb%7D"
    status, media, body = api(q)
    assert (status, media) == (200, "application/n-triples") and len(body.splitlines()) == 3
    assert f'<{X}a> <{X}k> "5"^^<{I}> .' in body.splitlines()
    assert api(q + "&format=ttl")[1] == "text/turtle" and api(q + "&format=odd")[0] == 400
    assert "".join(api.stream(q)[2]) == body
    api.write(q, f"file://{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"file://{tmp_path}/out").collect()) == sorted(body.splitlines())
    api.write("/repo/r?query=SELECT%20%3Fa%20%7B%3Fa%20%3Chttp%3A%2F%2Fx%2Fn%3E%20%3Fb%7D", f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 3
    for path in ("/", "/page/meta", "/tools/full/yasgui.html"):
        assert api(path)[0] == 200 and api(path)[2].startswith("<html>")


def test_feed_from_another_folder(tmp_path):
    """The streaming source is planned by a worker that has neither this folder nor the package on its path."""
    root = Path(__file__).resolve().parent.parent
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from quadrille.session import build_session
from quadrille.streaming.feed import append_once, run_once
spark = build_session("feed", "2", 2)
spark.range(9).withColumnRenamed("id", "counter").write.parquet("file://{tmp_path}/src")
run_once(spark, "file://{tmp_path}/src/*.parquet", append_once("file://{tmp_path}/out", ["counter"]), "file://{tmp_path}/check", batch="4")
print("ROWS", spark.read.parquet("file://{tmp_path}/out").count())
"""
    out = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert "ROWS 9" in out.stdout, out.stderr[-3000:]
