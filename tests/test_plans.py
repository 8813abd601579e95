"""Extraction, resolution, ingest, trust states, templates, state and the feed."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quadrille.functions.iri import parent_prefix, trusty_base
from quadrille.model import NS, FlatQuads, ns, quads_of
from quadrille.plans import ingest, listing, reconcile, resolve, templates, textsearch, trust
from quadrille.plans.extract import Extraction, gen
from quadrille.plans.resolve import ADMIN, ADMIN_PRED, EXT, MAINTAINER, MEMBER, OBSERVER, Resolver
from quadrille.plans.state import Breaker, EngineState, LoaderStatus, SnapshotStore, backoff, next_step
from quadrille.session import materialize
from quadrille.sources.rdf import content_of, nanopubs, parse_trig, read_nquads, read_trig
from quadrille.sparql.engine import Engine
from quadrille.sparql.parser import XSD

CODE = lambda c: "RA" + c * 43
NP = lambda c: "https://np.example.org/" + CODE(c)


def trig(c: str, assertion: str, info: str = "", key: str = "KEY") -> str:
    u = NP(c)
    return f"""@prefix this: <{u}> . @prefix sub: <{u}/> . @prefix np: <{NS["np"]}> . @prefix npx: <{NS["npx"]}> . @prefix dct: <{NS["dct"]}> . @prefix gen: <{NS["gen"]}> .
@prefix rdfs: <{NS["rdfs"]}> . @prefix owl: <{NS["owl"]}> . @prefix ex: <http://ex.org/> .
sub:head {{ this: a np:Nanopublication ; np:hasAssertion sub:assertion ; np:hasProvenance sub:provenance ; np:hasPublicationInfo sub:pubinfo . }}
sub:assertion {{ {assertion} }}
sub:provenance {{ sub:assertion rdfs:seeAlso <{NP("z")}> . }}
sub:pubinfo {{ this: dct:created "2024-01-0{1 + ord(c) % 9}T00:00:00Z"^^<{XSD}dateTime> ; rdfs:label "label {c}" ; dct:creator ex:me . sub:sig npx:hasPublicKey "{key}" ; npx:hasSignatureTarget this: ; npx:signedBy ex:me . {info} }}
"""


DOCS = {
    "a": trig("a", "<http://s.org/x/y> a gen:Space ; gen:hasAdmin ex:ann, ex:bob ; gen:isSubSpaceOf <http://s.org/x>, <http://s.org/x/y> ; owl:sameAs <http://alias.org/y> . <http://r.org/1> gen:isMaintainedBy <http://s.org/x/y> . ex:joe <http://www.wikidata.org/entity/P463> <http://s.org/x/y> .", "this: npx:hasNanopubType gen:Space ."),
    "b": trig("b", f"<http://s.org/x/y> a gen:Space ; gen:hasRootDefinition <{NP('a')}> ; gen:hasAdmin ex:cat ."),
    "c": trig("c", "<http://s.org/x/y> gen:hasRole ex:role ."),
    "d": trig("d", "sub:role a gen:SpaceMemberRole, gen:MemberRole ; gen:hasRegularProperty ex:knows ; gen:hasInverseProperty ex:known ."),
    "e": trig("e", "ex:kim ex:knows <http://s.org/x/y> . ex:lee ex:knows <http://s.org/x/y> . ex:lee ex:loves <http://s.org/x/y> .", "this: npx:hasNanopubType gen:RoleInstantiation . ex:knows a gen:RegularRoleProperty ."),
    "f": trig("f", "sub:p a gen:Preset ; gen:hasRole ex:role ; gen:appliesToInstancesOf gen:Space ; dct:isVersionOf ex:kind ."),
    "g": trig("g", "sub:as a gen:PresetAssignment, gen:DeactivatedPresetAssignment ; gen:isAssignmentOfPreset ex:kind ; gen:isAssignmentFor <http://s.org/x/y> ."),
    "h": trig("h", "sub:r a gen:RevokedRoleInstantiation ; gen:forSpace <http://s.org/x/y> ; gen:forAgent ex:kim ; gen:hasRole ex:role ."),
    "i": trig("i", "<http://s.org/x/y> gen:detachedRole ex:role ."),
    "j": trig("j", f"<{NP('c')}> npx:retracts <{NP('c')}> .", f"this: npx:supersedes <{NP('b')}> ; npx:introduces ex:thing ."),
}


@pytest.fixture(scope="module")
def pubs(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("trig")
    for c, t in DOCS.items():
        (d / f"{c}.trig").write_text(t)
    quads, _ = materialize(read_trig(spark, f"file://{d}"), "quads")
    n, content = nanopubs(quads)
    return quads, materialize(n, "nanopubs")[0], materialize(content, "content")[0]


def test_nanopubs_from_trig(pubs, rows):
    _, n, content = pubs
    assert n.count() == len(DOCS) and content.where("part = 'assertion'").count() == sum(len([q for q in parse_trig(t) if q[0].endswith("/assertion")]) for t in DOCS.values())
    a = n.where(F.col("np") == NP("a")).first()
    assert (a.pubkey, a.signer, a.label, a.creators, a.code) == ("KEY", "http://ex.org/me", "label a", ["http://ex.org/me"], CODE("a"))
    assert gen("hasRole") in n.where(F.col("np") == NP("c")).first().types


def test_extraction(pubs, rows):
    _, n, content = pubs
    x = Extraction(n, content)
    get = lambda df, *c: rows(df.select(*c))
    s, ex = "http://s.org/x/y", "http://ex.org/"
    assert get(x.space_refs(), "space", "root_np", "prefix") == [(s, NP("a"), "http://s.org/x")]
    assert get(x.definitions(), "np", "root_admin") == [(NP("a"), ex + "ann"), (NP("a"), ex + "bob"), (NP("b"), None)]
    grants = get(x.grants(), "np", "space", "agent", "dir", "pred")
    assert (NP("b"), s, ex + "cat", "inverse", gen("hasAdmin")) in grants and (NP("a"), s, ex + "joe", "regular", "http://www.wikidata.org/entity/P463") in grants
    assert [g for g in grants if g[0] == NP("e")] == [(NP("e"), s, ex + a, "regular", ex + "knows") for a in ("kim", "lee")]
    assert get(x.attachments(), "space", "role", "np") == [(s, ex + "role", NP("c"))]
    assert get(x.declarations(), "role", "role_type", "dir", "pred") == [(NP("d") + "/role", MEMBER, "inverse", ex + "known"), (NP("d") + "/role", MEMBER, "regular", ex + "knows")]
    assert get(x.subspaces(), "child", "parent") == [(s, "http://s.org/x")]
    assert get(x.aliases(), "canonical", "alias") == [(s, "http://alias.org/y")]
    assert get(x.preset_declarations(), "kind", "preset", "role", "applies_to") == [(ex + "kind", ex + "kind", ex + "role", gen("Space")), (ex + "kind", NP("f") + "/p", ex + "role", gen("Space"))]
    assert get(x.preset_assignments(), "preset", "resource", "active") == [(ex + "kind", s, False)]
    assert get(x.revocations(), "space", "agent", "role") == [(s, ex + "kim", ex + "role")]
    assert get(x.detachments(), "space", "role") == [(s, ex + "role")]
    assert set(x.tables()) <= set(EXT)
    assert all(set(c.split()[0] for c in EXT[k].split(", ")) <= set(df.columns) for k, df in x.tables().items())


def test_admin_quads(spark, pubs, rows):
    _, n, content = pubs
    q = ingest.admin_quads(n, content)
    j = q.where((F.col("s") == NP("j")) & ((F.col("g") == ingest.GRAPH) | (F.col("p") == ns("npa:refersToNanopub"))))
    has = lambda p: rows(j.where(F.col("p") == ns(p)).select("o"))
    assert has("npx:invalidates") == [(NP("b"),), (NP("c"),)] and has("npx:retracts") == [(NP("c"),)] and has("npx:supersedes") == [(NP("b"),)]
    assert has("npx:introduces") == [("http://ex.org/thing",)] and has("npa:artifactCode") == [(CODE("j"),)] and len(has("npa:hasGraph")) == 4
    assert (NP("z"),) in rows(j.where(F.col("p") == ns("npa:refersToNanopub")).select("o"))
    assert q.count() == q.distinct().count()
    text = ingest.filter_literals(n, content).where(F.col("np") == NP("a")).first().text
    assert text.startswith("_pubkey_") and "label a" in text
    ok, notes = ingest.accepted(n.unionByName(n.limit(1).withColumn("pubkey", F.lit(None).cast("string"))))
    assert ok.count() == len(DOCS) and [r.note for r in notes.collect()] == ["missing or invalid signature"]
    assert content_of(q.unionByName(pubs[0].withColumn("repo", F.lit("")).select(*q.columns)), NP("c")).where(F.col("s") == "http://s.org/x/y").count() == 1


def test_numbers_and_checksums(spark):
    rows = [("meta", NP(c), CODE(c), k) for k, c in enumerate("abcd")] + [("spaces", NP("a"), CODE("a"), 0)]
    df = spark.createDataFrame(rows, "repo string, np string, code string, counter long")
    n = {(r.repo, r.np[-1]): (r.load_number, r.load_checksum) for r in ingest.number(df).collect()}
    assert [n["meta", c][0] for c in "abcd"] == [0, 1, 2, 3] and n["spaces", "a"][0] == 1
    total = ingest.checksums(df, ["repo"]).where("repo = 'meta'").first()
    assert (total.np_count, total.checksum) == (4, n["meta", "d"][1])
    first, rest = df.where("counter < 2"), df.where("counter >= 2")
    heads = first.groupBy("repo").agg(F.count("*").alias("np_count"), *(F.bit_xor(c).alias(f"w{k}") for k, c in enumerate(ingest.code_words(F.col("code")))))
    assert n == {(r.repo, r.np[-1]): (r.load_number, r.load_checksum) for r in ingest.number(df, span=2).collect()}
    later = {(r.repo, r.np[-1]): (r.load_number, r.load_checksum) for r in ingest.number(rest, heads).collect()}
    assert later == {k: v for k, v in n.items() if k in later}
    again = ingest.fresh(df.unionByName(df), first)
    assert again.count() == 2


def test_iris(spark):
    cases = {"https://example.org/a/b/c/space": "https://example.org/a/b/c", "https://example.org/space": "https://example.org", "https://example.org/x/": "https://example.org", "https://example.org/a/space?q=1": "https://example.org/a", "https://example.org/a/space#f/g": "https://example.org/a", "https://example.org": None, "urn:a:b": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "c string").select("c", parent_prefix(F.col("c")).alias("p"))
    assert {r.c: r.p for r in df.collect()} == cases
    t = spark.createDataFrame([(x,) for x in (NP("a"), NP("a") + "/sub", NP("a") + "x", NP("a") + "#" + "y" * 44, CODE("a"))], "c string").select(trusty_base(F.col("c")).alias("b"))
    assert [r.b for r in t.collect()] == [NP("a"), NP("a"), None, None, None]


# -- spaces and roles

OLD, NEW = datetime(2024, 1, 1), datetime(2024, 2, 1)


class World:
    """Rows of the extraction for a space S with the references R1 (root admin dave) and R2 (root admin bob)."""

    def __init__(self, spark):
        self.spark, self.rows, self.n = spark, {k: [] for k in EXT}, 0
        self.put("acct", *[(a, f"k-{a}") for a in ("dave", "alice", "bob", "max", "mia", "zoe")])
        self.put("ref_iri", ("R1", "S", "P"), ("R2", "S", "P"))
        self.put("definition", ("R1", "d1", "dave"), ("R2", "d2", "bob"))
        for np in ("d1", "d2"):
            self.put("loads", (np, 0, "k-root"))
        self.put("declaration", ("maint", MAINTAINER, "regular", "maintains", "dm"), ("memb", MEMBER, "regular", "joins", "dj"), ("obs", OBSERVER, "inverse", "seen", "do"))

    def put(self, table, *rows):
        self.rows[table] += rows

    def say(self, table, by, *values, at=OLD, created=True):
        """A row published by someone in a nanopub of its own."""
        self.n += 1
        np = f"np{self.n}"
        self.put("loads", (np, self.n, f"k-{by}"))
        self.put(table, (f"x{self.n}", *values, f"k-{by}", np, *([at] if created else [])))
        return np

    def grant(self, by, agent, pred=ADMIN_PRED, dir_="inverse", at=OLD, space="S"):
        return self.say("grant", by, space, agent, dir_, pred, at=at)

    def invalidate(self, by, np):
        self.n += 1
        self.put("loads", (f"np{self.n}", self.n, f"k-{by}"))
        self.put("invalidates", (f"np{self.n}", np))

    def resolver(self, since=None):
        return Resolver(self.spark, {k: self.spark.createDataFrame(v, EXT[k]) for k, v in self.rows.items()}, since)


def pairs(df, *cols):
    return {tuple(r) for r in df.select(*cols).collect()}


def test_admin_closure_and_isolation(spark):
    w = World(spark)
    w.grant("dave", "alice")
    w.grant("alice", "max")
    w.grant("max", "mia")
    w.grant("bob", "zoe")
    w.grant("eve", "eve")
    gone = w.grant("dave", "ned")
    w.invalidate("dave", gone)
    void = w.grant("dave", "pat")
    w.invalidate("mallory", void)
    assert pairs(w.resolver().admins(), "ref", "agent") == {("R1", a) for a in ("alice", "max", "mia", "pat")} | {("R2", "zoe")}
    w.invalidate("root", "d1")  # the definition of R1 is dead
    assert pairs(w.resolver().admins(), "ref") == {("R2",)}


def test_admin_revocation(spark):
    w = World(spark)
    for a in ("alice", "dave", "max"):
        w.grant("dave", a)
    w.say("revocation", "dave", "S", "alice", ADMIN, at=NEW)
    w.say("revocation", "max", "S", "dave", ADMIN, at=NEW)  # a root admin is exempt
    w.say("revocation", "eve", "S", "max", ADMIN, at=NEW)  # nobody
    assert pairs(w.resolver().admins(), "agent") == {("dave",), ("max",), ("alice",)}  # dave himself becomes an admin in the same round
    w.grant("dave", "zoe")
    w.grant("max", "mia")
    w.say("revocation", "dave", "S", "mia", ADMIN, at=NEW)
    w.say("revocation", "zoe", "S", "zoe", ADMIN, at=NEW)  # may leave
    got = pairs(w.resolver().admins(), "agent")
    assert ("mia",) not in got and ("zoe",) not in got


def roles(w, **kw):
    return w.resolver(**kw).build()


def test_tiers_revocations_and_detachment(spark):
    w = World(spark)
    w.grant("dave", "dave")
    for role in ("maint", "memb", "obs"):
        w.say("attachment", "dave", "S", role)
    w.say("attachment", "eve", "S", "other")
    w.grant("dave", "max", "maintains", "regular")
    w.grant("max", "mia", "joins", "regular")
    w.grant("mia", "ann", "seen", "inverse")
    w.grant("zoe", "zoe", "seen", "inverse")  # observers name themselves
    w.grant("zoe", "joe", "joins", "regular")  # nobody may
    s = roles(w)
    assert pairs(s["role"], "ref", "agent", "role") == {("R1", "max", "maint"), ("R1", "mia", "memb"), ("R1", "ann", "obs"), ("R1", "zoe", "obs"), ("R2", "zoe", "obs")} - {("R2", "zoe", "obs")}
    assert pairs(s["attachment"], "ref", "role") == {("R1", r) for r in ("maint", "memb", "obs")}
    w.say("revocation", "max", "S", "mia", "memb", at=NEW)
    w.say("revocation", "eve", "S", "max", "maint", at=NEW)
    w.say("revocation", "zoe", "S", "zoe", "obs", at=OLD)  # on a tie the negative wins
    s = roles(w)
    assert pairs(s["role"], "agent") == {("max",), ("ann",)} - {("ann",)}  # ann's publisher is no member any more
    w.grant("max", "mia", "joins", "regular", at=NEW + timedelta(1))
    assert ("mia",) in pairs(roles(w)["role"], "agent")
    w.say("detachment", "dave", "S", "memb", at=NEW)
    assert ("memb",) not in pairs(roles(w)["attachment"], "role")
    assert {r.tier: r.n for r in resolve.totals(roles(w)).collect()}[ADMIN] == 1


def test_structure(spark):
    w = World(spark)
    w.put("ref_iri", ("RP", "P", None), ("RC", "C", "Q"))
    w.put("definition", ("RP", "d3", "bob"), ("RC", "d4", "dave"))
    for np in ("d3", "d4"):
        w.put("loads", (np, 0, "k-root"))
    w.grant("dave", "dave")
    w.grant("bob", "bob", space="P")
    w.grant("dave", "dave", space="C")
    w.grant("bob", "bob", space="C2")
    w.say("subspace", "dave", "S", "P", created=False)
    assert pairs(roles(w)["subspace"], "child") == set()  # dave is no admin of P
    w.say("subspace", "bob", "S", "P", created=False)
    s = roles(w)
    assert pairs(s["subspace"], "child_ref", "parent_ref") >= {("R1", "RP")} and pairs(s["prefix"], "child_ref") == set()
    assert ("R1", "isSubSpaceOf", "RP") in pairs(resolve.edges(s), "subject", "predicate", "object") and ("S", "isSubSpaceOf", "P") in pairs(resolve.edges(s), "subject", "predicate", "object")
    w.say("maintained", "dave", "res", "S", created=False)
    w.say("maintained", "eve", "res2", "S", created=False)
    s = roles(w)
    assert pairs(s["maintained"], "resource", "ref") == {("res", "R1")} and ("res", "hasGoverningSpaceRef", "R1") in pairs(resolve.edges(s), "subject", "predicate", "object")
    w.say("alias", "dave", "C", "A", created=False)
    assert pairs(roles(w)["alias"], "alias", "ref") == {("A", "RC")}
    w.put("ref_iri", ("RA", "A", None))
    w.put("definition", ("RA", "d5", "zoe"))
    w.put("loads", ("d5", 0, "k-root"))
    w.grant("zoe", "zoe", space="A")
    assert pairs(roles(w)["alias"], "alias") == set()  # a foreign admin of the alias blocks it


def test_presets(spark):
    w = World(spark)
    w.grant("dave", "dave")
    decl = lambda pd, role, at, to=gen("Space"): w.put("preset_decl", (pd, "kind", "kind", role, to, "n" + pd, at))
    decl("p1", "memb", OLD)
    decl("p2", "obs", NEW)
    np = w.say("preset_assign", "dave", "kind", "S", True)
    s = roles(w)
    assert pairs(s["attachment"], "ref", "role", "preset") == {("R1", "obs", "kind")} and s["stamp"].count() == 1
    w.invalidate("dave", np)
    assert roles(w)["attachment"].count() == 0
    w.say("preset_assign", "dave", "kind", "S", True, at=NEW)
    w.say("preset_assign", "dave", "kind", "S", False, at=NEW + timedelta(1))
    w.say("preset_assign", "eve", "kind", "S", True, at=NEW + timedelta(2))
    assert roles(w)["attachment"].count() == 0


@pytest.mark.parametrize("cut", [4, 7])
def test_incremental_equals_full(spark, cut):
    """A state built in two cycles is the state built at once."""
    w = World(spark)
    steps = [
        lambda: w.grant("max", "mia", "joins", "regular"), lambda: w.say("attachment", "dave", "S", "memb"), lambda: w.grant("dave", "max", "maintains", "regular"), lambda: w.say("attachment", "dave", "S", "maint"), lambda: w.say("subspace", "dave", "S", "P", created=False),
        lambda: w.grant("dave", "dave"), lambda: w.say("revocation", "max", "S", "mia", "memb", at=NEW), lambda: w.say("maintained", "dave", "res", "S", created=False), lambda: w.invalidate("dave", "np1"), lambda: w.say("detachment", "dave", "S", "maint", at=NEW),
    ]
    for f in steps[:cut]:
        f()
    state, last = roles(w), w.n
    for f in steps[cut:]:
        f()
    new, full = w.resolver(since=last).build(state), w.resolver().build()
    for k in full:
        cols = [c for c in full[k].columns if c not in ("np", "space", "preset")]
        assert pairs(new[k], *cols) == pairs(full[k], *cols), k


def test_publishable(spark):
    w = World(spark)
    w.grant("dave", "dave")
    full, empty = roles(w), World(spark).resolver().build()
    trusted = w.resolver().ext["acct"]
    assert resolve.publishable(full, None, trusted) and not resolve.publishable(empty, full, trusted) and resolve.publishable(empty, full, trusted.limit(0))


# -- shards, trust, text, templates


def test_shards_and_reconciliation(spark, rows):
    t = lambda *x: [f"http://t.org/{v}" for v in x]
    n = spark.createDataFrame([(NP("a"), "K", [*t("x"), NP("a") + "/own", "urn:y", gen("Space")], OLD, 1, OLD), (NP("b"), None, None, NEW, 2, NEW)], "np string, pubkey string, types array<string>, created timestamp, load_number long, loaded_at timestamp")
    s = ingest.shards(n, F.lit(NEW))
    kinds = lambda np: sorted(r.repo.split("_")[0] for r in s.where(F.col("np") == np).collect())
    assert kinds(NP("a")) == ["full", "meta", "pubkey", "spaces", "text", "type", "type"] and kinds(NP("b")) == ["full", "last30d", "meta", "text"]
    assert listing.repo_for(type_iri="http://t.org/x") in {r.repo for r in s.collect()}
    actual = ingest.shards(n).where(~((F.col("np") == NP("b")) & (F.col("repo") == "text")))
    lack, check = reconcile.forward_sweep(n, actual, 0)
    assert rows(lack.select("repo", "np")) == [("text", NP("b"))] and check.first().checkpoint == 1
    assert reconcile.forward_sweep(n, ingest.shards(n), 0)[1].first().checkpoint == 2
    assert rows(reconcile.retro_sweep(n, actual, 2, F.lit(NEW))) == [("text", NP("b"))]
    lag = spark.createDataFrame([(5, 3), (3, 5), (None, 1)], "a int, b int").select(reconcile.sync_lag(F.col("a"), F.col("b")).alias("l"))
    assert [r.l for r in lag.collect()] == [2, 0, -1]
    inv = spark.createDataFrame([(NP("b"), NP("a"))], "np string, target string")
    assert sorted(r.repo.split("_")[0] for r in ingest.propagate(inv, n).collect()) == ["pubkey", "spaces", "type", "type"]


ENVELOPE = """{"trustStateHash": "h", "trustStateCounter": {"$numberLong": "18"}, "createdAt": "2026-04-15T14:16:16.112094241Z[Etc/UTC]", "accounts": [
 {"pubkey": "p1", "agent": "a", "status": "toLoad", "depth": 1, "pathCount": 1, "ratio": 0.5, "quota": {"$numberLong": "100000"}, "name": "Zed", "nameCreatedAt": {"$date": {"$numberLong": "1000"}}},
 {"pubkey": "p2", "agent": "a", "status": "loaded", "ratio": 0.5, "name": "Ann", "nameCreatedAt": {"$date": "1970-01-01T00:00:02Z"}}, {"pubkey": "p3", "agent": "b", "status": "loaded"}],
 "edges": [{"fromPubkey": "p1", "toPubkey": "p2"}, {"fromPubkey": "p1", "toPubkey": "p2"}]}"""


def test_envelopes(spark, tmp_path):
    bad = ['{"trustStateHash": "h2", "accounts": []}', ENVELOPE.replace('"status": "loaded"}', '"x": 1}').replace('"h"', '"h3"'), "no json", ENVELOPE.replace('"accounts": [', '"accounts": 5, "y": [').replace('"h"', '"h4"'), ENVELOPE.replace('"edges": [', '"edges": 5, "y": [').replace('"h"', '"h5"')]
    s, a, e = trust.parse_envelopes(spark.createDataFrame([(x,) for x in [ENVELOPE, *bad]], "value string"))
    assert [(r.trust_state_hash, r.trust_state_counter, r.n_accounts) for r in s.where("valid").collect()] == [("h", 18, 3)]
    got = {r.pubkey: r for r in a.collect()}
    assert len(got) == 3 and got["p1"].quota == 100000 and got["p1"].name_created_at == datetime(1970, 1, 1, 0, 0, 1) and got["p2"].name_created_at.second == 2 and got["p3"].name is None
    assert e.count() == 1
    assert {r.agent: r.name for r in trust.canonical_names(a, ["trust_state_hash"]).collect()} == {"a": "Ann"}
    q = trust.trust_quads(s.where("valid"), a)
    assert q.where(F.col("p") == ns("npa:trustStatus")).count() == 3 and q.where(F.col("p") == ns("npa:hasCurrentTrustState")).count() == 1
    assert trust.read_envelopes(spark, f"file://{tmp_path}/none")[0].count() == 0
    (tmp_path / "e.json").write_text(ENVELOPE)
    assert trust.read_envelopes(spark, f"file://{tmp_path}/e.json")[1].count() == 3
    many = spark.range(5).select(F.col("id").cast("string").alias("trust_state_hash"), F.col("id").alias("trust_state_counter"))
    assert sorted(r.trust_state_counter for r in trust.retained(many, 2).collect()) == [3, 4] and trust.retained(many, 0).count() == 1


def test_text_search(spark, rows):
    docs = spark.createDataFrame([(1, "The quick fox"), (2, "quick quick"), (3, None), (4, "")], "id int, t string")
    index = textsearch.build_index(docs, "id", "t")
    assert rows(textsearch.search(index, "Quick FOX", "id").select("id")) == [(1,)]
    assert [r.id for r in textsearch.search(index, "quick fox", "id", False).orderBy(F.col("score").desc()).collect()] == [1, 2]
    assert textsearch.search(index, "none", "id").count() == 0
    assert docs.select(textsearch.snippet(F.col("t"), "FOX", 6).alias("s")).first().s == "quick fox"


def test_templates(spark):
    t = templates.Template(CODE("q"), "find", 'SELECT ?x ?v { VALUES ?_who_multi_iri {} ?x <http://x/v> ?v . ?x <http://x/n> ?_name . OPTIONAL { ?x <http://x/l> ?__tag } FILTER(?x = ?_who_multi_iri && ?v != "?_no") }')
    assert [(p.name, p.optional, p.iri, p.multi) for p in t.parameters] == [("who", False, True, True), ("name", False, False, False), ("tag", True, False, False)]
    rows = [("full", "g", f"http://x/{s}", "http://x/v", str(k), "lit", XSD + "integer") for k, s in enumerate("abc")] + [("full", "g", f"http://x/{s}", "http://x/n", 'q"uo\\te', "lit", XSD + "string") for s in "ab"]
    e = Engine(spark, FlatQuads(quads_of(spark, rows)))
    got = t.run(e, {"who": ["http://x/a", "http://x/c"], "name": 'q"uo\\te'})
    assert [tuple(r) for r in got.collect()] == [("http://x/a", "0")]
    for wrong in ({"name": "n"}, {"who": ["no iri"], "name": "n"}, {"who": ["http://x/a"], "name": ["a", "b"]}):
        with pytest.raises(templates.TemplateError):
            t.run(e, wrong)
    spec = t.openapi()
    assert "name: who" in spec and "type: array" in spec and "text/csv" in spec
    assert templates.parse_call(f"/api/{CODE('q')}/find.json") == (CODE("q"), "find", "json")
    with pytest.raises(templates.TemplateError):
        templates.parse_call("/api/xyz/find")
    assert templates.repo_of_endpoint("https://q.org/repo/type/ab", "https://q.org/repo/") == "type_ab"
    doc = templates.srx(e.query("SELECT ?x ?v { ?x <http://x/v> ?v } ", terms=True))
    assert doc.count("<result>") == 3 and "<uri>http://x/a</uri>" in doc and f'datatype="{XSD}integer"' in doc
    assert '"v":"0"' in templates.to_json_rows(got).first()[0]


def test_latest_version(spark):
    g, key = ns("npa:graph"), ns("npa:hasValidSignatureForPublicKeyHash")
    rows = []
    for k, c in enumerate("abcde"):
        rows += [("meta", g, NP(c), key, "k2" if c == "d" else "k1", "lit", XSD + "string"), ("meta", g, NP(c), ns("dct:created"), f"2024-01-0{k + 1}T00:00:00Z", "lit", XSD + "dateTime")]
    for a, b in ("ba", "cb", "db", "ec", "ae"):
        rows.append(("meta", g, NP(a), ns("npx:supersedes"), NP(b), "iri"))
    e = Engine(spark, FlatQuads(quads_of(spark, rows)))
    assert templates.latest_version(e, NP("a")).first().latest == NP("e")
    dead = Engine(spark, FlatQuads(quads_of(spark, [*rows, ("meta", g, NP("c"), ns("npx:invalidates"), NP("e"), "iri")])))
    assert templates.latest_version(dead, NP("a")).first().latest == NP("c")
    assert templates.latest_version(e, NP("x")).first().latest == NP("x")


def test_nquads(spark, tmp_path):
    (tmp_path / "q.nq").write_text('<http://a> <http://p> "x\\ny \\"q\\""@EN <http://g> .\n<http://a> <http://p> "1"^^<http://i> .\n_:b <http://p> <http://o> <http://g> . # c\ngarbage\n\n<http://a> <http://p> _:c .\n')
    got = [tuple(r) for r in read_nquads(spark, f"file://{tmp_path}/q.nq").collect()]
    assert got == [("http://g", "http://a", "http://p", 'x\ny "q"', "lit", ns("rdf:langString"), "en"), ("", "http://a", "http://p", "1", "lit", "http://i", ""), ("http://g", "_:b", "http://p", "http://o", "iri", "", ""), ("", "http://a", "http://p", "_:c", "bnode", "", "")]


# -- state and feed


def test_state(spark, tmp_path):
    path = f"file://{tmp_path}/state.json"
    s = LoaderStatus(spark, path)
    s.move("loading_initial", 5, 7)
    s.move("ready")
    with pytest.raises(ValueError):
        s.move("loading_updates", 4)
    with pytest.raises(ValueError):
        s.move("loading_initial")
    assert (LoaderStatus(spark, path).state.load_counter, LoaderStatus(spark, path).state.status) == (5, "ready")
    assert s.move("resetting").load_counter == -1
    st = EngineState(load_counter=10, setup_id=1)
    assert [next_step(st, c, i) for c, i in ((None, 1), (11, 2), (9, 1), (10, 1), (12, 1))] == ["wait", "resync", "resync", "idle", "load"]
    assert next_step(EngineState(load_counter=3), 5, 9) == "resync" and next_step(st, 11, 1, "broken") == "wait"
    b = Breaker(2, 10)
    b.record(False, 0)
    b.record(False, 1)
    assert not b.allows(5) and b.allows(11) and 30 <= backoff(10) <= 90
    store = SnapshotStore(spark, f"file://{tmp_path}/store")
    for v in ("v1", "v2", "v3"):
        store.publish({"t": spark.createDataFrame([(v,)], "v string")}, v)
    store.stage({"t": spark.createDataFrame([("x",)], "v string")}, "v4")
    assert store.table("t").first().v == "v3" and store.clean({"v1"}) == ["v2", "v4"] and store.versions() == ["v1", "v3"]


def test_feed(spark, tmp_path):
    from quadrille.streaming.feed import CounterFeed, append_once, in_order, latest_wins, run_once

    src, out, check = tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    src.mkdir()
    put = lambda name, lo, hi: spark.range(lo, hi).select(F.col("id").alias("counter"), (F.col("id") % 7).cast("string").alias("np")).toPandas().to_parquet(src / name)
    put("a.parquet", 0, 10)
    run_once(spark, f"{src}/*.parquet", append_once(out, ["np"]), check, batch="4")
    assert spark.read.parquet(out).count() == 7
    put("b.parquet", 10, 20)
    run_once(spark, f"{src}/*.parquet", append_once(out, ["np"]), check, batch="100")
    run_once(spark, f"{src}/*.parquet", append_once(out, ["np"]), check)
    assert sorted(r.np for r in spark.read.parquet(out).select("np").collect()) == [str(k) for k in range(7)]
    spark.dataSource.register(CounterFeed)
    assert spark.read.format("counterfeed").options(path=f"{src}/*.parquet", start="14").load().count() == 5
    assert in_order(spark.createDataFrame([(5,)], "counter long"), 4).count() == 1
    with pytest.raises(Exception, match="counter fell"):
        in_order(spark.createDataFrame([(4,)], "counter long"), 4).collect()
    ev = spark.createDataFrame([("a", 1, "grant"), ("a", 2, "revoke"), ("b", 1, "grant")], "k string, t int, v string")
    assert {r.k: r.v for r in latest_wins(ev, ["k"], ["t", "v"]).collect()} == {"a": "revoke", "b": "grant"}


def test_stored_nanopub(spark, pubs, rows, tmp_path):
    import base64

    from quadrille.sources.rdf import fetch_back, inline_nanopub, object_for, objects_for, pending_uris, prune_before

    quads, n, content = pubs
    store = ingest.admin_quads(n, content).unionByName(quads.withColumn("repo", F.lit("full")).select("repo", "g", "s", "p", "o", "o_kind", "o_dt", "o_lang"))
    store, _ = materialize(store, "store")
    got = fetch_back(store, NP("c"))
    assert got.where(F.col("g").startswith(NP("c"))).count() == content.where(F.col("np") == NP("c")).count()
    assert got.where((F.col("p") == ns("npx:invalidates")) & (F.col("s") == NP("j"))).count() == 1
    assert object_for(store, ingest.GRAPH, NP("c"), ns("npa:artifactCode")) == CODE("c") and object_for(store, "g", "s", "p") is None
    assert objects_for(store, ingest.GRAPH, NP("c"), ns("npa:hasGraph")).count() == 4
    kept = prune_before(store, F.lit("2024-01-05").cast("timestamp"))
    left = {r.s for r in kept.where(F.col("p") == ns("npa:artifactCode")).collect()}
    assert left == {NP(c) for c in DOCS if 1 + ord(c) % 9 >= 5} and kept.where(F.col("g").startswith(NP("c") + "/")).count() == (0 if NP("c") not in left else 11)
    inline = inline_nanopub(spark, base64.urlsafe_b64encode(DOCS["c"].encode()).decode().rstrip("="))
    assert rows(nanopubs(inline)[0].select("np")) == [(NP("c"),)]
    (tmp_path / "uris.txt").write_text(f"# list\n{NP('a')}\n{NP('y')}\n\nno code\n")
    assert rows(pending_uris(spark, f"file://{tmp_path}/uris.txt", n).select("code")) == [(CODE("y"),)]


def test_api_and_consumers(spark):
    from quadrille.api import Api
    from quadrille.plans.consumers import BUILT_IN, members, state_quads

    w = World(spark)
    w.put("ref_iri", ("RP", "P", None))
    w.grant("dave", "dave")
    w.say("attachment", "dave", "S", "memb")
    w.grant("dave", "mia", "joins", "regular")
    w.grant("zoe", "max", "joins", "regular")
    w.grant("zoe", "nobody", "joins", "regular")
    r = w.resolver()
    state = r.build()
    assert pairs(members(state, r.ext).where("ref = 'R1'"), "agent", "status") == {("mia", "validated"), ("max", "account-only"), ("nobody", "unknown")}
    e = Engine(spark, FlatQuads(materialize(state_quads(state, "http://state/1"), "state")[0]))
    api = Api(spark, e, BUILT_IN, spaces=spark.createDataFrame([("S<", "R1", "n")], "space string, ref string, root_np string"), shards=spark.createDataFrame([("type_x",), ("meta",)], "repo string"), gauges={"loaded": lambda: 3})
    code = BUILT_IN[0].code
    assert api(f"/api/{code}/space-admins.csv") == (200, "text/csv", "ref,agent\r\nR1,dave\r\n")
    assert api(f"/api/{code}/space-members.csv?space=S")[0] == 400  # no IRI
    assert api(f"/api/{code}/space-members.json?space=urn:none")[2] == '{"head": {"vars": ["ref", "agent", "role"]}, "results": {"bindings": []}}'
    assert api(f"/api/{code}/space-members.csv")[0] == 400 and api(f"/api/{code}/none.csv")[0] == 400 and api("/nowhere")[0] == 404
    assert api("/repo/spaces?query=ASK%20%7B%3Fa%20%3Fb%20%3Fc%7D")[2] == '{"head": {}, "boolean": true}'
    assert "uri" in api("/repo/spaces?query=SELECT%20%3Fa%20%7B%3Fa%20%3Fb%20%3Fc%7D%20LIMIT%201")[2]
    assert api("/repo/spaces?query=nonsense")[0] == 400 and api("/repo?for-type=http://t")[0] == 301
    assert api("/types")[2] == "type_x\n" and "S&lt;" in api("/spaces")[2] and '"space_iri":"S<"' in api("/spaces.json")[2]
    assert "loaded 3" in api("/metrics")[2] and "parameter: space" in api(f"/grlc-spec/{code}/space-members")[2] and "openapi" in api(f"/openapi/spec/{code}/sub-spaces")[2]
