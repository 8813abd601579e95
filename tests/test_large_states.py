"""Long chains of grants and many declarations of one pair."""

import random
from datetime import timedelta

from pyspark.sql import functions as F
from test_plans import OLD, World, pairs

from quadrille.plans import resolve
from quadrille.plans.resolve import ADMIN, EXT, Resolver
from quadrille.session import with_timeout


def test_admins_are_found_in_one_pass(spark, monkeypatch):
    w, written, real = World(spark), [], resolve.materialize
    people = ["dave", *(f"a{i}" for i in range(12))]
    w.put("acct", *[(a, f"k-{a}") for a in people[1:]])
    for a, b in zip(people, people[1:]):
        w.grant(a, b)
    monkeypatch.setattr(resolve, "materialize", lambda df, name, *more: written.append(name) or real(df, name, *more))
    assert pairs(w.resolver().admins(), "ref", "agent") == {("R1", a) for a in people[1:]}
    assert written.count("admins") == 1  # each round was a job and a table before


def test_rounds_within_a_task_are_those_of_all(spark):
    dice = random.Random(7)
    for trial in range(3):
        w = World(spark)
        people = ["dave", "bob", *(f"a{i}" for i in range(14))]
        w.put("acct", *[(a, f"k-{a}") for a in people[2:]], ("twin", "k-a1"))
        w.put("ref_iri", ("R1", "T", None))
        for _ in range(60):
            w.grant(dice.choice(people), dice.choice(people), at=OLD + timedelta(days=dice.randrange(9)), space=dice.choice("ST"))
        for _ in range(20):
            w.say("revocation", dice.choice(people), dice.choice("ST"), dice.choice(people), ADMIN, at=OLD + timedelta(days=dice.randrange(9)))
        r, cols = w.resolver(), ["ref", "space", "agent", "np"]
        got = sorted(map(tuple, r.admins().select(*cols).collect()))
        assert got == sorted(map(tuple, r.admins(local=-1).select(*cols).collect())) and len(got) > 4
        state = r.admins().where(F.col("agent").isin(people[:8]))
        assert sorted(map(tuple, r.admins(state).select(*cols).collect())) == sorted(map(tuple, r.admins(state, local=-1).select(*cols).collect()))


def test_subspaces_by_two_publishers(spark):
    dice = random.Random(3)
    people = [f"a{i}" for i in range(6)]
    for _ in range(3):
        acct = [(a, f"k-{a}") for a in people] + [("a0", "k-a1")]  # two agents share a key
        admins = [(f"r{s}{dice.randrange(2)}", s, dice.choice(people)) for s in "STU" for _ in range(3)]
        decl = [(f"d{i}", dice.choice("ST"), dice.choice("TU"), f"k-{dice.choice(people)}", f"np{dice.randrange(18)}") for i in range(22)]
        r = Resolver(spark, {k: spark.createDataFrame(v, EXT[k]) for k, v in {"acct": acct, "subspace": decl}.items()})
        said = [(c, p, np, a) for _, c, p, k, np in decl for a, key in acct if key == k and c != p]
        want = set()
        for c, p, np, pub in said:
            for by in [{pub}] + [{pub, b} for c2, p2, np2, b in said if (c2, p2) == (c, p) and np2 != np]:
                want |= {(x, y, c, p, np) for x, s, a in admins if s == c and a in by for y, t, b in admins if t == p and b in by}
        got = r.subspaces(spark.createDataFrame(admins, "ref string, space string, agent string"))
        assert sorted(map(tuple, got.select("child_ref", "parent_ref", "child", "parent", "np").collect())) == sorted(want)


def test_many_declarations_of_one_pair(spark):
    i = F.col("id").cast("string")
    decl = spark.range(20_000).select(F.concat(F.lit("d"), i).alias("d"), F.lit("S").alias("child"), F.lit("T").alias("parent"), F.when(F.col("id") % 2 == 0, "k-a").otherwise("k-b").alias("pk"), F.concat(F.lit("np"), i).alias("np"))
    r = Resolver(spark, {"acct": spark.createDataFrame([("a", "k-a"), ("b", "k-b")], EXT["acct"]), "subspace": decl})
    admins = spark.createDataFrame([("rs", "S", "a"), ("rt", "T", "b")], "ref string, space string, agent string")
    assert with_timeout(spark, 60, lambda: r.subspaces(admins).count()) == 20_000  # 400 million pairs of declarations before
