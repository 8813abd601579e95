"""Spaces, roles, aliases and presets: which rows of the extraction are authorised.

Rules are evaluated tier by tier: admins (recursive), aliases, sub-spaces, maintained resources, the prefix fallback,
governing references, presets, attachments, then maintainers, members and observers. A row counts if its publisher, an
approved account of the trust state, had the authority for it, its nanopub is not invalidated under the same key, and
no newer revocation or detachment by someone entitled speaks against it. On equal times the negative wins.

Inputs are the tables named in EXT; missing ones count as empty.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.functions.iri import encode_for_uri
from quadrille.model import NS
from quadrille.session import broadcast_if_small, materialize

# The tiers, from the highest.
GEN = NS["gen"]
ADMIN, MAINTAINER, MEMBER, OBSERVER = GEN + "AdminRole", GEN + "MaintainerRole", GEN + "MemberRole", GEN + "ObserverRole"
APPROVED = ("loaded", "toload")

EXT = {
    "acct": "agent string, pk string",
    "ref_iri": "ref string, space string, prefix string",
    "definition": "ref string, np string, root_admin string",
    "grant": "ri string, space string, agent string, dir string, pred string, pk string, np string, created timestamp",
    "attachment": "ra string, space string, role string, pk string, np string, created timestamp",
    "declaration": "role string, role_type string, dir string, pred string, np string",
    "subspace": "d string, child string, parent string, pk string, np string",
    "maintained": "d string, resource string, space string, pk string, np string",
    "alias": "d string, canonical string, alias string, pk string, np string",
    "preset_decl": "pd string, kind string, preset string, role string, applies_to string, np string, created timestamp",
    "preset_assign": "pa string, preset string, resource string, active boolean, pk string, np string, created timestamp",
    "revocation": "rev string, space string, agent string, role string, pk string, np string, created timestamp",
    "detachment": "det string, space string, role string, pk string, np string, created timestamp",
    "loads": "np string, ln long, pk string",
    "invalidates": "inv string, target string",
}
#: The rounds of the admins run within one task for references of up to so many grants and revocations.
LOCAL_ROWS = 1_000_000
#: As many rows are meant for a task of them.
LANE_ROWS = 50_000
ADMIN_PRED = GEN + "hasAdmin"
GEN_SPACE = GEN + "Space"


def approved(accounts: DataFrame) -> DataFrame:
    """The mirrored accounts: approved, with agent and key (D1)."""
    return accounts.where(F.lower("status").isin(*APPROVED)).select("agent", F.col("pubkey").alias("pk")).dropna().distinct()


def same_key_invalidations(loads: DataFrame, invalidates: DataFrame) -> DataFrame:
    """inv, target pairs where both nanopubs were signed with one key (D13). Of the loads only those named are
    shuffled, as their hashes tell, if these are few; what the hashes let pass is joined by the nanopubs."""
    invalidates, _ = materialize(invalidates.select("inv", "target").dropna(), "invalidates")
    marks = invalidates.select(F.explode(F.array("inv", "target")).alias("np")).select(F.xxhash64("np").alias("_h")).distinct()
    marks = broadcast_if_small(*materialize(marks, "marks"))
    keyed = loads.select("np", "pk").dropna().withColumn("_h", F.xxhash64("np")).join(marks, "_h", "left_semi").drop("_h").distinct()
    x = invalidates.join(keyed.select(F.col("np").alias("inv"), "pk"), "inv")
    return x.join(keyed.select(F.col("np").alias("target"), "pk"), ["target", "pk"]).select("inv", "target").distinct()


def moment(created: Column) -> Column:
    return F.coalesce(created, F.timestamp_seconds(F.lit(0)))


#: Rows that the rounds of the admins read: givers known before, roots, grants, revocations.
KNOWN, ROOT, GRANT, REVOCATION = range(4)
ADMINS = "ref string, space string, agent string, np string"


def admit(rows: pa.Table) -> pa.Table:
    """All rounds of Resolver.admins() for whole references: ref, space, agent, np of whom they admit.

    ``rows``: kind, ref, by, agent, at (microseconds), np, space. Agents of references are numbered; a round reads the
    grants of those found last and the revocations by those found since."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("at", "np", "space")], null_placement="at_start"))
    numbers = lambda *cs: pa.chunked_array([x for c in cs for x in rows[c].chunks], pa.string()).combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    ref, agents = np.tile(numbers("ref"), 2), numbers("agent", "by")
    nodes, node = np.unique(ref * (agents.max(initial=0) + 1) + agents, return_inverse=True)
    agent, by, kind, at, n = node[: len(rows)], node[len(rows) :], rows["kind"].to_numpy(), rows["at"].to_numpy(), len(nodes)

    def index(rows_of: np.ndarray):
        """A function that gives the numbers of these rows by a set of nodes, in their order."""
        order = rows_of[np.argsort(by[rows_of], kind="stable")]
        start = np.searchsorted(by[order], np.arange(n + 1))

        def of(some: np.ndarray) -> np.ndarray:
            size = start[some + 1] - start[some]
            return np.sort(order[np.repeat(start[some] - np.cumsum(size) + size, size) + np.arange(size.sum())])

        return of

    grants, revocations = index(np.flatnonzero(kind == GRANT)), index(np.flatnonzero(kind == REVOCATION))
    revoked, known = np.full(n, np.iinfo(np.int64).min), np.zeros(n, bool)

    def revoke(r: np.ndarray) -> None:
        np.maximum.at(revoked, agent[r], at[r])

    revoke(np.flatnonzero((kind == REVOCATION) & (agent == by)))
    known[agent[kind == KNOWN]] = True
    last, givers, found = np.flatnonzero(known), np.unique(agent[kind <= ROOT]), []
    while len(givers):
        revoke(revocations(last))
        g = grants(givers)
        g = g[~known[agent[g]] & (revoked[agent[g]] < at[g])]
        last, first = np.unique(agent[g], return_index=True)
        found.append(g[first])
        known[last], givers = True, last
    return rows.take(pa.array(np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64))).select(["ref", "space", "agent", "np"])


class Resolver:
    """The rules over one extraction. ``since``: only rows of nanopubs loaded after that number (exclusive)."""

    def __init__(self, spark: SparkSession, ext: dict[str, DataFrame], since: int | None = None):
        self.spark = spark
        self.ext = {k: ext[k] if k in ext else spark.createDataFrame([], s) for k, s in EXT.items()}
        self.since = since
        self._denoted: dict[int, tuple[DataFrame | None, DataFrame]] = {}

    @cached_property
    def dead(self) -> DataFrame:
        """Invalidated nanopubs; written once, as every rule reads them."""
        return broadcast_if_small(*materialize(same_key_invalidations(self.ext["loads"], self.ext["invalidates"]).select(F.col("target").alias("np")).distinct(), "dead"))

    def live(self, name: str, new: bool = True) -> DataFrame:
        """Rows that are not invalidated, and new ones only if the resolver has a horizon."""
        df = self.ext[name].join(self.dead, "np", "left_anti")
        if new and self.since is not None:
            df = df.join(self.ext["loads"].where(F.col("ln") > self.since).select("np").distinct(), "np", "left_semi")
        return df

    def published(self, name: str, new: bool = True, only: DataFrame | None = None, on: list[str] | None = None) -> DataFrame:
        """Live rows with the agents that published them (pub); joined with ``only`` first."""
        live = self.live(name, new)
        return (live if only is None else live.join(only, on)).join(self.ext["acct"].select(F.col("agent").alias("pub"), "pk"), "pk")

    def anew(self, **kw) -> Resolver:
        r = object.__new__(Resolver)
        r.__dict__ = self.__dict__ | {"dead": self.dead} | kw
        return r

    # -- D2, D3, D15
    def alive_refs(self) -> DataFrame:
        return self.live("definition", False).select("ref").distinct()

    def roots(self) -> DataFrame:
        """Root admins of references with a live definition: ref, agent."""
        d = self.ext["definition"].where("root_admin is not null").select("ref", F.col("root_admin").alias("agent")).distinct()
        return d.join(self.alive_refs(), "ref", "left_semi")

    def _revoking(self, denotes: DataFrame | None) -> DataFrame:
        """Revocations of the admin role, but for those of root admins: ref, agent, by, at."""
        rev = self.ext["revocation"].where(F.col("role") == ADMIN).join(self.denotes(denotes), "space").select("ref", "agent", "pk", moment(F.col("created")).alias("at"))
        root = self.ext["definition"].where("root_admin is not null").select("ref", F.col("root_admin").alias("agent")).distinct()
        rev = rev.join(self.ext["acct"].select(F.col("agent").alias("by"), "pk"), "pk").join(root, ["ref", "agent"], "left_anti")
        return rev.groupBy("ref", "agent", "by").agg(F.max("at").alias("at"))

    @cached_property
    def _revoked(self) -> DataFrame:
        """Written once, as every round of the admins reads it."""
        return materialize(self._revoking(None), "revoked")[0]

    def admin_revocations(self, admins: DataFrame, denotes: DataFrame | None = None) -> DataFrame:
        """ref, agent and the newest revocation of the admin role by an admin of the reference or the agent itself;
        root admins are exempt."""
        rev = self._revoked if denotes is None else self._revoking(denotes)
        admin = admins.select("ref", F.col("agent").alias("by")).distinct()
        entitled = rev.where("by = agent").select("ref", "agent", "at").unionByName(rev.join(admin, ["ref", "by"], "left_semi").select("ref", "agent", "at"))
        return entitled.groupBy("ref", "agent").agg(F.max("at").alias("revoked_at"))

    def admins(self, state: DataFrame | None = None, local: int = LOCAL_ROWS) -> DataFrame:
        """Admins by signed grants, from the root admins on: ref, space, agent, np. Semi-naive: each round follows only
        the admins found last; whom an admin already found has revoked by then is not admitted. No reference bears on
        another, so that a task runs all rounds of its references, however many; rounds of all executors are left for
        tables with a reference of more rows than ``local``."""
        refs = self.denotes(None)
        grants = self.published("grant").where((F.col("pred") == ADMIN_PRED) & (F.col("dir") == "inverse") & F.col("agent").isNotNull()).join(refs, "space")
        grants, _ = materialize(grants.select("ref", "space", "agent", "pub", "np", moment(F.col("created")).alias("at")), "grants")
        none = self.spark.createDataFrame([], ADMINS)
        rows = self._admin_rows(grants, state)
        size = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
        if (size["most"] or 0) <= local:
            lanes = (size["all"] or 0) // LANE_ROWS + 1
            new = rows.groupBy(F.pmod(F.xxhash64("ref"), F.lit(lanes)).alias("_lane")).applyInArrow(admit, ADMINS)
            new, _ = materialize(new, "admins")
            return new if state is None else state.select(*new.columns).unionByName(new)
        known = state if state is not None else none
        givers = self.roots() if state is None else self.roots().unionByName(state.select("ref", "agent")).distinct()
        revocable = bool(self._revoked.limit(1).count())
        while True:
            cand = grants.join(givers.select("ref", F.col("agent").alias("pub")).distinct(), ["ref", "pub"], "left_semi")
            if revocable:
                cand = cand.join(self.admin_revocations(known), ["ref", "agent"], "left").where("revoked_at is null or revoked_at < at")
            new = cand.join(known.select("ref", "agent").distinct(), ["ref", "agent"], "left_anti").groupBy("ref", "agent").agg(F.min(F.struct("at", "np", "space")).alias("x"))
            new, _ = materialize(new.select("ref", "x.space", "agent", "x.np"), "admins")
            if not new.limit(1).count():
                return known
            known, givers = known.unionByName(new), new

    def _admin_rows(self, grants: DataFrame, state: DataFrame | None) -> DataFrame:
        """What admit() reads."""
        row = lambda df, kind, by, at, *more: df.select(F.lit(kind).alias("kind"), "ref", F.col(by).alias("by"), "agent", at.alias("at"), *(more or (F.lit(None).cast("string").alias(c) for c in ("np", "space"))))
        parts = [row(grants, GRANT, "pub", F.unix_micros("at"), "np", "space"), row(self._revoked, REVOCATION, "by", F.unix_micros("at")), row(self.roots(), ROOT, "agent", F.lit(0).cast("long"))]
        if state is not None:
            parts.append(row(state.select("ref", "agent").distinct(), KNOWN, "agent", F.lit(0).cast("long")))
        return reduce(DataFrame.unionByName, parts).dropna(subset=["ref", "by", "agent"])

    # -- D10, D6 of the notation: which references an IRI stands for
    def denotes(self, same_as: DataFrame | None) -> DataFrame:
        """space, ref; written once for each table of aliases, and broadcast if it is small."""
        if id(same_as) not in self._denoted:
            self._denoted[id(same_as)] = same_as, broadcast_if_small(*materialize(self._denotes(same_as), "denotes"))
        return self._denoted[id(same_as)][1]

    def _denotes(self, same_as: DataFrame | None) -> DataFrame:
        own = self.ext["ref_iri"].select("space", "ref")
        return (own.unionByName(same_as.select(F.col("alias").alias("space"), "ref")) if same_as is not None else own).distinct()

    def aliases(self, admins: DataFrame) -> DataFrame:
        """alias, ref, np: the publisher is admin of the canonical reference and every admin of the alias is one too."""
        refs = self.ext["ref_iri"].select(F.col("space").alias("canonical"), "ref").distinct()
        a = self.published("alias").join(refs, "canonical").join(admins.select("ref", F.col("agent").alias("pub")).distinct(), ["ref", "pub"], "left_semi")
        a = a.select("alias", "canonical", "ref", "np").distinct()
        foreign = a.select("alias", "ref").distinct().join(admins.select(F.col("space").alias("alias"), "agent").distinct(), "alias").join(admins.select("ref", "agent").distinct(), ["ref", "agent"], "left_anti")
        return a.join(foreign.select("alias", "ref").distinct(), ["alias", "ref"], "left_anti")

    def subspaces(self, admins: DataFrame) -> DataFrame:
        """child_ref, parent_ref, child, parent, np. Either one publisher is admin of both sides, or two live
        declarations of the pair exist whose publishers together are."""
        adm = admins.select("ref", "space", "agent").distinct()
        side = lambda s: adm.select(F.col("ref").alias(f"{s}_ref"), F.col("space").alias(s), F.col("agent").alias(f"{s}_pub"))
        d = self.published("subspace").where("child <> parent").select("child", "parent", "np", "pub")
        one = d.join(side("child").withColumnRenamed("child_pub", "pub"), ["child", "pub"]).join(side("parent").withColumnRenamed("parent_pub", "pub"), ["parent", "pub"])
        # of the other declarations of a pair only their publishers count, with two nanopubs each: one of them is another
        other = self.published("subspace", False).where("child <> parent").groupBy("child", "parent", F.col("pub").alias("pub2")).agg(F.min("np").alias("n1"), F.max("np").alias("n2"))
        of = lambda df, s, pub: df.join(side(s).withColumnRenamed(f"{s}_pub", pub), [s, pub])
        ends = ["child", "parent", "child_ref", "parent_ref"]
        fold = lambda df, *by: df.groupBy("child", "parent", *by).agg(F.min("n1").alias("n1"), F.max("n2").alias("n2"))
        both = [
            d.join(fold(of(of(other, "child", "pub2"), "parent", "pub2"), *ends[2:]), ["child", "parent"]),
            of(d, "child", "pub").join(fold(of(other, "parent", "pub2"), "parent_ref"), ["child", "parent"]),
            of(d, "parent", "pub").join(fold(of(other, "child", "pub2"), "child_ref"), ["child", "parent"]),
        ]
        both = reduce(DataFrame.unionByName, (x.where("np <> n1 or np <> n2").select(*ends, "np") for x in both))
        cols = ["child_ref", "parent_ref", "child", "parent", "np"]
        return one.select(*cols).unionByName(both.select(*cols)).distinct()

    def maintained(self, admins: DataFrame) -> DataFrame:
        """resource, ref, space, np: the publisher is admin of the space."""
        m = self.published("maintained")
        return m.join(admins.select("ref", "space", F.col("agent").alias("pub")).distinct(), ["space", "pub"]).select("resource", "ref", "space", "np").distinct()

    def prefix_subspaces(self, subspaces: DataFrame) -> DataFrame:
        """child_ref, parent_ref by the IRI's prefix, unless the child has a validated declaration."""
        refs = self.ext["ref_iri"]
        child = refs.where("prefix is not null").select(F.col("ref").alias("child_ref"), F.col("space").alias("child"), F.col("prefix").alias("parent")).join(subspaces.select("child").distinct(), "child", "left_anti")
        parent = refs.select(F.col("ref").alias("parent_ref"), F.col("space").alias("parent"))
        return child.join(parent, "parent").where("child_ref <> parent_ref").select("child_ref", "parent_ref", "child", "parent").distinct()

    def governing(self, maintained: DataFrame) -> DataFrame:
        """resource, ref: maintained resources, and every space itself."""
        return maintained.select("resource", "ref").unionByName(self.ext["ref_iri"].select(F.col("space").alias("resource"), "ref")).distinct()

    # -- D4, D5, D6, D16
    def detached(self, admins: DataFrame, same_as: DataFrame) -> DataFrame:
        """ref, role and the time of the newest detachment by an admin of the reference."""
        d = self.ext["detachment"].join(self.ext["acct"].select(F.col("agent").alias("by"), "pk"), "pk").join(self.denotes(same_as), "space")
        d = d.join(admins.select("ref", F.col("agent").alias("by")).distinct(), ["ref", "by"], "left_semi")
        return d.groupBy("ref", "role").agg(F.max(moment(F.col("created"))).alias("detached_at"))

    def attachments(self, admins: DataFrame, same_as: DataFrame) -> DataFrame:
        """ref, space, role, np of roles attached by an admin, and by presets (preset set). First row per (ref, role)."""
        keys = admins.select("ref", "agent").join(self.ext["acct"].select("agent", "pk"), "agent").select("ref", "pk").distinct()
        keys = broadcast_if_small(*materialize(keys, "admin-keys"))
        direct = self.live("attachment").join(self.denotes(same_as), "space").join(keys, ["ref", "pk"], "left_semi")
        direct = direct.select("ref", "space", "role", "np", moment(F.col("created")).alias("at"), F.lit(None).cast("string").alias("preset"))
        both = direct.unionByName(self.preset_attachments(admins, same_as))
        both = both.join(self.detached(admins, same_as), ["ref", "role"], "left").where("detached_at is null or detached_at < at")
        first = both.groupBy("ref", "role").agg(F.min(F.struct(F.col("preset").isNotNull().alias("p"), "at", "np", "space", "preset")).alias("x"))
        return first.select("ref", "x.space", "role", "x.np", "x.preset")

    def latest_declarations(self) -> DataFrame:
        """The newest live declaration of each preset kind (W1)."""
        d = self.live("preset_decl", False).where("created is not null and kind is not null")
        newest = d.groupBy("kind").agg(F.max(F.struct("created", "pd")).alias("x")).select("kind", "x.pd")
        return d.join(newest, ["kind", "pd"], "left_semi")

    def latest_assignments(self, admins: DataFrame, same_as: DataFrame, new: bool = True) -> DataFrame:
        """The newest assignment by an admin for each preset, resource and reference (W2); one that is invalidated or
        old still shadows older ones."""
        pub = self.ext["acct"].select(F.col("agent").alias("pub"), "pk")
        a = self.ext["preset_assign"].where("created is not null").join(pub, "pk").join(self.denotes(same_as).withColumnRenamed("space", "resource"), "resource")
        a = a.join(admins.select("ref", F.col("agent").alias("pub")).distinct(), ["ref", "pub"], "left_semi")
        newest = a.groupBy("preset", "resource", "ref").agg(F.max(F.struct("created", "pa", "np", "active")).alias("x")).select("preset", "resource", "ref", "x.*")
        live = self.live("preset_assign", new).select("pa", "np").distinct()
        return newest.join(live, ["pa", "np"], "left_semi")

    def preset_attachments(self, admins: DataFrame, same_as: DataFrame) -> DataFrame:
        a = self.latest_assignments(admins, same_as).where("active")
        every = self.ext["preset_decl"].select("preset", "kind").distinct()
        decl = self.latest_declarations().where(F.col("applies_to") == GEN_SPACE).select("kind", "role").dropna().distinct()
        x = a.join(every, "preset").join(decl, "kind")
        return x.select("ref", F.col("resource").alias("space"), "role", "np", F.col("created").alias("at"), "preset").distinct()

    def preset_stamps(self, admins: DataFrame, same_as: DataFrame) -> DataFrame:
        """Every assignment by an admin, active or not."""
        a = self.published("preset_assign").join(self.denotes(same_as).withColumnRenamed("space", "resource"), "resource")
        return a.join(admins.select("ref", F.col("agent").alias("pub")).distinct(), ["ref", "pub"], "left_semi").select("pa", "preset", "resource", "ref", "active", "np", "created").distinct()

    # -- D7, D14
    def holders(self, roles: DataFrame, tier: str) -> DataFrame:
        """ref, agent of those whose role's predicate any declaration of the tier uses."""
        decl = self.ext["declaration"].where(F.col("role_type") == tier).select("dir", "pred").distinct()
        return roles.join(decl, ["dir", "pred"], "left_semi").select("ref", "agent").distinct()

    def role_revocations(self, admins: DataFrame, same_as: DataFrame, roles: DataFrame, tier: str, of: DataFrame) -> DataFrame:
        """ref, agent, role and the newest revocation by an admin, by a maintainer (of members and observers), by a
        member (of observers) or by the agent itself, of the agents and roles of the references in ``of``."""
        some = broadcast_if_small(*materialize(of.select("ref", "agent", "role").distinct(), "revocable"))
        rev = self.ext["revocation"].where(F.col("role") != ADMIN).join(self.denotes(same_as), "space").join(some, ["ref", "agent", "role"], "left_semi").join(self.ext["acct"].select(F.col("agent").alias("by"), "pk"), "pk").select("ref", "agent", "role", "by", moment(F.col("created")).alias("at"))
        held = [admins.select("ref", "agent")]
        if tier in (MEMBER, OBSERVER):
            held.append(roles.where(F.col("role_type") == MAINTAINER).select("ref", "agent"))
        if tier == OBSERVER:
            held.append(roles.where(F.col("role_type") == MEMBER).select("ref", "agent"))
        may = reduce(DataFrame.unionByName, held).distinct().withColumnRenamed("agent", "by")
        cols = ["ref", "agent", "role", "at"]
        entitled = rev.where("by = agent").select(*cols).unionByName(rev.join(may, ["ref", "by"], "left_semi").select(*cols))
        return entitled.groupBy("ref", "agent", "role").agg(F.max("at").alias("revoked_at"))

    def roles(self, tier: str, admins: DataFrame, same_as: DataFrame, attached: DataFrame, roles: DataFrame) -> DataFrame:
        """Role instantiations of one tier: ref, space, agent, role, role_type, dir, pred, np. The publisher is an
        admin or holds a higher tier; observers may name themselves."""
        decl = self.ext["declaration"].where(F.col("role_type") == tier).select("role", "role_type", "dir", "pred").distinct()
        open_ = attached.select("ref", "role").distinct().join(decl, "role").join(self.denotes(same_as), "ref")
        open_ = broadcast_if_small(*materialize(open_, "open"))
        x = self.published("grant", only=open_, on=["space", "dir", "pred"]).select("ref", "space", "agent", "role", "role_type", "dir", "pred", "np", "pub", moment(F.col("created")).alias("at"))
        held = [admins.select("ref", "agent")]
        if tier in (MEMBER, OBSERVER):
            held.append(self.holders(roles, MAINTAINER))
        if tier == OBSERVER:
            held.append(self.holders(roles, MEMBER))
        may = reduce(DataFrame.unionByName, held).distinct().withColumnRenamed("agent", "pub")
        ok = x.join(may, ["ref", "pub"], "left_semi")
        if tier == OBSERVER:
            ok = ok.unionByName(x.where("pub = agent"))
        ok, _ = materialize(ok, "offered")
        ok = ok.join(self.role_revocations(admins, same_as, roles, tier, ok), ["ref", "agent", "role"], "left").where("revoked_at is null or revoked_at < at")
        return ok.select("ref", "space", "agent", "role", "role_type", "dir", "pred", "np").distinct()

    # -- D18, D19
    def build(self, state: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
        """All tiers in order. With an earlier state and a horizon, rows that no longer hold are removed from the state
        and only rows above the horizon are looked at. If anything came or went that authorises other rows, the tiers
        are evaluated in full instead, so that rows that arrived before what authorises them are caught. The result is
        that of a full build in every case. Admins are derived anew in each cycle."""
        full = self.anew(since=None)
        admins = materialize(full.admins(), "admin")[0]
        old = self._displace(state) if state and self.since is not None else {}
        if old and self._structural(admins, state, old):
            old = {}
        r = self if old else full

        def keep(name: str, df: DataFrame) -> DataFrame:
            return materialize(df.unionByName(old[name]).distinct() if old else df, name)[0]

        out = {"admin": admins, "alias": keep("alias", r.aliases(admins))}

        r.denotes(out["alias"])  # once for all that follow

        def structure() -> None:
            out["subspace"] = keep("subspace", r.subspaces(admins))
            out["prefix"] = materialize(r.prefix_subspaces(out["subspace"]), "prefix")[0]

        def resources() -> None:
            out["maintained"] = keep("maintained", r.maintained(admins))
            out["governing"] = materialize(r.governing(out["maintained"]), "governing")[0]

        def presets() -> None:
            out["stamp"] = keep("stamp", r.preset_stamps(admins, out["alias"]))

        def attachments() -> None:
            out["attachment"] = old["attachment"] if old else materialize(r.attachments(admins, out["alias"]), "attachment")[0]

        with ThreadPoolExecutor(4) as pool:  # these tiers do not read each other
            for done in [pool.submit(f) for f in (structure, resources, presets, attachments)]:
                done.result()
        roles = self.spark.createDataFrame([], "ref string, space string, agent string, role string, role_type string, dir string, pred string, np string")
        for tier in (MAINTAINER, MEMBER, OBSERVER):
            new = r.roles(tier, admins, out["alias"], out["attachment"], roles)
            if old:
                own = old["role"].where(F.col("role_type") == tier)
                new, _ = materialize(new.join(own, own.columns, "left_anti").select(*own.columns), "fresh")
                if tier != OBSERVER and new.limit(1).count():
                    r = full  # new holders of a tier may authorise what came before them
                new = new.unionByName(own)
            roles = materialize(roles.unionByName(new.distinct()), "role")[0]
        out["role"] = roles
        return out

    def _displace(self, state: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The state without rows of invalidated nanopubs and without roles and attachments that were revoked,
        detached or deactivated since. Admin rows are derived anew in every cycle."""
        admins, same = state["admin"], state["alias"]
        out = {k: state[k].join(self.dead, "np", "left_anti").select(*state[k].columns) for k in ("alias", "subspace", "maintained", "stamp", "attachment", "role")}
        at = lambda name, col: self.ext[name].select("np", moment(F.col("created")).alias("at")).groupBy("np").agg(F.max("at").alias(col))
        a = out["attachment"].join(at("attachment", "a1"), "np", "left").join(at("preset_assign", "a2"), "np", "left").join(self.detached(admins, same), ["ref", "role"], "left")
        a = a.where("detached_at is null or detached_at < coalesce(a1, a2)")
        active = self.anew(since=None).latest_assignments(admins, same, False).where("active").select("preset", "ref", "np").distinct()
        out["attachment"] = a.where("preset is null").select(*state["attachment"].columns).unionByName(a.where("preset is not null").join(active, ["preset", "ref", "np"], "left_semi").select(*state["attachment"].columns))
        parts = []
        for tier in (MAINTAINER, MEMBER, OBSERVER):
            r = out["role"].where(F.col("role_type") == tier).join(at("grant", "at"), "np", "left").join(self.role_revocations(admins, same, out["role"], tier, out["role"]), ["ref", "agent", "role"], "left")
            parts.append(r.where("revoked_at is null or revoked_at < at").select(*state["role"].columns))
        out["role"] = reduce(DataFrame.unionByName, parts)
        return out

    def _structural(self, admins: DataFrame, state: dict[str, DataFrame], old: dict[str, DataFrame]) -> bool:
        """Did anything come or go that authorises other rows?"""
        some = lambda df: bool(df.limit(1).count())
        who = lambda df: df.select("ref", "agent")
        arrived = ("alias", "subspace", "attachment", "declaration", "preset_decl", "preset_assign")
        gone = ("alias", "subspace", "attachment", "role")
        changed = some(who(admins).exceptAll(who(state["admin"]))) or some(who(state["admin"]).exceptAll(who(admins)))
        return changed or any(some(self.live(n)) for n in arrived) or any(some(state[n].select(*old[n].columns).exceptAll(old[n])) for n in gone)


def publishable(new: dict[str, DataFrame], old: dict[str, DataFrame] | None, trusted: DataFrame) -> bool:
    """A build without any admin may replace a state that has some only if the trust state is empty, too."""
    return bool(new["admin"].limit(1).count()) or not old or not old["admin"].limit(1).count() or not trusted.limit(1).count()


def totals(state: dict[str, DataFrame]) -> DataFrame:
    """Numbers of distinct subjects per tier (D21)."""
    a = state["admin"].select("ref", "agent").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(ADMIN).alias("tier"), "n")
    t = state["attachment"].select("ref", "role").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit("RoleAssignment").alias("tier"), "n")
    r = state["role"].groupBy(F.col("role_type").alias("tier")).agg(F.countDistinct("ref", "agent", "np").alias("n"))
    return a.unionByName(t).unionByName(r)


def minted(base: Column, *parts: Column) -> Column:
    """A subject of its own per reference: the parts percent-encoded behind two underscores each (F3, F4)."""
    return F.concat(base, *(F.concat(F.lit("__"), encode_for_uri(p)) for p in parts))


def link_iri(kind: str, *parts: Column) -> Column:
    """The IRI of a link, by the hash of its parts (F5)."""
    path = "derivedlink/" if kind == "derived" else f"spacelink/{kind}/"
    return F.concat(F.lit(NS["npa"] + path), F.md5(F.concat_ws("|", *parts)))


def edges(state: dict[str, DataFrame]) -> DataFrame:
    """Convenience edges (subject, predicate, object) between references and between IRIs. As they are derived from
    the links each time, an edge stands as long as any link backs it."""

    def edge(df: DataFrame, s: str, p: str, o: str) -> DataFrame:
        return df.select(F.col(s).alias("subject"), F.lit(p).alias("predicate"), F.col(o).alias("object"))

    out = []
    for name in ("subspace", "prefix"):
        for c, p in (("child_ref", "parent_ref"), ("child", "parent")):
            out += [edge(state[name], c, "isSubSpaceOf", p), edge(state[name], p, "hasSubSpace", c)]
    for o in ("ref", "space"):
        out += [edge(state["maintained"], "resource", "isMaintainedBy", o), edge(state["maintained"], o, "hasMaintainedResource", "resource")]
    out += [edge(state["alias"], "alias", "sameAsSpace", "ref"), edge(state["alias"], "alias", "sameAsSpace", "canonical"), edge(state["governing"], "resource", "hasGoverningSpaceRef", "ref")]
    return reduce(DataFrame.unionByName, out).distinct()


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order values (top version)."""
    w = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
