"""What readers ask of the space state: the state as quads, members with their standing, and queries ready to use."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.model import NS, QUAD_COLUMNS, ns
from quadrille.plans.resolve import ADMIN, edges
from quadrille.plans.templates import Template


def state_quads(state: dict[str, DataFrame], graph: str) -> DataFrame:
    """Roles, attachments and edges of a state as quads of one graph, and the pointer to it."""

    def put(df: DataFrame, s, p: str, o) -> DataFrame:
        return df.select(F.lit("spaces"), F.lit(graph), s, F.lit(NS["npa"] + p), o, F.lit("iri"), F.lit(""), F.lit("")).toDF(*QUAD_COLUMNS).where("o is not null")

    name = lambda *c: F.concat(F.lit(NS["npa"] + "row/"), F.sha2(F.concat_ws("|", *c), 256))
    a = state["admin"].select("ref", "space", "agent", F.lit(ADMIN).alias("role_type"), F.lit(None).cast("string").alias("role"), "np")
    r = a.unionByName(state["role"].select("ref", "space", "agent", "role_type", "role", "np"))
    out = [put(r, name("ref", "agent", "role_type", "role", "np"), p, F.col(c)) for p, c in (("forSpaceRef", "ref"), ("forSpace", "space"), ("forAgent", "agent"), ("hasRoleType", "role_type"), ("role", "role"), ("viaNanopub", "np"))]
    e = edges(state)
    out.append(e.select(F.lit("spaces"), F.lit(graph), "subject", F.concat(F.lit(NS["npa"]), "predicate"), "object", F.lit("iri"), F.lit(""), F.lit("")).toDF(*QUAD_COLUMNS))
    spark = e.sparkSession
    out.append(spark.createDataFrame([("spaces", ns("npa:graph"), ns("npa:thisRepo"), ns("npa:hasCurrentSpaceState"), graph, "iri", "", "")], QUAD_COLUMNS))
    return reduce(DataFrame.unionByName, out).distinct()


def members(state: dict[str, DataFrame], ext: dict[str, DataFrame]) -> DataFrame:
    """ref, agent, role, status of all who were ever given a role of a reference: validated, account-only (the agent has
    an approved account but the role was not authorised) or unknown."""
    refs = ext["ref_iri"].select("ref", "space").distinct()
    decl = ext["declaration"].select("role", "dir", "pred").distinct()
    claimed = ext["grant"].join(refs, "space").join(decl, ["dir", "pred"]).select("ref", "agent", "role").distinct()
    ok = state["role"].select("ref", "agent", "role", F.lit(True).alias("ok")).distinct()
    known = ext["acct"].select("agent", F.lit(True).alias("known")).distinct()
    x = claimed.join(ok, ["ref", "agent", "role"], "full").join(known, "agent", "left")
    status = F.when(F.col("ok"), "validated").when(F.col("known"), "account-only").otherwise("unknown")
    return x.select("ref", "agent", "role", status.alias("status"))


_POINTER = f"GRAPH <{ns('npa:graph')}> {{ <{ns('npa:thisRepo')}> <{ns('npa:hasCurrentSpaceState')}> ?state . }}"
_N = f"<{NS['npa']}"
_CODE = "RA" + "0" * 43

#: Queries on the current state; each reads the pointer itself, so it sees one state only.
BUILT_IN = [
    Template(_CODE, "space-admins", f"SELECT ?ref ?agent WHERE {{ {_POINTER} GRAPH ?state {{ ?r {_N}forSpaceRef> ?ref ; {_N}forAgent> ?agent ; {_N}hasRoleType> <{ADMIN}> . }} }}", "spaces"),
    Template(_CODE, "space-members", f"SELECT ?ref ?agent ?role WHERE {{ {_POINTER} GRAPH ?state {{ ?r {_N}forSpaceRef> ?ref ; {_N}forAgent> ?agent ; {_N}role> ?role . ?r {_N}forSpace> ?_space_iri . }} }}", "spaces"),
    Template(_CODE, "sub-spaces", f"SELECT ?child WHERE {{ {_POINTER} GRAPH ?state {{ ?child {_N}isSubSpaceOf> ?_space_iri . }} }}", "spaces"),
    Template(_CODE, "all-sub-spaces", f"SELECT DISTINCT ?child WHERE {{ {_POINTER} GRAPH ?state {{ ?_space_iri {_N}hasSubSpace>+ ?child . }} }}", "spaces"),
    Template(_CODE, "maintained-resources", f"SELECT ?resource WHERE {{ {_POINTER} GRAPH ?state {{ ?resource {_N}isMaintainedBy> ?_space_iri . }} }}", "spaces"),
    Template(_CODE, "governing-refs", f"SELECT ?resource ?ref WHERE {{ {_POINTER} GRAPH ?state {{ ?resource {_N}hasGoverningSpaceRef> ?ref . }} }}", "spaces"),
    Template(_CODE, "repo-info", f"SELECT ?pred ?obj WHERE {{ <{ns('npa:thisRepo')}> ?pred ?obj . }} LIMIT 10"),
]
