"""Suppliers and parts as published nanopubs, the extraction from their statements, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.model import NS, ns
from quadrille.plans.extract import Extraction, gen
from quadrille.plans.resolve import MAINTAINER, MEMBER, OBSERVER
from quadrille.sources.bridge import EX, code, np_iri
from quadrille.sources.tables import table

TYPE, CUSTOM = ns("rdf:type"), EX + "takesPartIn"


def statement(s: Column, p: str, o: Column | str, when: Column | None = None, part: str = "assertion", kind: str = "iri") -> Column:
    x = F.struct(F.lit(part).alias("part"), s.alias("s"), F.lit(p).alias("p"), (F.lit(o) if isinstance(o, str) else o).alias("o"), F.lit(kind).alias("o_kind"))
    return x if when is None else F.when(when, x)


def published(spark: SparkSession, sf_dir: str) -> Extraction:
    """A supplier is a nanopub that declares a space with two admins, inline roles, and by nation and balance a root
    definition, an alias, a space above it or one that maintains it. A part's nanopub is about a role instantiation,
    attachment or declaration, a preset or its assignment by its type, and by its colour about the rest."""
    epoch, minute = F.unix_micros(F.lit("2024-01-01").cast("timestamp")), 60_000_000
    name = lambda kind, c: F.concat(F.lit(f"{EX}{kind}/"), c.cast("string"))
    k, bal = F.col("s_suppkey"), F.col("s_acctbal")
    own, above = name("space", k), name("space", F.col("s_nationkey"))
    id_ = F.concat(F.lit("s"), k.cast("string"))
    inline = [statement(name("agent", k + 2), gen("plansToAttend"), own), statement(own, CUSTOM, name("agent", k + 3)), statement(F.lit(CUSTOM), TYPE, gen("InverseRoleProperty"), part="pubinfo")]
    links = [statement(own, gen("hasRootDefinition"), np_iri(F.concat(F.lit("s"), (k - 1).cast("string"))), F.col("s_nationkey") < 10), statement(own, gen("isSubSpaceOf"), above, bal > 5000), statement(own, ns("owl:sameAs"), name("alias", k), bal < 2000), statement(own, gen("isMaintainedBy"), above, bal.between(2000, 5000))]
    noise = [statement(own, ns("rdfs:label"), name("text", k), kind="lit"), statement(F.lit("_:b"), gen("hasAdmin"), name("agent", k))]
    body = F.array(statement(own, TYPE, gen("Space")), statement(own, gen("hasAdmin"), name("agent", k)), statement(own, gen("hasAdmin"), name("agent", k + 1)), *links, *inline, *noise)
    sup = table(spark, sf_dir, "supplier").select(np_iri(id_).alias("np"), code(id_).alias("code"), F.array(F.lit(gen("Space"))).alias("types"), F.sha2(id_, 256).alias("pk"), F.timestamp_micros(epoch + k * minute).alias("created"), body.alias("body"))

    id_ = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", F.col("p_size").cast("long").alias("size"), F.split("p_name", " ")[0].alias("colour"), (F.col("p_name") < "m").alias("first"), F.substring_index("p_brand", "#", -1).cast("long").alias("brand"), np_iri(id_).alias("np"), code(id_).alias("code"), F.sha2(id_, 256).alias("pk"))
    np, size, brand, kind, colour = (F.col(c) for c in ("np", "size", "brand", "p_type", "colour"))
    node, place, role = F.concat(np, F.lit("#node")), name("space", brand), name("role", size)
    says = lambda c, *xs: F.when(c, F.array_compact(F.array(*xs)))
    rest = kind == "STANDARD"
    body = F.coalesce(
        says(kind == "ECONOMY", statement(name("agent", size), gen("plansToAttend"), place)),
        says(kind == "LARGE", statement(place, gen("hasRole"), role), statement(place, gen("hasRole"), name("role", brand))),
        says(kind == "MEDIUM", statement(node, TYPE, gen("SpaceMemberRole")), statement(node, TYPE, MEMBER, size <= 20), statement(node, TYPE, MAINTAINER, size > 40), statement(node, gen("hasRegularProperty"), name("pred", size)), statement(node, gen("hasInverseProperty"), name("pred", brand), F.col("first"))),
        says(kind == "PROMO", statement(node, TYPE, gen("Preset")), statement(node, ns("dct:isVersionOf"), name("kind", brand), size <= 25), statement(node, gen("hasRole"), role), statement(node, gen("appliesToInstancesOf"), gen("Space"), size > 10)),
        says(kind == "SMALL", statement(node, gen("isAssignmentOfPreset"), name("kind", brand)), statement(node, gen("isAssignmentFor"), place), statement(node, TYPE, gen("DeactivatedPresetAssignment"), size > 30)),
        says(rest & (colour == "hot"), statement(node, TYPE, gen("RevokedRoleInstantiation")), statement(node, gen("forSpace"), place), statement(node, gen("forAgent"), name("agent", size)), statement(node, gen("hasRole"), role, size > 5)),
        says(rest & (colour == "red"), statement(place, gen("detachedRole"), role), statement(place, gen("detachedRole"), name("role", brand))),
        says(rest & (colour == "new"), statement(name("space", size), gen("isSubSpaceOf"), place)),
        says(rest & (colour == "old"), statement(name("res", size), gen("isMaintainedBy"), place)),
        says(rest & (colour == "blue"), statement(name("agent", size), CUSTOM, place), statement(F.lit(CUSTOM), TYPE, gen("RegularRoleProperty"), part="pubinfo")),
        F.array(statement(place, gen("hasRole"), role)),
    )
    types = F.when(kind == "ECONOMY", F.array(F.lit(gen("RoleInstantiation")), F.lit(gen("plansToAttend"))))
    for test, t in ((kind == "LARGE", "hasRole"), (kind == "MEDIUM", "SpaceMemberRole"), (kind == "PROMO", "Preset"), (kind == "SMALL", "PresetAssignment"), (colour == "hot", "RevokedRoleInstantiation"), (colour == "red", "detachedRole"), (colour == "new", "isSubSpaceOf"), (colour == "old", "isMaintainedBy"), (colour == "blue", "RoleInstantiation")):
        types = types.when(test, F.array(F.lit(gen(t))))
    parts = p.select("np", "code", types.otherwise(F.array(F.lit(EX + "other"))).alias("types"), "pk", F.timestamp_micros(epoch + F.col("p_partkey") * minute).alias("created"), body.alias("body"))
    both = sup.withColumn("body", F.array_compact("body")).unionByName(parts)
    content = both.select("np", F.posexplode("body").alias("pos", "x")).select("np", "x.part", "pos", "x.s", "x.p", "x.o", "x.o_kind")
    return Extraction(both.drop("body"), content)


def extract_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spaces with their root nanopub, and the definitions with the admins of roots."""
    x = published(spark, sf_dir)
    return x.space_refs().join(x.definitions(), "ref").select("ref", "space", "root_np", "prefix", "def", "np", "root_admin")


def extract_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admins, inline roles and role instantiations, by known and by pinned direction."""
    return published(spark, sf_dir).grants().drop("created")


def extract_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role declarations by predicate."""
    return published(spark, sf_dir).declarations()


def extract_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).attachments().drop("created")


def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-spaces, maintained resources and aliases, in nanopubs of their own and embedded in those of spaces."""
    x = published(spark, sf_dir)
    cols = lambda kind, a, b: [F.lit(kind).alias("kind"), "d", F.col(a).alias("a"), F.col(b).alias("b"), "pk", "np"]
    return x.subspaces().select(*cols("subspace", "child", "parent")).unionByName(x.maintained().select(*cols("maintained", "resource", "space"))).unionByName(x.aliases().select(*cols("alias", "canonical", "alias")))


def extract_presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).preset_declarations().drop("created")


def extract_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir).preset_assignments().drop("created")


def extract_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revocations and detachments."""
    x = published(spark, sf_dir)
    rev = x.revocations().select(F.col("rev").alias("id"), "space", "agent", "role", "pk", "np")
    return rev.unionByName(x.detachments().select(F.col("det").alias("id"), "space", F.lit(None).cast("string").alias("agent"), "role", "pk", "np"))


QUERIES = {f.__name__: f for f in (extract_spaces, extract_grants, extract_roles, extract_attachments, extract_links, extract_presets, extract_assignments, extract_negatives)}

_CODE = "'RA' || substr(sha256({}), 1, 43)"
_NP = "'https://np.example.org/' || " + _CODE
_ROWS = f"""
s AS (
  SELECT *, '{EX}space/' || s_suppkey AS space, {_CODE.format("'s' || s_suppkey")} AS code, {_NP.format("'s' || s_suppkey")} AS np, sha256('s' || s_suppkey) AS pk,
         {_CODE.format("'s' || CASE WHEN s_nationkey < 10 THEN s_suppkey - 1 ELSE s_suppkey END")} AS root FROM supplier),
p AS (
  SELECT *, p_size AS size, split_part(p_name, ' ', 1) AS colour, p_name < 'm' AS first, split_part(p_brand, '#', 2) AS brand, {_CODE.format("'p' || p_partkey")} AS code, {_NP.format("'p' || p_partkey")} AS np,
         sha256('p' || p_partkey) AS pk, '{EX}space/' || split_part(p_brand, '#', 2) AS place, '{EX}role/' || p_size AS role FROM part)"""
_GEN, _NPA = NS["gen"], NS["npa"]

SQL = {
    "extract_spaces": f"""WITH {_ROWS}, ref AS (SELECT *, root || '_' || sha256(space) AS ref, 'https://np.example.org/' || root AS root_np FROM s)
SELECT ref, space, root_np, '{EX}space' AS prefix, '{_NPA}spacedef/' || code AS def, np, CASE WHEN root = code THEN '{EX}agent/' || (s_suppkey + k) END AS root_admin FROM ref, range(CASE WHEN root = code THEN 2 ELSE 1 END) r(k)""",
    "extract_grants": f"""WITH {_ROWS}
SELECT '{_NPA}roleinst/' || code AS ri, space, '{EX}agent/' || (s_suppkey + k) AS agent, 'inverse' AS dir, '{_GEN}hasAdmin' AS pred, pk, np FROM s, range(2) r(k)
UNION ALL SELECT '{_NPA}roleinst/' || code || '_' || sha256('{_GEN}plansToAttend'), space, '{EX}agent/' || (s_suppkey + 2), 'regular', '{_GEN}plansToAttend', pk, np FROM s
UNION ALL SELECT '{_NPA}roleinst/' || code || '_' || sha256('{CUSTOM}'), space, '{EX}agent/' || (s_suppkey + 3), 'inverse', '{CUSTOM}', pk, np FROM s
UNION ALL SELECT '{_NPA}roleinst/' || code, place, '{EX}agent/' || size, 'regular', '{_GEN}plansToAttend', pk, np FROM p WHERE p_type = 'ECONOMY'
UNION ALL SELECT '{_NPA}roleinst/' || code || '_' || sha256('{CUSTOM}' || chr(10) || place), place, '{EX}agent/' || size, 'regular', '{CUSTOM}', pk, np FROM p WHERE p_type = 'STANDARD' AND colour = 'blue'""",
    "extract_roles": f"""WITH {_ROWS}, r AS (SELECT *, np || '#node' AS node, CASE WHEN size <= 20 THEN '{MEMBER}' WHEN size > 40 THEN '{MAINTAINER}' ELSE '{OBSERVER}' END AS tier FROM p WHERE p_type = 'MEDIUM')
SELECT node AS role, tier AS role_type, 'regular' AS dir, '{EX}pred/' || size AS pred, np FROM r UNION ALL SELECT node, tier, 'inverse', '{EX}pred/' || brand, np FROM r WHERE first""",
    "extract_attachments": f"WITH {_ROWS} SELECT '{_NPA}roleassign/' || code AS ra, place AS space, role, pk, np FROM p WHERE p_type = 'LARGE'",
    "extract_links": f"""WITH {_ROWS}, above AS (SELECT *, '{EX}space/' || s_nationkey AS top FROM s)
SELECT 'subspace' AS kind, '{_NPA}subspace/' || code || '_' || sha256(top) AS d, space AS a, top AS b, pk, np FROM above WHERE s_acctbal > 5000 AND space <> top
UNION ALL SELECT 'subspace', '{_NPA}subspace/' || code || '_' || sha256(place), '{EX}space/' || size, place, pk, np FROM p WHERE p_type = 'STANDARD' AND colour = 'new' AND CAST(size AS VARCHAR) <> brand
UNION ALL SELECT 'maintained', '{_NPA}maintainedresource/' || code || '_' || sha256(space), space, top, pk, np FROM above WHERE s_acctbal BETWEEN 2000 AND 5000 AND space <> top
UNION ALL SELECT 'maintained', '{_NPA}maintainedresource/' || code || '_' || sha256('{EX}res/' || size), '{EX}res/' || size, place, pk, np FROM p WHERE p_type = 'STANDARD' AND colour = 'old'
UNION ALL SELECT 'alias', '{_NPA}spacealias/' || code || '_' || sha256('{EX}alias/' || s_suppkey), space, '{EX}alias/' || s_suppkey, pk, np FROM s WHERE s_acctbal < 2000""",
    "extract_presets": f"""WITH {_ROWS}, d AS (SELECT *, np || '#node' AS own, CASE WHEN size <= 25 THEN '{EX}kind/' || brand END AS version FROM p WHERE p_type = 'PROMO')
SELECT '{_NPA}presetdecl/' || code AS pd, coalesce(version, own) AS kind, unnest(list_filter([own, version], lambda x: x IS NOT NULL)) AS preset, role, CASE WHEN size > 10 THEN '{_GEN}Space' END AS applies_to, np FROM d""",
    "extract_assignments": f"WITH {_ROWS} SELECT '{_NPA}presetassign/' || code AS pa, '{EX}kind/' || brand AS preset, place AS resource, size <= 30 AS active, pk, np FROM p WHERE p_type = 'SMALL'",
    "extract_negatives": f"""WITH {_ROWS}, x AS (SELECT * FROM p WHERE p_type = 'STANDARD')
SELECT '{_NPA}rolerevoc/' || code || '_' || sha256('{EX}agent/' || size || chr(10) || role) AS id, place AS space, '{EX}agent/' || size AS agent, role, pk, np FROM x WHERE colour = 'hot' AND size > 5
UNION ALL SELECT '{_NPA}roledetach/' || code || '_' || sha256(role), place, NULL, role, pk, np FROM x WHERE colour = 'red'
UNION ALL SELECT '{_NPA}roledetach/' || code || '_' || sha256('{EX}role/' || brand), place, NULL, '{EX}role/' || brand, pk, np FROM x WHERE colour = 'red' AND CAST(size AS VARCHAR) <> brand""",
}
