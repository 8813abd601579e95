"""From the statements of nanopubs to rows about spaces, roles, presets and resources.

``nanopubs``: np, code, types (array), pk (hash of the signing key), created. ``content``: np, part (assertion,
provenance, pubinfo, head), pos (order of the statement), s, p, o, o_kind. Literals and blank nodes are no resources.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.iri import parent_prefix
from quadrille.functions.text import artifact_code
from quadrille.model import NS, ns
from quadrille.plans.resolve import MAINTAINER, MEMBER, OBSERVER

# Predicates of roles with a known direction; regular = <agent> p <space>, inverse = <space> p <agent>.
REGULAR_PREDICATES = [
    "http://www.wikidata.org/entity/P1344",
    "http://www.wikidata.org/entity/P463",
    "https://w3id.org/fair/3pff/participatedAsFacilitatorAssistantIn",
    "https://w3id.org/fair/3pff/participatedAsFacilitatorIn",
    "https://w3id.org/fair/3pff/participatedAsImplementerAspirantIn",
    "https://w3id.org/fair/3pff/participatedAsImplementerIn",
    "https://w3id.org/fair/3pff/participatedAsParticipantIn",
    "https://w3id.org/fair/3pff/participatedAsTrainerAssistantIn",
    "https://w3id.org/fair/3pff/participatedAsTrainerIn",
    "https://w3id.org/kpxl/gen/terms/plansToAttend",
]
INVERSE_PREDICATES = [
    "http://www.wikidata.org/entity/P710",
    "http://www.wikidata.org/entity/P823",
    "https://w3id.org/fair/3pff/has-event-assistant",
    "https://w3id.org/fair/3pff/has-event-facilitator",
    "https://w3id.org/fair/3pff/has-event-organizer",
    "https://w3id.org/kpxl/gen/terms/hasAdmin",
    "https://w3id.org/kpxl/gen/terms/hasGuest",
    "https://w3id.org/kpxl/gen/terms/hasHost",
    "https://w3id.org/kpxl/gen/terms/hasMaintainer",
    "https://w3id.org/kpxl/gen/terms/hasObserver",
    "https://w3id.org/kpxl/gen/terms/hasProjectLead",
    "https://w3id.org/kpxl/gen/terms/hasTeamMember",
]
# Types of nanopubs that the extraction looks at, besides the predicates above.
OWN_TYPES = [
    "https://w3id.org/kpxl/gen/terms/Space",
    "https://w3id.org/kpxl/gen/terms/hasRole",
    "https://w3id.org/kpxl/gen/terms/SpaceMemberRole",
    "https://w3id.org/kpxl/gen/terms/RoleInstantiation",
    "https://w3id.org/kpxl/gen/terms/isSubSpaceOf",
    "https://w3id.org/kpxl/gen/terms/MaintainedResource",
    "https://w3id.org/kpxl/gen/terms/isMaintainedBy",
    "https://w3id.org/kpxl/gen/terms/Preset",
    "https://w3id.org/kpxl/gen/terms/PresetAssignment",
    "https://w3id.org/kpxl/gen/terms/RevokedRoleInstantiation",
    "https://w3id.org/kpxl/gen/terms/detachedRole",
]
TRIGGER_TYPES = OWN_TYPES + REGULAR_PREDICATES + INVERSE_PREDICATES

TYPE = ns("rdf:type")
gen = lambda x: NS["gen"] + x
npa = lambda kind, *parts: F.concat(F.lit(NS["npa"] + kind + "/"), *parts)


def relevant(types: Column) -> Column:
    """Is a nanopub with these types looked at?"""
    return F.arrays_overlap(types, F.array(*map(F.lit, TRIGGER_TYPES)))


def known_direction(p: Column) -> Column:
    return F.when(p.isin(REGULAR_PREDICATES), "regular").when(p.isin(INVERSE_PREDICATES), "inverse")


class Extraction:
    """Each method gives one kind of rows; tables() gives what the resolver takes."""

    def __init__(self, nanopubs: DataFrame, content: DataFrame):
        self.nanopubs = nanopubs.where(relevant(F.col("types")))
        head = self.nanopubs.select("np", "code", "types", "pk", "created")
        self.assertion = content.where((F.col("part") == "assertion") & (F.col("o_kind") == "iri") & ~F.col("s").startswith("_:")).select("np", "pos", "s", "p", "o").join(head, "np")
        pins = content.where((F.col("part") == "pubinfo") & (F.col("p") == TYPE) & F.col("o").isin(gen("InverseRoleProperty"), gen("RegularRoleProperty")))
        self.pins = pins.groupBy("np", F.col("s").alias("p")).agg(F.max(F.struct("pos", "o")).alias("x")).select("np", "p", F.when(F.col("x.o") == gen("InverseRoleProperty"), "inverse").otherwise("regular").alias("pinned"))

    def typed(self, *types: str) -> DataFrame:
        return self.assertion.where(F.arrays_overlap("types", F.array(*map(F.lit, types))))

    @staticmethod
    def first(df: DataFrame, key: list[str], *cols: str) -> DataFrame:
        """The first statement of each key."""
        return df.groupBy(*key).agg(F.min(F.struct("pos", *cols)).alias("x")).select(*key, *(f"x.{c}" for c in cols))

    def head(self, df: DataFrame) -> DataFrame:
        return df.join(self.nanopubs.select("np", "code", "pk", "created"), "np")

    def spaces(self) -> DataFrame:
        """np, space, root, root_code: declared spaces with their root nanopub, the one named or else the nanopub."""
        a = self.typed(gen("Space"))
        rooted = a.where(F.col("p") == gen("hasRootDefinition")).withColumn("root_code", artifact_code("o")).where("root_code is not null")
        rooted = self.first(rooted.select("np", F.col("s").alias("space"), "pos", F.col("o").alias("root"), "root_code"), ["np", "space"], "root", "root_code")
        own = a.where(((F.col("p") == TYPE) & (F.col("o") == gen("Space"))) | (F.col("p") == gen("hasAdmin"))).where(~F.startswith("s", F.col("np")))
        own = own.select("np", F.col("s").alias("space"), F.col("np").alias("root"), F.col("code").alias("root_code")).distinct().join(rooted.select("np", "space"), ["np", "space"], "left_anti")
        return rooted.unionByName(own).withColumn("ref", F.concat("root_code", F.lit("_"), F.sha2("space", 256)))

    def space_refs(self) -> DataFrame:
        return self.spaces().select("ref", "space", F.col("root").alias("root_np"), parent_prefix(F.col("space")).alias("prefix")).distinct()

    def admin_agents(self) -> DataFrame:
        return self.typed(gen("Space")).where(F.col("p") == gen("hasAdmin")).select("np", F.col("o").alias("agent")).distinct()

    def definitions(self) -> DataFrame:
        """def, ref, np, root_admin: a row per root admin, who counts only where the nanopub is its own root."""
        x = self.head(self.spaces()).join(self.admin_agents(), "np", "left")
        return x.select(npa("spacedef", F.col("code")).alias("def"), "ref", "np", F.when(F.col("root") == F.col("np"), F.col("agent")).alias("root_admin")).distinct()

    def grants(self) -> DataFrame:
        """ri, space, agent, dir, pred, pk, np, created: admins of spaces, inline roles, and role instantiations."""
        cols = ["ri", "space", "agent", "dir", "pred", "pk", "np", "created"]
        spaces = self.spaces().select("np", "space")
        admin = self.head(spaces.join(self.admin_agents(), "np")).select(npa("roleinst", F.col("code")).alias("ri"), "space", "agent", F.lit("inverse").alias("dir"), F.lit(gen("hasAdmin")).alias("pred"), "pk", "np", "created")
        a = self.assertion.join(self.pins, ["np", "p"], "left").withColumn("known", known_direction(F.col("p")))
        a = a.withColumn("dir", F.coalesce("known", "pinned")).where("dir is not null")
        a = a.withColumns({"agent": F.when(F.col("dir") == "regular", F.col("s")).otherwise(F.col("o")), "space": F.when(F.col("dir") == "regular", F.col("o")).otherwise(F.col("s"))})
        inline = a.where(F.col("p") != gen("hasAdmin")).join(spaces, ["np", "space"], "left_semi")
        inline = inline.select(npa("roleinst", F.col("code"), F.lit("_"), F.sha2("p", 256)).alias("ri"), "space", "agent", "dir", F.col("p").alias("pred"), "pk", "np", "created")
        explicit = F.array_contains("types", gen("RoleInstantiation"))
        roles = a.where(explicit | F.arrays_overlap("types", F.array(*map(F.lit, REGULAR_PREDICATES + INVERSE_PREDICATES))))
        # a nanopub whose own admin entry already holds the subject gives no second one
        taken = self.admin_agents().join(spaces, "np", "left_semi").select("np").distinct()
        known = self.first(roles.where("known is not null").select("np", "pos", "space", "agent", "dir", F.col("p").alias("pred")), ["np"], "space", "agent", "dir", "pred")
        one = self.head(known.join(taken, "np", "left_anti")).select(npa("roleinst", F.col("code")).alias("ri"), "space", "agent", "dir", "pred", "pk", "np", "created")
        custom = roles.where(explicit & F.col("known").isNull() & (F.col("p") != TYPE)).join(known.select("np"), "np", "left_anti")
        many = custom.select(npa("roleinst", F.col("code"), F.lit("_"), F.sha2(F.concat("p", F.lit("\n"), "space"), 256)).alias("ri"), "space", "agent", "dir", F.col("p").alias("pred"), "pk", "np", "created")
        return reduce(DataFrame.unionByName, [x.select(*cols) for x in (admin, inline, one, many)]).distinct()

    def attachments(self) -> DataFrame:
        """The first role that a nanopub attaches to a space."""
        a = self.first(self.typed(gen("hasRole")).where(F.col("p") == gen("hasRole")).select("np", "pos", F.col("s").alias("space"), F.col("o").alias("role")), ["np"], "space", "role")
        return self.head(a).select(npa("roleassign", F.col("code")).alias("ra"), "space", "role", "pk", "np", "created")

    def declarations(self) -> DataFrame:
        """role, role_type, dir, pred, np: the first role minted in a nanopub, by predicate; observers by default."""
        a = self.typed(gen("SpaceMemberRole"))
        role = self.first(a.where((F.col("p") == TYPE) & (F.col("o") == gen("SpaceMemberRole")) & F.startswith("s", F.col("np"))).select("np", "pos", F.col("s").alias("role")), ["np"], "role")
        own = a.select("np", "pos", F.col("s").alias("role"), "p", "o").join(role, ["np", "role"])
        tier = self.first(own.where((F.col("p") == TYPE) & F.col("o").isin(MAINTAINER, MEMBER, OBSERVER)), ["np"], "o").withColumnRenamed("o", "tier")
        props = own.where(F.col("p").isin(gen("hasRegularProperty"), gen("hasInverseProperty"))).select("np", F.when(F.col("p") == gen("hasRegularProperty"), "regular").otherwise("inverse").alias("dir"), F.col("o").alias("pred")).distinct()
        return role.join(tier, "np", "left").join(props, "np", "left").select("role", F.coalesce("tier", F.lit(OBSERVER)).alias("role_type"), "dir", "pred", "np")

    def _pairs(self, pred: str, types: list[str]) -> DataFrame:
        """Statements of a predicate in nanopubs of these types, and on declared spaces, without loops."""
        a = self.assertion.where((F.col("p") == pred) & (F.col("s") != F.col("o")))
        alone = a.where(F.arrays_overlap("types", F.array(*map(F.lit, types))))
        embedded = a.join(self.spaces().select("np", F.col("space").alias("s")), ["np", "s"], "left_semi")
        return alone.select("np", "s", "o", "code", "pk").unionByName(embedded.select("np", "s", "o", "code", "pk")).distinct()

    def subspaces(self) -> DataFrame:
        return self._pairs(gen("isSubSpaceOf"), [gen("isSubSpaceOf")]).select(npa("subspace", F.col("code"), F.lit("_"), F.sha2("o", 256)).alias("d"), F.col("s").alias("child"), F.col("o").alias("parent"), "pk", "np")

    def maintained(self) -> DataFrame:
        return self._pairs(gen("isMaintainedBy"), [gen("MaintainedResource"), gen("isMaintainedBy")]).select(npa("maintainedresource", F.col("code"), F.lit("_"), F.sha2("s", 256)).alias("d"), F.col("s").alias("resource"), F.col("o").alias("space"), "pk", "np")

    def aliases(self) -> DataFrame:
        """owl:sameAs of a declared space; the subject is the canonical one."""
        a = self.assertion.where((F.col("p") == ns("owl:sameAs")) & (F.col("s") != F.col("o"))).join(self.spaces().select("np", F.col("space").alias("s")), ["np", "s"], "left_semi")
        return a.select(npa("spacealias", F.col("code"), F.lit("_"), F.sha2("o", 256)).alias("d"), F.col("s").alias("canonical"), F.col("o").alias("alias"), "pk", "np").distinct()

    def preset_declarations(self) -> DataFrame:
        """pd, kind, preset, role, applies_to, np, created, a row for each combination; the kind is what the preset is a
        version of, or itself."""
        a = self.typed(gen("Preset"))
        preset = self.first(a.where((F.col("p") == TYPE) & (F.col("o") == gen("Preset")) & F.startswith("s", F.col("np"))).select("np", "pos", F.col("s").alias("own")), ["np"], "own")
        own = a.select("np", "pos", F.col("s").alias("own"), "p", "o").join(preset, ["np", "own"])
        kinds = own.where(F.col("p") == ns("dct:isVersionOf"))
        kind = self.first(kinds, ["np"], "o").withColumnRenamed("o", "k")
        names = preset.select("np", F.col("own").alias("preset")).unionByName(kinds.select("np", F.col("o").alias("preset"))).distinct()
        objects = lambda p, c: own.where(F.col("p") == gen(p)).select("np", F.col("o").alias(c)).distinct()
        x = self.head(preset).join(kind, "np", "left").join(names, "np").join(objects("hasRole", "role"), "np", "left").join(objects("appliesToInstancesOf", "applies_to"), "np", "left")
        return x.select(npa("presetdecl", F.col("code")).alias("pd"), F.coalesce("k", "own").alias("kind"), "preset", "role", "applies_to", "np", "created")

    def preset_assignments(self) -> DataFrame:
        a = self.typed(gen("PresetAssignment"))
        x = self.first(a.where(F.col("p") == gen("isAssignmentOfPreset")).select("np", "pos", F.col("s").alias("node"), F.col("o").alias("preset")), ["np"], "node", "preset")
        own = a.select("np", "pos", F.col("s").alias("node"), "p", "o").join(x.select("np", "node"), ["np", "node"], "left_semi")
        res = self.first(own.where(F.col("p") == gen("isAssignmentFor")).select("np", "pos", F.col("o").alias("resource")), ["np"], "resource")
        off = own.where((F.col("p") == TYPE) & (F.col("o") == gen("DeactivatedPresetAssignment"))).select("np", F.lit(False).alias("on")).distinct()
        y = self.head(x).join(res, "np").join(off, "np", "left")
        return y.select(npa("presetassign", F.col("code")).alias("pa"), "preset", "resource", F.coalesce("on", F.lit(True)).alias("active"), "pk", "np", "created")

    def revocations(self) -> DataFrame:
        """Revoked instantiations with all of space, agent and role."""
        a = self.typed(gen("RevokedRoleInstantiation"))
        node = a.where((F.col("p") == TYPE) & (F.col("o") == gen("RevokedRoleInstantiation"))).select("np", "s").distinct()
        get = lambda p: F.min(F.when(F.col("p") == gen(p), F.struct("pos", "o")))["o"]
        x = a.join(node, ["np", "s"], "left_semi").groupBy("np", "s").agg(get("forSpace").alias("space"), get("forAgent").alias("agent"), get("hasRole").alias("role")).dropna()
        return self.head(x).select(npa("rolerevoc", F.col("code"), F.lit("_"), F.sha2(F.concat("agent", F.lit("\n"), "role"), 256)).alias("rev"), "space", "agent", "role", "pk", "np", "created").distinct()

    def detachments(self) -> DataFrame:
        a = self.typed(gen("detachedRole")).where(F.col("p") == gen("detachedRole"))
        return a.select(npa("roledetach", F.col("code"), F.lit("_"), F.sha2("o", 256)).alias("det"), F.col("s").alias("space"), F.col("o").alias("role"), "pk", "np", "created").distinct()

    def tables(self) -> dict[str, DataFrame]:
        return {
            "ref_iri": self.space_refs().select("ref", "space", "prefix").distinct(),
            "definition": self.definitions().select("ref", "np", "root_admin"),
            "grant": self.grants(),
            "attachment": self.attachments(),
            "declaration": self.declarations(),
            "subspace": self.subspaces(),
            "maintained": self.maintained(),
            "alias": self.aliases(),
            "preset_decl": self.preset_declarations(),
            "preset_assign": self.preset_assignments(),
            "revocation": self.revocations(),
            "detachment": self.detachments(),
        }
