"""SPARQL over quads: patterns become joins, filters and aggregations of DataFrames; Catalyst plans the rest."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.model import QUAD_COLUMNS, FlatQuads, QuadSource, node_term, term
from quadrille.operators.closure import closure
from quadrille.plans.textsearch import TextSearch
from quadrille.session import materialize
from quadrille.sparql import expressions as X
from quadrille.sparql.expressions import Val
from quadrille.sparql.parser import Query, SparqlError, parse, parse_update, variables

#: Fixed value: the namespace of full-text patterns.
SEARCH = "http://www.openrdf.org/contrib/lucenesail#"

TERM = T.StructType([T.StructField(c, T.StringType(), False) for c in ("k", "v", "dt", "lang")])


@dataclass
class Sol:
    """Solutions: a column v_<name> per variable, a string for one that is only ever an IRI or blank node ("iri"), a
    struct for others ("term"); null = unbound. ``sure``: variables that are bound in every row."""

    df: DataFrame
    vars: dict[str, str]
    sure: frozenset[str]

    def val(self, name: str) -> Val:
        return Val(self.vars[name], F.col(f"`v_{name}`"))

    def as_terms(self, names) -> Sol:
        """These variables as structs."""
        turn = [n for n in names if self.vars.get(n) == "iri"]
        df = self.df.withColumns({f"v_{n}": node_term(F.col(f"`v_{n}`")) for n in turn}) if turn else self.df
        return Sol(df, self.vars | dict.fromkeys(turn, "term"), self.sure)

    def only(self, names) -> Sol:
        keep = [n for n in self.vars if n in set(names)]
        return Sol(self.df.select(*(f"`v_{n}`" for n in keep)), {n: self.vars[n] for n in keep}, self.sure & set(keep))


@dataclass(frozen=True)
class Scope:
    """Where patterns are matched: a graph and a repository, each None (any), a constant or a variable. ``dataset``: the
    graphs that make up the default graph and those that GRAPH speaks of, None = all of both."""

    g: tuple | None = None
    repo: tuple | None = None
    dataset: tuple | None = None


def _align(a: Sol, b: Sol) -> tuple[Sol, Sol]:
    mixed = [n for n in a.vars if n in b.vars and a.vars[n] != b.vars[n]]
    return a.as_terms(mixed), b.as_terms(mixed)


def _rename(b: Sol, names) -> DataFrame:
    return b.df.withColumnsRenamed({f"v_{n}": f"w_{n}" for n in names})


def join(a: Sol | None, b: Sol, how: str = "inner", on: Column | None = None) -> Sol:
    """Join of compatible solutions; ``on`` is a further condition over the merged row (left joins)."""
    if a is None:
        return b
    a, b = _align(a, b)
    shared = [n for n in a.vars if n in b.vars]
    sure = [n for n in shared if n in a.sure and n in b.sure]
    loose = [n for n in shared if n not in sure]
    names = a.vars | b.vars
    bound = a.sure | (b.sure if how == "inner" else frozenset())
    if not loose and on is None and how == "inner":
        if sure:
            return Sol(a.df.join(b.df, [f"v_{n}" for n in sure]), names, bound)
        return Sol(a.df.crossJoin(b.df), names, bound)
    right = _rename(b, shared)
    if not loose:
        conds = [F.col(f"`v_{n}`") == F.col(f"`w_{n}`") for n in sure] + ([on] if on is not None else [])
        df = a.df.join(right, reduce(lambda x, y: x & y, conds) if conds else F.lit(True), how)
        return Sol(df.drop(*(f"w_{n}" for n in shared)), names, bound)
    loose_a, loose_b = [n for n in shared if n not in a.sure], [n for n in shared if n not in b.sure]
    parts = []
    for has_a, rows_a in _arms(a.df, "v", shared, loose_a):
        alone = rows_a
        for has_b, rows_b in _arms(right, "w", shared, loose_b):
            conds = [F.col(f"`v_{n}`") == F.col(f"`w_{n}`") for n in shared if n in has_a and n in has_b] + ([on] if on is not None else [])
            cond = reduce(lambda x, y: x & y, conds) if conds else F.lit(True)
            parts.append(rows_a.join(rows_b, cond, how if not loose_b else "inner"))
            alone = alone.join(rows_b, cond, "left_anti")
        if how == "left" and loose_b:
            parts.append(alone)
    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    df = df.withColumns({f"v_{n}": F.coalesce(F.col(f"`v_{n}`"), F.col(f"`w_{n}`")) for n in loose}).drop(*(f"w_{n}" for n in shared))
    return Sol(df, names, bound)


def _arms(df: DataFrame, prefix: str, shared: list[str], loose: list[str]) -> list[tuple[set[str], DataFrame]]:
    """The rows by which of the ``loose`` variables they bind, with all the variables bound in each part. Within a part
    compatible means equal, so parts are joined on keys; a test for null in the join would rule that out."""
    out = [(set(shared), df)]
    for n in loose:
        c = F.col(f"`{prefix}_{n}`")
        out = [x for has, rows in out for x in ((has, rows.where(c.isNotNull())), (has - {n}, rows.where(c.isNull())))]
    return out


def _key(c_kind: Column, v: Column, dt: Column, lang: Column) -> Column:
    """A term as one string: IRIs and blank nodes as they are, literals with their datatype and language first."""
    return F.when(c_kind == "lit", F.concat(F.lit('"'), dt, F.lit(" "), lang, F.lit(" "), v)).otherwise(v)


def _const_key(t: tuple) -> str:
    return t[1] if t[0] == "iri" else f'"{t[2]} {t[3]} {t[1]}'


def _unkey(c: Column) -> Column:
    parts = F.split(F.substr(c, F.lit(2)), " ", 3)
    return F.when(F.startswith(c, F.lit('"')), term("lit", parts[2], parts[0], parts[1])).otherwise(node_term(c))


class Engine:
    """Queries and updates over one quad source. ``base``: IRI prefix of repositories in SERVICE clauses. ``text``: what
    search:matches asks, by default an index of all literals."""

    def __init__(self, spark: SparkSession, source: QuadSource, base: str = "https://query.example.org/repo/", prefixes: dict[str, str] | None = None, text: TextSearch | None = None):
        self.spark, self.source, self.base, self.prefixes, self.text = spark, source, base, prefixes or {}, text

    # -- results
    def query(self, text: str, repo: str | None = None, terms: bool = False) -> DataFrame:
        """A table of the results. SELECT: a column per variable, lexical forms as strings (``terms``: structs of
        kind, value, datatype, language). ASK: one boolean. CONSTRUCT and DESCRIBE: s, p, o with the object's kind,
        datatype and language."""
        q = parse(text, self.prefixes)
        scope = Scope(repo=("iri", repo) if repo else None, dataset=q.dataset)
        if q.form == "ask":
            return self.group(q.where, scope).df.limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
        if q.form in ("construct", "describe"):
            return self._graph(q, scope)
        sol = self.select(q, scope)
        names = [n for _, n in q.projection] if q.projection is not None else [n for n in sol.vars if not n.startswith("_")]
        get = (lambda n: X.to_term(sol.val(n))) if terms else (lambda n: X.text(sol.val(n)))
        none = F.lit(None).cast(TERM if terms else "string")
        return sol.df.select(*((get(n) if n in sol.vars else none).alias(n) for n in names))

    def _graph(self, q: Query, scope: Scope) -> DataFrame:
        if q.form == "construct":
            sol = self.select(replace(q, form="select", projection=None), scope)
            return self.instantiate(sol, q.template).select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct()
        nodes = [self.spark.createDataFrame([(t[1],) for t in q.projection if t[0] == "iri"], "s string")]
        named = [t[1] for t in q.projection if t[0] == "var"]
        if named:
            sol = self.select(replace(q, form="select", projection=[(("var", n), n) for n in named]), scope)
            nodes += [sol.df.select(X.text(sol.val(n)).alias("s")) for n in named if n in sol.vars]
        wanted = reduce(DataFrame.unionByName, nodes).distinct()
        return self.quads(scope).join(wanted, "s", "left_semi").select("s", "p", "o", "o_kind", "o_dt", "o_lang").distinct()

    def instantiate(self, sol: Sol, template: list) -> DataFrame:
        """The quads of a template for every solution; incomplete ones and literal subjects or predicates drop out."""
        out = []
        for s, p, o, g in template:
            val = lambda t: (X.to_term(sol.val(t[1])) if t[1] in sol.vars else F.lit(None).cast(TERM)) if t[0] == "var" else term(*(("iri", F.lit(t[1])) if t[0] == "iri" else ("lit", F.lit(t[1]), t[2], t[3])))
            row = sol.df.select(val(s).alias("s"), val(p).alias("p"), val(o).alias("o"), (val(g) if g else term("iri", F.lit(""))).alias("g"))
            row = row.where("s.k <> 'lit' and p.k = 'iri' and o is not null and g.k = 'iri'")
            out.append(row.select(F.lit("").alias("repo"), "g.v", "s.v", "p.v", "o.v", "o.k", "o.dt", "o.lang").toDF(*QUAD_COLUMNS))
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], "repo string, g string, s string, p string, o string, o_kind string, o_dt string, o_lang string")

    def update(self, text: str) -> DataFrame:
        """The quads after a sequence of updates; this engine then answers from them. Nothing is changed in place."""
        for k, op in enumerate(parse_update(text, self.prefixes)):
            if k:  # the operations before are written, so that plans do not grow with their number
                self.source = FlatQuads(materialize(self.source.scan(None, None, None, None, None).select(*QUAD_COLUMNS), "quads")[0])
            quads = self.source.scan(None, None, None, None, None).select(*QUAD_COLUMNS)
            if op[0] == "drop":
                quads = quads.where(F.col("g") != op[1][1]) if op[1] else quads.where("false")
            else:
                _, gone, new, where = op
                sol = self.group(where, Scope()) if where else Sol(self.spark.range(1).select(), {}, frozenset())
                key = ["s", "p", "o", "o_kind", "o_dt", "o_lang"]
                if any(g for *_, g in gone):
                    quads = quads.join(self.instantiate(sol, [x for x in gone if x[3]]).select("g", *key).distinct(), ["g", *key], "left_anti")
                if any(not g for *_, g in gone):
                    quads = quads.join(self.instantiate(sol, [x for x in gone if not x[3]]).select(*key).distinct(), key, "left_anti")
                quads = quads.select(*QUAD_COLUMNS).unionByName(self.instantiate(sol, new)).distinct() if new else quads.select(*QUAD_COLUMNS)
            self.source = FlatQuads(quads)
        return self.source.scan(None, None, None, None, None)

    # -- query level
    def select(self, q: Query, scope: Scope, seed: Sol | None = None) -> Sol:
        sol = self.group(q.where, scope, seed)
        if q.values:
            sol = join(sol, self.inline(*q.values))
        exprs = [e for e, _ in q.projection or []] + q.having + [e for e, _ in q.order_by]
        if q.group_by or any(_aggregates(e) for e in exprs):
            sol, q = self.aggregate(sol, q)
        df, names, sure = sol.df, dict(sol.vars), set(sol.sure)
        if q.projection is not None:
            for e, n in q.projection:
                if e != ("var", n):
                    sol, v = self.value(e, Sol(df, names, frozenset(sure)), scope)
                    t = v.t if v.t in ("iri", "term") else "term"
                    df, names = sol.df.withColumn(f"v_{n}", v.c if v.t == t else X.to_term(v)), names | {n: t}
        sol = Sol(df, names, frozenset(sure))
        keep = [n for _, n in q.projection] if q.projection is not None else [n for n in names if not n.startswith("_")]
        if q.distinct:
            sol = sol.only(keep)
            sol = Sol(sol.df.distinct(), sol.vars, sol.sure)
        if q.order_by:
            keys = []
            for e, desc in q.order_by:
                sol, v = self.value(e, sol, scope)
                k = X.order_key(v)
                keys.append(k.desc_nulls_last() if desc else k.asc_nulls_first())
            sol = Sol(sol.df.orderBy(*keys), sol.vars, sol.sure)
        df = sol.df
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Sol(df, sol.vars, sol.sure).only(keep)

    def aggregate(self, sol: Sol, q: Query) -> tuple[Sol, Query]:
        """Group and aggregate; aggregates in the query become variables."""
        keys, names = [], {}
        for k, (e, name) in enumerate(q.group_by):
            sol, v = self.value(e, sol, Scope())
            n = name or f"_key{k}"
            t = v.t if v.t in ("iri", "term") else "term"
            keys.append((n, t, (v.c if v.t == t else X.to_term(v)).alias(f"v_{n}")))
            names[n] = t
        aggs: dict[tuple, str] = {}

        def lift(e):
            if isinstance(e, tuple) and e and e[0] == "agg":
                return ("var", aggs.setdefault(_freeze(e), f"_agg{len(aggs)}"))
            return type(e)(lift(x) for x in e) if isinstance(e, tuple | list) else e

        q = replace(q, projection=[(lift(e), n) for e, n in q.projection or []], having=[lift(e) for e in q.having], order_by=[(lift(e), d) for e, d in q.order_by], group_by=[])
        cols, kinds = [], {}
        for e, n in aggs.items():
            c, kinds[n] = self._aggregate(e, sol)
            cols.append(c.alias(f"v_{n}"))
        cols = cols or [F.count(F.lit(1)).alias("v__n")]
        df = sol.df.groupBy(*(c for *_, c in keys)).agg(*cols)
        df = df.withColumns({f"v_{n}": X.to_term(Val(k, F.col(f"`v_{n}`"))) for n, k in kinds.items() if k != "term"})
        out = Sol(df, names | dict.fromkeys(kinds, "term"), frozenset(n for n in names if n in sol.sure))
        for e in q.having:
            out = self.filter(out, e, Scope())
        return out, q

    def _aggregate(self, e: tuple, sol: Sol) -> tuple[Column, str]:
        _, name, distinct, arg, sep = e
        if arg is None:
            return (F.countDistinct(F.struct(*(f"`v_{n}`" for n in sol.vars))) if distinct else F.count(F.lit(1))), "int"
        _, v = self.value(arg, sol, Scope())
        t = X.to_term(v)
        if name == "COUNT":
            return (F.countDistinct(t) if distinct else F.count(t)), "int"
        if name in ("SUM", "AVG"):
            n = X.number(v)
            f = (F.sum_distinct if distinct else F.sum) if name == "SUM" else F.avg
            if name == "AVG" and distinct:
                return F.coalesce(F.sum_distinct(n) / F.countDistinct(n), F.lit(0.0)), "num"
            return F.coalesce(f(n), F.lit(0)), "int" if v.t == "int" and name == "SUM" else "num"
        if name in ("MIN", "MAX"):
            k = X.order_key(v)
            return (F.min_by if name == "MIN" else F.max_by)(t, k), "term"
        if name == "SAMPLE":
            return F.min_by(t, X.order_key(v)), "term"
        parts = X.text(v)
        return F.array_join(F.sort_array((F.collect_set if distinct else F.collect_list)(parts)), sep), "str"

    # -- groups
    def group(self, elements: list, scope: Scope, seed: Sol | None = None) -> Sol:
        sol, filters = seed, []
        for e in elements:
            kind = e[0]
            if kind == "bgp":
                sol = self.bgp(e[1], scope, sol)
            elif kind == "filter":
                filters.append(e[1])
            elif kind == "bind":
                sol, v = self.value(e[1], sol or self.unit(), scope)
                t = v.t if v.t in ("iri", "term") else "term"
                sol = Sol(sol.df.withColumn(f"v_{e[2]}", v.c if t == v.t else X.to_term(v)), sol.vars | {e[2]: t}, sol.sure)
            elif kind == "values":
                sol = join(sol, self.inline(e[1], e[2]))
            elif kind == "group":
                sol = join(sol, self.group(e[1], scope))
            elif kind == "graph":
                inner = replace(scope, g=e[1])
                sol = self.group(e[2], inner, sol) if _simple(e[2]) else join(sol, self.group(e[2], inner))
            elif kind == "service":
                inner = replace(scope, repo=("iri", e[1][1].removeprefix(self.base)) if e[1][0] == "iri" else e[1], g=None, dataset=None)
                sol = join(sol, self.group(e[2], inner))
            elif kind == "union":
                sol = join(sol, self.union([self.group(arm, scope) for arm in e[1]]))
            elif kind == "optional":
                sol = self.optional(sol or self.unit(), e[1], scope)
            elif kind == "minus":
                sol = self.minus(sol or self.unit(), self.group(e[1], scope))
            elif kind == "select":
                sol = join(sol, self.select(e[1], scope))
        sol = sol or self.unit()
        for e in filters:
            for part in _conjuncts(e):
                sol = self.filter(sol, part, scope)
        return sol

    def unit(self) -> Sol:
        return Sol(self.spark.range(1).select(F.lit(1).alias("v__unit")), {}, frozenset())

    def inline(self, names: list[str], rows: list) -> Sol:
        lit = [tuple(None if t is None else ("iri", t[1], "", "") if t[0] == "iri" else ("lit", t[1], t[2], t[3]) for t in r) for r in rows]
        df = self.spark.createDataFrame(lit, T.StructType([T.StructField(f"v_{n}", TERM) for n in names]))
        sure = frozenset(n for k, n in enumerate(names) if all(r[k] is not None for r in rows))
        iris = [n for k, n in enumerate(names) if all(r[k] is None or r[k][0] == "iri" for r in rows)]
        df = df.withColumns({f"v_{n}": F.col(f"`v_{n}`")["v"] for n in iris}) if iris else df
        return Sol(df, {n: "iri" if n in iris else "term" for n in names}, sure)

    def union(self, arms: list[Sol]) -> Sol:
        names: dict[str, str] = {}
        for a in arms:
            for n, t in a.vars.items():
                names[n] = t if names.get(n, t) == t else "term"
        arms = [a.as_terms([n for n in a.vars if names[n] == "term"]) for a in arms]
        cols = lambda a: [(F.col(f"`v_{n}`") if n in a.vars else F.lit(None).cast("string" if t == "iri" else TERM)).alias(f"v_{n}") for n, t in names.items()]
        df = reduce(DataFrame.unionByName, [a.df.select(*cols(a)) for a in arms])
        return Sol(df, names, frozenset.intersection(*(a.sure for a in arms)))

    def optional(self, sol: Sol, elements: list, scope: Scope) -> Sol:
        tests = [e[1] for e in elements if e[0] == "filter"]
        inner = self.group([e for e in elements if e[0] != "filter"], scope)
        own = [t for t in tests if variables(t) <= set(inner.vars) or _has_exists(t)]
        for t in own:
            inner = self.filter(inner, t, scope)
        rest = [t for t in tests if t not in own]
        if not rest:
            return join(sol, inner, "left")
        a, b = _align(sol, inner)
        both = Sol(a.df, a.vars | b.vars, a.sure)
        cond = reduce(lambda x, y: x & y, [X.boolean(self.value(t, both, scope)[1]) for t in rest])
        return join(a, b, "left", cond)

    def minus(self, a: Sol, b: Sol) -> Sol:
        a, b = _align(a, b)
        shared = [n for n in a.vars if n in b.vars]
        if not shared:
            return a
        if all(n in a.sure and n in b.sure for n in shared):
            return Sol(a.df.join(b.only(shared).df.distinct(), [f"v_{n}" for n in shared], "left_anti"), a.vars, a.sure)
        right = _rename(b.only(shared), shared).distinct()
        parts = []
        for has_a, rows in _arms(a.df, "v", shared, [n for n in shared if n not in a.sure]):
            for has_b, others in _arms(right, "w", shared, [n for n in shared if n not in b.sure]):
                if keys := has_a & has_b:
                    rows = rows.join(others, reduce(lambda x, y: x & y, [F.col(f"`v_{n}`") == F.col(f"`w_{n}`") for n in sorted(keys)]), "left_anti")
            parts.append(rows)
        return Sol(reduce(DataFrame.unionByName, parts), a.vars, a.sure)

    # -- filters
    def filter(self, sol: Sol, e: tuple, scope: Scope) -> Sol:
        if e[0] == "exists":
            return self.exists(sol, e[1], scope, "left_semi")
        if e[0] == "not" and e[1][0] == "exists":
            return self.exists(sol, e[1][1], scope, "left_anti")
        out, v = self.value(e, sol, scope)
        return Sol(out.df.where(X.boolean(v)), sol.vars, sol.sure).only(sol.vars) if sol.vars else Sol(out.df.where(X.boolean(v)), sol.vars, sol.sure)

    def matches(self, sol: Sol, elements: list, scope: Scope) -> tuple[Sol, list[str]]:
        """The solutions of a pattern inside EXISTS, and the variables it shares with the row outside. If a filter in
        it, at any depth, speaks of variables that only the outside binds, or sharing is not certain, the pattern is
        evaluated on the distinct outside bindings; else by itself."""
        if found := self.extremes(sol, elements, scope):
            return found
        bound = _binds(elements)
        outside = (variables(elements) - bound) & set(sol.vars)
        shared = sorted(variables(elements) & set(sol.vars))
        if not outside:
            inner = self.group(elements, scope)
            common = [n for n in shared if n in inner.vars]
            if all(n in sol.sure and n in inner.sure for n in common):
                return inner, common
        seed = sol.only(shared)
        return self.group(elements, scope, Sol(seed.df.distinct(), seed.vars, seed.sure)), shared

    def extremes(self, sol: Sol, elements: list, scope: Scope) -> tuple[Sol, list[str]] | None:
        """EXISTS over a pattern with one ordering comparison of two variables, of parts that have only outside
        variables in common: some pair satisfies it if and only if the extreme values do. Each side is reduced to its
        extreme per outside binding before it is joined, so that no key's rows are paired. None if the pattern is another."""
        tests = [t for e in elements if e[0] == "filter" for t in _conjuncts(e[1])]
        triples = [t for e in elements if e[0] == "bgp" for t in e[1]]
        if "var" in ((scope.g or "_")[0], (scope.repo or "_")[0]) or any(e[0] not in ("bgp", "filter") for e in elements) or len(tests) != 1 or tests[0][0] != "cmp" or tests[0][1] not in ("<", "<=", ">", ">="):
            return None
        _, op, a, b = tests[0]
        if a[0] != "var" or b[0] != "var" or any(t[1][0] != "p" for t in triples) or not all(n in sol.sure for n in variables(elements) & set(sol.vars)):
            return None
        parts: list[tuple[set, list]] = []
        for t in triples:
            own, apart = variables(t) - set(sol.vars), []
            mine = [t]
            for vs, ts in parts:
                if vs & own:
                    own, mine = own | vs, ts + mine
                else:
                    apart.append((vs, ts))
            parts = [*apart, (own, mine)]
        side = {n: next((k for k, (vs, _) in enumerate(parts) if n in vs), None) for n in (a[1], b[1])}
        if side[a[1]] == side[b[1]] or any(k is None and n not in sol.vars for n, k in side.items()):
            return None
        shared = sorted(variables(elements) & set(sol.vars))
        out = sol.only(shared)
        out = Sol(out.df.distinct(), out.vars, out.sure)
        for k, (_, ts) in enumerate(parts):
            inner = self.bgp(ts, scope, None)
            keys = [n for n in shared if n in inner.vars]
            name = next((n for n, m in side.items() if m == k), None)
            if name is None:
                inner = Sol(inner.only(keys).df.distinct(), {n: inner.vars[n] for n in keys}, frozenset(keys))
            else:
                kind, place = X.comparable(inner.val(name))
                most = F.max_by if (op[0] == ">") == (name == a[1]) else F.min_by
                cols = [f"v_{n}" for n in keys]
                rows = inner.as_terms([name]).df.withColumns({"_kind": kind, "_place": place})
                rows = rows.where(F.col("_place.n").isNotNull() | F.col("_place.i").isNotNull() | ~F.col("_kind").isin("number", "time"))
                rows = rows.groupBy(*cols, "_kind").agg(most(f"v_{name}", "_place").alias(f"v_{name}")).drop("_kind")
                inner = Sol(rows, {n: inner.vars[n] for n in keys} | {name: "term"}, frozenset([*keys, name]))
            out = join(out, inner)
        return self.filter(out, tests[0], scope).only(shared), shared

    def exists(self, sol: Sol, elements: list, scope: Scope, how: str) -> Sol:
        inner, keys = self.matches(sol, elements, scope)
        a, b = _align(sol, inner)
        if not keys:
            return Sol(a.df.join(b.df.limit(1).select(F.lit(1).alias("_one")), F.lit(True), how), sol.vars, sol.sure)
        if all(n in a.sure and n in b.sure for n in keys):
            df = a.df.join(b.only(keys).df.distinct(), [f"v_{n}" for n in keys], how)
        else:
            right = _rename(b.only(keys), keys).distinct()
            df = a.df.join(right, reduce(lambda x, y: x & y, [F.col(f"`v_{n}`").eqNullSafe(F.col(f"`w_{n}`")) for n in keys]), how)
        return Sol(df, a.vars, a.sure)

    def value(self, e: tuple, sol: Sol, scope: Scope) -> tuple[Sol, Val]:
        """The value of an expression on each row, and the solutions with any columns it needed."""
        kind = e[0]
        if kind == "var":
            return sol, sol.val(e[1]) if e[1] in sol.vars else Val("term", F.lit(None).cast(TERM))
        if kind == "iri":
            return sol, Val("iri", F.lit(e[1]))
        if kind == "lit":
            dt = e[2].rpartition("#")[2]
            if dt == "string":
                return sol, Val("str", F.lit(e[1]))
            if dt == "integer":
                return sol, Val("int", F.lit(int(e[1])).cast("long"))
            if dt == "boolean":
                return sol, Val("bool", F.lit(e[1] in ("true", "1")))
            return sol, Val("term", term("lit", F.lit(e[1]), e[2], e[3]))
        if kind == "exists":
            inner, keys = self.matches(sol, e[1], scope)
            a, b = _align(sol, inner)
            flag = f"v__e{len(a.df.columns)}"
            right = _rename(b.only(keys), keys).distinct().withColumn(flag, F.lit(True)) if keys else b.df.limit(1).select(F.lit(True).alias(flag))
            cond = reduce(lambda x, y: x & y, [F.col(f"`v_{n}`").eqNullSafe(F.col(f"`w_{n}`")) for n in keys], F.lit(True))
            df = a.df.join(right, cond, "left").drop(*(f"w_{n}" for n in keys))
            return Sol(df, a.vars, a.sure), Val("bool", F.col(flag).isNotNull())
        if kind in ("and", "or"):
            sol, a = self.value(e[1], sol, scope)
            sol, b = self.value(e[2], sol, scope)
            x, y = X.boolean(a), X.boolean(b)
            return sol, Val("bool", x & y if kind == "and" else x | y)
        if kind == "not":
            sol, a = self.value(e[1], sol, scope)
            return sol, Val("bool", ~X.boolean(a))
        if kind == "cmp":
            sol, a = self.value(e[2], sol, scope)
            sol, b = self.value(e[3], sol, scope)
            return sol, Val("bool", X.compare(e[1], a, b))
        if kind == "in":
            sol, a = self.value(e[1], sol, scope)
            tests = []
            for item in e[2]:
                sol, b = self.value(item, sol, scope)
                tests.append(X.compare("=", a, b))
            return sol, Val("bool", reduce(lambda x, y: x | y, tests, F.lit(False)))
        if kind == "arith":
            sol, a = self.value(e[2], sol, scope)
            sol, b = self.value(e[3], sol, scope)
            x, y = X.number(a), X.number(b)
            whole = a.t == b.t == "int" and e[1] != "/"
            f = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[e[1]]
            return sol, Val("int" if whole else "num", f if whole else f.cast("double"))
        if kind == "call":
            args = []
            for a in e[2]:
                sol, v = self.value(a, sol, scope)
                args.append(v)
            return sol, X.call(e[1], args)
        raise SparqlError(f"no value for {kind}")

    # -- basic graph patterns
    def text_matches(self, triples: list, scope: Scope, sol: Sol | None) -> tuple[list, Sol | None]:
        """Answer ``?s search:matches [ search:query "..." ; search:property ... ; search:score ?x ; search:snippet ?y ]``;
        the other triples and the solutions. The query is a constant, as prepared bindings make it."""
        for ask in [t for t in triples if t[1] == ("p", SEARCH + "matches")]:
            s, _, node = ask
            own = [t for t in triples if t[0] == node and t[1][0] == "p" and t[1][1].startswith(SEARCH)]
            triples = [t for t in triples if t is not ask and t not in own]
            given = {t[1][1].removeprefix(SEARCH): t[2] for t in own}
            if given.get("query", ("",))[0] != "lit" or set(given) - {"query", "property", "score", "snippet"} or s[0] == "lit":
                raise SparqlError("search:matches needs a search:query that is a literal; known are query, property, score, snippet")
            prop = given.get("property")
            repo = scope.repo[1] if scope.repo and scope.repo[0] == "iri" else None
            index = self.text or TextSearch(self.source.scan(repo, None, None, prop[1] if prop and prop[0] == "iri" else None, None))
            df = index.matches(given["query"][1], prop[1] if prop and prop[0] == "iri" else None)
            if s[0] == "iri":
                df = df.where(F.col("s") == s[1])
            cols = [(s[1], "iri", F.col("s"))] if s[0] == "var" else []
            cols += [(prop[1], "iri", F.col("p"))] if prop and prop[0] == "var" else []
            cols += [(given[k][1], "term", X.to_term(Val(t, F.col(k)))) for k, t in (("score", "num"), ("snippet", "str")) if k in given and given[k][0] == "var"]
            sol = join(sol, self._collect(df, cols))
        return triples, sol

    def bgp(self, triples: list, scope: Scope, sol: Sol | None) -> Sol:
        triples, sol = self.text_matches(triples, scope, sol)
        stars: dict[tuple, list] = {}
        for s, p, o in triples:
            if s[0] == "var" and p[0] == "p" and o[0] == "var" and o != s:
                stars.setdefault(s, []).append((p[1], o[1]))
        todo: list = list(triples)
        ready: list[Sol] = []
        for s, arms in stars.items():
            if scope.dataset is None and len(arms) > 1 and len({o for _, o in arms}) == len(arms) and scope.g != s and not any(scope.g == ("var", o) for _, o in arms):
                fused = self.source.star(*self._fixed(scope), [p for p, _ in arms])
                if fused:
                    ready.append(self._fused(fused, s[1], arms, scope))
                    todo = [t for t in todo if not (t[0] == s and t[1][0] == "p" and (t[1][1], t[2][1]) in arms and t[2][0] == "var")]
        while todo or ready:
            known = set(sol.vars) if sol else set()
            best = max(range(len(todo) + len(ready)), key=lambda k: self._rank(k, todo, ready, known))
            if best < len(todo):
                s, p, o = todo.pop(best)
                sol = self.triple(s, p, o, scope, sol)
            else:
                sol = join(sol, ready.pop(best - len(todo)))
        return sol

    @staticmethod
    def _rank(k: int, todo: list, ready: list, known: set) -> tuple:
        """Connected patterns first, then those with more constants."""
        if k >= len(todo):
            return (not known or bool(known & set(ready[k - len(todo)].vars)), 2, 0)
        t = todo[k]
        vs = {x[1] for x in (t[0], t[2]) if x[0] == "var"} | ({t[1][1]} if t[1][0] == "var" else set())
        easy = t[1][0] in ("p", "var")
        return (not known or bool(known & vs), easy * 1, sum(x[0] != "var" for x in t))

    @staticmethod
    def _fixed(scope: Scope) -> tuple[str | None, str | None]:
        return (scope.repo[1] if scope.repo and scope.repo[0] == "iri" else None), (scope.g[1] if scope.g and scope.g[0] == "iri" else None)

    def quads(self, scope: Scope, s: str | None = None, p: str | None = None, o: tuple | None = None) -> DataFrame:
        """The quads of the scope. A default graph of several graphs has each statement once."""
        repo, g = self._fixed(scope)
        if scope.dataset is None:
            return self.source.scan(repo, g, s, p, o)
        graphs = scope.dataset[0 if scope.g is None else 1]
        graphs = [x for x in dict.fromkeys(graphs) if g in (None, x)]
        if len(graphs) == 1:
            return self.source.scan(repo, graphs[0], s, p, o)
        df = self.source.scan(repo, g, s, p, o).where(F.col("g").isin(graphs) if graphs else F.lit(False))
        return df if scope.g is not None else df.dropDuplicates([c for c in df.columns if c != "g"])

    def _where(self, scope: Scope) -> list[tuple[str, Column]]:
        """Columns for the variables of the scope."""
        out = []
        if scope.g and scope.g[0] == "var":
            out.append((scope.g[1], F.col("g")))
        if scope.repo and scope.repo[0] == "var":
            out.append((scope.repo[1], F.concat(F.lit(self.base), F.col("repo"))))
        return out

    def _fused(self, fused, subject: str, arms: list, scope: Scope) -> Sol:
        df, cols = fused
        extra = self._where(scope)
        out, names = [F.col("s").alias(f"v_{subject}"), *(c.alias(f"v_{n}") for n, c in extra)], {subject: "iri"} | {n: "iri" for n, _ in extra}
        for p, o in arms:
            c, kind, dt = cols[p]
            out.append((F.col(c) if kind == "iri" else term(kind, F.col(c), dt)).alias(f"v_{o}"))
            names[o] = "iri" if kind == "iri" else "term"
        return Sol(df.select(*out), names, frozenset(names))

    def triple(self, s: tuple, p: tuple, o: tuple, scope: Scope, sol: Sol | None) -> Sol:
        if p[0] not in ("p", "var"):
            return join(sol, self.path_pattern(s, p, o, scope, sol))
        fixed = None if o[0] == "var" else ("iri", o[1], "", "") if o[0] == "iri" else o
        df = self.quads(scope, s[1] if s[0] == "iri" else None, p[1] if p[0] == "p" else None, fixed)
        cols: list[tuple[str, str, Column]] = []
        if s[0] == "var":
            cols.append((s[1], "iri", F.col("s")))
        if p[0] == "var":
            cols.append((p[1], "iri", F.col("p")))
        cols += [(n, "iri", c) for n, c in self._where(scope)]
        if o[0] == "var":
            cols.append((o[1], "term", term(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))))
        return join(sol, self._collect(df, cols))

    def _collect(self, df: DataFrame, cols: list[tuple[str, str, Column]]) -> Sol:
        """Columns of variables; one that is named twice must be equal."""
        first: dict[str, tuple[str, Column]] = {}
        for n, t, c in cols:
            if n in first:
                a, b = X.to_term(Val(*first[n])), X.to_term(Val(t, c))
                df = df.where(a == b)
            else:
                first[n] = (t, c)
        return Sol(df.select(*(c.alias(f"v_{n}") for n, (_, c) in first.items()), *([] if first else [F.lit(1).alias("v__unit")])), {n: t for n, (t, _) in first.items()}, frozenset(first))

    # -- property paths
    def path_pattern(self, s: tuple, p: tuple, o: tuple, scope: Scope, sol: Sol | None) -> Sol:
        seeds = {}
        for side, t in (("x", s), ("y", o)):
            if t[0] != "var":
                seeds[side] = self.spark.createDataFrame([(_const_key(t),)], "src string")
            elif sol and t[1] in sol.sure:
                x = X.to_term(sol.val(t[1]))
                seeds[side] = sol.df.select(_key(x["k"], x["v"], x["dt"], x["lang"]).alias("src")).distinct()
        pairs = self.path(p, scope, seeds)
        for side, t in (("x", s), ("y", o)):
            if t[0] != "var":
                pairs = pairs.where(F.col(side) == _const_key(t))
        cols = [(t[1], "term", _unkey(F.col(side))) for side, t in (("x", s), ("y", o)) if t[0] == "var"]
        return self._collect(pairs, cols + [(n, "iri", c) for n, c in self._where(scope)])

    def path(self, p: tuple, scope: Scope, seeds: dict) -> DataFrame:
        """x, y and the scope's columns g and repo, as bags for sequences and alternatives, as sets for the rest."""
        within = [c for c, t in (("g", scope.g), ("repo", scope.repo)) if t and t[0] == "var"]
        key = _key(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
        if p[0] == "p":
            return self.quads(scope, p=p[1]).select(F.col("s").alias("x"), key.alias("y"), *within)
        if p[0] == "neg":
            quads = self.quads(scope)
            ahead = quads.where(~F.col("p").isin(p[1])).select(F.col("s").alias("x"), key.alias("y"), *within) if p[1] or not p[2] else None
            back = quads.where(~F.col("p").isin(p[2])).select(key.alias("x"), F.col("s").alias("y"), *within) if p[2] else None
            return ahead.unionByName(back) if ahead is not None and back is not None else ahead if back is None else back
        if p[0] == "inv":
            turned = {{"x": "y", "y": "x"}[k]: v for k, v in seeds.items()}
            return self.path(p[1], scope, turned).select(F.col("y").alias("x"), F.col("x").alias("y"), *within)
        if p[0] == "alt":
            return reduce(DataFrame.unionByName, [self.path(q, scope, seeds) for q in p[1]])
        if p[0] == "seq":
            out = self.path(p[1][0], scope, {k: v for k, v in seeds.items() if k == "x"})
            for k, q in enumerate(p[1][1:], 2):
                ends = {"x": out.select(F.col("y").alias("src")).distinct()} if q[0] in ("star", "plus", "opt") else {}
                if k == len(p[1]) and "y" in seeds and not ends:
                    ends = {"y": seeds["y"]}
                step = self.path(q, scope, ends).select(F.col("x").alias("y"), F.col("y").alias("z"), *within)
                out = out.join(step, ["y", *within]).select("x", F.col("z").alias("y"), *within)
            return out
        edges = self.path(p[1], scope, {}).select(F.col("x").alias("src"), F.col("y").alias("dst"), *within)
        if p[0] == "opt":
            reach = edges.distinct().select(F.col("src").alias("x"), F.col("dst").alias("y"), *within)
        elif "x" in seeds or "y" not in seeds:
            reach = closure(edges, seeds.get("x"), within).select(F.col("src").alias("x"), F.col("dst").alias("y"), *within)
        else:
            back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *within)
            reach = closure(back, seeds["y"], within).select(F.col("dst").alias("x"), F.col("src").alias("y"), *within)
        if p[0] == "plus":
            return reach
        return reach.unionByName(self.zero(scope, seeds, within)).distinct()

    def zero(self, scope: Scope, seeds: dict, within: list[str]) -> DataFrame:
        """Each term with itself: those at a given end, else all subjects and objects."""
        key = _key(F.col("o_kind"), F.col("o"), F.col("o_dt"), F.col("o_lang"))
        if seeds and not within:
            ends = reduce(DataFrame.unionByName, seeds.values()).distinct()
            return ends.select(F.col("src").alias("x"), F.col("src").alias("y"))
        quads = self.quads(scope)
        nodes = quads.select(F.col("s").alias("x"), *within).unionByName(quads.select(key.alias("x"), *within)).distinct()
        if seeds:
            nodes = nodes.join(reduce(DataFrame.unionByName, seeds.values()).distinct().withColumnRenamed("src", "x"), "x", "left_semi")
        return nodes.select("x", F.col("x").alias("y"), *within)


def _freeze(e):
    return tuple(_freeze(x) for x in e) if isinstance(e, list | tuple) else e


def _aggregates(e) -> bool:
    return isinstance(e, list | tuple) and (bool(e) and e[0] == "agg" or any(map(_aggregates, e)))


def _has_exists(e) -> bool:
    return isinstance(e, list | tuple) and (bool(e) and e[0] == "exists" or any(map(_has_exists, e)))


def _conjuncts(e: tuple) -> list[tuple]:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _simple(elements: list) -> bool:
    return all(e[0] == "bgp" for e in elements)


def _binds(elements: list) -> set[str]:
    """Variables that the patterns of a group bind, not counting those of filters and of nested EXISTS."""
    out: set[str] = set()
    for e in elements:
        if e[0] in ("bgp", "values"):
            out |= variables(e)
        elif e[0] == "bind":
            out.add(e[2])
        elif e[0] in ("graph", "service"):
            out |= variables(e[1]) | _binds(e[2])
        elif e[0] in ("group", "optional"):
            out |= _binds(e[1])
        elif e[0] == "union":
            out |= set().union(*map(_binds, e[1]))
        elif e[0] == "select":
            out |= variables(e[1])
    return out
