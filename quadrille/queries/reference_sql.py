"""The queries of reference.py in DuckDB's SQL."""

from quadrille.model import NS
from quadrille.plans.resolve import ADMIN, GEN_SPACE, MAINTAINER, MEMBER, OBSERVER

EX = "http://ex.org/"
NP = "'https://np.example.org/RA' || substr(sha256(CAST({} AS VARCHAR)), 1, 43)"
CODE_BLOB = "hex(from_base64(translate(substr(code, 3), '-_', '+/') || '='))"

_EV = f"""
ev AS (
  SELECT event_id, ts, user_id, event_type, {NP.format("event_id")} AS np, 'RA' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 43) AS code, 'pk' || user_id AS pubkey, sha256('pk' || user_id) AS pk,
         CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 50 THEN 'label ' || json_extract_string(props, '$.k') END AS label, '{EX}type/' || event_type AS type
  FROM events),
rel0 AS (
  SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)
           WHEN 'error' THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) WHEN 'view' THEN CASE WHEN event_id > 0 THEN event_id - 1 END END AS t FROM events),
rel AS (SELECT {NP.format("event_id")} AS np, {NP.format("t")} AS target, CASE event_type WHEN 'purchase' THEN 'supersedes' ELSE 'invalidates' END AS pred FROM rel0 WHERE t IS NOT NULL),
dead AS (SELECT DISTINCT r.np AS inv, r.target FROM rel r JOIN ev a ON a.np = r.np JOIN ev b ON b.np = r.target WHERE r.pred = 'invalidates' AND a.pk = b.pk)"""
_SHARDS = f"""{_EV},
shard AS (SELECT np, code, event_id, event_type, unnest(['meta', 'full', 'text', 'pubkey_' || sha256(pubkey), 'type_' || sha256(type)]) AS repo FROM ev)"""

_C, _O, _N, _R, _S = (f"'{EX}{t}/' || " for t in ("customer", "orders", "nation", "region", "supplier"))


def _checksum(window: str = "") -> str:
    words = [f"format('{{:016x}}', bit_xor(('0x' || substr({CODE_BLOB}, {1 + 16 * k}, 16))::UBIGINT){window})" for k in range(4)]
    return f"to_base64(unhex({' || '.join(words)}))"


_GRANTS = f"""
nat AS (SELECT n_nationkey, 'n' || n_nationkey AS ref, '{EX}' || r_name || '/' || n_name AS space, '{EX}' || r_name AS prefix FROM nation JOIN region ON n_regionkey = r_regionkey),
acct AS (SELECT '{EX}agent/' || c_custkey AS agent, sha256('ck' || c_custkey) AS pk, c_custkey, c_nationkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
root AS (SELECT ref, '{EX}agent/' || min(c_custkey) AS agent FROM acct JOIN nat ON c_nationkey = n_nationkey GROUP BY ref),
o AS (
  SELECT o_orderstatus, o_orderpriority, ref, {NP.format("o_orderkey")} AS np, '{EX}agent/' || o_custkey AS pub0, o_custkey, o_orderdate, o_orderkey,
         '{EX}agent/' || lead(o_custkey) OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) AS agent, '{EX}role/' || o_orderpriority AS role, '{EX}pred/' || o_orderpriority AS pred
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nat ON c_nationkey = n_nationkey),
pubd AS (SELECT o.*, a.agent AS pub FROM o JOIN acct a ON a.agent = o.pub0 WHERE o.agent IS NOT NULL),
rev AS (
  SELECT ref, agent, pub AS by_, o_orderdate AS tm, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'admin' ELSE role END AS role FROM pubd WHERE o_orderstatus = 'F'),
admrev AS (SELECT v.ref, v.agent, v.by_, v.tm FROM rev v LEFT JOIN root r ON r.ref = v.ref AND r.agent = v.agent WHERE v.role = 'admin' AND r.ref IS NULL),
offer AS (
  SELECT g.ref, g.agent, g.pub, g.o_orderdate AS tm FROM pubd g LEFT JOIN (SELECT ref, agent, max(tm) AS last FROM admrev WHERE by_ = agent GROUP BY 1, 2) s ON s.ref = g.ref AND s.agent = g.agent
  WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (s.last IS NULL OR s.last < g.o_orderdate)),
adm(ref, agent) USING KEY (ref, agent) AS (
  SELECT DISTINCT g.ref, g.agent FROM offer g JOIN root r ON r.ref = g.ref AND r.agent = g.pub
  UNION
  SELECT DISTINCT g.ref, g.agent FROM offer g JOIN adm a ON a.ref = g.ref AND a.agent = g.pub
    LEFT JOIN recurring.adm k ON k.ref = g.ref AND k.agent = g.agent
    LEFT JOIN (SELECT v.ref, v.agent, max(v.tm) AS last FROM admrev v JOIN recurring.adm k ON k.ref = v.ref AND k.agent = v.by_ GROUP BY 1, 2) s ON s.ref = g.ref AND s.agent = g.agent
  WHERE k.ref IS NULL AND (s.last IS NULL OR s.last < g.tm))"""
_ATTACHED = """
att AS (SELECT DISTINCT g.ref, g.role FROM pubd g JOIN adm a ON a.ref = g.ref AND a.agent = g.pub WHERE o_orderstatus = 'P')"""
_ROLES = """
inst AS (SELECT g.* FROM pubd g JOIN att USING (ref, role) WHERE o_orderstatus = 'O'),
maint AS (SELECT DISTINCT i.ref, i.agent, i.role, i.np FROM inst i JOIN adm a ON a.ref = i.ref AND a.agent = i.pub WHERE o_orderpriority = '1-URGENT'),
may2 AS (SELECT ref, agent FROM adm UNION SELECT ref, agent FROM maint),
memb AS (SELECT DISTINCT i.ref, i.agent, i.role, i.np FROM inst i JOIN may2 a ON a.ref = i.ref AND a.agent = i.pub WHERE o_orderpriority = '2-HIGH'),
may3 AS (SELECT * FROM may2 UNION SELECT ref, agent FROM memb),
rolrev AS (SELECT v.ref, v.agent, v.role, max(v.tm) AS last FROM rev v LEFT JOIN may3 a ON a.ref = v.ref AND a.agent = v.by_ WHERE v.role <> 'admin' AND (a.ref IS NOT NULL OR v.by_ = v.agent) GROUP BY 1, 2, 3),
obs AS (
  SELECT DISTINCT i.ref, i.agent, i.role, i.np FROM inst i LEFT JOIN may3 a ON a.ref = i.ref AND a.agent = i.pub LEFT JOIN rolrev v ON v.ref = i.ref AND v.agent = i.agent AND v.role = i.role
  WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND (a.ref IS NOT NULL OR i.pub = i.agent) AND (v.last IS NULL OR v.last < i.o_orderdate))"""

_SPACES = f"{_GRANTS},{_ATTACHED},{_ROLES}"

# the roots of nations name themselves admins
_SELF = "(s.last IS NULL OR s.last < g.o_orderdate)"
_ROOTED = _GRANTS.replace(_SELF, _SELF + " UNION ALL SELECT ref, agent, agent, TIMESTAMP '2024-01-01' FROM root")
_AUTH = f"""
apr AS (SELECT c_nationkey AS nk, agent, pk, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rk FROM acct),
sup AS (
  SELECT s.nk, s.rk, a.agent, n.space AS above, 's' || s_suppkey AS ref, n.space || '/s' || s_suppkey AS space
  FROM (SELECT s_suppkey, s_nationkey AS nk, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rk FROM supplier) s JOIN apr a ON a.nk = s.nk AND a.rk = s.rk JOIN nat n ON n.n_nationkey = s.nk),
p0 AS (
  SELECT p_partkey, p_type, p_size AS size, split_part(p_name, ' ', 1) AS colour, p_name < 'm' AS first, CAST(split_part(p_brand, '#', 2) AS BIGINT) - 1 AS nk, {NP.format("'p' || p_partkey")} AS np,
         TIMESTAMP '2024-01-01' + p_partkey * INTERVAL 1 MINUTE AS created, '{EX}role/' || ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][least((p_size - 1) // 10 + 1, 5)] AS role FROM part),
p AS (
  SELECT p0.*, n.space, n.ref, a.agent, a.pk, a.rk FROM p0 JOIN nat n ON n.n_nationkey = p0.nk
  JOIN apr a ON a.nk = CASE WHEN p_type = 'ECONOMY' AND NOT first AND size > 25 THEN (p0.nk + 1) % 25 ELSE p0.nk END AND a.rk = (size - 1) % 25 // 10 + 1),
gone AS (
  SELECT target FROM (SELECT colour, lag(np) OVER (PARTITION BY pk ORDER BY p_partkey) AS target FROM p) WHERE colour = 'hot' AND target IS NOT NULL
  UNION SELECT b.np FROM p a JOIN p b ON b.p_partkey = a.p_partkey - 1 AND a.pk = b.pk WHERE a.colour = 'red'),
live AS (SELECT * FROM p WHERE np NOT IN (SELECT target FROM gone)),
adms AS (SELECT a.ref, n.space, a.agent FROM adm a JOIN nat n ON n.ref = a.ref UNION ALL SELECT ref, space, agent FROM sup),
refs AS (SELECT ref, space, prefix FROM nat UNION ALL SELECT 'r' || r_regionkey, '{EX}' || r_name, NULL FROM region UNION ALL SELECT ref, space, above FROM sup),
als AS (SELECT l.*, coalesce(s.space, '{EX}alias/' || l.nk || '-' || size) AS alias FROM live l LEFT JOIN sup s ON s.nk = l.nk AND s.rk = l.rk WHERE p_type = 'MEDIUM'),
alias AS (
  SELECT DISTINCT l.alias, l.space AS canonical, l.ref, l.np FROM als l JOIN adms a ON a.ref = l.ref AND a.agent = l.agent
  WHERE NOT EXISTS (SELECT 1 FROM adms f WHERE f.space = l.alias AND NOT EXISTS (SELECT 1 FROM adms k WHERE k.ref = l.ref AND k.agent = f.agent))),
decl AS (
  SELECT s.space AS child, l.space AS parent, np, l.agent AS pub FROM live l JOIN sup s ON s.nk = l.nk AND s.rk = l.rk WHERE p_type = 'ECONOMY' AND first
  UNION ALL SELECT l.space, n.space, np, agent FROM live l JOIN nat n ON n.n_nationkey = (l.nk + 1) % 25 WHERE p_type = 'ECONOMY' AND NOT first),
sub AS (
  SELECT DISTINCT c.ref AS child_ref, q.ref AS parent_ref, child, parent, d.np FROM decl d JOIN adms c ON c.space = child AND c.agent = pub JOIN adms q ON q.space = parent AND q.agent = pub
  UNION SELECT c.ref, q.ref, d.child, d.parent, d.np FROM decl d JOIN decl e ON e.child = d.child AND e.parent = d.parent AND e.np <> d.np
    JOIN adms c ON c.space = d.child AND c.agent IN (d.pub, e.pub) JOIN adms q ON q.space = d.parent AND q.agent IN (d.pub, e.pub)),
maintained AS (SELECT DISTINCT '{EX}res/' || l.nk || '-' || size AS resource, l.ref, l.space, np FROM live l JOIN adms a ON a.ref = l.ref AND a.agent = l.agent WHERE p_type = 'LARGE'),
prefixed AS (SELECT DISTINCT c.ref AS child_ref, q.ref AS parent_ref, c.space AS child, q.space AS parent FROM refs c JOIN refs q ON q.space = c.prefix WHERE c.ref <> q.ref AND c.space NOT IN (SELECT child FROM sub)),
governing AS (SELECT resource, ref FROM maintained UNION SELECT space, ref FROM refs),
newest AS (SELECT *, '{EX}kind/' || nk AS kind, CASE WHEN size <= 40 THEN '{GEN_SPACE}' ELSE '{EX}Other' END AS applies_to FROM live WHERE p_type = 'PROMO' QUALIFY row_number() OVER (PARTITION BY nk ORDER BY created DESC) = 1),
stamp AS (SELECT DISTINCT l.ref, np AS pa, size <= 30 AS active, l.space, '{EX}preset/' || nk AS preset, created, nk, np FROM p l JOIN adms a ON a.ref = l.ref AND a.agent = l.agent WHERE p_type = 'SMALL'),
assigned AS (SELECT * FROM (SELECT * FROM stamp QUALIFY row_number() OVER (PARTITION BY ref, preset ORDER BY created DESC) = 1) WHERE np IN (SELECT np FROM live)),
detached AS (SELECT l.ref, l.role, max(created) AS last FROM p l JOIN adms a ON a.ref = l.ref AND a.agent = l.agent WHERE p_type = 'STANDARD' GROUP BY 1, 2),
offered AS (
  SELECT g.ref, g.role, g.np, g.o_orderdate AS tm, 0 AS preset FROM pubd g JOIN adm a ON a.ref = g.ref AND a.agent = g.pub WHERE o_orderstatus = 'P'
  UNION ALL SELECT s.ref, n.role, s.np, s.created, 1 FROM assigned s JOIN newest n ON n.nk = s.nk WHERE active AND n.size <= 40),
attached AS (
  SELECT o.* FROM offered o LEFT JOIN detached d ON d.ref = o.ref AND d.role = o.role WHERE d.last IS NULL OR d.last < o.tm QUALIFY row_number() OVER (PARTITION BY o.ref, o.role ORDER BY preset, tm, np) = 1),
att AS (SELECT ref, role FROM attached)"""
_EDGES = """
edges AS (
  SELECT child_ref AS s, 'isSubSpaceOf' AS p, parent_ref AS o FROM sub UNION SELECT parent_ref, 'hasSubSpace', child_ref FROM sub UNION SELECT child, 'isSubSpaceOf', parent FROM sub UNION SELECT parent, 'hasSubSpace', child FROM sub
  UNION SELECT child_ref, 'isSubSpaceOf', parent_ref FROM prefixed UNION SELECT parent_ref, 'hasSubSpace', child_ref FROM prefixed UNION SELECT child, 'isSubSpaceOf', parent FROM prefixed UNION SELECT parent, 'hasSubSpace', child FROM prefixed
  UNION SELECT resource, 'isMaintainedBy', ref FROM maintained UNION SELECT resource, 'isMaintainedBy', space FROM maintained UNION SELECT ref, 'hasMaintainedResource', resource FROM maintained UNION SELECT space, 'hasMaintainedResource', resource FROM maintained
  UNION SELECT alias, 'sameAsSpace', ref FROM alias UNION SELECT alias, 'sameAsSpace', canonical FROM alias UNION SELECT resource, 'hasGoverningSpaceRef', ref FROM governing)"""

_G = [("customer", "c_custkey", ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]), ("orders", "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]), ("nation", "n_nationkey", ["n_name", "n_regionkey"]), ("region", "r_regionkey", ["r_name"]), ("supplier", "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"])]
_ADMIN_GRAPH = NS["npa"] + "graph"
_GRAPH_VAR = " UNION ALL ".join(
    [f"SELECT '{EX}{t}' AS g, '{EX}col/{c}' AS p, CAST(count({c}) AS VARCHAR) AS n FROM {t} HAVING count({c}) > 0" for t, _, cs in _G for c in cs]
    + [f"SELECT '{_ADMIN_GRAPH}', '{p}', CAST(count({c}) AS VARCHAR) FROM ev" for p, c in ((NS["npa"] + "hasValidSignatureForPublicKeyHash", "pk"), (NS["dct"] + "created", "ts"), (NS["npx"] + "hasNanopubType", "type"), (NS["rdfs"] + "label", "label"), (NS["npa"] + "hasLoadNumber", "event_id"))]
    + [f"SELECT '{_ADMIN_GRAPH}', '{NS['npx']}' || pred, CAST(count(*) AS VARCHAR) FROM rel GROUP BY pred"]
)
_ENC = "url_encode"

SQL = {
    "valid_nanopubs": f"""WITH {_EV}
SELECT np, pk AS key, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS date, label FROM ev WHERE np NOT IN (SELECT target FROM dead)""",
    "scan_pattern": f"WITH {_EV} SELECT np FROM ev WHERE event_type = 'purchase'",
    "graph_var": f"WITH {_EV} {_GRAPH_VAR}",
    "star_pattern": f"SELECT {_C} c_custkey AS c, c_name AS name, c_mktsegment AS seg, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "cross_graph": "SELECT r_name AS r, CAST(count(*) AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
    "optional_label": f"WITH {_EV} SELECT np, label FROM ev WHERE event_type = 'signup'",
    "optional_filter": f"SELECT {_C} c_custkey AS c, CASE WHEN o_orderkey IS NOT NULL THEN {_O} o_orderkey END AS o FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' WHERE c_mktsegment = 'BUILDING'",
    "exists_semi": f"SELECT {_C} c_custkey AS c FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "not_exists_anti": f"SELECT {_C} c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "subset_nested": f"SELECT {_N} n_nationkey AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal >= coalesce((SELECT max(c_acctbal) FROM customer WHERE c_nationkey = n_nationkey), -1e18))",
    "exists_flag": f"SELECT {_C} c_custkey AS c, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') THEN 'true' ELSE 'false' END AS has FROM customer",
    "minus_set": f"SELECT {_C} c_custkey AS c FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "union_arms": f"SELECT {_C} c_custkey AS x, c_name AS name FROM customer UNION ALL SELECT {_S} s_suppkey, s_name FROM supplier",
    "values_in": f"SELECT {_C} c_custkey AS c, c_mktsegment AS seg FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "bind_mint": f"SELECT {_C} c_custkey AS c, {_C} c_custkey || '__' || url_encode(c_name || ' *~/+') AS iri FROM customer",
    "numeric_filter": f"SELECT {_C} c_custkey AS c, CAST(c_acctbal AS VARCHAR) AS b FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 2000.5",
    "time_filter": f"SELECT {_O} o_orderkey AS o, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS d FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'",
    "lexical_filter": f"SELECT {_O} o_orderkey AS o FROM orders WHERE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') > '1998'",
    "regex_filter": f"SELECT {_C} c_custkey AS p FROM customer WHERE regexp_matches(c_name, '00[0-4]$')",
    "count_distinct": "SELECT o_orderstatus AS st, CAST(count(DISTINCT o_custkey) AS VARCHAR) AS n, CAST(count(*) AS VARCHAR) AS m FROM orders GROUP BY 1",
    "group_concat": "SELECT r_name AS r, string_agg(DISTINCT n_name, ' ' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "group_max": f"SELECT {_C} o_custkey AS c, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS last FROM orders GROUP BY o_custkey",
    "having": f"SELECT {_C} o_custkey AS c, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "sub_select": f"SELECT {_C} c_custkey AS c, c_name AS name, CAST(count(*) AS VARCHAR) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL",
    "topk": f"SELECT {_C} c_custkey AS c, CAST(c_acctbal AS VARCHAR) AS b FROM customer ORDER BY c_acctbal DESC, c LIMIT 20",
    "keyset_page": f"WITH {_EV} SELECT np, CAST(event_id AS VARCHAR) AS ln FROM ev WHERE event_id > 500 ORDER BY event_id LIMIT 100",
    "offset_slice": f"SELECT {_C} c_custkey AS c, CAST(c_acctbal AS VARCHAR) AS b FROM customer ORDER BY c_acctbal DESC, c LIMIT 10 OFFSET 5",
    "distinct_types": f"WITH {_EV} SELECT DISTINCT type AS t FROM ev",
    "ask_any": f"WITH {_EV} SELECT count(*) > 0 AS answer FROM rel WHERE pred = 'invalidates'",
    "construct_edges": f"SELECT DISTINCT {_N} c_nationkey AS s, '{EX}hasCustomer' AS p, {_C} c_custkey AS o, 'iri' AS o_kind, '' AS o_dt, '' AS o_lang FROM customer",
    "path_sequence": f"SELECT {_C} c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "path_alternative": f"SELECT {_C} c_custkey AS x, {_N} c_nationkey AS n FROM customer UNION ALL SELECT {_S} s_suppkey, {_N} s_nationkey FROM supplier",
    "path_inverse": f"SELECT {_N} c_nationkey AS n, CAST(count(*) AS VARCHAR) AS k FROM customer GROUP BY c_nationkey",
    "path_both_ways": f"WITH {_EV} SELECT np AS a, target AS b FROM rel WHERE pred = 'supersedes' UNION ALL SELECT target, np FROM rel WHERE pred = 'supersedes'",
    "service_hop": f"SELECT {_C} c_custkey AS c, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "service_var": f"WITH {_EV} SELECT 'https://query.example.org/repo/meta' AS r, CAST(count(label) AS VARCHAR) AS n FROM ev UNION ALL SELECT 'https://query.example.org/repo/full', CAST(count(*) AS VARCHAR) FROM nation",
    "from_graph": f"SELECT '{EX}col/n_name' AS p, CAST(count(*) AS VARCHAR) AS n FROM nation UNION ALL SELECT '{EX}col/n_regionkey', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT '{EX}col/r_name', CAST(count(*) AS VARCHAR) FROM region",
    "from_named": f"SELECT '{EX}nation' AS g, CAST(2 * count(*) AS VARCHAR) AS n FROM nation UNION ALL SELECT '{EX}supplier', CAST(3 * count(*) AS VARCHAR) FROM supplier",
    "optional_shared": f"""SELECT {_S} s_suppkey AS s, {_N} n.n_nationkey AS k, {_R} n.n_regionkey AS r FROM supplier JOIN nation m ON s_nationkey = m.n_nationkey LEFT JOIN nation n ON m.n_name <> 'NATION_3' OR n.n_nationkey = m.n_nationkey""",
    "minus_loose": f"SELECT {_S} s_suppkey AS s, CASE WHEN r_name LIKE '%A' THEN {_N} n_nationkey END AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE n_name <> 'NATION_1' OR r_name NOT LIKE '%A'",
    "type_alternatives": f"WITH {_EV} SELECT np, type AS t FROM ev WHERE event_type IN ('error', 'signup')",
    "path_star": f"""WITH RECURSIVE {_EV},
up AS (SELECT np, np AS target FROM ev WHERE event_type = 'purchase' UNION SELECT u.np, r.target FROM up u JOIN rel r ON r.np = u.target AND r.pred = 'supersedes')
SELECT np AS v, CAST(count(*) AS VARCHAR) AS n FROM up GROUP BY np""",
    "coalesce_value": f"WITH {_EV} SELECT np, coalesce(label, 'none') AS l FROM ev WHERE event_type = 'signup'",
    "text_matches": f"""WITH {_EV},
lits AS (
  SELECT np, 'label' AS p, label AS o FROM ev WHERE label IS NOT NULL UNION ALL SELECT np, 'pk', pk FROM ev UNION ALL SELECT np, 'created', strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') FROM ev UNION ALL SELECT np, 'number', CAST(event_id AS VARCHAR) FROM ev),
w AS (SELECT *, regexp_extract_all(lower(o), '[\\p{{L}}\\p{{N}}]+') AS ws FROM lits),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT np, p, o, len(ws) AS dl, q.word, len(list_filter(ws, lambda x: x = q.word)) AS tf FROM w, (VALUES ('7'), ('12')) q(word)),
df AS (SELECT word, count(*) AS df FROM tf WHERE tf > 0 GROUP BY word)
SELECT np, '{NS["rdfs"]}label' AS prop, CAST(CAST(floor(1000 * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean)))) AS BIGINT) AS VARCHAR) AS k, min(o) AS snippet
FROM tf JOIN df USING (word), stats WHERE tf > 0 AND p = 'label' AND np IN (SELECT np FROM ev WHERE event_type = 'purchase') GROUP BY np""",
    "functions_text": f"SELECT {_C} c_custkey AS c, upper(c_name) AS u, CAST(length(c_name) AS VARCHAR) AS l, substr(c_name, 3, 4) AS s, split_part(c_name, '#', 1) AS b, split_part(c_name, '#', 2) AS a, md5(c_name) AS m FROM customer",
    "functions_number": f"SELECT {_C} c_custkey AS c, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS f, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS k FROM customer",
    "functions_time": "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, CAST(month(o_orderdate) AS VARCHAR) AS m, CAST(count(*) AS VARCHAR) AS n FROM orders GROUP BY ALL",
    "path_closure": f"""WITH RECURSIVE {_EV},
up AS (SELECT np, target FROM rel WHERE pred = 'supersedes' UNION SELECT u.np, r.target FROM up u JOIN rel r ON r.np = u.target AND r.pred = 'supersedes')
SELECT np AS v, CAST(count(*) AS VARCHAR) AS n FROM up GROUP BY np""",
    "latest_versions": f"""WITH RECURSIVE {_EV},
up AS (SELECT target AS src, np AS dst FROM rel WHERE pred = 'supersedes' UNION SELECT u.src, r.np FROM up u JOIN rel r ON r.target = u.dst AND r.pred = 'supersedes'),
pairs AS (SELECT * FROM up UNION SELECT src, src FROM up)
SELECT p.src AS np, arg_max(p.dst, (b.ts, p.dst)) AS latest FROM pairs p JOIN ev a ON a.np = p.src JOIN ev b ON b.np = p.dst AND b.pk = a.pk
WHERE p.dst NOT IN (SELECT target FROM dead) GROUP BY p.src""",
    "template_run": f"SELECT {_O} o_orderkey AS o, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "shard_fanout": f"""WITH {_SHARDS} SELECT repo, count(*) AS n FROM shard GROUP BY repo
UNION ALL SELECT 'last30d', count(*) FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 30 DAYS""",
    "running_load": f"""WITH {_SHARDS}
SELECT repo, np, row_number() OVER w - 1 AS load_number, {_checksum(" OVER w")} AS load_checksum FROM shard
WINDOW w AS (PARTITION BY repo ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "xor_checksum": f"WITH {_SHARDS} SELECT repo, count(*) AS np_count, {_checksum()} AS checksum FROM shard GROUP BY repo",
    "last30d": f"WITH {_EV} SELECT np, ts AS created FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 30 DAYS",
    "propagate_invalidation": f"""WITH {_EV}, x AS (SELECT DISTINCT r.np, b.pubkey, b.type, a.pubkey AS pubkey0, a.type AS type0 FROM rel r JOIN ev a ON a.np = r.np JOIN ev b ON b.np = r.target WHERE r.pred = 'invalidates')
SELECT np, 'pubkey_' || sha256(pubkey) AS repo FROM x WHERE pubkey <> pubkey0 UNION SELECT np, 'type_' || sha256(type) FROM x WHERE type <> type0""",
    "valid_invalidations": f"WITH {_EV} SELECT inv, target FROM dead",
    "shard_missing": f"WITH {_SHARDS} SELECT repo, np FROM shard WHERE event_type = 'error' AND repo LIKE 'type_%'",
    "fleet_consistency": r"""WITH r AS (SELECT trim(instance) AS instance, regexp_replace(trim(repo), '^(pubkey|type)/', '\1_') AS repo, np_count, reported_at, status_row, rtrim(translate(nullif(trim(checksum), ''), '-_', '+/'), '=') AS checksum FROM repo_status),
l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY instance, repo ORDER BY reported_at DESC, status_row DESC) = 1)
SELECT repo FROM l GROUP BY repo HAVING count(DISTINCT instance) < (SELECT count(DISTINCT instance) FROM l) OR count(DISTINCT (coalesce(np_count, -1), coalesce(checksum, ''))) > 1""",
    "shard_counts": f"WITH {_SHARDS} SELECT CASE WHEN repo LIKE 'pubkey_%' THEN 'pubkey' WHEN repo LIKE 'type_%' THEN 'type' ELSE 'other' END AS kind, count(DISTINCT repo) AS n FROM shard GROUP BY 1",
    "hash_dictionary": "SELECT DISTINCT sha256('pk' || user_id) AS hash, 'pk' || user_id AS value, 'pubkey' AS kind FROM events",
    "iri_functions": r"""WITH s AS (SELECT *, trim(space_iri) AS i, regexp_replace(regexp_replace(trim(space_iri), '[#?].*$', ''), '/+$', '') AS b, nullif(trim(root_nanopub), '') AS root FROM space_rows)
SELECT space_row, nullif(regexp_extract(b, '^([A-Za-z][A-Za-z0-9_+.-]*://[^/]+(?:/.*)?)/[^/]*$', 1), '') AS parent,
  nullif(regexp_extract(root, '^(.*[^A-Za-z0-9_-]RA[A-Za-z0-9_-]{43})([^A-Za-z0-9\\\]^_].{0,43})?$', 1), '') AS base, nullif(regexp_extract(root_nanopub, 'RA[A-Za-z0-9_-]{43}'), '') AS code,
  'type_' || sha256(space_iri) AS shard, CASE WHEN length(space_ref) >= 45 THEN substr(space_ref, 1, 1) || '..' || substr(space_ref, 41, 5) || '..' ELSE space_ref END AS short, url_encode(space_iri) AS encoded FROM s""",
    "canonical_names": """SELECT delivery_id, trim(agent) AS agent, arg_min(trim(name), (-coalesce(ratio, -1.0), trim(name))) AS name FROM trust_accounts WHERE trim(name) <> '' GROUP BY 1, 2""",
    "distinct_edges": f"""SELECT DISTINCT trust_state_hash, from_pubkey, to_pubkey, '{NS["npa"]}endorsementlink/' || sha256(trust_state_hash || '|' || from_pubkey || '|' || to_pubkey || '|' || coalesce(via_nanopub, '')) AS link FROM trust_edges""",
    "retained_states": "SELECT DISTINCT trust_state_hash, trust_state_counter FROM trust_snapshots ORDER BY trust_state_counter DESC, trust_state_hash LIMIT 10",
    "trust_evolution": "SELECT registry, trust_state_counter, delivery_id, nullif(lower(trim(status)), '') AS status, count(*) AS n FROM trust_accounts JOIN trust_snapshots USING (delivery_id) GROUP BY ALL",
    "space_listing": "SELECT DISTINCT nullif(trim(space_iri), '') AS space, nullif(trim(space_ref), '') AS ref, nullif(regexp_extract(root_nanopub, 'RA[A-Za-z0-9_-]{43}'), '') AS root_np FROM space_rows",
    "mirror_accounts": f"WITH RECURSIVE {_SPACES} SELECT agent, pk FROM acct",
    "admin_closure": f"WITH RECURSIVE {_SPACES} SELECT ref, agent FROM adm",
    "role_attachments": f"WITH RECURSIVE {_SPACES} SELECT ref, role FROM att",
    "space_state": f"""WITH RECURSIVE {_SPACES}
SELECT ref, agent, role, '{MAINTAINER}' AS role_type, np FROM maint UNION ALL SELECT ref, agent, role, '{MEMBER}', np FROM memb UNION ALL SELECT ref, agent, role, '{OBSERVER}', np FROM obs""",
    "prefix_subspaces": f"""WITH RECURSIVE {_SPACES}, reg AS (SELECT 'r' || r_regionkey AS ref, '{EX}' || r_name AS space FROM region)
SELECT '{NS["npa"]}derivedlink/' || md5(n.ref || '|' || r.ref) AS link, n.ref AS child_ref, r.ref AS parent_ref FROM nat n JOIN reg r ON n.prefix = r.space""",
    "newest_revocations": f"""WITH RECURSIVE {_SPACES}
SELECT space, agent, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '{ADMIN}' ELSE role END AS role, np AS rev FROM o JOIN nat USING (ref) WHERE o_orderstatus = 'F' AND agent IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY space, agent, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN '{ADMIN}' ELSE role END ORDER BY o_orderdate DESC, np DESC) = 1""",
    "text_search": """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents WHERE text IS NOT NULL),
stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM w),
tf AS (SELECT doc_id, len(ws) AS dl, q.word, len(list_filter(ws, lambda x: x = q.word)) AS tf FROM w, (VALUES ('cache'), ('memory'), ('worker')) q(word)),
df AS (SELECT word, count(*) AS df FROM tf WHERE tf > 0 GROUP BY word)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score
FROM tf JOIN df USING (word), stats WHERE tf > 0 GROUP BY doc_id HAVING count(*) = 3""",
    "space_state_revoked": f"""WITH RECURSIVE {_SPACES}
SELECT '{ADMIN}' AS tier, count(*) AS n FROM adm UNION ALL SELECT 'RoleAssignment', count(*) FROM att UNION ALL SELECT '{MAINTAINER}', count(DISTINCT (ref, agent, np)) FROM maint
UNION ALL SELECT '{MEMBER}', count(DISTINCT (ref, agent, np)) FROM memb UNION ALL SELECT '{OBSERVER}', count(DISTINCT (ref, agent, np)) FROM obs""",
    "stream_ingest": f"WITH {_SHARDS} SELECT repo, count(*) AS n FROM shard GROUP BY repo",
}
SQL["incremental_cycle"] = SQL["space_state"]
SQL["auth_state"] = SQL["auth_cycle"] = f"""WITH RECURSIVE {_ROOTED},{_AUTH},{_ROLES},{_EDGES}
SELECT 'admin' AS tier, ref AS a, agent AS b, '' AS c FROM adms UNION ALL SELECT 'alias', ref, alias, np FROM alias UNION ALL SELECT 'subspace', child_ref, parent_ref, np FROM sub
UNION ALL SELECT 'prefix', child_ref, parent_ref, '' FROM prefixed UNION ALL SELECT 'maintained', ref, resource, np FROM maintained UNION ALL SELECT 'governing', ref, resource, '' FROM governing
UNION ALL SELECT 'stamp', ref, pa, CAST(active AS VARCHAR) FROM stamp WHERE np IN (SELECT np FROM live) UNION ALL SELECT 'attachment', ref, role, np FROM attached
UNION ALL SELECT 'role', ref, agent || ' ' || role || ' {MAINTAINER}', np FROM maint UNION ALL SELECT 'role', ref, agent || ' ' || role || ' {MEMBER}', np FROM memb UNION ALL SELECT 'role', ref, agent || ' ' || role || ' {OBSERVER}', np FROM obs
UNION ALL SELECT 'declaration', kind, role, np FROM newest UNION ALL SELECT 'assignment', ref, preset, pa FROM assigned UNION ALL SELECT 'detached', ref, role, strftime(last, '%Y-%m-%d %H:%M:%S') FROM detached
UNION ALL SELECT 'edges', p, CAST(count(*) AS VARCHAR), '' FROM edges GROUP BY p"""
