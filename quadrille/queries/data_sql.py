"""The p-queries of the core in DuckDB's SQL."""

_ACCOUNTS = r"""
rows_ AS (
  SELECT delivery_id, acc_row, lower(trim(pubkey)) AS pubkey, trim(agent) AS agent, lower(nullif(trim(status), '')) AS status,
         nullif(trim(name), '') AS name, name_created_at
  FROM trust_accounts WHERE trim(pubkey) <> '' AND trim(agent) <> ''),
best AS (
  SELECT * FROM rows_ QUALIFY row_number() OVER (PARTITION BY delivery_id, pubkey, agent ORDER BY name_created_at DESC NULLS LAST, acc_row) = 1),
complete AS (
  SELECT s.delivery_id, trim(s.registry) AS registry, s.trust_state_counter AS counter, trim(s.trust_state_hash) AS trust_state_hash
  FROM trust_snapshots s LEFT JOIN (SELECT delivery_id, count(*) AS n FROM best GROUP BY 1) b USING (delivery_id)
  WHERE coalesce(b.n, 0) = s.n_accounts
  QUALIFY row_number() OVER (PARTITION BY trim(s.registry), s.trust_state_counter ORDER BY s.received_at, s.delivery_id) = 1),
chain AS (
  SELECT *, row_number() OVER w AS ord, lead(counter) OVER w AS next_counter, lag(delivery_id) OVER w AS earlier
  FROM complete WINDOW w AS (PARTITION BY registry ORDER BY counter)),
states AS (SELECT c.registry, c.ord, c.counter, c.next_counter, b.pubkey, b.agent, b.status, b.name, b.name_created_at FROM best b JOIN chain c USING (delivery_id))
"""

_ORPHANS = r"""
refs AS (
  SELECT 'trust_accounts' AS src_table, acc_row AS row_id, trim(intro_nanopub) AS ref, received_at AS ref_time FROM trust_accounts LEFT JOIN trust_snapshots USING (delivery_id)
  UNION ALL SELECT 'trust_edges', edge_row, trim(via_nanopub), received_at FROM trust_edges LEFT JOIN trust_snapshots USING (delivery_id)
  UNION ALL SELECT 'space_rows', space_row, trim(root_nanopub), extracted_at FROM space_rows),
coded AS (SELECT *, regexp_extract(ref, 'RA[A-Za-z0-9_-]{43}') AS code FROM refs WHERE ref <> ''),
loads AS (SELECT regexp_extract(np, 'RA[A-Za-z0-9_-]{43}') AS code, nullif(lower(trim(pubkey_hash)), '') AS pk, load_timestamp AS t,
                 regexp_extract(invalidates_np, 'RA[A-Za-z0-9_-]{43}') AS target FROM np_load),
since AS (SELECT code, min(t) AS since FROM loads WHERE code <> '' GROUP BY 1),
until AS (SELECT i.target AS code, min(s.since) AS until FROM loads i JOIN loads t ON t.code = i.target AND t.pk = i.pk JOIN since s ON s.code = i.code WHERE i.target <> '' GROUP BY 1),
judged AS (
  SELECT c.*, strftime(ref_time, '%Y-%m') AS ref_month,
         CASE WHEN s.code IS NULL THEN 'missing' WHEN s.since > c.ref_time THEN 'late' WHEN u.until <= c.ref_time THEN 'deleted' END AS reason
  FROM coded c LEFT JOIN since s USING (code) LEFT JOIN until u USING (code))
"""

SQL = {
    "p1_found": f"""WITH {_ACCOUNTS},
marked AS (
  SELECT *, CASE WHEN lag(ord) OVER w = ord - 1 AND lag(status) OVER w IS NOT DISTINCT FROM status AND lag(name) OVER w IS NOT DISTINCT FROM name
                  AND lag(name_created_at) OVER w IS NOT DISTINCT FROM name_created_at THEN 0 ELSE 1 END AS fresh
  FROM states WINDOW w AS (PARTITION BY registry, pubkey, agent ORDER BY ord)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY registry, pubkey, agent ORDER BY ord) AS run FROM marked)
SELECT registry, pubkey, agent, min(counter) AS valid_from, coalesce(arg_max(coalesce(next_counter, -1), ord), -1) AS valid_to
FROM runs GROUP BY registry, pubkey, agent, run""",
    "p6_found": f"""WITH {_ACCOUNTS},
pairs AS (SELECT delivery_id AS later, earlier, trust_state_hash FROM chain WHERE earlier IS NOT NULL)
SELECT p.trust_state_hash, b.pubkey, b.agent, CASE WHEN a.pubkey IS NULL THEN 'added' ELSE 'changed' END AS change_kind
FROM pairs p JOIN best b ON b.delivery_id = p.later LEFT JOIN best a ON a.delivery_id = p.earlier AND a.pubkey = b.pubkey AND a.agent = b.agent
WHERE a.pubkey IS NULL OR a.status IS DISTINCT FROM b.status
UNION ALL
SELECT p.trust_state_hash, a.pubkey, a.agent, 'removed'
FROM pairs p JOIN best a ON a.delivery_id = p.earlier LEFT JOIN best b ON b.delivery_id = p.later AND a.pubkey = b.pubkey AND a.agent = b.agent
WHERE b.pubkey IS NULL""",
    "p2_found": f"""WITH {_ORPHANS} SELECT src_table, row_id, ref_month, reason FROM judged WHERE reason IS NOT NULL""",
    "p2_report": f"""WITH {_ORPHANS}
SELECT src_table, ref_month, reason, count(*) AS n_orphans, count(DISTINCT nullif(code, '')) AS n_keys FROM judged WHERE reason IS NOT NULL GROUP BY ALL""",
    "p3_found": r"""WITH reports AS (
  SELECT trim(instance) AS instance, regexp_replace(trim(repo), '^(pubkey|type)/', '\1_') AS repo, np_count, reported_at, status_row,
         rtrim(translate(nullif(trim(checksum), ''), '-_', '+/'), '=') AS checksum
  FROM repo_status WHERE trim(repo) <> ''),
latest AS (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY instance, repo ORDER BY reported_at DESC, status_row DESC) = 1),
a AS (SELECT * FROM latest WHERE instance = 'inst-a'), b AS (SELECT * FROM latest WHERE instance = 'inst-b'),
j AS (SELECT coalesce(a.repo, b.repo) AS repo, a.repo AS ra, b.repo AS rb, a.np_count IS DISTINCT FROM b.np_count AS dn, a.checksum IS DISTINCT FROM b.checksum AS dc
      FROM a FULL JOIN b ON a.repo = b.repo)
SELECT repo, 'missing_a' AS finding FROM j WHERE ra IS NULL UNION ALL SELECT repo, 'missing_b' FROM j WHERE rb IS NULL
UNION ALL SELECT repo, 'np_count' FROM j WHERE ra = rb AND dn UNION ALL SELECT repo, 'checksum' FROM j WHERE ra = rb AND dc""",
    "p4_found": r"""WITH runs AS (SELECT run_id, setup_id, load_counter, polled_at FROM registry_polls WHERE trim(outcome) = 'ok' AND setup_id IS NOT NULL),
ranks AS (SELECT setup_id, row_number() OVER (ORDER BY min(polled_at)) AS r FROM runs GROUP BY 1),
seen AS (
  SELECT f.setup_id, f.load_number, regexp_extract(f.np_id, 'RA[A-Za-z0-9_-]{43}') AS code, arg_min(r.run_id, (r.polled_at, r.run_id)) AS run_id
  FROM window_feed f JOIN runs r ON r.setup_id = f.setup_id AND f.arrived_at <= r.polled_at AND f.load_number <= r.load_counter GROUP BY ALL)
SELECT run_id, load_number FROM seen s JOIN ranks USING (setup_id)
QUALIFY r = min(r) OVER (PARTITION BY code)""",
    "p5_found": r"""SELECT feed_id FROM window_feed WHERE trim(np_id) <> ''
QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(regexp_extract(np_id, 'RA[A-Za-z0-9_-]{43}'), ''), trim(np_id)) ORDER BY arrived_at, feed_id) > 1""",
}
