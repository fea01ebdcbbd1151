"""DuckDB twins of the entitlement queries."""

from __future__ import annotations

from siltstone.operators.access import OPERATIONS

# The operation map as rows: operation, privilege, depth checked (0: anywhere, NULL: the request's own).
_NEED = ", ".join("('{}', '{}', {})".format(name, wanted, {"anywhere": 0, "catalog": 1, "schema": 2}.get(level, "NULL"))
                  for name, wanted, level in OPERATIONS)

_BASE = """
place AS (SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
bought AS (SELECT l.*, o_custkey, o_orderpriority FROM lineitem l JOIN orders ON l_orderkey = o_orderkey)
"""

_TREE = _BASE + """,
sup AS (SELECT s_suppkey, 'namespace:' || r_name || '.' || n_name AS outer_ns,
               'namespace:' || r_name || '.' || n_name || '.' || sign AS inner_ns,
               'table:' || r_name || '.' || n_name || '.' || sign || '.' || s_name AS object
        FROM (SELECT *, CASE WHEN s_acctbal < 0 THEN 'debit' ELSE 'credit' END AS sign FROM supplier)
        JOIN place ON s_nationkey = n_nationkey),
cust AS (SELECT 'user:' || c_custkey AS usr, c_mktsegment, r_name, n_name
         FROM customer JOIN place ON c_nationkey = n_nationkey),
edges AS (SELECT object AS child, inner_ns AS parent FROM sup UNION SELECT inner_ns, outer_ns FROM sup
          UNION SELECT 'namespace:' || r_name || '.' || n_name, 'catalog:' || r_name FROM place
          /* more edges */),
anc AS (SELECT child, parent AS ancestor FROM edges
        UNION SELECT a.child, e.parent FROM anc a JOIN edges e ON e.child = a.ancestor),
role_tuples AS (
  SELECT usr AS subject, 'assignee' AS relation, 'role:' || n_name AS object FROM cust
  UNION ALL SELECT 'role:' || n_name || '#assignee', 'assignee', 'role:' || r_name FROM place
  UNION ALL SELECT 'role:' || r_name || '#assignee', 'ownership', 'role:' || n_name FROM place
            WHERE n_nationkey = r_regionkey),
members AS (SELECT subject, object AS role FROM role_tuples WHERE subject LIKE 'user:%'
            UNION SELECT m.subject, t.object FROM members m JOIN role_tuples t ON t.subject = m.role || '#assignee'),
tuples AS (
  SELECT * FROM role_tuples
  UNION SELECT usr, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'describe' WHEN 'BUILDING' THEN 'select'
                         WHEN 'FURNITURE' THEN 'modify' WHEN 'HOUSEHOLD' THEN 'create'
                         WHEN 'MACHINERY' THEN 'ownership' END, 'namespace:' || r_name || '.' || n_name FROM cust
  UNION SELECT 'user:' || o_custkey, CASE l_returnflag WHEN 'R' THEN 'ownership' WHEN 'A' THEN 'pass_grants'
                                          WHEN 'N' THEN 'describe' END, object
        FROM bought JOIN sup ON l_suppkey = s_suppkey
  UNION SELECT 'role:' || r_name || '#assignee', 'describe', 'catalog:' || r_name FROM place
  UNION SELECT 'user:*', 'managed_access', 'namespace:' || r_name || '.' || n_name FROM place
        WHERE r_name IN ('ASIA', 'EUROPE')),
targets AS (
  SELECT 'user:' || o_custkey AS subject, object FROM bought JOIN sup ON l_suppkey = s_suppkey
  UNION SELECT usr, 'namespace:' || r_name || '.' || n_name FROM cust
  UNION SELECT usr, 'catalog:' || r_name FROM cust),
holders AS (SELECT subject, subject AS holder FROM (SELECT DISTINCT subject FROM targets)
            UNION ALL SELECT subject, role || '#assignee' FROM members)
"""

# What some queries add to the edges, at the mark.
_SECOND_MARK = "/* more edges */"
_SECOND = """UNION SELECT object, 'namespace:' || r_name || '.' || n_name FROM sup JOIN place ON n_nationkey = s_suppkey % 25
          WHERE s_suppkey % 3 = 0"""

_HELD = _TREE + """,
blocked AS (SELECT DISTINCT child AS object FROM anc
            WHERE ancestor IN (SELECT object FROM tuples WHERE relation = 'managed_access' AND subject = 'user:*')),
places AS (SELECT subject, object, object AS spot FROM targets
           UNION ALL SELECT subject, object, ancestor FROM targets JOIN anc ON child = object),
hits AS (SELECT p.subject, p.object, p.spot, t.relation, t.object IN (SELECT object FROM blocked) AS is_blocked,
                split_part(p.object, ':', 1) AS kind, split_part(p.spot, ':', 1) IN ('catalog', 'namespace') AS holds
         FROM places p JOIN holders h ON h.subject = p.subject
         JOIN tuples t ON t.subject = h.holder AND t.object = p.spot),
held AS (
  SELECT subject, object,
         coalesce(bool_or(kind <> 'table' AND holds AND relation IN ('create', 'ownership')), false) AS "create",
         coalesce(bool_or(relation IN ('describe', 'select', 'modify', 'ownership')
                          OR (holds AND relation = 'create')), false) AS "describe",
         coalesce(bool_or(relation IN ('modify', 'ownership')), false) AS modify,
         coalesce(bool_or(relation IN ('select', 'modify', 'ownership')), false) AS "select",
         coalesce(bool_or(spot = object AND relation = 'ownership'), false) AS ownership,
         coalesce(bool_or(spot = object AND relation = 'pass_grants'), false) AS pass_grants,
         coalesce(bool_or(relation = 'manage_grants' OR (relation = 'ownership' AND NOT is_blocked)), false)
           AS manage_grants
  FROM targets LEFT JOIN hits USING (subject, object) GROUP BY subject, object)
"""

_SEEN = _HELD + """,
below AS (SELECT t.subject AS holder, a.ancestor AS container
          FROM tuples t JOIN anc a ON a.child = t.object
          WHERE t.relation IN ('describe', 'select', 'modify', 'ownership')
             OR (t.relation = 'create' AND NOT t.object LIKE 'table:%')),
seen AS (SELECT DISTINCT t.subject, t.object FROM targets t JOIN holders h ON h.subject = t.subject
         JOIN below b ON b.holder = h.holder AND b.container = t.object),
flags AS (
  SELECT h.*, split_part(h.object, ':', 1) AS kind,
         "describe" OR (h.subject, h.object) IN (SELECT (subject, object) FROM seen) AS visible,
         "create" AND pass_grants AS pass_create, "describe" AND pass_grants AS pass_describe,
         modify AND pass_grants AS pass_modify, "select" AND pass_grants AS pass_select
  FROM held h),
facts AS (UNPIVOT (SELECT subject, object, kind, "create", "describe", modify, "select", manage_grants, visible,
                          pass_create, pass_describe, pass_modify, pass_select FROM flags)
          ON "create", "describe", modify, "select", manage_grants, visible, pass_create, pass_describe, pass_modify,
             pass_select INTO NAME flag VALUE holds),
rules(kinds, capability, flag) AS (VALUES
  ('table namespace catalog', 'can_change_ownership', 'manage_grants'),
  ('table namespace catalog', 'can_grant_describe', 'manage_grants'),
  ('table namespace catalog', 'can_grant_describe', 'pass_describe'),
  ('table namespace catalog', 'can_grant_manage_grants', 'manage_grants'),
  ('table namespace catalog', 'can_grant_modify', 'manage_grants'),
  ('table namespace catalog', 'can_grant_modify', 'pass_modify'),
  ('table namespace catalog', 'can_grant_pass_grants', 'manage_grants'),
  ('table namespace catalog', 'can_grant_select', 'manage_grants'),
  ('table namespace catalog', 'can_grant_select', 'pass_select'),
  ('namespace catalog', 'can_grant_create', 'manage_grants'),
  ('namespace catalog', 'can_grant_create', 'pass_create'),
  ('table namespace', 'can_read_assignments', 'manage_grants'),
  ('table namespace', 'can_read_assignments', 'pass_describe'),
  ('table namespace', 'can_read_assignments', 'pass_select'),
  ('table namespace', 'can_read_assignments', 'pass_modify'),
  ('namespace', 'can_read_assignments', 'pass_create'),
  ('table', 'can_commit', 'modify'), ('table', 'can_control_tasks', 'modify'), ('table', 'can_drop', 'modify'),
  ('table', 'can_get_metadata', 'describe'), ('table', 'can_get_tasks', 'describe'),
  ('table', 'can_include_in_list', 'describe'), ('table', 'can_read_data', 'select'),
  ('table', 'can_rename', 'modify'), ('table namespace', 'can_set_protection', 'modify'),
  ('table', 'can_undrop', 'modify'), ('table', 'can_write_data', 'modify'),
  ('namespace catalog', 'can_create_namespace', 'create'), ('namespace', 'can_create_table', 'create'),
  ('namespace', 'can_create_view', 'create'), ('namespace catalog', 'can_delete', 'modify'),
  ('namespace catalog', 'can_get_metadata', 'visible'), ('namespace catalog', 'can_include_in_list', 'visible'),
  ('namespace catalog', 'can_list_everything', 'describe'), ('namespace catalog', 'can_list_namespaces', 'visible'),
  ('namespace', 'can_list_tables', 'visible'), ('namespace', 'can_list_views', 'visible'),
  ('namespace', 'can_set_managed_access', 'manage_grants'), ('namespace', 'can_update_properties', 'modify'),
  ('catalog', 'can_use', 'visible')),
able AS (SELECT subject, object, string_agg(DISTINCT capability, ',' ORDER BY capability) AS capabilities
         FROM facts JOIN rules ON facts.flag = rules.flag AND list_contains(string_split(kinds, ' '), kind)
         WHERE holds GROUP BY subject, object)
"""

_GRANTS = _BASE + """,
named AS (
  SELECT 'catalog' AS object_type, r_regionkey AS object_id, r_name AS "catalog", '' AS "schema", '' AS "table"
  FROM region
  UNION ALL SELECT 'schema', n_nationkey, r_name, n_name, '' FROM place
  UNION ALL SELECT 'table', s_suppkey, r_name, n_name, s_name FROM supplier JOIN place ON s_nationkey = n_nationkey),
grants AS (
  SELECT 'c' || c_custkey AS user_id, 'schema' AS object_type, c_nationkey AS object_id,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN ['SHOW_TABLES'] WHEN 'BUILDING' THEN ['SELECT_TABLE', 'SHOW_COLUMNS']
              WHEN 'FURNITURE' THEN ['CREATE_TABLE', 'DROP_TABLE'] WHEN 'HOUSEHOLD' THEN ['SHOW_SCHEMAS', 'INSERT_TABLE']
              WHEN 'MACHINERY' THEN ['ALL'] END AS actions, CAST(NULL AS VARCHAR[]) AS cols FROM customer
  UNION ALL SELECT DISTINCT 'c' || o_custkey, 'table', l_suppkey,
         CASE l_returnflag WHEN 'R' THEN ['SELECT_TABLE'] WHEN 'A' THEN ['SHOW_COLUMNS', 'UPDATE_TABLE']
              WHEN 'N' THEN ['INSERT_TABLE', 'DELETE_TABLE'] END,
         CASE WHEN l_linestatus = 'F' THEN ['s_name', 's_acctbal'] END FROM bought
  UNION ALL SELECT 'c' || c_custkey, 'catalog', n_regionkey, ['ALL'], NULL
         FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 9900),
priv AS (SELECT user_id, "catalog", "schema", "table", privilege, bool_or(cols IS NULL) AS whole,
                list_sort(list_distinct(coalesce(flatten(list(cols) FILTER (cols IS NOT NULL)), []))) AS cols
         FROM (SELECT user_id, "catalog", "schema", "table", unnest(actions) AS privilege, cols
               FROM grants JOIN named USING (object_type, object_id))
         GROUP BY user_id, "catalog", "schema", "table", privilege)
"""

_SALES = """
gone_s AS (SELECT s_suppkey FROM supplier JOIN gone_n ON s_nationkey = n_nationkey UNION SELECT s_suppkey FROM debt),
gone_c AS (SELECT c_custkey FROM customer JOIN gone_n ON c_nationkey = n_nationkey),
gone_o AS (SELECT o_orderkey FROM orders JOIN gone_c ON o_custkey = c_custkey),
lines AS (SELECT *, l_orderkey IN (FROM gone_o) OR l_suppkey IN (FROM gone_s) AS gone FROM lineitem)
"""

ORACLE = {
    "cascade_sales": f"""WITH
        gone_n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
        debt AS (SELECT s_suppkey FROM supplier WHERE s_acctbal < -500), {_SALES},
        total(table_name, removed, rows) AS (
          SELECT 'region', (SELECT count(*) FROM region WHERE r_name = 'EUROPE'), (SELECT count(*) FROM region)
          UNION ALL SELECT 'nation', (SELECT count(*) FROM gone_n), (SELECT count(*) FROM nation)
          UNION ALL SELECT 'supplier', (SELECT count(*) FROM gone_s), (SELECT count(*) FROM supplier)
          UNION ALL SELECT 'customer', (SELECT count(*) FROM gone_c), (SELECT count(*) FROM customer)
          UNION ALL SELECT 'orders', (SELECT count(*) FROM gone_o), (SELECT count(*) FROM orders)
          UNION ALL SELECT 'lineitem', (SELECT count(*) FROM lines WHERE gone), (SELECT count(*) FROM lineitem))
        SELECT table_name, removed AS removed_rows, rows - removed AS kept_rows FROM total""",
    "cascade_lines": f"""WITH gone_n AS (SELECT n_nationkey FROM nation WHERE n_nationkey % 4 = 1),
        debt AS (SELECT s_suppkey FROM supplier WHERE false), {_SALES}
        SELECT l_suppkey, count(*) AS lines, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
               CAST(sum(l_orderkey) AS BIGINT) AS orders
        FROM lines WHERE NOT gone GROUP BY l_suppkey""",
    "cascade_grants": f"""WITH {_GRANTS}
        SELECT user_id, object_type, object_id, count(*) AS grants
        FROM grants JOIN named USING (object_type, object_id)
        WHERE "catalog" <> 'ASIA' AND NOT (object_type = 'table'
              AND object_id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0))
        GROUP BY user_id, object_type, object_id""",
    "cascade_tree": """WITH RECURSIVE
        gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 11
                 UNION SELECT c.c_custkey FROM customer c JOIN gone g ON c.c_custkey // 3 = g.c_custkey)
        SELECT c_custkey, c_nationkey, c_custkey // 3 AS recruiter FROM customer WHERE c_custkey NOT IN (FROM gone)""",
    "role_closure": f"WITH RECURSIVE {_TREE} SELECT subject, role FROM members",
    "closure_changes": """WITH RECURSIVE
        place AS (SELECT n_nationkey, n_name, r_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
        edges AS (
          SELECT 'user:' || c_custkey AS src, 'role:' || n_name AS dst FROM customer JOIN place
                 ON n_nationkey = CASE WHEN c_mktsegment = 'BUILDING' THEN (c_nationkey + 1) % 25 ELSE c_nationkey END
          UNION SELECT 'role:' || n_name, 'role:' || r_name FROM place WHERE n_nationkey % 5 <> 0
          UNION SELECT 'role:' || r_name, 'role:' || n_name FROM place WHERE n_nationkey = r_regionkey AND r_name <> 'EUROPE'
          UNION SELECT 'role:ASIA', 'role:EUROPE'),
        pairs AS (SELECT src, dst FROM edges UNION SELECT p.src, e.dst FROM pairs p JOIN edges e ON e.src = p.dst)
        SELECT src, dst FROM pairs""",
    "effective_relations": f"""WITH RECURSIVE {_HELD}
        SELECT subject, object, "create", "describe", modify, "select", ownership, pass_grants FROM held""",
    "interval_relations": f"""WITH RECURSIVE {_HELD.replace(_SECOND_MARK, _SECOND)}
        SELECT subject, object, "create", "describe", modify, "select", ownership, pass_grants, manage_grants FROM held""",
    "tree_labels": f"""WITH RECURSIVE {_TREE},
        nodes AS (SELECT child AS node FROM edges UNION SELECT parent FROM edges)
        SELECT node, (SELECT count(*) FROM anc WHERE ancestor = node) AS below FROM nodes""",
    "indexed_tables": f"""WITH {_GRANTS},
        pairs AS (SELECT DISTINCT 'c' || o_custkey AS usr, r_name, n_name, s_name
                  FROM bought JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey),
        asked AS (SELECT usr, r_name AS cat, n_name AS sch, s_name AS tab FROM pairs
                  UNION SELECT usr, r_name, n_name, '' FROM pairs UNION SELECT usr, r_name, '', '' FROM pairs),
        met AS (SELECT a.*, privilege FROM asked a JOIN priv p ON p.user_id = usr AND p."catalog" = cat AND p."schema" = ''
                UNION SELECT a.*, privilege FROM asked a JOIN priv p
                ON p.user_id = usr AND p."catalog" = cat AND p."schema" = sch AND p."table" = '' AND sch <> ''
                UNION SELECT a.*, privilege FROM asked a JOIN priv p
                ON p.user_id = usr AND p."catalog" = cat AND p."schema" = sch AND p."table" = tab AND tab <> '')
        SELECT usr AS user_id, cat AS "catalog", sch AS "schema", tab AS "table",
               string_agg(DISTINCT privilege, ',' ORDER BY privilege) AS privileges
        FROM met GROUP BY usr, cat, sch, tab""",
    "grant_rights": f"""WITH RECURSIVE {_HELD}
        SELECT subject, object, manage_grants, concat_ws(',',
            CASE WHEN manage_grants THEN 'can_change_ownership' END,
            CASE WHEN NOT t AND (manage_grants OR ("create" AND pass_grants)) THEN 'can_grant_create' END,
            CASE WHEN manage_grants OR ("describe" AND pass_grants) THEN 'can_grant_describe' END,
            CASE WHEN manage_grants THEN 'can_grant_manage_grants' END,
            CASE WHEN manage_grants OR (modify AND pass_grants) THEN 'can_grant_modify' END,
            CASE WHEN manage_grants THEN 'can_grant_pass_grants' END,
            CASE WHEN manage_grants OR ("select" AND pass_grants) THEN 'can_grant_select' END,
            CASE WHEN NOT c AND (manage_grants OR (pass_grants AND ("describe" OR "select" OR modify
                                                                   OR (NOT t AND "create"))))
                 THEN 'can_read_assignments' END) AS rights
        FROM (SELECT *, object LIKE 'table:%' AS t, object LIKE 'catalog:%' AS c FROM held)""",
    "object_capabilities": f"""WITH RECURSIVE {_SEEN}
        SELECT subject, object, coalesce(capabilities, '') AS capabilities
        FROM targets LEFT JOIN able USING (subject, object)""",
    "listing_visibility": f"""WITH RECURSIVE {_TREE},
        listed AS (SELECT child, parent AS container FROM edges WHERE NOT child LIKE '%.credit'
                   UNION SELECT object, 'namespace:' || r_name || '.' || n_name
                         FROM sup JOIN place ON n_nationkey = s_suppkey % 25),
        up AS (SELECT child, container FROM listed
               UNION SELECT u.child, l.container FROM up u JOIN listed l ON l.child = u.container),
        described AS (SELECT DISTINCT subject, object FROM tuples
                      WHERE object NOT LIKE 'role:%' AND (relation IN ('describe', 'select', 'modify', 'ownership')
                         OR (relation = 'create' AND NOT object LIKE 'table:%'))),
        reached AS (SELECT DISTINCT object, object AS x FROM described
                    UNION SELECT d.object, a.child FROM (SELECT DISTINCT object FROM described) d
                          JOIN anc a ON a.ancestor = d.object),
        pairs AS (SELECT DISTINCT r.object, u.container FROM reached r JOIN up u ON u.child = r.x
                  WHERE u.container <> r.object
                    AND NOT EXISTS (SELECT 1 FROM anc a WHERE a.child = u.container AND a.ancestor = r.object))
        SELECT DISTINCT subject AS holder, container FROM described JOIN pairs USING (object)""",
    "listing_mismatches": f"""WITH RECURSIVE {_TREE},
        listed AS (SELECT child, parent AS container FROM edges WHERE NOT child LIKE '%.credit'
                   UNION SELECT object, 'namespace:' || r_name || '.' || n_name
                         FROM sup JOIN place ON n_nationkey = s_suppkey % 25)
        SELECT *, 'listed' AS missing_in FROM (SELECT child, parent AS container FROM edges EXCEPT SELECT * FROM listed)
        UNION ALL
        SELECT *, 'parents' FROM (SELECT * FROM listed EXCEPT SELECT child, parent FROM edges)""",
    "role_capabilities": f"""WITH RECURSIVE {_TREE},
        asked AS (SELECT usr AS subject, 'role:' || n_name AS object FROM cust
                  UNION SELECT usr, 'role:' || r_name FROM cust),
        holds AS (SELECT a.subject, a.object, bool_or(t.relation = 'ownership') AS owner
                  FROM asked a JOIN holders h ON h.subject = a.subject
                  JOIN role_tuples t ON t.object = a.object AND t.subject = h.holder GROUP BY ALL)
        SELECT a.subject, a.object, CASE WHEN owner THEN 'can_assume,can_change_ownership,can_delete,'
                 || 'can_grant_assignee,can_update' WHEN owner IS NOT NULL THEN 'can_assume' ELSE '' END AS capabilities
        FROM asked a LEFT JOIN holds USING (subject, object)""",
    "upward_visibility": f"WITH RECURSIVE {_SEEN} SELECT DISTINCT holder, container FROM below",
    "column_grants": f"""WITH RECURSIVE {_HELD},
        direct AS (SELECT DISTINCT 'user:' || o_custkey AS subject,
                          CASE WHEN l_returnflag = 'A' THEN 'mask' ELSE 'select' END AS relation, object,
                          CASE l_returnflag WHEN 'R' THEN 's_acctbal' WHEN 'A' THEN 's_name' ELSE 's_nationkey' END
                            AS name
                   FROM bought JOIN sup ON l_suppkey = s_suppkey),
        cols(name) AS (VALUES ('s_suppkey'), ('s_name'), ('s_nationkey'), ('s_acctbal'))
        SELECT h.subject, 'column:' || substring(h.object, 7) || '.' || c.name AS object,
               h."select" OR s.subject IS NOT NULL AS "select", m.subject IS NOT NULL AS mask
        FROM held h CROSS JOIN cols c
        LEFT JOIN direct s ON s.subject = h.subject AND s.object = h.object AND s.name = c.name
                          AND s.relation = 'select'
        LEFT JOIN direct m ON m.subject = h.subject AND m.object = h.object AND m.name = c.name
                          AND m.relation = 'mask'
        WHERE h.object LIKE 'table:%'""",
    "rbac_lookup": f"""WITH {_GRANTS}
        SELECT user_id, "catalog", "schema", "table", privilege, whole, array_to_string(cols, ',') AS "columns"
        FROM priv""",
    "decisions": f"""WITH {_GRANTS},
        req AS (
          SELECT l_orderkey, l_linenumber, l_partkey, 'c' || o_custkey AS user_id,
                 CASE o_orderpriority WHEN '1-URGENT' THEN 'SelectFromColumns' WHEN '2-HIGH' THEN 'InsertIntoTable'
                      WHEN '3-MEDIUM' THEN 'FilterTables' WHEN '4-NOT SPECIFIED' THEN 'ShowTables'
                      ELSE 'ExecuteQuery' END AS operation,
                 CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'system' ELSE r_name END AS cat,
                 CASE WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'information_schema' ELSE n_name END AS sch,
                 s_name AS tab,
                 CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_returnflag = 'R' THEN ['s_name', 's_acctbal']
                                                        ELSE ['s_name', 's_nationkey'] END END AS asked
          FROM bought JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey),
        need(operation, wanted, lvl) AS (VALUES
          ('SelectFromColumns', 'SELECT_TABLE', 'table'), ('InsertIntoTable', 'INSERT_TABLE', 'table'),
          ('FilterTables', 'ANY', 'table'), ('FilterTables', 'ANY', 'schema'),
          ('FilterTables', 'SHOW_TABLES', 'schema'), ('ShowTables', 'SHOW_TABLES', 'schema')),
        hit AS (
          SELECT u.user_id, operation, cat, sch, tab, asked, lvl, whole, cols
          FROM (SELECT DISTINCT user_id, operation, cat, sch, tab, asked FROM req) u JOIN need USING (operation)
          JOIN priv p ON p.user_id = u.user_id AND p."catalog" = u.cat
                     AND (p."schema" = '' OR p."schema" = u.sch)
                     AND (p."table" = '' OR (lvl = 'table' AND p."table" = u.tab))
                     AND (wanted = 'ANY' OR privilege IN ('ALL', wanted))),
        granted AS (
          SELECT user_id, operation, cat, sch, tab, asked,
                 bool_or(lvl = 'schema' OR whole OR asked IS NULL)
                 OR list_has_all(coalesce(flatten(list(cols) FILTER (lvl = 'table')), []), asked) AS yes
          FROM hit GROUP BY user_id, operation, cat, sch, tab, asked)
        SELECT l_orderkey, l_linenumber, l_partkey, r.user_id, r.operation, 'table' AS level,
               r.operation = 'ExecuteQuery' OR r.cat = 'system' OR r.sch = 'information_schema'
               OR coalesce(g.yes, false) AS allowed
        FROM req r LEFT JOIN granted g
          ON g.user_id = r.user_id AND g.operation = r.operation AND g.cat = r.cat AND g.sch = r.sch
         AND g.tab = r.tab AND g.asked IS NOT DISTINCT FROM r.asked""",
    "operation_matrix": f"""WITH {_GRANTS},
        need(operation, wanted, fixed) AS (VALUES {_NEED}),
        names AS (SELECT operation, row_number() OVER (ORDER BY operation) - 1 AS number
                  FROM (SELECT DISTINCT operation FROM need)),
        firsts AS (SELECT o_custkey, min(l_suppkey) AS s FROM bought GROUP BY o_custkey),
        req AS (SELECT o_custkey, 'c' || o_custkey AS user_id, operation, (number + o_custkey) % 6 AS shape,
                       r_name AS cat, n_name AS sch, s_name AS tab
                FROM firsts JOIN supplier ON s_suppkey = s JOIN place ON s_nationkey = n_nationkey, names),
        shaped AS (SELECT *, CASE WHEN shape IN (0, 1, 5) THEN 3 WHEN shape = 2 THEN 2 ELSE 1 END AS own,
                          CASE shape WHEN 0 THEN ['s_name', 's_acctbal'] WHEN 5 THEN ['s_nationkey'] END AS asked
                   FROM req),
        checks AS (SELECT s.*, wanted, coalesce(fixed, own) AS depth FROM shaped s JOIN need USING (operation)
                   WHERE coalesce(fixed, own) BETWEEN 1 AND own),
        met AS (SELECT c.*, privilege, whole, cols FROM checks c JOIN priv p
                ON p.user_id = c.user_id AND p."catalog" = cat AND p."schema" = ''
                UNION ALL SELECT c.*, privilege, whole, cols FROM checks c JOIN priv p
                ON p.user_id = c.user_id AND p."catalog" = cat AND p."schema" = sch AND p."table" = '' WHERE depth >= 2
                UNION ALL SELECT c.*, privilege, whole, cols FROM checks c JOIN priv p
                ON p.user_id = c.user_id AND p."catalog" = cat AND p."schema" = sch AND p."table" = tab WHERE depth >= 3),
        hit AS (SELECT o_custkey, operation, depth < 3 OR asked IS NULL OR whole AS free, cols, asked FROM met
                WHERE wanted = 'ANY' OR privilege IN ('ALL', wanted)),
        granted AS (SELECT o_custkey, operation,
                           bool_or(free) OR list_has_all(flatten(list(cols)), any_value(asked)) AS yes
                    FROM hit GROUP BY o_custkey, operation)
        SELECT o_custkey, s.operation, CASE own WHEN 3 THEN 'table' WHEN 2 THEN 'schema' ELSE 'catalog' END AS level,
               s.operation = 'ExecuteQuery' OR coalesce(g.yes, false)
               OR (s.operation IN (SELECT operation FROM need WHERE fixed = 0)
                   AND s.user_id IN (SELECT user_id FROM priv)) AS allowed
        FROM shaped s LEFT JOIN granted g USING (o_custkey, operation)""",
    "column_batches": f"""WITH {_GRANTS},
        pairs AS (SELECT DISTINCT o_custkey, l_suppkey, r_name, n_name, s_name
                  FROM bought JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey),
        cols("index", "column") AS (VALUES (0, 's_suppkey'), (1, 's_name'), (2, 's_nationkey'), (3, 's_acctbal')),
        seen AS (SELECT o_custkey, l_suppkey, "index",
                        coalesce(bool_or(whole OR list_contains(p.cols, "column")), false) AS allowed
                 FROM pairs CROSS JOIN cols LEFT JOIN priv p
                   ON p.user_id = 'c' || o_custkey AND p."catalog" = r_name
                  AND (p."schema" = '' OR (p."schema" = n_name AND (p."table" = '' OR p."table" = s_name)))
                  AND privilege IN ('ALL', 'SELECT_TABLE', 'SHOW_COLUMNS') GROUP BY ALL)
        SELECT o_custkey, l_suppkey,
               coalesce(string_agg("index", ',' ORDER BY "index") FILTER (allowed), '') AS indices
        FROM seen GROUP BY o_custkey, l_suppkey""",
    "visible_tables": f"""WITH {_GRANTS},
        pairs AS (SELECT DISTINCT o_custkey, l_suppkey, r_name, n_name, s_name
                  FROM bought JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey),
        found AS (SELECT o_custkey, l_suppkey, bool_or(p.user_id IS NOT NULL) AS at_table,
                         bool_or(p."table" = '') AS at_schema, bool_or(p."schema" = '') AS at_catalog
                  FROM pairs LEFT JOIN priv p ON p.user_id = 'c' || o_custkey AND p."catalog" = r_name
                   AND (p."schema" = '' OR (p."schema" = n_name AND (p."table" = '' OR p."table" = s_name)))
                  GROUP BY o_custkey, l_suppkey)
        SELECT o_custkey, l_suppkey, concat_ws(',', CASE WHEN at_table THEN '0' END, CASE WHEN at_schema THEN '1' END,
                                               CASE WHEN at_catalog THEN '2' END) AS indices FROM found""",
    "visible_columns": f"""WITH {_GRANTS},
        pairs AS (SELECT DISTINCT o_custkey, s_suppkey, r_name, n_name, s_name
                  FROM bought JOIN supplier ON l_suppkey = s_suppkey JOIN place ON s_nationkey = n_nationkey),
        cols("index", "column") AS (VALUES (0, 's_suppkey'), (1, 's_name'), (2, 's_nationkey'), (3, 's_acctbal'))
        SELECT s_suppkey, 'c' || o_custkey AS user_id, "index", "column",
               coalesce(bool_or(whole OR list_contains(p.cols, "column")), false) AS allowed
        FROM pairs CROSS JOIN cols LEFT JOIN priv p
          ON p.user_id = 'c' || o_custkey AND p."catalog" = r_name
         AND (p."schema" = '' OR (p."schema" = n_name AND (p."table" = '' OR p."table" = s_name)))
         AND privilege IN ('ALL', 'SELECT_TABLE', 'SHOW_COLUMNS')
        GROUP BY s_suppkey, o_custkey, "index", "column" """,
    "row_filter": "SELECT * FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0",
    "column_mask": """
        SELECT c_custkey, substring(c_name, 1, 3) || '******' AS c_name, c_nationkey, c_acctbal, c_mktsegment
        FROM customer""",
    "role_masks": """
        SELECT c_custkey, substring(c_name, 1, 3) || '******' AS c_name, c_nationkey, c_acctbal,
               CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN substring(c_mktsegment, 1, 3) || '******'
                    ELSE c_mktsegment END AS c_mktsegment, 'analyst_' || c_nationkey AS user_id
        FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "secured_dataset": """
        SELECT c_custkey, substring(c_name, 1, 3) || '******' AS c_name, c_nationkey, c_mktsegment
        FROM customer WHERE c_nationkey = 7 AND c_acctbal > 0""",
    "secured_for_users": """
        SELECT 'analyst_' || c_nationkey AS user_id, c_custkey, substring(c_name, 1, 3) || '******' AS c_name, c_nationkey,
               CAST(NULL AS DOUBLE) AS c_acctbal, c_mktsegment
        FROM customer WHERE c_acctbal > 0""",
    "rows_of_users": """
        SELECT 'c' || c_custkey AS user_id, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys
        FROM customer JOIN orders ON c_acctbal >= 9990
             OR (o_custkey % 25 = c_nationkey AND o_orderkey % 100 = c_custkey % 100)
        GROUP BY c_custkey""",
    "grant_checks": f"""WITH {_BASE}
        SELECT 'actions_empty' AS rule, count(*) AS violations FROM customer WHERE c_mktsegment = 'HOUSEHOLD'
        UNION ALL SELECT 'actions_unknown', count(*) FROM customer WHERE c_mktsegment = 'FURNITURE'
        UNION ALL SELECT 'object_type_unknown', count(*) FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT 'grant_repeated', count(*) FROM (
            SELECT o_custkey, l_suppkey FROM bought WHERE l_linestatus = 'F' GROUP BY ALL HAVING count(*) > 1)""",
    "grant_updates": """
        SELECT o_orderkey AS relation_id, o_custkey AS user_id,
               CASE WHEN o_orderstatus = 'F' THEN 'ALL' ELSE o_orderpriority END AS action,
               TIMESTAMP '2024-01-01' AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-01' END AS updated_at
        FROM orders
        UNION ALL SELECT -1 - c_custkey, c_custkey, 'NEW', TIMESTAMP '2024-02-01', TIMESTAMP '2024-02-01'
        FROM customer""",
    "grant_revoke": f"""WITH {_BASE}
        (SELECT 'user:' || o_custkey AS subject, 'select' AS relation, 'table:' || l_suppkey AS object FROM bought
         UNION SELECT 'user:' || o_custkey, 'describe', 'table:' || l_suppkey FROM bought WHERE l_returnflag = 'N')
        EXCEPT SELECT 'user:' || o_custkey, 'select', 'table:' || l_suppkey FROM bought WHERE l_returnflag = 'R'""",
}
ORACLE["indexed_matrix"] = ORACLE["operation_matrix"]
