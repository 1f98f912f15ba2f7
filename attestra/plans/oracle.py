"""SQL equivalents of the registered queries, written independently of the DataFrame plans."""

from __future__ import annotations

# Common table expressions shared by several statements; only those a statement names are added.
_CTES: dict[str, str] = {
    "op": "SELECT o.*, c.c_nationkey AS project_id FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey",
    "prio": """
        SELECT o_orderkey, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'must' WHEN '2' THEN 'must'
            WHEN '3' THEN 'should' WHEN '5' THEN 'could' ELSE 'unclear' END AS priority FROM orders""",
    "req": """
        SELECT op.project_id, op.o_orderkey AS req_id, op.o_orderstatus AS title, prio.priority,
            coalesce(t.n, 0) AS n_evidence,
            CASE WHEN t.n IS NULL THEN 'missing' WHEN prio.priority = 'unclear' OR t.n_unclear > 0 THEN 'unclear'
                WHEN t.n_covered = t.n THEN 'covered' ELSE 'partial' END AS status
        FROM op JOIN prio USING (o_orderkey) LEFT JOIN (
            SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_unclear,
                count(*) FILTER (l_returnflag = 'A') AS n_covered FROM lineitem GROUP BY 1) t
            ON t.l_orderkey = op.o_orderkey""",
    "crit": """
        SELECT op.project_id, op.o_custkey, op.o_orderkey AS ac_id, prio.priority, op.o_totalprice,
            coalesce(t.n, 0) AS n_evidence, CASE WHEN t.n IS NULL THEN 'missing' ELSE 'covered' END AS status
        FROM op JOIN prio USING (o_orderkey) LEFT JOIN (
            SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'A' GROUP BY 1) t
            ON t.l_orderkey = op.o_orderkey""",
    "claim": """
        SELECT 'C' || o_orderkey AS claim_id, 'K' || o_custkey AS related_task, o_orderkey AS ord, o_orderdate,
            CASE o_orderstatus WHEN 'F' THEN 'covered' WHEN 'O' THEN 'partial' ELSE 'compliant' END AS claimed_status
        FROM orders""",
    "done": "SELECT * FROM claim WHERE claimed_status IN ('covered', 'compliant')",
    "evref": """
        SELECT 'C' || l_orderkey AS claim_id, l_linenumber AS pos,
            CASE WHEN l_returnflag = 'A' THEN 'E' || l_partkey WHEN l_returnflag = 'N' THEN 'N' || l_partkey
                WHEN l_linestatus = 'O' THEN 'C' || l_orderkey ELSE 'S' || l_suppkey END AS ref FROM lineitem""",
    "testref": """
        SELECT 'C' || l_orderkey AS claim_id, 'S' || CAST(l_quantity AS INT) AS path FROM lineitem
        WHERE l_linestatus = 'F'""",
    "pev": """
        SELECT 'E' || p_partkey AS evidence_id, CASE WHEN p_type = 'ECONOMY' THEN 'test' ELSE 'tool' END AS source_type,
            'S' || p_size AS source_path, CASE WHEN p_type = 'ECONOMY' THEN 'N' || p_partkey END AS nodeid,
            CASE WHEN p_brand = 'Brand#1' THEN 'violated' WHEN p_brand IN ('Brand#2', 'Brand#3') THEN 'unclear'
                WHEN p_type = 'ECONOMY' THEN 'covered' ELSE 'compliant' END AS status, p_partkey AS ord, p_size
        FROM part""",
    "tev": """
        SELECT 'T' || c_custkey AS evidence_id, 'K' || c_custkey AS task_id, c_custkey AS ord, c_nationkey, c_mktsegment,
            CASE WHEN c_acctbal < 0 THEN 'partial' ELSE 'covered' END AS status
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "evkey": """
        SELECT DISTINCT * FROM (
            SELECT evidence_id AS ref, evidence_id, status, ord FROM pev
            UNION ALL SELECT source_path, evidence_id, status, ord FROM pev
            UNION ALL SELECT nodeid, evidence_id, status, ord FROM pev WHERE nodeid IS NOT NULL
            UNION ALL SELECT evidence_id, evidence_id, status, ord FROM tev
            UNION ALL SELECT 'docs/task_list.json', evidence_id, status, ord FROM tev)""",
    "keysum": """
        SELECT ref, count(DISTINCT status) AS n_status, string_agg(DISTINCT status, ', ' ORDER BY status) AS statuses,
            count(*) FILTER (status IN ('covered', 'compliant')) AS n_supporting, bool_or(status = 'violated') AS violated,
            max_by(status, ord) FILTER (status NOT IN ('covered', 'compliant', 'violated')) AS other
        FROM evkey GROUP BY 1""",
    "taskac": """
        SELECT task_id, 'AC-N' || c_nationkey AS ac_id FROM tev
        UNION ALL SELECT task_id, 'AC-S' || c_mktsegment FROM tev""",
    "actest": """
        SELECT 'AC-N' || p_size AS ac_id, count(*) AS n_tests, count(*) FILTER (status <> 'covered') AS n_failed
        FROM pev WHERE source_type = 'test' GROUP BY 1""",
    "external": """
        SELECT d.claim_id, e.ref FROM done d JOIN evref e ON e.claim_id = d.claim_id AND e.ref <> e.claim_id""",
    "reffound": """
        SELECT x.claim_id, x.ref, k.n_status, k.statuses, k.violated, k.other, k.ref IS NOT NULL AS found
        FROM external x LEFT JOIN keysum k USING (ref)""",
    "refind": """
        SELECT claim_id, 'self_referential_claim' AS category, CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS VARCHAR) AS detail,
            1 AS occurrences FROM done WHERE claim_id NOT IN (SELECT claim_id FROM external)
        UNION ALL SELECT claim_id, 'conflicting_statuses', ref, statuses, 1 FROM reffound WHERE n_status > 1
        UNION ALL SELECT claim_id, CASE WHEN NOT found THEN 'non_existent_evidence' WHEN violated THEN 'violated_evidence'
            ELSE 'unclear_evidence_status' END, ref, CASE WHEN NOT found THEN NULL WHEN violated THEN 'violated' ELSE other END, 1
            FROM reffound WHERE NOT found OR violated OR other IS NOT NULL""",
    "missed": """
        SELECT d.claim_id, t.ac_id FROM done d JOIN taskac t ON t.task_id = d.related_task JOIN actest a USING (ac_id)
        WHERE d.claim_id IN (SELECT claim_id FROM testref) AND NOT EXISTS (
            SELECT 1 FROM testref r JOIN pev p ON p.source_path = r.path
            WHERE r.claim_id = d.claim_id AND p.source_type = 'test' AND 'AC-N' || p.p_size = t.ac_id)""",
    "find": """
        SELECT claim_id, category, ref, detail, CAST(occurrences AS BIGINT) AS occurrences FROM (
            SELECT * FROM refind
            UNION ALL SELECT d.claim_id, 'task_not_completed', d.related_task, t.status, 1
                FROM done d JOIN tev t ON t.task_id = d.related_task WHERE t.status <> 'covered'
            UNION ALL SELECT d.claim_id, 'non_existent_task', d.related_task, NULL, 1
                FROM done d WHERE d.related_task NOT IN (SELECT task_id FROM tev)
            UNION ALL SELECT d.claim_id, 'no_test_coverage', t.ac_id, NULL, 1 FROM done d
                JOIN taskac t ON t.task_id = d.related_task LEFT JOIN actest a USING (ac_id) WHERE a.ac_id IS NULL
            UNION ALL SELECT d.claim_id, 'failed_tests', t.ac_id, NULL, a.n_failed FROM done d
                JOIN taskac t ON t.task_id = d.related_task JOIN actest a USING (ac_id) WHERE a.n_failed > 0
            UNION ALL SELECT claim_id, 'test_covers_mismatch', ac_id, NULL, 1 FROM missed)""",
    "covfile": """
        SELECT p_brand AS project_id, 'src/' || p_partkey || '.py' AS path, p_size * 2.0::DOUBLE AS percent_covered,
            CAST(trunc(p_retailprice) AS BIGINT) AS num_statements FROM part""",
    "changed": """
        SELECT 'src/' || p_partkey || '.py' AS path FROM part
        WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5')""",
    "globbed": """
        SELECT *, (path GLOB 'src/1*' OR path GLOB '*/src/1*' OR path GLOB 'src/??.py' OR path GLOB '*/src/??.py'
              OR path GLOB '[2-4]*5.py' OR path GLOB '*/[2-4]*5.py')
            AND NOT (path GLOB '*/1[!0-4]*' OR path GLOB '*/*/1[!0-4]*' OR path GLOB 'src/*7.p?' OR path GLOB '*/src/*7.p?')
            AS in_scope FROM (SELECT p_brand AS project_id, 'src/' || p_partkey || '.py' AS path FROM part)""",
    "fref": """
        SELECT 'C' || l_orderkey AS claim_id, CASE WHEN l_returnflag = 'R' THEN 'test' ELSE 'code' END AS kind,
            'src/' || l_partkey || '.py' AS path, l_linestatus = 'F' AS has_fragment, l_linenumber AS pos, l_partkey
        FROM lineitem""",
    "staged": """
        SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
            o_totalprice, o_orderdate FROM orders""",
    "head": "SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'",
    "dec": """
        SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 'accept_risk' WHEN 'signup' THEN 'mark_complete'
            ELSE event_type END AS action, json_extract_string(props, '$.k') AS target FROM events""",
    "pdec": "SELECT d.*, c.c_nationkey AS project_id FROM dec d JOIN customer c ON c.c_custkey = d.user_id",
    "rule": """
        SELECT p_brand AS project_id, CASE p_type WHEN 'ECONOMY' THEN 'dependency_rules' WHEN 'LARGE' THEN 'quality_gates'
                WHEN 'MEDIUM' THEN 'storage_rules' WHEN 'PROMO' THEN 'security_rules' WHEN 'SMALL' THEN 'forbidden_patterns'
                ELSE 'other_section' END AS section, 'RULE-' || p_partkey AS rule_id,
            CASE WHEN p_size <= 40 THEN 'must' ELSE 'should' END AS severity,
            CASE WHEN p_size <= 25 THEN 'manual' ELSE 'machine' END AS method,
            CASE WHEN p_retailprice < 960 THEN 'lead' END AS accepted_by,
            CASE WHEN p_retailprice < 950 THEN TIMESTAMP '2001-01-01' + to_days(p_size) END AS accepted_at,
            p_size, p_type FROM part""",
    "edge": """
        SELECT op.project_id AS from_module, s.s_nationkey AS to_module, count(*) AS n_lines FROM lineitem l
        JOIN op ON op.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1, 2""",
    "bound": """
        SELECT e.*, nf.n_regionkey <> nt.n_regionkey AS outside, e.to_module = e.from_module + 1 AS forbidden FROM edge e
        JOIN nation nf ON nf.n_nationkey = e.from_module JOIN nation nt ON nt.n_nationkey = e.to_module
        WHERE e.from_module <> e.to_module""",
    "gap": """
        SELECT project_id, CAST(req_id AS VARCHAR) AS item_id, 'requirement' AS item_type, req_id AS ord, 1 AS source_rank,
            'must' AS severity FROM req WHERE status = 'missing' AND priority = 'must'
        UNION ALL SELECT project_id, CAST(ac_id AS VARCHAR), 'ac', ac_id, 2, 'must' FROM crit
            WHERE status = 'missing' AND priority = 'must' AND o_totalprice >= 250000
        UNION ALL SELECT c_nationkey, CAST(c_custkey AS VARCHAR), 'task', c_custkey, 3, 'should' FROM customer
            WHERE c_acctbal < 0""",
    "touched": "SELECT project_id, CAST(o_orderkey AS VARCHAR) AS item_id FROM op WHERE o_totalprice > 450000",
    "evid": """
        SELECT project_id, CAST(o_orderkey AS VARCHAR) AS item_id FROM op
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""",
    "actions": """
        SELECT g.project_id, 'HIGH' AS priority, 'cover_gap' AS type, g.item_id, 1 AS rank, g.ord,
            CASE WHEN t.item_id IS NOT NULL THEN 85 WHEN e.item_id IS NOT NULL THEN 60 ELSE 30 END AS urgency
        FROM gap g LEFT JOIN touched t USING (project_id, item_id) LEFT JOIN evid e USING (project_id, item_id)
        WHERE g.severity = 'must'
        UNION ALL SELECT r.project_id, CASE k.k WHEN 2 THEN 'HIGH' ELSE 'LOW' END,
            CASE k.k WHEN 2 THEN 'high_risk' ELSE 'stale_debt' END, 'R' || r.o_orderkey, k.k, r.o_orderkey,
            CASE WHEN t.item_id IS NOT NULL THEN 85 WHEN e.item_id IS NOT NULL THEN 60 WHEN r.o_totalprice < 20000 THEN 25 ELSE 30 END
        FROM op r JOIN (VALUES (2), (3)) k(k) ON (k.k = 2 AND r.o_orderpriority LIKE '1%') OR (k.k = 3 AND r.o_totalprice < 20000)
        LEFT JOIN touched t ON t.project_id = r.project_id AND t.item_id = CAST(r.o_orderkey AS VARCHAR)
        LEFT JOIN evid e ON e.project_id = r.project_id AND e.item_id = CAST(r.o_orderkey AS VARCHAR)
        WHERE r.o_orderstatus = 'P'""",
    "gproj": """
        SELECT c_custkey AS project_id, CASE WHEN c_acctbal < -700 THEN 'draft' ELSE 'active' END AS status FROM customer""",
    "gdec": "SELECT DISTINCT user_id AS project_id, action, target FROM dec WHERE action IN ('accept_risk', 'mark_complete')",
    "gfind": """
        SELECT c.o_custkey AS project_id, 'ac_missing_evidence' AS code, CAST(c.ac_id AS VARCHAR) AS item_id, 3 AS rank,
            c.ac_id AS ord, d.target IS NOT NULL AS resolved, 'block' AS open_effect
        FROM crit c LEFT JOIN gdec d ON d.project_id = c.o_custkey AND d.action = 'mark_complete' AND d.target = CAST(c.ac_id AS VARCHAR)
        WHERE c.status = 'missing' AND c.priority = 'must' AND c.o_totalprice >= 450000
        UNION ALL SELECT o.o_custkey, 'non_blocking_gap', CAST(o.o_orderkey AS VARCHAR), 10, o.o_orderkey, d.target IS NOT NULL, 'fail'
        FROM orders o JOIN prio USING (o_orderkey)
        LEFT JOIN gdec d ON d.project_id = o.o_custkey AND d.action = 'mark_complete' AND d.target = CAST(o.o_orderkey AS VARCHAR)
        WHERE prio.priority = 'must' AND o.o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
        UNION ALL SELECT o.o_custkey, k.code, 'R' || o.o_orderkey, k.rank, o.o_orderkey, d.target IS NOT NULL, k.effect
        FROM orders o
        LEFT JOIN gdec d ON d.project_id = o.o_custkey AND d.action = 'accept_risk' AND d.target = CAST(o.o_orderkey AS VARCHAR)
        JOIN (VALUES ('high_risk', 4, 'block'), ('low_risk', 11, 'fail')) k(code, rank, effect)
            ON (k.code = 'high_risk' AND ((o.o_orderstatus = 'P' AND o.o_totalprice > 490000 AND o.o_orderpriority LIKE '1%') OR d.target IS NOT NULL))
            OR (k.code = 'low_risk' AND o.o_orderstatus = 'P' AND o.o_totalprice > 490000 AND o.o_orderpriority NOT LIKE '1%')""",
    "gfx": "SELECT *, CASE WHEN resolved THEN 'note' ELSE open_effect END AS effect FROM gfind",
    "gate": """
        SELECT p.project_id,
            CASE WHEN p.status = 'draft' THEN 'draft_approved' WHEN coalesce(f.b, 0) > 0 THEN 'blocked'
                WHEN coalesce(f.f, 0) > 0 THEN 'fail' ELSE 'pass' END AS gate_decision,
            CASE WHEN p.status = 'draft' THEN 0 ELSE coalesce(f.b, 0) END AS n_blocking,
            CASE WHEN p.status = 'draft' THEN 0 ELSE coalesce(f.f, 0) END AS n_failing,
            CASE WHEN p.status = 'draft' THEN 0 ELSE coalesce(f.n, 0) END AS n_noted,
            CASE WHEN p.status = 'draft' THEN 0 ELSE coalesce(f.r, 0) END AS n_resolved,
            coalesce(d.n, 0) AS human_decisions_applied
        FROM gproj p LEFT JOIN (
            SELECT project_id, count(*) FILTER (effect = 'block') AS b, count(*) FILTER (effect = 'fail') AS f,
                count(*) FILTER (effect = 'note') AS n, count(*) FILTER (resolved) AS r FROM gfx GROUP BY 1) f USING (project_id)
        LEFT JOIN (SELECT project_id, count(*) AS n FROM gdec GROUP BY 1) d USING (project_id)""",
    "pedge": """
        SELECT l.l_orderkey AS file_path, l.l_linenumber AS lineno, l.l_partkey, l.l_returnflag AS flag,
            replace(p.p_name, ' ', '.') AS imported_module, p.p_brand AS to_module
        FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey""",
    "affc": """
        SELECT DISTINCT f.claim_id FROM fref f JOIN part p ON p.p_partkey = f.l_partkey
        WHERE p.p_brand = 'Brand#7' AND p.p_size < 20""",
    "afft": "SELECT DISTINCT c.related_task AS task_id FROM claim c JOIN affc USING (claim_id)",
    "aff": """
        SELECT 'claim' AS item_type, claim_id AS item_id FROM affc UNION ALL SELECT 'task', task_id FROM afft
        UNION ALL SELECT DISTINCT 'requirement', 'REQ-' || c_nationkey FROM customer JOIN afft ON task_id = 'K' || c_custkey
        UNION ALL SELECT DISTINCT 'ac', 'AC-' || CAST(floor(c_acctbal) AS BIGINT) FROM customer JOIN afft ON task_id = 'K' || c_custkey""",
    "igap": """
        SELECT 'claim' AS item_type, 'C' || o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT 'ac', 'AC-' || CAST(floor(c_acctbal) AS BIGINT) FROM customer
        UNION ALL SELECT 'task', 'K' || c_custkey FROM customer WHERE c_acctbal < 0""",
    "idtext": """
        SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'AC-P-' || c_nationkey || '-' || c_custkey
            WHEN 'AUTOMOBILE' THEN 'TASK-P-' || c_custkey WHEN 'FURNITURE' THEN 'REQ-X-' || c_custkey
            WHEN 'HOUSEHOLD' THEN 'DOC-' || c_custkey ELSE ' ' END AS id FROM customer""",
    "exitcode": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CASE WHEN o_totalprice < 100000 THEN 0
            WHEN o_totalprice < 450000 THEN 1 WHEN o_totalprice < 480000 THEN 2 ELSE 3 END AS code FROM orders""",
    "toolrows": """
        SELECT o_orderkey AS ord, cat AS tool_category, 'f' || o_orderkey AS source_path, code,
            CASE WHEN code = 3 OR (code = 2 AND cat <> 'type_check') THEN 'tool_execution_failed'
                WHEN code = 2 THEN 'tool_usage_error' END AS error_code,
            CASE WHEN code >= 2 THEN NULL
                WHEN cat = 'lint' THEN CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END
                WHEN cat = 'security' THEN CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END
                WHEN code = 1 AND o_orderstatus = 'F' THEN 2 ELSE 0 END AS n_findings
        FROM exitcode, (VALUES ('lint'), ('type_check'), ('security')) v(cat)""",
    "toolst": """
        SELECT ord, tool_category, source_path, error_code, n_findings,
            CASE WHEN error_code = 'tool_usage_error' THEN 'skipped' WHEN error_code IS NOT NULL THEN 'blocked'
                WHEN n_findings = 0 THEN 'compliant' ELSE 'violated' END AS status FROM toolrows""",
    "testst": """
        SELECT o_orderkey AS ord, 't.py::test_' || o_orderkey AS source_path,
            CASE o_orderstatus WHEN 'F' THEN 'covered' WHEN 'O' THEN 'violated' ELSE 'unclear' END AS status,
            CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'skipped' END AS outcome,
            'REQ-P-' || o_custkey AS covers
        FROM exitcode WHERE code < 2 AND o_orderpriority NOT LIKE '1%'
        UNION ALL SELECT o_orderkey, 'f' || o_orderkey, 'violated', 'error', '' FROM exitcode
            WHERE code < 2 AND o_orderpriority NOT LIKE '1%'
        UNION ALL SELECT o_orderkey, 'f' || o_orderkey, CASE code WHEN 0 THEN 'covered' ELSE 'violated' END,
            CASE code WHEN 0 THEN 'passed' ELSE 'failed' END, '' FROM exitcode WHERE code < 2 AND o_orderpriority LIKE '1%'""",
    "idx": """
        SELECT c_nationkey AS project_id, 'task' AS source_type, 'docs/task_list.json' AS source_path,
            'N' || c_nationkey || ',S' || c_mktsegment AS covers,
            CASE WHEN c_acctbal < 0 THEN 'missing' WHEN c_acctbal < 3000 THEN 'partial' WHEN c_acctbal < 9000 THEN 'covered'
                ELSE 'unclear' END AS status, 1 AS rank, c_custkey AS ord, false AS carried_over
        FROM customer WHERE c_mktsegment <> 'MACHINERY'
        UNION ALL SELECT op.project_id, 'claim', 'claims/current.json', CASE WHEN c.c_mktsegment = 'MACHINERY' THEN ''
            ELSE 'N' || c.c_nationkey || ',S' || c.c_mktsegment END, op.o_orderstatus, 2, op.o_orderkey, false
        FROM op JOIN customer c ON c.c_custkey = op.o_custkey
        UNION ALL SELECT p_size, CASE WHEN p_type = 'ECONOMY' THEN 'test' ELSE 'tool' END, 'src/' || p_partkey || '.py', '',
            CASE WHEN p_size * 3 >= 80 THEN 'compliant' ELSE 'violated' END, 3, p_partkey, false FROM part""",
    "oldidx": """
        SELECT c.c_nationkey AS project_id, CASE event_type WHEN 'error' THEN 'test' WHEN 'view' THEN 'tool' ELSE 'claim' END AS source_type,
            'src/' || json_extract_string(props, '$.k') || '.py' AS source_path, event_id, value > 10 AS cov
        FROM events e JOIN customer c ON c.c_custkey = e.user_id""",
    "allidx": """
        SELECT * FROM idx UNION ALL
        SELECT project_id, source_type, source_path, '', 'covered', 4, event_id, true FROM oldidx o
        WHERE (source_type = 'test' OR (source_type = 'tool' AND cov)) AND NOT EXISTS (
            SELECT 1 FROM idx i WHERE i.source_type = o.source_type AND i.source_path = o.source_path)""",
}

_SQL: dict[str, str] = {
    "requirement_coverage": """
        SELECT project_id, req_id, priority, status, n_evidence, status = 'missing' AND priority = 'must' AS is_gap FROM req""",
    "requirement_coverage_after_changes": """
        WITH line AS (
            SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 THEN 'unclear' WHEN l_returnflag = 'A' THEN 'covered'
                WHEN l_returnflag = 'N' THEN 'partial' ELSE 'unclear' END AS status FROM lineitem WHERE l_orderkey % 7 <> 0),
        n AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (status = 'unclear') AS u, count(*) FILTER (status = 'covered') AS c FROM line GROUP BY 1),
        r AS (SELECT c_nationkey AS project_id, o_orderkey AS req_id, coalesce(n, 0) AS n_evidence, left(o_orderpriority, 1) AS level, u, c
            FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN n ON l_orderkey = o_orderkey),
        s AS (SELECT *, CASE WHEN n_evidence = 0 THEN 'missing' WHEN level = '4' OR u > 0 THEN 'unclear' WHEN c = n_evidence THEN 'covered' ELSE 'partial' END AS status FROM r)
        SELECT project_id, req_id, status, n_evidence, status = 'missing' AND level IN ('1', '2') AS is_gap FROM s""",
    "decision_log": """
        SELECT CAST(user_id % 20 AS VARCHAR) AS project_id, CASE WHEN event_type <> 'error' THEN row_number() OVER (
                PARTITION BY user_id % 20, event_type = 'error'
                ORDER BY event_type <> 'purchase', ts, event_type, CAST(event_id AS VARCHAR)) END AS decision_id, CAST(event_id AS VARCHAR) AS "targetId"
        FROM events""",
    "published_report": """
        WITH run AS (SELECT * FROM (VALUES ('RUN-1', 'RUN-1', 0), ('last', 'RUN-2', 2000)) v(asked, run_id, bound)),
        n AS (SELECT asked, c_nationkey, count(*) AS n FROM customer JOIN run ON c_acctbal < bound GROUP BY ALL)
        SELECT run.asked, run_id, n_nationkey AS project_id, CASE WHEN coalesce(n, 0) > 2 THEN 'blocked' ELSE 'pass' END AS gate_decision, coalesce(n, 0) AS n_gaps
        FROM run CROSS JOIN nation LEFT JOIN n ON n.asked = run.asked AND c_nationkey = n_nationkey""",
    "requirement_evidence": """
        SELECT l_orderkey AS req_id, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS evidence_id
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority LIKE '1%'""",
    "ac_coverage": """
        SELECT project_id, ac_id, status, n_evidence,
            status = 'missing' AND priority = 'must' AND o_totalprice >= 250000 AS is_gap FROM crit""",
    "task_claim_coverage": """
        SELECT c.c_nationkey AS project_id, 'K' || c.c_custkey AS task_id,
            CASE WHEN k.n IS NULL THEN 'no_claim_for_task' WHEN k.has_tests THEN 'test_failed' ELSE 'no_tests_declared' END AS reason
        FROM customer c LEFT JOIN (
            SELECT related_task, count(*) AS n, bool_or(has_tests) AS has_tests, bool_or(passing) AS passing FROM (
                SELECT CASE WHEN cl.o_orderdate >= TIMESTAMP '2001-01-01' THEN cl.related_task ELSE 'closed' END AS related_task, cl.claim_id, count(t.path) > 0 AS has_tests,
                    coalesce(bool_or(r.status = 'covered'), false) AS passing
                FROM claim cl LEFT JOIN testref t USING (claim_id) LEFT JOIN (
                    SELECT source_path AS path, max_by(status, ord) AS status FROM pev WHERE source_type = 'test' GROUP BY 1) r
                    ON r.path = t.path
                GROUP BY 1, 2) GROUP BY 1) k ON k.related_task = 'K' || c.c_custkey
        WHERE c.c_mktsegment IN ('BUILDING', 'AUTOMOBILE') AND NOT coalesce(k.passing, false)""",
    "coverage_summary": """
        SELECT project_id, round_even(sum(num_statements * percent_covered / 100) / sum(num_statements) * 100, 1) AS aggregate_percent,
            CAST(sum(num_statements) AS BIGINT) AS total_statements,
            CAST(floor(round(sum(num_statements * percent_covered / 100), 6)) AS BIGINT) AS total_covered, count(*) AS file_count
        FROM covfile GROUP BY 1""",
    "coverage_violations": "SELECT project_id, path, percent_covered FROM covfile WHERE percent_covered < 80",
    "worst_coverage": """
        SELECT project_id, CAST(row_number() OVER w AS INT) AS position, path, percent_covered FROM covfile
        WHERE percent_covered < 80 WINDOW w AS (PARTITION BY project_id ORDER BY percent_covered, path)
        QUALIFY row_number() OVER w <= 5""",
    "claim_findings": "SELECT claim_id, category, ref, detail, occurrences FROM find",
    "claim_verdict": """
        SELECT c.claim_id, c.claimed_status, CASE WHEN f.failed THEN 'violated' WHEN f.own THEN 'blocked'
            WHEN f.other THEN 'low_confidence' ELSE c.claimed_status END AS status, coalesce(f.n, 0) AS n_mismatches
        FROM claim c LEFT JOIN (
            SELECT claim_id, bool_or(category IN ('violated_evidence', 'failed_tests')) AS failed,
                bool_or(category = 'self_referential_claim') AS own,
                bool_or(category NOT IN ('violated_evidence', 'failed_tests', 'self_referential_claim', 'conflicting_statuses')) AS other,
                CAST(sum(occurrences) AS BIGINT) AS n FROM find GROUP BY 1) f USING (claim_id)""",
    "conflicting_references": """
        SELECT ref, string_agg(DISTINCT status, ',' ORDER BY status) AS statuses,
            count(*) FILTER (status IN ('covered', 'compliant')) AS n_supporting
        FROM (SELECT source_path AS ref, status FROM pev) GROUP BY 1 HAVING count(DISTINCT status) > 1""",
    "claim_support": """
        SELECT DISTINCT x.claim_id, x.ref, k.n_supporting FROM external x JOIN keysum k USING (ref) WHERE k.n_supporting > 0""",
    "hash_invalidation": """
        SELECT d.source AS claim_id, 'doc/' || d.doc_id AS path,
            CASE WHEN d.lang = 'fr' THEN 'deleted' WHEN l.doc_id IS NULL THEN 'no_record' ELSE 'changed' END AS change
        FROM documents d LEFT JOIN labels l USING (doc_id)
        WHERE d.lang = 'fr' OR l.doc_id IS NULL
            OR sha256(d.text) <> sha256(CASE WHEN l.quality = 1 THEN d.text ELSE upper(d.text) END)""",
    "claims_to_reverify": """
        SELECT source AS claim_id, 'needs_reverification' AS status, count(*) AS n_files,
            count(*) FILTER (lang = 'fr') AS n_deleted, count(*) FILTER (lang <> 'fr' AND l.doc_id IS NULL) AS n_no_record,
            count(*) FILTER (lang <> 'fr' AND l.doc_id IS NOT NULL) AS n_changed
        FROM documents d LEFT JOIN labels l USING (doc_id) WHERE lang = 'fr' OR l.doc_id IS NULL OR lang <> 'en' GROUP BY 1""",
    "dangling_refs": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""",
    "claim_task_integrity": """
        SELECT claim_id, related_task FROM claim WHERE related_task NOT IN (SELECT task_id FROM tev)""",
    "task_reference_problems": """
        SELECT o_orderkey AS task_id, 'related_modules' AS link, 'K' || o_custkey AS target FROM orders
        WHERE 'K' || o_custkey NOT IN (SELECT task_id FROM tev)
        UNION ALL SELECT o_orderkey, 'related_requirements', 'D' || d FROM (
            SELECT o_orderkey, day(o_orderdate) AS d FROM orders UNION ALL SELECT o_orderkey, month(o_orderdate) FROM orders)
        WHERE d NOT IN (SELECT p_size FROM part WHERE p_size <= 25)""",
    "missing_parents": """
        SELECT 'K' || c_custkey AS task_id, 'AC-P-' || c_nationkey || '-' || c_custkey AS ac_id, 'REQ-P-' || c_nationkey AS parent_req_id
        FROM customer WHERE c_acctbal <= 3000 AND c_nationkey <> 0 AND c_mktsegment <> 'BUILDING'""",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "mapping_both_ways": """
        WITH r AS (SELECT p_partkey AS id, p_size FROM part WHERE p_size > 5),
        k AS (SELECT l_partkey AS id, bool_or(l_linestatus = 'F' AND l_returnflag = 'R' AND l_discount >= 0.08) AS top FROM lineitem GROUP BY 1)
        SELECT 'dead_link' AS finding, id AS req_id FROM k WHERE id NOT IN (SELECT id FROM r)
        UNION ALL SELECT CASE WHEN p_size <= 20 THEN 'must_uncovered' ELSE 'should_uncovered' END, id FROM r
            WHERE p_size <= 40 AND id NOT IN (SELECT id FROM k WHERE top)""",
    "scope_partition": """
        SELECT project_id, count(*) FILTER (in_scope) AS n_in_scope, count(*) FILTER (NOT in_scope) AS n_out_of_scope
        FROM globbed GROUP BY 1""",
    "scope_by_project": """
        SELECT project_id, path, (path GLOB 'src/' || split_part(project_id, '#', 2) || '*'
                OR path GLOB '*/src/' || split_part(project_id, '#', 2) || '*')
            AND NOT (path GLOB '[!0-4]*9.py' OR path GLOB '*/[!0-4]*9.py') AS in_scope FROM globbed""",
    "unclaimed_files": """
        SELECT path FROM changed JOIN globbed USING (path) WHERE in_scope
            AND path NOT IN (
            SELECT path FROM fref JOIN claim USING (claim_id) WHERE NOT has_fragment AND o_orderdate >= TIMESTAMP '2001-01-01')""",
    "ghost_files": """
        SELECT path FROM changed WHERE path <> 'src/11.py' AND path NOT LIKE 'src/5%' AND path NOT IN (
            SELECT f.path FROM fref f JOIN staged s ON f.claim_id = 'C' || s.o_orderkey
            WHERE f.kind = 'code' AND NOT f.has_fragment AND s.o_totalprice > 480000 AND NOT EXISTS (
                SELECT 1 FROM head h WHERE h.o_orderkey = s.o_orderkey AND h.o_orderstatus = s.o_orderstatus))""",
    "reverse_coverage": """
        SELECT DISTINCT f.path, c.related_task AS task_id, CASE WHEN t.task_id IS NULL THEN 'block' ELSE 'warn' END AS effect
        FROM fref f JOIN changed USING (path) JOIN claim c USING (claim_id) LEFT JOIN tev t ON t.task_id = c.related_task
        LEFT JOIN customer m ON 'K' || m.c_custkey = c.related_task AND m.c_acctbal < -500
        WHERE f.kind = 'code' AND (t.task_id IS NULL OR (m.c_custkey IS NULL AND t.status <> 'covered'))""",
    "fresh_refs": """
        WITH a AS (SELECT DISTINCT p_size AS project_id, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'X' END || substr(CAST(p_partkey AS VARCHAR), 1, 1) AS ac_id
                   FROM part WHERE p_size % 2 = 0)
        SELECT project_id, o_orderkey AS task_id, substr(o_orderpriority, 1, 1) AS ac_id,
            CASE WHEN project_id IN (SELECT project_id FROM a) THEN 'criterion_not_in_document' ELSE 'document_not_staged' END AS reason
        FROM op WHERE NOT EXISTS (
            SELECT 1 FROM a WHERE a.project_id = op.project_id AND a.ac_id = substr(o_orderpriority, 1, 1))""",
    "uncovered_files": """
        SELECT 'src/' || p_partkey || '.py' AS path FROM part
        WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linenumber = 3)""",
    "affected_items": "SELECT item_type, item_id FROM aff",
    "stale_gaps": """
        SELECT item_type, item_type <> 'task' AND NOT EXISTS (
            SELECT 1 FROM aff a WHERE a.item_type = g.item_type AND a.item_id = g.item_id) AS stale, count(*) AS n
        FROM igap g GROUP BY 1, 2""",
    "stale_risks": """
        SELECT project_id, count(*) FILTER (o_orderstatus = 'P' AND n_regionkey <= 2 AND o_totalprice <= 400000) AS n_stale, count(*) AS n_total
        FROM op JOIN nation ON n_nationkey = project_id GROUP BY 1""",
    "current_findings": """
        SELECT g.item_id AS claim_id, CASE WHEN g.item_id IN (SELECT item_id FROM aff) THEN 'current' ELSE 'pre_existing' END AS change_scope
        FROM igap g WHERE g.item_type = 'claim'""",
    "claim_delta": """
        SELECT s.o_orderkey AS claim_id, s.o_orderstatus FROM staged s WHERE NOT EXISTS (
            SELECT 1 FROM head h WHERE h.o_orderkey = s.o_orderkey AND h.o_orderstatus = s.o_orderstatus)""",
    "keyed_delta": """
        SELECT s.o_orderkey AS claim_id, CASE WHEN h.o_orderkey IS NULL THEN 'new' ELSE 'modified' END AS change
        FROM staged s LEFT JOIN head h USING (o_orderkey) WHERE h.o_orderkey IS NULL OR h.o_orderstatus <> s.o_orderstatus""",
    "rule_diff": """
        SELECT p_brand AS section, p_partkey AS rule_id, CASE WHEN p_size > 40 THEN 'add' WHEN p_size < 10 THEN 'delete'
            ELSE 'modify' END AS action, p_brand || '.' || p_partkey AS path
        FROM part WHERE p_size > 40 OR p_size < 10 OR p_retailprice > 980""",
    "document_diff": """
        SELECT c_custkey, 'project.segment' AS path, CAST(NULL AS VARCHAR) AS rule_id, 'modify' AS action FROM customer WHERE c_nationkey < 5
        UNION ALL SELECT c_custkey, 'rules.R1', 'R1', 'modify' FROM customer WHERE floor(c_acctbal) <> floor(least(c_acctbal, 9000))
        UNION ALL SELECT c_custkey, 'rules.R3', 'R3', 'delete' FROM customer WHERE c_acctbal < 0
        UNION ALL SELECT c_custkey, 'rules.R4', 'R4', 'add' FROM customer WHERE c_acctbal < 0""",
    "baseline_drift": """
        WITH d AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
        SELECT c_custkey AS project_id, drift, CASE WHEN drift = 'changed' THEN n ELSE 0 END AS n_changes,
            c_mktsegment <> 'MACHINERY' AS requirements_drift
        FROM (SELECT c_custkey, c_mktsegment, coalesce(n, 0) AS n,
                CASE WHEN c_acctbal <= 5000 THEN 'none' WHEN c_nationkey = 3 THEN 'no_metadata' WHEN c_nationkey = 4 THEN 'no_baseline'
                    WHEN n IS NULL THEN 'format_only' ELSE 'changed' END AS drift
              FROM customer LEFT JOIN d ON o_custkey = c_custkey)""",
    "accepted_rules": """
        SELECT rule_id, CASE WHEN accepted_by IS NULL THEN r.who ELSE accepted_by END AS accepted_by,
            CASE WHEN accepted_by IS NULL THEN r.at ELSE accepted_at END AS accepted_at
        FROM rule LEFT JOIN (
            SELECT 'RULE-' || l_partkey AS rule_id, min(l_shipdate) AS at, arg_min('S' || l_suppkey, {'a': l_shipdate, 'b': 'S' || l_suppkey}) AS who
            FROM lineitem GROUP BY 1) r USING (rule_id) WHERE severity = 'must'""",
    "unknown_acceptances": """
        SELECT l_orderkey, 'RULE-' || l_partkey AS rule_id FROM lineitem
        WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""",
    "evidence_index": """
        SELECT project_id, 'EVIDENCE-' || project_id || '-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS evidence_id,
            source_type, source_path, covers, status, carried_over
        FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY rank, ord) AS n FROM allidx)""",
    "incremental_reuse": """
        SELECT p_brand AS project_id, 'src/' || p_partkey || '.py#L1' AS source_path, 'old' AS source_type FROM part WHERE p_size < 20
        UNION ALL SELECT p_brand, 'src/' || p_partkey || '.py', 'new' FROM part WHERE p_size >= 20""",
    "gap_dedup": """
        SELECT o_custkey AS item_id, 'task' AS item_type, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 2 END AS source_rank, o_orderkey AS ord
        FROM orders WHERE o_orderstatus IN ('F', 'O')
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderkey) = 1""",
    "risk_ids": """
        WITH u AS (
            SELECT project_id, 'C' || o_orderkey AS target_id, 1 AS rank, o_orderkey AS ord FROM op
            UNION ALL SELECT c_nationkey, 'K' || c_custkey, 2, c_custkey FROM customer),
        m AS (SELECT s_nationkey AS project_id, max(s_suppkey) FILTER (s_acctbal >= 0) AS last FROM supplier GROUP BY 1),
        n AS (SELECT u.*, coalesce(m.last, 0) + row_number() OVER (PARTITION BY project_id ORDER BY rank, ord) AS n FROM u LEFT JOIN m USING (project_id))
        SELECT project_id, target_id, 'RISK-P-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS risk_id FROM n""",
    "rule_first_violation": """
        SELECT 'RULE-' || l_suppkey AS target_id, 'Architecture rule RULE-' || l_suppkey || ' is violated: ' || m AS description, 'must' AS severity
        FROM (SELECT l_suppkey, l_orderkey || '/' || l_linenumber || '/' || l_partkey AS m, row_number() OVER (
                PARTITION BY l_suppkey ORDER BY l_orderkey, l_orderkey || '/' || l_linenumber || '/' || l_partkey) AS n
              FROM lineitem WHERE l_returnflag = 'R') WHERE n = 1""",
    "risks_from_gaps": """
        SELECT project_id, severity, 'EVIDENCE-P-999' AS evidence_id,
            'RISK-P-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS risk_id,
            CASE item_type WHEN 'requirement' THEN 'Requirement ' || item_id || ' has no related task.'
                WHEN 'ac' THEN 'Acceptance criterion ' || item_id || ' has no passing test evidence.'
                ELSE 'Task ' || item_id || ' has no claim or an incomplete one.' END AS description
        FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY ord, source_rank) AS n FROM gap)""",
    "enriched_risks": """
        SELECT category AS risk_category, CASE category WHEN 'conflicting_statuses' THEN 'should' ELSE 'must' END AS severity,
            count(*) AS n, true AS has_impact, max(CASE category
                WHEN 'self_referential_claim' THEN 'Claim ' || claim_id || ' is done on self-referential evidence alone.'
                WHEN 'conflicting_statuses' THEN 'Evidence ' || ref || ' of claim ' || claim_id || ' disagrees with itself: ' || detail || '.'
                WHEN 'non_existent_evidence' THEN 'Evidence ' || ref || ' of claim ' || claim_id || ' cannot be found.'
                ELSE 'Evidence ' || ref || ' of claim ' || claim_id || ' is ''' || detail || '''.' END) AS last_description
        FROM refind GROUP BY 1, 2""",
    "urgent_actions": """
        SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY urgency DESC, rank, ord) AS position, priority, type, item_id, urgency
        FROM actions""",
    "action_counts": """
        SELECT project_id, count(*) FILTER (priority = 'HIGH') AS n_high, CAST(0 AS BIGINT) AS n_medium,
            count(*) FILTER (priority = 'LOW') AS n_low, count(*) FILTER (urgency >= 80) AS n_current,
            count(*) FILTER (urgency BETWEEN 20 AND 79) AS n_pre_existing, CAST(0 AS BIGINT) AS n_pending_human
        FROM actions GROUP BY 1""",
    "decisions_applied": """
        SELECT project_id, count(DISTINCT target) FILTER (action = 'accept_risk') AS n_accepted,
            count(DISTINCT target) FILTER (action = 'mark_complete') AS n_completed,
            count(DISTINCT action || target) AS human_decisions_applied
        FROM pdec WHERE action IN ('accept_risk', 'mark_complete') GROUP BY 1""",
    "pending_decisions": """
        SELECT project_id, 'uncovered_ac' AS category, CAST(ac_id AS VARCHAR) AS target_id, 'must' AS severity FROM crit
        WHERE status = 'missing' AND priority = 'must' AND o_totalprice >= 250000 AND NOT EXISTS (
            SELECT 1 FROM pdec d WHERE d.project_id = crit.project_id AND d.target = CAST(ac_id AS VARCHAR))
        UNION ALL SELECT project_id, 'stale_debt', 'C' || o_orderkey, 'should' FROM op WHERE o_orderstatus = 'P' AND o_totalprice < 100000
        UNION ALL SELECT c_nationkey, 'accepted_rule', 'K' || c_custkey, 'should' FROM customer WHERE c_acctbal < 0""",
    "decision_keys_compat": """
        SELECT 'DEC-' || substr(CASE WHEN length(x) < 4 THEN lpad(x, 4, '0') ELSE x END, 1, 4) AS decision_key, count(*) AS n_targets
        FROM (SELECT hex(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split('uncovered_ac:AC-P-' || c_custkey, ''),
            lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 4294967296)) AS x FROM customer) GROUP BY 1""",
    "related_code": """
        SELECT ac_id, CAST(position AS INT) AS position, path, claim_id FROM (
            SELECT 'AC-' || c_nationkey AS ac_id, 'src/' || l_partkey || '.py' AS path, 'C' || l_orderkey AS claim_id,
                row_number() OVER (PARTITION BY c_nationkey ORDER BY l_orderkey, l_linenumber, 'src/' || l_partkey || '.py') AS position
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_returnflag <> 'R')
        WHERE position <= 3""",
    "titled_gaps": """
        SELECT l_orderkey, l_partkey AS ac_id, coalesce(p_name, '') AS ac_title FROM lineitem
        LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10""",
    "gate_by_account": "SELECT * FROM gate",
    "gate_reasons": """
        SELECT g.project_id, row_number() OVER (PARTITION BY g.project_id ORDER BY rank, ord) AS seq, code, item_id, effect
        FROM gfx g JOIN gproj p USING (project_id) WHERE p.status <> 'draft'
        UNION ALL SELECT project_id, 1, CASE gate_decision WHEN 'pass' THEN 'all_passed' ELSE 'draft' END, NULL, 'note' FROM gate
        WHERE gate_decision = 'draft_approved' OR (gate_decision = 'pass' AND n_noted = 0)""",
    "gate_by_project": """
        WITH g AS (
            SELECT gap.project_id, CASE item_type WHEN 'ac' THEN 'block' ELSE 'fail' END AS effect,
                EXISTS (SELECT 1 FROM pdec d WHERE d.action = 'mark_complete' AND d.project_id = gap.project_id AND d.target = gap.item_id) AS resolved
            FROM gap
            UNION ALL SELECT op.project_id, CASE category WHEN 'conflicting_statuses' THEN 'fail' ELSE 'block' END, false
            FROM refind JOIN op ON refind.claim_id = 'C' || op.o_orderkey),
        f AS (SELECT project_id, resolved, CASE WHEN resolved THEN 'note' ELSE effect END AS effect FROM g),
        t AS (SELECT project_id, count(*) FILTER (effect = 'block') AS b, count(*) FILTER (effect = 'fail') AS f,
                count(*) FILTER (effect = 'note') AS n, count(*) FILTER (resolved) AS r FROM f GROUP BY 1),
        d AS (SELECT project_id, count(DISTINCT action || target) AS n FROM pdec WHERE action IN ('accept_risk', 'mark_complete') GROUP BY 1)
        SELECT n_nationkey AS project_id, CASE WHEN coalesce(t.b, 0) > 0 THEN 'blocked' WHEN coalesce(t.f, 0) > 0 THEN 'fail' ELSE 'pass' END AS gate_decision,
            coalesce(t.b, 0) AS n_blocking, coalesce(t.f, 0) AS n_failing, coalesce(t.n, 0) AS n_noted, coalesce(t.r, 0) AS n_resolved,
            coalesce(d.n, 0) AS human_decisions_applied
        FROM nation LEFT JOIN t ON t.project_id = n_nationkey LEFT JOIN d ON d.project_id = n_nationkey""",
    "run_flags": """
        WITH o AS (
            SELECT o_custkey AS project_id, count(*) FILTER (o_orderstatus = 'F') AS gaps, count(*) AS risks,
                bool_or(o_orderstatus = 'F' AND o_totalprice > 300000) AS cov, bool_or(o_orderpriority LIKE '1%') AS must,
                bool_or(o_totalprice < 5000) AS low, bool_or(o_totalprice > 495000) AS unclear,
                bool_or(o_totalprice < 2000) AS viol, bool_or(o_orderpriority LIKE '5%') AS unc FROM orders GROUP BY 1)
        SELECT project_id, gate_decision = 'blocked' AS gate_blocked, gate_decision = 'fail' AS gate_fail,
            coalesce(must, false) AS has_must_risks, coalesce(gaps > 5 OR risks > 10, false) AS high_gap_risk_count,
            coalesce(low, false) AS has_low_confidence, coalesce(cov, false) AS has_coverage_gaps,
            coalesce(unclear, false) AS has_unclear_constraints, coalesce(viol, false) AS has_violations,
            coalesce(unc, false) AS has_uncovered_evolution_scope
        FROM gate LEFT JOIN o USING (project_id)""",
    "boundary_violations": """
        SELECT from_module, to_module, 'forbidden' AS violation, n_lines FROM bound WHERE forbidden
        UNION ALL SELECT from_module, to_module, 'not_allowed', n_lines FROM bound WHERE outside""",
    "module_status": """
        SELECT n_nationkey AS rule_id, CASE WHEN EXISTS (
            SELECT 1 FROM bound WHERE forbidden AND n_lines > 100 AND from_module = n_nationkey) THEN 'violated' ELSE 'compliant' END AS status
        FROM nation""",
    "banned_dependencies": """
        SELECT violation, from_module, imported_module, count(*) AS n FROM (
            SELECT 'runtime' AS violation, flag AS from_module, imported_module FROM pedge
            WHERE flag <> 'A' AND (contains(imported_module, 'widget') OR contains(imported_module, 'ring'))
            UNION ALL SELECT 'adapter', flag, imported_module FROM pedge WHERE flag <> 'A' AND to_module = 'Brand#1') GROUP BY ALL""",
    "banned_packages": """
        SELECT file_path, lineno, l_partkey, split_part(imported_module, '.', 1) AS root_package FROM pedge
        WHERE split_part(imported_module, '.', 1) IN ('red', 'hot')""",
    "external_resources": r"""
        SELECT page_id, len(u) AS n_urls, array_to_string(u, ' ') AS urls FROM (
            SELECT page_id, regexp_extract_all(html, '(?i)(?:href|src)\s*=\s*["'']/[^"''/][^"'']*["'']') AS u FROM pages)""",
    "missing_inputs": """
        SELECT c_custkey AS project_id, k AS file_key FROM customer, (VALUES ('prd', 'F'), ('architecture_constraints', 'O'), ('task_list', 'P')) v(k, s)
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = s AND o_totalprice > 100000)""",
    "evidence_for_paths": """
        WITH e AS (SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'src/' || p_partkey || '.py' WHEN p_size > 20 THEN 'lib/' || p_partkey || '.pyi'
                ELSE 'other/repo/src/' || p_partkey || '.py' END AS p FROM part),
        c AS (SELECT '/repo/src/' || c_custkey || '.py' AS path, 'repo/src/' || c_custkey || '.py' AS n FROM customer)
        SELECT path, coalesce('E' || min(p_partkey), 'EVIDENCE-P-999') AS evidence_id
        FROM c LEFT JOIN e ON ends_with(n, p) OR ends_with(p, n) GROUP BY 1""",
    "rule_status": """
        SELECT project_id, rule_id, section, CASE WHEN method = 'manual' AND accepted_by IS NOT NULL THEN 'accepted' WHEN method = 'manual' THEN 'unclear'
                ELSE 'unclear_blocking' END AS classification,
            coalesce(method = 'manual' AND accepted_by IS NOT NULL
                AND floor(date_diff('second', accepted_at, TIMESTAMP '2001-02-15 12:00:00') / 86400) > 30, false) AS stale_acceptance
        FROM rule WHERE severity = 'must' AND section <> 'other_section' AND rule_id NOT IN (
            SELECT 'RULE-' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1)""",
    "must_rollup": """
        WITH s AS (SELECT p_brand AS project_id, bool_or(p_type = 'PROMO' AND p_size = 7 AND p_retailprice < 980) AS v,
                bool_or(p_type = 'SMALL' AND p_size = 9 AND p_retailprice < 980) AS u FROM part GROUP BY 1)
        SELECT project_id, 'GATE-P-006' AS rule_id, CASE WHEN v THEN 'violated' ELSE 'compliant' END AS status, 'must' AS severity FROM s
        UNION ALL SELECT project_id, 'GATE-P-007', CASE WHEN u THEN 'unclear' ELSE 'compliant' END, 'must' FROM s
        UNION ALL SELECT project_id, 'FORBID-P-007', 'compliant', 'must' FROM s""",
    "import_edges": """
        SELECT 'f' || c_custkey AS file_path, 'os' AS imported_module, 1 AS lineno FROM customer
        UNION ALL SELECT 'f' || c_custkey, 'pkg.' || c_mktsegment, 1 FROM customer
        UNION ALL SELECT 'f' || c_custkey, 'pkg.n' || c_nationkey, 2 FROM customer
        UNION ALL SELECT 'f' || c_custkey, 'sub', 4 FROM customer
        UNION ALL SELECT 'f' || c_custkey, CASE m WHEN 'more' THEN 'more.' || c_nationkey ELSE m END, n FROM customer,
            (VALUES ('late', 11), ('more', 11), ('after', 14), ('lists', 15), ('last', 20), ('x.y', 20)) v(m, n)""",
    "id_checks": r"""
        WITH v AS (SELECT *, regexp_matches(id, '^((AC|DOD)-P-\d+-\d+|(REQ|TASK|MOD|GATE|FORBID|PRINCIPLE|PHASE|EVIDENCE|RISK|CLAIM)-P-\d+|PROJECT-P)$') AS ok FROM idtext)
        SELECT c_custkey, CASE WHEN ok THEN split_part(id, '-', 1) END AS id_type,
            CASE WHEN trim(id) = '' THEN 'empty' WHEN ok THEN NULL WHEN id LIKE 'REQ-%' THEN 'malformed' ELSE 'unknown' END AS problem,
            CASE WHEN id LIKE 'AC-%' THEN regexp_replace(id, '^AC-(.+)-(\d+)-(\d+)$', 'REQ-\1-\2') END AS parent FROM v""",
    "covers_from_text": """
        SELECT o_orderkey, 'AC-P-' || o_custkey || '-1,REQ-P-' || o_orderkey AS covers FROM orders""",
    "constraint_checks": """
        SELECT CAST(o_orderkey AS VARCHAR) AS key, 'orders[' || o_orderkey || ']' || suffix AS field_path, rule, value FROM (
            SELECT o_orderkey, '.status' AS suffix, 'required' AS rule, CAST(NULL AS VARCHAR) AS value FROM orders WHERE o_orderstatus = 'P'
            UNION ALL SELECT o_orderkey, '.priority', 'enum', o_orderpriority FROM orders WHERE o_orderpriority = '5-LOW'
            UNION ALL SELECT o_orderkey, '.priority', 'pattern', o_orderpriority FROM orders WHERE o_orderpriority LIKE '4%'
            UNION ALL SELECT o_orderkey, '.priority', 'max_length', o_orderpriority FROM orders WHERE length(o_orderpriority) > 10
            UNION ALL SELECT o_orderkey, '.price', 'minimum', CAST(o_totalprice AS VARCHAR) FROM orders WHERE o_totalprice < 5000
            UNION ALL SELECT o_orderkey, '.parts[1]', 'item_pattern', 'NOT SPECIFIED' FROM orders WHERE o_orderpriority LIKE '4%')""",
    "claim_problems": """
        SELECT item_id, problem FROM (
            SELECT CASE o_orderstatus WHEN 'P' THEN 'CLAIM-Q-' ELSE 'CLAIM-P-' END || o_orderkey AS item_id, * FROM orders) o
        JOIN (VALUES ('invalid_id'), ('invalid_task_id'), ('no_external_evidence')) v(problem)
            ON (problem = 'invalid_id' AND o_orderstatus = 'P') OR (problem = 'invalid_task_id' AND o_orderpriority LIKE '5%')
            OR (problem = 'no_external_evidence' AND o_totalprice > 250000 AND o_orderpriority LIKE '1%' AND o_orderstatus <> 'P')
        WHERE item_id NOT LIKE '%-9999'""",
    "task_problems": """
        SELECT 'TASK-P-' || c_custkey AS item_id, problem FROM customer JOIN (VALUES ('isolated'), ('orphan')) v(problem)
            ON (problem = 'isolated' AND (c_acctbal < 0 OR c_nationkey < 12))
            OR (problem = 'orphan' AND c_mktsegment = 'BUILDING' AND c_acctbal <= 5000)
        WHERE c_custkey <> 9999""",
    "test_scenarios": """
        SELECT scenario, count(*) AS n FROM orders JOIN (VALUES ('invalid_input'), ('empty_input'), ('valid_input'), ('default')) v(scenario)
            ON (scenario = 'invalid_input' AND o_orderstatus = 'O') OR (scenario = 'empty_input' AND o_totalprice < 50000)
            OR (scenario = 'valid_input' AND o_orderstatus = 'F')
            OR (scenario = 'default' AND o_orderstatus = 'P' AND o_totalprice >= 50000) GROUP BY 1""",
    "health_report": """
        WITH i AS (
            SELECT 'evidence_refs_integrity' AS "check" FROM evref WHERE ref NOT IN (SELECT evidence_id FROM pev)
            UNION ALL SELECT 'file_refs_integrity' FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)
            UNION ALL SELECT 'requirement_mapping' FROM orders WHERE 'K' || o_custkey NOT IN (SELECT task_id FROM tev)
            UNION ALL SELECT 'ac_mapping' FROM orders WHERE substr(o_orderpriority, 3) NOT IN (
                SELECT substr(o_orderpriority, 3) FROM orders WHERE o_totalprice > 499000)
            UNION ALL SELECT 'machine_rule_coverage' FROM rule WHERE method = 'machine' AND section <> 'other_section' AND p_type <> 'SMALL'
                AND p_size NOT IN (SELECT p_size FROM part WHERE p_size <= 30))
        SELECT "check", count(*) AS n_issues FROM i GROUP BY ROLLUP ("check")""",
    "sections_from_documents": """
        SELECT c_custkey AS doc_id, 'REQ-P-' || c_nationkey AS req_id, c_name AS title,
            CASE WHEN c_acctbal < 0 THEN 'could' WHEN c_mktsegment = 'MACHINERY' THEN 'unclear' ELSE 'must' END AS priority,
            CASE WHEN c_mktsegment = 'BUILDING' THEN 'quality_evolution' ELSE 'functional' END AS category,
            'AC-P-' || c_nationkey || '-' || c_custkey AS ac_id, c_acctbal > 2000 AS is_testing_required FROM customer""",
    "front_matter": """
        SELECT c_custkey AS doc_id, CASE WHEN c_acctbal < -500 THEN 'draft' ELSE 'active' END AS status, c_name AS project_name, 'P' AS id_prefix
        FROM customer""",
    "test_report_scan": "SELECT ord, source_path, status, outcome, covers FROM testst",
    "tool_report_scan": "SELECT ord, tool_category, source_path, status, error_code, n_findings FROM toolst",
    "evidence_run_summary": """
        SELECT 1 AS project_id, count(*) AS n_executed, count(error_code) AS n_blocked, count(*) FILTER (status = 'skipped') AS n_skipped FROM (
            SELECT status, error_code FROM toolst WHERE tool_category <> 'security'
            UNION ALL SELECT status, NULL FROM testst
            UNION ALL SELECT CASE code WHEN 2 THEN 'skipped' ELSE 'blocked' END, 'x' FROM exitcode WHERE code >= 2)""",
    "coverage_report_scan": """
        SELECT c_custkey AS ord, 'src/' || c_custkey || '.py' AS source_path,
            CASE WHEN c_nationkey + 0.5 >= 15 THEN 'compliant' ELSE 'violated' END AS status, CAST(c_nationkey + 0.5 AS DOUBLE) AS percent_covered,
            CAST(10 AS BIGINT) AS num_statements FROM customer
        UNION ALL SELECT c_custkey, 'src/c.py', 'compliant', 80.0::DOUBLE, 0 FROM customer""",
    "tool_work_list": """
        SELECT path, CASE WHEN bool_or(kind = 'test') THEN 'test' ELSE 'source' END AS path_type FROM fref JOIN changed USING (path)
        WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 45) GROUP BY 1""",
    "missing_reports": """
        WITH x AS (
            SELECT p_partkey, 'src/' || p_partkey || '.py' AS path, cat FROM part JOIN (VALUES ('test'), ('lint'), ('security')) v(cat)
                ON (cat = 'test' AND p_type = 'ECONOMY') OR (cat <> 'test' AND p_type NOT IN ('ECONOMY', 'PROMO')))
        SELECT path, cat AS tool_category FROM x WHERE NOT EXISTS (
            SELECT 1 FROM lineitem WHERE l_partkey = x.p_partkey AND l_discount >= 0.09
                AND CASE WHEN l_linestatus = 'F' THEN 'test' WHEN l_returnflag = 'A' THEN 'lint' ELSE 'security' END = x.cat)""",
    "claim_test_results": """
        WITH r AS (SELECT p_size, count(*) AS n, count(*) FILTER (p_brand = 'Brand#1') AS bad FROM part WHERE p_type = 'ECONOMY' GROUP BY 1),
        t AS (SELECT DISTINCT CAST(l_quantity AS INT) AS q FROM lineitem WHERE l_linestatus = 'F'),
        s AS (SELECT q, n, bad, CASE WHEN q NOT IN (SELECT p_size FROM part WHERE p_size <= 40) THEN 'file_not_found' WHEN n IS NULL THEN 'not_run'
                WHEN q = 13 THEN 'timeout' WHEN bad = 0 THEN 'passed' ELSE 'failed' END AS status FROM t LEFT JOIN r ON p_size = q)
        SELECT 'S' || q AS path, status, CASE WHEN status IN ('passed', 'failed') THEN CAST(n - bad AS INT) ELSE 0 END AS n_passed,
            CASE WHEN status IN ('passed', 'failed') THEN CAST(bad AS INT) ELSE 0 END AS n_failed, 0 AS n_errors,
            CASE WHEN status IN ('passed', 'failed') THEN CAST(n AS INT) ELSE 0 END AS num_tests FROM s""",
    "unknown_extensions": r"""
        SELECT DISTINCT e AS extension FROM (
            SELECT regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '[^/](\.[^./]+)$', 1) AS e FROM pages) WHERE e <> '' AND e <> '.py'""",
    "input_manifest": """
        SELECT source AS project_id, CAST(doc_id AS VARCHAR) AS file_key, CASE WHEN lang = 'de' THEN 'missing' ELSE 'ok' END AS status,
            CASE WHEN lang = 'de' AND n_chars < 1000 THEN 'missing_input' END AS error_code,
            CASE WHEN lang <> 'de' THEN sha256(text) END AS sha256 FROM documents""",
    "manifest_errors": """
        SELECT source AS project_id, count(*) FILTER (lang = 'es' OR (lang = 'de' AND n_chars < 1000)) AS n_errors,
            bool_or(lang IN ('es', 'de') AND n_chars < 1000) AS has_required_errors FROM documents GROUP BY 1""",
    "tasks_from_documents": """
        SELECT c_nationkey AS project_id, 'TASK-P-' || c_custkey AS task_id, CAST(NULL AS VARCHAR) AS title, 'done' AS status,
            'REQ-P-' || c_nationkey || ',REQ-P-99' AS requirements, CAST(0 AS BIGINT) AS ord FROM customer WHERE c_acctbal >= 0
        UNION ALL SELECT c_nationkey, 'TASK-P-' || c_custkey || '1', c_name, NULL, NULL, 2 FROM customer WHERE c_acctbal >= 0""",
    "claims_from_documents": """
        SELECT 'CLAIM-P-' || o_orderkey AS claim_id, 'TASK-P-' || o_custkey AS related_task, date_trunc('day', o_orderdate)::TIMESTAMP AS claimed_ts,
            'a.py,b.py#L' || o_orderkey AS code_refs, 0 AS n_tests, CAST(0 AS BIGINT) AS ord FROM orders WHERE o_orderkey <> 9999""",
    "rules_from_documents": """
        SELECT c_custkey AS project_id, 'security_rules' AS section, 'S-' || c_custkey AS rule_id, 'must' AS severity, 'machine' AS verification_method FROM customer
        UNION ALL SELECT c_custkey, 'quality_gates', 'G-' || c_custkey, 'must', 'manual' FROM customer""",
    "modules_from_documents": """
        SELECT c_custkey AS project_id, 'M-' || c_custkey AS module_id, 'f.py' AS files, 0 AS n_allowed, true AS no_forbidden_list FROM customer""",
    "scope_patterns": """
        SELECT c_custkey AS project_id, 'include' AS kind, 'src/' || c_mktsegment || '/**' AS pattern FROM customer""",
    "nested_requirement_links": """
        SELECT c_custkey AS project_id, 'REQ-P-' || c_nationkey AS req_id, true AS top_level FROM customer
        UNION ALL SELECT c_custkey, 'REQ-P-77', false FROM customer""",
    "decisions_from_documents": """
        SELECT user_id AS project_id, event_id AS decision_id, event_type AS action, json_extract_string(props, '$.k') AS "targetId",
            TIMESTAMP '2024-01-01' AS timestamp FROM events WHERE event_type <> 'error'""",
    "new_decision_ids": """
        SELECT user_id AS project_id, coalesce(l.last, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS decision_id,
            CAST(event_id AS VARCHAR) AS "targetId"
        FROM events LEFT JOIN (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'signup' GROUP BY 1) l USING (user_id)
        WHERE event_type = 'purchase' AND value < 50""",
    "changed_files_from_listings": """
        SELECT page_id AS project_id, url AS path FROM pages UNION SELECT page_id, 'b.py' FROM pages""",
    "drift_findings": """
        WITH d AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
        s AS (SELECT c_custkey, CASE WHEN c_acctbal <= 5000 THEN 'none' WHEN c_nationkey = 3 THEN 'no_metadata' WHEN c_nationkey = 4 THEN 'no_baseline'
                WHEN n IS NULL THEN 'format_only' ELSE 'changed' END AS drift FROM customer LEFT JOIN d ON o_custkey = c_custkey)
        SELECT c_custkey AS project_id, 'risk' AS kind, 'should' AS severity FROM s WHERE drift <> 'none'
        UNION ALL SELECT c_custkey, 'gap', 'should' FROM s WHERE drift = 'changed'
        UNION ALL SELECT c_custkey, 'undocumented', 'must' FROM s WHERE drift = 'no_baseline'
            OR (drift = 'changed' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 490000))""",
    "lock_baseline": """
        SELECT c_custkey AS project_id, outcome,
            CASE WHEN outcome = 'locked' THEN 'py' WHEN c_nationkey <= 5 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'js' ELSE 'py' END AS language,
            CASE WHEN outcome = 'locked' THEN 'h' WHEN c_nationkey <= 5 THEN NULL WHEN c_acctbal > 2000 THEN 'h' ELSE 'old' END AS architecture_constraints_hash,
            CASE WHEN outcome = 'locked' THEN CASE WHEN c_acctbal > 9000 THEN 'new' ELSE 'p' END WHEN c_nationkey <= 5 THEN NULL ELSE 'p' END AS prd_hash
        FROM (SELECT *, CASE WHEN c_mktsegment = 'FURNITURE' THEN 'language_unknown' WHEN c_nationkey <= 5 THEN 'locked'
                WHEN c_mktsegment = 'BUILDING' THEN 'language_conflict' WHEN c_acctbal > 2000 AND c_acctbal <= 9000 THEN 'unchanged'
                WHEN c_acctbal <= 2000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 'undocumented_change'
                ELSE 'locked' END AS outcome FROM customer)""",
    "edge_modules": """
        SELECT CASE WHEN o_orderstatus <> 'F' THEN 'M' || substr(o_orderpriority, 1, 1) END AS from_module,
            CASE WHEN project_id = 3 THEN 'MSUB' WHEN project_id = 4 OR project_id >= 20 THEN NULL ELSE 'M' || project_id END AS to_module, count(*) AS n
        FROM op GROUP BY ALL""",
    "rule_gate": """
        WITH p AS (SELECT *, p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') AS ch FROM part),
        r AS (SELECT p_brand, ch, 'must_rule_violation' AS code, 'block' AS e FROM p WHERE p_type = 'PROMO'
            UNION ALL SELECT p_brand, ch, 'rule_status_violated', 'block' FROM p WHERE p_type <> 'PROMO' AND p_size % 5 = 2
            UNION ALL SELECT p_brand, ch, 'unclear_rule', 'fail' FROM p WHERE p_type = 'SMALL'
            UNION ALL SELECT p_brand, ch, 'rule_status_unclear', 'fail' FROM p WHERE p_size % 5 = 4)
        SELECT p_brand AS project_id, code, CASE WHEN ch THEN 'note' ELSE e END AS effect, CASE WHEN ch THEN 'pre_existing' ELSE 'all' END AS change_scope, count(*) AS n
        FROM r GROUP BY ALL
        UNION ALL SELECT p_brand, 'coverage_violation', 'block', 'current', count(*) FROM p WHERE p_type = 'LARGE' GROUP BY 1""",
    "run_metadata": """
        WITH j AS (SELECT g.project_id, count(*) AS n FROM gfx g JOIN gproj p USING (project_id) WHERE p.status <> 'draft' GROUP BY 1)
        SELECT project_id, 'RUN-1' AS run_id, '2001-02-15T12:00:00.000000Z' AS scan_time, gate_decision, CASE gate_decision WHEN 'blocked' THEN 2 ELSE 0 END AS exit_code,
            coalesce(j.n, 1) AS n_reasons FROM gate LEFT JOIN j USING (project_id)""",
    "run_reasons": """
        WITH r AS (SELECT g.project_id, code, row_number() OVER (PARTITION BY g.project_id ORDER BY rank, ord) AS seq FROM gfx g JOIN gproj p USING (project_id) WHERE p.status <> 'draft')
        SELECT project_id, 'RUN-1' AS run_id, seq, code AS reason FROM r
        UNION ALL SELECT project_id, 'RUN-1', 1, CASE gate_decision WHEN 'pass' THEN 'all_passed' ELSE 'draft' END
        FROM gate WHERE project_id NOT IN (SELECT project_id FROM r)""",
    "fallback_actions": """
        WITH r AS (SELECT g.project_id, code, row_number() OVER (PARTITION BY g.project_id ORDER BY rank, ord) AS seq FROM gfx g JOIN gproj p USING (project_id) WHERE p.status <> 'draft')
        SELECT project_id, 'gate_blocked' AS type, code AS detail, 80 AS urgency, seq AS ord FROM r JOIN gate USING (project_id)
        WHERE gate_decision IN ('blocked', 'fail') AND project_id NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""",
    "reusable_results": """
        SELECT 'doc/' || doc_id AS path, sha256(text) AS file_hash, toxic FROM documents JOIN labels USING (doc_id)
        WHERE quality = 1 OR sha256(text) = sha256('x')""",
    "normalised_refs": r"""
        SELECT page_id, split_part(url, '#', 1) AS without_fragment, regexp_extract(split_part(url, '#', 1), '([^/]*)$', 1) AS base_name,
            CASE WHEN starts_with(url, 'https://m.ththth.example.net/') THEN substr(url, 30) ELSE url END AS relative,
            substr(html, 1, 80) AS clipped, url AS title FROM pages""",
    "document_problems": """
        SELECT c_nationkey AS project_id, c_custkey AS doc_id, problem,
            CASE item WHEN 'req' THEN 'REQ-P-' || c_nationkey WHEN 'other' THEN 'AC-P-99-' || c_custkey ELSE 'AC-P-' || c_nationkey || '-' || c_custkey END AS item_id
        FROM customer JOIN (VALUES (1, 'test_flag_missing', 'ac'), (2, 'test_flag_invalid', 'ac'), (3, 'category_invalid', 'req'),
            (4, 'criterion_under_wrong_requirement', 'other'), (4, 'parent_requirement_missing', 'other'), (5, 'priority_missing', 'req'),
            (6, 'duplicate_requirement', 'req')) v(k, problem, item) ON k = c_custkey % 7""",
    "analysis_gate": """
        SELECT CAST(c_custkey AS VARCHAR) AS project_id, CASE c_custkey % 4 WHEN 0 THEN 'pass' WHEN 3 THEN 'draft_approved' ELSE 'blocked' END AS gate_decision
        FROM customer""",
    "affected_by_project": """
        WITH r AS (SELECT DISTINCT project_id, 'C' || (o_orderkey % 211) AS claim_id, o_orderkey % 101 AS f FROM op),
        x AS (SELECT DISTINCT project_id, o_orderkey % 97 AS f FROM op WHERE o_orderkey % 5 = 0),
        c AS (SELECT DISTINCT project_id, claim_id FROM r JOIN x USING (project_id, f)),
        t AS (SELECT DISTINCT op.project_id, op.o_custkey % 53 AS k FROM op JOIN c ON c.project_id = op.project_id AND c.claim_id = 'C' || (op.o_orderkey % 211))
        SELECT project_id, 'claim' AS item_type, claim_id AS item_id FROM c
        UNION ALL SELECT project_id, 'task', 'K' || k FROM t
        UNION ALL SELECT DISTINCT op.project_id, CASE WHEN o_orderkey % 2 = 0 THEN 'requirement' ELSE 'ac' END, 'R' || (o_orderkey % 307)
        FROM op JOIN t ON t.project_id = op.project_id AND t.k = op.o_custkey % 53""",
    "reference_findings_by_project": """
        WITH e AS (
            SELECT p_size % 25 AS project_id, 'E' || (p_partkey % 50) AS ref, p_partkey,
                CASE WHEN p_partkey % 7 = 0 THEN 'violated' WHEN p_partkey % 11 = 0 THEN 'unclear' ELSE 'compliant' END AS status FROM part),
        k AS (SELECT project_id, ref, count(DISTINCT status) AS n, bool_or(status = 'violated') AS v, bool_or(status = 'unclear') AS u FROM e GROUP BY 1, 2),
        c AS (SELECT project_id, o_orderkey FROM op WHERE o_orderstatus <> 'O'),
        x AS (SELECT c.project_id, c.o_orderkey, 'E' || (l_partkey % 60) AS ref, l_linenumber AS pos FROM c JOIN lineitem ON l_orderkey = c.o_orderkey WHERE l_discount < 0.05),
        j AS (SELECT x.*, k.n, k.v, k.u FROM x LEFT JOIN k USING (project_id, ref))
        SELECT project_id, 'C' || o_orderkey AS claim_id, 'self_referential_claim' AS category, CAST(NULL AS VARCHAR) AS ref, CAST(0 AS BIGINT) AS pos
        FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM x)
        UNION ALL SELECT project_id, 'C' || o_orderkey, 'conflicting_statuses', ref, pos FROM j WHERE n > 1
        UNION ALL SELECT project_id, 'C' || o_orderkey, CASE WHEN n IS NULL THEN 'non_existent_evidence' WHEN v THEN 'violated_evidence' ELSE 'unclear_evidence_status' END, ref, pos
        FROM j WHERE n IS NULL OR v OR u""",
    "dangling_by_project": """
        SELECT project_id, o_orderkey, 'M' || (o_orderkey % 40) AS module_id FROM op WHERE NOT EXISTS (
            SELECT 1 FROM supplier WHERE s_nationkey = op.project_id AND s_suppkey % 40 = op.o_orderkey % 40)""",
    "more_constraint_checks": """
        WITH p AS (SELECT *, 'parts[' || p_partkey || ']' AS spot FROM part)
        SELECT p_brand AS project_id, CAST(p_partkey AS VARCHAR) AS key, spot || '.count' AS field_path, 'type' AS rule, 'many' AS value FROM p WHERE p_size % 5 = 0
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.title', 'min_length', p_type FROM p WHERE length(p_type) < 6
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.size', 'maximum', CAST(p_size AS VARCHAR) FROM p WHERE p_size > 40
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.words', 'min_items', NULL FROM p WHERE p_size % 2 <> 0
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.z', 'additional', 'z' FROM p WHERE p_size % 7 = 0
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.words[0]', 'item_enum', p_type FROM p WHERE p_type NOT IN ('ECONOMY', 'LARGE', 'MEDIUM')
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.words[1]', 'item_enum', p_brand FROM p WHERE p_size % 2 = 0 AND p_brand <> 'Brand#1'
        UNION ALL SELECT p_brand, CAST(p_partkey AS VARCHAR), spot || '.parts[0].name', 'item_required', NULL FROM p WHERE p_size % 3 = 0""",
    "document_criteria": """
        SELECT DISTINCT c_custkey % 10 AS project_id, 'AC-P-' || c_nationkey || '-1' AS ac_id FROM customer
        UNION SELECT c_custkey % 10, 'AC-QX-2-' || (c_custkey % 3) FROM customer""",
    "rule_requirement_links": """
        SELECT p_brand AS project_id, 'REQ-' || (p_size + d) AS req_id, true AS top_level, count(*) AS n FROM part, (VALUES (0), (1)) v(d) GROUP BY 1, 2
        UNION ALL SELECT 'Brand#1', 'MREQ-' || n_nationkey, true, 1 FROM nation""",
    "skipped_refs": """
        SELECT DISTINCT p_brand AS project_id, 'doc/f' || (p_partkey % 40) || '.md' AS source_path, 'skipped' AS status, 'no_tool_applies' AS skip_reason
        FROM part WHERE p_size % 3 = 0""",
    "active_gaps": """
        SELECT project_id, o_orderkey AS item_id FROM op WHERE o_orderstatus = 'P' OR NOT starts_with(o_orderpriority, '1')""",
    "file_hashes": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "sentences_and_hints": """
        SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN '。' || p_type || '。' ELSE p_name END AS sentence,
            CASE WHEN p_size % 4 = 2 THEN p_type WHEN p_size % 2 = 0 THEN p_name WHEN p_size % 4 = 3 THEN p_brand ELSE '' END AS hint
        FROM part""",
    "presence_status": """
        SELECT c_custkey AS project_id, 'DEP-' || c_custkey AS rule_id,
            CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'violated' ELSE 'compliant' END AS status, 'must' AS severity
        FROM customer""",
    "artifact_status": """
        WITH p AS (SELECT page_id % 20 AS project_id, bool_or(page_id % 11 = 0) AS bad FROM pages GROUP BY 1)
        SELECT n_nationkey::BIGINT AS project_id, 'DEP-002' AS rule_id, CASE WHEN bad IS NULL THEN 'unclear' WHEN bad THEN 'violated' ELSE 'compliant' END AS status
        FROM nation LEFT JOIN p ON p.project_id = n_nationkey""",
    "external_links": r"""
        SELECT page_id, len(u) AS n_urls, array_to_string(u, ' ') AS urls FROM (
            SELECT page_id, regexp_extract_all(html || CASE WHEN page_id % 2 = 0 THEN '<a HREF=''https://e.example/' || page_id || '''>x</a>' ELSE '' END,
                '(?i)(?:href|src)\s*=\s*["''](?:https?:)?//[^"'']+["'']') AS u FROM pages)""",
    "drift_status": """
        SELECT c_custkey AS project_id, 'GATE-' || c_nationkey AS rule_id, CASE WHEN c_acctbal < 0 THEN 'unclear' ELSE 'compliant' END AS status,
            CASE WHEN c_acctbal < 0 THEN 'should' ELSE 'must' END AS severity
        FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderkey % 25 = c_nationkey)""",
    "unclear_rules": """
        SELECT project_id, rule_id, CAST(substr(rule_id, 6) AS BIGINT) AS ord FROM rule
        WHERE severity = 'must' AND section <> 'other_section' AND method <> 'manual' AND rule_id NOT IN (
            SELECT 'RULE-' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1)""",
    "classified_status": """
        SELECT project_id, rule_id, 'unclear' AS status, 'must' AS severity, p_name AS title
        FROM rule JOIN (SELECT p_partkey, p_name FROM part) ON rule_id = 'RULE-' || p_partkey
        WHERE severity = 'must' AND section <> 'other_section' AND NOT (method = 'manual' AND accepted_by IS NOT NULL) AND rule_id NOT IN (
            SELECT 'RULE-' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1)""",
    "unclear_rule_risks": """
        SELECT project_id, rule_id AS target_id, 'should' AS severity, 'EVIDENCE-P-999' AS evidence_id, 'low_confidence' AS confidence, 'suggestion' AS type
        FROM rule WHERE severity = 'must' AND section <> 'other_section' AND method <> 'manual' AND rule_id NOT IN (
            SELECT 'RULE-' || l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_discount >= 0.1)""",
    "violation_actions": """
        SELECT CASE WHEN s_acctbal < 4000 THEN s_nationkey ELSE -s_nationkey - 1 END AS project_id, 'fix_violation' AS type, 'RULE-' || s_suppkey AS item_id,
            s_name AS detail, 90 AS urgency FROM supplier
        UNION ALL SELECT s_nationkey, 'arch_status_violation', 'RULE-' || s_suppkey, NULL, 90 FROM supplier
        WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 AND s_acctbal >= 4000""",
    "uncovered_task_criteria": """
        WITH res AS (SELECT s_nationkey AS project_id, 't' || (s_suppkey % 100) AS path, max_by(s_acctbal < 3000, s_suppkey) AS good FROM supplier GROUP BY 1, 2),
        k AS (SELECT op.project_id, op.o_custkey, bool_or(coalesce(res.good, false)) AS passing FROM op
              LEFT JOIN res ON res.project_id = op.project_id AND res.path = 't' || (op.o_orderkey % 100) GROUP BY 1, 2)
        SELECT c_nationkey AS project_id, 'K' || c_custkey AS task_id, ac AS ac_id, CASE WHEN k.o_custkey IS NULL THEN 'no_claim_for_task'
                ELSE 'test_failed' END AS reason
        FROM customer LEFT JOIN k ON k.o_custkey = c_custkey, LATERAL (SELECT unnest(['AC-' || (c_custkey % 50), 'AC-0']) AS ac)
        WHERE c_acctbal > 0 AND (k.o_custkey IS NULL OR (c_nationkey IN (SELECT s_nationkey FROM supplier) AND NOT k.passing))""",
    "row_validity": """
        WITH p AS (SELECT project_id, 'T' || (o_orderkey % 400) AS task_id, count(*) AS n FROM op GROUP BY 1, 2)
        SELECT c_nationkey AS project_id, 'T' || (c_custkey % 200) AS task_id, c_custkey, coalesce(n, 0) AS n_problems, n IS NULL AS is_valid
        FROM customer LEFT JOIN p ON p.project_id = c_nationkey AND p.task_id = 'T' || (c_custkey % 200)""",
    "head_snapshot": "SELECT project_id, o_orderkey, o_orderstatus FROM op WHERE o_orderkey % 3 = 0",
    "written_index": """
        SELECT c_nationkey AS project_id, 'RUN-7' AS run_id, 'EVIDENCE-P-' || c_custkey AS evidence_id, CASE WHEN c_acctbal < 0 THEN 'missing' ELSE 'covered' END AS status,
            c_mktsegment AS covers FROM customer""",
    "report_parts": "SELECT project_id, 'orders' AS section, o_orderkey AS ord, o_orderstatus FROM op",
    "claim_archive": """
        SELECT project_id, o_orderkey AS claim_id, CASE WHEN project_id % 2 = 0 THEN 'commit-' || CASE project_id WHEN 4 THEN '20010215120000' ELSE 'c' || project_id END END AS commit_id
        FROM op""",
    "structural_differences": """
        SELECT c_custkey AS project_id, replace(path, '$', CAST(c_custkey AS VARCHAR)) AS path,
            CASE WHEN k = 3 THEN 'R' || c_custkey END AS rule_id, action
        FROM customer JOIN (VALUES (0, 'a', 'modify'), (1, 's', 'modify'), (2, 'a.b', 'delete'), (2, 'a', 'add'), (3, 'rules.R$', 'add'),
            (4, 'n.p', 'delete'), (5, 't', 'add'), (7, 'r', 'modify'), (8, 'a.b.c.d.e.f.g.h', 'modify')) v(k, path, action) ON k = c_custkey % 10""",
}


def _needed(text: str, seen: list[str]) -> None:
    """Names of the expressions ``text`` uses, dependencies first."""
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in text).split())
    for name in _CTES:
        if name in words and name not in seen:
            _needed(_CTES[name], seen)
            if name not in seen:
                seen.append(name)


# Other plans for the same results.
_SQL["gate_from_store"] = _SQL["gate_by_project"]
_SQL["claim_delta_of_snapshots"] = _SQL["claim_delta"]
_SQL["keyed_delta_of_snapshots"] = _SQL["keyed_delta"]


def statements() -> dict[str, str]:
    """Query name -> statement with the expressions it needs."""
    out = {}
    for name, body in _SQL.items():
        used: list[str] = []
        _needed(body, used)
        own = body.strip()
        parts = [f"{cte} AS ({_CTES[cte].strip()})" for cte in used]
        if own.startswith("WITH "):
            parts.append(own[5:])
            out[name] = "WITH " + ", ".join(parts)
        else:
            out[name] = ("WITH " + ", ".join(parts) + " " if parts else "") + own
    return out
