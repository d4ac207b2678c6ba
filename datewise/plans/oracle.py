"""Shared SQL of the DuckDB twins: the derived tables and the fixture rules, written independently of the engine."""

DAY = "DATE '1999-06-30'"

EV = """ev AS (
  WITH d AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS valid_from, o_orderkey, o_orderstatus, o_orderpriority,
             ROW_NUMBER() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn FROM orders)
  SELECT c.c_custkey AS employee_id, d.o_orderkey AS version_id,
         CAST(ROW_NUMBER() OVER (PARTITION BY c.c_custkey ORDER BY d.valid_from) AS INT) AS version, d.valid_from,
         LEAD(d.valid_from) OVER (PARTITION BY c.c_custkey ORDER BY d.valid_from) AS valid_to, n.n_name AS location,
         c.c_mktsegment AS department, CASE WHEN d.o_orderkey % 13 = 0 THEN NULL ELSE d.o_orderpriority END AS employment_type,
         c.c_acctbal > 5000 AS is_manager,
         CASE WHEN c.c_custkey % 17 = 0 THEN NULL ELSE MIN(d.valid_from) OVER (PARTITION BY c.c_custkey) END AS hire_date,
         d.o_orderkey % 7 <> 0 AS status_present,
         CASE WHEN d.o_orderkey % 7 = 0 OR d.o_orderkey % 11 = 0 THEN NULL ELSE d.o_orderstatus END AS attr_status,
         CAST(d.o_orderkey % 10 AS INT) AS attr_level, 'E-' || lpad(CAST(c.c_custkey AS VARCHAR), 9, '0') AS external_id,
         CASE WHEN c.c_custkey % 19 = 0 THEN NULL ELSE 'u' || c.c_custkey || '@example.org' END AS email, 'c' || (c.c_custkey % 3) AS company_id
  FROM customer c JOIN d ON d.o_custkey = c.c_custkey AND d.rn = 1
  JOIN nation n ON n.n_nationkey = (c.c_nationkey + d.o_orderkey) % 25)"""

GM = """gm AS (
  SELECT event_type AS group_id, user_id AS employee_id, DATE '1999-06-01' + CAST(EXTRACT(DAY FROM MIN(ts)) AS INT) AS valid_from,
         CASE WHEN user_id % 3 = 0 THEN NULL ELSE DATE '1999-06-01' + CAST(EXTRACT(DAY FROM MIN(ts)) AS INT) + 20 END AS valid_to,
         'c' || (user_id % 3) AS company_id
  FROM events WHERE event_id % 5 = 0 GROUP BY event_type, user_id)"""

OV = """ov AS (
  SELECT o_orderkey AS id, o_custkey AS employee_id, 'main' AS category_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'p-urgent' ELSE 'p-default' END AS policy_id,
         CASE WHEN o_orderkey % 2 = 0 THEN 'ASSIGN' ELSE 'EXCLUDE' END AS action, CAST(o_orderkey % 101 - 50 AS INT) AS priority,
         CAST(o_orderdate AS DATE) AS valid_from,
         CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + 365 END AS valid_to, o_orderkey % 5 = 0 AS revoked,
         'exception ' || o_orderkey AS reason, 'c' || (o_custkey % 3) AS company_id
  FROM orders WHERE o_orderkey % 29 = 0)"""


def on(day: str) -> str:
    return f"valid_from <= {day} AND (valid_to IS NULL OR valid_to > {day})"


def snap(day: str = DAY, name: str = "snap") -> str:
    return f"""{name} AS (
  SELECT e.*, coalesce(g.group_ids, CAST([] AS VARCHAR[])) AS group_ids,
         CASE WHEN hire_date IS NULL THEN NULL ELSE greatest(0, date_diff('day', hire_date, {day})) END AS tenure
  FROM (SELECT * FROM ev WHERE {on(day)}) e
  LEFT JOIN (SELECT employee_id, list_sort(list(DISTINCT group_id)) AS group_ids FROM gm WHERE {on(day)} GROUP BY employee_id) g
  USING (employee_id))"""


#: rule version, category, policy, priority, specificity, condition over the flat snapshot, at a date before 2000
RULES = [
    ("r-any-v1", "main", "p-default", 1, 1, "TRUE"),
    ("r-urgent-v1", "main", "p-urgent", 40, 2, "coalesce(employment_type = '1-URGENT', FALSE) AND NOT coalesce(attr_status = 'F', FALSE)"),
    ("r-machinery-v1", "main", "p-machinery", 30, 2, "department = 'MACHINERY' AND NOT coalesce(employment_type = '5-LOW', FALSE)"),
    ("r-tenured-v1", "main", "p-tenured", 20, 1, "coalesce(tenure >= 730, FALSE)"),
    ("r-group-v1", "main", "p-group", 35, 2, "list_contains(group_ids, 'click') AND attr_level > 3"),
    ("k-place-v1", "perks", "k-place", 5, 1, "location IN ('NATION_3', 'NATION_7', 'NATION_11')"),
    ("k-manager-v1", "perks", "k-manager", 5, 1, "is_manager"),
    ("k-level-v1", "perks", "k-level", 5, 2, "attr_level >= 8 OR (status_present AND attr_status IS DISTINCT FROM 'O')"),
    ("k-year-v1", "perks", "k-year", 5, 2, "coalesce(hire_date < DATE '1996-01-01', FALSE)"),
]


def cand(day: str = DAY, name: str = "cand", source: str = "snap", overrides: str = "ov", rules=None) -> str:
    parts = [f"SELECT employee_id, '{c}' AS category_id, 'rule:{v}' AS candidate_id, '{p}' AS policy_id, 'RULE' AS source, "
             f"'ASSIGN' AS action, {prio} AS priority, CAST({spec} AS BIGINT) AS specificity FROM {source} WHERE {cond}"
             for v, c, p, prio, spec, cond in (rules or RULES)]
    manual = (f"SELECT employee_id, category_id, 'manual:' || lpad(CAST(id AS VARCHAR), 12, '0'), policy_id, 'MANUAL', action, priority, "
              f"9007199254740991 FROM {overrides} WHERE NOT revoked AND {on(day)} AND employee_id IN (SELECT employee_id FROM {source})")
    return f"{name} AS (" + " UNION ALL ".join([*parts, manual]) + ")"


PRECEDENCE = "CASE WHEN source = 'MANUAL' THEN 0 ELSE 1 END, priority DESC, specificity DESC, candidate_id, policy_id"


def judged(name: str = "judged", source: str = "cand") -> str:
    return f"""{name} AS (
  WITH p AS (SELECT *, ROW_NUMBER() OVER w AS place, FIRST_VALUE(action) OVER w AS c_action, FIRST_VALUE(candidate_id) OVER w AS c_id
             FROM {source} WINDOW w AS (PARTITION BY employee_id, category_id, policy_id ORDER BY {PRECEDENCE})),
       q AS (SELECT *, place = 1 AND action = 'ASSIGN' AS eligible FROM p),
       r AS (SELECT *, ROW_NUMBER() OVER w AS rk, FIRST_VALUE(candidate_id) OVER w AS t_id, FIRST_VALUE(source) OVER w AS t_source,
                    FIRST_VALUE(priority) OVER w AS t_priority, FIRST_VALUE(specificity) OVER w AS t_spec
             FROM q WINDOW w AS (PARTITION BY employee_id, category_id ORDER BY CASE WHEN eligible THEN 0 ELSE 1 END, {PRECEDENCE})),
       s AS (SELECT *, eligible AND (category_id <> 'main' OR rk = 1) AS won FROM r)
  SELECT *, CASE WHEN won THEN NULL
     WHEN place = 1 AND action = 'EXCLUDE' THEN 'Manual exclusion controlled this policy'
     WHEN c_action = 'EXCLUDE' THEN 'Policy was vetoed by a higher-precedence manual exclusion'
     WHEN place > 1 THEN 'Duplicate proposal for the same policy had lower precedence'
     WHEN source <> t_source THEN 'Another policy won because manual assignments outrank rule proposals'
     WHEN priority <> t_priority THEN 'Another policy won because it had higher priority'
     WHEN specificity <> t_spec THEN 'Another policy won because its rule was more specific'
     ELSE 'Another policy won by the stable candidate identifier tie-break' END AS reason_lost,
     CASE WHEN won OR (place = 1 AND action = 'EXCLUDE') THEN NULL WHEN place > 1 THEN c_id ELSE t_id END AS won_by
  FROM s)"""


def query(select: str, *parts: str) -> str:
    return "WITH " + ",\n".join([EV, GM, OV, *parts]) + "\n" + select


BASE = (snap(), cand(), judged())
EARLIER = "DATE '1998-12-31'"
#: A rule of the fixtures that ends on the later date still matched on the earlier one.
RULES_BEFORE = [*RULES, ("r-ended-v1", "main", "p-ended", 95, 1, "department = 'BUILDING'")]
BEFORE = (snap(EARLIER, "snap0"), cand(EARLIER, "cand0", "snap0", rules=RULES_BEFORE), judged("judged0", "cand0"))
