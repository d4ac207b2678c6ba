"""Queries of the rule universe: six domains of fifty rules, derived from observed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import universe
from . import oracle as o
from .core import DAY, Data, register

ROLES = ("ANALYST", "ENGINEER", "CLERK", "NURSE", "MANAGER")


def facts(spark, d) -> DataFrame:
    """Observed facts of complete employees: a job title by department and level, a pay basis by level."""
    snap = Data(spark, d).snap()
    level = F.variant_get("attributes", "$.level", "int")
    title = F.concat_ws(" ", "department", F.array(*map(F.lit, ROLES))[level % 5])
    rows = snap.withColumns({"job_title": title, "employment_status": F.try_variant_get("attributes", "$.status", "string"),
                             "pay_basis": F.when(level % 2 == 0, "per Annum").otherwise("per Hour")}).drop("attributes", "group_ids")
    rows = rows.where("hire_date IS NOT NULL AND employment_type IS NOT NULL AND employment_status IS NOT NULL")
    titles = rows.groupBy(F.col("job_title").alias("title")).agg(F.count("*").alias("n"))
    return universe.observed_facts(rows, universe.role_families(titles), F.lit(DAY))


FACTS = ("f0 AS (SELECT *, department || ' ' || list_extract(['ANALYST', 'ENGINEER', 'CLERK', 'NURSE', 'MANAGER'], attr_level % 5 + 1) AS job_title, list_extract(['ANALYST', 'ENGINEER', 'CLERK', 'NURSE', 'MANAGER'], attr_level % 5 + 1) AS role, "
         "attr_status AS employment_status, CASE WHEN attr_level % 2 = 0 THEN 'per Annum' ELSE 'per Hour' END AS pay_basis, "
         "CASE WHEN tenure >= 3650 THEN 'veteran' WHEN tenure >= 1825 THEN 'senior' WHEN tenure >= 730 THEN 'established' ELSE 'new' END AS tier, department AS cohort FROM snap "
         "WHERE hire_date IS NOT NULL AND employment_type IS NOT NULL AND attr_status IS NOT NULL), "
         "tok AS (SELECT token, count(DISTINCT job_title) AS titles, count(*) AS employees FROM (SELECT job_title, unnest([department, role]) AS token FROM f0) GROUP BY token), "
         "fam AS (SELECT job_title, lower(token) AS family FROM (SELECT DISTINCT job_title, unnest([department, role]) AS token FROM f0) JOIN tok USING (token) "
         "QUALIFY row_number() OVER (PARTITION BY job_title ORDER BY titles, employees DESC, token) = 1), "
         "facts AS (SELECT * FROM f0 JOIN fam USING (job_title))")


def _key_sql(prefix: str, values: str) -> str:
    slug = f"regexp_replace(regexp_replace(lower(array_to_string({values}, '-')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"
    json = f"'[\"' || array_to_string({values}, '\",\"') || '\"]'"
    return f"'{prefix}-' || regexp_replace({slug}[1:{max(1, 100 - len(prefix) - 10)}], '-$', '') || '-' || sha256({json})[1:8]"


def _domain_sql(domain: str) -> str:
    parts = []
    for place, group in enumerate(universe.DOMAINS[domain]):
        for prefix, names, priority in group:
            if "top_status" in names:
                own = names[0]
                source = (f"(SELECT {own}, top_status, n FROM (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY n DESC, top_status) AS rn FROM "
                          f"(SELECT {own}, employment_status AS top_status, count(*) AS n FROM facts GROUP BY ALL)) WHERE rn = 1)")
            else:
                source = f"(SELECT {', '.join(names)}, count(*) AS n FROM facts GROUP BY ALL)"
            parts.append(f"SELECT {place} AS place, {_key_sql(prefix, '[' + ', '.join(names) + ']')} AS key, n, {priority} AS priority FROM {source}")
    return f"(SELECT '{domain}' AS domain, key, n, priority FROM ({' UNION ALL '.join(parts)}) ORDER BY place, n DESC, key LIMIT 50)"


def _domain(domain: str):
    def run(spark, d):
        return universe.derive_domain(facts(spark, d), domain).drop("values")

    return run


for _name in universe.DOMAINS:
    register(f"universe_{_name}", o.query(_domain_sql(_name), o.snap(), FACTS))(_domain(_name))


@register("universe_blueprint", o.query(
    "SELECT domain, count(*) AS rules, count(DISTINCT key) AS keys, CAST(sum(n) AS BIGINT) AS employees FROM (" + " UNION ALL ".join(map(_domain_sql, universe.DOMAINS)) + ") GROUP BY domain", o.snap(), FACTS))
def universe_blueprint(spark, d):
    rules = universe.blueprint(facts(spark, d))
    return rules.groupBy("domain").agg(F.count("*").alias("rules"), F.count_distinct("key").alias("keys"), F.sum("n").alias("employees"))


@register("universe_role_families", o.query("SELECT family, CAST(sum(n) AS BIGINT) AS employees, string_agg(job_title, '|' ORDER BY job_title) AS titles FROM (SELECT family, job_title, count(*) AS n FROM facts GROUP BY ALL) GROUP BY family", o.snap(), FACTS))
def universe_role_families(spark, d):
    f = facts(spark, d).groupBy(F.col("job_title").alias("title")).agg(F.count("*").alias("n"))
    return universe.role_families(f).withColumn("titles", F.array_join("titles", "|"))
