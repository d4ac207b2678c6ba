"""Effective-dated tables of the rule engine, derived from the star-schema tables."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import all_of, any_of, compare, group, none_of

AS_OF = datetime.date(1999, 6, 30)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def employee_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version per customer and order date; an attribute key may be missing, null or set."""
    orders = read(spark, sf_dir, "orders").select(
        "o_custkey", F.col("o_orderdate").cast("date").alias("valid_from"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    latest = Window.partitionBy("o_custkey", "valid_from").orderBy(F.desc("o_orderkey"))
    d = orders.withColumn("rn", F.row_number().over(latest)).where("rn = 1")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey")
    nation = F.broadcast(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"))  # 25 rows by definition
    own = Window.partitionBy("c_custkey").orderBy("valid_from")
    whole = Window.partitionBy("c_custkey")
    key = F.col("o_orderkey")
    status = F.when(key % 7 == 0, F.lit("")).when(key % 11 == 0, F.lit('"status":null,')).otherwise(
        F.concat(F.lit('"status":"'), "o_orderstatus", F.lit('",')))
    return (
        customer.join(d, F.col("c_custkey") == F.col("o_custkey"))
        .withColumn("n_nationkey", (F.col("c_nationkey") + key) % 25).join(nation, "n_nationkey")
        .select(
            F.col("c_custkey").alias("employee_id"), key.alias("version_id"),
            F.row_number().over(own).cast("int").alias("version"), "valid_from",
            F.lead("valid_from").over(own).alias("valid_to"), F.col("n_name").alias("location"),
            F.col("c_mktsegment").alias("department"),
            F.when(key % 13 != 0, F.col("o_orderpriority")).alias("employment_type"),
            (F.col("c_acctbal") > 5000).alias("is_manager"),
            F.when(F.col("c_custkey") % 17 != 0, F.min("valid_from").over(whole)).alias("hire_date"),
            F.concat(F.lit("{"), status, F.lit('"level":'), (key % 10).cast("string"), F.lit("}")).alias("attributes_json"),
            F.concat(F.lit("E-"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("external_id"),
            F.when(F.col("c_custkey") % 19 != 0, F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@example.org"))).alias("email"),
            F.concat(F.lit("c"), (F.col("c_custkey") % 3).cast("string")).alias("company_id")))


def group_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_add(F.lit("1999-06-01").cast("date"), F.dayofmonth(F.min("ts")))
    return (read(spark, sf_dir, "events").where("event_id % 5 = 0").groupBy("event_type", "user_id").agg(start.alias("valid_from"))
            .select(F.col("event_type").alias("group_id"), F.col("user_id").alias("employee_id"), "valid_from",
                    F.when(F.col("user_id") % 3 != 0, F.date_add("valid_from", 20)).alias("valid_to"),
                    F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("company_id")))


def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, start = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").where("o_orderkey % 29 = 0").select(
        key.alias("id"), F.col("o_custkey").alias("employee_id"), F.lit("main").alias("category_id"),
        F.when(key % 3 == 0, "p-urgent").otherwise("p-default").alias("policy_id"),
        F.when(key % 2 == 0, "ASSIGN").otherwise("EXCLUDE").alias("action"),
        (key % 101 - 50).cast("int").alias("priority"), start.alias("valid_from"),
        F.when(key % 4 != 0, F.date_add(start, 365)).alias("valid_to"), (key % 5 == 0).alias("revoked"),
        F.concat(F.lit("exception "), key.cast("string")).alias("reason"),
        F.concat(F.lit("c"), (F.col("o_custkey") % 3).cast("string")).alias("company_id"))


def _rule(rule: str, policy: str, priority: int, condition: dict, valid_from="1990-01-01", valid_to=None, enabled=True,
          category="main", policy_enabled=True) -> dict:
    return {"rule_id": rule, "version_id": f"{rule}-v1", "policy_id": policy, "category_id": category, "priority": priority,
            "condition": condition, "valid_from": valid_from, "valid_to": valid_to, "enabled": enabled,
            "policy_enabled": policy_enabled}


#: The published rules of the fixtures: a single-choice category `main` and a multiple-choice one, `perks`.
RULES = [
    _rule("r-any", "p-default", 1, compare("department", "NE", "none")),
    _rule("r-urgent", "p-urgent", 40, all_of(compare("employment_type", "EQ", "1-URGENT"), none_of(compare("attribute.status", "EQ", "F")))),
    _rule("r-machinery", "p-machinery", 30, all_of(compare("department", "EQ", "MACHINERY"), none_of(compare("employment_type", "EQ", "5-LOW")))),
    _rule("r-tenured", "p-tenured", 20, compare("tenure_days", "GTE", 730)),
    _rule("r-group", "p-group", 35, all_of(group("click"), compare("attribute.level", "GT", 3))),
    _rule("r-future", "p-future", 90, compare("department", "EQ", "BUILDING"), valid_from="1999-09-01"),
    _rule("r-ended", "p-ended", 95, compare("department", "EQ", "BUILDING"), valid_to="1999-06-30"),
    _rule("r-off", "p-off", 99, compare("department", "EQ", "BUILDING"), enabled=False),
    _rule("k-place", "k-place", 5, compare("location", "IN", ["NATION_3", "NATION_7", "NATION_11"]), category="perks"),
    _rule("k-manager", "k-manager", 5, compare("is_manager", "EQ", True), category="perks"),
    _rule("k-level", "k-level", 5, any_of(compare("attribute.level", "GTE", 8), compare("attribute.status", "NE", "O")), category="perks"),
    _rule("k-year", "k-year", 5, all_of(compare("as_of_date", "LT", "2000-01-01"), compare("hire_date", "LT", "1996-01-01")), category="perks"),
]
#: Categories and whether one or several policies may hold.
CATEGORIES = {"main": "SINGLE", "perks": "MULTIPLE"}


def policies(spark: SparkSession) -> DataFrame:
    rows = sorted({(r["category_id"], r["policy_id"]) for r in RULES})
    return spark.createDataFrame([(c, p, f"Policy {p}", True) for c, p in rows],
                                 "category_id string, policy_id string, name string, enabled boolean")


def rule_table(spark: SparkSession) -> DataFrame:
    day = datetime.date.fromisoformat
    return spark.createDataFrame(
        [(r["rule_id"], r["version_id"], r["policy_id"], r["category_id"], r["priority"], r["enabled"], day(r["valid_from"]),
          day(r["valid_to"]) if r["valid_to"] else None) for r in RULES],
        "rule_id string, version_id string, policy_id string, category_id string, priority int, enabled boolean, "
        "valid_from date, valid_to date")
