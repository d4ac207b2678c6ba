"""Rule universes derived from observed facts: distributions, role families, tiers and combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import derived_key

#: Tiers of tenure: name and lower bound in days.
TENURE_TIERS = (("new", 0), ("established", 730), ("senior", 1825), ("veteran", 3650))
#: Tokens by frequency over titles, and more for titles that these leave out.
COMMON_TOKENS, MORE_TOKENS = 24, 12
GENERAL = "GENERAL"


def require_complete(facts: DataFrame, names: list[str]) -> DataFrame:
    """Employees that lack a required fact, with the names they lack; empty when complete."""
    missing = F.filter(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]), lambda x: x.isNotNull())
    return facts.withColumn("missing", missing).where(F.size("missing") > 0)


def distribution(facts: DataFrame, *names: str) -> DataFrame:
    """Counts of value combinations, most frequent first, then by value."""
    return facts.groupBy(*names).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *names)


def cohorts(facts: DataFrame, name: str, k: int) -> DataFrame:
    """The k most frequent values; top-k, not a full sort."""
    return facts.where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(k)


def cohort_members(facts: DataFrame, name: str, k: int) -> DataFrame:
    return facts.join(F.broadcast(cohorts(facts, name, k).select(name)), name).select("employee_id", F.col(name).alias("group_id"))


def tenure_tier(days: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier, least in TENURE_TIERS:
        out = F.when(days >= least, tier).otherwise(out)
    return out


def title_tokens(title: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Distinct capitalised words of three letters or more, without stop words."""
    words = F.array_distinct(F.regexp_extract_all(F.upper(title), F.lit("[A-Z][A-Z0-9]+"), F.lit(0)))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*(stop_words or ("",))))


def role_families(titles: DataFrame, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """`titles` has title and n; each title goes to the rarest of its selected tokens.

    Selected are the tokens of most titles, then the most frequent ones of
    titles that these do not cover. What is broadcast is at most 36 tokens.
    """
    tokens = titles.select("title", "n", F.explode_outer(title_tokens(F.col("title"), stop_words)).alias("token"))
    stats = tokens.where("token IS NOT NULL").groupBy("token").agg(
        F.count("*").alias("titles"), F.sum("n").alias("employees"))
    common = stats.orderBy(F.desc("titles"), F.desc("employees"), "token").limit(COMMON_TOKENS)
    marked = tokens.join(F.broadcast(common.select("token", F.lit(True).alias("common"))), "token", "left")
    covered = marked.groupBy("title").agg(F.coalesce(F.bool_or("common"), F.lit(False)).alias("covered"))
    left = tokens.join(covered.where("NOT covered").select("title"), "title", "left_semi").where("token IS NOT NULL")
    more = left.groupBy("token").agg(F.sum("n").alias("uncovered")).join(stats, "token").orderBy(
        F.desc("uncovered"), F.desc("titles"), "token").limit(MORE_TOKENS)
    chosen = common.select("token").union(more.select("token")).distinct()
    stats = stats.join(F.broadcast(chosen), "token", "left_semi")
    best = Window.partitionBy("title").orderBy(F.asc_nulls_last("titles"), F.desc("employees"), "token")
    family = tokens.join(F.broadcast(stats), "token", "left").withColumn(
        "token", F.when(F.col("titles").isNotNull(), F.col("token"))).withColumn("rn", F.row_number().over(best)).where("rn = 1")
    return family.groupBy(F.lower(F.coalesce("token", F.lit(GENERAL))).alias("family")).agg(
        F.sum("n").alias("employees"), F.array_sort(F.collect_set("title")).alias("titles"))


def fill_rules(candidates: DataFrame, taken: int, target: int = 50) -> DataFrame:
    """Candidates by count, then key, as many as bring a domain to its target."""
    return candidates.orderBy(F.desc("n"), "key").limit(max(0, target - taken))


def domain_rules(facts: DataFrame, keys: list[str], primary: int, target: int = 50) -> DataFrame:
    """One primary rule per value of the first key, then combinations up to the target, with falling priorities."""
    head = facts.where(F.col(keys[0]).isNotNull()).groupBy(keys[0]).agg(F.count("*").alias("n")).select(
        F.col(keys[0]).alias("key"), "n", F.lit(primary).alias("priority"))
    pairs = None
    for depth in range(2, len(keys) + 1):
        own = keys[:depth]
        part = facts.na.drop(subset=own).groupBy(*own).agg(F.count("*").alias("n")).select(
            F.concat_ws("|", *own).alias("key"), "n", F.lit(primary - 40 * (depth - 1)).alias("priority"))
        pairs = part if pairs is None else pairs.unionByName(part)
    rest = pairs.orderBy(F.desc("n"), "key").limit(target)
    every = head.withColumn("first", F.lit(0)).unionByName(rest.withColumn("first", F.lit(1)))
    return every.orderBy("first", F.desc("n"), "key").limit(target).drop("first")


# What each domain is derived from. A primary or candidate is the prefix of its rule keys, the facts that
# it combines, and its priority; `top_status` stands for the most frequent status of the first fact's value.
DOMAINS = {
    "department": (
        (("dept-primary", ("department",), 400),),
        (("dept-cohort", ("cohort",), 320), ("dept-location", ("department", "location"), 280),
         ("dept-employment-type", ("department", "employment_type"), 260), ("dept-status", ("department", "employment_status"), 240),
         ("dept-job-title", ("department", "job_title"), 220))),
    "location": (
        (("location-primary", ("location",), 300), ("workplace-general-status", ("employment_status",), 100)),
        (("location-employment-type", ("location", "employment_type"), 240), ("location-status", ("location", "employment_status"), 220),
         ("location-department", ("location", "department"), 200), ("location-job-title", ("location", "job_title"), 180),
         ("location-pay-basis", ("location", "pay_basis"), 160))),
    "employment": (
        (("compensation-employment-primary", ("employment_type",), 400),),
        (("compensation-pay-basis", ("pay_basis",), 320), ("compensation-employment-status", ("employment_type", "employment_status"), 280),
         ("compensation-pay-status", ("pay_basis", "employment_status"), 260), ("compensation-employment-location", ("employment_type", "location"), 240),
         ("compensation-pay-location", ("pay_basis", "location"), 220), ("compensation-employment-department", ("employment_type", "department"), 200))),
    "role": (
        (("role-primary", ("family",), 400),),
        (("role-status", ("family", "top_status"), 300), ("role-department", ("family", "department"), 260),
         ("role-location", ("family", "location"), 240), ("role-employment-type", ("family", "employment_type"), 220))),
    "tenure": (
        (("tenure-primary", ("tier",), 400),),
        (("tenure-employment-type", ("tier", "employment_type"), 280), ("tenure-status", ("tier", "employment_status"), 260),
         ("tenure-location", ("tier", "location"), 240), ("tenure-department", ("tier", "department"), 220),
         ("tenure-pay-basis", ("tier", "pay_basis"), 200))),
    "cross": (
        (("cross-rule-group-status", ("cohort", "top_status"), 300),),
        (("cross-rule-location-employment", ("location", "employment_type"), 260), ("cross-rule-department-location", ("department", "location"), 250),
         ("cross-rule-department-role", ("department", "family"), 240), ("cross-rule-tenure-employment", ("tier", "employment_type"), 230),
         ("cross-rule-location-status", ("location", "employment_status"), 220))),
}
#: Rules of a domain.
RULES_PER_DOMAIN = 50


def combinations(facts: DataFrame, prefix: str, names: tuple[str, ...], priority: int) -> DataFrame:
    """One rule per observed combination: key, values, n, priority. Rows that lack a value combine nothing."""
    if "top_status" in names:
        own = [n for n in names if n != "top_status"]
        counts = facts.na.drop(subset=[*own, "employment_status"]).groupBy(*own, F.col("employment_status").alias("top_status")).agg(F.count("*").alias("n"))
        # The most frequent status, then the first by name: an aggregation, as there are few statuses.
        top = counts.groupBy(*own).agg(F.array_min(F.collect_list(F.struct((-F.col("n")).alias("m"), "top_status"))).alias("t"))
        grouped = top.select(*own, F.col("t.top_status").alias("top_status"), (-F.col("t.m")).alias("n"))
    else:
        grouped = facts.na.drop(subset=list(names)).groupBy(*names).agg(F.count("*").alias("n"))
    values = F.array(*names)
    return grouped.select(derived_key(prefix, values).alias("key"), values.alias("values"), "n", F.lit(priority).alias("priority"))


def derive_domain(facts: DataFrame, domain: str, target: int = RULES_PER_DOMAIN) -> DataFrame:
    """The domain's rules: all primaries, then candidates by count and key until the target is met.

    `facts` has a row per employee with the facts that DOMAINS names. Each
    combination is one aggregation with partial counts; what is sorted is
    combinations, cut by a top-k.
    """
    primaries, candidates = DOMAINS[domain]
    every = None
    for place, group in enumerate((primaries, candidates)):
        for prefix, names, priority in group:
            part = combinations(facts, prefix, names, priority).withColumn("place", F.lit(place))
            every = part if every is None else every.unionByName(part)
    cut = every.orderBy("place", F.desc("n"), "key").limit(target)
    return cut.select(F.lit(domain).alias("domain"), "key", "values", "n", "priority")


def blueprint(facts: DataFrame) -> DataFrame:
    """The rules of all domains."""
    out = None
    for domain in DOMAINS:
        part = derive_domain(facts, domain)
        out = part if out is None else out.unionByName(part)
    return out


def blueprint_faults(rules: DataFrame, target: int = RULES_PER_DOMAIN) -> DataFrame:
    """Domains without exactly the target's number of rules, and keys that occur twice; empty for a whole blueprint."""
    counts = rules.groupBy("domain").agg(F.count("*").alias("n")).where(F.col("n") != target).select(
        F.col("domain").alias("what"), "n")
    return counts.unionByName(rules.groupBy(F.col("key").alias("what")).agg(F.count("*").alias("n")).where("n > 1"))


def observed_facts(snap: DataFrame, families: DataFrame, day: Column, cohort_size: int = 8) -> DataFrame:
    """The snapshot's facts as DOMAINS names them: tier, role family by job title, and cohort of the largest departments."""
    title = families.select("family", F.explode("titles").alias("job_title"))
    top = cohorts(snap, "department", cohort_size).select("department", F.col("department").alias("cohort"))
    days = F.when(F.col("hire_date").isNotNull(), F.greatest(F.lit(0), F.datediff(day, F.col("hire_date"))))
    return (snap.withColumn("tier", tenure_tier(days)).join(title, "job_title", "left").join(F.broadcast(top), "department", "left"))


def semantic_fingerprint(rules: DataFrame, columns: list[str]) -> DataFrame:
    """One digest of a universe, with keys in the place of ids and no regard to order."""
    rows = F.array_sort(F.collect_list(F.sha2(F.to_json(F.struct(*columns)), 256)))
    return rules.agg(F.sha2(F.array_join(rows, "\n"), 256).alias("fingerprint"), F.count("*").alias("rules"))
