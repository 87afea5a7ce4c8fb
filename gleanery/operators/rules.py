"""Rules from policy text judged over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import policy

# Which fields count as which class of material.
SCORE_FIELDS = ("average_score", "rank")
RESEARCH_PARTS = ("papers", "patents", "competitions")
RESEARCH_FIELDS = (*RESEARCH_PARTS, "research_total")


def policy_conditions(policies: DataFrame, award: str) -> tuple[DataFrame, DataFrame]:
    """(conditions, ambiguity) per policy: distinct thresholds, and rules that cannot be judged."""
    section = policy.award_section(F.col("text"), F.lit(award))
    s = policies.select("policy_id", section.alias("section"))
    rules = (s.filter(~policy.has_choice(F.col("section")))
             .select("policy_id", F.explode(policy.threshold_rules(F.col("section"))).alias("r")).select("policy_id", "r.*").distinct())
    many = rules.groupBy("policy_id", "field").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("policy_id")
    choice = s.filter(policy.has_choice(F.col("section"))).select("policy_id")
    return rules, many.unionByName(choice).distinct()


def resolved_values(values: DataFrame) -> DataFrame:
    """(entity_id, field, value, conflict): agreed numbers, with the research total of three parts."""
    number = F.col("value").try_cast("double")
    base = values.withColumn("v", number).filter(F.col("v").isNotNull()).groupBy("entity_id", "field").agg(
        F.min("v").alias("low"), F.max("v").alias("high")).select(
        "entity_id", "field", F.when(F.col("low") == F.col("high"), F.col("low")).alias("value"), (F.col("low") != F.col("high")).alias("conflict"))
    parts = base.filter(F.col("field").isin(*RESEARCH_PARTS)).groupBy("entity_id").agg(
        F.count("value").alias("n"), F.sum("value").alias("value")).filter(F.col("n") == len(RESEARCH_PARTS))
    total = parts.select("entity_id", F.lit("research_total").alias("field"), "value", F.lit(False).alias("conflict"))
    return base.unionByName(total)


def eligibility(applications: DataFrame, policies: DataFrame, values: DataFrame, award: str) -> DataFrame:
    """eligible, not_eligible or insufficient_evidence per (entity_id, policy_id)."""
    conditions, unclear = policy_conditions(policies, award)
    resolved = resolved_values(values)
    seen = values.groupBy("entity_id").agg(
        F.bool_or(F.col("field").isin(*SCORE_FIELDS)).alias("scores"), F.bool_or(F.col("field").isin(*RESEARCH_FIELDS)).alias("research"))
    clash = resolved.groupBy("entity_id").agg(F.bool_or("conflict").alias("clash"))
    tested = applications.join(conditions, "policy_id").join(resolved.select("entity_id", "field", "value"), ["entity_id", "field"], "left").groupBy(
        "entity_id", "policy_id").agg(
        F.count(F.lit(1)).alias("conditions"), F.count_if(F.col("value").isNull()).alias("unknown"),
        F.count_if(policy.holds(F.col("value"), F.col("operator"), F.col("threshold"))).alias("passed"))
    j = (applications.join(tested, ["entity_id", "policy_id"], "left").join(seen, "entity_id", "left").join(clash, "entity_id", "left")
         .join(unclear.withColumn("unclear", F.lit(True)), "policy_id", "left"))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    missing = F.array_compact(F.array(
        F.when(no("scores"), "scores"), F.when(no("research"), "research"), F.when(F.col("conditions").isNull(), "rules"),
        F.when(~no("clash"), "conflicting values"), F.when(~no("unclear"), "ambiguous rules"), F.when(F.col("unknown") > 0, "field values")))
    return j.select(
        "entity_id", "policy_id", F.coalesce("conditions", F.lit(0)).alias("conditions"), F.coalesce("passed", F.lit(0)).alias("passed"),
        F.when(F.size(missing) > 0, "insufficient_evidence").when(F.col("passed") == F.col("conditions"), "eligible").otherwise("not_eligible").alias("conclusion"),
        F.array_join(missing, ",").alias("missing"))


def threshold_approval(rows: DataFrame, policies: DataFrame, threshold: float, ten_thousands: bool = False) -> DataFrame:
    """Rows (project, budget) above a threshold, judged by the first budget rule found.

    Without a rule the decision is null and the status insufficient_evidence.
    """
    found = policies.select("policy_id", policy.budget_rule(F.col("text")).alias("r")).filter("r is not null")
    rule = found.agg(F.min_by("r", "policy_id").alias("r")).scalar()
    over = rows.filter(F.col("budget") > threshold).withColumn("r", rule)
    limit = F.col("r.threshold_yuan") / (10_000 if ten_thousands else 1)
    return over.select(
        "project", "budget", F.col("r.operator").alias("operator"), limit.alias("rule_threshold"),
        policy.holds(F.col("budget"), F.col("r.operator"), limit).alias("requires_special_approval"),
        F.when(F.col("r").isNull(), "insufficient_evidence").otherwise("found").alias("status"))
