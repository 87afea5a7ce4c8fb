"""Rules written in policy text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How thresholds are worded.
AT_LEAST = r"(?:不低于|不少于|至少|达到|>=|≥)\s*(\d+(?:\.\d+)?)"
AT_MOST = r"(?:不超过|不高于|至多|<=|≤|(?:在|位于)?前)\s*(\d+(?:\.\d+)?)"
AND_ABOVE = r"(\d+(?:\.\d+)?)\s*(?:分|项|名)?以上"
AWARD_HEADING = r"(?:特|一|二|三)等奖学金"
FIELD_PATTERNS = {
    "average_score": r"(?:平均成绩|平均分|average(?:_score)?)",
    "rank": r"(?:专业排名|排名|rank)",
    "papers": r"(?:论文数|论文数量|papers?)",
    "patents": r"(?:专利数|专利数量|patents?)",
    "competitions": r"(?:竞赛数|竞赛数量|competitions?)",
    "research_total": r"(?:科研成果总数|科研成果|research)",
}
BUDGET_RULE = (r"预算(?:金额)?\s*(超过|高于|大于|不低于|不少于|至少|达到|不超过|低于|>=|<=|>|<|≥|≤)"
               r"\s*(\d+(?:\.\d+)?)\s*(万元|万|元)?")
BUDGET_OPERATORS = {
    ">": ("超过", "高于", "大于", ">"), ">=": ("不低于", "不少于", "至少", "达到", ">=", "≥"),
    "<=": ("不超过", "<=", "≤"), "<": ("低于", "<")}


def award_section(text: Column, award: Column) -> Column:
    """Text from the award name up to the next award heading; empty without the name."""
    start = F.call_function("instr", text, award)
    rest = F.substring(text, start + F.length(award), F.length(text))
    tail = F.element_at(F.split(rest, AWARD_HEADING, 2), 1)
    return F.when(start > 0, F.concat(award, tail)).otherwise(F.lit(""))


def threshold_rules(section: Column) -> Column:
    """Array of struct(field, operator, threshold) found in an award section."""
    found = []
    for field, prefix in FIELD_PATTERNS.items():
        for operator, tail in ((">=", AT_LEAST), ("<=", AT_MOST), (">=", AND_ABOVE)):
            numbers = F.regexp_extract_all(section, F.lit(rf"(?i){prefix}\s*{tail}"), F.lit(1))
            found.append(F.transform(numbers, _rule(field, operator)))
    return F.array_distinct(F.concat(*found))


def _rule(field: str, operator: str):
    return lambda number: F.struct(F.lit(field).alias("field"), F.lit(operator).alias("operator"),
                                   number.cast("double").alias("threshold"))


def has_choice(section: Column) -> Column:
    """A rule with an "or" cannot be judged term by term."""
    return section.contains("或")


def budget_rule(text: Column) -> Column:
    """Struct(operator, threshold_yuan) of the first budget rule, or null."""
    word = F.regexp_extract(text, BUDGET_RULE, 1)
    number = F.regexp_extract(text, BUDGET_RULE, 2).try_cast("double")
    unit = F.regexp_extract(text, BUDGET_RULE, 3)
    operator = None
    for op, words in BUDGET_OPERATORS.items():
        operator = F.when(word.isin(*words), op) if operator is None else operator.when(word.isin(*words), op)
    return F.when(word != "", F.struct(
        operator.alias("operator"),
        F.when(unit.isin("万元", "万"), number * 10000).otherwise(number).alias("threshold_yuan")))


def holds(actual: Column, operator: Column, threshold: Column) -> Column:
    return (F.when(operator == ">", actual > threshold).when(operator == ">=", actual >= threshold)
            .when(operator == "<", actual < threshold).when(operator == "<=", actual <= threshold))
