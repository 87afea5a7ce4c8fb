"""Canonical meaning of a column name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import norm_field_name

# Column names whose meaning is known, and names that stay unknown.
UNKNOWN_NAMES = ("编号", "代码", "类型", "备注")
ALIASES = {
    "student_id": ("学号", "学生学号", "studentid"),
    "name": ("姓名", "学生姓名", "name"),
    "college": ("学院", "所属院系"),
    "phone": ("联系电话", "移动电话", "手机号", "手机"),
    "email": ("邮箱", "email"),
    "grade": ("年级", "所在年级"),
    "class": ("班级", "所在班级"),
}
SENSITIVE_ALIASES = {
    "id_card": ("身份证", "身份证号", "idcard", "nationalid"),
    "address": ("地址", "家庭地址", "住址", "address"),
    "passport": ("护照", "护照号", "passport"),
    "bank_account": ("银行卡", "银行账号", "bankaccount"),
}
DATE_TOKENS = ("日期", "时间", "date", "time")
SCORE_TOKENS = ("成绩", "分数", "score", "平均分")
SENSITIVE_NAMES = ("student_id", "name", "phone", "email", "id_card", "address", "passport", "bank_account")
ALIAS_CONFIDENCE, SENSITIVE_CONFIDENCE, DATE_CONFIDENCE, SCORE_CONFIDENCE = 0.99, 0.96, 0.82, 0.84


def field_semantics(source_name: Column) -> Column:
    """Struct(canonical_name, mapping_confidence, sensitive) for a column of names."""
    key = norm_field_name(source_name)

    def has(tokens):
        hit = F.lit(False)
        for token in tokens:
            hit = hit | key.contains(token)
        return hit

    rules = [(key.isin(*UNKNOWN_NAMES), None, 0.0)]
    rules += [(key.isin(*names), canonical, ALIAS_CONFIDENCE) for canonical, names in ALIASES.items()]
    rules += [(key.isin(*names), canonical, SENSITIVE_CONFIDENCE) for canonical, names in SENSITIVE_ALIASES.items()]
    rules += [(has(DATE_TOKENS), "date", DATE_CONFIDENCE), (has(SCORE_TOKENS), "score", SCORE_CONFIDENCE)]
    out = None
    for test, canonical, confidence in rules:
        value = F.struct(F.lit(canonical).cast("string").alias("canonical_name"),
                         F.lit(confidence).alias("mapping_confidence"),
                         F.lit(canonical in SENSITIVE_NAMES).alias("sensitive"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("canonical_name"),
                                  F.lit(0.0).alias("mapping_confidence"), F.lit(False).alias("sensitive")))


def semantics_columns(source_name: Column) -> list[Column]:
    s = field_semantics(source_name)
    return [s["canonical_name"].alias("canonical_name"),
            F.coalesce(s["canonical_name"], F.lit("unknown")).alias("semantic_type"),
            s["mapping_confidence"].alias("mapping_confidence"), s["sensitive"].alias("sensitive")]
