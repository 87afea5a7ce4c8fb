"""Labels for instruction-like text and for key fields in recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label names and their patterns, all case-insensitive.
WEB_PATTERNS = (
    ("INSTRUCTION_OVERRIDE",
     r"ignore\s+(?:all\s+)?(?:previous|prior|above|system)?\s*(?:instructions?|rules?)"
     r"|忽略(?:之前|以上|所有)?(?:的)?(?:系统)?(?:指令|规则)"),
    ("SYSTEM_PROMPT_REFERENCE", r"\bsystem\s+prompt\b|系统提示(?:词|语)?"),
    ("TOOL_EXECUTION_INSTRUCTION",
     r"\b(?:execute|run|call|invoke)\s+(?:a\s+|the\s+)?(?:tool|function|command)\b"
     r"|执行(?:这个|以下|任意)?(?:工具|函数|命令)|调用(?:工具|函数)"),
    ("TOOL_PERMISSION_OVERRIDE",
     r"(?:enable|allow|grant|change|override)\s+(?:all\s+)?tool(?:s|\s+permissions?)?"
     r"|(?:启用|允许|授予|修改|覆盖)(?:所有)?工具(?:权限)?"),
    ("DANGEROUS_TOOL_NAME", r"\b(?:delete_file|write_word|rollback_word|undo_word|reindex_document)\b"),
)
VISUAL_PATTERNS = (
    ("POLICY_OVERRIDE_TEXT",
     r"忽略(?:之前|以上|所有)?(?:的)?(?:系统)?规则|ignore\s+(?:all\s+)?(?:system\s+)?(?:rules|instructions)"),
    ("TOOL_NAME_TEXT", r"\b(?:delete_file|write_word|rollback_word|undo_word|reindex_document)\b"),
    ("TOOL_CALL_JSON_TEXT", r"[\{\[]\s*[\"']?(?:tool|function|tool_call)[\"']?\s*:"),
    ("FAKE_CONFIRMED_TEXT", r"\bconfirmed\s*=\s*true\b|[\"']confirmed[\"']\s*:\s*true"),
    ("FAKE_APPROVAL_TEXT",
     r"fake\s*approval|伪造(?:的)?审批|审批已通过|approval\s*[:=]\s*[\"']?(?:approved|true)[\"']?"),
    ("SCREENSHOT_COMMAND_TEXT",
     r"screenshot\s+(?:command|cmd)|截图命令|点击(?:此)?按钮执行|扫码(?:执行|确认)|QR\s*(?:command|button)"),
)
KEY_FIELD_PATTERNS = (
    ("student_id", r"(?:学号|学生编号)\s*[:：]?\s*[A-Za-z0-9-]+"),
    ("phone", r"(?:电话|手机|联系方式)\s*[:：]?\s*[0-9*+()\s-]{6,}"),
    ("amount", r"(?:金额|费用|合计)\s*[:：]?\s*[¥￥]?\s*[0-9,.]+"),
    ("date", r"(?:日期|时间)\s*[:：]?\s*[0-9年月日./-]+"),
    ("name", r"(?:姓名|名字)\s*[:：]?\s*[^\s,，;；]{1,20}"),
)
LOW_CONFIDENCE = 0.70


def _labels(text: Column, patterns) -> Column:
    found = F.array_compact(F.array(*[
        F.when(text.rlike("(?i)" + pattern), F.lit(code)) for code, pattern in patterns]))
    # most texts match nothing: one pass tells, before a pass per pattern
    any_of_them = "(?i)" + "|".join(f"(?:{pattern})" for _, pattern in patterns)
    return F.when(text.rlike(any_of_them), found).otherwise(F.array().cast("array<string>"))


def injection_labels_web(text: Column) -> Column:
    """Codes of instruction-like passages; the text itself is left alone."""
    return _labels(text, WEB_PATTERNS)


def injection_labels_visual(text: Column) -> Column:
    return _labels(text, VISUAL_PATTERNS)


def visual_review(text: Column, confidence: Column, asked: Column) -> Column:
    """Whether recognised text needs a reviewer."""
    return ((F.size(injection_labels_visual(text)) > 0) | F.coalesce(asked, F.lit(False))
            | F.coalesce(confidence < LOW_CONFIDENCE, F.lit(False)))


def key_field_type(text: Column) -> Column:
    out = None
    for name, pattern in KEY_FIELD_PATTERNS:
        test = text.rlike("(?i)" + pattern)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out
