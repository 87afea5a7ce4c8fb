"""Where a request should look, which domain it belongs to, and how large it is."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import strip

# Signal words, weights and patterns of the routing rules.
URL = r"(?i)https?://[^\s<>'\"，。；]+"
LOCAL_SIGNALS = ("上传", "本地", "知识库", "材料", "这份文档", "该文档", "论文", "附件")
WEB_SIGNALS = ("联网", "网页", "互联网", "网上", "网络", "在线", "官网", "公开信息",
               "最新", "今日", "当前政策", "新闻", "实时", "天气")
BOTH_SIGNALS = ("结合本地", "结合材料", "对照材料", "本地和网页", "本地与网页", "材料和最新",
                "结合网上", "结合网络", "结合在线")
NETWORK_DENIAL = (
    r"(?i)(?:不(?:要|用|需(?:要)?|必)?|禁止|严禁|无需|勿)\s*"
    r"(?:联网|上网|(?:访问|抓取|读取|搜索|查询|查阅|查)\s*(?:网页|网站|互联网|网络|网上))"
    r"|\b(?:do\s+not|don't|never|no)\s+(?:browse|browsing|web\s+search|internet\s+access)\b"
    r"|\b(?:offline|local\s+(?:files?\s+)?only)\b")
LOCAL_ONLY = (
    r"(?:^|[，。；;！!\n\s])(?:请你|请)?(?:仅|只)(?:能|允许)?\s*"
    r"(?:使用|用|依据|根据|查询|分析|读取|检索|处理|参考)?\s*(?:本地|上传|知识库|附件)")
REPORT = r"(?i)(?:生成|撰写|编写|制作|输出).{0,12}报告|(?:write|generate|produce)\s+(?:a\s+)?report"
BULK = r"(?i)(?:\d{2,}|[十百千万])\s*(?:份|个|篇|files|documents)|批量|所有材料|全部材料"
OPERATION_WORDS = ("分析", "比较", "对比", "总结", "检索", "汇总", "研究")
PERSON_TERMS = {"学生": 2, "学号": 4, "成绩": 2, "专业排名": 3, "科研": 2, "奖学金": 4,
                "综合评价": 3, "综合分析": 2, "姓名": 2, "班级": 1, "年级": 1}
GENERAL_TERMS = {"项目": 2, "预算": 3, "合同": 2, "发票": 2, "库存": 2, "供应商": 2,
                 "管理办法": 2, "审批": 2, "报告": 1, "文件": 1}
PERSON_ID = r"(?i)(?<![A-Za-z0-9])S\d{2,}(?![A-Za-z0-9])"
SURNAMES = ("赵钱孙李周吴郑王冯陈褚卫蒋沈韩杨朱秦许何吕施张孔曹严华金魏陶姜谢邹彭鲁韦马方任袁柳唐薛雷贺倪汤"
            "罗郝安顾孟黄萧姚邵汪毛戴宋庞熊舒项董梁杜贾江郭梅林钟徐高夏蔡田樊胡霍万卢莫石崔龚程陆叶黎乔谭申刘邓曾")
PERSON_REQUEST = (
    r"(?:综合分析|查询一个不存在的|查找学生?)\s*[一-鿿]{2,4}[？?]?$"
    r"|查询\s*[" + SURNAMES + r"][一-鿿]{1,2}[？?]?$")
TASK_SIGNALS = {
    "write": ("写入", "写进", "追加", "修改", "保存到"),
    "compare": ("比较", "对比", "差异", "高于", "低于"),
    "rule_check": ("判断", "是否符合", "是否需要", "条件", "资格", "审批"),
    "summarize": ("总结", "摘要", "概括", "归纳"),
    "workflow": ("然后", "并根据", "再根据", "依次", "批量"),
    "query": ("查询", "查找", "找出", "列出", "多少", "哪些"),
}
TASK_PRIORITY = ("rule_check", "compare", "summarize", "query")


def any_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def count_of(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def weight_of(text: Column, weights: dict[str, int]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") * n for w, n in weights.items()])


def source_route(message: Column) -> Column:
    """Struct(strategy, reason_code, urls). A wish to stay offline beats everything."""
    text = strip(message)
    urls = F.regexp_extract_all(text, F.lit(URL), F.lit(0))
    offline = text.rlike(NETWORK_DENIAL) | text.rlike(LOCAL_ONLY)
    local, web = any_of(text, LOCAL_SIGNALS), any_of(text, WEB_SIGNALS)
    both = any_of(text, BOTH_SIGNALS) | (local & web)

    def route(strategy, reason):
        return F.struct(F.lit(strategy).alias("strategy"), F.lit(reason).alias("reason_code"))

    choice = (F.when(offline, route("LOCAL", "EXPLICIT_LOCAL_ONLY_RESTRICTION"))
              .when(F.size(urls) > 0, route("DIRECT_URL", "EXPLICIT_DIRECT_URL"))
              .when(both, route("BOTH", "EXPLICIT_LOCAL_AND_WEB_SIGNALS"))
              .when(web, route("WEB", "EXPLICIT_WEB_OR_FRESH_INFORMATION"))
              .when(local, route("LOCAL", "EXPLICIT_LOCAL_DOCUMENT_SIGNAL"))
              .otherwise(route("LOCAL", "SAFE_LOCAL_DEFAULT")))
    return F.struct(choice["strategy"].alias("strategy"), choice["reason_code"].alias("reason_code"),
                    F.when(choice["strategy"] == "DIRECT_URL", urls)
                    .otherwise(F.array().cast("array<string>")).alias("urls"))


def complexity_route(message: Column) -> Column:
    """Struct(async_required, reason_codes, strategy, predicted_calls)."""
    text = strip(message)
    strategy = source_route(message)["strategy"]
    bulk, operations = text.rlike(BULK), count_of(text, OPERATION_WORDS)
    calls = (F.lit(1) + operations + F.when(strategy == "BOTH", 2).otherwise(0)
             + F.when(bulk, 3).otherwise(0))
    reasons = F.array_compact(F.array(
        F.when(text.rlike(REPORT), "EXPLICIT_REPORT"), F.when(bulk, "BULK_INPUT"),
        F.when(strategy == "BOTH", "CROSS_SOURCE"),
        F.when((calls >= 4) | ((F.length(text) >= 500) & (operations >= 2)), "MULTI_STEP")))
    return F.struct(
        (F.size(reasons) > 0).alias("async_required"),
        F.when(F.size(reasons) > 0, reasons).otherwise(F.array(F.lit("SIMPLE_REQUEST"))).alias("reason_codes"),
        strategy.alias("strategy"), calls.alias("predicted_calls"))


def task_type(text: Column) -> Column:
    scores = {k: count_of(text, words) for k, words in TASK_SIGNALS.items()}
    others = reduce(lambda a, b: a + b, [s for k, s in scores.items() if k != "workflow"])
    best = F.greatest(*[scores[k] for k in TASK_PRIORITY])
    out = (F.when(scores["write"] > 0, "write")
           .when((scores["workflow"] > 0) & (others > 0), "workflow")
           .when((others + scores["workflow"]) == 0, "query"))
    for kind in TASK_PRIORITY:
        out = out.when(scores[kind] == best, kind)
    return out


def domain_route(message: Column, person_hits: int = 0, general_hits: int = 0, has_files: bool = False) -> Column:
    """Struct(domain, effective_domain, task_type, reason_code).

    ``person_hits`` and ``general_hits`` are the weights that table columns and
    requested tools add.
    """
    text = strip(message)
    by_id = text.rlike(PERSON_ID)
    person = (weight_of(text, PERSON_TERMS) + F.when(by_id, 6).otherwise(0)
              + F.when(text.rlike(PERSON_REQUEST), 4).otherwise(0) + person_hits)
    general = weight_of(text, GENERAL_TERMS) + general_hits + int(has_files)

    def route(domain, reason):
        return F.struct(F.lit(domain).alias("domain"), reason.alias("reason_code"))

    choice = (F.when((person == 0) & (general == 0), route("unknown", F.lit("NO_DOMAIN_SIGNAL_GENERAL_FALLBACK")))
              .when((person > 0) & (general > 0) & (F.abs(person - general) <= 2),
                    route("unknown", F.lit("AMBIGUOUS_DOMAIN_SIGNALS_GENERAL_FALLBACK")))
              .when(person > general, route("student", F.when(by_id, "STUDENT_STRUCTURAL_ID_SIGNAL")
                                            .otherwise("STUDENT_SCHEMA_OR_TASK_SIGNAL")))
              .otherwise(route("general", F.lit("GENERAL_SCHEMA_OR_TASK_SIGNAL"))))
    return F.struct(choice["domain"].alias("domain"),
                    F.when(choice["domain"] == "student", "student").otherwise("general").alias("effective_domain"),
                    task_type(text).alias("task_type"), choice["reason_code"].alias("reason_code"))
