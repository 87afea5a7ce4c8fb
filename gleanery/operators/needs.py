"""Information needs: decomposition, sufficiency, rewriting, and bounded retrieval rounds.

All tasks advance together; one round is one set of joins over every open need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions import ids
from gleanery.functions import text as tx
from gleanery.functions.routes import any_of, count_of
from gleanery.operators.ranking import first_per_key
from gleanery.operators.retrieval import chunk_vectors, hybrid_retrieve
from gleanery.operators.storage import settle

# Signals of complex requests, clause marks, suffixes and limits.
COMPLEX_SIGNALS = ("并根据", "然后", "分别", "综合", "比较", "对比", "判断", "是否符合", "是否需要", "规则", "资格", "冲突", "跨文件", "多个文件")
CLAUSE_MARK = r"(?:，?并根据|，?然后|；|;|，同时|，以及|，并且)"
RULE_TERMS, COMPARE_TERMS = ("规则", "办法", "资格", "条件", "审批"), ("比较", "对比", "差异")
POLICY_SUFFIXES = ("评审办法", "相关规定", "实施办法", "管理办法")
FIRST_PRIZE = "一等奖学金"
CONTROL_WORDS = ("结合本地", "结合材料", "对照材料", "本地和网页", "本地与网页", "材料和最新", "联网", "网页", "互联网")
LOW_CONFIDENCE = 0.70
FIELD_NAME = r"^[A-Za-z_][A-Za-z0-9_]{0,63}$"


def clauses(message: Column) -> Column:
    parts = F.transform(F.split(message, CLAUSE_MARK), lambda p: F.regexp_replace(p, r"^[ ，。]+|[ ，。]+$", ""))
    return F.filter(parts, lambda p: p != "")


def is_complex(message: Column) -> Column:
    signals = count_of(message, COMPLEX_SIGNALS)
    spoken = F.size(F.filter(F.split(message, CLAUSE_MARK), lambda p: tx.strip(p) != ""))
    return (signals >= 1) & ((spoken >= 2) | (signals >= 2))


def need_decompose(requests: DataFrame, domain: str = "general") -> DataFrame:
    """The needs of each complex request (request_id, message), with type, year and id."""
    text = tx.strip(F.col("message"))
    rows = requests.withColumn("text", text).filter(is_complex(F.col("text")))
    parts = clauses(F.col("text"))
    parts = F.when(F.size(parts) == 1, F.array("text")).otherwise(parts)
    year = F.nullif(F.regexp_extract("text", r"(?<!\d)(20\d{2})\s*年?", 1), F.lit(""))
    flat = rows.select("request_id", year.alias("year"), F.posexplode(parts).alias("p", "clause"))
    scope = F.concat(F.lit('{"file_id":null,"file_ids":null,"file_type":null,"page":null,"slide":null,"year":'), F.coalesce("year", F.lit("null")),
                     F.lit(',"student_id":null,"document_metadata":null}'))
    key = F.concat(F.lit(domain + ":"), (F.col("p") + 1).cast("string"), F.lit(":"), "clause", F.lit(":"), scope)
    kind = F.when(any_of(F.col("clause"), RULE_TERMS), "rule").when(any_of(F.col("clause"), COMPARE_TERMS), "comparison").otherwise(
        "student_fact" if domain == "student" else "general_fact")
    return flat.select(
        "request_id", (F.col("p") + 1).alias("need_no"), F.concat(F.lit("need-"), F.substring(F.sha2(key, 256), 1, 12)).alias("need_id"),
        kind.alias("need_type"), F.col("clause").alias("name"), F.col("clause").alias("query"), F.col("year").cast("int").alias("year"))


def need_sufficiency(needs: DataFrame, evidence: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Status of each need (need_id, required_terms, minimum_evidence) over its evidence.

    evidence: need_id, evidence_id, position, text, confidence, review_required, conflict.
    """
    once = first_per_key(evidence.select("need_id", "evidence_id", "position", "text", "confidence", "review_required", "conflict"),
                         ["need_id", "evidence_id"], F.col("position"))
    low = F.coalesce("review_required", F.lit(False)) | F.coalesce(F.col("confidence") < threshold, F.lit(False))
    rows = once.withColumn("low", low).join(needs.select("need_id", "required_terms"), "need_id")
    counts = rows.groupBy("need_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or(F.coalesce("conflict", F.lit(False))).alias("conflict"),
        F.count_if(~F.col("low")).alias("safe"), F.bool_or("low").alias("any_low"))
    seen = (rows.filter("not low").select("need_id", "text", F.explode("required_terms").alias("term"))
            .filter(F.col("text").contains(F.col("term"))).groupBy("need_id", "term").agg(F.count(F.lit(1)).alias("c"))
            .groupBy("need_id").agg(F.collect_set("term").alias("seen")))
    j = needs.join(counts, "need_id", "left").join(seen, "need_id", "left")
    lacking = F.array_except("required_terms", F.coalesce("seen", F.array().cast("array<string>")))
    status = (F.when(F.col("n").isNull(), "missing").when(F.col("conflict"), "conflict")
              .when((F.col("safe") >= F.col("minimum_evidence")) & (F.size(lacking) == 0), "sufficient")
              .when(F.col("any_low"), "low_confidence").otherwise("partial"))
    return j.select(*needs.columns, status.alias("status"), F.coalesce("n", F.lit(0)).alias("evidence_count"),
                    F.when(status.isin("conflict", "sufficient"), F.array().cast("array<string>")).otherwise(lacking).alias("missing_terms"))


def rewrite(query: Column, name: Column, description: Column, round_no: int, missing: Column, given: Column | None = None) -> Column:
    """Query of a round: as is, then given rewrites or fixed suffixes, then none."""
    if round_no <= 1:
        return query
    extra = F.array_join(missing, " ")
    fixed = F.lit(None).cast("string")
    if round_no == 2:
        fixed = tx.collapse_space(F.concat(query, F.lit(" 补充证据 "), F.when(extra != "", extra).otherwise(name)))
    elif round_no == 3:
        fixed = tx.collapse_space(F.concat(query, F.lit(" 交叉核验 "), description))
    return fixed if given is None else F.coalesce(F.get(given, F.lit(round_no - 2)), fixed)


def retry_queries(query: Column) -> Column:
    """At most two other forms of a lone search without hits."""
    plain = reduce(lambda q, s: F.replace(q, F.lit(s), F.lit("")), POLICY_SUFFIXES, query)
    plain = F.regexp_replace(plain, r"^[ ，。；;：:]+|[ ，。；;：:]+$", "")
    first = F.when((plain != "") & (plain != query), plain)
    prize = F.when(query.contains(FIRST_PRIZE) & ~F.coalesce(first == FIRST_PRIZE, F.lit(False)), FIRST_PRIZE)
    return F.slice(F.array_compact(F.array(first, prize)), 1, 2)


def source_query(query: Column, round_no: int, missing: Column) -> Column:
    """Query form of a cross-source round."""
    clean = tx.collapse_space(query)
    if round_no <= 1:
        return clean
    base = tx.collapse_space(reduce(lambda q, w: F.replace(q, F.lit(w), F.lit(" ")), CONTROL_WORDS, clean))
    base = F.when(base != "", base).otherwise(clean)
    if round_no == 2:
        return tx.collapse_space(F.concat_ws(" ", base, F.array_join(missing, " ")))
    return tx.collapse_space(F.concat(base, F.lit(" 官方 原文"))) if round_no == 3 else F.lit(None).cast("string")


def _filled_fields(chunks: DataFrame) -> Column:
    """Names of the fields that a chunk's evidence has a value for: its columns, and the keys of a ``metadata`` map."""
    def filled(kind: str, value: Column) -> Column:
        empty = (value == "") if kind == "string" else (F.size(value) == 0) if kind.startswith("array") else F.lit(False)
        return value.isNotNull() & ~F.coalesce(empty, F.lit(False))

    names = {c: (F.col(f"`{c}`"), k) for c, k in chunks.dtypes if c not in ("chunk_text", "metadata")} | {"content": (F.col("chunk_text"), "string")}
    own = F.array_compact(F.array(F.lit("evidence_id"), *[F.when(filled(k, value), c) for c, (value, k) in names.items()]))
    if dict(chunks.dtypes).get("metadata") != "map<string,string>":
        return own
    # a field of the evidence itself hides a key of the same name
    keys = F.filter(F.map_keys(F.map_filter("metadata", lambda k, v: filled("string", v) & k.rlike(FIELD_NAME))), lambda k: ~k.isin("evidence_id", *names))
    return F.concat(own, F.coalesce(keys, F.array().cast("array<string>")))


def _evidence_of(rows: DataFrame, chunks: DataFrame, asked: DataFrame) -> DataFrame:
    """Evidence rows (need_id, evidence_id, text, ...) of retrieval results, which are stored so that few of them are sent to the texts."""
    rows = settle(rows)
    meta = chunks.select("chunk_id", F.col("chunk_text").alias("text"), _filled_fields(chunks).alias("fields"),
                         *[F.col(c) if c in chunks.columns else F.lit(None).cast(k).alias(c)
                           for c, k in (("confidence", "double"), ("review_required", "boolean"), ("conflict", "boolean"), ("source", "string"))])
    j = rows.join(meta, "chunk_id").join(asked.select(F.col("need_id").alias("query_id"), "query"), "query_id")
    eid = ids.evidence_id({"chunk_id": ids.json_text(F.col("chunk_id")), "query": ids.json_text(F.col("query"))})
    return j.select(F.col("query_id").alias("need_id"), eid.alias("evidence_id"), F.col("final_position").cast("bigint").alias("position"),
                    tx.excerpt(F.col("text"), F.col("query")).alias("text"), "confidence", "review_required", "conflict", "source", "fields")


def controlled_retrieval(needs: DataFrame, chunks: DataFrame, max_rounds: int = 3, max_calls: int = 6,
                         top_k: int = 5, failures: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, needs, evidence) after bounded rounds over all open needs.

    needs: task_id, need_id, need_no, query, name, required_terms, minimum_evidence.
    The call budget of a task is spent in need order; results do not depend on time.
    ``failures`` (need_id, error_code, called) are needs whose search fails, as a call that
    counts or, not ``called``, before one is made. The first of them whose turn comes ends its
    task with stop_reason ``error``; the needs before it in the round have been searched.
    """
    if not 1 <= max_rounds <= 10:
        raise ValueError("max_rounds must be 1..10")
    spark = needs.sparkSession
    empty = F.array().cast("array<string>")
    state = settle(needs.select("*", F.lit("missing").alias("status"), F.col("required_terms").alias("missing_terms"), empty.alias("tried")))
    tasks = settle(needs.select("task_id").distinct().select("task_id", F.lit(0).cast("bigint").alias("calls"), F.lit(0).alias("rounds"),
                                                            F.lit(None).cast("string").alias("stop_reason"), F.lit(None).cast("string").alias("error_code")))
    found = spark.createDataFrame([], "need_id string, evidence_id string, position bigint, text string, confidence double, "
                                      "review_required boolean, conflict boolean, source string, fields array<string>")
    if failures is None:
        failures = spark.createDataFrame([], "need_id string, error_code string, called boolean")
    failures = failures.groupBy("need_id").agg(F.min("error_code").alias("failure"), F.max("called").alias("called"))
    vectors = settle(chunk_vectors(chunks))
    for number in range(1, max_rounds + 1):
        live = tasks.filter("stop_reason is null")
        open_ = (state.filter("status <> 'sufficient'").join(live.select("task_id", "calls"), "task_id")
                 .withColumn("q", rewrite(F.col("query"), F.col("name"), F.col("query"), number, F.col("missing_terms")))
                 .withColumn("fresh", F.coalesce(~F.array_contains("tried", F.col("q")), F.lit(False))))
        before = W.partitionBy("task_id").orderBy("need_no").rowsBetween(W.unboundedPreceding, -1)
        open_ = open_.withColumn("spent", F.col("calls") + F.coalesce(F.sum(F.col("fresh").cast("int")).over(before), F.lit(0)))
        open_ = open_.withColumn("reached", F.col("spent") < max_calls).join(failures, "need_id", "left")
        fails = F.col("reached") & F.col("fresh") & F.col("failure").isNotNull()
        halt = F.min(F.when(fails, F.struct("need_no", "failure", "called"))).over(W.partitionBy("task_id"))
        open_ = settle(open_.withColumn("halt", halt).withColumn("reached", F.col("reached") & F.coalesce(F.col("need_no") < F.col("halt.need_no"), F.lit(True))))
        asked = settle(open_.filter("reached and fresh").select("task_id", "need_id", F.col("q").alias("query")))
        rows = hybrid_retrieve(chunks, asked.select(F.col("need_id").alias("query_id"), "query"), top_k, vectors=vectors)
        current = _evidence_of(rows, chunks, asked)
        news = settle(current.join(found, ["need_id", "evidence_id"], "left_anti").withColumn("position", F.col("position") + number * 1000))
        found = found.unionByName(news)
        judged = need_sufficiency(state.join(asked, ["need_id"], "left_semi").select("need_id", "required_terms", "minimum_evidence"), found)
        verdict = judged.select("need_id", F.col("status").alias("new_status"), F.col("missing_terms").alias("new_missing"))
        state = settle(state.join(verdict, "need_id", "left").join(asked.select("need_id", F.col("query").alias("q")), "need_id", "left").select(
            *needs.columns, F.coalesce("new_status", "status").alias("status"), F.coalesce("new_missing", "missing_terms").alias("missing_terms"),
            F.when(F.col("q").isNotNull(), F.concat("tried", F.array("q"))).otherwise(F.col("tried")).alias("tried")))
        made = open_.groupBy("task_id").agg(
            F.count_if(F.col("reached") & F.col("fresh")).alias("made"), F.bool_or(~F.col("reached")).alias("cut"), F.count(F.lit(1)).alias("unresolved"),
            F.count_if(F.col("reached") & ~F.col("fresh")).alias("exhausted"), F.any_value("halt").alias("halt"))
        fresh_rows = news.join(asked.select("need_id", "task_id"), "need_id").groupBy("task_id").agg(F.count(F.lit(1)).alias("gained"))
        left = state.groupBy("task_id").agg(F.count_if(F.col("status") != "sufficient").alias("left"))
        j = tasks.join(made, "task_id", "left").join(fresh_rows, "task_id", "left").join(left, "task_id")
        calls = F.col("calls") + F.coalesce("made", F.lit(0)) + F.coalesce(F.col("halt.called"), F.lit(False)).cast("int")
        reason = (F.when(F.col("made").isNull(), "sufficient").when(F.col("halt").isNotNull(), "error").when(F.col("cut"), "budget").when(F.col("left") == 0, "sufficient")
                  .when((F.col("made") == 0) & (F.col("exhausted") == F.col("unresolved")), "scope_exhausted")
                  .when(F.lit(number > 1) & F.col("gained").isNull(), "no_new_evidence").when(calls >= max_calls, "budget"))
        if number == max_rounds:
            reason = F.coalesce(reason, F.lit("budget"))
        done = F.col("stop_reason").isNotNull()
        tasks = settle(j.select("task_id", F.when(done, F.col("calls")).otherwise(calls).alias("calls"),
                                F.when(done | F.col("made").isNull(), F.col("rounds")).otherwise(F.lit(number)).alias("rounds"),
                                F.coalesce("stop_reason", reason).alias("stop_reason"), F.coalesce("error_code", F.when(~done, F.col("halt.failure"))).alias("error_code")))
        if tasks.filter("stop_reason is null").isEmpty():
            break
    answers = state.groupBy("task_id").agg(
        F.bool_or(F.col("status") == "conflict").alias("c"), F.bool_or(F.col("status") == "low_confidence").alias("l"), F.bool_and(F.col("status") == "sufficient").alias("s"))
    tasks = tasks.join(answers, "task_id").select("task_id", "calls", "rounds", "stop_reason", F.when(F.col("c"), "conflict").when(
        F.col("l"), "low_confidence").when(F.col("s"), "confirmed").otherwise("not_found").alias("answer_status"), "error_code")
    return tasks, state.drop("tried"), found


# Order of sources per route.
SOURCE_SEQUENCE = {"LOCAL": ("LOCAL",), "WEB": ("WEB",), "BOTH": ("LOCAL", "WEB")}


def cross_source_retrieval(tasks: DataFrame, chunks: DataFrame, max_rounds: int = 3, max_calls: int = 4,
                           top_k: int = 5) -> tuple[DataFrame, DataFrame]:
    """(tasks, evidence): local and web rounds per route, until enough or nothing new.

    tasks: task_id, query, strategy, required_terms, minimum_evidence and, where wanted,
    required_fields and urls. chunks carry ``source`` LOCAL or WEB, and the fields that their
    evidence has as columns or in a ``metadata`` map. A DIRECT_URL task looks up one of its
    urls a round, by file_id; without urls its query is the URL.
    """
    if not 1 <= max_rounds <= 8:
        raise ValueError("max_rounds must be 1..8")
    spark, none = tasks.sparkSession, F.array().cast("array<string>")
    given = {c: F.coalesce(F.col(c), other) if c in tasks.columns else other for c, other in (("required_fields", none), ("urls", none))}
    given["urls"] = F.when(F.size(given["urls"]) > 0, given["urls"]).otherwise(F.array("query"))
    tasks = tasks.withColumns(given)
    lacking_all = F.array_distinct(F.concat(F.array(F.lit("minimum_evidence")), "required_fields", "required_terms"))
    state = settle(tasks.select("*", F.lit("INSUFFICIENT").alias("status"), lacking_all.alias("missing"),
                                F.array().cast("array<string>").alias("tried"), F.lit(0).alias("idle"), F.lit(0).alias("calls"),
                                F.lit(None).cast("string").alias("stop_reason")))
    found = spark.createDataFrame([], "need_id string, evidence_id string, position bigint, text string, source string, fields array<string>")
    pools = {place: chunks.filter(F.col("source") == place) for place in ("LOCAL", "WEB")}
    vectors = {place: settle(chunk_vectors(pool)) for place, pool in pools.items()}
    for number in range(1, max_rounds + 1):
        local = F.col("strategy").isin("LOCAL") | ((F.col("strategy") == "BOTH") & F.lit(number == 1))
        source = F.when(F.col("strategy") == "DIRECT_URL", F.when(F.size("urls") >= number, "URL")).when(local, "LOCAL").otherwise("WEB")
        text = F.when(F.col("strategy") == "DIRECT_URL", F.get("urls", F.lit(number - 1))).otherwise(source_query(F.col("query"), number, F.col("missing")))
        live = state.filter("stop_reason is null").withColumns({"at": source, "q": text})
        mark = F.concat_ws(":", "at", F.when(F.col("at") == "URL", F.col("q")).otherwise(F.lower("q")))
        reason = (F.when(F.col("calls") >= max_calls, "BUDGET_EXHAUSTED").when(F.col("at").isNull(), "SOURCES_EXHAUSTED")
                  .when(F.col("q").isNull(), "QUERY_EXHAUSTED").when(F.array_contains("tried", mark), "LOOP_PREVENTED"))
        live = settle(live.withColumns({"early": reason, "mark": mark}))
        news = None
        for place in ("LOCAL", "WEB", "URL"):
            asked = live.filter((F.col("at") == place) & F.col("early").isNull()).select(F.col("task_id").alias("need_id"), F.col("q").alias("query"))
            if asked.isEmpty():
                continue
            pool = pools["LOCAL" if place == "LOCAL" else "WEB"]
            if place == "URL":
                hit = asked.join(pool, asked["query"] == pool["file_id"]).select(F.col("need_id").alias("query_id"), "chunk_id", (F.col("chunk_index") + 1).alias("final_position"))
            else:
                hit = hybrid_retrieve(pool, asked.select(F.col("need_id").alias("query_id"), "query"), top_k, vectors=vectors[place]).select(
                    "query_id", "chunk_id", "final_position")
            part = _evidence_of(hit, chunks, asked).select("need_id", "evidence_id", "position", "text", "source", "fields")
            news = part if news is None else news.unionByName(part)
        news = found.limit(0) if news is None else news
        news = settle(news.join(found, ["need_id", "evidence_id"], "left_anti").withColumn("position", F.col("position") + number * 1000))
        found = found.unionByName(news)
        gained = news.groupBy(F.col("need_id").alias("task_id")).agg(F.count(F.lit(1)).alias("gained"))
        have = found.groupBy(F.col("need_id").alias("task_id")).agg(F.count_distinct("evidence_id").alias("have"))
        terms = (live.select("task_id", F.explode("required_terms").alias("term")).join(found.select(F.col("need_id").alias("task_id"), "text"), "task_id")
                 .filter(F.col("text").contains(F.col("term"))).groupBy("task_id").agg(F.collect_set("term").alias("seen")))
        fields = (live.select("task_id", F.explode("required_fields").alias("field")).join(found.select(F.col("need_id").alias("task_id"), "fields"), "task_id")
                  .filter(F.array_contains("fields", F.col("field"))).groupBy("task_id").agg(F.collect_set("field").alias("filled")))
        j = live.join(gained, "task_id", "left").join(have, "task_id", "left").join(terms, "task_id", "left").join(fields, "task_id", "left")
        lacking = F.array_distinct(F.concat(
            F.when(F.coalesce("have", F.lit(0)) < F.col("minimum_evidence"), F.array(F.lit("minimum_evidence"))).otherwise(none),
            F.array_except("required_fields", F.coalesce("filled", none)), F.array_except("required_terms", F.coalesce("seen", none))))
        ran = F.col("early").isNull()
        idle = F.when(F.col("gained").isNull(), F.col("idle") + 1).otherwise(0)
        enough = F.size(lacking) == 0
        stop = F.coalesce("early", F.when(enough, "SUFFICIENT").when(idle >= 2, "NO_NEW_EVIDENCE"))
        if number == max_rounds:
            stop = F.coalesce(stop, F.lit("BUDGET_EXHAUSTED"))
        moved = j.select(
            *tasks.columns, F.when(ran, F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT")).otherwise(F.col("status")).alias("status"),
            F.when(ran, lacking).otherwise(F.col("missing")).alias("missing"), F.when(ran, F.concat("tried", F.array("mark"))).otherwise(F.col("tried")).alias("tried"),
            F.when(ran, idle).otherwise(F.col("idle")).alias("idle"), (F.col("calls") + ran.cast("int")).alias("calls"), stop.alias("stop_reason"))
        state = settle(state.filter("stop_reason is not null").unionByName(moved))
        if state.filter("stop_reason is null").isEmpty():
            break
    return state.select("task_id", "strategy", "status", "calls", "stop_reason", F.array_join("missing", ",").alias("missing")), found
