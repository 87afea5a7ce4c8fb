"""Evidence records: validity, upgrade, conflicts, claims, the delivery gate, location.

Evidence rows belong to a draft: draft_id, evidence_id, position, source_type, file_id,
file_name, chunk_id, page_no, table, cell, sheet, field, record_key, url, domain,
retrieved_at, content, value, year, evidence_version, conflict.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import ids
from gleanery.functions import text as tx
from gleanery.functions.urls import host
from gleanery.operators.ranking import first_per_key, top_n
from gleanery.operators.containment import containment
from gleanery.operators.storage import settle

# Citation form, words of time-sensitive questions, and size notes.
CITATION = r"\[(?:evidence:)?([A-Za-z0-9_-]{1,128})\]"
TIME_SENSITIVE = r"(?i)当前|最新|今日|今天|实时|目前|\b(?:current|latest|today|up.to.date)\b"
LIST_MARK = r"^\s*(?:[-*+]\s+|\d+[.)]\s+)"
MANY_EVIDENCE, LONG_DRAFT, MANY_CLAIMS = 1000, 100_000, 200
WEB_TYPES = ("WEB", "URL")
#: Warnings that records give by themselves.
RECORD_CODES = ("EVIDENCE_INVALID", "LOCATION_MISSING", "SOURCE_INCOMPLETE", "FRESHNESS_MISSING", "FRESHNESS_INVALID", "EVIDENCE_CONFLICT")


def filled(*columns: Column) -> Column:
    # one look at each column: derived ones are worked out anew for every mention
    return reduce(lambda a, b: a & b, [F.coalesce(c.cast("string").rlike(r"(?U)\S"), F.lit(False)) for c in columns])


def evidence_valid(e: DataFrame) -> Column:
    """Required marks of a record by its source type."""
    local = filled(F.col("file_id"), F.col("file_name"), F.col("legacy_source_type")) & (F.col("freshness") == "not_applicable")
    web = (filled(F.col("url"), F.col("domain"), F.col("retrieved_at")) & (F.col("trust_level") == "untrusted_web_data")
           & ~F.coalesce(F.col("has_authority"), F.lit(False)))
    return F.coalesce(F.when(F.col("source_type") == "LOCAL", local).when(F.col("source_type").isin(*WEB_TYPES), web), F.lit(False))


def upgrade(old: DataFrame) -> DataFrame:
    """Locator type, status, content and validity of an old record."""
    name = F.lower(F.coalesce("file_name", F.lit("")))
    cell_box = F.col("table").isNotNull() & F.col("cell").isNotNull() & F.col("has_box")
    locator = F.when(F.col("source_type") == "structured", "excel").when(cell_box, "visual_table").when(
        F.col("recognition_type") == "handwritten", "handwriting").when(F.col("image_no").isNotNull(), "image").when(
        name.endswith(".pdf"), F.when(F.col("region_id").isNotNull() | F.col("has_box"), "visual_pdf").otherwise("text_pdf"))
    for endings, kind in (((".doc", ".docx"), "word"), ((".ppt", ".pptx"), "presentation"), ((".txt",), "txt"), ((".json",), "json"), ((".csv",), "csv")):
        locator = locator.when(reduce(lambda a, b: a | b, [name.endswith(x) for x in endings]), kind)
    status = F.when(F.col("conflict"), "conflict").when(F.col("review_required"), "review_required").otherwise(F.col("evidence_status"))
    body = tx.strip(F.coalesce(F.nullif("content", F.lit("")), F.nullif("text_excerpt", F.lit("")), F.nullif("value_summary", F.lit("")), F.lit("")))
    located = F.when(F.col("source_type") == "structured",
                     (F.col("table").isNotNull() & F.col("cell").isNotNull()) | filled(F.col("sheet"), F.col("field"), F.col("record_key"))).otherwise(
        F.coalesce("block_id", "chunk_id").isNotNull() | (F.col("region_id").isNotNull() & F.col("has_box")) | cell_box)
    return old.select(
        "evidence_id", F.coalesce("locator_type", locator).alias("locator_type"), status.alias("evidence_status"), body.alias("content"),
        (F.col("review_required") | F.col("conflict")).alias("review_required"),
        (tx.not_blank(F.col("file_id")) & F.coalesce(located, F.lit(False)) & (body != "")).alias("valid"))


def value_conflicts(e: DataFrame) -> DataFrame:
    """Rows whose value differs from some value on the other side, local or web, of the same key.

    Whether a differing value exists is told by the least and greatest value of the
    other side, so the rows are never paired, and shuffled once. Values of another year, period or unit are
    not compared; ``period`` and ``unit`` may be absent.
    """
    key = ["draft_id", "field", "record_key", "year", "period", "unit"]
    e = e.withColumns({k: F.lit(None).cast("string") for k in ("period", "unit") if k not in e.columns})
    v = e.withColumn("v", tx.value_key(F.col("value"))).withColumn("local", F.col("source_type") == "LOCAL").filter(
        F.col("draft_id").isNotNull() & filled(F.col("value"), F.col("field")) & F.col("source_type").isin("LOCAL", *WEB_TYPES))
    v = v.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in ("record_key", "year", "period", "unit")})
    v = v.select("evidence_id", *key, "v", "local")
    v = v.withColumns({n: f(F.when(F.col("local") == side, F.col("v"))).over(Window.partitionBy(*key)) for n, f, side in (
        ("ll", F.min, True), ("lh", F.max, True), ("wl", F.min, False), ("wh", F.max, False))})
    differs = F.when(F.col("local"), (F.col("wl") != F.col("v")) | (F.col("wh") != F.col("v"))).otherwise(
        (F.col("ll") != F.col("v")) | (F.col("lh") != F.col("v")))
    return v.filter(F.coalesce(differs, F.lit(False))).select("draft_id", "evidence_id", "field", "record_key")


def claims_of(drafts: DataFrame) -> DataFrame:
    """(draft_id, claim_no, claim) of draft texts."""
    return drafts.select("draft_id", F.posexplode(tx.split_claims(F.col("draft"))).alias("p", "claim")).select(
        "draft_id", (F.col("p") + 1).alias("claim_no"), "claim")


def citations(claims: DataFrame) -> DataFrame:
    return claims.select("draft_id", "claim_no", F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit(CITATION), F.lit(1)))).alias("evidence_id"))


def plain_claim(claim: Column) -> Column:
    return tx.claim_normal(F.regexp_replace(F.regexp_replace(claim, CITATION, ""), LIST_MARK, ""))


def repeated_ids(e: DataFrame) -> DataFrame:
    """(draft_id, evidence_id, first_position) of the ids that stand at several positions; stored."""
    at = e.groupBy("draft_id", "evidence_id").agg(F.min("position").alias("first_position"), F.max("position").alias("last"))
    # few rows make few files, so that their size tells the planner how few they are
    return settle(at.filter("first_position < last").drop("last").hint("rebalance"), lean=True)


def judge_evidence(e: DataFrame, repeated: DataFrame) -> DataFrame:
    """Evidence with a column per warning code and whether it is usable for coverage.

    FRESHNESS_MISSING marks a record without date, which counts where the draft answers a time-sensitive
    question. Records are judged where they are read; only their marks meet the ``repeated_ids``.
    """
    local, web = F.col("source_type") == "LOCAL", F.col("source_type").isin(*WEB_TYPES)
    unsound = ~filled(F.col("evidence_id"), F.col("content")) | F.col("position").isNull() | ~F.coalesce(F.col("evidence_version") == "4.0", F.lit(False))
    placed = filled(F.col("chunk_id")) | F.coalesce(F.col("page_no") > 0, F.lit(False)) | filled(F.col("table"), F.col("cell")) | filled(
        F.col("sheet"), F.col("field"), F.col("record_key"))
    url = F.col("url")
    # one pass over the URL gives its host; a URL with user data has none
    named = F.lower(F.regexp_extract(url, r"(?i)^\s*https?://(\[[0-9a-f:.]+\]|[^/?#:@\s]+)(?::\d*)?(?:[/?#]|\s*$)", 1))
    domain_ok = F.rtrim(named, F.lit(".")) == F.rtrim(F.lower(tx.strip(F.col("domain"))), F.lit("."))
    # a domain with more than dots equals no empty host
    url_ok = F.col("domain").rlike(r"(?U)[^\s.]") | (named != "")
    incomplete = F.when(local, ~filled(F.col("file_id"), F.col("file_name"))).when(
        web, ~filled(url, F.col("domain"), F.col("retrieved_at")) | ~F.coalesce(domain_ok & url_ok, F.lit(False))).otherwise(F.lit(True))
    dated = filled(F.col("retrieved_at"))
    marks = e.select(
        "draft_id", "evidence_id", "position", "content", unsound.alias("EVIDENCE_INVALID"), (local & ~placed).alias("LOCATION_MISSING"),
        incomplete.alias("SOURCE_INCOMPLETE"), (~dated).alias("FRESHNESS_MISSING"),
        (dated & ~tx.is_timestamp(F.col("retrieved_at"))).alias("FRESHNESS_INVALID"), F.col("conflict").alias("EVIDENCE_CONFLICT"))
    late = F.coalesce(F.col("position") != F.col("first_position"), F.lit(False))
    judged = marks.join(repeated, ["draft_id", "evidence_id"], "left").withColumn("EVIDENCE_INVALID", F.col("EVIDENCE_INVALID") | late)
    return judged.select("draft_id", "evidence_id", "content", *RECORD_CODES,
                         (~F.col("EVIDENCE_INVALID") & ~F.col("LOCATION_MISSING") & ~F.col("SOURCE_INCOMPLETE")).alias("usable"))


def _excerpt_hits(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """Claims found in evidence of their own draft, whatever its size."""
    return containment(texts, phrases, ("draft_id",)).select("draft_id", "phrase_id", "text_id")


def claim_links(claims: DataFrame, usable: DataFrame, claim_map: DataFrame) -> DataFrame:
    """(draft_id, claim_no, method, evidence_id or null, unknown): evidence of every claim; stored.

    An explicit map beats inline citations, which beat the exact excerpt. A mapped
    claim without ids has no evidence.
    """
    key = ["draft_id", "claim_no"]
    mapped = settle(claims.join(claim_map, ["draft_id", "claim"]).select(
        *key, F.col("mapped_id").alias("evidence_id"), F.lit("explicit_mapping").alias("method")), lean=True)
    unmapped = settle(claims.join(mapped.select(*key), key, "left_anti"), lean=True)
    cited = citations(unmapped).withColumn("method", F.lit("inline_citation"))
    silent = unmapped.filter(F.col("draft_id").isNull() | ~F.col("claim").rlike(CITATION)).join(cited.select(*key), key, "left_anti")
    phrases = silent.select("draft_id", F.col("claim_no").alias("phrase_id"), plain_claim(F.col("claim")).alias("phrase")).filter("phrase <> ''")
    texts = usable.select("draft_id", F.col("evidence_id").alias("text_id"), tx.claim_normal(F.col("content")).alias("body"))
    hits = _excerpt_hits(texts, phrases).select(
        "draft_id", F.col("phrase_id").alias("claim_no"), F.col("text_id").alias("evidence_id"))
    excerpts = settle(silent.select(*key).join(hits, key, "left").select(
        *key, F.lit("exact_excerpt").alias("method"), "evidence_id", F.lit(False).alias("unknown")), lean=True)
    known = usable.select("draft_id", "evidence_id", F.lit(True).alias("ok"))
    named = settle(mapped.unionByName(cited).join(known, ["draft_id", "evidence_id"], "left").select(
        *key, "method", F.when(F.col("ok"), F.col("evidence_id")).alias("evidence_id"),
        (F.col("ok").isNull() & F.col("evidence_id").isNotNull()).alias("unknown")), lean=True)
    return named.unionByName(excerpts)


def evidence_gate(drafts: DataFrame, e: DataFrame, claim_map: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(warnings, links): (draft_id, code, findings) rows and the claim coverage.

    Inputs of any size are checked whole; QUALITY_INPUT_LIMIT only notes a large one. Steps are stored one
    after the other, so that the disk holds the shuffle files of one step at a time.
    """
    judged = judge_evidence(e, repeated_ids(e))
    claims = settle(claims_of(drafts), lean=True)
    links = claim_links(claims, judged.filter("usable").select("draft_id", "evidence_id", "content"), claim_map)
    lit = lambda code: F.lit(code).alias("code")
    amounts = settle(judged.groupBy("draft_id").agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.col(c)).alias(c) for c in RECORD_CODES]), lean=True)
    sizes = claims.groupBy("draft_id").agg(F.count(F.lit(1)).alias("claims"))
    d = drafts.select("draft_id", F.length("draft").alias("length"), F.coalesce(F.col("query").rlike(TIME_SENSITIVE), F.lit(False)).alias("time_sensitive"))
    d = d.join(sizes, "draft_id", "left").join(amounts, "draft_id", "left")
    large = (F.col("length") > LONG_DRAFT) | (F.coalesce("claims", F.lit(0)) > MANY_CLAIMS) | (F.coalesce("records", F.lit(0)) > MANY_EVIDENCE)
    once = lambda test: F.when(test, F.lit(1).cast("bigint"))
    amount = {c: F.col(c) for c in RECORD_CODES} | {
        "FRESHNESS_MISSING": F.when(F.col("time_sensitive"), F.col("FRESHNESS_MISSING")),
        "ANSWER_DRAFT_MISSING": once(F.col("claims").isNull()), "QUALITY_INPUT_LIMIT": once(large)}
    own = F.filter(F.array(*[F.struct(lit(c), n.alias("n")) for c, n in amount.items()]), lambda x: x.n > 0)
    own = settle(d.select("draft_id", F.explode(own).alias("f")).select("draft_id", "f.code", "f.n"), lean=True)
    differing = settle(value_conflicts(e).groupBy("draft_id").agg(F.count(F.lit(1)).alias("n")), lean=True)
    per_claim = links.groupBy("draft_id", "claim_no").agg(F.count("evidence_id").alias("n"), F.bool_or("unknown").alias("u"))
    found = own.unionByName(differing.select("draft_id", lit("EVIDENCE_CONFLICT"), "n")).unionByName(
        per_claim.filter("n = 0 or u").select("draft_id", lit("EVIDENCE_MISSING"), F.lit(1).cast("bigint").alias("n")))
    return found.groupBy("draft_id", "code").agg(F.sum("n").alias("findings")), links


def gate_status(drafts: DataFrame, warnings: DataFrame) -> DataFrame:
    return drafts.select("draft_id").join(warnings.select("draft_id").distinct().withColumn("w", F.lit(True)), "draft_id", "left").select(
        "draft_id", F.when(F.col("w"), "WARNING").otherwise("PASS").alias("status"))


def evidence_union(*lists: DataFrame) -> DataFrame:
    """One row per evidence_id over lists with ``position``; earlier lists and rows win."""
    out = None
    for n, df in enumerate(lists):
        part = df.withColumn("list_no", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return first_per_key(out, ["evidence_id"], F.struct("list_no", "position"))


def new_evidence(current: DataFrame, earlier: DataFrame) -> DataFrame:
    return current.join(earlier, ["need_id", "evidence_id"], "left_anti")


def url_dedupe(hits: DataFrame, limit: int) -> DataFrame:
    """Hits per batch by canonical URL, first wins, cut at the limit.

    A hit that is not accepted rejects its batch when it comes before the list is full.
    """
    from gleanery.functions.urls import canonical_url

    c = hits.withColumn("canonical", canonical_url(F.col("url")))
    firsts = c.filter("canonical is not null").groupBy("batch_id", "canonical").agg(F.min("position").alias("position"))
    kept = top_n(firsts, ["batch_id"], [F.col("position")], limit, "rank")
    ends = kept.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.max("position").alias("last"))
    bad = c.filter("canonical is null").groupBy("batch_id").agg(F.min("position").alias("bad"))
    rejected = bad.join(ends, "batch_id", "left").filter(
        F.col("n").isNull() | (F.col("n") < limit) | (F.col("bad") < F.col("last"))).select("batch_id")
    return kept.join(rejected, "batch_id", "left_anti").select("batch_id", F.col("canonical").alias("url"), "position")


def answer_evidence(calls: DataFrame) -> DataFrame:
    """Evidence behind an answer: the last declared list, else all lists.

    calls: answer_id, call_no, position, evidence_id, source_type, declares. The last
    row per id wins and keeps the place of the first.
    """
    last = calls.groupBy("answer_id").agg(F.max(F.when(F.col("declares"), F.col("call_no"))).alias("last_call"))
    rows = calls.join(last, "answer_id").filter(
        (F.col("last_call").isNull() | (F.col("call_no") == F.col("last_call"))) & tx.not_blank(F.col("evidence_id"))
        & ~F.lower("source_type").isin("memory", "history"))
    at = F.struct("call_no", "position")
    return rows.groupBy("answer_id", "evidence_id").agg(F.min(at).alias("first"), F.max_by("source_type", at).alias("source_type")).select(
        "answer_id", "evidence_id", "source_type", F.col("first.call_no").alias("first_call"), F.col("first.position").alias("first_position"))


def locate(e: DataFrame, chunks: DataFrame, cells: DataFrame, regions: DataFrame) -> DataFrame:
    """Source place and text of evidence, or UNAVAILABLE for a stale locator.

    Cells are (table, cell, text), chunks (file_id, chunk_id, block_id, chunk_text),
    regions (region_id, text).
    """
    blocks = chunks.groupBy("file_id", "block_id").agg(F.min_by(F.struct("chunk_id", "chunk_text"), F.col("chunk_index")).alias("by_block"))
    j = (e.join(chunks.select("file_id", "chunk_id", F.col("chunk_text").alias("by_chunk")), ["file_id", "chunk_id"], "left")
         .join(blocks, ["file_id", "block_id"], "left")
         .join(cells.select("table", "cell", F.col("text").alias("by_cell")), ["table", "cell"], "left")
         .join(regions.select("region_id", F.col("text").alias("by_region")), "region_id", "left"))
    sheet = F.col("locator_type").isin("excel", "csv", "visual_table")
    text = F.when(sheet, F.col("by_cell")).otherwise(F.coalesce("by_chunk", "by_block.chunk_text", "by_region"))
    return j.select("evidence_id", "locator_type", F.when(text.isNull(), "UNAVAILABLE").otherwise("located").alias("status"), text.alias("text"))


def document_evidence(ranked: DataFrame, chunks: DataFrame, queries: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Evidence rows of retrieval results, one status row for queries without any.

    chunks add block_id, page_no, confidence and review_required; ``failed`` lists the
    queries whose asked page could not be recognised.
    """
    meta = chunks.select("chunk_id", "block_id", "chunk_text", "page_no", "confidence", "review_required")
    asked = queries.select("query_id", "query")
    if failed is not None:
        asked = asked.join(failed.select("query_id", F.lit(True).alias("failed")), "query_id", "left")
    else:
        asked = asked.withColumn("failed", F.lit(None).cast("boolean"))
    rows = asked.join(ranked.join(meta, "chunk_id"), "query_id", "left")
    hit = F.col("chunk_id").isNotNull() & F.col("failed").isNull()
    eid = ids.evidence_id({"chunk_id": ids.json_text(F.col("chunk_id")), "block_id": ids.json_text(F.col("block_id")), "query": ids.json_text(F.col("query"))})
    shown = lambda c: F.when(hit, c)
    return rows.select(
        "query_id", F.when(F.col("failed"), "insufficient_evidence").when(hit, "found").otherwise("not_found").alias("status"),
        shown(eid).alias("evidence_id"), shown(F.col("file_id")).alias("file_id"), shown(F.col("chunk_id")).alias("chunk_id"),
        shown(F.col("page_no")).alias("page_no"), shown(tx.excerpt(F.col("chunk_text"), F.col("query"))).alias("text_excerpt"),
        shown(F.round("retrieval_score", 6)).alias("score"), shown(F.coalesce(F.col("confidence") < 0.8, F.lit(False))).alias("low_confidence"),
        shown(F.col("review_required")).alias("review_required")).distinct()


# Authority marks that a page may state itself.
AUTHORITIES = ("official", "academic", "general", "unknown")


def web_evidence(records: DataFrame, source_type: str, max_chars: int | None = None) -> DataFrame:
    """Evidence of hits or pages (url, domain, title, content, publisher, published_at, authority, retrieved_at).

    Records without text are dropped. Identity and content cover the whole text; a caller
    may bound the content by ``max_chars``, which ``content_truncated`` then tells.
    """
    whole = tx.strip(F.col("content"))
    url = tx.strip(F.col("url"))
    domain = F.lower(F.coalesce(F.nullif(tx.strip(F.col("domain")), F.lit("")), host(url)))
    body = whole if max_chars is None else F.substring(whole, 1, max(1, max_chars))
    eid = ids.evidence_id({"source_type": ids.json_text(F.lit(source_type)), "url": ids.json_text(url), "content_hash": ids.json_text(ids.text_hash(whole))})
    authority = F.lower(tx.strip(F.coalesce("authority", F.lit(""))))
    published = F.nullif(tx.strip(F.col("published_at")), F.lit(""))
    return records.filter(tx.not_blank(F.col("content")) & (url != "") & (domain != "")).select(
        eid.alias("evidence_id"), F.lit(source_type).alias("source_type"), url.alias("url"), domain.alias("domain"),
        F.nullif(tx.strip(F.col("title")), F.lit("")).alias("title"), body.alias("content"), (F.length(whole) > F.length(body)).alias("content_truncated"),
        F.nullif(tx.strip(F.col("publisher")), F.lit("")).alias("publisher"), published.alias("published_at"), "retrieved_at",
        F.when(authority.isin(*AUTHORITIES), authority).otherwise("unknown").alias("authority"),
        F.when(published.isNotNull(), "published_at_available").otherwise("retrieval_time_only").alias("freshness"),
        F.lit("untrusted_web_data").alias("trust_level"))
