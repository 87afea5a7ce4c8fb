"""Recognised regions, pages, blocks and visual tables.

Regions: file_id, page_no, seq, region_id, text, bbox (array of four doubles),
confidence, recognition_type, status, review_required, conflict_texts,
visual_block_type. A page holds few regions; a file may hold many pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanery.functions.ids import short_hash
from gleanery.functions.labels import injection_labels_visual, key_field_type
from gleanery.functions.text import not_blank, strip

# Thresholds of the review policy and of the derived tables.
USABLE, REVIEW, KEY_FIELD = 0.55, 0.80, 0.90
CELL_CONFIDENCE, FIELD_CONFIDENCE, WRITE_CONFIDENCE = 0.85, 0.85, 0.70
IDENTITY_FIELDS = ("name", "student_id", "phone")


def bbox_normalise(points: Column) -> Column:
    """[minx, miny, maxx, maxy] of a polygon given as points, null without points."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_points(box: Column) -> Column:
    """The two corners of a four-number box."""
    return F.when(F.size(box) >= 4, F.array(F.array(box[0], box[1]), F.array(box[2], box[3])))


def region_conflict(regions: DataFrame, candidates: str = "candidates") -> DataFrame:
    """Two or more distinct candidate texts blank the region and are all kept."""
    texts = F.filter(F.transform(F.col(candidates), lambda c: strip(c["text"])), lambda x: x != "")
    kinds = F.array_distinct(F.transform(F.col(candidates), lambda c: c["recognition_type"]))
    marked = regions.withColumn("__conflict", F.size(F.array_distinct(texts)) > 1)
    conflict = F.col("__conflict")
    return marked.withColumns({
        "text": F.when(conflict, "").otherwise(F.col("text")),
        "recognition_type": F.when(conflict & (F.size(kinds) > 1), "mixed").otherwise(F.col("recognition_type")),
        "status": F.when(conflict, "low_confidence").otherwise(F.col("status")),
        "conflict_texts": F.when(conflict, F.transform(F.col(candidates), lambda c: c["text"])).otherwise(F.array().cast("array<string>")),
    }).drop("__conflict")


def region_safety(regions: DataFrame) -> DataFrame:
    """Status, key field, review reasons and the two safety flags of each region."""
    known = regions.withColumn("__all", F.concat_ws(" ", F.col("text"), F.col("conflict_texts")))
    known = known.withColumn("key_field_type", key_field_type(F.col("__all"))).withColumn(
        "detected_patterns", injection_labels_visual(F.col("__all")))
    unsure = F.col("recognition_type").isin("handwritten", "mixed", "unknown")
    conf, key = F.col("confidence"), F.col("key_field_type")
    conflict, patterns = F.size("conflict_texts") > 1, F.size("detected_patterns") > 0
    below = lambda limit: F.coalesce(conf < limit, F.lit(True))
    unusable = unsure & F.coalesce(conf < USABLE, F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(unusable, "HANDWRITING_BELOW_USABLE_CONFIDENCE"), F.when(unsure & below(REVIEW), "HANDWRITING_REVIEW_REQUIRED"),
        F.when(F.col("recognition_type") == "unknown", "UNKNOWN_RECOGNITION_TYPE"),
        F.when(key.isNotNull() & unsure & below(KEY_FIELD), "LOW_CONFIDENCE_KEY_FIELD"),
        F.when(conflict, "RECOGNITION_MODEL_CONFLICT"), F.when(patterns, "VISUAL_UNTRUSTED_INSTRUCTION_LIKE_DATA")))
    dead = F.col("status").isin("empty", "failed")
    judged = known.withColumns({
        "__reasons": F.when(dead, F.array().cast("array<string>")).otherwise(reasons),
        "__dead": dead, "__conflict": conflict, "__unusable": unusable & ~dead})
    review = F.col("review_required") | (F.size("__reasons") > 0)
    status = F.when(F.col("__dead"), F.col("status")).when(F.col("__unusable") | F.col("__conflict"), "low_confidence").otherwise(F.col("status"))
    return judged.withColumns({
        "review_required": review, "status": status,
        "review_reason": F.when(F.size("__reasons") > 0, F.array_join("__reasons", ";")),
        "safe_for_high_impact": ~F.col("__dead") & (status == "success") & ~review & (F.size("detected_patterns") == 0),
        "safe_for_identity_match": ~F.col("__dead") & ~(F.coalesce(key.isin(*IDENTITY_FIELDS), F.lit(False)) & review) & ~F.col("__conflict"),
    }).drop("__all", "__reasons", "__dead", "__conflict", "__unusable")


# How block kinds and document kinds are recognised.
SIGNATURE, STAMP = r"(?:签名|签字|署名)\s*[:：]?", r"(?:盖章|公章|印章)"
TITLE_END, SENTENCE_MARK = r"(?:证书|证明|通知|公告|申请表|登记表|报告|总结|函)$", r"[。！？；;]"
LABEL_VALUE = r"^\s*([^:：\n]{1,30})\s*[:：]\s*(\S.*?)\s*$"
DOCUMENT_RULES = (
    ("certificate", r"(?:证书|证明书|获奖证明|荣誉证明)", 0.92), ("notice", r"(?:通知|公告|告知书)", 0.90),
    ("form", r"(?:申请表|登记表|信息表|表单)", 0.90), ("report", r"(?:报告|总结|分析报告)", 0.88),
    ("letter", r"(?:尊敬的|此致\s*敬礼|来信|函)", 0.86))

GRID_MARK = r"[\t|]"
RULE_MARK = "|".join(pattern for _, pattern, _ in DOCUMENT_RULES)


def visual_blocks(regions: DataFrame) -> DataFrame:
    """Blocks with their kind and the last title above them on the page."""
    firsts = regions.groupBy("file_id", "page_no").agg(F.min("seq").alias("__first"))
    # a left join, which is left out where nothing asks for titles
    rows = regions.join(firsts, ["file_id", "page_no"], "left")
    text = strip(F.coalesce("text", F.lit("")))
    bars = F.length("text") - F.length(F.replace("text", F.lit("|"), F.lit("")))
    short_title = (F.col("seq") == F.col("__first")) & (text != "") & (F.length(text) <= 40) & (
        text.rlike(TITLE_END) | ~text.rlike(SENTENCE_MARK))
    given, grid = F.col("visual_block_type"), text.contains("\t") | (bars >= 2)
    kind = (F.when(given.isNotNull(), given)
            .when(text.rlike(SIGNATURE), "signature").when(text.rlike(STAMP), "stamp")
            .when(grid, "table").when(short_title, "title")
            .when(text != "", "paragraph").otherwise("unknown"))
    # tables are known without the first of the page; the first test spares most texts the others
    table = F.coalesce(F.when(given.isNotNull(), given == "table").otherwise(
        F.col("text").rlike(GRID_MARK) & grid & ~text.rlike(SIGNATURE) & ~text.rlike(STAMP)), F.lit(False))
    typed = rows.withColumns({"block_type": kind, "is_table": table}).drop("__first")
    return typed.withColumn("block_id", short_hash(F.concat_ws(":", F.col("file_id").cast("string"), "region_id", "block_type")))


def page_title_parent(blocks: DataFrame) -> DataFrame:
    above = W.partitionBy("file_id", "page_no").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    title = F.last(F.when(F.col("block_type") == "title", F.col("block_id")), ignorenulls=True).over(above)
    return blocks.withColumn("parent_id", F.when(F.col("block_type") != "title", title))


def label_value_fields(blocks: DataFrame) -> DataFrame:
    """``label: value`` lines of text blocks that have a box, with a review mark."""
    # a text without a colon has no such line, and leaves before its kind is told
    named = blocks.filter(F.col("text").rlike("[:：]"))
    lines = named.filter(F.col("block_type").isin("paragraph", "table", "unknown") & F.col("bbox").isNotNull()).select(
        "file_id", "block_id", "confidence", "review_required", "safe_for_high_impact",
        F.explode(F.split("text", r"\R")).alias("line")).filter(F.col("line").rlike(LABEL_VALUE))
    review = (F.col("review_required") | F.coalesce(F.col("confidence") < FIELD_CONFIDENCE, F.lit(True)) | ~F.col("safe_for_high_impact"))
    return lines.select(
        "file_id", "block_id", strip(F.regexp_extract("line", LABEL_VALUE, 1)).alias("field_label"),
        strip(F.regexp_extract("line", LABEL_VALUE, 2)).alias("value"),
        F.when(review, "review_required").otherwise("extracted").alias("status"))


def document_class(blocks: DataFrame) -> DataFrame:
    """(file_id, document_type, confidence, block_id): first rule that hits, with its evidence."""
    text = F.col("text")
    hits = F.array_compact(F.array(*[F.when(text.rlike(pattern), i) for i, (_, pattern, _) in enumerate(DOCUMENT_RULES)]))
    hits = F.when(text.rlike(RULE_MARK), hits).otherwise(F.array().cast("array<int>"))
    marks = lambda rows: rows.select("file_id", "block_id", hits.alias("hits"), "is_table")
    marked = marks(blocks)
    verdict = marked.groupBy("file_id").agg(F.min(F.array_min("hits")).alias("rule"), F.bool_and("is_table").alias("tables"))
    names = F.array(*[F.lit(n) for n, _, _ in DOCUMENT_RULES])
    scores = F.array(*[F.lit(s) for _, _, s in DOCUMENT_RULES])
    verdict = verdict.select(
        "file_id", "rule", "tables",
        F.when(F.col("rule").isNotNull(), F.get(names, F.col("rule"))).when(F.col("tables"), "table").otherwise("unknown").alias("document_type"),
        F.when(F.col("rule").isNotNull(), F.get(scores, F.col("rule"))).when(F.col("tables"), 0.85).otherwise(0.0).alias("confidence"))
    # evidence is a block that some rule hits, or a table; one look at a text tells most others, before blocks are formed
    held = marks(blocks.filter(F.col("visual_block_type").isNotNull() | text.rlike(f"{RULE_MARK}|{GRID_MARK}"))).withColumnRenamed("file_id", "__file")
    shown = (F.col("file_id") == F.col("__file")) & F.coalesce(F.array_contains("hits", F.col("rule")), F.col("tables"))
    return verdict.join(held, shown, "left").select("file_id", "document_type", "confidence", "block_id")


def bbox_union(box: Column) -> Column:
    """Aggregate: smallest box around all boxes, nulls ignored."""
    ends = [F.min(box[0]), F.min(box[1]), F.max(box[2]), F.max(box[3])]
    return F.when(ends[0].isNotNull(), F.array(*ends))


def page_rollup(regions: DataFrame) -> DataFrame:
    usable = (F.col("status") == "success") & not_blank(F.col("text"))
    box = F.when(usable, F.col("bbox"))
    lines = F.array_sort(F.collect_list(F.when(usable, F.struct("seq", "text"))))
    return regions.groupBy("file_id", "page_no").agg(
        lines.alias("lines"), F.min(F.when(usable, F.col("confidence"))).alias("confidence"), bbox_union(box).alias("bbox"),
        F.count_if(usable).alias("usable_regions")).select(
        "file_id", "page_no", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"), "confidence", "bbox",
        F.when(F.col("usable_regions") > 0, "success").otherwise("failed").alias("status"))


def region_metrics(regions: DataFrame) -> DataFrame:
    hand = F.col("recognition_type").isin("handwritten", "mixed")
    conf = F.when(hand, F.col("confidence"))
    return regions.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("region_count"), F.count_if(F.col("status") == "success").alias("successful_regions"),
        F.count_if(F.col("status").isin("low_confidence", "empty", "failed")).alias("failed_regions"),
        F.count_if(hand).alias("handwriting_region_count"), F.min(conf).alias("handwriting_confidence"),
        F.round(F.avg(conf), 6).alias("handwriting_confidence_average"))


def page_route(pages: DataFrame) -> DataFrame:
    """Text, mixed or scanned file from pages with and without text."""
    good = F.count_if(not_blank(F.col("text")))
    bad = F.count_if(~not_blank(F.col("text")))
    return pages.groupBy("file_id").agg(good.alias("text_pages"), bad.alias("ocr_pages")).withColumn(
        "pdf_type", F.when((F.col("text_pages") > 0) & (F.col("ocr_pages") > 0), "mixed").when(F.col("text_pages") > 0, "text").otherwise("scanned")
    ).withColumn("route", F.when(F.col("pdf_type") == "text", "TEXT").otherwise("VISUAL"))


def region_provenance(chunks: DataFrame, regions: DataFrame) -> DataFrame:
    """Region of each chunk by its region id, else by page and box (first in reading order)."""
    # a chunk is looked up one way or the other, and only takes along what that needs
    named, boxed = chunks.filter("region_id is not null"), chunks.filter("region_id is null")
    by_id = regions.select("file_id", "region_id").distinct().withColumn("__known", F.lit(True))
    by_box = regions.filter("bbox is not null").groupBy("file_id", "page_no", "bbox").agg(F.min_by("region_id", "seq").alias("source_region_id"))
    first = named.select("chunk_id", "file_id", "region_id").join(by_id, ["file_id", "region_id"], "left").select(
        "chunk_id", F.when(F.col("__known"), F.col("region_id")).alias("source_region_id"))
    second = boxed.select("chunk_id", "file_id", "page_no", "bbox").join(by_box, ["file_id", "page_no", "bbox"], "left")
    return first.unionByName(second.select("chunk_id", "source_region_id"))


def grid_check(cells: DataFrame) -> DataFrame:
    """Per visual table: status, warning and size; a gap or a repeat makes it irregular.

    Cells: table_id, row_index, column_index, bbox, confidence, status,
    review_required, structure_hint, row_span, column_span. Gaps are counted against
    the full grid, which needs no list of its places.
    """
    reliable = ((F.col("status") == "success") & F.col("bbox").isNotNull() & ~F.col("review_required")
                & F.coalesce(F.col("confidence") >= CELL_CONFIDENCE, F.lit(False)))
    spanned = F.coalesce((F.col("row_span") != 1) | (F.col("column_span") != 1), F.lit(False))
    per_place = cells.groupBy("table_id", "row_index", "column_index").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~reliable).alias("weak"), F.count_if(F.col("bbox").isNull()).alias("boxless"),
        F.bool_or(F.coalesce(F.col("structure_hint") == "merged_cells", F.lit(False)) | spanned).alias("merged"),
        F.bool_or(F.coalesce(F.col("structure_hint") == "borderless_hand_drawn", F.lit(False))).alias("borderless"))
    t = per_place.groupBy("table_id").agg(
        F.sum("n").alias("cells"), F.count(F.lit(1)).alias("places"), F.max("row_index").alias("last_row"),
        F.max("column_index").alias("last_column"), F.sum("weak").alias("weak"), F.sum("boxless").alias("boxless"),
        F.bool_or("merged").alias("merged"), F.bool_or("borderless").alias("borderless"),
        F.bool_or(F.col("row_index").isNull() | F.col("column_index").isNull()).alias("placeless"))
    full = (F.col("last_row") + 1) * (F.col("last_column") + 1)
    warning = (F.when(F.col("merged"), "MERGED_CELLS_UNSUPPORTED").when(F.col("borderless"), "BORDERLESS_HAND_DRAWN_TABLE_UNSUPPORTED")
               .when(F.col("placeless") | (F.col("boxless") > 0), "TABLE_STRUCTURE_OR_CELL_GEOMETRY_UNAVAILABLE")
               .when(F.col("places") != F.col("cells"), "DUPLICATE_CELL_COORDINATES_UNSUPPORTED")
               .when(F.col("places") != full, "IRREGULAR_OR_INCOMPLETE_GRID_UNSUPPORTED"))
    return t.withColumn("__w", warning).select(
        "table_id", F.when(F.col("__w").isNull(), "normal").otherwise("degraded").alias("status"),
        F.coalesce("__w", F.when(F.col("weak") > 0, "LOW_CONFIDENCE_CELLS_REQUIRE_REVIEW")).alias("warning"),
        F.when(F.col("__w").isNull(), F.col("last_row") + 1).otherwise(0).cast("bigint").alias("row_count"),
        F.when(F.col("__w").isNull(), F.col("last_column") + 1).otherwise(0).cast("bigint").alias("column_count"))


NUMBER = r"^[+-]?(?:\d+(?:\.\d+)?|\.\d+)$"


def cell_calculation(chosen: DataFrame, cells: DataFrame, tables: DataFrame, operation: str) -> DataFrame:
    """Exact decimal result over chosen cells (table_id, row_index, column_index), or why not."""
    if operation not in ("sum", "avg", "min", "max", "count"):
        raise ValueError(f"unknown operation {operation}")
    reliable = ((F.col("status") == "success") & F.col("bbox").isNotNull() & ~F.col("review_required")
                & F.coalesce(F.col("confidence") >= CELL_CONFIDENCE, F.lit(False)))
    place = ["table_id", "row_index", "column_index"]
    known = cells.groupBy(*place).agg(F.bool_and(reliable).alias("reliable"), F.min("text").alias("text"))
    clean = F.replace(strip(F.col("text")), F.lit(","), F.lit(""))
    number = F.when(clean.rlike(NUMBER), clean.try_cast("decimal(38,18)"))
    rows = chosen.join(known, place, "left").withColumn("number", number)
    agg = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    value = F.count(F.lit(1)).cast("decimal(38,18)") if operation == "count" else agg[operation]("number")
    plain = F.lit(operation == "count")
    judged = rows.groupBy("table_id").agg(
        value.alias("value"), F.count_if(F.col("reliable").isNull()).alias("absent"),
        F.count_if(~F.col("reliable")).alias("weak"), F.count_if(F.col("number").isNull()).alias("texts"))
    j = judged.join(tables.select("table_id", F.col("status").alias("table_status")), "table_id", "left")
    verdict = (F.when(F.col("table_status").isNull(), "VISUAL_TABLE_NOT_FOUND").when(F.col("table_status") != "normal", "VISUAL_TABLE_NOT_RELIABLE")
               .when(F.col("absent") > 0, "VISUAL_TABLE_CELL_NOT_FOUND").when(F.col("weak") > 0, "VISUAL_TABLE_CELL_NOT_RELIABLE")
               .when(~plain & (F.col("texts") > 0), "VISUAL_TABLE_NON_NUMERIC_CELL").otherwise("calculated"))
    return j.select("table_id", verdict.alias("status"), F.when(verdict == "calculated", F.col("value").cast("double")).alias("value"))


def visual_write_gate(evidence: DataFrame) -> DataFrame:
    """confirm, reject or require_user_review per request, over its visual evidence.

    evidence: request_id, locator_type, recognition_type, region_id, conflict,
    review_required, safe_for_high_impact, confidence, text.
    """
    visual = (F.coalesce(F.col("locator_type").isin("visual_pdf", "image", "visual_table", "handwriting"), F.lit(False))
              | F.coalesce(F.col("recognition_type").isin("printed", "handwritten", "mixed", "unknown"), F.lit(False))
              | F.col("region_id").isNotNull())
    unsafe = (~F.coalesce("safe_for_high_impact", F.lit(True)) | F.col("review_required")
              | F.coalesce(F.col("confidence") < WRITE_CONFIDENCE, F.lit(True)) | (F.size(injection_labels_visual(F.coalesce("text", F.lit("")))) > 0))
    g = evidence.groupBy("request_id").agg(
        F.bool_or(visual).alias("visual"), F.bool_or(visual & F.col("conflict")).alias("conflict"), F.bool_or(visual & unsafe).alias("unsafe"))
    return g.select(
        "request_id", F.when(F.col("conflict"), "reject").when(F.col("unsafe"), "require_user_review").otherwise("confirm").alias("decision"),
        F.when(~F.col("visual"), "NO_UNSAFE_VISUAL_EVIDENCE").when(F.col("conflict"), "VISUAL_EVIDENCE_CONFLICT")
        .when(F.col("unsafe"), "LOW_CONFIDENCE_VISUAL_WRITE_REQUIRES_REVIEW")
        .otherwise("VISUAL_EVIDENCE_ELIGIBLE_FOR_REAL_APPROVAL").alias("reason_code"))
