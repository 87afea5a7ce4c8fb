"""Linking the records of one entity across sources, and reporting conflicts.

Sources come as long cells (workspace, source, row_number, canonical_name, value)
plus a field profile (workspace, source, canonical_name, null_count, unique_count,
row_count). Ids are (workspace, entity_id). A workspace holds the sources that are
searched together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import is_blank, norm_key, strip
from gleanery.operators.storage import settle

# Which meanings may join records.
PRIMARY_KEY = "student_id"
UNIQUE_KEYS = ("id_card", "passport", "email")
COMPOSITE_KEYS = ("name", "college", "grade", "class")
ROW = ["workspace", "source", "row_number"]


def source_cells(df: DataFrame, workspace: str, source: str, fields: dict[str, str],
                 row_number: str = "row_number") -> DataFrame:
    """Long cells of one source; ``fields`` maps canonical names to columns."""
    cells = F.array(*[F.struct(F.lit(name).alias("canonical_name"), F.col(c).cast("string").alias("value"))
                      for name, c in fields.items()])
    return df.select(F.col(workspace).alias("workspace"), F.lit(source).alias("source"),
                     F.col(row_number).alias("row_number"), F.explode(cells).alias("c")).select(*ROW, "c.*")


def source_profile(cells: DataFrame) -> DataFrame:
    blank = is_blank(F.col("value"))
    per_value = (cells.groupBy("workspace", "source", "canonical_name", F.when(~blank, strip(F.col("value"))).alias("v"))
                 .agg(F.count(F.lit(1)).alias("n")))
    return per_value.groupBy("workspace", "source", "canonical_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.count("v").alias("unique_count"))


def _with_norm(cells: DataFrame) -> DataFrame:
    return cells.filter(~is_blank(F.col("value"))).withColumn("norm", norm_key(F.col("value")))


def primary_links(ids: DataFrame, cells: DataFrame) -> DataFrame:
    """(entity_id, row, method) where the primary key of a source equals the id."""
    keys = _with_norm(cells).filter(F.col("canonical_name") == PRIMARY_KEY)
    asked = ids.select("workspace", "entity_id", norm_key(F.col("entity_id")).alias("norm"))
    return asked.join(keys, ["workspace", "norm"]).select(
        "workspace", "entity_id", "source", "row_number", F.lit(PRIMARY_KEY).alias("method"))


def _reliable(profile: DataFrame) -> DataFrame:
    return profile.filter((F.col("null_count") == 0) & (F.col("unique_count") == F.col("row_count"))
                          & F.col("canonical_name").isin(*UNIQUE_KEYS)).select("workspace", "source", "canonical_name")


def unique_links(ids: DataFrame, found: DataFrame, cells: DataFrame, profile: DataFrame) -> DataFrame:
    """Ids without a primary hit, matched on columns that are complete and unique."""
    open_ids = ids.join(found, ["workspace", "entity_id"], "left_anti")
    keys = _with_norm(cells).join(_reliable(profile), ["workspace", "source", "canonical_name"], "left_semi")
    asked = open_ids.select("workspace", "entity_id", norm_key(F.col("entity_id")).alias("norm"))
    return asked.join(keys, ["workspace", "norm"]).select(
        "workspace", "entity_id", "source", "row_number", F.col("canonical_name").alias("method"))


def consensus_values(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Per entity and field, the value when all linked records agree."""
    # an aggregate of texts sorts all that a task reads, and stored cells are packed far denser than sorted ones; so they are dealt out by rows
    parts = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = links.join(_with_norm(cells).repartition(parts, *ROW), ROW)
    return (values.groupBy("workspace", "entity_id", "canonical_name")
            .agg(F.min("norm").alias("norm"), F.max("norm").alias("top"),
                 F.max_by("value", F.struct("source", "row_number")).alias("value"))
            .filter(F.col("norm") == F.col("top")).drop("top"))


def auxiliary_links(links: DataFrame, anchors: DataFrame, cells: DataFrame, profile: DataFrame) -> DataFrame:
    """Candidate rows in sources without a hit: first unique key, else all four names.

    The result keeps every candidate with ``candidates``, the count per entity and
    source; one candidate links, more make the source ambiguous.
    """
    linked = links.select("workspace", "entity_id", "source").distinct()
    norm_cells = _with_norm(cells)
    rank = F.array_position(F.array(*map(F.lit, UNIQUE_KEYS)), F.col("canonical_name"))
    keyed = norm_cells.join(_reliable(profile), ["workspace", "source", "canonical_name"], "left_semi")
    by_key = (anchors.filter(F.col("canonical_name").isin(*UNIQUE_KEYS))
              .select("workspace", "entity_id", "canonical_name", "norm")
              .join(keyed, ["workspace", "canonical_name", "norm"])
              .join(linked, ["workspace", "entity_id", "source"], "left_anti")
              .select("workspace", "entity_id", "source", "row_number", rank.alias("r"),
                      F.col("canonical_name").alias("method")))
    # both lists of candidates are stored, so that a task holds the sorted sides of a few joins at a time, not of all
    by_key = settle(by_key)
    best = by_key.groupBy("workspace", "entity_id", "source").agg(F.min("r").alias("r"))
    by_key = settle(by_key.join(best, ["workspace", "entity_id", "source", "r"]).drop("r"))

    def composite(rows: DataFrame, key: Sequence[str]) -> DataFrame:
        parts = [F.max(F.when(F.col("canonical_name") == c, F.col("norm"))).alias(c) for c in COMPOSITE_KEYS]
        wide = rows.filter(F.col("canonical_name").isin(*COMPOSITE_KEYS)).groupBy(*key).agg(*parts)
        return wide.dropna(subset=list(COMPOSITE_KEYS))

    names = (composite(anchors, ["workspace", "entity_id"])
             .join(composite(norm_cells, ROW), ["workspace", *COMPOSITE_KEYS]).select("workspace", "entity_id", "source", "row_number"))
    names = (settle(names).join(linked, ["workspace", "entity_id", "source"], "left_anti")
             .join(by_key, ["workspace", "entity_id", "source"], "left_anti")
             .select("workspace", "entity_id", "source", "row_number",
                     F.lit("name_college_grade_class").alias("method")))
    candidates = settle(by_key.unionByName(names))
    sizes = candidates.groupBy("workspace", "entity_id", "source").agg(F.count(F.lit(1)).alias("candidates"))
    return candidates.join(sizes, ["workspace", "entity_id", "source"])


def partial_key_issues(links: DataFrame, anchors: DataFrame, candidates: DataFrame, profile: DataFrame) -> DataFrame:
    """Sources with some but not all composite keys, for entities with an agreed name."""
    available = (profile.filter(F.col("canonical_name").isin(*COMPOSITE_KEYS))
                 .groupBy("workspace", "source").agg(F.count(F.lit(1)).alias("keys"))
                 .filter(F.col("keys") < len(COMPOSITE_KEYS)).select("workspace", "source"))
    named = anchors.filter(F.col("canonical_name") == "name").select("workspace", "entity_id")
    key = ["workspace", "entity_id", "source"]
    return (named.join(available, "workspace").join(links.select(*key), key, "left_anti")
            .join(candidates.select(*key), key, "left_anti")
            .select(*key, F.lit("PARTIAL_IDENTITY_KEYS").alias("reason")))


def resolve_entities(ids: DataFrame, cells: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, statuses): linked rows with their method, and found/ambiguous/not_found."""
    primary = primary_links(ids, cells)
    # each stage below reads these rows several times, so they are written once
    links = settle(primary.unionByName(unique_links(ids, primary, cells, profile)))
    anchors = settle(consensus_values(links, cells))
    candidates = settle(auxiliary_links(links, anchors, cells, profile))
    added = candidates.filter("candidates = 1").drop("candidates")
    issues = (candidates.filter("candidates > 1").select("workspace", "entity_id").distinct()
              .unionByName(partial_key_issues(links, anchors, candidates, profile).select("workspace", "entity_id")))
    everything = links.unionByName(added)
    hit = everything.groupBy("workspace", "entity_id").agg(F.count(F.lit(1)).alias("records"))
    trouble = issues.groupBy("workspace", "entity_id").agg(F.count(F.lit(1)).alias("issues"))
    statuses = (ids.join(hit, ["workspace", "entity_id"], "left").join(trouble, ["workspace", "entity_id"], "left")
                .select("workspace", "entity_id", F.coalesce("records", F.lit(0)).alias("records"),
                        F.when(F.col("records").isNull(), "not_found")
                        .when(F.col("issues") > 0, "ambiguous").otherwise("found").alias("status")))
    return everything, statuses


# Severities of the conflict kinds.
DEDICATED = {"name": "same_id_different_name", "college": "same_id_different_college"}


def linked_values(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Every filled cell of the linked rows; stored."""
    return settle(links.join(_with_norm(cells), ROW))


def entity_conflicts(links: DataFrame, cells: DataFrame, raw_cells: DataFrame | None = None, values: DataFrame | None = None) -> DataFrame:
    """(entity, conflict_type, severity, field, value_count) without choosing a winner; ``values`` are the ``linked_values`` where these are at hand."""
    key = ["workspace", "entity_id"]
    values = linked_values(links, cells) if values is None else values
    per_value = values.groupBy(*key, "canonical_name", "norm").agg(F.count(F.lit(1)).alias("n"))
    differing = (per_value.filter(F.col("canonical_name") != PRIMARY_KEY).groupBy(*key, "canonical_name")
                 .agg(F.count(F.lit(1)).alias("value_count")).filter("value_count > 1"))
    kind = F.lit("same_field_different_value")
    for name, label in DEDICATED.items():
        kind = F.when(F.col("canonical_name") == name, label).otherwise(kind)
    fields = differing.select(*key, kind.alias("conflict_type"),
                              F.when(F.col("canonical_name").isin(*DEDICATED), "error").otherwise("warning").alias("severity"),
                              F.col("canonical_name").alias("field"), "value_count")
    out = [fields]
    if raw_cells is not None:
        raw = links.join(_with_norm(raw_cells), ROW)
        out.append(raw.groupBy(*key, "canonical_name", "norm").agg(F.count(F.lit(1)).alias("n"))
                   .groupBy(*key, "canonical_name").agg(F.sum("n").alias("seen"), F.count(F.lit(1)).alias("value_count"))
                   .filter("seen > 1 and value_count > 1")
                   .select(*key, F.lit("same_field_different_value").alias("conflict_type"),
                           F.lit("warning").alias("severity"), F.col("canonical_name").alias("field"), "value_count"))
    row = [*key, "source", "row_number"]
    per_row = values.join(values.filter(F.col("canonical_name") == "date").select(*row), row, "left_semi").groupBy(*row).agg(
        F.array_sort(F.collect_list(F.when(F.col("canonical_name") != "date", F.struct("canonical_name", "norm")))).alias("snapshot"))
    dated = (per_row.groupBy(*key, "snapshot").agg(F.count(F.lit(1)).alias("rows"))
             .groupBy(*key).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("value_count"))
             .filter("rows > 1 and value_count > 1"))
    out.append(dated.select(*key, F.lit("time_version_conflict").alias("conflict_type"), F.lit("warning").alias("severity"),
                            F.lit("date").alias("field"), "value_count"))
    per_source = links.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n"))
    out.append(per_source.filter("n > 1").select(
        *key, F.lit("duplicate_record").alias("conflict_type"), F.lit("error").alias("severity"),
        F.col("source").alias("field"), F.col("n").alias("value_count")))
    single = per_source.groupBy(*key).agg(F.count(F.lit(1)).alias("sources"), F.min("source").alias("field")).filter("sources = 1")
    out.append(single.select(*key, F.lit("single_source_only").alias("conflict_type"), F.lit("warning").alias("severity"),
                             "field", F.col("sources").alias("value_count")))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result


def validate_entities(ids: DataFrame, cells: DataFrame, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(issues, statuses) per entity: conflicts, count mismatches and contact checks."""
    from gleanery.operators.quality import contact_valid

    key = ["workspace", "entity_id"]
    links, statuses = resolve_entities(ids, cells, profile)
    clear = statuses.filter("status = 'found'").select(*key)
    links = settle(links.join(clear, key, "left_semi"))
    values = linked_values(links, cells)
    conflicts = entity_conflicts(links, cells, values=values).filter("conflict_type <> 'single_source_only'").select(
        *key, F.col("conflict_type").alias("issue_type"), "severity", F.lit(True).alias("conflict"))
    counts = links.groupBy(*key, "source").agg(F.count(F.lit(1)).alias("n")).groupBy(*key).agg(
        F.min("n").alias("low"), F.max("n").alias("high"))
    mismatch = counts.filter("low <> high").select(
        *key, F.lit("cross_file_count_mismatch").alias("issue_type"), F.lit("warning").alias("severity"),
        F.lit(False).alias("conflict"))
    contacts = values.filter(F.col("canonical_name").isin("phone", "email")).filter(
        ~F.when(F.col("canonical_name") == "phone", contact_valid("phone", F.col("value")))
        .otherwise(contact_valid("email", F.col("value"))))
    invalid = contacts.select(*key, F.lit("invalid_contact_format").alias("issue_type"),
                              F.lit("error").alias("severity"), F.lit(False).alias("conflict"))
    issues = conflicts.unionByName(mismatch).unionByName(invalid)
    per_entity = issues.groupBy(*key).agg(F.count(F.lit(1)).alias("issue_count"), F.bool_or("conflict").alias("c"),
                                          F.bool_or(F.col("severity") == "error").alias("e"))
    final = statuses.join(per_entity, key, "left").select(
        *key, F.when(F.col("status") != "found", F.col("status")).when(F.col("c"), "conflict")
        .when(F.col("e"), "invalid_data").otherwise("found").alias("status"),
        F.coalesce("issue_count", F.lit(0)).alias("issue_count"))
    return issues.drop("conflict"), final


def lookup(keys: DataFrame, dimension: DataFrame, id_column: str, name_column: str) -> DataFrame:
    """Exact id match first, else exact name: (lookup_key, status, matches, entity_id).

    A name that many rows carry is counted before the join, so it stays one row.
    """
    by_id = dimension.groupBy(strip(F.col(id_column)).alias("k")).agg(
        F.count(F.lit(1)).alias("id_n"), F.min(id_column).alias("id_hit"))
    by_name = dimension.groupBy(strip(F.col(name_column)).alias("k")).agg(
        F.count(F.lit(1)).alias("name_n"), F.min(id_column).alias("name_hit"))
    asked = keys.withColumn("k", strip(F.col("lookup_key")))
    n = F.coalesce("id_n", "name_n", F.lit(0))
    return asked.join(by_id, "k", "left").join(by_name, "k", "left").select(
        "lookup_key", F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous").alias("status"),
        n.alias("matches"), F.when(n == 1, F.coalesce("id_hit", "name_hit")).alias("entity_id"))


def entity_profile(people: DataFrame, scores: DataFrame, facts: DataFrame, metrics: Sequence[str],
                   fact_columns: Sequence[str]) -> DataFrame:
    """Person with first score and first fact row; a missing child is ``no_record``, never zero.

    Children are (entity_id, position, columns as text); text that is not a number
    makes the child ``invalid_data``.
    """
    def child(df: DataFrame, columns: Sequence[str], prefix: str) -> DataFrame:
        first = df.groupBy("entity_id").agg(F.min_by(F.struct(*columns), F.col("position")).alias("r"))
        numbers = [F.col("r")[c].try_cast("double") for c in columns]
        bad = F.lit(False)
        for n in numbers:
            bad = bad | n.isNull()
        return first.select("entity_id", *[n.alias(c) for n, c in zip(numbers, columns)],
                            F.when(bad, "invalid_data").otherwise("found").alias(prefix + "_status"))

    total = F.lit(0.0)
    for m in metrics:
        total = total + F.col(m)
    out = people.join(child(scores, metrics, "score"), "entity_id", "left").join(
        child(facts, fact_columns, "fact"), "entity_id", "left")
    return out.select(
        *people.columns, *metrics, *fact_columns,
        F.when(F.col("score_status") == "found", F.round(total / len(metrics), 2)).alias("average"),
        F.coalesce("score_status", F.lit("no_record")).alias("score_status"),
        F.coalesce("fact_status", F.lit("no_record")).alias("fact_status"))


def ranked_children(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(joined, orphans): a run is valid only when no child lacks its parent."""
    return children.join(parents, key), children.join(parents.select(key), key, "left_anti")


def pairwise_differences(chosen: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """left - right for the pairs of each short comparison list, in list order.

    ``chosen`` has (comparison_id, entity_id, position, metrics); a list is what a
    caller names for one report, and its pairs are the report.
    """
    right = chosen.select("comparison_id", F.col("entity_id").alias("right_id"), F.col("position").alias("right_position"),
                          *[F.col(m).alias("right_" + m) for m in metrics])
    return chosen.join(right, "comparison_id").filter(F.col("position") < F.col("right_position")).select(
        "comparison_id", F.col("entity_id").alias("left_id"), "right_id",
        *[F.round(F.col(m) - F.col("right_" + m), 2).alias(m) for m in metrics])
