"""URL filters: explicit rules, and gradient-boosted trees over lexical features for the rest.

URLs that a rule judges are the labelled ones. Trees learn from their length, depth,
digit ratio, entropy, parameters and the block rates of their suffixes, and judge the
URLs that no rule names.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from gleanery.operators.storage import settle

#: (verdict, host, path): a rule fits its host and all its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Labelled URLs to learn from, about; more are thinned by the hash of the URL.
TRAINING_ROWS = 50_000
FOLDS = 5
FEATURES = ("chars", "host_chars", "path_chars", "host_depth", "path_depth", "digit_ratio", "entropy", "params", "query_chars",
            "marks", "has_fragment", "suffix_rate", "suffix_known", "segment_rate", "segment_known")
_SIGNS = string.ascii_lowercase + string.digits + "-._~:/?#=&%+"


def url_parts(url: str) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty where it is null or has no ://."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: str, path: str, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    def first(value) -> Column:
        ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
        fits = [F.when(((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p), F.lit(value(v, h, p)))
                for v, h, p in ordered]
        return F.coalesce(*fits, F.lit(None).cast("string"))
    return first(lambda v, h, p: h + p), first(lambda v, h, p: v)


def _entropy(text: Column, length: Column) -> Column:
    """Bits per character, characters outside the URL signs counted as one kind."""
    counts = [length - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _SIGNS]
    counts.append(length - sum(counts[1:], counts[0]))
    share = lambda n: n / F.greatest(length, F.lit(1))
    return F.aggregate(F.array(*counts), F.lit(0.0), lambda a, n: a - F.when(n > 0, share(n) * F.log2(share(n))).otherwise(0.0))


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path) with its lexical features, its ``suffix`` (last two host labels) and first path ``segment``."""
    text = F.lower(F.coalesce("url", F.lit("")))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    length = F.length(text)
    digits = length - F.length(F.translate(text, string.digits, ""))
    return urls.withColumns({
        "chars": length, "host_chars": F.length("host"), "path_chars": F.length("path"),
        "host_depth": F.size(F.split("host", r"\.")), "path_depth": F.size(F.split("path", "/")),
        "digit_ratio": digits / F.greatest(length, F.lit(1)), "entropy": _entropy(text, length),
        "params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "query_chars": F.length(query),
        "marks": F.length(F.regexp_replace(text, r"[a-z0-9]", "")), "has_fragment": F.contains(text, F.lit("#")).cast("int"),
        "suffix": F.regexp_extract("host", r"[^.]*\.?[^.]*$", 0), "segment": F.regexp_extract("path", r"^/[^/]*", 0),
        "fold": F.pmod(F.xxhash64("url"), F.lit(FOLDS)).cast("int")})


def _with_rates(rows: DataFrame, labelled: DataFrame, key: str) -> DataFrame:
    """Block rate and number of labelled URLs per key; labelled rows see only the other folds, so none sees itself."""
    folds = labelled.groupBy(key, "fold").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    whole = folds.groupBy(key).agg(F.sum("blocked").alias("all_blocked"), F.sum("n").alias("all_n"))
    seen = rows.join(settle(whole), key, "left").join(settle(folds), [key, "fold"], "left")
    own = lambda c: F.when(F.col("label").isNotNull(), F.coalesce(c, F.lit(0))).otherwise(0)
    n = F.coalesce("all_n", F.lit(0)) - own("n")
    blocked = F.coalesce("all_blocked", F.lit(0)) - own("blocked")
    return (seen.withColumn(f"{key}_rate", (blocked + 1.0) / (n + 2.0)).withColumn(f"{key}_known", F.log1p(n))
            .drop("blocked", "n", "all_blocked", "all_n"))


def judge(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, training_rows: int = TRAINING_ROWS,
          trees: int = 15, depth: int = 4) -> DataFrame:
    """page_id, host, path, ``rule`` that fits (or null), ``verdict`` (allow or block) and ``block_score`` (the trees', 0 to 1).

    A rule's verdict stands; elsewhere the trees' does. ``labels`` (url, label 0 or 1) adds labelled URLs. About
    ``training_rows`` labelled rows are learned from. Where all labels agree, so does the verdict; without
    labels it is allow. Null URLs have empty parts and are judged by the same features. ``rules`` is a short list.
    """
    host, path = url_parts("url")
    parts = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, verdict = matched_rule("host", "path", rules)
    rows = lexical_features(parts.withColumns({"rule": rule, "ruled": verdict}))
    rows = settle(rows.withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == "block").cast("int"))))
    learned = rows.filter("label is not null")
    if labels is not None:
        given = labels.select("url", F.col("label").cast("int").alias("label")).filter("label in (0, 1)").withColumns({"host": host, "path": path})
        learned = learned.unionByName(lexical_features(given), allowMissingColumns=True)
    scored = _with_rates(_with_rates(rows, learned, "suffix"), learned, "segment")
    sizes = {r["label"]: r["n"] for r in learned.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        out = scored.withColumn("block_score", F.lit(float(1 in sizes)))
    else:
        share = int(1_000_000 * min(1.0, training_rows / sum(sizes.values())))
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        known = learned if labels is None else learned.select(*rows.columns)
        training = known.filter(F.pmod(F.xxhash64("url", F.lit("sample")), F.lit(1_000_000)) < share)
        training = settle(_with_rates(_with_rates(training, learned, "suffix"), learned, "segment").select("label", *FEATURES))
        model = GBTClassifier(labelCol="label", featuresCol="features", maxIter=trees, maxDepth=depth, maxBins=32, seed=5).fit(
            assembled.transform(training))
        model.setProbabilityCol("probability")
        out = model.transform(assembled.transform(scored)).withColumn("block_score", vector_to_array("probability")[1])
    judged = F.coalesce("ruled", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", judged.alias("verdict"), "block_score")
