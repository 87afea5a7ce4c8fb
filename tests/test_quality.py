"""The shared pass over a table's cells against a plain profile."""

import random
import re

from pyspark.sql import functions as F

from gleanery.operators.profile import field_profile
from gleanery.operators.quality import column_facts, validate_table


def kind(v):
    v = v.strip()
    if v.lower() in ("true", "false"):
        return "boolean"
    if re.fullmatch(r"[-+]?\d+", v):
        return "integer"
    return "number" if re.fullmatch(r"[-+]?(\d+\.\d*|\d*\.\d+)([Ee][-+]?\d+)?", v) else "string"


def test_facts_of_columns(spark):
    rng = random.Random(3)
    pick = {"name": [" Ann", "ann", "Bo", None, " ", "Straße", "strasse"], "score": ["5", "101", "-1", "x", "9.5", None, "1e3"], "email": ["a@b.c", "a b", "", None],
            "手机号": ["138 1234 5678", "12", None], "学号": ["S1", "s1", "S2", "S3", None], "memo": [None, " "]}
    rows = [tuple(rng.choice(v) for v in pick.values()) for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in pick))
    got = {r["source_name"]: r for r in column_facts(df).collect()}
    for i, c in enumerate(pick):
        cells = [r[i] for r in rows]
        full = [v.strip() for v in cells if v and v.strip()]
        keys = [v.lower().replace("ß", "ss") for v in full]
        r = got[c]
        assert (r["row_count"], r["null_count"]) == (60, 60 - len(full))
        assert sorted(r["kinds"]) == sorted({kind(v) for v in full})
        assert r["groups"] == (sum(keys.count(k) > 1 for k in set(keys)) if c in ("name", "学号") else 0)
        assert r["range"] == (sum(kind(v) not in ("integer", "number") or not 0 <= float(v) <= 100 for v in full) if c == "score" else 0)
        bad = {"email": lambda v: not re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", v), "手机号": lambda v: not re.fullmatch(r"\+?\d[\d\s-]{5,19}", v)}.get(c)
        assert r["contact"] == (sum(map(bad, full)) if bad else 0)


def test_a_table_is_read_once(spark, tmp_path):
    spark.range(1000).select(F.col("id").cast("string").alias("学号"), F.lit("x").alias("memo")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for result, scans in ((validate_table(df, "s"), 2), (field_profile(df), 1)):
        plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan parquet") <= scans and plan.count("Generate explode(array(named_struct") <= scans
    assert validate_table(df.filter("memo = 'y'"), "s").collect() == []
