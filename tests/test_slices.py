"""Order-dependent operators on groups that fill many slices, against plain loops."""

import random

from pyspark.sql import functions as F

from gleanery.operators import ranking as rk
from gleanery.operators.windows import heading_path, repeat_requests


def accepted(times, period):
    out, last = {}, None
    for t in sorted(times):
        if last is None or t - last > period:
            last = t
        out[t] = last
    return out


def test_repeats_in_bursts_of_any_length(spark):
    rng = random.Random(9)
    data = []
    for key in range(6):
        t = 0
        for _ in range(rng.choice([1, 5, 200])):
            t += rng.choice([0, 1, 30, 299, 300, 301, 5000])
            data.append((key, t))
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(data)], "id bigint, k int, s bigint").withColumn("at", F.timestamp_seconds("s"))
    got = repeat_requests(df, ["k"], "at", "id", slices=16).collect()
    assert len(got) == len(data)
    for key in range(6):
        times = {}
        for i, (k, t) in enumerate(data):
            if k == key:
                times.setdefault(t, i)
        want = accepted(times, 300)
        assert {r["id"]: r["accepted_id"] for r in got if r["k"] == key} == {
            i: times[want[t]] for i, (k, t) in enumerate(data) if k == key}


def test_a_burst_of_a_million_times(spark):
    """One key, a time about every 1.5 ms without a gap: some 1,500 periods of a second in a chain."""
    ids = spark.range(1_000_000).select("id", F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 1500 + F.xxhash64("id") % 700).alias("at"))
    got = repeat_requests(ids, ["k"], "at", "id", seconds=1, slices=24)
    rows = got.select("id", F.unix_micros("at").alias("t"), "accepted_id").toPandas()
    first = rows.groupby("t")["id"].min()
    want = accepted(first.index.tolist(), 1_000_000)
    assert len(rows) == 1_000_000 and (rows["accepted_id"] == rows["t"].map(want).map(first)).all()
    assert rows["accepted_id"].nunique() > 1400


def test_pointers_are_kept_for_the_times_at_which_chains_come_in(spark, monkeypatch):
    """One key, 20,000 times in a burst of 400 periods: pointers for a period of each of 24 slices, not for every time."""
    from gleanery.operators import windows
    kept, settle = [], windows.settle
    monkeypatch.setattr(windows, "settle", lambda df: (kept.append(settle(df)), kept[-1])[1])
    ids = spark.range(20_000).select("id", F.lit("k").alias("k"), F.timestamp_micros(F.col("id") * 20_000 + F.xxhash64("id") % 9000).alias("at"))
    got = repeat_requests(ids, ["k"], "at", "id", seconds=1, slices=24)
    rows = got.select("id", F.unix_micros("at").alias("t"), "accepted_id").toPandas()
    want, first = accepted(rows["t"].tolist(), 1_000_000), rows.groupby("t")["id"].min()
    assert len(rows) == 20_000 and (rows["accepted_id"] == rows["t"].map(want).map(first)).all()
    pointers = [df.count() for df in kept if "__jump" in df.columns]
    assert pointers and max(pointers) < 24 * 60

def paths(levels):
    out, titles = [], {}
    for i, level in enumerate(levels):
        if level:
            titles = {n: t for n, t in titles.items() if n < level} | {level: f"t{i}"}
        out.append([titles[n] for n in sorted(titles)])
    return out


def test_heading_paths_of_a_long_file(spark):
    rng = random.Random(11)
    files = {"long": [rng.choice([None] * 30 + [1, 2, 3, 4, 5, 6]) for _ in range(20_000)], "flat": [None] * 50, "deep": [6, 5, 4, 3, 2, 1, None, 2, 6, 3]}
    df = spark.createDataFrame([(f, i, f"t{i}", x) for f, levels in files.items() for i, x in enumerate(levels)],
                               "file_id string, line_number int, content string, heading_level int")
    got = heading_path(df.repartition(7), slices=16)
    found = {}
    for r in got.collect():
        found.setdefault(r["file_id"], {})[r["line_number"]] = r["heading_path"]
    for f, levels in files.items():
        assert [found[f][i] for i in range(len(levels))] == paths(levels)


def test_a_long_group_fills_many_slices(spark):
    df = spark.range(20_000).select(F.lit("a").alias("g"), "id", (F.col("id") % 50).alias("v"))
    base = rk.sliced(df, ["g"], ["v", "id"], 16)
    sizes = [r["count"] for r in base.groupBy("__s").count().collect()]
    assert len(sizes) >= 12 and max(sizes) < 4 * 20_000 / 16
    plan = rk.position_in_group(df, ["g"], "v", "id", slices=16)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and plan.count("Scan parquet") == 2 and "Range (" not in plan
