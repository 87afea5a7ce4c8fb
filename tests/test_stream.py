"""The trace stream: late rows, quiet sessions, restarts, compaction."""

import os
import shutil
import time
from datetime import datetime, timedelta

from gleanery.streaming import trace_stream as ts

SCHEMA = "trace_id int, session_id string, event_type string, result_status string, duration_ms int, metrics_json string, created_at timestamp"


def add(spark, base, ids, days=0):
    data = [(i, f"s{i % 2}", "tool_execution" if i % 5 else "research_stage", "success" if i % 3 else "failed", i, '{"p": "13812345678"}',
             datetime(2024, 1, 1) + timedelta(days=days, seconds=i)) for i in ids]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.mode("append").parquet(base + "/in")


def run(spark, base, quiet=None):
    ts.clean_log(spark, base + "/in", base + "/log", base + "/cp1", "10 days")
    ts.session_counters(spark, base + "/log", base + "/out", base + "/cp2", quiet)
    return counters(spark, base)


def counters(spark, base):
    rows = ts.latest_counters(spark, base + "/out").collect()
    return {r["session_id"]: (r["calls"], r["failed_calls"], r["total_duration_ms"], r["max_duration_ms"]) for r in rows}


def wanted(ids):
    mine = lambda s: [i for i in ids if i % 2 == s and i % 5]
    return {f"s{s}": (len(mine(s)), sum(i % 3 == 0 for i in mine(s)), sum(mine(s)), max(mine(s))) for s in (0, 1) if mine(s)}


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    base = str(tmp_path)
    add(spark, base, range(20), days=100)
    assert run(spark, base) == wanted(range(20))
    add(spark, base, [*range(10, 20), *range(20, 26)], days=0)  # repeats and rows a hundred days old
    add(spark, base, range(30, 33), days=95)
    assert run(spark, base) == wanted([*range(26), 30, 31, 32])
    log = spark.read.parquet(base + "/log")
    assert sorted(r["trace_id"] for r in ts.late_rows(log, "30 days").collect()) == list(range(20, 26))
    assert sorted(r["trace_id"] for r in ts.late_rows(log, "2 days").collect()) == [*range(20, 26), 30, 31, 32]
    assert {r[0] for r in log.select("metrics_json").collect()} == {'{"p": "138****5678"}'}


def test_state_of_quiet_sessions_goes(spark, tmp_path):
    base = str(tmp_path)
    add(spark, base, range(10))
    run(spark, base, quiet=1)
    time.sleep(1.2)
    add(spark, base, range(12, 15))
    got = run(spark, base, quiet=1)
    assert got == wanted([*range(10), 12, 13, 14])
    runs = spark.read.parquet(base + "/out/batches").groupBy("session_id").agg({"since": "min", "calls": "min"}).collect()
    since = {r[0]: {x["since"] for x in spark.read.parquet(base + "/out/batches").filter(f"session_id = '{r[0]}'").collect()} for r in runs}
    assert {len(x) for x in since.values()} == {2}  # the second run started anew


def test_restart_and_compaction(spark, tmp_path):
    base = str(tmp_path)
    add(spark, base, range(12))
    run(spark, base)
    add(spark, base, range(12, 30))
    want = run(spark, base)
    assert want == wanted(range(30))
    # the last batch was written but not committed
    last = max(int(f) for f in os.listdir(base + "/cp2/commits") if f.isdigit())
    os.remove(f"{base}/cp2/commits/{last}")
    if os.path.exists(f"{base}/cp2/commits/.{last}.crc"):
        os.remove(f"{base}/cp2/commits/.{last}.crc")
    assert run(spark, base) == want
    keep = base + "/copy"
    shutil.copytree(base + "/out/batches", keep)
    ts.compact_counters(spark, base + "/out")
    assert counters(spark, base) == want and not [f for f in os.listdir(base + "/out/batches") if "=" in f]
    for f in os.listdir(keep):  # as if the batches had not been deleted
        if "=" in f:
            shutil.copytree(f"{keep}/{f}", f"{base}/out/batches/{f}")
    assert counters(spark, base) == want
    ts.compact_counters(spark, base + "/out")
    add(spark, base, range(30, 41))
    assert run(spark, base) == wanted(range(41))
    ts.compact_counters(spark, base + "/out")
    assert counters(spark, base) == wanted(range(41)) and len(os.listdir(base + "/out/bases")) == 1
