"""python tests/check_queries.py SF_DIR [names...]: run queries against their SQL."""

import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from comparing import compare, connect  # noqa: E402
from gleanery.plans import MODULES, all_checks, all_queries, catalogs  # noqa: E402

if __name__ == "__main__":
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    runs, checks = all_queries(), all_checks()
    modules = dict(zip(MODULES, catalogs()))
    names = []
    for w in wanted or MODULES:
        names += list(modules[w].runs) if w in modules else [w]
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = runs[name](spark, sf_dir)
            problem = compare(df, con, checks[name]) if name in checks else f"ROWS ONLY {df.count()}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        bad += problem is not None and not problem.startswith("ROWS ONLY")
        print(f"{name:32s} {time.time() - t0:6.2f}s {'ok' if problem is None else problem}", flush=True)
    print(f"{len(names)} queries, {bad} with differences")
