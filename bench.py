"""Times the headline queries: a line a query on stderr as it ends, then one line of JSON."""

import json
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

from strikelab import registry  # noqa: E402

HEADLINE = ["atm_straddle", "otm_strangle", "strike_asof", "sl_single", "sl_combined", "trail_ratio", "mtm_portfolio", "psl_levels", "st_b120", "st_dt", "st_nre", "st_sut", "st_s2ut", "st_shift", "mod_weekly", "mod_psl_dt", "supertrend_long", "cube_unpivot", "heatmap_totals", "calmar"]
#: Seconds for one query, and for all.
LIMIT, BUDGET = 180, 1200


def timed(spark: SparkSession, name: str, sf: str, limit: float) -> float | None:
    """Seconds, or None if the query took longer than limit or failed."""
    watch = threading.Timer(limit, spark.sparkContext.cancelAllJobs)
    watch.start()
    began = time.time()
    try:
        registry.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)
    except Exception as e:  # noqa: BLE001  one query's failure doesn't cost the others' times
        print(f"{name}: {type(e).__name__} {str(e)[:200]}", file=sys.stderr, flush=True)
        return None
    finally:
        watch.cancel()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times, began = {}, time.time()
    for name in HEADLINE:
        left = BUDGET - (time.time() - began)
        times[name] = timed(spark, name, sf, min(LIMIT, left)) if left > 0 else None
        print(name, times[name], file=sys.stderr, flush=True)
    done = [x for x in times.values() if x is not None]
    print(json.dumps({"metric": "headline queries", "value": round(sum(done), 3), "unit": "sec", "queries": times, "sf": sf}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
