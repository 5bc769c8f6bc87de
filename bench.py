"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line. Starting Spark isn't counted."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = ["indicators_features", "bars_hourly_ohlcv", "bars_volume", "align_as_of_business_days", "align_interpolate", "regimes_statistics", "options_greeks", "options_portfolio_greeks", "performance_drawdowns", "performance_trade_statistics", "risk_value_at_risk", "validation_linear_folds"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from quantframe.jobs import registry

    took = {}
    registry.QUERIES["bars_bucket_statistics"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir).removeprefix("sf"), "lineitem_rows": rows}))


if __name__ == "__main__":
    main()
