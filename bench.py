"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from logloom.plans import catalogue

HEADLINE = (
    "p1_parse_line", "f2_mask", "f3_f4_tokens", "f6_lex", "g1_drain", "g2_drain_stock", "g3_drain_delimited", "g4_drain_fullsearch", "g5_statistical", "d1_online",
    "a1_idf", "f17_templates", "a4_a8_slots", "a12_template_logs", "a13_documents", "m1_quality", "s1_text_lines",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    n_lines = catalogue.event_lines(spark, sf_dir).count()
    queries["g2_drain_stock"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts JVM code and workers
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    rates = {f"{k}_lines_per_s": round(n_lines / took[q]) for k, q in (("group", "g1_drain"), ("stock_group", "g2_drain_stock"), ("online", "d1_online"), ("render", "a12_template_logs"))}
    print(json.dumps({"metric": "total_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "event_lines": n_lines, **rates}))
    spark.stop()


if __name__ == "__main__":
    main()
