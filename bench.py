"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs to its end into a no-op sink, twice, so nothing is collected; the total counts the first runs. Stage tables (the daily fact, the
feature matrix) are written once, as in a job of several steps, and timed on their own.
"""

from __future__ import annotations

import json
import os
import time

from saleswright.session import clear_scratch, get_session


def timed(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "saleswright-bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "16g",
           # At this scale a shuffle holds a few MB; keep it spread over the cores all the same.
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    from saleswright.catalog import base, queries

    registered = queries()
    seconds = {
        "stage_fact_region": timed(lambda: base.fact(spark, sf_dir)),
        "stage_fact_nation": timed(lambda: base.fact(spark, sf_dir, "nation")),
        "stage_features": timed(lambda: base.staged_features(spark, sf_dir)),
    }
    headline = (
        "w6_feature_matrix", "h8_mint_shrink_levels", "f8_trained_cv", "f3_cv_pooled", "h4_aggregated_levels", "h7_mint_ols", "x4_waterfall", "e1_request_rates",
        "j6_feature_lookup", "a6_interval_offsets", "f11_batch_prediction", "naive_holdout_by_family",
    )
    again = {}
    for name in headline:
        run = lambda: registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        seconds[name], again[name] = timed(run), timed(run)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "second_run": again,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
