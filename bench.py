"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores. Every query runs its
whole plan into Spark's no-op sink; a short warm-up loads classes first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factorframe import build_session
from factorframe.plans.catalogue import REGISTRY

HEADLINE = (
    "daily_rank_ic", "features_short", "factor_ic_table", "icir_summary", "ic_decay", "psi_table", "resample_week", "cs_zscore",
    "label_xs_ret", "neutralize", "newey_west", "purged_kfold", "cv_evaluate", "top_k_all_dates", "industry_cap_select",
    "dropout_holdings", "portfolio_returns", "perf_summary", "style_exposure", "fama_macbeth", "attribution_summary", "validate_panel",
    "statistics_by_code", "densify", "asof_forward_shift", "stream_upsert_bars",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    REGISTRY["statistics_by_code"].run(spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in only:
        start = time.perf_counter()
        REGISTRY[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
