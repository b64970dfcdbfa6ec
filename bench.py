"""Time the headline queries: one JSON line.

``BENCH_SF_DIR`` names the folder of the tables, ``BENCH_CPUS`` the local cores. Every query
is computed in full into the ``noop`` sink, so Python row conversion is not measured.
"""

from __future__ import annotations

import json
import os
import time

from folkscope.queries import QUERIES
from folkscope.session import build_session, clear_scratch

HEADLINE = [
    "country_content",
    "genre_profile",
    "agg_weighted_share",
    "majority_response",
    "join_star_chain",
    "pivot_wide",
    "agg_across",
    "stacked_share",
    "window_group_total",
    "top_n_ties",
    "row_index",
    "reorder_levels",
    "parse_dmy",
    "json_flatten_first",
    "replace_first",
    "src_multi_file",
    "profile_summary",
    "profile_top_values",
    "glm_counts",
    "glm_bernoulli",
    "augment",
    "ols_fit",
    "ci_profile",
    "refit_without",
    "culture_model",
    "film_table",
    "analysis_table",
    "profile_describe",
    "profile_numeric",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small run of each kind of work, so that the first query does not pay for class loading.
    QUERIES["country_content"](spark, folder).write.format("noop").mode("overwrite").save()
    QUERIES["glm_counts"](spark, folder).collect()
    seconds = {}
    for key in HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
