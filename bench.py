"""Benchmark: headline analyses over the canonical inspection table at $BENCH_SF_DIR.

The canonical table is first materialised once from the star schema (what a
production deployment keeps as a stored table) and timed separately; every analysis
then runs over the stored table, end to end, over all rows.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from faultline.functions.quantile import exact_quantiles  # noqa: E402
from faultline.operators import cluster, findings, investigate, kpi, patterns, trend  # noqa: E402
from faultline.plans.catalog import QUERIES, load_all  # noqa: E402
from faultline.session import get_spark  # noqa: E402
from faultline.sources.fixtures import PARAMS, inspections  # noqa: E402
from faultline.streaming import jobs  # noqa: E402


def run(df):
    """Force full computation of a result (small results are collected)."""
    return len(df.collect())


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus, app="faultline-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    load_all()

    def timed(name, fn):
        t0 = time.perf_counter()
        fn()
        times[name] = round(time.perf_counter() - t0, 3)

    timed("q00_materialize_canonical", lambda: inspections(spark, sf_dir, with_part_lot=True))
    df = inspections(spark, sf_dir, with_part_lot=True)      # stored by the step above

    timed("k02_kpi_totals", lambda: run(kpi.kpi_totals(df)))
    timed("k12_machine_ranking", lambda: run(kpi.member_ranking(df, "machine_id", "inspection_id")))
    timed("k08_defect_type_ranking", lambda: run(kpi.defect_type_ranking(df)))
    timed("k14_parameter_contrast", lambda: run(kpi.parameter_contrast(df)))
    timed("k20_batch_table", lambda: run(kpi.batch_table(df, batch_col="part_lot")))
    timed("k17_daily_rate_by_machine", lambda: run(kpi.daily_rate(df, "machine_id")))

    def trends():
        s = trend.trend_series(df)
        run(s)
        run(trend.change_points(s))
    timed("t06_trend_cusum_change_point", trends)

    pats, p90 = {}, {}
    timed("q01_parameter_p90", lambda: p90.update(exact_quantiles(df, PARAMS, 0.9)))     # for mining and contributions

    def mine():
        p = patterns.patterns(df, thresholds=p90)
        pats["p"] = p
        run(p.where(F.col("pattern_id").isNotNull()))
    timed("p15_pattern_mining", mine)
    timed("r05_recommendations", lambda: run(findings.recommendations(pats["p"])))
    timed("c02_contribution_ranking", lambda: run(investigate.contribution(df, "STANDARD", thresholds=p90)))
    timed("c05b_knn_information", lambda: run(investigate.knn_mutual_information(df, "STANDARD")))
    timed("c05_mutual_information", lambda: run(investigate.mutual_information(df, "STANDARD")))
    timed("m01_window_features", lambda: run(cluster.window_features(df)))
    timed("m04_kmeans_sweep", lambda: cluster.kmeans_sweep(cluster.scaled_features(df)))
    timed("c07_tree", lambda: run(investigate.decision_tree(df, "STANDARD")[0]))
    timed("i16_ingest", lambda: run(QUERIES["i16_validated_deduplicated"](spark, sf_dir).groupBy().count()))
    timed("m08_dbscan", lambda: run(cluster.dbscan(cluster.scaled_features(df))))
    timed("st01_stream_daily_rate", lambda: run(jobs.run_to_parquet(
        jobs.tumbling_rate(jobs.event_stream(spark, sf_dir)), "bench-st01")))

    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cores": cpus, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
