"""Benchmark the headline work.

Default mode mirrors production: the master table is prepared once
(cleaned, merged, featured, split by time and written to the checkpoint
folder: "prepare"), then every headline analysis runs over it. With
``--from-raw`` each registered query instead runs its full plan from the
raw driver tables.

Runs at $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]
and prints ONE JSON line:
{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}
Results go to the no-op sink (full execution, no driver collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q_master", "q_corridor", "q_state_satisfaction", "q_delay_band", "q_correlation",
    "q_mann_whitney", "q_spearman", "q_time_split", "q_split_drift", "q_seller_features_test",
    "q_seller_performance", "q_segment_profile", "q_feature_matrix", "q_auc", "q_roc_curve",
]


def _sink(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def prepared_analyses(p):
    """Headline analyses over a prepared master (name -> thunk)."""
    from pyspark.sql import functions as F

    from routewise.operators import evaluate as ev
    from routewise.operators.split import split_summary
    from routewise.plans import corridors, eda, prediction as pr, sellers

    def features():
        tr, te = sellers.add_seller_features(p.train, p.test)
        cols = pr.FEATURE_COLUMNS
        tr, te, _ = pr.impute_medians(pr.as_features(tr, cols, ["order_id"]),
                                      pr.as_features(te, cols, ["order_id"]), cols)
        return tr.unionByName(te)

    labelled = p.train.withColumn("is_train", F.lit(1)).unionByName(
        p.test.withColumn("is_train", F.lit(0)))
    return {
        "q_corridor": lambda: corridors.corridor_stats(p.master),
        "q_state_satisfaction": lambda: corridors.state_satisfaction(p.master),
        "q_delay_band": lambda: eda.delay_band_satisfaction(p.master),
        "q_correlation": lambda: eda.correlation_matrix(p.master),
        "q_mann_whitney": lambda: corridors.same_state_test(p.master),
        "q_spearman": lambda: corridors.corridor_spearman(corridors.corridor_stats(p.master)),
        "q_split_drift": lambda: split_summary(labelled),
        "q_seller_features_test": lambda: sellers.add_seller_features(p.train, p.test)[1],
        "q_seller_performance": lambda: sellers.seller_performance(p.master),
        "q_segment_profile": lambda: sellers.segment_profile(
            sellers.name_sellers(sellers.given_segments(sellers.seller_performance(p.master)))),
        "q_feature_matrix": features,
        "q_auc": lambda: ev.auc(pr.given_scores(p.test)),
        "q_roc_curve": lambda: ev.roc_curve(pr.given_scores(p.test)),
    }


def main() -> None:
    from routewise.plans.pipeline import prepare
    from routewise.plans.queries import QUERIES
    from routewise.session import build_session
    from routewise.sources import fixture_tables

    from_raw = "--from-raw" in sys.argv
    names = [a for a in sys.argv[1:] if not a.startswith("--")]
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="routewise-bench-")
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.local.dir": scratch,
    })
    # warm-up: JIT and class loading are not part of any timing, so the
    # same code paths run once, untimed, on the smallest dataset
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    if from_raw:
        for name in names or HEADLINE:
            _sink(QUERIES[name](spark, warm_dir))
    else:
        wp = prepare(fixture_tables(spark, warm_dir))
        _sink(wp.train)
        for thunk in prepared_analyses(wp).values():
            _sink(thunk())
    times = {}
    if from_raw:
        for name in names or HEADLINE:
            t0 = time.time()
            _sink(QUERIES[name](spark, sf_dir))
            times[name] = round(time.time() - t0, 3)
        metric = "headline_queries_from_raw_total"
    else:
        t0 = time.time()
        p = prepare(fixture_tables(spark, sf_dir))  # master written once, split found
        _sink(p.train)
        times["prepare"] = round(time.time() - t0, 3)
        for name, thunk in prepared_analyses(p).items():
            if names and name not in names:
                continue
            t0 = time.time()
            _sink(thunk())
            times[name] = round(time.time() - t0, 3)
        metric = "prepare_once_then_headline_analyses_total"
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": metric, "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
