"""Benchmark the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
The panel is the 50-item one of FIXTURES.md (477,076 rows at sf0.1). Every
query starts from the parquet scan and is forced with a ``noop`` write, so
the time covers the whole plan and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from demandcast.operators import windows as W  # noqa: E402
from demandcast.operators.compare import compare_columns  # noqa: E402
from demandcast.operators.metrics import score_metrics  # noqa: E402
from demandcast.operators.split import split_by_time  # noqa: E402
from demandcast.operators.stats import split_counts, split_valid  # noqa: E402
from demandcast.plans.boosting import fit_boosted, predict_boosted  # noqa: E402
from demandcast.plans.features import feature_frame, feature_names  # noqa: E402
from demandcast.plans.model import fit_forecaster, predict  # noqa: E402
from demandcast.session import checkpointed, get_session, shared_path  # noqa: E402
from demandcast.sources.panel import read_sales  # noqa: E402
from demandcast.sources.sinks import save_table  # noqa: E402
from demandcast.sources.fixtures import (N_ITEMS_BENCH, lineitem_panel,  # noqa: E402
                                         unfolded_panel)

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEAT = 2
# Patience of the fit: it ends by early stopping, far from the default 5000 rounds.
FIT_PATIENCE = 10
# Rounds of the leaf-wise fit, which goes on improving for hundreds of rounds.
LEAFWISE_ROUNDS = 20
# Buckets of the stored panel (a layout of the data, not of the machine).
BUCKETS = 32


def force(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn, repeat: int = REPEAT) -> float:
    best = float("inf")
    for _ in range(repeat):
        t0 = time.perf_counter()
        fn()
        best = min(best, time.perf_counter() - t0)
    return round(best, 3)


def grouped_map_split(df, ratio: float = 0.8):
    """For comparison only: the same split rule evaluated per series in pandas
    (one Arrow round trip per group), the way a grouped map would do it."""
    import numpy as np
    import pandas as pd

    def tag(pdf: pd.DataFrame) -> pd.DataFrame:
        dates = np.sort(pdf["date"].to_numpy())
        cutoff = dates[int(len(dates) * ratio)]
        return pdf.assign(Dataset=np.where(pdf["date"].to_numpy() > cutoff, "Test", "Train"))

    return df.groupBy("store", "item").applyInPandas(
        tag, "date date, store int, item int, sales int, Dataset string")


def main() -> None:
    spark = get_session(f"local[{CPUS}]", app="demandcast-bench",
                        shuffle_partitions=2 * CPUS,
                        extra={"spark.driver.memory": "16g"})
    panel = lambda: lineitem_panel(spark, SF_DIR, n_items=N_ITEMS_BENCH)
    force(panel())  # warm-up: JVM, file listing, codegen caches

    q = {}
    q["b1_split"] = timed(lambda: force(split_by_time(panel())))
    cmp = {}  # alternatives to the default paths, reported beside the total
    cmp["b1_split_grouped_map"] = timed(lambda: force(grouped_map_split(panel())))
    q["b1_split_check"] = timed(lambda: split_valid(split_counts(split_by_time(panel()))).collect())
    q["b2_feature_frame"] = timed(lambda: force(feature_frame(panel())))
    # series per supplier and part: their number grows with the scale factor
    q["b2_unfolded"] = timed(lambda: force(feature_frame(unfolded_panel(spark, SF_DIR))))
    # the same frame over the panel stored bucketed by series, and writing it
    table = f"bench_panel_{os.getpid()}"
    cmp["b2_bucketed_write"] = timed(lambda: save_table(
        panel(), table, path=shared_path(spark, f"tables/{table}"),
        bucket_by=("store", "item"), buckets=BUCKETS))
    cmp["b2_feature_frame_bucketed"] = timed(lambda: force(feature_frame(read_sales(spark, table))))
    q["b3_ewm"] = timed(lambda: force(W.add_ewm(split_by_time(panel()), within="Dataset")))
    cmp["b3_ewm_window"] = timed(lambda: force(W.add_ewm(split_by_time(panel()),
                                                         within="Dataset", method="window")))

    def compare():
        t = split_by_time(panel())
        cols = [W.roll_name("sales", "roll", op, w) for op in ("sum", "mean", "std")
                for w in (3, 5, 7)]
        compare_columns(W.add_rolling(t, within="Dataset"),
                        W.add_rolling(t, within="Dataset", frame="rows"),
                        ["date", "store", "item"], cols).collect()
    q["compare_columns"] = timed(compare)

    def metrics():
        ff = feature_frame(panel()).withColumn(
            "prediction", F.coalesce(F.col("sales_lag_7").cast("double"), F.lit(0.0)))
        score_metrics(ff.filter(F.col("Dataset") == "Test"), by="store").collect()
    q["b5_store_metrics"] = timed(metrics)

    def fit_and_score():
        ff = checkpointed(feature_frame(panel()))
        train, valid, test = (ff.filter(F.col("Dataset") == t)
                              for t in ("Train", "Validation", "Test"))
        fit = fit_forecaster(train, valid, feature_names(), patience=FIT_PATIENCE)
        rounds["fitted"], rounds["kept"] = len(fit.history), fit.best_iteration
        score_metrics(predict(fit, test), by="store").collect()
    rounds = {}
    q["b4_fit_score"] = timed(fit_and_score)

    def fit_leafwise():
        ff = checkpointed(feature_frame(panel()))
        fit = fit_boosted(ff.filter(F.col("Dataset") == "Train"), ff.filter(F.col("Dataset") == "Validation"),
                          feature_names(), max_iter=LEAFWISE_ROUNDS, row_key=["store", "item", "date"])
        score_metrics(predict_boosted(fit, ff.filter(F.col("Dataset") == "Test")), by="store").collect()
    cmp[f"b4_leafwise_{LEAFWISE_ROUNDS}_rounds"] = timed(fit_leafwise, 1)

    sf = os.path.basename(SF_DIR.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_time", "value": round(sum(q.values()), 3),
                      "unit": "sec", "queries": q, "comparisons": cmp, "sf": sf, "cpus": CPUS,
                      "panel_items": N_ITEMS_BENCH, "fit_rounds": rounds,
                      "fit_patience": FIT_PATIENCE}))


if __name__ == "__main__":
    main()
