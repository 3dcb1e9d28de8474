import datetime as dt
import re

from pyspark.sql import functions as F

from conftest import SF_SMOKE
from demandcast.operators import windows as W
from demandcast.plans.features import feature_frame, feature_names
from demandcast.plans.registry import rounded
from demandcast.session import shared_path
from demandcast.sources.fixtures import lineitem_panel
from demandcast.sources.sinks import RunLog


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def count(text, node):
    """Operators named ``node`` in a physical plan string (codegen ids stripped)."""
    lines = (re.sub(r"^\*\(\d+\) ", "", line.lstrip(" :+-")) for line in text.splitlines())
    return sum(1 for line in lines if line.startswith(node))


def test_feature_frame_has_26_features_and_columns(spark):
    ff = feature_frame(lineitem_panel(spark, SF_SMOKE))
    assert len(feature_names()) == 26
    assert ff.columns[:5] == ["date", "store", "item", "sales", "Dataset"]
    assert set(feature_names()) <= set(ff.columns) and len(ff.columns) == 29
    types = dict(ff.dtypes)
    assert types["sales_lag_1"] == "int" and types["sales_roll_sum_3"] == "bigint"
    assert types["public_holiday"] == "int" and types["sales_ewm_06"] == "double"


def test_feature_frame_plan_one_shuffle_no_python(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(feature_frame(lineitem_panel(spark, SF_SMOKE)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # one exchange for the lineitem aggregate, one for the series windows;
    # the holiday rules are an expression, so nothing is broadcast
    assert count(text, "Exchange hashpartitioning") == 2
    assert count(text, "BroadcastExchange") == 0
    assert count(text, "Sort [") == 2  # split order, then (series, set) order
    for node in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert node not in text


def test_scan_prunes_columns(spark):
    ff = feature_frame(lineitem_panel(spark, SF_SMOKE))
    text = plan_text(ff)
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", text)
    assert schemas
    for schema in schemas:
        assert set(re.findall(r"(\w+):", schema)) == {"l_partkey", "l_suppkey", "l_quantity", "l_shipdate"}


def test_store_filter_pushes_below_window(spark):
    ff = feature_frame(lineitem_panel(spark, SF_SMOKE)).filter(F.col("store") == 3)
    opt = ff._jdf.queryExecution().optimizedPlan().toString()
    # the partition-key filter sits below the Window operators, on the scan's own column
    assert "Filter" not in opt[:opt.rfind("Window")]
    assert "l_suppkey" in opt[opt.rfind("Filter"):].splitlines()[0]


def test_ewm_window_path_is_one_sort(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = lineitem_panel(spark, SF_SMOKE)
        text = plan_text(W.add_ewm(W.add_lags(df), method="window"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert count(text, "Sort [") == 1
    assert "FlatMapGroupsInPandas" not in text


def test_compare_join_reuses_series_partitioning(spark):
    from demandcast.plans import registry
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan_text(registry.q_compare_columns(spark, SF_SMOKE))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # source aggregate and series windows (reused by the second side); the
    # join adds none; one single-partition exchange for the final aggregate
    assert count(text, "Exchange hashpartitioning") == 2
    assert count(text, "ReusedExchange") == 1
    assert count(text, "Exchange SinglePartition") == 1


def test_aggregates_combine_before_their_shuffle(spark):
    """Hot keys are pre-aggregated map-side: a partial aggregate sits below each exchange."""
    from demandcast.operators.metrics import score_metrics
    from demandcast.operators.split import split_by_time
    from demandcast.operators.stats import split_counts
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        panel = lineitem_panel(spark, SF_SMOKE)
        scored = panel.withColumn("prediction", F.col("sales") + 1)
        for df in (panel, split_counts(split_by_time(panel)),
                   score_metrics(scored, by="store")):
            text = plan_text(df)
            # every hash exchange feeding an aggregate has a map-side aggregate
            # (partial functions, or a pruned map-side distinct) right below it
            lines = text.splitlines()
            for i, line in enumerate(lines):
                if "Exchange hashpartitioning" in line and "HashAggregate" in lines[i - 1]:
                    assert "HashAggregate" in lines[i + 1]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_weather_lookup_is_broadcast_not_shuffled(spark):
    from demandcast.operators.lookups import add_weather
    from demandcast.sources.fixtures import derived_weather
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = add_weather(lineitem_panel(spark, SF_SMOKE), derived_weather(spark, SF_SMOKE))
        text = plan_text(df)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_feature_frame_on_bucketed_panel_needs_no_shuffle(spark):
    from demandcast.session import shared_path
    from demandcast.sources.panel import read_sales
    from demandcast.sources.sinks import RunLog, save_table
    name = f"bucketed_{RunLog.new_run_id()[:8]}"
    save_table(lineitem_panel(spark, SF_SMOKE), name, path=shared_path(spark, f"tables/{name}"),
               bucket_by=("store", "item"), buckets=4)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ff = feature_frame(read_sales(spark, name))
        text = plan_text(ff)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert count(text, "Exchange hashpartitioning") == 0
    assert ff.count() == 5858


def test_feature_frame_ewm_methods_agree(spark):
    panel = lineitem_panel(spark, SF_SMOKE)
    a = feature_frame(panel)
    b = feature_frame(panel, ewm_method="blocks")
    assert a.columns == b.columns
    key = ["store", "item", "date"]
    j = a.select(*key, "sales_ewm_06", "sales_ewm_085", "Dataset").join(
        b.select(*key, F.col("sales_ewm_06").alias("b06"), F.col("sales_ewm_085").alias("b085"),
                 F.col("Dataset").alias("bset")), key)
    assert j.count() == 5858
    assert j.filter((F.abs(F.col("sales_ewm_06") - F.col("b06")) > 1e-9)
                    | (F.abs(F.col("sales_ewm_085") - F.col("b085")) > 1e-9)
                    | (F.col("Dataset") != F.col("bset"))).count() == 0


def test_feature_days_equals_the_full_frame(spark):
    import random

    from demandcast.plans.features import feature_days
    rng = random.Random(6)
    rows = []
    for store in range(1, 5):
        day = 0
        for i in range(30 * store):
            day += rng.choice([1, 1, 1, 2, 5])
            sales = None if rng.random() < 0.15 or (store == 2 and i > 40) else rng.randint(1, 50)
            rows.append((dt.date(2020, 1, 1) + dt.timedelta(days=day), store, 1, sales))
    p = spark.createDataFrame(rows, "date date, store int, item int, sales int")
    full = [tuple(r) for r in rounded(feature_frame(p)).collect()]
    columns = feature_frame(p).columns
    for start, end in (("2020-01-01", "2020-01-09"), ("2020-02-20", "2020-02-20"), ("2020-05-01", "2020-06-10"),
                       ("2020-03-05", "2020-12-31"), ("2030-01-01", "2030-01-02"), ("2010-01-01", "2010-01-02")):
        got = rounded(feature_days(p, start, end))
        assert got.columns == columns
        want = [r for r in full if start <= str(r[0]) <= end]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
        again = rounded(feature_days(p, start, end, broadcast_rows=0))
        assert sorted(map(tuple, again.collect()), key=str) == sorted(want, key=str)


def test_feature_days_reads_a_bounded_span(spark):
    from demandcast.plans.features import feature_days
    path = shared_path(spark, f"test-panel-{RunLog.new_run_id()}")
    days = spark.range(3000).select(F.date_add(F.lit("2010-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                    F.lit(1).alias("store"), F.lit(1).alias("item"),
                                    (F.col("id") % 17).cast("int").alias("sales"))
    days.repartitionByRange(10, "date").write.parquet(path)
    out = feature_days(spark.read.parquet(path), "2016-06-01", "2016-06-01")
    plan = out._jdf.queryExecution().toString()
    since = dt.date(2016, 6, 1) - dt.timedelta(days=47)  # the EWM's reach
    pushed = [f for f in plan.splitlines() if "PushedFilters" in f and f"GreaterThanOrEqual(date,{since}" in f]
    assert pushed and "LessThanOrEqual(date,2016-06-08)" in pushed[0]
    assert out.count() == 1
