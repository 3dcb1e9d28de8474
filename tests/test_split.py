import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import daily, panel_df
from demandcast.operators.split import split_by_time, split_nested, train_test_frames
from demandcast.sources.panel import parse_dates, unparsable_dates


def tags(df):
    return [r["Dataset"] for r in df.orderBy("store", "item", "date").collect()]


@pytest.mark.parametrize("n", [1, 2, 5, 10])
def test_k_plus_one_train_rows(spark, n):
    out = split_by_time(panel_df(spark, daily("2020-01-01", n)), ratio=0.8)
    k = int(n * 0.8)
    assert tags(out).count("Train") == min(n, k + 1)


def test_ties_on_cutoff_stay_train(spark):
    rows = daily("2020-01-01", 5)
    rows.append((rows[3][0], 1, 1, 99))  # a second row on the cutoff date (position k=4)
    rows = sorted(rows)
    out = split_by_time(panel_df(spark, rows), ratio=0.8).filter(F.col("date") == rows[4][0])
    assert {r["Dataset"] for r in out.collect()} == {"Train"}


@pytest.mark.parametrize("ratio", [0.0, 1.0, -0.1, 1.5])
def test_ratio_outside_open_interval_raises(spark, ratio):
    with pytest.raises(ValueError):
        split_by_time(panel_df(spark, daily("2020-01-01", 3)), ratio=ratio)


def test_text_dates_parse_before_ordering(spark):
    # MM-dd-yyyy text across a year end: as text, 01-.. sorts before 12-..
    rows = [("12-30-2019", 1, 1, 1), ("12-31-2019", 1, 1, 2), ("01-01-2020", 1, 1, 3),
            ("01-02-2020", 1, 1, 4), ("01-03-2020", 1, 1, 5)]
    raw = spark.createDataFrame(rows, "date string, store int, item int, sales int")
    out = split_by_time(parse_dates(raw), ratio=0.6).orderBy("date").collect()
    assert [r["Dataset"] for r in out] == ["Train"] * 4 + ["Test"]
    assert str(out[0]["date"]) == "2019-12-30"


def test_unparsable_date_is_null_and_reported(spark):
    raw = spark.createDataFrame([("13-45-2019", 1, 1, 1), ("01-02-2020", 1, 1, 2)],
                                "date string, store int, item int, sales int")
    assert unparsable_dates(raw).count() == 1
    assert parse_dates(raw).filter(F.col("date").isNull()).count() == 1


def test_nested_split_three_tags(spark):
    out = split_nested(panel_df(spark, daily("2020-01-01", 20)), ratio=0.8, inner_ratio=0.8)
    t = tags(out)
    # 20 rows: Train 17 (k=16), of which Train 14 (k=13), Validation 3; Test 3
    assert (t.count("Train"), t.count("Validation"), t.count("Test")) == (14, 3, 3)
    assert t == ["Train"] * 14 + ["Validation"] * 3 + ["Test"] * 3


def test_two_frame_interface(spark):
    train, test = train_test_frames(split_by_time(panel_df(spark, daily("2020-01-01", 10))))
    assert (train.count(), test.count()) == (9, 1)
    assert "Dataset" not in train.columns


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(0, 400)), min_size=1, max_size=60,
                unique=True),
       st.floats(0.05, 0.95))
def test_split_properties(spark, keyed_days, ratio):
    import datetime as dt
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=day), s, 1, day) for s, day in keyed_days]
    random.Random(1).shuffle(rows)
    out = split_by_time(panel_df(spark, rows), ratio=ratio).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["store"], []).append(r)
    for rs in by.values():
        n = len(rs)
        train = sorted(r["date"] for r in rs if r["Dataset"] == "Train")
        test = sorted(r["date"] for r in rs if r["Dataset"] == "Test")
        assert len(train) == min(n, int(n * ratio) + 1)
        if test:
            assert train[-1] < test[0]


def test_result_independent_of_partitions(spark):
    rows = [r for s in (1, 2, 3) for r in daily("2020-01-01", 37, store=s)]
    random.Random(7).shuffle(rows)
    base = sorted(tuple(r) for r in split_by_time(panel_df(spark, rows)).collect())
    again = sorted(tuple(r) for r in
                   split_by_time(panel_df(spark, rows).repartition(7)).collect())
    assert base == again


def test_histogram_split_equals_the_window_split(spark):
    import random

    from demandcast.operators.split import split_by_histogram, split_nested_by_histogram
    rng = random.Random(4)
    rows = [("2020-01-01", 1, 1, 1), ("2020-01-01", 1, 2, 1), ("2020-01-02", 1, 2, 1)]
    for store in range(2, 8):
        rows += [(f"2020-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", store, None if store == 7 else 1, i)
                 for i in range(store * 7)]  # ties, and a null key
    df = panel_df(spark, rows + [(None, 3, 1, 99), (None, 3, 1, 98)])
    for ratio in (0.1, 0.5, 0.8, 0.99):
        for window, histogram in ((split_by_time, split_by_histogram), (split_nested, split_nested_by_histogram)):
            a = sorted(map(str, window(df, ratio=ratio).collect()))
            assert a == sorted(map(str, histogram(df, ratio=ratio).collect()))
            if histogram is split_by_histogram:
                assert a == sorted(map(str, histogram(df, ratio=ratio, broadcast_rows=0).collect()))
    with pytest.raises(ValueError):
        split_by_histogram(df, ratio=1)


def test_histogram_split_leaves_the_rows_where_they_are(spark):
    """No shuffle of the rows, so a series with a third of all rows is no task's alone."""
    from demandcast.operators.split import split_by_histogram
    df = spark.range(0, 30_000, 1, 8).select(
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 300).cast("int")).alias("date"),
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50).cast("int").alias("store"),
        F.lit(1).alias("item"), F.lit(1).alias("sales"))
    out = split_by_histogram(df)
    hot = out.filter("store = 1").groupBy(F.spark_partition_id()).count().collect()
    assert len(hot) == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_histogram_split_deals_more_tasks_for_more_rows(spark, tmp_path, monkeypatch):
    """A task's share of the unfolded panel and of its dates has a bound, which AQE keeps."""
    from demandcast import session
    from demandcast.operators.split import series_cutoffs
    from demandcast.sources.fixtures import unfolded_panel
    spark.range(0, 6_000, 1, 3).select(
        F.expr("timestamp'1995-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 40 as int))").alias("l_shipdate"),
        (F.col("id") % 7).alias("l_suppkey"), (F.col("id") % 150).alias("l_partkey"),
        F.lit(2.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    panel = unfolded_panel(spark, str(tmp_path))
    cutoffs = series_cutoffs(panel, rows=6_000)
    for df in (panel, cutoffs):
        shares = df.groupBy(F.spark_partition_id()).count().collect()
        assert len(shares) == 12
    assert session.tasks_for(spark, 1) == 4
    plain = series_cutoffs(panel)
    assert sorted(cutoffs.collect()) == sorted(plain.collect())
