import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import SF_CHECK, SF_SMOKE, daily, panel_df
from demandcast.operators.compare import compare_columns
from demandcast.operators.metrics import EPS, metric_means, score_metrics
from demandcast.operators.split import split_by_time
from demandcast.operators.stats import split_counts, split_matrix, split_valid, tag_counts
from demandcast.sources.fixtures import lineitem_panel


def test_absent_pair_counts_zero_share_null(spark):
    rows = daily("2020-01-01", 10, store=1, item=1) + daily("2020-01-01", 10, store=2, item=2)
    counts = split_counts(split_by_time(panel_df(spark, rows)))
    m = {r["Item"]: r for r in split_matrix(counts, stores=[1, 2]).collect()}
    assert m[1]["Store2_TR"] == 0 and m[1]["Store2_TST"] == 0 and m[1]["Store2_PTR"] is None
    assert m[1]["Store1_TR"] == 9 and m[1]["Store1_PTR"] == pytest.approx(90.0)


def test_split_valid_false_at_sf0001_true_at_sf001(spark):
    for sf, expect in ((SF_SMOKE, False), (SF_CHECK, True)):
        counts = split_counts(split_by_time(lineitem_panel(spark, sf)))
        assert split_valid(counts).first()["split_valid"] is expect


def test_split_sizes_at_sf001(spark):
    got = {r["Dataset"]: r["rows"] for r in
           tag_counts(split_by_time(lineitem_panel(spark, SF_CHECK))).collect()}
    assert got == {"Train": 38170, "Test": 9505}


def test_mape_floors(spark):
    df = spark.createDataFrame([(0.0, 2.0), (4.0, 2.0)], "y double, p double")
    eps = score_metrics(df, "y", "p").first()
    one = score_metrics(df, "y", "p", floor=1.0).first()
    assert eps["mape"] == pytest.approx((2.0 / EPS + 0.5) / 2)
    assert one["mape"] == pytest.approx((2.0 + 0.5) / 2)
    assert eps["mse"] == pytest.approx(4.0) and eps["rmse"] == pytest.approx(2.0)


def test_per_store_sorted_and_nanmean(spark):
    df = spark.createDataFrame([(2, 1.0, 1.0), (1, 2.0, 4.0), (1, 2.0, 0.0)],
                               "store int, y double, p double")
    per = score_metrics(df, "y", "p", by="store")
    assert [r["store"] for r in per.collect()] == [1, 2]
    nan_rows = spark.createDataFrame([(1, float("nan")), (2, 3.0), (3, 5.0)],
                                     "store int, mse double")
    assert metric_means(nan_rows, ("mse",)).first()["mean_mse"] == pytest.approx(4.0)


def test_compare_reports_one_sided_and_negative(spark):
    keys = "date date, store int, item int, v double"
    a = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 1, 1.0), (dt.date(2020, 1, 2), 1, 1, 5.0),
                               (dt.date(2020, 1, 3), 1, 1, None)], keys)
    b = spark.createDataFrame([(dt.date(2020, 1, 1), 1, 1, 1.0), (dt.date(2020, 1, 2), 1, 1, 9.0),
                               (dt.date(2020, 1, 4), 1, 1, 2.0)], keys)
    r = compare_columns(a, b, ["date", "store", "item"], ["v"]).first()
    assert (r["rows_left"], r["rows_right"], r["rows_joined"]) == (3, 3, 2)
    assert (r["left_only"], r["right_only"], r["mismatches"]) == (1, 1, 1)
    signed = compare_columns(a, b, ["date", "store", "item"], ["v"], signed=True).first()
    assert signed["mismatches"] == 0  # the reference's test misses 5 - 9 < 0
