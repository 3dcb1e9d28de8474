import datetime as dt
import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import daily, panel_df
from demandcast.operators import windows as W


def series(df, col):
    return [r[col] for r in df.orderBy("store", "item", "date").collect()]


def test_lags_order_by_date_not_row_order(spark):
    rows = daily("2020-01-01", 10)
    random.Random(3).shuffle(rows)
    out = W.add_lags(panel_df(spark, rows).repartition(5), lags=(1, 3))
    assert series(out, "sales_lag_1") == [None] + list(range(1, 10))
    assert series(out, "sales_lag_3") == [None] * 3 + list(range(1, 8))


def test_lag_uses_group_cols(spark):
    rows = daily("2020-01-01", 3, store=1) + daily("2020-01-01", 3, store=2, values=[7, 8, 9])
    out = W.add_lags(panel_df(spark, rows), lags=(1,))
    assert series(out, "sales_lag_1") == [None, 1, 2, None, 7, 8]


@pytest.mark.parametrize("step", [2, 3, 4])
def test_range_frame_differs_from_rows_on_gaps(spark, step):
    df = panel_df(spark, daily("2020-01-01", 6, step=step))
    rng = W.add_rolling(df, windows=(3,), ops=("sum",))
    rows = W.add_rolling(df, windows=(3,), ops=("sum",), frame="rows")
    # gaps of >= 2 days: a +-1 day frame holds only the row itself
    assert series(rng, "sales_roll_sum_3") == list(range(1, 7))
    assert series(rows, "sales_roll_sum_3") == [3, 6, 9, 12, 15, 11]


def test_range_frame_even_window_spans_w_plus_one_days(spark):
    df = panel_df(spark, daily("2020-01-01", 6))
    out = W.add_rolling(df, windows=(4,), ops=("sum",))
    # int(4 / 2) = 2 days each side: 5 days
    assert series(out, "sales_roll_sum_4") == [6, 10, 15, 20, 18, 15]


def test_rows_frame_matches_pandas_centered(spark):
    vals = [5, 1, 7, 3, 9, 2, 8, 4]
    df = panel_df(spark, daily("2020-01-01", len(vals), values=vals))
    out = W.add_rolling(df, windows=(3, 4, 5), frame="rows")
    s = pd.Series(vals, dtype="float64")
    for w in (3, 4, 5):
        r = s.rolling(window=w, center=True, min_periods=1)
        for op, ref in (("sum", r.sum()), ("mean", r.mean()), ("std", r.std())):
            got = series(out, f"sales_roll_{op}_{w}")
            for g, e in zip(got, ref):
                if isinstance(e, float) and math.isnan(e):
                    assert g is None
                else:
                    assert g == pytest.approx(e, rel=1e-12)


def test_single_row_window_std_is_null(spark):
    out = W.add_rolling(panel_df(spark, daily("2020-01-01", 1)), windows=(3,))
    r = out.first()
    assert r["sales_roll_std_3"] is None and r["sales_roll_sum_3"] == 1


def test_rolling_mean_times_count_is_sum(spark):
    df = panel_df(spark, daily("2020-01-01", 20, values=[random.Random(i).randint(0, 50)
                                                         for i in range(20)], step=1))
    out = W.add_rolling(df, windows=(5,), ops=("sum", "mean")).collect()
    # interior rows have 5 days in frame
    for r in out[2:-2]:
        assert r["sales_roll_mean_5"] * 5 == pytest.approx(r["sales_roll_sum_5"])


def test_trailing_frame_excludes_current_day(spark):
    out = W.add_rolling(panel_df(spark, daily("2020-01-01", 5)), windows=(2,),
                        ops=("sum",), trailing=True)
    assert series(out, "sales_roll_sum_2") == [None, 1, 3, 5, 7]


def test_calendar_day_frames_across_dst_change(spark):
    # 2017-04-02: clocks go back in Melbourne; a seconds-based range loses a neighbour
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Australia/Melbourne")
    try:
        out = W.add_rolling(panel_df(spark, daily("2017-03-31", 5)), windows=(3,), ops=("sum",))
        assert series(out, "sales_roll_sum_3") == [3, 6, 9, 12, 9]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_ewm_nulls_fixture(spark):
    vals = [None, 1, None, 2, None, None, 5]
    out = W.add_ewm(panel_df(spark, daily("2020-01-01", 7, values=vals)), alphas=(0.6,))
    got = series(out, "sales_ewm_06")
    expected = [None, 1, 1, 1.862069, 1.862069, 1.862069, 4.783140]
    assert got[0] is None
    assert [round(g, 6) for g in got[1:]] == expected[1:]


def test_ewm_alpha_one_is_target(spark):
    vals = [3, 1, 4, 1, 5, 9, 2, 6]
    out = W.add_ewm(panel_df(spark, daily("2020-01-01", 8, values=vals)), alphas=(1.0,))
    assert series(out, "sales_ewm_10") == [float(v) for v in vals]


def test_ewm_long_null_run_carries_forward(spark):
    vals = [4, 6] + [None] * 60 + [10]
    out = W.add_ewm(panel_df(spark, daily("2020-01-01", len(vals), values=vals)),
                    alphas=(0.6, 0.85))
    ref = pd.Series(vals, dtype="float64")
    for a, n in ((0.6, "sales_ewm_06"), (0.85, "sales_ewm_085")):
        exp = ref.ewm(alpha=a).mean().tolist()
        assert series(out, n) == pytest.approx(exp, rel=1e-12)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 500)), min_size=1, max_size=200),
       st.sampled_from([0.05, 0.3, 0.6, 0.85, 0.99]))
def test_ewm_matches_pandas(spark, vals, alpha):
    df = panel_df(spark, daily("2020-01-01", len(vals), values=vals))
    name = W.ewm_name("sales", "ewm", alpha)
    got = series(W.add_ewm(df, alphas=(alpha,)), name)
    exp = pd.Series(vals, dtype="float64").ewm(alpha=alpha).mean().tolist()
    for g, e in zip(got, exp):
        if math.isnan(e):
            assert g is None
        else:
            assert g == pytest.approx(e, rel=1e-9, abs=1e-9)


def test_ewm_methods_agree_at_any_alpha(spark):
    vals = [random.Random(i).randint(0, 80) for i in range(300)]
    df = panel_df(spark, daily("2020-01-01", 300, values=vals))
    for alpha in (0.6, 0.01):
        exp = pd.Series(vals, dtype="float64").ewm(alpha=alpha).mean().tolist()
        for method in ("window", "blocks"):
            got = series(W.add_ewm(df, alphas=(alpha,), method=method), W.ewm_name("sales", "ewm", alpha))
            assert got == pytest.approx(exp, rel=1e-12)
    with pytest.raises(ValueError):
        W.add_ewm(df, method="pandas")


def test_noise_is_repeatable_and_scaled(spark):
    rows = [r for s in range(1, 11) for r in daily("2020-01-01", 200, store=s)]
    df = panel_df(spark, rows)
    a = W.add_lags(df, lags=(1,), noise_scale=1.6)
    b = W.add_lags(df.repartition(3), lags=(1,), noise_scale=1.6)
    key = ["store", "item", "date"]
    ja = a.join(b.withColumnRenamed("sales_lag_1", "other"), key)
    assert ja.filter(F.col("sales_lag_1") != F.col("other")).count() == 0
    noise = a.select((F.col("sales_lag_1") - F.col("sales") + 1).alias("e")).dropna()
    stats = noise.agg(F.avg("e"), F.stddev("e")).first()
    assert abs(stats[0]) < 0.15 and 1.45 < stats[1] < 1.75


def test_all_null_series(spark):
    df = panel_df(spark, daily("2020-01-01", 6, values=[None] * 6))
    out = W.add_rolling(W.add_ewm(W.add_lags(df)), windows=(3,))
    for c in ("sales_lag_1", "sales_ewm_06", "sales_roll_sum_3", "sales_roll_mean_3",
              "sales_roll_std_3"):
        assert series(out, c) == [None] * 6


def test_feature_frame_invariant_to_shuffle_partitions(spark):
    from conftest import SF_SMOKE
    from demandcast.plans.features import feature_frame
    from demandcast.sources.fixtures import lineitem_panel

    def rows():
        ff = feature_frame(lineitem_panel(spark, SF_SMOKE))
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r)
                      for r in ff.collect())

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        a = rows()
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        b = rows()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b and len(a) == 5858


def _spark_xxhash64(values, seed=42):
    """Spark's ``xxhash64`` over int-like columns, brute force: XXH64 of each
    4-byte little-endian value, each column seeded with the previous hash."""
    import struct

    import xxhash
    h = seed
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i", v), seed=h & 0xFFFFFFFFFFFFFFFF)
        h = h - (1 << 64) if h >= (1 << 63) else h
    return h


def test_noise_matches_brute_force(spark):
    rows = daily("2020-01-01", 12, store=3, item=2)
    out = W.add_lags(panel_df(spark, rows), lags=(1,), noise_scale=1.6, seed=42)
    got = {r["date"]: r["sales_lag_1"] for r in out.collect()}
    epoch = dt.date(1970, 1, 1)
    for i, (day, store, item, _) in enumerate(rows):
        if i == 0:
            assert got[day] is None
            continue
        days = (day - epoch).days
        u = [((_spark_xxhash64([store, item, days, 42, s]) % (1 << 53)) + 0.5) / float(1 << 53)
             for s in (2, 3)]  # streams 2k, 2k+1 for lag k = 1
        z = math.sqrt(-2.0 * math.log(u[0])) * math.cos(2.0 * math.pi * u[1])
        assert got[day] == pytest.approx(rows[i - 1][3] + 1.6 * z, rel=1e-12)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(0, 1e9, allow_nan=False)), min_size=1,
                max_size=120),
       st.sampled_from([0.02, 0.5, 0.999]))
def test_ewm_large_values_and_extreme_alpha(spark, vals, alpha):
    rows = daily("2020-01-01", len(vals), values=vals)
    df = spark.createDataFrame(rows, "date date, store int, item int, sales double")
    name = W.ewm_name("sales", "ewm", alpha)
    got = series(W.add_ewm(df, alphas=(alpha,)), name)
    exp = pd.Series(vals, dtype="float64").ewm(alpha=alpha).mean().tolist()
    for g, e in zip(got, exp):
        if math.isnan(e):
            assert g is None
        else:
            assert g == pytest.approx(e, rel=1e-9, abs=1e-6)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(0, 10**6)), min_size=1, max_size=150),
       st.lists(st.sampled_from([0.05, 0.3, 0.6, 0.85, 0.999, 1.0]), min_size=1, max_size=3,
                unique=True))
def test_ewm_blocks_match_pandas(spark, vals, alphas):
    df = panel_df(spark, daily("2020-01-01", len(vals), values=vals))
    out = W.add_ewm(df, alphas=tuple(alphas), method="blocks")
    for a in alphas:
        got = series(out, W.ewm_name("sales", "ewm", a))
        exp = pd.Series(vals, dtype="float64").ewm(alpha=a).mean().tolist()
        for g, e in zip(got, exp):
            if math.isnan(e):
                assert g is None
            else:
                assert g == pytest.approx(e, rel=1e-9, abs=1e-9)
