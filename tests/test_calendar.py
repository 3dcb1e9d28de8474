import datetime as dt

from pyspark.sql import functions as F

from conftest import panel_df
from demandcast.functions.calendar import add_calendar
from demandcast.functions.holidays import holiday_calendar
from demandcast.operators.lookups import add_holiday_flag, add_weather, daily_weather
from demandcast.plans.oracle import victoria_holidays


def cal(spark, dates):
    df = panel_df(spark, [(x, 1, 1, 1) for x in dates])
    return {str(r["date"]): r for r in add_calendar(df).collect()}


def test_month_ends_and_iso_weeks(spark):
    r = cal(spark, ["2020-02-28", "2020-02-29", "2021-02-28", "2019-12-31", "2020-01-01",
                    "2021-01-03"])
    assert r["2020-02-28"]["is_month_end"] == 0 and r["2020-02-29"]["is_month_end"] == 1
    assert r["2021-02-28"]["is_month_end"] == 1
    assert r["2019-12-31"]["is_month_end"] == 1 and r["2020-01-01"]["is_month_start"] == 1
    assert r["2019-12-31"]["week_of_year"] == 1  # ISO week 1 of 2020
    assert r["2021-01-03"]["week_of_year"] == 53


def test_weekday_and_weekend(spark):
    r = cal(spark, ["2020-01-04", "2020-01-05", "2020-01-06"])  # Sat, Sun, Mon
    assert [r[k]["day_of_week"] for k in sorted(r)] == [5, 6, 0]
    assert [r[k]["is_weekend"] for k in sorted(r)] == [1, 1, 0]


def test_generated_holidays_match_python_rendering(spark):
    years = range(1990, 2031)
    got = sorted((r["date"], r["name"]) for r in
                 holiday_calendar(spark, years=(1990, 2030)).collect())
    assert got == victoria_holidays(years)


def test_known_victorian_holidays(spark):
    got = {r["date"]: r["name"] for r in holiday_calendar(spark, years=(2017, 2017)).collect()}
    assert got[dt.date(2017, 4, 14)] == "Good Friday"
    assert got[dt.date(2017, 11, 7)] == "Melbourne Cup"
    assert got[dt.date(2017, 3, 13)] == "Labour Day"
    assert got[dt.date(2017, 1, 2)] == "New Year's Day (Observed)"  # 1 Jan was a Sunday
    assert dt.date(2017, 12, 27) not in got  # 25/26 Dec 2017 were Monday/Tuesday
    xmas21 = {r["date"]: r["name"] for r in holiday_calendar(spark, years=(2021, 2021)).collect()}
    assert xmas21[dt.date(2021, 12, 27)] == "Christmas Day (Observed)"  # Saturday
    assert xmas21[dt.date(2021, 12, 28)] == "Boxing Day (Observed)"  # Sunday


def test_holiday_flag_and_listed_twice(spark):
    df = panel_df(spark, [("2020-12-25", 1, 1, 5), ("2020-12-24", 1, 1, 6)])
    hol = spark.createDataFrame([(dt.date(2020, 12, 25), "Christmas Day"),
                                 (dt.date(2020, 12, 25), "Christmas Day")], "date date, name string")
    out = add_holiday_flag(df, hol)
    assert out.count() == 2
    assert {str(r["date"]): r["public_holiday"] for r in out.collect()} == \
        {"2020-12-25": 1, "2020-12-24": 0}
    assert dict(out.dtypes)["public_holiday"] == "int"


def test_default_holiday_flag(spark):
    df = panel_df(spark, [("1999-11-02", 1, 1, 5), ("1999-11-03", 1, 1, 6)])
    flags = {str(r["date"]): r["public_holiday"] for r in add_holiday_flag(df).collect()}
    assert flags == {"1999-11-02": 1, "1999-11-03": 0}  # Melbourne Cup 1999


def test_weather_lowest_station_per_day(spark):
    w = spark.createDataFrame(
        [(dt.date(2020, 1, 1), "B", 1.0, 2.0, 1.5), (dt.date(2020, 1, 1), "A", 3.0, 4.0, 3.5)],
        "date date, station string, tmin double, tmax double, tavg double")
    assert daily_weather(w).first()["tavg"] == 3.5
    df = panel_df(spark, [("2020-01-01", 1, 1, 5), ("2020-01-02", 1, 1, 6)])
    out = {str(r["date"]): r["tavg"] for r in add_weather(df, w).collect()}
    assert out == {"2020-01-01": 3.5, "2020-01-02": None}


def test_weather_keeps_one_station(spark):
    day = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    w = spark.createDataFrame(
        [(day[0], "A", 1.0, 2.0, 1.5), (day[0], "B", 8.0, 9.0, 8.5), (day[1], "B", 8.0, 9.0, 8.5),
         (day[2], "A", 3.0, 4.0, 3.5), (day[2], "A", 5.0, 6.0, 5.5)],
        "date date, station string, tmin double, tmax double, tavg double")
    got = {r["_wdate"]: r["tavg"] for r in daily_weather(w).collect()}
    assert got == {day[0]: 1.5, day[2]: 4.5}  # no value of B on A's missing day


def test_holidays_of_any_year(spark):
    dates = ["1899-12-25", "2101-12-26", "1850-01-01", "2016-09-30", "2015-10-02", "2020-10-23",
             "2021-09-24", "2014-09-26", "2020-09-25", "2500-06-14"]
    df = panel_df(spark, [(x, 1, 1, 5) for x in dates] + [(None, 1, 1, 5)])
    flags = {str(r["date"]): r["public_holiday"] for r in add_holiday_flag(df).collect()}
    assert [flags[d] for d in dates] == [1, 1, 1, 1, 1, 1, 1, 0, 0, 1]
    assert flags["None"] == 0


def test_flag_equals_the_calendar(spark):
    from demandcast.functions.holidays import holiday_names
    days = spark.sql("SELECT explode(sequence(DATE'1995-01-01', DATE'2030-12-31')) AS date")
    got = {(r["date"], r["n"]) for r in
           days.select("date", F.explode(holiday_names("date")).alias("n")).collect()}
    assert got == set(victoria_holidays(range(1995, 2031)))


def test_extra_days_count_as_holidays(spark):
    extra = spark.createDataFrame([(dt.date(2022, 9, 22), "Day of Mourning")], "date date, name string")
    df = panel_df(spark, [("2022-09-22", 1, 1, 5), ("2022-12-26", 1, 1, 5), ("2022-12-24", 1, 1, 5)])
    flags = {str(r["date"]): r["public_holiday"] for r in add_holiday_flag(df, extra=extra).collect()}
    assert flags == {"2022-09-22": 1, "2022-12-26": 1, "2022-12-24": 0}


def test_extra_holiday_rows_are_added(spark):
    extra = spark.createDataFrame([(dt.date(2015, 10, 5), "Proclaimed Day")],
                                  "date date, name string")
    cal = holiday_calendar(spark, years=(2015, 2015), extra=extra)
    names = {r["name"] for r in cal.filter(F.col("date") == dt.date(2015, 10, 5)).collect()}
    assert names == {"Proclaimed Day"}
    assert cal.count() == len(victoria_holidays(range(2015, 2016))) + 1


def test_date_features_from_text_dates(spark):
    from demandcast.plans.features import date_features
    raw = spark.createDataFrame([("11-02-1999", 1, 1, 5), ("11-03-1999", 1, 1, 6)],
                                "date string, store int, item int, sales int")
    out = {str(r["date"]): r for r in date_features(raw).collect()}
    assert out["1999-11-02"]["public_holiday"] == 1 and out["1999-11-02"]["day_of_week"] == 1
    assert out["1999-11-03"]["public_holiday"] == 0 and out["1999-11-03"]["month"] == 11
