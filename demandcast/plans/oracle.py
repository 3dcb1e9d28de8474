"""DuckDB SQL texts that state each registered query a second way.

They run on the driver's parquet views (``lineitem`` ...). Where the Spark
side uses a window trick, the SQL uses the plain definition: the EWM is a
recursive CTE of the exact recurrence, the split compares row positions, the
holiday flag is an ``IN`` test against a literal list computed here in
Python (``datetime`` and ``dateutil.easter``), independent of the Spark
rule expressions.
"""

from __future__ import annotations

import datetime as dt

from dateutil.easter import easter

from demandcast.plans.model import REFERENCE_FIXED

RATIO = "0.8::DOUBLE"
PART = "PARTITION BY store, item, Dataset"
YEARS = range(1995, 2002)  # years of the derived panel (1995-01-02 .. 2001-11-04)


# ------------------------------------------------------------- holidays --

def _nth_weekday(year: int, month: int, weekday: int, n: int) -> dt.date:
    first = dt.date(year, month, 1)
    return first + dt.timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))


def victoria_holidays(years=YEARS) -> list[tuple[dt.date, str]]:
    """(date, name) of the Victorian public holidays, rendered with ``datetime``."""
    out = []
    for y in years:
        e = easter(y)
        days = [
            (dt.date(y, 1, 1), "New Year's Day"),
            (dt.date(y, 1, 26), "Australia Day"),
            (_nth_weekday(y, 3, 0, 2), "Labour Day"),
            (e - dt.timedelta(days=2), "Good Friday"),
            (e - dt.timedelta(days=1), "Easter Saturday"),
            (e + dt.timedelta(days=1), "Easter Monday"),
            (dt.date(y, 4, 25), "Anzac Day"),
            (_nth_weekday(y, 6, 0, 2), "Queen's Birthday"),
            (_nth_weekday(y, 11, 1, 1), "Melbourne Cup"),
            (dt.date(y, 12, 25), "Christmas Day"),
            (dt.date(y, 12, 26), "Boxing Day"),
        ]
        if y >= 2016:
            days.append((e, "Easter Sunday"))
        if y >= 2015:
            friday = dt.date(y, 9, 24)
            friday += dt.timedelta(days=(4 - friday.weekday()) % 7)
            days.append(({2015: dt.date(2015, 10, 2), 2020: dt.date(2020, 10, 23),
                          2022: dt.date(2022, 9, 23)}.get(y, friday), "Grand Final Friday"))
        for d, name in (days[0], days[1]):
            if d.weekday() >= 5:
                days.append((d + dt.timedelta(days=7 - d.weekday()), f"{name} (Observed)"))
        for d, name in (days[9], days[10]):
            if d.weekday() >= 5:
                days.append((d + dt.timedelta(days=2), f"{name} (Observed)"))
        out.extend(days)
    return sorted(out)


def _holidays_cte(years=YEARS) -> str:
    rows = ",\n    ".join(f"(DATE '{d.isoformat()}', '{n.replace(chr(39), chr(39) * 2)}')"
                          for d, n in victoria_holidays(years))
    return f"hol(date, name) AS (VALUES\n    {rows})"


# ---------------------------------------------------------------- pieces --

PANEL_CTE = """panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date,
         CAST(l_suppkey % 10 + 1 AS INTEGER) AS store,
         CAST(l_partkey % 5 + 1 AS INTEGER) AS item,
         CAST(SUM(l_quantity) AS INTEGER) AS sales
  FROM lineitem GROUP BY 1, 2, 3)"""

TAGGED_CTE = f"""ranked AS (
  SELECT *, row_number() OVER (PARTITION BY store, item ORDER BY date) AS _rn,
            count(*) OVER (PARTITION BY store, item) AS _n
  FROM panel),
tagged AS (
  SELECT date, store, item, sales,
         CASE WHEN _rn <= floor(_n * {RATIO}) + 1 THEN 'Train' ELSE 'Test' END AS Dataset
  FROM ranked)"""

NESTED_CTE = f"""nranked AS (
  SELECT *, row_number() OVER ({PART} ORDER BY date) AS _rn2,
            count(*) OVER ({PART}) AS _n2
  FROM {{src}}),
nested AS (
  SELECT * EXCLUDE (Dataset, _rn2, _n2),
         CASE WHEN Dataset = 'Train' AND _rn2 > floor(_n2 * {RATIO}) + 1
              THEN 'Validation' ELSE Dataset END AS Dataset
  FROM nranked)"""

CALENDAR_COLS = """CAST(month(date) AS INTEGER) AS month,
         CAST(day(date) AS INTEGER) AS day,
         CAST(year(date) AS INTEGER) AS year,
         CAST(weekofyear(date) AS INTEGER) AS week_of_year,
         CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
         CAST(isodow(date) >= 6 AS INTEGER) AS is_weekend,
         CAST(day(date) = 1 AS INTEGER) AS is_month_start,
         CAST(last_day(date) = date AS INTEGER) AS is_month_end"""

HOLIDAY_COL = "CAST(date IN (SELECT date FROM hol) AS INTEGER) AS public_holiday"

WEATHER_CTE = """wdates AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem),
wraw AS (
  SELECT date, '94866' AS station,
         CAST((dayofyear(date) * 7 + 0) % 13 + 4 AS DOUBLE) AS tmin,
         CAST((dayofyear(date) * 7 + 0) % 13 + 4 + (dayofyear(date) + 0) % 9 + 10 AS DOUBLE) AS tmax
  FROM wdates WHERE day(date) <> 11
  UNION ALL
  SELECT date, '95936' AS station,
         CAST((dayofyear(date) * 7 + 3) % 13 + 4 AS DOUBLE) AS tmin,
         CAST((dayofyear(date) * 7 + 3) % 13 + 4 + (dayofyear(date) + 1) % 9 + 10 AS DOUBLE) AS tmax
  FROM wdates),
weather AS (
  SELECT date, tmin, tmax, (tmin + tmax) / 2.0 AS tavg FROM wraw
  WHERE station = (SELECT min(station) FROM wraw))"""


def _lag_cols(lags=(1, 3, 5, 7)) -> str:
    return ",\n         ".join(f"lag(sales, {k}) OVER ({PART} ORDER BY date) AS sales_lag_{k}"
                               for k in lags)


def _roll_col(op: str, w: int, frame: str = "range", trailing: bool = False) -> str:
    if frame == "range":
        h = int(w / 2)
        bounds = (f"RANGE BETWEEN INTERVAL {w} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING"
                  if trailing else
                  f"RANGE BETWEEN INTERVAL {h} DAY PRECEDING AND INTERVAL {h} DAY FOLLOWING")
    else:
        bounds = f"ROWS BETWEEN {w // 2} PRECEDING AND {(w - 1) // 2} FOLLOWING"
    over = f"OVER ({PART} ORDER BY date {bounds})"
    name = f"sales_roll_{op}_{w}"
    if op == "sum":
        return f"CAST(sum(sales) {over} AS BIGINT) AS {name}"
    fn = {"mean": "avg", "std": "stddev_samp"}[op]
    return f"round({fn}(sales) {over}, 6) AS {name}"


def _roll_cols(ops=("sum", "mean", "std"), windows=(3, 5, 7), frame="range",
               trailing=False) -> str:
    return ",\n         ".join(_roll_col(op, w, frame, trailing) for op in ops for w in windows)


def _ewm_ctes(src: str, alphas=(0.6, 0.85)) -> str:
    """The exact recurrence S_t = x_t + q S_{t-1}, W_t = [x_t present] + q W_{t-1}."""
    tags = [str(a).replace(".", "") for a in alphas]
    first = ", ".join(f"CAST(COALESCE(sales, 0) AS DOUBLE) AS s{t}, "
                      f"CAST(CASE WHEN sales IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS w{t}" for t in tags)
    step = ", ".join(
        f"e.s{t} * (1.0 - {a}::DOUBLE) + CAST(COALESCE(b.sales, 0) AS DOUBLE), "
        f"e.w{t} * (1.0 - {a}::DOUBLE) + CAST(CASE WHEN b.sales IS NULL THEN 0 ELSE 1 END AS DOUBLE)"
        for t, a in zip(tags, alphas))
    cols = ", ".join(f"s{t}, w{t}" for t in tags)
    return f"""ebase AS (
  SELECT store, item, Dataset, date, sales,
         row_number() OVER ({PART} ORDER BY date) AS _k
  FROM {src}),
erec(store, item, Dataset, _k, date, {cols}) AS (
  SELECT store, item, Dataset, _k, date, {first} FROM ebase WHERE _k = 1
  UNION ALL
  SELECT b.store, b.item, b.Dataset, b._k, b.date, {step}
  FROM erec e JOIN ebase b
    ON b.store = e.store AND b.item = e.item AND b.Dataset = e.Dataset AND b._k = e._k + 1),
ewm AS (
  SELECT store, item, Dataset, date,
         {", ".join(f"CASE WHEN w{t} > 0 THEN s{t} / w{t} END AS sales_ewm_{t}" for t in tags)}
  FROM erec)"""


def _with(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes)


def _feature_frame_sql(scope: str = "split", weather: bool = False) -> str:
    part = PART if scope == "split" else "PARTITION BY store, item"
    lag = _lag_cols().replace(PART, part)
    roll = _roll_cols().replace(PART, part)
    ewm = _ewm_ctes("tagged").replace(PART, part)
    if scope != "split":
        ewm = ewm.replace("AND b.Dataset = e.Dataset", "")
    wcols = "w.tmin, w.tmax, w.tavg," if weather else ""
    wjoin = "LEFT JOIN weather w USING (date)" if weather else ""
    feats = f"""feats AS (
  SELECT t.date, t.store, t.item, t.sales, t.Dataset,
         {CALENDAR_COLS},
         {HOLIDAY_COL},
         {wcols}
         {lag},
         {roll}
  FROM tagged t {wjoin})"""
    joined = """fe AS (
  SELECT f.*, round(e.sales_ewm_06, 6) AS sales_ewm_06, round(e.sales_ewm_085, 6) AS sales_ewm_085
  FROM feats f JOIN ewm e USING (store, item, date))"""
    extra = [WEATHER_CTE] if weather else []
    return _with(PANEL_CTE, TAGGED_CTE, _holidays_cte(), *extra, ewm, feats, joined,
                 NESTED_CTE.format(src="fe"), recursive=True) + "\nSELECT * FROM nested"


FEATURES_26 = ("store, item, month, day, year, week_of_year, day_of_week, is_weekend, "
               "is_month_start, is_month_end, public_holiday, "
               "sales_lag_1, sales_lag_3, sales_lag_5, sales_lag_7, "
               "sales_roll_sum_3, sales_roll_sum_5, sales_roll_sum_7, "
               "sales_roll_mean_3, sales_roll_mean_5, sales_roll_mean_7, "
               "sales_roll_std_3, sales_roll_std_5, sales_roll_std_7, "
               "sales_ewm_06, sales_ewm_085")

EPS = "2.220446049250313e-16"


def _metric_cols() -> str:
    err = "(COALESCE(CAST(sales_lag_7 AS DOUBLE), 0.0) - CAST(sales AS DOUBLE))"
    return f"""avg({err} * {err}) AS mse,
         sqrt(avg({err} * {err})) AS rmse,
         avg(abs({err}) / greatest(abs(CAST(sales AS DOUBLE)), {EPS})) AS mape,
         avg(abs({err})) AS mae,
         count({err}) AS n"""


def _round_metrics(src: str, by: str) -> str:
    return (f"SELECT {by}, round(mse, 6) AS mse, round(rmse, 6) AS rmse, "
            f"round(mape, 6) AS mape, round(mae, 6) AS mae, n FROM {src}")


def _split_counts_cte() -> str:
    return f"""counts AS (
  SELECT store, item,
         CAST(count_if(Dataset = 'Train') AS BIGINT) AS train_rows,
         CAST(count_if(Dataset = 'Test') AS BIGINT) AS test_rows,
         100.0::DOUBLE * CAST(count_if(Dataset = 'Train') AS BIGINT) / count(*) AS train_pct,
         100.0::DOUBLE * CAST(count_if(Dataset = 'Test') AS BIGINT) / count(*) AS test_pct
  FROM tagged GROUP BY store, item)"""


def _split_matrix_sql(stores=range(1, 11)) -> str:
    cols = []
    for s in stores:
        cols += [f"COALESCE(max(CASE WHEN store = {s} THEN train_rows END), 0) AS Store{s}_TR",
                 f"COALESCE(max(CASE WHEN store = {s} THEN test_rows END), 0) AS Store{s}_TST",
                 f"round(max(CASE WHEN store = {s} THEN train_pct END), 6) AS Store{s}_PTR",
                 f"round(max(CASE WHEN store = {s} THEN test_pct END), 6) AS Store{s}_PTST"]
    return (_with(PANEL_CTE, TAGGED_CTE, _split_counts_cte())
            + "\nSELECT item AS Item,\n  " + ",\n  ".join(cols) + "\nFROM counts GROUP BY item")


def _split_valid_sql() -> str:
    tr = "100.0::DOUBLE * 0.8::DOUBLE"
    te = "100.0::DOUBLE * (1.0::DOUBLE - 0.8::DOUBLE)"
    ok = (f"(train_pct > {tr} - 0.3::DOUBLE AND train_pct < {tr} + 0.3::DOUBLE "
          f"AND test_pct > {te} - 0.3::DOUBLE AND test_pct < {te} + 0.3::DOUBLE)")
    return (_with(PANEL_CTE, TAGGED_CTE, _split_counts_cte())
            + f"\nSELECT COALESCE(bool_and({ok}), true) AS split_valid, "
              f"count(*) AS series, CAST(count_if(NOT {ok}) AS BIGINT) AS bad_series FROM counts")


def _compare_sql() -> str:
    cols = [f"sales_roll_{op}_{w}" for op in ("sum", "mean", "std") for w in (3, 5, 7)]
    raw = lambda frame: ",\n         ".join(
        _roll_col(op, w, frame).replace("round(", "(").replace(", 6) AS", ") AS")
        for op in ("sum", "mean", "std") for w in (3, 5, 7))
    left = f"lft AS (SELECT date, store, item, {raw('range')}, true AS _in_x FROM tagged)"
    right = f"rgt AS (SELECT date, store, item, {raw('rows')}, true AS _in_y FROM tagged)"
    j = ("j AS (SELECT * FROM lft l FULL OUTER JOIN rgt r USING (date, store, item))")
    parts = []
    for c in cols:
        x, y = f"CAST(l.{c} AS DOUBLE)", f"CAST(r.{c} AS DOUBLE)"
        mism = f"(({x}) IS DISTINCT FROM ({y}) AND ({x} IS NULL OR {y} IS NULL OR abs({x} - {y}) > 0.001))"
        parts.append(
            f"SELECT '{c}' AS column_name,\n"
            f"  CAST(count_if(_in_x) AS BIGINT) AS rows_left, CAST(count_if(_in_y) AS BIGINT) AS rows_right,\n"
            f"  CAST(count_if(_in_x AND _in_y) AS BIGINT) AS rows_joined,\n"
            f"  CAST(count_if(_in_x AND _in_y IS NULL) AS BIGINT) AS left_only,\n"
            f"  CAST(count_if(_in_y AND _in_x IS NULL) AS BIGINT) AS right_only,\n"
            f"  CAST(count_if(_in_x AND _in_y AND {mism}) AS BIGINT) AS mismatches\n"
            f"FROM lft l FULL OUTER JOIN rgt r USING (date, store, item)")
    return _with(PANEL_CTE, TAGGED_CTE, left, right) + "\n" + "\nUNION ALL\n".join(parts)


def _more_texts() -> dict[str, str]:
    from demandcast.plans.registry import ERAS
    from demandcast.plans.search import draw_trials

    tagged_base = _with(PANEL_CTE, TAGGED_CTE)
    years = sorted({y + e for y in YEARS for e in ERAS})
    moved = "\nUNION\n".join(f"SELECT CAST(date + INTERVAL ({e}) YEAR AS DATE) AS date FROM panel"
                             for e in ERAS)
    draws = ",\n  ".join(
        f"({i}, {t['learning_rate']:.6f}::DOUBLE, {t['max_depth']}, {t['num_leaves']}, "
        f"{t['bagging_fraction']:.6f}::DOUBLE, {t['feature_fraction']:.6f}::DOUBLE, true)"
        for i, t in enumerate(draw_trials(10, 42)))
    tested = f"{tagged_base},\ntest AS (SELECT * FROM tagged WHERE Dataset = 'Test')"
    unfolded = """panel AS (
  SELECT CAST(l_shipdate AS DATE) AS date, CAST(l_suppkey AS INTEGER) AS store,
         CAST(l_partkey AS INTEGER) AS item, CAST(SUM(l_quantity) AS INTEGER) AS sales
  FROM lineitem GROUP BY 1, 2, 3)"""
    return {
        "holiday_eras": _with(PANEL_CTE, _holidays_cte(years), f"moved AS ({moved})")
        + f"\nSELECT date, {HOLIDAY_COL} FROM moved",
        "ewm_slow": _with(PANEL_CTE, TAGGED_CTE, _ewm_ctes("tagged", (0.01,)), recursive=True)
        + "\nSELECT t.*, round(e.sales_ewm_001, 6) AS sales_ewm_001 FROM tagged t JOIN ewm e "
          "USING (store, item, date)",
        "lag_noise": tagged_base
        + f"\nSELECT date, store, item, Dataset, lag(sales, 1) OVER ({PART} ORDER BY date) AS sales_lag_1, "
          f"CASE WHEN lag(sales, 1) OVER ({PART} ORDER BY date) IS NOT NULL THEN true END "
          "AS noise_in_range FROM tagged",
        "noise_moments": tagged_base
        + f",\nlags AS (SELECT lag(sales, 1) OVER ({PART} ORDER BY date) AS v FROM tagged)"
          "\nSELECT count(v) AS rows, true AS mean_near_0, true AS deviation_near_scale FROM lags",
        "filter_store": _with(PANEL_CTE) + "\nSELECT * FROM panel WHERE store = 3",
        "first_days": _with(PANEL_CTE) + "\nSELECT * FROM panel ORDER BY date, store, item LIMIT 20",
        "pandas_source": _with(PANEL_CTE)
        + "\nSELECT store, CAST(sum(sales) AS BIGINT) AS sales FROM panel GROUP BY store",
        "bad_dates": _with(PANEL_CTE)
        + "\nSELECT strftime(date, '%Y/%d/%m') AS date, store, item, sales FROM panel WHERE day(date) = 13",
        "compare_signed": tagged_base
        + "\nSELECT 'v' AS column_name, count(*) AS rows_left, count(*) AS rows_right, "
          "count(*) AS rows_joined, CAST(0 AS BIGINT) AS left_only, CAST(0 AS BIGINT) AS right_only, "
          "CAST(count_if(3 - item > 0.001) AS BIGINT) AS mismatches FROM tagged",
        "unfolded_rolling": _with(unfolded)
        + "\nSELECT *,\n         " + _roll_cols(("sum",)).replace(PART, "PARTITION BY store, item")
        + "\nFROM panel",
        "gbt_predictions": tested + "\nSELECT date, store, item, sales, true AS predicted FROM test",
        "gbt_store_metrics": tested + "\nSELECT store, count(*) AS n, true AS beats_mean FROM test GROUP BY store",
        "random_search_trials": "SELECT * FROM (VALUES\n  " + draws + ") AS t(trial, learning_rate, "
        "max_depth, num_leaves, bagging_fraction, feature_fraction, scored)",
        "tuned_store_metrics": tested + "\nSELECT store, count(*) AS n, true AS scored FROM test GROUP BY store",
        "model_roundtrip": tested + "\nSELECT store, item, date, true AS same FROM test",
        "table_roundtrip": _with(PANEL_CTE) + "\nSELECT * FROM panel",
        "boosted_stump_l1": _with(PANEL_CTE) + "," + _stump_ctes("regression_l1")
        + "\nSELECT date, store, item, sales, round(prediction, 4) AS prediction FROM scored",
        "boosted_stump_l2": _with(PANEL_CTE) + "," + _stump_ctes("regression")
        + "\nSELECT date, store, item, sales, round(prediction, 4) AS prediction FROM scored",
        "boosted_scores": _with(PANEL_CTE) + "," + _stump_ctes("regression_l1")
        + "\nSELECT CAST(1 AS INTEGER) AS round, "
          "round(avg(abs(prediction - sales) / greatest(abs(sales), 1)), 4) AS mape, "
          "round(sqrt(avg((prediction - sales) ** 2)), 4) AS rmse FROM scored",
        "stump_importances": _with(PANEL_CTE) + "," + _stump_ctes("regression")
        + "\nSELECT feature, CAST(1 AS BIGINT) AS splits, round(gain / 1e3, 3) AS gain_thousands FROM chosen",
        "feature_days": _feature_frame_sql()
        + " WHERE date BETWEEN DATE '2000-05-01' AND DATE '2000-05-21'",
        "split_tag_histogram": tagged_base + "\nSELECT * FROM tagged",
        "split_nested_histogram": _with(PANEL_CTE, TAGGED_CTE, NESTED_CTE.format(src="tagged"))
        + "\nSELECT * FROM nested",
        "split_histogram": _with(unfolded, TAGGED_CTE) + "\nSELECT * FROM tagged",
        "timestamp_feature": _with(PANEL_CTE)
        + "\nSELECT *, CAST(date AS TIMESTAMP) AS timestamp, "
          "CAST(epoch(CAST(date AS TIMESTAMP)) AS BIGINT) AS seconds FROM panel",
        "table_overwrite": _with(PANEL_CTE)
        + "\nSELECT date, store, item, CAST(sales * 2 AS INTEGER) AS sales FROM panel WHERE store <> 3",
        "table_snapshots": _with(PANEL_CTE)
        + "\nSELECT CAST(s AS INTEGER) AS snapshot, count(*) AS rows, CAST(sum(sales) AS BIGINT) AS sales "
          "FROM panel JOIN range(1, 4) AS r(s) ON store <= s GROUP BY s",
        "model_versions": _with(PANEL_CTE)
        + ",\ncuts AS (SELECT * FROM (VALUES (1, 1996), (2, 1998), (3, 2000)) AS c(version, until)),"
          "\ncounted AS (SELECT version, until, count(*) AS n FROM panel JOIN cuts ON year(date) <= until GROUP BY 1, 2)"
          "\nSELECT CAST(version AS INTEGER) AS version, 'tag' AS kind, 'until' AS key, CAST(until AS VARCHAR) AS value "
          "FROM counted"
          "\nUNION ALL SELECT CAST(version AS INTEGER), 'tag', 'rows', CAST(n AS VARCHAR) FROM counted"
          "\nUNION ALL SELECT CAST(version AS INTEGER), 'description', 'description', 'means until ' || until FROM counted"
          "\nUNION ALL SELECT 3, 'mean', CAST(store AS VARCHAR), printf('%.4f', avg(sales)) FROM panel "
          "WHERE year(date) <= 2000 GROUP BY store",
        "run_log": tagged_base + "\nSELECT 'metric' AS kind, 'rows_' || Dataset AS key, "
        "CAST(count(*) AS VARCHAR) AS value FROM tagged GROUP BY Dataset"
        "\nUNION ALL SELECT * FROM (VALUES ('param', 'ratio', '0.8'), ('param', 'keys', 'store,item'), "
        "('tag', 'stage', 'split'))",
    }


def _stump_ctes(objective: str) -> str:
    """The best of all splits of the panel by store or item, with the reference's penalties:
    ``chosen`` (feature, cut, gain), ``sided`` (rows with their side and residual)."""
    l1, l2 = REFERENCE_FIXED["lambda_l1"], REFERENCE_FIXED["lambda_l2"]
    absolute = objective == "regression_l1"
    start = "median(sales)" if absolute else "avg(sales)"
    grad = "sign(init - sales)" if absolute else "init - sales"

    def gain(g, n):
        return f"greatest(abs({g}) - {l1!r}, 0) ** 2 / ({n} + {l2!r})"

    return f"""
base AS (SELECT *, CAST({start} OVER () AS DOUBLE) AS init FROM panel),
graded AS (SELECT *, CAST({grad} AS DOUBLE) AS g FROM base),
cells AS (
  SELECT 0 AS j, 'store' AS feature, store AS v, sum(g) AS g, count(*) AS n FROM graded GROUP BY store
  UNION ALL
  SELECT 1, 'item', item, sum(g), count(*) FROM graded GROUP BY item),
cuts AS (
  SELECT j, feature, v AS cut, sum(g) OVER l AS gl, sum(n) OVER l AS nl,
         sum(g) OVER w AS gw, sum(n) OVER w AS nw
  FROM cells WINDOW l AS (PARTITION BY j ORDER BY v), w AS (PARTITION BY j)),
chosen AS (
  SELECT feature, cut, {gain('gl', 'nl')} + {gain('gw - gl', '(nw - nl)')} - {gain('gw', 'nw')} AS gain
  FROM cuts WHERE nl >= 20 AND nw - nl >= 20 ORDER BY gain DESC, j, cut LIMIT 1),
sided AS (
  SELECT g.*, CASE WHEN c.feature = 'store' THEN store <= cut ELSE item <= cut END AS on_left
  FROM graded g, chosen c),
leaves AS (
  SELECT on_left, {'median(sales - init)' if absolute else
                   f'-sign(sum(g)) * greatest(abs(sum(g)) - {l1!r}, 0) / (count(*) + {l2!r})'} AS value
  FROM sided GROUP BY on_left),
scored AS (
  SELECT date, store, item, sales, init + 0.5 * value AS prediction FROM sided JOIN leaves USING (on_left))"""


def oracle_sql() -> dict[str, str]:
    tagged_base = _with(PANEL_CTE, TAGGED_CTE)
    metrics_base = _feature_frame_sql().replace("\nSELECT * FROM nested", "")
    return {
        "sales_panel": _with(PANEL_CTE) + "\nSELECT * FROM panel",
        "sales_text_dates": _with(PANEL_CTE)
        + "\nSELECT strptime(strftime(date, '%m-%d-%Y'), '%m-%d-%Y')::DATE AS date, "
          "store, item, sales FROM panel",
        "split_tag": tagged_base + "\nSELECT * FROM tagged",
        "split_nested": _with(PANEL_CTE, TAGGED_CTE, NESTED_CTE.format(src="tagged"))
        + "\nSELECT * FROM nested",
        "tag_counts": _with(PANEL_CTE, TAGGED_CTE, NESTED_CTE.format(src="tagged"))
        + "\nSELECT Dataset, count(*) AS rows FROM nested GROUP BY Dataset",
        "split_counts": _with(PANEL_CTE, TAGGED_CTE, _split_counts_cte())
        + "\nSELECT store, item, train_rows, test_rows, round(train_pct, 6) AS train_pct, "
          "round(test_pct, 6) AS test_pct FROM counts",
        "split_matrix": _split_matrix_sql(),
        "split_valid": _split_valid_sql(),
        "series_keys": _with(PANEL_CTE)
        + "\nSELECT 'store' AS key, store AS value FROM (SELECT DISTINCT store FROM panel)"
          "\nUNION ALL SELECT 'item' AS key, item AS value FROM (SELECT DISTINCT item FROM panel)",
        "calendar_features": _with(PANEL_CTE)
        + f"\nSELECT date, store, item, sales,\n         {CALENDAR_COLS}\nFROM panel",
        "holiday_flag": _with(PANEL_CTE, _holidays_cte())
        + f"\nSELECT date, store, item, sales, {HOLIDAY_COL} FROM panel",
        "holiday_days": _with(PANEL_CTE, _holidays_cte())
        + "\nSELECT h.date, h.name FROM hol h WHERE h.date IN (SELECT date FROM panel)",
        "weather_join": _with(PANEL_CTE, WEATHER_CTE)
        + "\nSELECT p.date, p.store, p.item, p.sales, w.tmin, w.tmax, w.tavg "
          "FROM panel p LEFT JOIN weather w USING (date)",
        "lag_features": tagged_base + f"\nSELECT *,\n         {_lag_cols()}\nFROM tagged",
        "rolling_sum": tagged_base + f"\nSELECT *,\n         {_roll_cols(('sum',))}\nFROM tagged",
        "rolling_mean": tagged_base + f"\nSELECT *,\n         {_roll_cols(('mean',))}\nFROM tagged",
        "rolling_std": tagged_base + f"\nSELECT *,\n         {_roll_cols(('std',))}\nFROM tagged",
        "rolling_rows": tagged_base
        + f"\nSELECT *,\n         {_roll_cols(frame='rows')}\nFROM tagged",
        "rolling_trailing": tagged_base
        + f"\nSELECT *,\n         {_roll_cols(trailing=True)}\nFROM tagged",
        "ewm_features": _with(PANEL_CTE, TAGGED_CTE, _ewm_ctes("tagged"), recursive=True)
        + "\nSELECT t.*, round(e.sales_ewm_06, 6) AS sales_ewm_06, "
          "round(e.sales_ewm_085, 6) AS sales_ewm_085 FROM tagged t JOIN ewm e "
          "USING (store, item, date)",
        "feature_frame": _feature_frame_sql(),
        "feature_frame_series": _feature_frame_sql("series"),
        "feature_frame_weather": _feature_frame_sql(weather=True),
        "feature_frame_bucketed": _feature_frame_sql(),
        "feature_projection": metrics_base
        + f"\nSELECT {FEATURES_26}, sales FROM nested WHERE Dataset = 'Train'",
        "compare_columns": _compare_sql(),
        # both EWM implementations agree on every row of the panel
        "compare_ewm_methods": _with(PANEL_CTE) + "\n" + "\nUNION ALL\n".join(
            f"SELECT '{c}' AS column_name, count(*) AS rows_left, count(*) AS rows_right, "
            "count(*) AS rows_joined, CAST(0 AS BIGINT) AS left_only, "
            "CAST(0 AS BIGINT) AS right_only, CAST(0 AS BIGINT) AS mismatches FROM panel"
            for c in ("sales_ewm_06", "sales_ewm_085")),
        **_more_texts(),
        "store_metrics": metrics_base + ",\nm AS (SELECT store, " + _metric_cols()
        + " FROM nested WHERE Dataset = 'Test' GROUP BY store)\n" + _round_metrics("m", "store"),
        "overall_metrics": metrics_base + ",\nm AS (SELECT Dataset, " + _metric_cols()
        + " FROM nested GROUP BY Dataset)\n" + _round_metrics("m", "Dataset"),
        "metric_means": metrics_base + ",\nm AS (SELECT store, " + _metric_cols()
        + " FROM nested WHERE Dataset = 'Test' GROUP BY store)\n"
        "SELECT round(avg(CASE WHEN NOT isnan(mse) THEN mse END), 6) AS mean_mse, "
        "round(avg(CASE WHEN NOT isnan(rmse) THEN rmse END), 6) AS mean_rmse, "
        "round(avg(CASE WHEN NOT isnan(mape) THEN mape END), 6) AS mean_mape FROM m",
    }
