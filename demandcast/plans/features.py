"""The 26-feature frame of the reference in one plan, and P1.

Order of work (the reference's, in one frame instead of two):
T1 split -> calendar + holiday (+ weather) lookups -> lags, rolling, EWM per
(store, item, split set) -> T2 validation split of the Train rows.

Physical shape: one exchange on (store, item); the split's window and the
feature windows run on it (the features partition by the set tag as well,
which the (store, item) hash partitioning already satisfies, so only a local
sort is added). Lookups are broadcast joins and keep that partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandcast.functions.calendar import CALENDAR_COLUMNS, calendar_columns
from demandcast.operators import windows as W
from demandcast.operators.lookups import MAX_BROADCAST_ROWS, add_holiday_flag, add_weather
from demandcast.operators.split import TEST, TRAIN, VALIDATION, split_by_time, split_nested
from demandcast.sources.panel import parse_dates

KEYS = ("store", "item")
LAGS = (1, 3, 5, 7)
ROLL_WINDOWS = (3, 5, 7)
ROLL_OPS = ("sum", "mean", "std")
ALPHAS = (0.6, 0.85)
EXCLUDE = ("date", "timestamp")


def feature_names(target: str = "sales", keys=KEYS, lags=LAGS,
                  windows=ROLL_WINDOWS, ops=ROLL_OPS, alphas=ALPHAS,
                  weather: bool = False) -> list[str]:
    """The model inputs in pipeline order (26 with the defaults)."""
    names = [*keys, *CALENDAR_COLUMNS, "public_holiday"]
    if weather:
        names += ["tmin", "tmax", "tavg"]
    names += [W.lag_name(target, "lag", k) for k in lags]
    names += [W.roll_name(target, "roll", op, w) for op in ops for w in windows]
    names += [W.ewm_name(target, "ewm", a) for a in alphas]
    return names


def date_features(df: DataFrame, holidays: DataFrame | None = None,
                  weather: DataFrame | None = None, date: str = "date") -> DataFrame:
    """The reference's date-feature step in one call: parse ``date`` (F1), add
    the calendar block (F3-F8), the holiday flag (J4) and, given a weather
    table, its daily values (J5). Projections and broadcast joins only."""
    df = parse_dates(df, date)
    df = add_holiday_flag(df, holidays, date=date)
    if weather is not None:
        df = add_weather(df, weather, date=date)
    extra = ["public_holiday"] + (["tmin", "tmax", "tavg"] if weather is not None else [])
    return df.select(*[c for c in df.columns if c not in extra],
                     *calendar_columns(date), *extra)


def feature_frame(panel: DataFrame, ratio: float = 0.8, inner_ratio: float | None = 0.8,
                  holidays: DataFrame | None = None, weather: DataFrame | None = None,
                  target: str = "sales", keys=KEYS, lags=LAGS, windows=ROLL_WINDOWS,
                  ops=ROLL_OPS, alphas=ALPHAS, feature_scope: str = "split",
                  frame: str = "range", trailing: bool = False,
                  noise_scale: float = 0.0, seed: int = 42,
                  tag: str = "Dataset", ewm_method: str = "window") -> DataFrame:
    """The labelled feature frame: one row per (store, item, date).

    ``feature_scope="split"`` (the reference, D6) computes windows inside each
    split set, so test lags start null; ``"series"`` uses the whole series.
    ``inner_ratio=None`` skips the validation split. ``ewm_method="blocks"``
    computes the EWM with O(1) window work per row at the price of two more
    local sorts (see ``operators.windows.ewm_blocks``).
    """
    df = split_by_time(panel, keys, ratio, tag=tag)
    df = add_features(df, holidays, weather, target, keys, lags, windows, ops, alphas, feature_scope,
                      frame, trailing, noise_scale, seed, tag, ewm_method)
    if inner_ratio is not None:
        df = split_nested(df, keys, inner_ratio=inner_ratio, tag=tag)
    return df


def add_features(df: DataFrame, holidays: DataFrame | None = None, weather: DataFrame | None = None,
                 target: str = "sales", keys=KEYS, lags=LAGS, windows=ROLL_WINDOWS, ops=ROLL_OPS,
                 alphas=ALPHAS, feature_scope: str = "split", frame: str = "range",
                 trailing: bool = False, noise_scale: float = 0.0, seed: int = 42,
                 tag: str = "Dataset", ewm_method: str = "window") -> DataFrame:
    """The features of rows that carry their split tag (the middle of :func:`feature_frame`)."""
    if feature_scope not in ("split", "series"):
        raise ValueError("feature_scope must be 'split' or 'series'")
    within = tag if feature_scope == "split" else None
    df = add_holiday_flag(df, holidays)
    if weather is not None:
        df = add_weather(df, weather)
    extra_cols = ["public_holiday"] + (["tmin", "tmax", "tavg"] if weather is not None else [])
    window_cols = (
        calendar_columns() + [F.col(c) for c in extra_cols]
        + W.lag_columns(lags, keys, target, "lag", within=within,
                      noise_scale=noise_scale, seed=seed)
        + W.rolling_columns(windows, keys, target, "roll", ops, within=within,
                            frame=frame, trailing=trailing)
        + ([W.ewm_rank_column(keys, within=within)] if ewm_method == "window" else []))
    df = df.select(*[c for c in df.columns if c not in extra_cols], *window_cols)
    if ewm_method == "window":
        df = df.select("*", *W.ewm_sum_columns(alphas, keys, target, within=within))
        df = df.select(*W.drop_ewm_temps(df), *W.ewm_mean_columns(alphas, target, "ewm"))
        ewm_cols = [W.ewm_name(target, "ewm", a) for a in alphas]
        df = df.select(*[c for c in df.columns if c not in ewm_cols],
                       *W.ewm_carry_columns(ewm_cols, keys, within=within))
    elif ewm_method == "blocks":
        df = W.ewm_blocks(df, alphas, keys, target, "ewm", within=within)
    else:
        raise ValueError("ewm_method must be 'window' or 'blocks'")
    return df


def row_reach(lags=LAGS, alphas=ALPHAS) -> int:
    """Rows before a row that its features can read: the largest lag, or the rows whose
    EWM weight still counts."""
    return max([*lags, *[W.ewm_window_rows(a) for a in alphas], 0])


def series_spans(panel: DataFrame, start, reach: int, ratio: float = 0.8, inner_ratio: float | None = 0.8,
                 keys=KEYS, date: str = "date", target: str = "sales") -> DataFrame:
    """Per series: both split cutoffs and ``since``, the date from which rows are needed
    so that rows from ``start`` on have ``reach`` rows before them.

    A histogram of dates per series, as in ``split.series_cutoffs``: the panel is read
    once for keys, date and the target's presence; a row per date is sorted. Rows
    without a target do not feed the EWM, so the reach is counted from the last row
    before ``start`` that has one.
    """
    keys = list(keys)
    days = panel.groupBy(*keys, F.col(date).alias("__date")).agg(
        F.count("*").alias("__rows"), F.count(target).alias("__known"))
    line = Window.partitionBy(*keys).orderBy(F.col("__date").asc_nulls_last())
    whole = Window.partitionBy(*keys)
    place = lambda n, r: F.floor(n.cast("double") * F.lit(float(r)))
    n, upto = F.sum("__rows").over(whole), F.sum("__rows").over(line)
    days = days.select("*", upto.alias("__upto"), n.alias("__n"))
    at = lambda p: (F.col("__upto") - F.col("__rows") <= p) & (p < F.col("__upto"))
    days = days.withColumn("__cut", F.max(F.when(at(place(F.col("__n"), ratio)), F.col("__date"))).over(whole))
    first = F.sum(F.when(F.col("__date") > F.col("__cut"), 0).otherwise(F.col("__rows"))).over(whole)
    days = days.withColumn("__first", first)
    inner = F.when(at(place(F.col("__first"), inner_ratio)), F.col("__date")) if inner_ratio is not None \
        else F.lit(None).cast("date")
    before = F.col("__date") < F.lit(start).cast("date")
    days = days.withColumn("__inner", F.max(inner).over(whole)) \
        .withColumn("__past", F.max(F.when(before & (F.col("__known") > 0), F.col("__upto"))).over(whole)) \
        .withColumn("__all", F.max(F.when(before, F.col("__upto"))).over(whole))
    need = F.least("__past", "__all") - F.lit(reach)
    return days.groupBy(*keys).agg(
        F.max("__cut").alias("__cut"), F.max("__inner").alias("__inner"),
        F.min(F.when(F.col("__upto") >= F.coalesce(need, F.lit(0)), F.col("__date"))).alias("__since"))


def feature_days(panel: DataFrame, start, end, ratio: float = 0.8, inner_ratio: float | None = 0.8,
                 target: str = "sales", keys=KEYS, lags=LAGS, windows=ROLL_WINDOWS, alphas=ALPHAS,
                 tag: str = "Dataset", broadcast_rows: int = MAX_BROADCAST_ROWS, **options) -> DataFrame:
    """The rows of :func:`feature_frame` dated ``start`` to ``end``, from a bounded span.

    A date filter on the frame itself cannot pass below its windows. Here every series'
    needed span is found first (:func:`series_spans`), the panel is scanned from the
    earliest of them to ``end`` plus half a window (a plain date range, so files and row
    groups are pruned), each series is cut to its own span, and the frame is trimmed at
    last. The cutoffs come from whole series, so the tags are those of the full frame.
    Options are those of :func:`add_features`; ``noise_scale`` included, its noise hangs
    on the row's keys and date.
    """
    keys, half = list(keys), max([0, *windows])
    spans = series_spans(panel, start, row_reach(lags, alphas), ratio, inner_ratio, keys, target=target)
    early = F.date_sub(F.lit(start).cast("date"), half)
    spans = spans.withColumn("__since", F.least(F.coalesce("__since", early), early))
    first = spans.agg(F.min("__since")).first()[0]
    span = panel.filter(F.col("date") <= F.date_add(F.lit(end).cast("date"), half))
    if first is not None:
        span = span.filter(F.col("date") >= F.lit(first))
    spans = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], "__cut", "__inner", "__since")
    if spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        spans = F.broadcast(spans)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    joined = span.join(spans, match).filter(F.col("date") >= F.col("__since"))
    split = F.when(F.col("date") > F.col("__cut"), F.lit(TEST)).otherwise(F.lit(TRAIN))
    rows = joined.select(*[c for c in panel.columns if c != tag], split.alias(tag), "__inner")
    out = add_features(rows, target=target, keys=keys, lags=lags, windows=windows, alphas=alphas, tag=tag, **options)
    inner = F.when((F.col(tag) == TRAIN) & (F.col("date") > F.col("__inner")), F.lit(VALIDATION)).otherwise(F.col(tag))
    return (out.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
            .withColumn(tag, inner).drop("__inner"))


def prepare_features(df: DataFrame, target: str = "sales",
                     exclude=EXCLUDE, keep=()) -> DataFrame:
    """Every column but ``exclude``, label kept in the same row."""
    drop = set(exclude) - set(keep)
    return df.select(*[c for c in df.columns if c not in drop])
