"""Time-ordered train/test split of every series.

Rule: order a series of n rows by date, take k = floor(n * ratio); the date at
0-based position k is the cutoff. Rows dated after the cutoff are the second
set, all others (ties with the cutoff included) the first. Without ties a
series keeps k + 1 rows in the first set; a one-row series is all first set.

The rule is three window expressions over one ``PARTITION BY keys ORDER BY
date`` specification, so the split is a single shuffle on the series keys
and stays inside the JVM. Group size is bounded: the panel grain makes a
series at most one row per calendar day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandcast.operators.lookups import MAX_BROADCAST_ROWS
from demandcast.session import checkpointed, tasks_for

TRAIN, TEST, VALIDATION = "Train", "Test", "Validation"


def _check_ratio(ratio: float) -> float:
    ratio = float(ratio)
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"split ratio must be in (0, 1), got {ratio}")
    return ratio


def split_tag_column(keys, ratio: float, date: str = "date",
                     names=(TRAIN, TEST), within: str | None = None) -> Column:
    """The tag column of T1 as one expression.

    ``within`` names an existing tag column: each (keys, tag value) group is
    then split on its own. Partitioning by the tag as well lets T2 share the
    sort of the features computed per set.
    """
    ratio = _check_ratio(ratio)
    part = ", ".join("`" + c.replace("`", "``") + "`"
                     for c in (list(keys) if within is None else [*keys, within]))
    d = "`" + date.replace("`", "``") + "`"
    whole = f"OVER (PARTITION BY {part})"
    ordered = f"OVER (PARTITION BY {part} ORDER BY {d} ASC NULLS LAST)"
    # the date at 0-based position floor(n * ratio) of the series
    cutoff = (f"max(CASE WHEN row_number() {ordered} = "
              f"floor(CAST(count(1) {whole} AS DOUBLE) * {ratio!r}D) + 1 "
              f"THEN {d} END) {whole}")
    return F.expr(f"CASE WHEN {d} > {cutoff} THEN '{names[1]}' ELSE '{names[0]}' END")


def split_by_time(df: DataFrame, keys=("store", "item"), ratio: float = 0.8,
                  date: str = "date", tag: str = "Dataset",
                  names=(TRAIN, TEST)) -> DataFrame:
    """Add the tag column (P4/P5) instead of returning two frames."""
    return df.withColumn(tag, split_tag_column(keys, ratio, date, names))


def series_cutoffs(df: DataFrame, keys=("store", "item"), ratio: float = 0.8,
                   date: str = "date", rows: int | None = None) -> DataFrame:
    """Keys and ``cutoff`` of every series: its date at 0-based position floor(n * ratio).

    From a histogram: rows are counted per series and date within each task first, the
    running sum over a series' dates passes the position once. What is sorted is a row
    per date, however many rows a date or a series holds. With ``rows``, at most so many
    rows of ``df``, the dates are dealt to so many tasks that each sorts few.
    """
    ratio, keys = _check_ratio(ratio), list(keys)
    days = df.groupBy(*keys, F.col(date).alias("__date")).agg(F.count("*").alias("__rows"))
    if rows is not None:
        days = days.repartition(tasks_for(df.sparkSession, rows), *keys)
    line = Window.partitionBy(*keys).orderBy(F.col("__date").asc_nulls_last())
    upto = F.sum("__rows").over(line)
    place = F.floor(F.sum("__rows").over(Window.partitionBy(*keys)).cast("double") * F.lit(ratio))
    return (days.select(*keys, "__date", "__rows", upto.alias("__upto"), place.alias("__place"))
            .filter((F.col("__upto") - F.col("__rows") <= F.col("__place"))
                    & (F.col("__place") < F.col("__upto")))
            .select(*keys, F.col("__date").alias("cutoff")))


def split_by_histogram(df: DataFrame, keys=("store", "item"), ratio: float = 0.8,
                       date: str = "date", tag: str = "Dataset", names=(TRAIN, TEST),
                       broadcast_rows: int = MAX_BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """T1 without a window over rows: the rows meet their series' cutoff (same result as
    :func:`split_by_time`).

    The rows are not shuffled by series: up to ``broadcast_rows`` series the cutoffs are
    broadcast, beyond that they are joined, where AQE splits a series that holds many
    rows. One more scan of the keys and dates is the price. ``rows``, a bound of the rows
    if one is known, is that of :func:`series_cutoffs`.
    """
    keys = list(keys)
    # a row per series, found once: the count and the join read the checkpoint
    cutoffs = checkpointed(series_cutoffs(df, keys, ratio, date, rows).select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("cutoff").alias("__cutoff")))
    if cutoffs.count() <= broadcast_rows:
        cutoffs = F.broadcast(cutoffs)
    match = F.lit(True)
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__{k}"))
    later = F.col(date) > F.col("__cutoff")
    return df.join(cutoffs, match, "left").select(
        *[c for c in df.columns if c != tag],
        F.when(later, F.lit(names[1])).otherwise(F.lit(names[0])).alias(tag))


def split_nested_by_histogram(df: DataFrame, keys=("store", "item"), ratio: float = 0.8,
                              inner_ratio: float = 0.8, date: str = "date",
                              tag: str = "Dataset") -> DataFrame:
    """T2 by two histograms: the rows dated up to the first cutoff have a second one."""
    df = df if tag in df.columns else split_by_histogram(df, keys, ratio, date, tag)
    train = df.filter(F.col(tag) == TRAIN)
    inner = split_by_histogram(train, keys, inner_ratio, date, tag, (TRAIN, VALIDATION))
    return inner.unionByName(df.filter(F.col(tag) != TRAIN))


def split_nested(df: DataFrame, keys=("store", "item"), ratio: float = 0.8,
                 inner_ratio: float = 0.8, date: str = "date",
                 tag: str = "Dataset") -> DataFrame:
    """Split, then split the Train rows again into Train and Validation.

    If ``tag`` already exists it is taken as the first split (so features can
    be computed between the two splits, as the reference does).
    """
    if tag not in df.columns:
        df = split_by_time(df, keys, ratio, date, tag)
    inner = split_tag_column(keys, inner_ratio, date, (TRAIN, VALIDATION),
                             within=tag)
    return df.withColumn(
        tag, F.when(F.col(tag) == F.lit(TRAIN), inner).otherwise(F.col(tag)))


def train_test_frames(df: DataFrame, tag: str = "Dataset",
                      names=(TRAIN, TEST)) -> tuple[DataFrame, ...]:
    """The reference's two-frame interface, one filter per tag value."""
    return tuple(df.filter(F.col(tag) == F.lit(n)).drop(tag) for n in names)
