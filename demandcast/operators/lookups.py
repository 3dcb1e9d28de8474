"""Per-date lookups as joins against small, size-checked dimension tables.

The reference calls a Python function per row (one holiday-library lookup or
one web request per row). Here the holiday rules are a column expression on the
date; weather, and holidays that a caller lists, are left joins on ``date``. A
caller's table is broadcast after a row count; beyond the limit the join stays a
shuffle join, which is correct at any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.functions.holidays import is_holiday

# Rows a lookup side may have to be broadcast (a few tens of MB at most).
MAX_BROADCAST_ROWS = 2_000_000


def checked_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS,
                      known_rows: int | None = None) -> DataFrame:
    """``F.broadcast(df)`` if it has at most ``max_rows`` rows, else ``df``.

    ``known_rows`` is a proven upper bound; without it the rows are counted
    (one job over the small side only).
    """
    rows = known_rows if known_rows is not None else df.count()
    return F.broadcast(df) if rows <= max_rows else df


def holiday_dates(holidays: DataFrame, date: str = "date") -> DataFrame:
    """One row per holiday date: a day listed twice must not duplicate panel rows."""
    return holidays.select(F.col(date).cast("date").alias("_holiday")).distinct()


def add_holiday_flag(df: DataFrame, holidays: DataFrame | None = None,
                     date: str = "date", out: str = "public_holiday",
                     max_rows: int = MAX_BROADCAST_ROWS,
                     extra: DataFrame | None = None) -> DataFrame:
    """``out`` = 1 if ``date`` is a public holiday, else 0 (INT).

    Without ``holidays`` the Victorian rules are evaluated on each row's own
    date, for any year and without a join; ``extra`` (date, name) rows, such
    as proclaimed days, count as well. With ``holidays`` only its dates do.
    """
    rules = F.lit(False) if holidays is not None else is_holiday(date)
    listed = holidays if holidays is not None else extra
    rest = [F.col(c) for c in df.columns if c != out]
    if listed is None:
        return df.select(*rest, rules.cast("int").alias(out))
    side = checked_broadcast(holiday_dates(listed), max_rows)
    joined = df.join(side, F.col(date) == F.col("_holiday"), "left")
    return joined.select(*rest, (rules | F.col("_holiday").isNotNull()).cast("int").alias(out))


def daily_weather(weather: DataFrame, date: str = "date",
                  station: str = "station",
                  values=("tmin", "tmax", "tavg")) -> DataFrame:
    """One weather row per date of the feed's lowest station id.

    The station is fixed once per feed, so values never hop between stations; a
    day on which it did not report has no row. Repeated reports of a day are
    averaged (a numeric hash aggregate with a partial step). The station is a
    one-row aggregate.
    """
    lowest = F.broadcast(weather.agg(F.min(station).alias("_station")))
    one = weather.join(lowest, F.col(station) == F.col("_station"))
    return (one.groupBy(F.col(date).cast("date").alias("_wdate"))
               .agg(*[F.avg(F.col(v).cast("double")).alias(v) for v in values]))


def add_weather(df: DataFrame, weather: DataFrame, date: str = "date",
                station: str = "station", values=("tmin", "tmax", "tavg"),
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Left-join the daily weather values (null where no station reported)."""
    side = checked_broadcast(daily_weather(weather, date, station, values), max_rows)
    return (df.join(side, F.col(date) == F.col("_wdate"), "left")
              .select(*df.columns, *values))
