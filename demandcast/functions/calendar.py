"""Calendar fields of a DATE column as built-in (codegen) expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Output names and order of the calendar block (before public_holiday).
CALENDAR_COLUMNS = ("month", "day", "year", "week_of_year", "day_of_week",
                    "is_weekend", "is_month_start", "is_month_end")


def calendar_columns(date: str = "date") -> list[Column]:
    """month, day, year, ISO week, weekday (Monday = 0) and three 0/1 flags."""
    d = "`" + date.replace("`", "``") + "`"
    exprs = {
        "month": f"month({d})",
        "day": f"dayofmonth({d})",
        "year": f"year({d})",
        "week_of_year": f"weekofyear({d})",
        "day_of_week": f"weekday({d})",  # Monday = 0 ... Sunday = 6
        "is_weekend": f"CAST(weekday({d}) >= 5 AS INT)",
        "is_month_start": f"CAST(dayofmonth({d}) = 1 AS INT)",
        "is_month_end": f"CAST(last_day({d}) = {d} AS INT)",
    }
    return [F.expr(e).alias(name) for name, e in exprs.items()]


def add_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """Append the calendar block; a pure projection, no shuffle."""
    return df.select("*", *calendar_columns(date))


def add_timestamp(df: DataFrame, date: str = "date", out: str = "timestamp") -> DataFrame:
    """the reference's ``timestamp`` column (midnight of ``date`` in the session zone)."""
    return df.withColumn(out, F.to_timestamp(F.col(date)))
