"""Read a daily sales table as a typed (date, store, item, sales) panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SALES_SCHEMA = T.StructType([
    T.StructField("date", T.DateType(), True),
    T.StructField("store", T.IntegerType(), True),
    T.StructField("item", T.IntegerType(), True),
    T.StructField("sales", T.IntegerType(), True),
])

# Text format of the date column in the source table.
SOURCE_DATE_FORMAT = "MM-dd-yyyy"

KEYS = ("store", "item")


def to_date_column(c: Column | str, dtype: T.DataType,
                   fmt: str = SOURCE_DATE_FORMAT, strict: bool = False) -> Column:
    """a DATE from text, a timestamp or a date.

    Unparsable text becomes null, or with ``strict`` ends the job with its value.
    """
    c = F.col(c) if isinstance(c, str) else c
    if isinstance(dtype, T.StringType):
        day = F.try_to_date(c, fmt)
        if not strict:
            return day
        message = F.concat(F.lit(f"date not in the format {fmt}: "), c)
        return F.when(c.isNotNull() & day.isNull(), F.raise_error(message).cast("date")).otherwise(day)
    if isinstance(dtype, T.DateType):
        return c
    return F.to_date(c)


def parse_dates(df: DataFrame, col: str = "date",
                fmt: str = SOURCE_DATE_FORMAT) -> DataFrame:
    """Replace ``col`` by its DATE value; parsing happens before any ordering (D3)."""
    dtype = df.schema[col].dataType
    return df.withColumn(col, to_date_column(col, dtype, fmt))


def unparsable_dates(df: DataFrame, col: str = "date",
                     fmt: str = SOURCE_DATE_FORMAT) -> DataFrame:
    """Rows whose raw date text does not parse with ``fmt`` (reported, not dropped)."""
    dtype = df.schema[col].dataType
    return df.filter(F.col(col).isNotNull()
                     & to_date_column(col, dtype, fmt).isNull())


def typed_panel(df: DataFrame, date: str = "date", store: str = "store",
                item: str = "item", target: str = "sales",
                fmt: str = SOURCE_DATE_FORMAT, strict: bool = False) -> DataFrame:
    """Project any frame to the four panel columns with the panel types.

    The projection is explicit so a parquet or catalog scan reads only these
    four columns (``ReadSchema`` shows them).
    """
    dtype = df.schema[date].dataType
    return df.select(
        to_date_column(date, dtype, fmt, strict).alias("date"),
        F.col(store).cast("int").alias("store"),
        F.col(item).cast("int").alias("item"),
        F.col(target).cast("int").alias("sales"),
    )


def read_sales(spark: SparkSession, source: str, fmt: str = SOURCE_DATE_FORMAT,
               file_format: str | None = None, dedupe: bool = True,
               strict: bool = True) -> DataFrame:
    """Scan the sales table by catalog name or by path.

    ``source`` is a table name unless it contains a path separator; paths are
    read with ``file_format`` (default parquet). Rows that repeat a (store,
    item, date) key are summed (:func:`ensure_grain`, a loud error on INT
    overflow), so a series has at most one row a day; ``dedupe=False`` skips
    that for a source known to have this grain. Date text that does not parse
    ends the job unless ``strict=False``, which makes it null (see
    :func:`unparsable_dates` to list such rows).
    """
    if "/" in source or file_format is not None:
        reader = spark.read.format(file_format or "parquet")
        if (file_format or "parquet") == "csv":
            reader = reader.option("header", "true")
        raw = reader.load(source)
    else:
        raw = spark.table(source)
    panel = typed_panel(raw, fmt=fmt, strict=strict)
    return ensure_grain(panel) if dedupe else panel


def ensure_grain(df: DataFrame, keys=KEYS, date: str = "date",
                 target: str = "sales") -> DataFrame:
    """One row per (keys, date): duplicate rows are summed.

    Partial aggregation combines duplicates map-side before the shuffle, so a
    hot key costs no more shuffle volume than its number of distinct dates.
    """
    return (df.groupBy(*keys, date)
              .agg(F.sum(target).cast("int").alias(target))
              .select(date, *keys, target))


def duplicate_keys(df: DataFrame, keys=KEYS, date: str = "date") -> DataFrame:
    """(keys, date) combinations present more than once, with their count."""
    return (df.groupBy(*keys, date).count()
              .filter(F.col("count") > 1))
