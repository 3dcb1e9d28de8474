"""The panel and the weather table derived from the driver's TPC-H-like tables.

Both are Spark jobs over the whole ``lineitem`` table, so their cost grows
with it. The SQL text in ``demandcast.plans.oracle`` states the same rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from demandcast.session import tasks_for

# Fixed values of the derived panel (FIXTURES.md section 2).
N_STORES = 10
N_ITEMS_CHECK = 5
N_ITEMS_BENCH = 50
# Weather stations of the derived weather table, lowest id first.
WEATHER_STATIONS = ("94866", "95936")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_panel(spark: SparkSession, sf_dir: str,
                   n_items: int = N_ITEMS_CHECK,
                   n_stores: int = N_STORES) -> DataFrame:
    """Daily sales per (store, item) from ``lineitem``: one row per key and date.

    Only four columns are read; the aggregation is a partial (map-side)
    hash aggregate followed by one shuffle on the group key.
    """
    li = read_table(spark, sf_dir, "lineitem")
    return (li.select(
                F.to_date("l_shipdate").alias("date"),
                (F.col("l_suppkey") % n_stores + 1).cast("int").alias("store"),
                (F.col("l_partkey") % n_items + 1).cast("int").alias("item"),
                "l_quantity")
              .groupBy("date", "store", "item")
              .agg(F.sum("l_quantity").cast("int").alias("sales")))


def unfolded_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily sales per supplier and part: the number of series grows with the data.

    So does the number of tasks (by the rows that the file footers count): next to no
    two rows share a key, and a task's hash table holds its rows.
    """
    li = read_table(spark, sf_dir, "lineitem")
    return (li.select(F.to_date("l_shipdate").alias("date"),
                      F.col("l_suppkey").cast("int").alias("store"),
                      F.col("l_partkey").cast("int").alias("item"), "l_quantity")
              .repartition(tasks_for(spark, li.count()), "date", "store", "item")
              .groupBy("date", "store", "item")
              .agg(F.sum("l_quantity").cast("int").alias("sales")))


def derived_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per ship date and station with integer-rule temperatures.

    Stands in for a daily weather feed: (date, station, tmin, tmax, tavg).
    The values follow date arithmetic only, so the DuckDB text can repeat them.
    """
    stations = F.array(*[F.struct(F.lit(i).alias("offset"), F.lit(s).alias("station"))
                         for i, s in enumerate(WEATHER_STATIONS)])
    # one scan: every date is exploded into its stations; the first station has
    # a gap on every eleventh day of a month
    days = (read_table(spark, sf_dir, "lineitem")
            .select(F.to_date("l_shipdate").alias("date")).distinct()
            .select("date", F.inline(stations))
            .filter((F.col("offset") > 0) | (F.dayofmonth("date") != 11)))
    doy, offset = F.dayofyear("date"), F.col("offset")
    tmin = ((doy * 7 + offset * 3) % 13 + 4).cast("double")
    tmax = (F.col("tmin") + (doy + offset) % 9 + 10).cast("double")
    return (days.withColumn("tmin", tmin).withColumn("tmax", tmax)
            .select("date", "station", "tmin", "tmax",
                    ((F.col("tmin") + F.col("tmax")) / 2.0).alias("tavg")))
