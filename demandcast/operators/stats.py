"""A1-A5 (and J3): row counts and the split check, all as grouped aggregates.

Nothing is collected: the reference's driver loop over stores and items
becomes a ``groupBy`` with partial aggregation, and the store-by-item matrix
a ``pivot``. Absent (store, item) pairs come out of the pivot as nulls, which
turns the reference's items x stores loop (J3) into counts of 0 without a
cross join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandcast.operators.split import TEST, TRAIN


def tag_counts(df: DataFrame, tag: str = "Dataset") -> DataFrame:
    """A1: rows per tag value in one job."""
    return df.groupBy(tag).agg(F.count(F.lit(1)).cast("bigint").alias("rows"))


def series_keys(df: DataFrame, col: str) -> DataFrame:
    """A2: distinct values of one key column, sorted."""
    return df.select(col).distinct().orderBy(col)


def split_counts(df: DataFrame, keys=("store", "item"), tag: str = "Dataset",
                 names=(TRAIN, TEST)) -> DataFrame:
    """A3: per series, rows in each set and their percentages."""
    first, second = (F.col(tag) == F.lit(n) for n in names)
    n = F.count(F.lit(1))
    return (df.groupBy(*keys)
              .agg(F.count_if(first).cast("bigint").alias("train_rows"),
                   F.count_if(second).cast("bigint").alias("test_rows"),
                   (100.0 * F.count_if(first) / n).alias("train_pct"),
                   (100.0 * F.count_if(second) / n).alias("test_pct")))


def split_matrix(counts: DataFrame, stores,
                 row_key: str = "item", col_key: str = "store") -> DataFrame:
    """A4: one row per item, four columns per store ``Store{n}_TR/_TST/_PTR/_PTST``.

    ``stores`` lists the stores to show, so nothing is collected and the lineage
    runs once; the long form of any number of stores is :func:`split_counts`.
    Absent pairs get 0 rows and null shares.
    """
    stores = list(stores)
    wide = (counts.groupBy(row_key).pivot(col_key, stores)
                  .agg(F.max("train_rows").alias("TR"),
                       F.max("test_rows").alias("TST"),
                       F.max("train_pct").alias("PTR"),
                       F.max("test_pct").alias("PTST")))
    cols = [F.col(row_key).alias("Item")]
    for s in stores:
        cols += [F.coalesce(F.col(f"{s}_TR"), F.lit(0)).cast("bigint").alias(f"Store{s}_TR"),
                 F.coalesce(F.col(f"{s}_TST"), F.lit(0)).cast("bigint").alias(f"Store{s}_TST"),
                 F.col(f"{s}_PTR").alias(f"Store{s}_PTR"),
                 F.col(f"{s}_PTST").alias(f"Store{s}_PTST")]
    return wide.select(*cols)


def split_valid(counts: DataFrame, ratio: float = 0.8, tol: float = 0.3) -> DataFrame:
    """A5: one row, true iff every series' shares lie strictly inside target +- tol.

    Also returns how many series were checked and how many fail, so a false
    answer can be traced without collecting the table.
    """
    train_t, test_t = 100.0 * ratio, 100.0 * (1.0 - ratio)
    ok = ((F.col("train_pct") > train_t - tol) & (F.col("train_pct") < train_t + tol)
          & (F.col("test_pct") > test_t - tol) & (F.col("test_pct") < test_t + tol))
    return counts.agg(
        F.coalesce(F.bool_and(ok), F.lit(True)).alias("split_valid"),
        F.count(F.lit(1)).cast("bigint").alias("series"),
        F.count_if(~ok).cast("bigint").alias("bad_series"))
