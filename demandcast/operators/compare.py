"""Compare two versions of a panel column by column.

One full outer join on the keys and one aggregate with a ``count_if`` per
column, unpivoted to one row per column. Unlike the reference's comparer it
catches negative differences, reports rows present on one side only, and
treats two nulls as equal without a sentinel (D14).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_TOL = 1e-3


def mismatch(x: Column, y: Column, tol: float = DEFAULT_TOL, signed: bool = False) -> Column:
    """True where the two versions differ by more than ``tol``.

    ``signed=True`` is the reference's test (``x - y > tol`` after both
    sides' nulls became -1000); the default compares absolute differences and
    counts one-sided nulls as mismatches.
    """
    if signed:
        return (F.coalesce(x, F.lit(-1000.0)) - F.coalesce(y, F.lit(-1000.0))) > tol
    return (~x.eqNullSafe(y)) & (x.isNull() | y.isNull() | (F.abs(x - y) > tol))


def compare_columns(left: DataFrame, right: DataFrame, keys, cols,
                    tol: float = DEFAULT_TOL, signed: bool = False) -> DataFrame:
    """(column_name, rows_left, rows_right, rows_joined, left_only, right_only, mismatches)."""
    keys, cols = list(keys), list(cols)
    lx = left.select(*keys, *[F.col(c).cast("double").alias(f"{c}_x") for c in cols],
                     F.lit(True).alias("_in_x"))
    ry = right.select(*keys, *[F.col(c).cast("double").alias(f"{c}_y") for c in cols],
                      F.lit(True).alias("_in_y"))
    joined = lx.join(ry, keys, "full_outer")
    in_x = F.coalesce(F.col("_in_x"), F.lit(False))
    in_y = F.coalesce(F.col("_in_y"), F.lit(False))
    both = in_x & in_y
    aggs = [F.count_if(in_x).alias("rows_left"), F.count_if(in_y).alias("rows_right"),
            F.count_if(both).alias("rows_joined"),
            F.count_if(in_x & ~in_y).alias("left_only"),
            F.count_if(in_y & ~in_x).alias("right_only")]
    aggs += [F.count_if(both & mismatch(F.col(f"{c}_x"), F.col(f"{c}_y"), tol, signed))
             .alias(f"m{i}") for i, c in enumerate(cols)]
    wide = joined.agg(*aggs)
    stack = ", ".join(f"'{c}', m{i}" for i, c in enumerate(cols))
    return wide.select(
        F.expr(f"stack({len(cols)}, {stack}) AS (column_name, mismatches)"),
        *[F.col(c).cast("bigint").alias(c) for c in
          ("rows_left", "rows_right", "rows_joined", "left_only", "right_only")]
    ).select("column_name", "rows_left", "rows_right", "rows_joined", "left_only",
             "right_only", F.col("mismatches").cast("bigint").alias("mismatches"))
