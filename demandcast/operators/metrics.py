"""Error metrics overall, per split set and per store, on the cluster.

A prediction column lives in the same row as its label (J2, D17), so a
per-store table is one ``groupBy`` with partial aggregation instead of one
driver-side prediction per store.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# MAPE denominators are max(|y|, floor).
# float64 machine epsilon, the floor of the hold-out MAPE (D9):
EPS = 2.220446049250313e-16
# the floor of the validation MAPE used while fitting and searching (D9):
FIT_FLOOR = 1.0


def metric_columns(label: str, pred: str, floor: float = EPS) -> list[Column]:
    """mse, rmse (D8: both, under their right names), mape, mae and row count."""
    y = F.col(label).cast("double")
    err = F.col(pred).cast("double") - y
    mse = F.avg(err * err)
    return [
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(err) / F.greatest(F.abs(y), F.lit(float(floor)))).alias("mape"),
        F.avg(F.abs(err)).alias("mae"),
        F.count(err).cast("bigint").alias("n"),
    ]


def score_metrics(df: DataFrame, label: str = "sales", pred: str = "prediction",
                  by=None, floor: float = EPS) -> DataFrame:
    """A6/A7 overall (``by=None``) or A8 per group, sorted by the group keys."""
    if not by:
        return df.agg(*metric_columns(label, pred, floor))
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(*metric_columns(label, pred, floor)).orderBy(*by)


def metric_means(per_group: DataFrame, cols=("mse", "rmse", "mape")) -> DataFrame:
    """NaN- and null-skipping mean of each metric column (``np.nanmean``)."""
    return per_group.agg(*[
        F.avg(F.when(~F.isnan(F.col(c)), F.col(c))).alias(f"mean_{c}") for c in cols])
