"""Write tables, models, model signatures and run logs.

Everything is written by Spark to a path or catalog table the caller names:
on a cluster that is shared storage, so a lost executor or driver restart
does not lose it. Nothing is written to a machine-local folder.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_LOG_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("run_ts", T.TimestampType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("key", T.StringType(), False),
    T.StructField("value", T.StringType(), True),
])


def as_spark(df, spark: SparkSession | None = None) -> DataFrame:
    """S3: accept a Spark, pandas-on-Spark or pandas frame."""
    if isinstance(df, DataFrame):
        return df
    if hasattr(df, "to_spark"):
        return df.to_spark()
    if isinstance(df, pd.DataFrame):
        spark = spark or SparkSession.getActiveSession()
        return spark.createDataFrame(df)
    raise TypeError(f"cannot write a {type(df).__name__}")


def laid_out(df: DataFrame, partition_by=None) -> DataFrame:
    """Rows dealt for a partitioned write: each value's rows together, but a value that
    holds many rows spread over as many tasks as its size asks for (AQE splits and merges
    rebalanced partitions by bytes)."""
    if not partition_by:
        return df
    return df.hint("rebalance", *([partition_by] if isinstance(partition_by, str) else partition_by))


def save_table(df, name: str, fmt: str = "parquet", mode: str = "overwrite",
               partition_by=None, path: str | None = None, bucket_by=None,
               buckets: int | None = None, sort_by=None, rows_per_file: int | None = None) -> None:
    """``saveAsTable`` (the reference used Delta; the format is a parameter).

    ``path`` makes it an external table at that location; ``partition_by``
    (e.g. ``"store"``) lets later reads prune partitions. ``bucket_by=("store",
    "item")`` with ``buckets`` stores the panel hash-partitioned by series, so a
    feature frame read from it needs no shuffle at all (the bucketed scan
    already provides the series partitioning); ``sort_by`` adds ``date``
    order inside each bucket. ``buckets`` defaults to the session's shuffle
    partitions; ``rows_per_file`` bounds the files of a large partition value.
    An overwrite that must be atomic, or that reads the table it replaces, is
    :class:`demandcast.sources.snapshots.SnapshotTable`'s.
    """
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    df = as_spark(df)
    buckets = int(buckets or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows are dealt by the layout's own keys first, so a bucket is written by one task
    # and a partition value by as few as its size allows, not by every task
    if bucket_by:
        df = df.repartition(buckets, *as_list(bucket_by))
    else:
        df = laid_out(df, partition_by)
    writer = df.write.format(fmt).mode(mode)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if partition_by:
        writer = writer.partitionBy(*as_list(partition_by))
    if bucket_by:
        writer = writer.bucketBy(buckets, *as_list(bucket_by))
        if sort_by:
            writer = writer.sortBy(*as_list(sort_by))
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


# ------------------------------------------------------------ S4, S6 --

def save_model(model, path: str, input_example: DataFrame | None = None,
               example_rows: int = 5) -> None:
    """S4 + S6: the pipeline, its input schema and a few input rows, side by side."""
    pm = model.model if hasattr(model, "model") else model
    pm.write().overwrite().save(f"{path}/model")
    if input_example is not None:
        spark = input_example.sparkSession
        sig = json.dumps({"inputs": json.loads(input_example.schema.json()),
                          "output": {"name": "prediction", "type": "double"}})
        (spark.createDataFrame([(sig,)], "signature string")
              .write.mode("overwrite").json(f"{path}/signature"))
        (input_example.limit(example_rows)
                      .write.mode("overwrite").parquet(f"{path}/input_example"))


def load_signature(spark: SparkSession, path: str) -> T.StructType | None:
    try:
        row = spark.read.json(f"{path}/signature").first()
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":  # no signature was saved
            return None
        raise
    return T.StructType.fromJson(json.loads(row["signature"])["inputs"])


def load_model(spark: SparkSession, path: str) -> PipelineModel:
    """The saved pipeline (predictions equal the saved model's)."""
    return PipelineModel.load(f"{path}/model")


def check_signature(df: DataFrame, signature: T.StructType | None) -> None:
    """Every input column the model was saved with must be present with its type."""
    if signature is None:
        return
    have = {f.name: f.dataType for f in df.schema.fields}
    missing = [f.name for f in signature.fields if f.name not in have]
    if missing:
        raise ValueError(f"input lacks columns the model was saved with: {missing}")
    other = [f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}"
             for f in signature.fields if have[f.name] != f.dataType]
    if other:
        raise ValueError(f"input columns have other types than the model was saved with: {other}")


# ---------------------------------------------------------------- S5 --

class RunLog:
    """An append-only table of (run_id, run_ts, kind, key, value) rows.

    ``kind`` is ``param``, ``metric`` or ``tag``; values are stored as text.
    Every call writes a folder of its own below ``path``: concurrent writers share
    no ``_temporary`` folder, so none can take another's rows away. Use
    :meth:`log_all` for many items at once (one job, one folder).
    """

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path, fmt

    @staticmethod
    def new_run_id() -> str:
        return uuid.uuid4().hex

    def log(self, run_id: str, kind: str, items: dict) -> None:
        self.log_all([(run_id, kind, items)])

    def log_all(self, entries) -> None:
        """Write many (run_id, kind, items) entries with one job."""
        ts = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        rows = [(run_id, ts, kind, str(k), None if v is None else str(v))
                for run_id, kind, items in entries for k, v in items.items()]
        if rows:
            (self.spark.createDataFrame(rows, RUN_LOG_SCHEMA).coalesce(1)
                 .write.format(self.fmt).mode("errorifexists")
                 .save(f"{self.path}/batch-{uuid.uuid4().hex}"))

    def read(self) -> DataFrame:
        return (self.spark.read.format(self.fmt).schema(RUN_LOG_SCHEMA)
                    .option("recursiveFileLookup", "true").load(self.path))

    def metrics(self, run_id: str) -> DataFrame:
        return self.read().filter((F.col("run_id") == run_id) & (F.col("kind") == "metric"))
