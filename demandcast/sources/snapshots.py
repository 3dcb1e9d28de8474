"""Numbered commits on shared storage: atomic table overwrites (S2) and model versions.

Both need one thing that a folder of files lacks: a single step that makes a finished
write visible. Data is written by Spark into a folder of its own; then a small numbered
file that names the folder is created, if no such number exists yet. Whoever loses the
race for a number takes the next one, so numbers have no gaps and nothing is overwritten.

- :class:`SnapshotTable`: readers take the highest number (or one that they name) and see
  that snapshot until they ask again. A table can be overwritten from itself; a write
  that fails leaves no number, so the table stays as it was.
- :class:`ModelVersions`: a version per saved model, with tags and a description that may
  change later.

The numbered file appears whole or not at all: on a file system that the driver sees
directly it is linked into place, elsewhere Hadoop's create-without-overwrite is used
(atomic on HDFS, ABFS, GCS and on S3A with conditional writes).
"""

from __future__ import annotations

import datetime as dt
import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from demandcast.sources.sinks import RunLog, as_spark, laid_out

_DIGITS = 9
_LOCAL = ("", "file")


def _local(path: str) -> str | None:
    """The path on this machine's file system, if it is one."""
    found = urlparse(path)
    return unquote(found.path) if found.scheme in _LOCAL else None


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file whole, unless the path exists; whether it was created."""
    if (local := _local(path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        staged = f"{local}.{uuid.uuid4().hex}.staged"
        with open(staged, "x", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        try:
            os.link(staged, local)  # one step: fails if the name is taken
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)
    fs, at = _hadoop(spark, path)
    if fs.exists(at):
        return False
    try:
        out = fs.create(at, False)
    except Exception as taken:  # py4j wraps the file system's own exception
        if "FileAlreadyExists" in str(taken):
            return False
        raise
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    return True


def _listed(spark: SparkSession, folder: str) -> list[str]:
    """Names of the committed files of a folder, in order."""
    if (local := _local(folder)) is not None:
        names = os.listdir(local) if os.path.isdir(local) else []
    else:
        fs, at = _hadoop(spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(n for n in names if n.endswith(".json") and n[:-5].isdigit())


def _text(spark: SparkSession, path: str) -> str:
    if (local := _local(path)) is not None:
        with open(local, encoding="utf-8") as f:
            return f.read()
    return spark.read.option("wholetext", True).text(path).first()["value"]


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _hadoop(spark, path)
    fs.delete(at, True)


class Commits:
    """Numbered JSON records in one folder: 1, 2, 3, ... without gaps."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def numbers(self) -> list[int]:
        return [int(n[:-5]) for n in _listed(self.spark, self.folder)]

    def add(self, record: dict) -> int:
        """Commit a record under the next free number."""
        number = (self.numbers() or [0])[-1] + 1
        while not create_if_absent(self.spark, self._path(number), json.dumps({**record, "number": number})):
            number += 1
        return number

    def get(self, number: int | None = None) -> dict:
        """A record, the latest by default."""
        known = self.numbers()
        if not known:
            raise LookupError(f"nothing is committed in {self.folder}")
        number = known[-1] if number is None else number
        if number not in known:
            raise LookupError(f"{self.folder} has no number {number}")
        return json.loads(_text(self.spark, self._path(number)))

    def all(self) -> list[dict]:
        return [self.get(n) for n in self.numbers()]

    def _path(self, number: int) -> str:
        return f"{self.folder}/{number:0{_DIGITS}d}.json"


class SnapshotTable:
    """A table of whole snapshots below ``path``; the latest number is the table."""

    def __init__(self, spark: SparkSession, path: str, fmt: str = "parquet"):
        self.spark, self.path, self.fmt = spark, path.rstrip("/"), fmt
        self.commits = Commits(spark, f"{self.path}/_snapshots")

    def overwrite(self, df, partition_by=None, rows_per_file: int | None = None) -> int:
        """Replace the table by ``df`` (which may read this table); the new number."""
        df = as_spark(df, self.spark)
        folder = f"data-{uuid.uuid4().hex}"
        writer = laid_out(df, partition_by).write.format(self.fmt).mode("errorifexists")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        if partition_by:
            writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
        writer.save(f"{self.path}/{folder}")  # a failure up to here leaves the table as it was
        return self.commits.add({"folder": folder, "schema": df.schema.json()})

    def read(self, number: int | None = None) -> DataFrame:
        """One snapshot, the latest by default; later writes do not change the frame."""
        from pyspark.sql.types import StructType

        record = self.commits.get(number)
        schema = StructType.fromJson(json.loads(record["schema"]))
        return (self.spark.read.format(self.fmt).schema(schema).load(f"{self.path}/{record['folder']}")
                .select(*schema.names))

    def expire(self, keep: int = 2) -> list[int]:
        """Delete the data of all but the last ``keep`` snapshots; their numbers.

        The numbers stay taken. A reader that holds an expired snapshot fails, so keep
        as many as the longest reader needs.
        """
        old = self.commits.numbers()[:-keep] if keep > 0 else []
        for number in old:
            _delete(self.spark, f"{self.path}/{self.commits.get(number)['folder']}")
        return old


class ModelVersions:
    """Versions of named models below ``root``, with tags and descriptions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self, name: str) -> Commits:
        if not name or "/" in name:
            raise ValueError(f"not a model name: {name!r}")
        return Commits(self.spark, f"{self.root}/{name}/versions")

    def _notes(self, name: str) -> RunLog:
        return RunLog(self.spark, f"{self.root}/{name}/notes")

    def register(self, name: str, save, description: str | None = None, tags: dict | None = None) -> int:
        """Save a model and commit it as the next version of ``name``.

        ``save(path)`` writes the model to the folder it is given; it runs before the
        version exists, so a reader never sees half a model.
        """
        path = f"{self.root}/{name}/models/{uuid.uuid4().hex}"
        commits = self._commits(name)
        save(path)
        now = dt.datetime.now(dt.timezone.utc).isoformat()
        version = commits.add({"name": name, "path": path, "created": now})
        notes = dict(tags or {})
        if notes or description is not None:
            self.annotate(name, version, notes, description)
        return version

    def annotate(self, name: str, version: int, tags: dict | None = None, description: str | None = None) -> None:
        """Set tags (a None removes one) and the description of a version."""
        self._commits(name).get(version)
        run = f"{version:0{_DIGITS}d}"
        entries = [(run, "tag", tags)] if tags else []
        if description is not None:
            entries.append((run, "description", {"description": description}))
        self._notes(name).log_all(entries)

    def get(self, name: str, version: int | None = None) -> dict:
        """``name, number, path, created`` of a version, the latest by default."""
        return self._commits(name).get(version)

    def versions(self, name: str) -> DataFrame:
        """``name, version, path, created`` of every version (a row per saved model)."""
        rows = [(r["name"], r["number"], r["path"], r["created"]) for r in self._commits(name).all()]
        return self.spark.createDataFrame(rows, "name string, version int, path string, created string")

    def notes(self, name: str) -> DataFrame:
        """``version, kind, key, value``: the last value set for every tag and description."""
        last = Window.partitionBy("run_id", "kind", "key").orderBy(F.col("run_ts").desc())
        return (self._notes(name).read().withColumn("nth", F.row_number().over(last))
                .filter("nth = 1 and value is not null")
                .select(F.col("run_id").cast("int").alias("version"), "kind", "key", "value"))
