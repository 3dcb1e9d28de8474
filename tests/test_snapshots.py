"""Atomic overwrites (S2) and model versions."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from demandcast.session import shared_path
from demandcast.sources import snapshots
from demandcast.sources.sinks import RunLog, laid_out
from demandcast.sources.snapshots import Commits, ModelVersions, SnapshotTable, create_if_absent


@pytest.fixture
def folder(spark):
    return shared_path(spark, f"test-snapshots/{RunLog.new_run_id()}")


def numbers(df):
    return sorted(r[0] for r in df.collect())


def test_create_if_absent_is_whole_or_not(spark, folder):
    assert create_if_absent(spark, f"{folder}/x.json", "one")
    assert not create_if_absent(spark, f"{folder}/x.json", "two")
    assert snapshots._text(spark, f"{folder}/x.json") == "one"


def test_create_if_absent_through_hadoop(spark, folder, monkeypatch):
    monkeypatch.setattr(snapshots, "_local", lambda path: None)
    commits = Commits(spark, f"{folder}/commits")
    assert commits.numbers() == []
    assert [commits.add({"v": i}) for i in range(3)] == [1, 2, 3]
    assert not create_if_absent(spark, commits._path(2), "other")
    assert commits.get()["v"] == 2 and commits.get(1)["v"] == 0


def test_eight_writers_take_eight_numbers(spark, folder):
    models = ModelVersions(spark, folder)

    def work(i):
        return [models.register("m", lambda path: spark.range(i + 1).write.parquet(path), tags={"writer": i})
                for _ in range(2)]

    with ThreadPoolExecutor(8) as pool:
        got = [v for vs in pool.map(work, range(8)) for v in vs]
    assert sorted(got) == list(range(1, 17))
    rows = models.versions("m").collect()
    assert sorted(r.version for r in rows) == list(range(1, 17)) and len({r.path for r in rows}) == 16
    writers = {r.version: int(r.value) for r in models.notes("m").collect()}
    for r in rows:
        assert spark.read.parquet(r.path).count() == writers[r.version] + 1


def test_versions_tags_and_descriptions(spark, folder):
    models = ModelVersions(spark, folder)
    save = lambda path: spark.range(3).write.parquet(path)
    assert models.register("m", save, "first", {"stage": "test"}) == 1
    assert models.register("m", save) == 2 and models.register("other", save) == 1
    models.annotate("m", 1, {"stage": "live", "by": "x"}, "better")
    models.annotate("m", 1, {"by": None})
    assert sorted(map(tuple, models.notes("m").collect())) == \
        [(1, "description", "description", "better"), (1, "tag", "stage", "live")]
    assert models.get("m")["number"] == 2 and models.get("m", 1)["number"] == 1
    for bad in (lambda: models.get("m", 3), lambda: models.get("none"), lambda: models.annotate("m", 9, {"a": 1})):
        with pytest.raises(LookupError):
            bad()

    def broken(path):
        spark.range(1).write.parquet(path)
        raise OSError("disk")

    with pytest.raises(OSError):
        models.register("m", broken)
    assert models.get("m")["number"] == 2


def test_overwrite_from_itself_and_failed_write(spark, folder):
    table = SnapshotTable(spark, folder)
    with pytest.raises(LookupError):
        table.read()
    table.overwrite(spark.range(10).withColumn("store", F.col("id") % 2), partition_by="store")
    table.overwrite(table.read().filter("store = 1"))
    assert numbers(table.read()) == [1, 3, 5, 7, 9] and table.read().columns == ["id", "store"]
    broken = table.read().withColumn("id", F.expr("if(id = 5, raise_error('stop'), id)").cast("long"))
    with pytest.raises(Exception, match="stop"):
        table.overwrite(broken)
    assert numbers(table.read()) == [1, 3, 5, 7, 9] and table.commits.numbers() == [1, 2]
    assert numbers(table.read(1)) == list(range(10))


def test_reader_keeps_its_snapshot(spark, folder):
    table = SnapshotTable(spark, folder)
    table.overwrite(spark.range(5))
    before = table.read()
    table.overwrite(spark.range(100, 103))
    assert numbers(before) == [0, 1, 2, 3, 4] and numbers(table.read()) == [100, 101, 102]
    table.overwrite(spark.range(1))
    assert table.expire(keep=2) == [1]
    assert numbers(table.read(2)) == [100, 101, 102]


def test_a_large_partition_value_is_written_by_many_tasks(spark, folder):
    """One store holds most rows: its rows spread by size, and small stores share tasks."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.rebalancePartitionsSmallPartitionFactor": "0.1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") < 150_000, 1).otherwise(F.col("id") % 5 + 2).alias("store"),
            F.xxhash64("id").alias("sales"))
        laid_out(rows, "store").write.partitionBy("store").parquet(folder)
        files = spark.read.parquet(folder).select("store", F.input_file_name().alias("f")).distinct() \
            .groupBy("store").count().collect()
        counts = {r["store"]: r["count"] for r in files}
        assert counts[1] > 4 and all(n <= 2 for s, n in counts.items() if s != 1)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
