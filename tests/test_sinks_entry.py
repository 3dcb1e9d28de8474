import pandas as pd
from pyspark.sql import functions as F

from demandcast.session import shared_path
from demandcast.sources.sinks import RunLog, as_spark, save_table


def test_as_spark_accepts_pandas(spark):
    df = as_spark(pd.DataFrame({"a": [1, 2]}), spark)
    assert df.count() == 2


def test_table_round_trip(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "store int, sales int")
    name = f"t_{RunLog.new_run_id()[:8]}"
    save_table(df, name, path=shared_path(spark, f"tables/{name}"), partition_by="store")
    assert sorted(tuple(r) for r in spark.table(name).select("store", "sales").collect()) == \
        [(1, 10), (2, 20)]


def test_run_log_appends(spark):
    log = RunLog(spark, shared_path(spark, f"runlog-{RunLog.new_run_id()}"))
    rid = RunLog.new_run_id()
    log.log(rid, "param", {"lr": 0.1, "depth": 3})
    log.log(rid, "metric", {"mape": 0.2})
    assert log.read().filter(F.col("run_id") == rid).count() == 3
    assert log.metrics(rid).first()["value"] == "0.2"


def test_run_log_keeps_every_concurrent_row(spark):
    from concurrent.futures import ThreadPoolExecutor
    log = RunLog(spark, shared_path(spark, f"runlog-{RunLog.new_run_id()}"))

    def work(i):
        for j in range(4):
            log.log(f"run{i}", "metric", {f"m{j}": j})
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(work, range(8)))
    assert log.read().count() == 32


def test_one_file_per_bucket(spark):
    import glob
    name = f"t_{RunLog.new_run_id()[:8]}"
    path = shared_path(spark, f"tables/{name}")
    df = spark.range(0, 5000, 1, 16).selectExpr("CAST(id % 50 AS INT) AS store", "id AS sales")
    save_table(df, name, path=path, bucket_by="store", buckets=4)
    assert len(glob.glob(path.removeprefix("file:") + "/part-*")) <= 4
    assert spark.table(name).count() == 5000


def test_missing_signature_is_none_but_a_broken_one_raises(spark):
    import pytest
    from demandcast.sources.sinks import load_signature
    path = shared_path(spark, f"sig-{RunLog.new_run_id()}")
    assert load_signature(spark, path) is None
    spark.createDataFrame([("not json",)], "signature string").write.json(f"{path}/signature")
    with pytest.raises(ValueError):
        load_signature(spark, path)


def test_entry_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.count() > 0 and len(out.columns) == 29
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert {"feature_frame", "split_counts", "ewm_features", "store_metrics"} <= set(sql)


def test_read_sales_csv_text_dates_and_dedupe(spark, tmp_path):
    import pytest
    from demandcast.sources.panel import read_sales
    from demandcast.sources.sinks import check_signature
    p = tmp_path / "sales.csv"
    p.write_text("date,store,item,sales\n01-02-2020,1,1,3\n01-02-2020,1,1,4\n"
                 "12-31-2019,1,1,5\n")
    df = read_sales(spark, str(p), file_format="csv", dedupe=True)
    got = sorted((str(r["date"]), r["sales"]) for r in df.collect())
    assert got == [("2019-12-31", 5), ("2020-01-02", 7)]
    assert dict(df.dtypes) == {"date": "date", "store": "int", "item": "int", "sales": "int"}
    with pytest.raises(ValueError):
        check_signature(df.drop("item"), df.schema)


def test_read_sales_stops_at_bad_dates(spark, tmp_path):
    import pytest
    from demandcast.sources.panel import read_sales
    p = tmp_path / "bad.csv"
    p.write_text("date,store,item,sales\n01-02-2020,1,1,3\n2020/13/45,1,1,4\n")
    with pytest.raises(Exception, match="2020/13/45"):
        read_sales(spark, str(p), file_format="csv").collect()
    lax = read_sales(spark, str(p), file_format="csv", strict=False)
    assert sorted(str(r["date"]) for r in lax.collect()) == ["2020-01-02", "None"]


def test_cluster_session_without_checkpoint_dir_is_refused():
    import pytest

    from demandcast.session import ensure_checkpoint_dir

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"
        set_to = None

        def getCheckpointDir(self):  # noqa: N802 - PySpark's name
            return None

        def getConf(self):  # noqa: N802
            return Conf()

        def setCheckpointDir(self, d):  # noqa: N802
            self.set_to = d

    class Session:
        sparkContext = Context()
        conf = Conf()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
    assert Session.sparkContext.set_to is None  # no machine-local folder was chosen

    class SharedConf(Conf):
        def get(self, key, default=None):
            return "hdfs:///shared/ckpt" if key == "spark.checkpoint.dir" else default

    class OwnFolder(Conf):
        def get(self, key, default=None):
            return "file:/tmp/ckpt" if key == "spark.checkpoint.dir" else default

    Session.conf = OwnFolder()
    with pytest.raises(RuntimeError):  # each machine has its own /tmp
        ensure_checkpoint_dir(Session())

    Session.conf = SharedConf()
    assert ensure_checkpoint_dir(Session()) == "hdfs:///shared/ckpt"
    assert Session.sparkContext.set_to == "hdfs:///shared/ckpt"
