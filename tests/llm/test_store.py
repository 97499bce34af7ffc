from types import SimpleNamespace

import pytest

from maskloom.llm import store


def session(master, folder=None):
    sc = SimpleNamespace(master=master, applicationId="app-x", getCheckpointDir=lambda: None)
    return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: folder))


def test_shared_folder():
    assert store.shared_dir(session("spark://host", "hdfs://store/tmp/")) == "hdfs://store/tmp"
    with pytest.raises(ValueError):
        store.shared_dir(session("spark://host"))
    assert store.shared_dir(session("local[2]")).startswith("file:///")


def test_saved_tables_are_read_back_and_dropped(spark):
    table = store.saved(spark.range(10).selectExpr("id", "cast(null as string) as s"), "test")
    assert table.count() == 10 and table.dtypes == [("id", "bigint"), ("s", "string")]
    store.dropped(table)
    with pytest.raises(Exception):
        spark.read.schema(table.schema).parquet(table._maskloom_path).count()


def test_batches_are_bounded_once(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "7m")
    store.prepare(spark)
    assert spark.conf.get(key) == "7m"
    spark.conf.unset(key)
    store.prepare(spark)
    assert spark.conf.get(key) == "2m"
    spark.conf.set(key, before)


def test_buffers_are_bounded(spark):
    import glob

    import pyarrow.parquet as pq

    key = "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.unset(key)
    store.prepare(spark)
    assert int(spark.conf.get(key)) == store.READ_ROWS < 4096
    spark.conf.set(key, "100")
    store.prepare(spark)
    assert spark.conf.get(key) == "100"  # a session's own bound stays
    spark.conf.unset(key)
    wide = spark.range(0, 6_000_000, 1, 1).selectExpr("id", "xxhash64(id) h")
    table = store.saved(wide, "groups")
    (file,) = glob.glob(table._maskloom_path.removeprefix("file://") + "/part-*")
    assert pq.ParquetFile(file).num_row_groups > 2 and table.count() == 6_000_000
    store.dropped(table)
