"""Where scratch tables go."""

from types import SimpleNamespace

import pytest

from loomwork import session


def fake(master, **conf):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda k, d=None: conf.get(k.replace(".", "_"), d)),
        sparkContext=SimpleNamespace(master=master))


def test_shared_folder_comes_from_the_session():
    spark = fake("spark://host:7077", spark_checkpoint_dir="hdfs:///shared/")
    assert session.scratch_root(spark) == "hdfs:///shared/"
    path = session.scratch_path(spark, "x")
    assert path.startswith("hdfs:///shared/loomwork/x-") and path != session.scratch_path(spark, "x")


def test_cluster_without_shared_folder_is_an_error():
    with pytest.raises(RuntimeError):
        session.scratch_root(fake("spark://host:7077"))


def test_local_session_gets_one_folder():
    assert session.scratch_root(fake("local[2]")) == session.scratch_root(fake("local[4]"))


def test_materialize_reads_back(spark):
    df = spark.range(5)
    back = session.materialize(df, "test")
    assert back.dtypes == df.dtypes and back.count() == 5
    assert "parquet" in back._jdf.queryExecution().toString().lower()
