"""Where checkpoints go: a folder that is set counts as shared; a cluster without one has its warehouse."""

from types import SimpleNamespace

import pytest

from gridspark.session import checkpoint_dir


def cluster(current=None, **conf):
    """The parts of a session on a cluster of its own that choose the folder."""
    set_to = []
    context = SimpleNamespace(
        master="spark://host:7077", getCheckpointDir=lambda: current, getConf=lambda: conf, setCheckpointDir=set_to.append,
    )
    return SimpleNamespace(sparkContext=context, conf=conf), set_to


def test_a_mounted_folder_is_taken():
    spark, _ = cluster("file:/mnt/shared/checkpoints/4f1c")  # Spark's form of a plain path
    assert checkpoint_dir(spark) == "file:/mnt/shared/checkpoints/4f1c"
    spark, set_to = cluster(**{"spark.checkpoint.dir": "file:///mnt/shared"})
    assert checkpoint_dir(spark) == "file:///mnt/shared" and set_to == ["file:///mnt/shared"]


def test_without_a_folder_the_warehouse_serves():
    spark, set_to = cluster(**{"spark.sql.warehouse.dir": "hdfs://store/tables"})
    assert checkpoint_dir(spark).startswith("hdfs://store/tables/") and len(set_to) == 1


def test_with_neither_it_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(cluster()[0])
