"""Where reduced tables are kept."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from textlens import session


class _Context:
    def __init__(self, master, directory=None):
        self.master, self.directory = master, directory

    def getCheckpointDir(self):
        return self.directory

    def setCheckpointDir(self, directory):
        self.directory = directory


class _Session:
    def __init__(self, master, setting=None, directory=None):
        self.sparkContext = _Context(master, directory)
        self.conf = {session.CHECKPOINT_SETTING: setting} if setting else {}


def test_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session("yarn"))


def test_named_folder_is_used():
    for master in ("yarn", "local[4]"):
        named = _Session(master, "hdfs:///shared/checkpoints")
        session.ensure_checkpoint_dir(named)
        assert named.sparkContext.directory == "hdfs:///shared/checkpoints"
    kept = _Session("yarn", "hdfs:///other", "hdfs:///already/set")
    session.ensure_checkpoint_dir(kept)
    assert kept.sparkContext.directory == "hdfs:///already/set"


def test_local_session_makes_its_own():
    local = _Session("local[2]")
    session.ensure_checkpoint_dir(local)
    assert "textlens-checkpoints-" in local.sparkContext.directory


def test_settled_table_no_longer_depends_on_its_plan(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    kept = session.settle(df)
    assert "HashAggregate" not in kept._jdf.queryExecution().executedPlan().toString()
    assert sorted(kept.collect()) == sorted(df.collect())
