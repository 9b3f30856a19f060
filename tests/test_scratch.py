"""The folder for intermediate data: where it is, and that it goes."""

import os
import subprocess
import sys
import types

import pytest

from inkspark.sources.scratch import _root, scratch

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
from pyspark.sql import SparkSession
from inkspark.sources.scratch import scratch
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{}").getOrCreate()
path = scratch(spark)
spark.range(3).write.parquet(path)
print("rows", spark.read.parquet(path).count(), path)
spark.stop()
"""


def test_folder_of_the_setting_is_used_and_removed_after_the_session_stopped(tmp_path):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=180)
    assert f"rows 3 {tmp_path}/inkspark-" in done.stdout
    assert not list(tmp_path.glob("inkspark-*/*"))


def test_new_path_each_time(spark):
    assert scratch(spark) != scratch(spark)


def test_a_local_warehouse_is_no_shared_folder(spark):
    """On a cluster without a folder for checkpoints, a warehouse on each machine's own disk is refused."""
    conf = types.SimpleNamespace(get=lambda key, default=None: default if key == "spark.checkpoint.dir" else "file:/var/warehouse")
    far = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="spark://far:7077", _jvm=spark.sparkContext._jvm, _jsc=spark.sparkContext._jsc))
    with pytest.raises(ValueError, match=r"spark\.checkpoint\.dir"):
        _root(far)
