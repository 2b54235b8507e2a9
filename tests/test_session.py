import subprocess
import sys
import time
from pathlib import Path
from types import SimpleNamespace

import pytest

from quern.session import checkpoint_root, staged


def test_no_machine_local_folder_on_a_cluster():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="yarn")
    spark = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: default))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_root(spark)


def test_the_named_folder_is_used(tmp_path):
    code = f"""
from pyspark.sql import SparkSession
from quern.session import checkpoint_root, durable, scratch_path, staged
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "{tmp_path}").getOrCreate()
assert scratch_path(spark, "x").startswith("{tmp_path}/x-"), scratch_path(spark, "x")
assert durable(spark.range(3)).count() == staged(spark.range(3), "y").count() == 3
"""
    root = str(Path(__file__).resolve().parents[1])
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root, timeout=120)
    assert any(p.name.startswith("y-") for p in tmp_path.iterdir())
    assert any(p.name.startswith("rdd-") for p in tmp_path.glob("*/*"))


def test_staged_leaves_no_shuffle_files(spark):
    def shuffled():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split("/shuffle_")[1:]

    before = set(shuffled())
    kept = staged(spark.range(1000).repartition(3, "id"), "z")
    for _ in range(20):  # they go in the background
        if not set(shuffled()) - before:
            break
        time.sleep(0.5)
    assert not set(shuffled()) - before and kept.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
