import os
import subprocess
import sys
from pathlib import Path

import pyspark
from pyspark.sql import functions as F

from sparkloom.plans import udf


class Scale:
    def __init__(self, by: int):
        self.by = by

    def __call__(self, x, t):
        return None if x is None else f"{t}{x * self.by}"


def frame(spark):
    return spark.range(5).select(F.when(F.col("id") != 3, F.col("id")).alias("x"), F.lit("t").alias("t"))


def test_a_stage_of_its_own_by_the_plan(spark):
    df = udf.on_resources(frame(spark), udf.Remote(Scale, 10), ["x", "t"], "y", "string", cpus=2, gpus=1, barrier=True)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "cpus" in plan and "gpu" in plan and "true" in plan.split("MapInArrow")[1]
    profile = udf.resources(cpus=4)
    assert profile.taskResources["cpus"].amount == 4 and not profile.executorResources
    assert udf.resources(gpus=0.5, memory="2g").executorResources["gpu"].amount == 1


def test_without_needs_it_runs_anywhere(spark):
    out = udf.on_resources(frame(spark), udf.Remote(Scale, 10), ["x", "t"], "y", "string")
    assert [r["y"] for r in out.orderBy(F.col("x").asc_nulls_last()).collect()] == ["t0", "t10", "t20", "t40", None] and out.columns == ["x", "t", "y"]


CLUSTER = """
from pyspark.sql import SparkSession
from test_resources import Scale, frame
from sparkloom.plans import udf
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.ui.enabled", "false").getOrCreate()
out = udf.on_resources(frame(spark), udf.Remote(Scale, 10), ["x", "t"], "y", "string", cpus=2)
print("GOT", sorted(str(r["y"]) for r in out.collect()))
spark.stop()
"""


def test_a_cluster_runs_it_with_two_cores_a_task(tmp_path):
    # Executors work below Spark's home; one of links keeps that out of the installation.
    home, here = tmp_path / "home", tmp_path / "here"
    home.mkdir()
    here.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    done = subprocess.run([sys.executable, "-c", CLUSTER], capture_output=True, text=True, timeout=180, cwd=here, env=os.environ | {"SPARK_SCALA_VERSION": "2.13", "SPARK_HOME": str(home)})
    assert "GOT ['None', 't0', 't10', 't20', 't40']" in done.stdout, done.stderr[-2000:]
