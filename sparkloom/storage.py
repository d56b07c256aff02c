"""Tables written to the cluster's shared folder, to cut lineage and to compute a costly step once.

A written table outlives the executors that made it, so losing one costs only the tasks that were running there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset: a temporary folder for a local master, else one in the warehouse, if that is shared."""
    sc = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        found = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_sparkloom"
        # A local path is another folder on every machine, and what one task writes there no other one finds.
        if found.startswith("file:") or "://" not in found:
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that driver and executors share; the warehouse, {found}, is local")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def new_path(spark: SparkSession, name: str = "table") -> str:
    return f"{shared_dir(spark)}/sparkloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and return the reread table, whose plan is a plain scan."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def materialize_observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """As :func:`materialize`, with aggregates of the rows that the write passes by, at no further job."""
    seen = Observation()
    out = materialize(df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), name)
    return out, seen.get


def release(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`materialize` that no later step reads."""
    for df in tables:
        path = getattr(df, "_sparkloom_path", None)
        if path:
            spark = df.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where a plan without shuffles would leave some idle, as small files and single row groups do."""
    plan, cores = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext.defaultParallelism
    # A plan with shuffles is adaptive, and asking it for its partitions would run it.
    if plan.nodeName().startswith("AdaptiveSparkPlan") or plan.execute().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are held to 4 MB from now on: batches of a number of rows can hold that many long values."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    return df
