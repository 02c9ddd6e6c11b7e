"""Session set-up and the two physical helpers every operator shares: cutting lineage and spreading input."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings of a session that this package creates itself; an existing session is taken as it is.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the package's settings."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("contextlake")
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions)).config("spark.driver.memory", memory)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names in ``spark.checkpoint.dir``.

    Only where that is unset, as in tests on one machine, is a local folder made.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "contextlake-checkpoints")
    context.setCheckpointDir(named)
    return named


def cut(df: DataFrame, *replaces: DataFrame, **observed: Column) -> DataFrame:
    """Write ``df`` as a table to the shared checkpoint folder and go on from there.

    A lost executor then costs no rerun of what led to it. A written table is taken rather than ``checkpoint()``, as
    that keeps the size estimates of the plan that it cuts: in loops of joins these multiply without bound, while a
    table has the size of its files, so that small ones are broadcast. Tables that the new one ``replaces`` are deleted
    once it is written, as in loops; all others go when the session's JVM ends. Aggregates named in ``observed`` are
    computed by the same job and stand in ``observed`` of the result; a task that runs twice may count twice in them.
    """
    spark, seen = df.sparkSession, Observation()
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/contextlake-{uuid.uuid4().hex}"
    (df.observe(seen, *[c.alias(n) for n, c in observed.items()]) if observed else df).write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table.cut_path, table.observed = path, seen.get if observed else {}
    release(*replaces)
    return table


def release(*tables: DataFrame) -> None:
    """Delete tables that ``cut`` has written; frames that read them can't be used any more."""
    for table in tables:
        where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """Give Python-heavy work one task per core at least; inputs with enough splits are left as they are, and so are those
    that come from a shuffle, as to know their partitions would be to run it."""
    plan = df._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return df
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if plan.execute().getNumPartitions() >= wanted else df.repartition(wanted)


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to its Python workers, once for each context, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_contextlake_shipped", False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="contextlake-")) / "contextlake_package.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._contextlake_shipped = True
