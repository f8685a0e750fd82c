"""Session settings and the two services every operator shares: tables by name and checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from outside."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tenure")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of spark.checkpoint.dir; only a local session may do without and gets a folder of its own."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tenure-checkpoint-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise df reliably: the plan behind it is cut, and lost executors can read it again.

    The result is known by the size of its files. Spark keeps the estimate of the plan that was cut, and
    estimates of joins multiply: over rounds they grow to numbers of millions of digits.
    """
    ensure_checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    spark, jvm = done.sparkSession, done.sparkSession._jvm
    plan = done._jdf.queryExecution().analyzed()
    path = jvm.org.apache.hadoop.fs.Path(plan.rdd().getCheckpointFile().get())
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    # statistics of that size are those of a plan of that size
    stats = spark.range(max(1, size // 8)).select((F.col("id") + 0).alias("x"))._jdf.queryExecution().analyzed().stats()
    nothing = jvm.scala.Option.empty()
    leaf = jvm.org.apache.spark.sql.execution.LogicalRDD(
        plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), done._jdf.sparkSession(), jvm.scala.Option.apply(stats), nothing
    )
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(done._jdf.sparkSession(), leaf), spark)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cores(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)

