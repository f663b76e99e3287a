"""Reading the crawl tables and cutting lineage safely."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """The parquet table `name` under `root`, narrowed to `columns` when given."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    return df.select(*columns) if columns else df


#: Tables of fewer bytes, by the planner's estimate, are spread over all cores where their files would leave some idle.
SMALL_BYTES = 32 << 20


def read_spread(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """read_table for row-wise work: a small table in fewer files than there are cores is spread by the hash of its first column.

    Large tables, and those with files enough, stay as they are stored and are not shuffled.
    """
    df = read_table(spark, root, name, *columns)
    cores = spark.sparkContext.defaultParallelism
    if int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < SMALL_BYTES and 0 < len(df.inputFiles()) < cores:
        return df.repartition(cores, df.columns[0])
    return df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    The folder that the cluster names in spark.checkpoint.dir wins. Only where
    neither that setting nor a checkpoint folder exists is a folder of our own
    made, and only where everything runs on one machine.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set: a cluster needs a shared folder")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="sitelake-checkpoint-"))
    return jsc.getCheckpointDir().get()


def materialise(df: DataFrame) -> DataFrame:
    """Checkpoint `df` to the shared folder, so that later reads neither recompute nor depend on an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
