"""Spark session and checkpoint helpers."""
import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(app="kinsift", cores=None, partitions=None, extra=None):
    """A local session for tests and the bench; a cluster passes its own session instead."""
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", partitions or str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
    )
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark):
    """Use the shared folder named in spark.checkpoint.dir; make one up only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="kinsift-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")


def many_tasks(spark):
    """Partitions for a small table whose rows make much work. Asked for by number, they are not merged again for being small."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def materialise(df):
    """Write a table to the shared folder and read it back: the lineage ends there, a lost executor
    costs nothing, and the planner knows the real size."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df):
    """Delete the files of a table written by `materialise`; nothing outside the shared folder is touched."""
    spark = df.sparkSession
    shared = spark.sparkContext.getCheckpointDir()
    jvm = spark.sparkContext._jvm
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        if shared and folder.split(":", 1)[-1].lstrip("/").startswith(shared.split(":", 1)[-1].lstrip("/") + "/table-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
