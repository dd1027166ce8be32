"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Runtime settings every job of this library assumes. They can be changed on a
# live session, so `tune` also serves sessions made elsewhere.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "occurra", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, visible to all executors.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if current is None:
            context.setCheckpointDir(configured)
        return configured
    if current is not None:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="occurra-"))
    return context.getCheckpointDir()


_scratch: list[str] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder of this session in the shared folder; ``clear_scratch`` removes it."""
    path = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


class scratch:  # noqa: N801
    """``with scratch(spark):`` removes the tables stored inside when the block ends.

    Results have to be written or collected within the block: they read those tables.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.start = spark, 0

    def __enter__(self) -> "scratch":
        self.start = len(_scratch)
        return self

    def __exit__(self, *_: object) -> None:
        clear_scratch(self.spark, self.start)


def clear_scratch(spark: SparkSession, start: int = 0) -> None:
    """Remove the scratch folders this process has made, from number ``start`` on.

    Folders are deleted through the file system of their path, so this also works
    in a remote store.
    """
    jvm = spark.sparkContext._jvm
    for path in _scratch[start:]:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    del _scratch[start:]


def one_row(spark: SparkSession, **values: object) -> DataFrame:
    """One row of constants, planned without a job."""
    columns = ", ".join(f":{name} AS {name}" for name in values)
    return spark.sql(f"SELECT {columns}", args=values)


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Store ``df`` as a table in the shared folder and read it from there.

    Survives the loss of executors, and gives the planner the real size of the
    table, which a checkpointed RDD does not.
    """
    return counted_stage(df, label)[0]


def counted_stage(df: DataFrame, label: str = "stage", compression: str | None = None) -> tuple[DataFrame, int]:
    """``cut_lineage`` plus the number of rows, counted while writing. Name a compression only for tables that no join
    reads: the planner goes by the size of their files."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    rows = Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path), rows.get["n"]
