"""Curation intake as a stream of files into a queue table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from occurra.model import CURATION_ROW
from occurra.operators.merging import append_unique
from occurra.session import scratch_path

QUEUE_SCHEMA = "seq bigint, name string, smiles string, taxon string, doi string, key string"
LOG_SCHEMA = "added bigint, skipped bigint, batch bigint"


def read_queue(spark: SparkSession, queue_path: str, before: int | None = None) -> DataFrame:
    """The queue; ``before`` leaves out that batch and later ones."""
    rows = spark.read.schema(f"{QUEUE_SCHEMA}, batch bigint").parquet(f"{queue_path}/rows")
    return rows if before is None else rows.filter(F.col("batch") < before)


def read_log(spark: SparkSession, queue_path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(f"{queue_path}/log")


def _append_batch(queue_path: str):
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        offered = batch.persist()
        added, _ = append_unique(read_queue(spark, queue_path, before=batch_id), offered)
        target = f"{queue_path}/rows/batch={batch_id}"
        # own folder per batch, replaced when the batch is run again after a failure
        added.select("seq", "name", "smiles", "taxon", "doi", "key").write.mode("overwrite").parquet(target)
        n_added = spark.read.schema(QUEUE_SCHEMA).parquet(target).agg(F.count(F.lit(1)).alias("added"))
        n_offered = offered.count()
        n_added.select(
            F.col("added"),
            (F.lit(n_offered) - F.col("added")).cast("bigint").alias("skipped"),
        ).write.mode("overwrite").parquet(f"{queue_path}/log/batch={batch_id}")
        offered.unpersist()

    return run


def intake_stream(
    candidates: DataFrame, queue_path: str, checkpoint_path: str | None = None, once: bool = False
) -> StreamingQuery:
    """Append unseen candidates of a stream (with ``seq``) to the queue.

    Each batch is reduced to its first row per key and anti-joined with the
    queue of earlier batches only, so that running a batch twice gives the same
    queue.
    """
    spark = candidates.sparkSession
    empty = spark.createDataFrame([], QUEUE_SCHEMA)
    empty.limit(0).write.mode("ignore").parquet(f"{queue_path}/rows/batch=-1")
    writer = candidates.writeStream.foreachBatch(_append_batch(queue_path)).option(
        "checkpointLocation", checkpoint_path or scratch_path(spark, "intake")
    )
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def candidate_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Candidates landing as JSON lines in a folder."""
    return (
        spark.readStream.schema(CURATION_ROW).option("maxFilesPerTrigger", files_per_batch).json(folder)
    )
