"""Keyed merges of curation tables; ``seq`` carries the input order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.functions import text as tx
from occurra.operators.skew import keep_first


def with_row_key(df: DataFrame, name: str = "key") -> DataFrame:
    return df.withColumn(name, tx.row_key(F.col("smiles"), F.col("taxon"), F.col("doi")))


def dedup_candidates(rows: DataFrame) -> DataFrame:
    """E3 on curation rows: the first row per row key."""
    return keep_first(with_row_key(rows), ["key"], [F.col("seq").asc()])


def append_unique(queue: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates new to the queue and to each other, and ``(added, skipped)``.

    Candidates shrink to one row per key first. The queue, which keeps growing,
    is reduced to the keys on offer before anything else: for a batch that
    measures small that is a scan of its ``key`` column without a shuffle.
    """
    queued = queue if "key" in queue.columns else with_row_key(queue)
    firsts = dedup_candidates(candidates)
    taken = queued.select("key").join(firsts.select("key"), "key", "left_semi").distinct()
    added = firsts.join(taken, "key", "left_anti")
    offered = candidates.agg(F.count(F.lit(1)).alias("offered"), F.lit("all").alias("_one"))
    kept = added.agg(F.count(F.lit(1)).alias("added"), F.lit("all").alias("_one"))
    counts = kept.join(offered, "_one").select("added", (F.col("offered") - F.col("added")).alias("skipped"))
    return added, counts


def merge_passes(previous: DataFrame, updated: DataFrame) -> DataFrame:
    """``previous`` in order with matching rows replaced.

    Per key only the first previous row is replaced, by the last updated row.
    Both sides shrink to one row per key, meet, and come back on the unique
    ``seq``, so a key held by many previous rows is never gathered.
    """
    payload = [c for c in previous.columns if c not in ("seq", "key")]
    first = previous.groupBy("key").agg(F.min("seq").alias("seq"))
    last = keep_first(updated, ["key"], [F.col("seq").desc()])
    replacing = (
        last.select("key", F.struct(*payload).alias("_new")).join(first, "key").select("seq", "_new")
    )
    merged = previous.join(replacing, "seq", "left")
    chosen = [
        F.when(F.col("_new").isNotNull(), F.col("_new").getField(c)).otherwise(F.col(c)).alias(c)
        for c in payload
    ]
    return merged.select("seq", "key", *chosen)
