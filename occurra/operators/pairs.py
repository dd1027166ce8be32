"""Occurrences laid out by a hash of (compound, taxon), so that a batch of asked pairs reads only the buckets they fall into."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occurra.session import counted_stage

#: Distinct occurrences a bucket should hold, and bounds of the number of buckets (each is a folder).
ROWS_PER_BUCKET = 1_000_000
FEWEST_BUCKETS, MOST_BUCKETS = 64, 4_096


def bucket_of(buckets: int, c: Column | str = "c", t: Column | str = "t") -> Column:
    return F.pmod(F.xxhash64(c, t), F.lit(buckets)).cast("int")


def write_pairs(statements: DataFrame, folder: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
    """Distinct ``(c, t, r)`` by bucket; a pair with very many references is laid out over several files."""
    spark = statements.sparkSession
    triples, n = counted_stage(statements.select("c", "t", "r").filter("c IS NOT NULL AND t IS NOT NULL").distinct(), "triples")
    buckets = min(max(-(-n // rows_per_bucket), FEWEST_BUCKETS), MOST_BUCKETS)
    placed = triples.withColumn("bucket", bucket_of(buckets)).repartitionByRange("bucket", "c", "t", "r").sortWithinPartitions("bucket", "c", "t")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/triples")
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/buckets")


@dataclass(frozen=True)
class PairIndex:
    spark: SparkSession
    folder: str

    @cached_property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.folder}/buckets").first()["buckets"]

    @cached_property
    def triples(self) -> DataFrame:
        return self.spark.read.schema("c string, t string, r string, bucket int").parquet(f"{self.folder}/triples")

    def of(self, asked: DataFrame) -> DataFrame:
        """Distinct ``(c, t, r)`` of distinct asked pairs ``(c, t)``, which are read twice: once for their buckets."""
        placed = asked.withColumn("bucket", bucket_of(self.buckets))
        needed = [r["bucket"] for r in placed.select("bucket").distinct().collect()]  # at most MOST_BUCKETS numbers
        part = self.triples if len(needed) == self.buckets else self.triples.filter(F.col("bucket").isin(needed))
        return part.join(placed, ["bucket", "c", "t"], "left_semi").select("c", "t", "r")
