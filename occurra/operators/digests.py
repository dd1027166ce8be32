"""D5 kept up to date: distinct ids laid out by bucket, a digest per bucket, and one digest over those.

Rows that are added later read and digest only the buckets their new ids fall into.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occurra.operators.stats import DIGEST_BUCKETS, bucket_digests, digest_ids, whole_digest
from occurra.session import cut_lineage

#: Folders that the buckets are dealt over; a batch opens those of its ids.
PARTS = 256
IDS = "id string, bucket bigint, version int, part int"
DIGESTS = "bucket bigint, digest string"


@dataclass(frozen=True)
class DigestTree:
    """The ids under ``folder/ids/version=/part=`` and the digests under ``folder/digests/version=``.

    Version 0 comes from ``write``, the next ones from ``add`` in ascending order. A version replaces what an
    earlier attempt at it left, so a lost run can be repeated. NULL ids are left out, known ids change nothing.
    """

    spark: SparkSession
    folder: str

    def write(self, rows: DataFrame, compound: str = "compound_qid") -> None:
        self._store(_placed(rows, compound), 0)
        self._store_digests(bucket_digests(self._ids(0)), 0)

    def add(self, rows: DataFrame, version: int, compound: str = "compound_qid") -> None:
        offered = cut_lineage(_placed(rows, compound), "offered")
        parts = [r["part"] for r in offered.select("part").distinct().collect()]  # at most PARTS numbers
        fresh = offered.join(self._ids(version - 1, parts), ["part", "bucket", "id"], "left_anti")
        self._store(fresh, version)
        touched = self._ids(version, parts).filter(F.col("version") == version).select("bucket").distinct()
        again = bucket_digests(self._ids(version, parts).join(touched, "bucket", "left_semi"))
        self._store_digests(again.unionByName(self.digests(version - 1).join(touched, "bucket", "left_anti")), version)

    def digests(self, version: int) -> DataFrame:
        """``(bucket, digest)``, at most ``DIGEST_BUCKETS`` rows."""
        return self.spark.read.schema(DIGESTS).parquet(f"{self.folder}/digests/version={version}")

    def digest(self, version: int) -> DataFrame:
        """The one row that ``result_digest`` gives for all rows up to the version."""
        return whole_digest(self.digests(version))

    def _ids(self, version: int, parts: list[int] | None = None) -> DataFrame:
        ids = self.spark.read.schema(IDS).parquet(f"{self.folder}/ids").filter(F.col("version") <= version)
        return ids if parts is None or len(parts) == PARTS else ids.filter(F.col("part").isin(parts))

    def _store(self, placed: DataFrame, version: int) -> None:
        spread = placed.repartitionByRange("part", "bucket", "id").sortWithinPartitions("part", "bucket")
        spread.write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/ids/version={version}")

    def _store_digests(self, digests: DataFrame, version: int) -> None:
        digests.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/digests/version={version}")


def _placed(rows: DataFrame, compound: str) -> DataFrame:
    part = F.floor(F.col("bucket") * PARTS / DIGEST_BUCKETS).cast("int")
    return digest_ids(rows, compound).withColumn("part", part)
