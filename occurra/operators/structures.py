"""A stored inverted index of fingerprints: which compounds hold a bit, rarest bits first.

Postings are ``(bit, size, c, w0..wk)``, laid out by bit and, within a bit, by the number of bits of the compound.
A screen reads the postings of the rarest bit asked for, a similarity search those of the few rarest bits one of which
every hit must hold; either leaves out row groups of other sizes. Both check on the words that come with a posting.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occurra.operators.similarity import literal_words, n_words, pack, tanimoto
from occurra.operators.skew import by_rows

SUBSTRUCTURE, SIMILARITY = "substructure", "similarity"
#: Size bands of the batch join: each is wider than the one before by this factor.
BAND = 1.25
#: Blocks a side of the grid in which queries meet all compounds when their postings would be longer.
GRID = 16


def write_index(fingerprints: DataFrame, folder: str, n_bits: int) -> None:
    """Postings by bit and the number of compounds of every bit.

    A bit that most compounds hold is laid out over several tasks, by size. Fingerprints without a bit have no postings;
    no search but that for nothing finds them.
    """
    words = [f"w{i}" for i in range(n_words(n_bits))]
    prints = fingerprints
    if "w0" not in fingerprints.columns:
        prints = fingerprints.select("c", "bits", *[pack(F.col("bits"), i).alias(w) for i, w in enumerate(words)], F.size("bits").alias("size"))
    postings = prints.select(F.explode(F.array_distinct("bits")).alias("bit"), "size", "c", *words)
    laid_out = postings.repartitionByRange("bit", "size", "c").sortWithinPartitions("bit", "size")
    laid_out.write.mode("overwrite").partitionBy("bit").parquet(f"{folder}/postings")
    spark = fingerprints.sparkSession
    stored = spark.read.schema(f"size int, c string, {', '.join(f'{w} long' for w in words)}, bit int").parquet(f"{folder}/postings")
    stored.groupBy("bit").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/bits")


@dataclass(frozen=True)
class FingerprintIndex:
    spark: SparkSession
    folder: str
    n_bits: int

    @cached_property
    def postings(self) -> DataFrame:
        words = ", ".join(f"w{i} long" for i in range(n_words(self.n_bits)))
        return self.spark.read.schema(f"size int, c string, {words}, bit int").parquet(f"{self.folder}/postings")

    @cached_property
    def frequency(self) -> dict[int, int]:
        """Compounds per bit: at most ``n_bits`` numbers."""
        return {r["bit"]: r["n"] for r in self.spark.read.parquet(f"{self.folder}/bits").collect()}

    @cached_property
    def first_postings(self) -> DataFrame:
        """One posting of every fingerprint, that of its lowest bit."""
        lowest = F.lit(True)
        for i in range(n_words(self.n_bits)):
            at = F.col("bit") - 64 * i
            below = F.when(at >= 64, F.lit(-1).cast("bigint")).when(at > 0, F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), at.cast("int"))))
            lowest &= F.coalesce(F.col(f"w{i}").bitwiseAND(below) == 0, F.lit(True))
        return self.postings.filter(lowest)

    @cached_property
    def counted(self) -> tuple[int, int]:
        """Number of fingerprints and of their compounds."""
        return tuple(self.first_postings.agg(F.count(F.lit(1)), F.count_distinct("c")).first())

    def _rarest(self, bits: list[int], n: int) -> list[int]:
        return sorted(set(bits), key=lambda b: (self.frequency.get(b, 0), b))[:n]

    def screen(self, bits: list[int]) -> DataFrame:
        """C17: ``(c)`` of the compounds with every bit asked for, out of the postings of the rarest one."""
        if not bits:
            raise ValueError("a structure without bits is no search")
        rows = self.postings.filter((F.col("bit") == self._rarest(bits, 1)[0]) & (F.col("size") >= len(set(bits))))
        for i, word in enumerate(literal_words(bits, self.n_bits)):
            if word:
                rows = rows.filter(F.col(f"w{i}").bitwiseAND(F.lit(word)) == F.lit(word))
        return rows.select("c")

    def similar(self, bits: list[int], threshold: float) -> DataFrame:
        """``(c, similarity)`` at or above the threshold.

        A hit shares at least ``ceil(threshold * size)`` bits, hence one of the ``size - that + 1`` rarest; it is taken
        from the postings of the rarest of those that it holds.
        """
        size = len(set(bits))
        if not size:
            return self.postings.limit(0).select("c", F.lit(0.0).alias("similarity"))
        chosen = self._rarest(bits, size - ceil(threshold * size - 1e-9) + 1)
        rows = self.postings.filter(F.col("bit").isin(chosen) & F.col("size").between(threshold * size - 1e-9, size / threshold + 1e-9))
        common = sum_of([F.bit_count(F.col(f"w{i}").bitwiseAND(F.lit(w))) for i, w in enumerate(literal_words(bits, self.n_bits))])
        # no bit that is rarer than the posting's own
        first = F.lit(False)
        for k, bit in enumerate(chosen):
            rarer = [(i, w) for i, w in enumerate(literal_words(chosen[:k], self.n_bits)) if w]
            first |= reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.lit(w)) == 0 for i, w in rarer], F.col("bit") == bit)
        return rows.filter(first).withColumn("similarity", tanimoto(common, F.col("size"), F.lit(size))).filter(F.col("similarity") >= threshold).select("c", "similarity")

    def batch(self, queries: DataFrame, key: str = "key") -> DataFrame:
        """``(key, c, similarity)`` for a table of queries ``(key, bits, kind, threshold)``, all in one join.

        ``kind`` is ``SUBSTRUCTURE`` or ``SIMILARITY``; similarity is NULL for the former. Queries meet the postings on
        (bit, size band), a pair at the rarest bit of the query's chosen ones that the compound holds. A query whose chosen
        postings are more than there are fingerprints meets each of these once instead, on (cell of a grid, size band). Queries
        without bits find nothing. A pair comes once for every query of its key and fingerprint of its compound.
        """
        words = range(n_words(self.n_bits))
        ranks = {b: k for k, b in enumerate(self._rarest(list(range(self.n_bits)), self.n_bits))}
        rank = F.array(*[F.lit(ranks[b]) for b in range(self.n_bits)])
        by_rarity = F.array_sort(F.transform(F.array_distinct("bits"), lambda b: F.struct(F.get(rank, b).alias("r"), b.alias("b"))))
        asked = queries.filter("size(bits) > 0").select(
            F.col(key).alias("key"),
            (F.col("kind") == SUBSTRUCTURE).alias("screens"),
            F.col("threshold").cast("double").alias("threshold"),
            F.transform(by_rarity, lambda x: x["b"]).alias("bits"),
        )
        size = F.size("bits")
        asked = asked.select("*", size.alias("q_size"), *[pack(F.col("bits"), i).alias(f"q{i}") for i in words])
        share = F.col("threshold") * F.col("q_size")
        n_chosen = F.when(F.col("screens"), 1).otherwise(F.col("q_size") - F.ceil(share - 1e-9) + 1)
        low = F.when(F.col("screens"), F.col("q_size")).otherwise(F.greatest(F.ceil(share - 1e-9), F.lit(1)))
        high = F.when(F.col("screens"), self.n_bits).otherwise(F.least(F.floor(F.col("q_size") / F.col("threshold") + 1e-9), F.lit(self.n_bits)))
        asked = asked.select("*", low.cast("int").alias("low"), high.cast("int").alias("high"), n_chosen.cast("int").alias("n_chosen")).filter("low <= high")
        lengths = F.array(*[F.lit(self.frequency.get(b, 0)).cast("bigint") for b in range(self.n_bits)])
        chosen = F.slice("bits", 1, F.col("n_chosen"))
        read = F.aggregate(chosen, F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(F.get(lengths, b), F.lit(0).cast("bigint")))
        asked = asked.withColumn("dense", F.coalesce(~F.col("screens") & (read > self.counted[0]), F.lit(False)))
        probes = asked.filter("NOT dense").select("*", F.posexplode(chosen).alias("place", "bit"))
        earlier = F.when(F.col("place") > 0, F.slice("bits", 1, F.greatest(F.col("place"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
        probes = probes.select("*", *[pack(earlier, i).alias(f"e{i}") for i in words]).drop("place")
        # cells of the grid are numbered below the bits; a query is in the cells of its row, a compound in those of its column
        row, column = (F.pmod(F.xxhash64(c), F.lit(GRID)).cast("int") for c in ("key", "c"))
        across = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda j: -1 - row * GRID - j)
        whole = asked.filter("dense").select("*", F.explode(across).alias("bit"), *[F.lit(0).cast("bigint").alias(f"e{i}") for i in words])
        probes = probes.unionByName(whole).withColumn("band", F.explode(F.sequence(_band(F.col("low")), _band(F.col("high"))))).drop("bits", "n_chosen", "dense")

        # at most n_bits and the cells of the grid
        used = {r["bit"]: r["n"] for r in probes.filter("bit IS NOT NULL").groupBy("bit").agg(F.count(F.lit(1)).alias("n")).collect()}
        lists = self.postings.filter(F.col("bit").isin([b for b in used if b >= 0]))
        if min(used, default=0) < 0:
            down = F.transform(F.sequence(F.lit(0), F.lit(GRID - 1)), lambda i: -1 - i * GRID - column)
            lists = lists.unionByName(self.first_postings.withColumn("bit", F.explode(down)))
        lists = lists.withColumn("band", _band(F.col("size")))
        common = sum_of([F.bit_count(F.col(f"w{i}").bitwiseAND(F.col(f"q{i}"))) for i in words])
        score = tanimoto(common, F.col("size"), F.col("q_size"))
        holds = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"q{i}")) == F.col(f"q{i}") for i in words])
        first = reduce(lambda a, b: a & b, [F.col(f"w{i}").bitwiseAND(F.col(f"e{i}")) == 0 for i in words])
        met = F.col("size").between(F.col("low"), F.col("high")) & first & F.when(F.col("screens"), holds).otherwise(score >= F.col("threshold"))
        # pairs are many more than the rows they come from: partitions of few bytes are not to be put together
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        p, q = (side.repartition(parts, "bit", "band").alias(name) for side, name in ((lists, "p"), (by_rows(probes, sum(used.values())), "q")))
        return p.join(q, (F.col("p.bit") == F.col("q.bit")) & (F.col("p.band") == F.col("q.band")) & met).select(
            F.col("key").alias(key), "c", F.when(~F.col("screens"), score).alias("similarity")
        )


def _band(size: Column) -> Column:
    """Band of a number of bits, which is one at least."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(BAND))).cast("int")


def sum_of(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)
