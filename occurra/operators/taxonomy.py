"""Transitive taxonomy: the clade below one or several taxa.

Without an index a clade is found by path doubling: a few levels one by one, then rounds that each follow paths four
times as long as the round before, so that a lineage of depth ``d`` takes about ``log4(d)`` of them. A stored index holds
all pairs of an ancestor and a descendant, laid out by ancestor; a clade is then a pruned scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from occurra.operators.skew import by_rows
from occurra.session import counted_stage, one_row, scratch_path

#: Levels walked one by one before paths are doubled: most clades asked for are shallow.
WALKED_LEVELS = 3
#: Folders of a stored index.
INDEX_BUCKETS = 64
#: A lineage table of more pairs than this per edge is not worth storing; such a taxonomy is searched by doubling.
MOST_PAIRS_PER_EDGE = 256


class ClosureTooDeep(RuntimeError):
    """The taxonomy did not converge within the allowed number of levels."""


def _links(edges: DataFrame) -> DataFrame:
    """Distinct ``(child, parent)`` without loops, which no closure needs."""
    return edges.select("child", "parent").filter("child <> parent").distinct()


def _step(reached: DataFrame, hops: DataFrame) -> DataFrame:
    """``(root, t)`` one hop below ``reached``."""
    return reached.join(hops, reached["t"] == hops["parent"]).select("root", F.col("child").alias("t"))


def _chained(hops: DataFrame) -> DataFrame:
    """Hops twice as long; every child has one."""
    upper = hops.select(F.col("child").alias("_via"), F.col("parent").alias("_top"))
    return hops.join(upper, hops["parent"] == upper["_via"]).select("child", F.col("_top").alias("parent"))


class _Rounds:
    """Stored tables of one closure: every round is one write of new members and, beside them, of longer hops."""

    def __init__(self, spark: SparkSession, folder: str, members: str):
        self.spark, self.folder, self.members, self.sizes = spark, folder, members, []

    @property
    def number(self) -> int:
        return len(self.sizes)

    def store(self, members: DataFrame, hops: DataFrame | None = None) -> tuple[int, int]:
        """Number of members and hops written."""
        rows = members.select(F.lit("member").alias("kind"), F.col("root").alias("a"), F.col("t").alias("b"))
        if hops is not None:
            rows = rows.unionByName(hops.select(F.lit("hop").alias("kind"), F.col("parent").alias("a"), F.col("child").alias("b")))
        seen = Observation()
        counted = rows.observe(seen, F.count_if(F.col("kind") == "member").alias("members"), F.count_if(F.col("kind") == "hop").alias("hops"))
        counted.write.partitionBy("kind").parquet(f"{self.folder}/round={self.number:06d}")
        self.sizes.append(seen.get["members"])
        return seen.get["members"], seen.get["hops"]

    def _read(self, path: str, kind: str) -> DataFrame:
        return self.spark.read.schema(f"a {self.members}, b {self.members}, kind string").option("basePath", path).parquet(path).filter(F.col("kind") == kind)

    def members_since(self, first: int = 0) -> DataFrame:
        """Members of round ``first`` and later ones, from one scan."""
        paths = [f"{self.folder}/round={n:06d}/kind=member" for n in range(first, self.number) if self.sizes[n]]
        if not paths:
            return self.members_of(first)
        return self.spark.read.schema(f"a {self.members}, b {self.members}").parquet(*paths).select(F.col("a").alias("root"), F.col("b").alias("t"))

    def members_of(self, number: int) -> DataFrame:
        return self._read(f"{self.folder}/round={number:06d}", "member").select(F.col("a").alias("root"), F.col("b").alias("t"))

    def last_hops(self) -> DataFrame:
        return self._read(f"{self.folder}/round={self.number - 1:06d}", "hop").select(F.col("b").alias("child"), F.col("a").alias("parent"))


def descendants_of_each(edges: DataFrame, roots: DataFrame, max_levels: int | None = None, walked: int = WALKED_LEVELS) -> DataFrame:
    """C3 for many taxa at once: distinct ``(root, t)``, every root in its own clade.

    ``roots`` has a column ``root``. Several parents and cycles are fine. After the first levels every taxon's smallest
    parent makes a forest, in which hops of ``m`` edges, one a taxon, double by a join with themselves: with all members
    less than ``a`` levels below those a pass starts from, and hops of ``m <= a`` edges, a round adds the members less than
    ``a + 3 m`` levels below and stores hops of ``4 m`` edges. The pass ends when a round brings nothing new or no
    lineage is so long. Then the other edges are followed once, and a new pass starts from what they brought, if
    anything. ``max_levels`` is for callers who want to fail on deeper ones. Each round is a table in the shared folder:
    lineage stays flat, lost executors cost nothing, the planner knows real sizes.
    """
    spark = edges.sparkSession
    links = _links(edges)
    kind = dict(links.dtypes)["child"]
    rounds = _Rounds(spark, scratch_path(spark, "closure"), kind)
    start = roots.select(F.col("root").cast(kind).alias("root")).distinct()
    if not rounds.store(start.select("root", F.col("root").alias("t")))[0]:
        return rounds.members_since()

    def new(found: DataFrame) -> DataFrame:
        return found.distinct().join(by_rows(rounds.members_since(), sum(rounds.sizes)), ["root", "t"], "left_anti")

    for level in range(1, (walked if max_levels is None else max_levels + 1) + 1):
        if not rounds.store(new(_step(by_rows(rounds.members_of(rounds.number - 1), rounds.sizes[-1]), links)))[0]:
            return rounds.members_since()
        if max_levels is not None and level > max_levels:
            raise ClosureTooDeep(f"more than {max_levels} taxonomy levels")
    forest = links.groupBy("child").agg(F.min("parent").alias("parent"))
    lengths = [forest.count()]
    hops, since = [by_rows(forest, lengths[0])], 0
    others = links.join(hops[0], ["child", "parent"], "left_anti")
    while True:
        at = 0
        while True:
            known = by_rows(rounds.members_since(since), sum(rounds.sizes[since:]))
            twice = by_rows(_chained(hops[at]), lengths[at])
            once = _step(known, hops[at])
            found = once.unionByName(_step(known.unionByName(once), twice))
            longer = _chained(twice) if len(hops) == at + 1 else None
            n_new, n_hops = rounds.store(new(found), longer)
            if longer is not None:
                lengths.append(n_hops)
                hops.append(by_rows(rounds.last_hops(), n_hops) if n_hops else None)
            at += 1
            if not n_new or hops[at] is None:
                break
        since = rounds.number
        if not rounds.store(new(_step(by_rows(rounds.members_since(), sum(rounds.sizes)), others)))[0]:
            return rounds.members_since()


def descendants(edges: DataFrame, root: str | DataFrame, max_levels: int | None = None) -> DataFrame:
    """Reflexive-transitive closure as a set ``(t)``; ``root`` is an id or a table ``(t)`` of them."""
    single = isinstance(root, str)
    roots = one_row(edges.sparkSession, root=root) if single else root.select(F.col("t").alias("root"))
    found = descendants_of_each(edges, roots, max_levels).select("t")
    return found if single else found.distinct()


# ---- stored lineages ---------------------------------------------------------


def _bucket(ancestor: Column) -> Column:
    return F.pmod(F.xxhash64(ancestor), F.lit(INDEX_BUCKETS)).cast("int")


def write_clades(edges: DataFrame, folder: str, most_pairs_per_edge: int = MOST_PAIRS_PER_EDGE) -> bool:
    """All distinct pairs ``(root, t)`` of an ancestor and a taxon below it, laid out by ancestor; False, and nothing
    stored, where they are more than ``most_pairs_per_edge`` times the edges.

    Pairs up to ``m`` levels apart joined with themselves are those up to ``2 m`` apart.
    """
    links, n_links = counted_stage(_links(edges), "links")
    pairs, n_pairs = links.select(F.col("parent").alias("root"), F.col("child").alias("t")), n_links
    while n_pairs:
        if n_pairs > most_pairs_per_edge * n_links:
            return False
        below = pairs.select(F.col("root").alias("_via"), F.col("t").alias("_below"))
        longer = pairs.join(below, pairs["t"] == below["_via"]).select("root", F.col("_below").alias("t"))
        pairs, n_now = counted_stage(pairs.unionByName(longer).filter("root <> t").distinct(), "lineages")
        if n_now == n_pairs:
            break
        n_pairs = n_now
    laid_out = pairs.withColumn("bucket", _bucket(F.col("root"))).repartitionByRange("bucket", "root", "t").sortWithinPartitions("bucket", "root")
    laid_out.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    return True


@dataclass(frozen=True)
class CladeIndex:
    """Lineages written by ``write_clades``; a taxon is in its own clade, whether the index knows it or not."""

    spark: SparkSession
    folder: str

    @property
    def pairs(self) -> DataFrame:
        return self.spark.read.schema("root string, t string, bucket int").parquet(self.folder)

    def descendants(self, root: str) -> DataFrame:
        """``(t)``: one pruned scan."""
        bucket = one_row(self.spark, root=root).select(_bucket(F.col("root"))).first()[0]
        below = self.pairs.filter((F.col("bucket") == bucket) & (F.col("root") == root)).select("t")
        return below.unionByName(one_row(self.spark, t=root))

    def descendants_of_each(self, roots: DataFrame) -> DataFrame:
        """``(root, t)`` for a table ``(root)``: only folders of asked ancestors are read."""
        asked = roots.select("root").distinct().withColumn("bucket", _bucket(F.col("root")))
        buckets = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # at most INDEX_BUCKETS
        below = self.pairs.filter(F.col("bucket").isin(buckets)).join(asked, ["bucket", "root"]).select("root", "t")
        return below.unionByName(asked.select("root", F.col("root").alias("t")))
