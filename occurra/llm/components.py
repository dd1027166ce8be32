"""Connected components by contraction; every level is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.session import counted_stage, cut_lineage

#: Rows of a table of numbers that one task handles without strain.
ROWS_PER_TASK = 100_000


def fitted(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than about ``rows`` rows need: a small table is not written in hundreds of files."""
    return df.coalesce(rows // ROWS_PER_TASK + 1)


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """``links`` (a, b) of longs -> ``node, label``: the smallest node each one reaches.

    ``most``: number of links or more, if known.

    Each level points every node at the smallest of its neighbours and joins
    nodes with the same target, which at least halves the graph. Nothing is
    collected; a node with very many links is pre-aggregated and its join
    split at run time. NULLs and links of a node with itself are ignored.
    """
    first = (
        links.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    edges, left = counted_stage(first if most is None else fitted(first, most), "edges")
    levels = []
    while left:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(
            edges.select(F.col("b").alias("node"), F.col("a").alias("other"))
        )
        lowest = both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("parent"))
        parents = cut_lineage(fitted(lowest, 2 * left), "parents")
        levels.append((parents, left))
        of_a = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        of_b = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        joined = edges.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        met = joined.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges, left = counted_stage(fitted(met, left), "edges")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = levels.pop()[0].select("node", F.col("parent").alias("label"))
    while levels:
        above = labels.select(F.col("node").alias("parent"), "label")
        parents, size = levels.pop()
        resolved = parents.join(above, "parent", "left").select("node", F.coalesce("label", "parent").alias("label"))
        labels = cut_lineage(fitted(resolved, 2 * size), "labels")
    return labels


def joined_by(reached: DataFrame, links: DataFrame, n_links: int) -> DataFrame:
    """``reached`` (``node, label``, as ``components`` gives it) after ``n_links`` more links (a, b): only these are contracted.

    Their ends are taken to the labels reached so far; what these then reach is put in the labels' place.
    """

    def end(x: str) -> DataFrame:
        return reached.select(F.col("node").alias(x), F.col("label").alias(f"l{x}"))

    ends = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    between = cut_lineage(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a <> b"), "between")
    new = components(between, n_links)
    moved = new.select(F.col("node").alias("label"), F.col("label").alias("lower"))
    known = reached.join(moved, "label", "left").select("node", F.coalesce("lower", "label").alias("label"))
    return cut_lineage(known.unionAll(new.join(reached.select("node"), "node", "left_anti").select("node", "label")), "reached")
