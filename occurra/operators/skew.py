"""Joins that stay balanced when one key holds a large share of the rows.

``heavy_keys`` names the keys above a fixed share of a table in one pass with
the built-in heavy-hitter sketch, so at most ``1 / HEAVY_SHARE`` keys exist and
the list is small whatever the table size. ``attach`` splits just those keys:
their rows get one of ``n`` salts and the matching dimension rows are repeated
``n`` times. All other keys take the plain join.

A table whose scan is small needs no profile: any of its groups fits a task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_SHARE = 1 / 400
SKETCH_ITEMS = 8192
PROFILE_MIN_BYTES = 512 * 1024 * 1024
ROWS_PER_SALT = 1_000_000
#: Rows of one side that a join may send to every task. The planner goes by compressed sizes, of which the table that the
#: driver builds may be sixty times as large; rows that were counted say more.
BROADCAST_ROWS = 100_000

SALT = "_salt"


@dataclass(frozen=True)
class SkewPolicy:
    min_bytes: int = PROFILE_MIN_BYTES
    rows_per_salt: int = ROWS_PER_SALT
    share: float = HEAVY_SHARE


DEFAULT_POLICY = SkewPolicy()


@dataclass(frozen=True)
class HeavyKeys:
    """Per column: key -> number of salts."""

    salts: dict[str, dict[str, int]] = field(default_factory=dict)

    def of(self, column: str) -> dict[str, int]:
        return self.salts.get(column, {})


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's own size estimate; file sizes for a plain scan.

    A session without access to the plan counts every table as large.
    """
    if not hasattr(df, "_jdf"):
        return 1 << 62
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcasts(df: DataFrame) -> bool:
    """Whether the planner takes ``df`` for small enough to send it to every task of a join."""
    if not hasattr(df, "_jdf"):
        return False
    return estimated_bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def by_rows(side: DataFrame, rows: int) -> DataFrame:
    """A side of a join that has ``rows`` rows: not broadcast, whatever its compressed size, where these are many."""
    return side if rows <= BROADCAST_ROWS else side.hint("merge")


def heavy_keys(
    df: DataFrame, columns: list[str], policy: SkewPolicy = DEFAULT_POLICY, rows: int | None = None
) -> HeavyKeys:
    """Keys of ``columns`` (text) that hold at least ``policy.share`` of the rows.

    ``rows``, when the caller knows it, replaces the size estimate: a table of
    fewer rows than one salt takes has nothing to split.
    """
    small = estimated_bytes(df) < policy.min_bytes if rows is None else rows < policy.rows_per_salt
    if small:
        return HeavyKeys()
    top = int(1 / policy.share)
    profile = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.expr(f"approx_top_k(`{c}`, {top}, {SKETCH_ITEMS})").alias(c)
            for c in columns
        ],
    ).first()
    floor = max(profile["_n"] * policy.share, policy.rows_per_salt)
    salts = {
        c: {
            hit["item"]: -(-hit["count"] // policy.rows_per_salt)
            for hit in profile[c] or []
            if hit["item"] is not None and hit["count"] > floor
        }
        for c in columns
    }
    return HeavyKeys({c: found for c, found in salts.items() if found})


def attach(
    facts: DataFrame,
    dimensions: list[tuple[DataFrame, str]],
    key: str,
    heavy: dict[str, int] | None = None,
    spread_by: Column | None = None,
) -> DataFrame:
    """Join ``facts`` with ``(dimension, how)`` pairs on one key.

    All joins share one partitioning of the facts, hence one shuffle. Every
    ``how`` must keep the facts on the splittable side: inner, left,
    left_semi or left_anti. ``spread_by`` must be reproducible, so that a task
    run again gives the same salt; default is a hash of the whole row.
    """
    if not heavy:
        for dim, how in dimensions:
            facts = facts.join(dim, key, how)
        return facts

    spark = facts.sparkSession
    # at most 1 / share rows, so this broadcast has a fixed bound
    table = F.broadcast(spark.createDataFrame(list(heavy.items()), f"{key} string, _n int"))
    spread = F.xxhash64(*(facts.columns if spread_by is None else [spread_by]))
    salted = (
        facts.join(table, key, "left")
        .withColumn(SALT, F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(spread, F.col("_n"))).cast("int"))
        .drop("_n")
    )
    for dim, how in dimensions:
        copies = (
            dim.join(table, key, "left")
            .withColumn(SALT, F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1)))
            .drop("_n")
        )
        salted = salted.join(copies, [key, SALT], how)
    return salted.drop(SALT)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row per key. Each task keeps one row per key before the
    shuffle (window group limit), so a hot key sends one row per task."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") == 1).drop("_rank")
