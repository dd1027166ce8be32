"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

The words of all texts are shared out by weight; a source is clamped at ``max_epochs`` times its
words and what it cannot take goes to the others by weight, until none is above. A source's texts are then
taken ``floor(target / words)`` times, and once more up to a place in a seeded order of its texts, which
makes the words taken meet the target to within one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occurra.llm.common import WORD
from occurra.session import cut_lineage

MAX_EPOCHS = 3
SEED = 17
#: The seeded order is a 60-bit number; its first 12 bits divide a source into pieces of equal chance.
KEY_BITS, PIECE_BITS = 60, 12


def _key(seed: int):
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"))), 1, 15), 16, 10).cast("long")


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """``doc_id, source, size, key``: words per text (NULL: 0) and its place in the seeded order."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long"), F.lit(0)).alias("size"),
        _key(seed).alias("key"),
    )


def repeating_weights(sources: DataFrame, *weights: int) -> DataFrame:
    """``source, weight``: sources by code point, NULL last, take the given weights in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    place = (F.row_number().over(order) - 1) % len(weights)
    return sources.select("source", F.get(turn, place.cast("int")).alias("weight"))


def water_fill(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, weight, source_size`` -> plus ``target``; shares 100 % of the words of all sources.

    Every round is one aggregate of the source table. The level only rises, so clamped sources stay
    clamped and the loop ends when no new one is. Sources of weight 0 take nothing.
    """
    cap = max_epochs * F.col("source_size")
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    level, clamped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > cap
        state = sources.agg(
            F.sum(F.when(over, cap)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"),
            F.count_if(over).alias("over"),
        ).first()
        if state["over"] == clamped or not state["free"]:
            break
        clamped = state["over"]
        level = (float(total) - float(state["fixed"] or 0)) / float(state["free"])
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, whole, cut``: whole repeats of a source, and the last key that is taken once more.

    Pieces of the order are summed per source first, so the running sum goes over at most 4096 sums per
    source and over the texts of one piece, however large the source.
    """
    shift = KEY_BITS - PIECE_BITS
    piece = F.shiftright("key", shift)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = targets.withColumn("whole", epochs.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    sums = sized.groupBy("source", piece.alias("piece")).agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("piece"))
    by_source = plan.select(F.col("source").alias("s"), "rest")
    at = (
        sums.withColumn("upto", upto)
        .join(by_source, F.col("source").eqNullSafe(F.col("s")))
        .filter("upto > rest")
        .groupBy("source")
        .agg(F.min(F.struct("piece", (F.col("upto") - F.col("words")).alias("before"), "rest")).alias("at"))
        .select(F.col("source").alias("s"), F.col("at.piece").alias("p"), F.col("at.before").alias("before"), F.col("at.rest").alias("rest"))
    )
    inside = sized.join(at, F.col("source").eqNullSafe(F.col("s")) & (piece == F.col("p")))
    sofar = F.sum("size").over(
        Window.partitionBy("source", "p").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    last = (
        inside.withColumn("middle", F.col("before") + sofar - F.col("size") / 2)
        .filter("middle <= rest")
        .groupBy("source")
        .agg(F.max("key").alias("key"))
        .select(F.col("source").alias("k"), "key")
    )
    placed = at.join(last, F.col("s").eqNullSafe(F.col("k")), "left").select(
        "s", F.coalesce("key", F.shiftleft("p", shift) - 1).alias("upto")
    )
    # no piece reaches above the rest: the whole source is taken once more
    return plan.join(placed, F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "source_size", "target", "whole",
        F.when(F.col("rest") > 0, F.coalesce("upto", F.lit((1 << KEY_BITS) - 1))).otherwise(-1).alias("cut"),
    )


def plan_mix(sized: DataFrame, weights: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, target, whole, cut`` of stored ``sizes``; small: one row per source."""
    own = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    given = weights.select(F.col("source").alias("s"), F.col("weight").cast("double").alias("weight"))
    sources = cut_lineage(
        own.join(given, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", F.coalesce("weight", F.lit(0.0)).alias("weight"), "source_size"
        ),
        "sources",
    )
    return cut_lineage(cuts(sized, water_fill(sources, max_epochs)), "mix")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, repeats`` per row of ``docs``.

    ``weights``: ``source, weight`` (a source that is not listed takes nothing); without it sources weigh 1, 2, 3 in turn. ``taken``
    is ``size * repeats``. NULL is a source like any other; texts without a word take nothing. Rows with
    equal ids share their place in the order. A source without words has target 0.
    """
    sized = cut_lineage(sizes(docs, seed), "sizes")
    if weights is None:
        weights = repeating_weights(sized.select("source").distinct(), 1, 2, 3)
    mix = plan_mix(sized, weights, max_epochs).withColumnRenamed("source", "s")
    repeats = F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)
    return sized.join(mix, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), "source", repeats.alias("repeats")
    )


def mixed(docs: DataFrame, weights: DataFrame | None = None, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` that the mix takes, unchanged, with ``repeats`` (1 or more). Texts are not shuffled for it
    as long as the source table is small enough to be sent to them."""
    sized = cut_lineage(sizes(docs, seed), "sizes")
    if weights is None:
        weights = repeating_weights(sized.select("source").distinct(), 1, 2, 3)
    mix = plan_mix(sized, weights, max_epochs).select(F.col("source").alias("_s"), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"))
    repeats = F.col("_whole") + F.when(_key(seed) <= F.col("_cut"), 1).otherwise(0)
    return (
        docs.join(mix, F.col("source").cast("string").eqNullSafe(F.col("_s")))
        .withColumn("repeats", repeats.cast("int"))
        .filter("repeats > 0")
        .select(*[F.col(f"`{c}`") for c in docs.columns if c != "repeats"], "repeats")
    )


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5(concat_ws(':', '17', CAST(doc_id AS varchar))), 1, 15) AS bigint) AS key
  FROM documents),
sources AS (
  SELECT source, source_size, 1.0::double + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM (SELECT source, CAST(sum(size) AS bigint) AS source_size FROM sized GROUP BY source)),
ranked AS (
  SELECT *, CAST(sum(source_size) OVER () AS double) AS total,
    coalesce(sum(3 * source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources),
level AS (
  SELECT coalesce(max((total - CAST(fixed AS double)) / free), 0) AS l
  FROM ranked),
targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS double), weight * l) AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(least(CAST(3 * source_size AS double), weight * l) / source_size) AS bigint) ELSE 0 END AS whole
  FROM sources, level),
ordered AS (
  SELECT z.*, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
    sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id ROWS UNBOUNDED PRECEDING) - z.size / 2.0::double AS middle
  FROM sized z JOIN targets t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS bigint) AS size, source_size, target,
  CAST(size * (whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END) AS bigint) AS taken, source,
  whole + CASE WHEN rest > 0 AND middle <= rest THEN 1 ELSE 0 END AS repeats
FROM ordered"""
