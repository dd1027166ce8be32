"""Counters, hashes and capped views of result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.operators.skew import keep_first
from occurra.session import counted_stage, cut_lineage

ENTRY_KEY = ("compound_qid", "taxon_qid", "reference_qid")
COUNTERS = ("n_entries", "n_entries_unique", "n_compounds", "n_taxa", "n_references")
DIGEST_BUCKETS = 16384
TOP_K_ROWS = 20_000  # up to here a top-k; every task hands that many rows to one
CUT_RANGES = 2048


def dataset_stats(df: DataFrame, compound="compound_qid", taxon="taxon_qid", reference="reference_qid") -> DataFrame:
    """Five counters in one row.

    Rows first shrink to distinct triples with their multiplicity (combined
    before the shuffle); the distinct counts expand that smaller set only.
    """
    blank = F.lit("")
    triples = df.groupBy(
        F.col(compound).alias("c"),
        F.coalesce(F.col(taxon), blank).alias("t"),
        F.coalesce(F.col(reference), blank).alias("r"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return triples.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_entries"),
        F.count(F.lit(1)).alias("n_entries_unique"),
        F.count_distinct("c").alias("n_compounds"),
        F.count_distinct(F.nullif(F.col("t"), blank)).alias("n_taxa"),
        F.count_distinct(F.nullif(F.col("r"), blank)).alias("n_references"),
    )


def dedup_entries(df: DataFrame, order: list[Column], present: tuple[str, ...] = ()) -> DataFrame:
    """The earliest row per (compound, taxon, reference); absent ids count as blank.

    ``present`` names ids that are never absent. They are taken as they are, so that rows which are laid out by
    one of them already are not shuffled again.
    """
    blanked = {f"_k{i}": F.coalesce(F.col(c), F.lit("")) for i, c in enumerate(ENTRY_KEY) if c not in present}
    keys = [c for c in ENTRY_KEY if c in present] + list(blanked)
    return keep_first(df.withColumns(blanked), keys, order).drop(*blanked)


def row_limit(n: int | None) -> int | None:
    """At least one row; None is no limit. ``ROW_LIMIT_DEFAULT`` and ``ROW_LIMIT_CEILING`` are for callers who want them."""
    return None if n is None else max(1, n)


def limit_rows(df: DataFrame, n: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """at most ``n`` rows, all of them without ``n``; sorted when asked.

    A sorted limit of more than ``TOP_K_ROWS`` is cut by range: no task gathers it.
    """
    n = row_limit(n)
    if n is None:
        return df.orderBy(*order) if order else df
    if order and n > TOP_K_ROWS:
        stored, n_rows = counted_stage(df, "rows")
        return first_rows(stored, order, n, n_rows).orderBy(*order)
    return (df.orderBy(*order) if order else df).limit(n)


def first_rows(df: DataFrame, order: list[Column], n: int, n_rows: int) -> DataFrame:
    """Exactly the first ``n`` of the ``n_rows`` rows of a stored table, for large ``n``.

    Rows are laid out by range; whole ranges below the cut are kept as they
    are and only the one range the cut falls into is sorted. The driver sees
    one count per range.
    """
    return df if n_rows <= n else slice_rows(df, order, 0, n)


def slice_rows(df: DataFrame, order: list[Column], start: int, end: int) -> DataFrame:
    """Rows ``start`` to ``end`` of the order, unsorted, for large ``end``: a range that one of them cuts is sorted,
    ranges between are taken as they are."""
    spread = df.repartitionByRange(CUT_RANGES, *order).withColumn("_range", F.spark_partition_id())
    ranged = cut_lineage(spread, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).orderBy("_range").collect()
    below, whole, parts = 0, [], []
    for number, size in ((r["_range"], r["n"]) for r in sizes):
        first, past = max(start - below, 0), min(end - below, size)
        if first < past:
            if (first, past) == (0, size):
                whole.append(number)
            else:
                parts.append(ranged.filter(F.col("_range") == number).orderBy(*order).limit(past).offset(first))
        below += size
    lo, hi = (whole[0], whole[-1]) if whole else (0, -1)
    taken = ranged.filter(F.col("_range").between(lo, hi))
    for part in parts:
        taken = taken.unionByName(part)
    return taken.drop("_range")


def capped_rows(df: DataFrame, order: list[Column], cap: int | None = None, present: tuple[str, ...] = ()) -> DataFrame:
    """D3, rows: deduplicated entries in order, cut to the cap if there is one.

    A short list is a top-k. For a long one the entries are stored once, which
    also counts them; mostly they are fewer than the cap and nothing is cut.
    """
    entries, cap = dedup_entries(df, order, present), row_limit(cap)
    if cap is None:
        return entries.orderBy(*order)
    if cap <= TOP_K_ROWS:
        return entries.orderBy(*order).limit(cap)
    stored, n_rows = counted_stage(entries, "entries")
    return first_rows(stored, order, cap, n_rows).orderBy(*order)


def capped_stats(df: DataFrame, cap: int | None = None) -> DataFrame:
    """D3 and D10, counters: over all rows, plus whether the cap cuts them."""
    return with_cap(dataset_stats(df), cap)


def with_cap(counted: DataFrame, cap: int | None = None) -> DataFrame:
    """``n_returned`` and ``capped`` beside counters over all rows."""
    cap = row_limit(cap)
    every = F.col("n_entries_unique")
    shown = every if cap is None else F.least(every, F.lit(cap).cast("bigint"))
    return (
        counted
        .withColumn("n_returned", shown)
        .withColumn("capped", F.col("n_entries_unique") > F.col("n_returned"))
    )


def is_capped(total: Column | None, returned: Column, limit: int) -> Column:
    """With a total, more rows than returned; without, the limit was reached."""
    return total > returned if total is not None else returned >= limit


def stats_from_rows(rows: DataFrame) -> DataFrame:
    """The same counters over the displayed rows only."""
    return dataset_stats(rows)


def result_hash(rows: DataFrame, compound: str = "compound_qid") -> DataFrame:
    """SHA-256 of the sorted distinct compound ids joined by ``|``.

    The ids meet in one text, so this is for row sets that were cut to a limit.
    ``result_digest`` takes row sets of any size.
    """
    ids = rows.select(F.col(compound).alias("id")).filter(F.col("id").isNotNull()).distinct()
    joined = F.expr("listagg(id, '|') WITHIN GROUP (ORDER BY id)")
    return ids.agg(F.sha2(F.coalesce(joined, F.lit("")).cast("binary"), 256).alias("result_hash"))


def result_digest(df: DataFrame, compound: str = "compound_qid", buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """D5 for row sets of any size: SHA-256 over the digests of id buckets.

    Ids fall into a fixed number of buckets by their own SHA-256, so no group
    depends on one key and the last step joins at most ``buckets`` digests.
    """
    return whole_digest(bucket_digests(digest_ids(df, compound, buckets)))


def digest_ids(df: DataFrame, compound: str = "compound_qid", buckets: int = DIGEST_BUCKETS) -> DataFrame:
    """Distinct ``(id, bucket)``."""
    ids = df.select(F.col(compound).alias("id")).filter(F.col("id").isNotNull()).distinct()
    prefix = F.conv(F.substr(F.sha2(F.col("id"), 256), F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    return ids.withColumn("bucket", prefix % buckets)


def bucket_digests(ids: DataFrame) -> DataFrame:
    """``(bucket, digest)`` over the sorted ids of every bucket that has some."""
    return ids.groupBy("bucket").agg(F.expr("sha2(listagg(id, '|') WITHIN GROUP (ORDER BY id), 256)").alias("digest"))


def whole_digest(parts: DataFrame) -> DataFrame:
    whole = F.expr("listagg(digest, '|') WITHIN GROUP (ORDER BY bucket)")
    return parts.agg(F.sha2(F.coalesce(whole, F.lit("")).cast("binary"), 256).alias("result_digest"))
