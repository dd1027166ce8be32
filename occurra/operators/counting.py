"""Counters of a search without its rows: multiplicities multiplied along the joins.

A statement gives one result row for every combination of the values that its compound, taxon and reference have. How
many these are is counted per key of every property table; the statements then need only these numbers, and no
label, title, name or DOI is read or moved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.operators.occurrences import LABEL_LANGUAGES, Occurrences
from occurra.operators.skew import attach


def _several(table: DataFrame, key: str, name: str) -> DataFrame:
    """Keys with more than one value; any other has a factor of 1 in a left join."""
    return table.groupBy(key).agg(F.count(F.lit(1)).alias(name)).filter(F.col(name) > 1)


def _times(keys: DataFrame, key: str, start: str, tables: list[DataFrame]) -> DataFrame:
    """``(key, start)`` with ``start`` multiplied by the number of values in every table."""
    names = [f"_n{i}" for i in range(len(tables))]
    joined = reduce(lambda df, part: df.join(part, key, "left"), [_several(t, key, n) for t, n in zip(tables, names, strict=True)], keys)
    product = reduce(lambda a, b: a * b, [F.coalesce(n, F.lit(1)) for n in names], F.col(start))
    return joined.select(key, product.alias(start))


def compound_factors(occ: Occurrences, facts: DataFrame) -> DataFrame:
    """``(c, n_c)``: rows of the compound table per compound, given its rows ``facts`` joined with what a filter needs.

    ``facts`` has a row per identifier and value of the tables that it was joined with, named in ``facts.columns``.
    """
    g = occ.graph
    labels = [g.labels.filter(F.col("lang") == lang) for lang in LABEL_LANGUAGES]
    joined = {"mass": g.mass, "formula_raw": g.formula_raw}
    rest = [t for name, t in joined.items() if name not in facts.columns] + [g.smiles_iso, *labels]
    return _times(facts.groupBy("c").agg(F.count(F.lit(1)).alias("n_c")), "c", "n_c", rest)


def counters(occ: Occurrences, compounds: DataFrame | None = None, clade: DataFrame | None = None, dates: DataFrame | None = None) -> DataFrame:
    """D1 in one row: ``n_entries, n_entries_unique, n_compounds, n_taxa, n_references`` of the rows of a search.

    ``compounds`` are the rows of ``compound_ids`` that pass, joined with the tables their filters needed; ``clade`` is a set
    ``(t)``; ``dates`` are the rows of ``ref_date`` that pass a bound on the year, without which no reference is required.
    Statements shrink to distinct triples with their multiplicity before they meet the factors.
    """
    g = occ.graph
    taxa = g.taxon_names.groupBy("t").agg(F.count(F.lit(1)).alias("n_t"))
    taxa = taxa if clade is None else taxa.join(clade.select("t").distinct(), "t", "left_semi")
    factors = compound_factors(occ, g.compound_ids.select("c") if compounds is None else compounds)
    spread = F.xxhash64("c", "t", "r")
    facts, sides = g.statements.select("c", "t", "r").withColumn("n", F.lit(1).cast("bigint")), [(factors, "c"), (taxa, "t")]
    if clade is not None:
        # the clade cuts most statements off before they are grouped
        facts, sides = attach(facts, [(taxa, "inner")], "t", occ.heavy.of("t"), spread).withColumn("n", F.col("n_t")).drop("n_t"), sides[:1]
    triples = facts.groupBy("c", "t", "r").agg(F.sum("n").alias("n"))
    for side, key in sides:
        triples = attach(triples, [(side, "inner")], key, occ.heavy.of(key), spread)
    if clade is not None:
        triples = triples.withColumn("n_t", F.lit(1))
    if dates is None:
        known = [_several(t, "r", n) for t, n in ((g.ref_date, "n_d"), (g.ref_title, "n_title"), (g.ref_doi, "n_doi"))]
        triples = attach(triples, [(k, "left") for k in known], "r", occ.heavy.of("r"), spread)
    else:
        passing = dates.groupBy("r").agg(F.count(F.lit(1)).alias("n_d"))
        known = [_several(t, "r", n) for t, n in ((g.ref_title, "n_title"), (g.ref_doi, "n_doi"))]
        triples = attach(triples, [(passing, "inner"), *[(k, "left") for k in known]], "r", occ.heavy.of("r"), spread)
    factor = reduce(lambda a, b: a * b, [F.coalesce(n, F.lit(1)) for n in ("n_t", "n_c", "n_d", "n_title", "n_doi")], F.col("n"))
    return triples.agg(
        F.coalesce(F.sum(factor), F.lit(0)).cast("bigint").alias("n_entries"),
        F.count(F.lit(1)).alias("n_entries_unique"),
        F.count_distinct("c").alias("n_compounds"),
        F.count_distinct("t").alias("n_taxa"),
        F.count_distinct("r").alias("n_references"),
    )
