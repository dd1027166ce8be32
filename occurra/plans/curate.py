"""K6 to K8: curation of a whole table of candidates as one set-oriented job."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, replace
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.functions import chemistry as ch
from occurra.functions import text as tx
from occurra.model import Graph
from occurra.operators import curation as cu
from occurra.operators.merging import dedup_candidates, merge_passes, with_row_key
from occurra.operators.occurrences import Occurrences
from occurra.operators.pairs import PairIndex
from occurra.operators.resolve import resolve_references, taxa_only
from occurra.operators.skew import DEFAULT_POLICY, SkewPolicy, heavy_keys
from occurra.session import counted_stage, cut_lineage

CONVERTED = (
    "seq bigint, name string, smiles string, taxon string, doi string, "
    "canonical_smiles string, isomeric_smiles string, inchi string, inchikey string, "
    "exact_mass double, mass_warning string, undefined_stereo boolean, conversion_error string, "
    "reference_lines string"
)
INPUT_COLUMNS = tuple(part.split()[0] for part in CONVERTED.split(","))

Converter = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass(frozen=True)
class Curation:
    """``results`` is one row per distinct candidate, ``bundle`` its text sections, ``resolved`` the stored lookups behind them."""

    results: DataFrame
    bundle: DataFrame
    resolved: DataFrame | None = None


def guarded(converter: Converter) -> Converter:
    """A converter whose exception costs one row and not the job.

    A batch that fails is converted again row by row; a row that fails on its own
    carries the exception as ``conversion_error`` and has no other output.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                done = list(converter(iter([batch])))
            except Exception:
                done = [part for i in range(len(batch)) for part in one(batch.iloc[i : i + 1])]
            yield from done

    def one(row: pd.DataFrame) -> list[pd.DataFrame]:
        try:
            return list(converter(iter([row])))
        except Exception as error:
            failed = row.reindex(columns=INPUT_COLUMNS).astype(object).where(lambda df: df.notna(), None)
            failed["conversion_error"] = f"{type(error).__name__}: {error}"
            return [failed]

    return run


def convert(rows: DataFrame, converter: Converter) -> DataFrame:
    """K8: a user's structure converter over Arrow batches of candidates."""
    return rows.mapInPandas(guarded(converter), CONVERTED)


def prepare(rows: DataFrame, converter: Converter | None = None) -> tuple[DataFrame, int]:
    """Candidates reduced to the first row per key, stored once for all lookups."""
    firsts = dedup_candidates(rows)
    if converter is not None:
        firsts = with_row_key(convert(firsts.drop("key"), converter))
    return counted_stage(firsts, "candidates")


def resolve_rows(
    firsts: DataFrame, n_rows: int, graph: Graph | Occurrences, policy: SkewPolicy = DEFAULT_POLICY
) -> DataFrame:
    """Every lookup of the batch: compound, taxon, reference, existing occurrence."""
    graph, occurring = _parts(graph)
    keyed = firsts.select(
        "inchikey",
        tx.clean(F.col("taxon")).alias("given"),
        tx.doi_key(F.col("doi")).alias("doi_id"),
    )
    heavy = heavy_keys(keyed, ["inchikey", "given", "doi_id"], policy, n_rows)
    rows = cu.with_known_compounds(firsts, graph, heavy)
    rows = cut_lineage(cu.resolve_dependencies(rows, graph, heavy), "resolved")
    return cu.with_occurrence_flags(rows, occurring, policy, n_rows)


def _parts(graph: Graph | Occurrences) -> tuple[Graph, DataFrame | PairIndex]:
    """The graph, and where its occurrences are looked up: in the stored layout by pair if there is one."""
    if isinstance(graph, Occurrences):
        return graph.graph, graph.pairs or graph.graph.statements
    return graph, graph.statements


def result_table(resolved: DataFrame) -> DataFrame:
    """Statements, status and note of resolved rows; a bad row is flagged, not thrown."""
    failed = F.col("conversion_error").isNotNull()
    occurrence = F.array_compact(F.array(cu.occurrence_statement()))
    lines = F.concat(
        F.when(F.col("known_c").isNotNull(), cu.missing_statements()).otherwise(cu.create_statements()),
        occurrence,
    )
    empty = F.array_remove(F.array(F.lit("")), "")
    computed = ch.formula_subscripts(ch.formula_from_inchi(F.col("inchi")))
    rows = resolved.withColumn("_lines", F.when(failed, empty).otherwise(lines))
    rows = rows.withColumn("status", cu.curation_status(F.size("_lines")))

    def unless_failed(value):
        return F.when(~failed, value)

    return rows.select(
        "seq",
        "key",
        *[c for c in INPUT_COLUMNS if c != "seq" and c not in _DERIVED],
        *[unless_failed(F.col(c)).alias(c) for c in ("canonical_smiles", "inchikey", "inchi")],
        unless_failed(F.coalesce("known_formula", computed)).alias("formula"),
        unless_failed(F.coalesce("known_mass", "exact_mass")).alias("mass"),
        unless_failed(F.when(F.col("known_mass").isNull(), F.col("mass_warning"))).alias("mass_warning"),
        unless_failed(F.col("known_c")).alias("compound_qid"),
        "status",
        cu.curation_note(F.col("status")).alias("note"),
        F.when(failed, empty).otherwise(F.col("dependency_blocks")).alias("dependency_blocks"),
        F.col("_lines").alias("statements"),
    )


_DERIVED = ("canonical_smiles", "inchikey", "inchi", "mass_warning")


def curate(
    rows: DataFrame, graph: Graph | Occurrences, converter: Converter | None = None, policy: SkewPolicy = DEFAULT_POLICY
) -> Curation:
    """K6: candidates to results and edit statements. The lookups are stored; results are columns over them."""
    firsts, n_rows = prepare(rows, converter)
    resolved = cut_lineage(resolve_rows(firsts, n_rows, graph, policy), "flagged")
    results = result_table(resolved)
    return Curation(results, cu.bundle(results), resolved)


def second_pass_inputs(results: DataFrame) -> DataFrame:
    """K7: candidates that wait for other items, to be curated again."""
    return results.filter(F.size("dependency_blocks") > 0).select("seq", "name", "smiles", "taxon", "doi")


def apply_second_pass(previous: DataFrame, updated: DataFrame) -> Curation:
    """K7: updated rows merged into the earlier results."""
    merged = cut_lineage(merge_passes(previous, updated), "merged")
    return Curation(merged, cu.bundle(merged))


def second_pass(
    previous: DataFrame, converted: DataFrame, graph: Graph | Occurrences, policy: SkewPolicy = DEFAULT_POLICY
) -> Curation:
    """Waiting rows curated again against the whole grown graph, then merged; ``second_pass_added`` does with less.

    ``converted`` holds the candidates with their conversion outputs.
    """
    waiting = second_pass_inputs(previous).select("seq")
    again = converted.join(waiting, "seq", "left_semi")
    return apply_second_pass(previous, curate(again, graph, policy=policy).results)


def added_since(before: Graph, after: Graph) -> Graph:
    """The rows of every table that the grown graph has beyond the earlier one, by one anti join each.

    For tables that are not versioned; who knows what was added passes that.
    """

    def rows(name: str) -> DataFrame:
        old, new = getattr(before, name), getattr(after, name)
        return new.limit(0) if new is old else new.exceptAll(old.select(*new.columns))

    return Graph(**{f.name: rows(f.name) for f in fields(Graph)})


def second_pass_added(first: Curation, graph: Graph | Occurrences, added: Graph) -> Curation:
    """K7 as a delta: rows that wait meet only what was added since the first pass.

    What the first pass has found of a row stays, but for properties a known compound has got since; what it has not
    found is looked up among the added taxa, references and compounds. (``second_pass`` tries the first of several
    spellings among the waiting rows on all taxa again, and so may find one that the first pass did not try.) Only rows whose ids this completes ask for
    their occurrence in the whole graph, the other waiting rows in the added statements. ``graph`` is the grown graph.
    """
    grown, occurring = _parts(graph)
    waiting = first.resolved.filter(F.col("conversion_error").isNull() & (F.size("dependency_blocks") > 0))
    there = _filled(added)
    rows = waiting.drop("dependency_blocks", "pending").withColumns({"_c": F.col("known_c"), "_t": F.col("t"), "_r": F.col("r")})
    if there & {"taxon_names", "instance_of"}:
        taxa = taxa_only(added.taxon_names, grown.instance_of).unionByName(taxa_only(grown.taxon_names, added.instance_of)).distinct()
        found = cu.taxon_lookup(waiting.filter("t IS NULL"), taxa).withColumnRenamed("t", "_new_t")
        rows = rows.join(found, "given", "left").withColumn("t", F.coalesce("t", "_new_t")).drop("_new_t")
    if "ref_doi" in there:
        found = resolve_references(waiting.filter("r IS NULL").select(F.col("doi_id").alias("doi")), added.ref_doi)
        found = found.select(F.col("key").alias("doi_id"), F.col("r").alias("_new_r"))
        rows = rows.join(found, "doi_id", "left").withColumn("r", F.coalesce("r", "_new_r")).drop("_new_r")
    if "compound_ids" in there:
        found = cu.match_compounds(waiting.filter("known_c IS NULL"), replace(grown, compound_ids=added.compound_ids))
        names = [c for c in found.columns if c != "inchikey"]
        rows = rows.join(found.withColumnsRenamed({c: f"_new_{c}" for c in names}), "inchikey", "left")
        rows = rows.withColumns({c: F.coalesce(c, f"_new_{c}") for c in names}).drop(*[f"_new_{c}" for c in names])
    for table, column in (("smiles_iso", "known_iso"), ("inchi", "known_inchi"), ("formula_raw", "known_formula"), ("mass", "known_mass")):
        if table in there:
            found = getattr(added, table).groupBy(F.col("c").alias("known_c")).agg(F.min("v").alias("_new"))
            rows = rows.join(found, "known_c", "left").withColumn(column, F.least(column, "_new")).drop("_new")
    rows = cut_lineage(rows, "waiting")
    changed = ~(F.col("_c").eqNullSafe(F.col("known_c")) & F.col("_t").eqNullSafe(F.col("t")) & F.col("_r").eqNullSafe(F.col("r")))
    complete = F.col("known_c").isNotNull() & F.col("t").isNotNull()
    pairs = rows.filter(complete).select(F.col("known_c").alias("c"), "t", changed.alias("changed"))
    found = cu.known_occurrences(pairs.filter("changed"), occurring)
    if "statements" in there:
        found = found.unionByName(cu.known_occurrences(pairs.filter("NOT changed"), added.statements))
    hits = cu.occurrence_keys(found).withColumn("_hit", F.lit(True))
    keyed = rows.withColumn("occurrence", F.when(complete, cu.occurrence_key("known_c")))
    flagged = keyed.join(hits, "occurrence", "left").withColumn("occurs", F.col("_hit").isNotNull() | (F.col("occurs") & ~changed))
    updated = result_table(cu.with_dependencies(flagged.drop("_hit", "occurrence", "_c", "_t", "_r")))
    return apply_second_pass(first.results, updated)


def _filled(tables: Graph) -> set[str]:
    """Names of the tables that have a row, in one small job."""
    parts = [getattr(tables, f.name).limit(1).select(F.lit(f.name).alias("name")) for f in fields(Graph)]
    return {r["name"] for r in reduce(DataFrame.unionByName, parts).collect()}


def awaiting_second_pass(curation: Curation) -> bool:
    return not curation.bundle.filter(F.col("section") == "dependencies").isEmpty()
