"""K9: one search, from criteria to rows, counters, hashes and metadata."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from occurra.functions import text as tx
from occurra.model import BIOTA, Criteria, Graph
from occurra.operators import filters, stats
from occurra.operators.counting import counters
from occurra.operators.occurrences import Occurrences, compound_table, result_rows
from occurra.operators.requests import criteria_table, query_hash
from occurra.operators.resolve import rank_matches
from occurra.operators.similarity import similar, substructure_screen
from occurra.operators.skew import attach
from occurra.operators.structures import SIMILARITY
from occurra.session import counted_stage, cut_lineage, one_row


class TaxonNotFound(LookupError):
    """No taxon carries the requested name."""


@dataclass(frozen=True)
class TaxonChoice:
    """``qid`` is None without a taxon, ``*`` for all taxa."""

    qid: str | None
    warning: str | None = None


def resolve_taxon(spark: SparkSession, graph: Graph, taxon: str) -> TaxonChoice:
    """H26, then a name lookup: E1 picks the match and E2 tells whether it is ambiguous. One row reaches the driver."""
    row = (
        one_row(spark, raw=taxon)
        .select(
            tx.taxon_input(F.col("raw")).alias("kind"),
            tx.clean(F.col("raw")).alias("given"),
            tx.sanitize_taxon(F.col("raw")).alias("name"),
        )
        .first()
    )
    if row["kind"] != "lookup":
        return TaxonChoice(row["kind"])
    hits = graph.taxon_names.filter(F.col("name") == row["name"]).select(
        F.lit(row["name"]).alias("input"), F.col("t").alias("qid"), "name", F.length("t").alias("pos")
    )
    best = rank_matches(hits).first()
    if best is None:
        raise TaxonNotFound(row["given"])
    if best["ambiguous"]:
        shown = ", ".join(best["candidates"])
        return TaxonChoice(best["qid"], f"ambiguous taxon, using {best['name']} ({best['qid']}); candidates: {shown}")
    if row["name"] != taxon:
        return TaxonChoice(best["qid"], f"taxon standardised from '{taxon}' to '{row['name']}'")
    return TaxonChoice(best["qid"])


def is_similarity(criteria: Criteria) -> bool:
    """A multi-line structure is always a substructure search."""
    return criteria.search_type == SIMILARITY and not any(mark in criteria.smiles.strip() for mark in "\r\n")


def structure_hits(occ: Occurrences, criteria: Criteria, query_bits: list[int], n_bits: int) -> DataFrame:
    """The distinct compounds a structure search finds, through the stored index where there is one."""
    index, prints = occ.structures, occ.graph.fingerprints
    if is_similarity(criteria):
        hits = index.similar(query_bits, criteria.threshold) if index else similar(prints, query_bits, criteria.threshold, n_bits)
    elif index and query_bits:
        hits = index.screen(query_bits)
    else:
        hits = substructure_screen(prints, query_bits, n_bits)
    return hits.select("c").distinct()


def enriched_matches(
    occ: Occurrences,
    criteria: Criteria,
    qid: str | None,
    query_bits: list[int] | None = None,
    n_bits: int = 64,
) -> DataFrame:
    """All matching rows with every property, filters applied.

    Mass and formula filters act on the compound table and a clade on the taxon
    names before the statements are touched. Both reduced sides are stored and
    counted: the smaller cuts the statements first, and a side of small real size is
    broadcast, so that a selective search does not shuffle the statements. The
    properties of the compounds are joined last.
    """
    g = occ.graph
    structure = bool(criteria.smiles.strip())
    if structure and query_bits is None:
        raise ValueError("a structure search needs the bits of its query structure")
    if structure and qid == "*":
        qid = BIOTA
    clade = None if qid in (None, "*") else occ.descendants(qid)

    base = g.compound_ids
    if structure:
        base = base.join(structure_hits(occ, criteria, query_bits, n_bits), "c", "left_semi")
    compounds = compound_table(g, base)
    compounds = filters.filter_mass(compounds, criteria.mass_min, criteria.mass_max)
    compounds = filters.filter_formula(compounds, criteria)

    n_compounds = n_names = None
    if structure or criteria.mass_active or criteria.formula_active:
        compounds, n_compounds = counted_stage(compounds, "compounds")
    if structure and clade is None:
        rows = any_taxon(occ, compounds)
    else:
        names = occ.clade_names(clade)
        if clade is not None:
            names, n_names = counted_stage(names, "names")
        first = n_compounds is not None and (n_names is None or n_compounds <= n_names)
        rows = occ.enriched(compounds, names, selected=None if n_compounds is None else compounds, compounds_first=first)
    return filters.filter_year(rows, criteria.year_min, criteria.year_max)


def any_taxon(occ: Occurrences, compounds: DataFrame) -> DataFrame:
    """C14: compounds with their occurrence block, or alone without one.

    ``compounds`` are the stored hits. Their statements, found once and stored, give
    both the rows and the compounds that occur; the others are added alone.
    """
    core = cut_lineage(occ.core(compounds=compounds.select("c").distinct(), compounds_first=True), "hits")
    found = attach(occ.with_references(core), [(compounds, "inner")], "c", occ.heavy.of("c"), F.col("statement"))
    alone = compounds.join(core.select("c").distinct(), "c", "left_anti")
    return found.unionByName(alone, allowMissingColumns=True)


#: Key columns that no matching row lacks: its compound is known by a join.
COMPOUND = (stats.ENTRY_KEY[0],)
ENTRY_ORDER = (*stats.ENTRY_KEY, "statement", "mass", "name", "ref_title", "ref_doi", "pub_year", "smiles")


def search_counters(occ: Occurrences, criteria: Criteria, qid: str | None, query_bits: list[int] | None = None, n_bits: int = 64) -> DataFrame | None:
    """D1 of a search without its rows; None for structures without a taxon, whose compounds may occur nowhere."""
    g = occ.graph
    structure = bool(criteria.smiles.strip())
    if structure and qid is None:
        return None
    if structure and qid == "*":
        qid = BIOTA
    clade = None if qid in (None, "*") else cut_lineage(occ.descendants(qid).select("t"), "clade")
    compounds = g.compound_ids.select("c")
    if structure:
        compounds = compounds.join(structure_hits(occ, criteria, query_bits, n_bits), "c", "left_semi")
    if criteria.mass_active:
        compounds = compounds.join(g.mass.withColumnRenamed("v", "mass"), "c")
        compounds = filters.filter_mass(compounds, criteria.mass_min, criteria.mass_max)
    if criteria.formula_active:
        compounds = filters.filter_formula(compounds.join(g.formula_raw.withColumnRenamed("v", "formula_raw"), "c"), criteria)
    dates = filters.filter_year(g.ref_date, criteria.year_min, criteria.year_max, "v") if criteria.year_active else None
    return counters(occ, compounds, clade, dates)


@dataclass
class SearchResult:
    """One search; each part is planned when asked for.

    Counters are multiplied out without the rows, unless these are stored.
    """

    criteria: Criteria
    taxon: TaxonChoice
    occ: Occurrences
    limit: int | None = None
    query_bits: list[int] | None = None
    n_bits: int = 64

    @cached_property
    def matches(self) -> DataFrame:
        """Every matching row, enriched (RDF export)."""
        return enriched_matches(self.occ, self.criteria, self.taxon.qid, self.query_bits, self.n_bits)

    @cached_property
    def all_rows(self) -> DataFrame:
        """Every matching row as RESULT_ROW (other exports)."""
        return result_rows(self.matches)

    @cached_property
    def counted(self) -> DataFrame | None:
        """D1 over all rows without them, where that can be."""
        return search_counters(self.occ, self.criteria, self.taxon.qid, self.query_bits, self.n_bits)

    def store(self) -> "SearchResult":
        """Run the search once: rows, counters, hashes and exports then read its stored rows."""
        self.matches = cut_lineage(self.matches, "matches")
        self.all_rows, self.counted = result_rows(self.matches), None
        return self

    def persist(self) -> "SearchResult":
        """Keep the matching rows while rows, counters and hashes are read."""
        self.all_rows.persist()
        return self

    def unpersist(self) -> None:
        self.all_rows.unpersist()

    @cached_property
    def rows(self) -> DataFrame:
        """Deduplicated, in order, cut to the limit (display)."""
        return stats.capped_rows(self.all_rows, [F.col(c).asc_nulls_first() for c in ENTRY_ORDER], self.limit, present=COMPOUND)

    @cached_property
    def stats(self) -> DataFrame:
        """Counters over all rows, with ``n_returned`` and ``capped``."""
        counted = self.counted
        return stats.with_cap(stats.dataset_stats(self.all_rows) if counted is None else counted, self.limit)

    @cached_property
    def query_hash(self) -> DataFrame:
        spark = self.occ.graph.statements.sparkSession
        return query_hash(criteria_table(spark, self.criteria, self.taxon.qid)).select("query_hash")

    @cached_property
    def result_hash(self) -> DataFrame:
        """Of the displayed rows."""
        return stats.result_hash(self.rows)

    @cached_property
    def result_digest(self) -> DataFrame:
        """Of all matching rows, cut or not."""
        return stats.result_digest(self.all_rows)


def search(
    spark: SparkSession,
    graph: Graph | Occurrences,
    criteria: Criteria,
    query_bits: list[int] | None = None,
    limit: int | None = None,
    n_bits: int = 64,
) -> SearchResult:
    occ = graph if isinstance(graph, Occurrences) else Occurrences(graph)
    choice = resolve_taxon(spark, occ.graph, criteria.taxon)
    if criteria.smiles.strip() and query_bits is None:
        raise ValueError("a structure search needs the bits of its query structure")
    return SearchResult(criteria, choice, occ, limit, query_bits, n_bits)
