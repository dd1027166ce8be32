"""Compound - taxon - reference rows out of the graph tables.

Order of work: join the taxa first, which also applies the clade, then the
reference properties on one shared partitioning, then the compounds. The
properties of a compound are joined into one compound table beforehand, so the
large statement table is shuffled once per key and not once per property; this
widest table comes last, so that no shuffle carries it, and the rows stay laid out by compound.
A selection of compounds cuts the narrow statements beforehand.
Multi-valued properties fan out; nothing is pre-aggregated.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.functions import chemistry as ch
from occurra.functions import text as tx
from occurra.model import Graph
from occurra.operators.pairs import PairIndex
from occurra.operators.skew import DEFAULT_POLICY, HeavyKeys, SkewPolicy, attach, broadcasts, by_rows, heavy_keys
from occurra.operators.structures import FingerprintIndex
from occurra.operators.taxonomy import CladeIndex, descendants, descendants_of_each

# Label languages in order of preference.
LABEL_LANGUAGES = ("mul", "en")


@dataclass
class Occurrences:
    """A graph with the skew profile of its statement table (taken once) and, where they are stored, indexes of structures,
    clades and (compound, taxon) pairs."""

    graph: Graph
    policy: SkewPolicy = field(default=DEFAULT_POLICY)
    _heavy: HeavyKeys | None = None
    structures: FingerprintIndex | None = None
    clades: CladeIndex | None = None
    pairs: PairIndex | None = None

    @property
    def heavy(self) -> HeavyKeys:
        if self._heavy is None:
            self._heavy = heavy_keys(self.graph.statements, ["c", "t", "r"], self.policy)
        return self._heavy

    def descendants(self, root: str) -> DataFrame:
        return descendants(self.graph.taxon_parent, root) if self.clades is None else self.clades.descendants(root)

    def descendants_of_each(self, roots: DataFrame) -> DataFrame:
        return descendants_of_each(self.graph.taxon_parent, roots) if self.clades is None else self.clades.descendants_of_each(roots)

    def core(
        self,
        statements: DataFrame | None = None,
        compounds: DataFrame | None = None,
        clade: DataFrame | None = None,
        compounds_first: bool = False,
    ) -> DataFrame:
        """Statements with compound identifiers and taxon name, all mandatory.

        A clade (``t, taxon_name``, as ``clade_names`` gives it) takes the place of
        the taxon names, so that one join with the statements both filters them and
        names their taxon. The smaller of the two sides should come first.
        """
        facts = self.graph.statements if statements is None else statements
        dims = self.graph.compound_ids if compounds is None else compounds
        names = self.clade_names() if clade is None else clade
        sides = [(names, "t"), (dims, "c")]
        for dim, key in reversed(sides) if compounds_first else sides:
            facts = attach(facts, [(dim, "inner")], key, self.heavy.of(key), F.col("statement"))
        return facts

    def enriched(
        self,
        compounds: DataFrame,
        clade: DataFrame | None = None,
        statements: DataFrame | None = None,
        selected: DataFrame | None = None,
        compounds_first: bool = False,
    ) -> DataFrame:
        """Statements with taxon name, reference properties and the columns of ``compounds``, which are joined last.

        ``selected`` holds, in its column ``c``, the compounds of a selection: the statements of others are left out
        while they are narrow. It or the clade comes first, as in ``core``. Names of all taxa that the planner takes for small
        enough to broadcast come last, so that no shuffle carries them.
        """
        facts = self.graph.statements if statements is None else statements
        names = self.clade_names() if clade is None else clade
        last = clade is None and broadcasts(names)
        sides = [] if last else [(names, "t", "inner")]
        if selected is not None:
            sides.append((selected.select("c"), "c", "left_semi"))
        for dim, key, how in reversed(sides) if compounds_first else sides:
            facts = attach(facts, [(dim, how)], key, self.heavy.of(key), F.col("statement"))
        rows = attach(self.with_references(facts), [(compounds, "inner")], "c", self.heavy.of("c"), F.col("statement"))
        return rows.join(names, "t") if last else rows

    def clade_names(self, clade: DataFrame | None = None) -> DataFrame:
        """Names of the taxa of a clade, or of all taxa."""
        names = self.graph.taxon_names.withColumnRenamed("name", "taxon_name")
        return names if clade is None else names.join(clade.select("t"), "t", "left_semi")

    def in_clade(self, statements: DataFrame, clade: DataFrame | None) -> DataFrame:
        """C4: rows whose taxon is in the clade; None means no filter.

        The clade is not forced into a broadcast: AQE does that when its
        measured size allows.
        """
        if clade is None:
            return statements
        return attach(
            statements, [(clade.select("t"), "left_semi")], "t", self.heavy.of("t"), F.col("statement")
        )

    def with_references(self, facts: DataFrame) -> DataFrame:
        """Date, title and DOI by reference; the date first, a year filter cuts there."""
        g = self.graph
        dims = [
            (g.ref_date.withColumnRenamed("v", "ref_date"), "left"),
            (g.ref_title.withColumnRenamed("v", "ref_title"), "left"),
            (g.ref_doi.withColumnRenamed("v", "ref_doi"), "left"),
        ]
        return attach(facts, dims, "r", self.heavy.of("r"), F.col("statement"))


def pick_label(labels: DataFrame) -> DataFrame:
    """``(c, label, label_lang)`` — every `mul` label, else every `en` label."""
    mul, en = (
        labels.filter(F.col("lang") == lang).select("c", F.col("v").alias(lang)) for lang in LABEL_LANGUAGES
    )
    return mul.join(en, "c", "full").select(
        "c",
        F.coalesce("mul", "en").alias("label"),
        F.when(F.col("mul").isNotNull(), "mul").otherwise("en").alias("label_lang"),
    )


def compound_table(graph: Graph, base: DataFrame | None = None, selected: DataFrame | None = None, n_selected: int = 0) -> DataFrame:
    """Identifiers plus optional properties of every compound.

    ``selected`` holds, in its column ``c``, all compounds of ``base`` and ``n_selected`` rows: properties of others are
    left out before they are joined, so that no join sends a whole table of properties to every task.

    Mandatory identifiers on the left, so all joins keep their partitioning.
    Two filtered label scans instead of ``pick_label``: a full join would lose
    the shared partitioning.
    """
    ids = graph.compound_ids if base is None else base
    mul, en = (
        graph.labels.filter(F.col("lang") == lang).select("c", F.col("v").alias(f"_{lang}"))
        for lang in LABEL_LANGUAGES
    )

    def side(values: DataFrame) -> DataFrame:
        if selected is None:
            return values
        return by_rows(values.join(by_rows(selected.select("c"), n_selected), "c", "left_semi"), n_selected)

    return (
        ids.join(side(graph.mass.withColumnRenamed("v", "mass")), "c", "left")
        .join(side(graph.formula_raw.withColumnRenamed("v", "formula_raw")), "c", "left")
        .join(side(graph.smiles_iso.withColumnRenamed("v", "smiles_iso")), "c", "left")
        .join(side(mul), "c", "left")
        .join(side(en), "c", "left")
        .withColumn("label", F.coalesce("_mul", "_en"))
        .withColumn(
            "label_lang",
            F.when(F.col("_mul").isNotNull(), "mul").when(F.col("_en").isNotNull(), "en"),
        )
        .drop("_mul", "_en")
    )


def enrich(occ: Occurrences, statements: DataFrame | None = None) -> DataFrame:
    """Core rows plus every optional property."""
    return occ.enriched(compound_table(occ.graph), statements=statements)


def result_rows(enriched: DataFrame, *kept: str) -> DataFrame:
    """Enriched rows in the shape of RESULT_ROW, after the columns to keep beside it."""
    return enriched.select(
        *kept,
        F.col("c").alias("compound_qid"),
        F.col("label").alias("name"),
        "inchikey",
        F.coalesce("smiles_iso", "smiles_conn").alias("smiles"),
        "mass",
        ch.formula_digits(F.col("formula_raw")).alias("formula"),
        F.col("t").alias("taxon_qid"),
        "taxon_name",
        F.col("r").alias("reference_qid"),
        "ref_title",
        "ref_doi",
        F.year("ref_date").cast("smallint").alias("pub_year"),
        "statement",
    )


def project_result(enriched: DataFrame) -> DataFrame:
    """B2: the fifteen output columns with numeric identifiers."""
    return enriched.select(
        tx.entity_number(F.col("c")).alias("compound"),
        F.col("label").alias("compoundLabel"),
        F.col("inchikey").alias("compound_inchikey"),
        F.col("smiles_conn").alias("compound_smiles_conn"),
        F.col("smiles_iso").alias("compound_smiles_iso"),
        F.col("mass").alias("compound_mass"),
        ch.formula_digits(F.col("formula_raw")).alias("compound_formula"),
        tx.entity_number(F.col("t")).alias("taxon"),
        "taxon_name",
        tx.entity_number(F.col("r")).alias("ref_qid"),
        "ref",
        "ref_title",
        "ref_doi",
        F.date_format("ref_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ref_date"),
        "statement",
    )
