"""Curation operators: known compounds, existing occurrences, edit statements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.functions import chemistry as ch
from occurra.functions import text as tx
from occurra.model import TAXON_CLASS, Graph
from occurra.operators.pairs import PairIndex
from occurra.operators.resolve import resolve_references, taxa_only
from occurra.operators.skew import DEFAULT_POLICY, HeavyKeys, SkewPolicy, attach, heavy_keys, keep_first
from occurra.session import cut_lineage

# Classes and properties of the edit statements, status names.
STEREOISOMER_GROUP = "Q59199015"
CHEMICAL_ENTITY = "Q113145171"
CHEMICAL_COMPOUND = "Q11173"
FOUND_IN = "P703"
NEW_TAXON = "[NEW_TAXON_QID]"
TAXON_STEP = "## -- Step: create missing taxon --"

COMPLETE = "existing_complete"
UPDATES = "existing_updates"
NEW = "new_compound"
PENDING = "pending_dependencies"
ERROR = "error"
UNIT = "\x1f"  # separates the ids of an occurrence key
STATUS_ORDER = (COMPLETE, UPDATES, NEW, PENDING, ERROR)

NOTES = {
    COMPLETE: "the compound is complete",
    UPDATES: "the compound lacks statements",
    NEW: "the compound is new",
    PENDING: "create the missing items first",
}


def _lines(*lines: Column) -> Column:
    """The lines that are not NULL, in order."""
    return F.array_compact(F.array(*[line.cast("string") for line in lines]))


def _quoted(subject: Column, prop: str, value: Column) -> Column:
    return F.concat(subject, F.lit(f'|{prop}|"'), tx.escape_quotes(value), F.lit('"'))


def match_compounds(inchikeys: DataFrame, graph: Graph) -> DataFrame:
    """``(inchikey)`` to one known compound with its five optional properties.

    The graph side shrinks to the wanted compounds, stored once, before its
    properties are read; of several values the smallest is taken.
    """
    wanted = inchikeys.select("inchikey").filter(F.col("inchikey").isNotNull()).distinct()
    ids = graph.compound_ids.join(wanted, "inchikey", "left_semi")
    order = [F.length("c").asc(), F.col("c").asc(), F.col("smiles_conn").asc()]
    found = cut_lineage(keep_first(ids, ["inchikey"], order), "known")

    def smallest(df: DataFrame, name: str) -> DataFrame:
        kept = df.join(found.select("c"), "c", "left_semi")
        return kept.groupBy("c").agg(F.min("v").alias(name))

    parts = [
        smallest(graph.smiles_iso, "known_iso"),
        smallest(graph.inchi, "known_inchi"),
        smallest(graph.formula_raw, "known_formula"),
        smallest(graph.mass, "known_mass"),
    ]
    joined = reduce(lambda a, b: a.join(b, "c", "left"), parts, found)
    return joined.select(
        "inchikey",
        F.col("c").alias("known_c"),
        F.col("smiles_conn").alias("known_canonical"),
        "known_iso",
        "known_inchi",
        "known_formula",
        "known_mass",
    )


def known_occurrences(pairs: DataFrame, statements: DataFrame | PairIndex) -> DataFrame:
    """Distinct ``(c, t, r)`` of the statements whose (c, t) is asked for.

    An index reads the buckets of the asked pairs. A table of statements is read once and not profiled: AQE
    broadcasts the asked pairs when they measure small, and splits a pair with very many statements
    when they do not. What is left is combined before the second shuffle.
    """
    asked = pairs.filter(F.col("c").isNotNull() & F.col("t").isNotNull()).select("c", "t").distinct()
    if isinstance(statements, PairIndex):
        return statements.of(asked)
    return statements.select("c", "t", "r").join(asked, ["c", "t"], "left_semi").distinct()


def occurrence_exists(pairs: DataFrame, statements: DataFrame | PairIndex) -> DataFrame:
    """Distinct ``(c, t)`` with ``exists``."""
    found = known_occurrences(pairs, statements).select("c", "t").distinct().withColumn("_hit", F.lit(True))
    return pairs.select("c", "t").distinct().join(found, ["c", "t"], "left").select(
        "c", "t", F.col("_hit").isNotNull().alias("exists")
    )


def occurrence_exists_ref(triples: DataFrame, statements: DataFrame | PairIndex) -> DataFrame:
    """C11: distinct ``(c, t, r)`` with ``exists``."""
    found = known_occurrences(triples, statements).withColumn("_hit", F.lit(True))
    return triples.select("c", "t", "r").distinct().join(found, ["c", "t", "r"], "left").select(
        "c", "t", "r", F.col("_hit").isNotNull().alias("exists")
    )


def occurrence_key(c: str = "c") -> Column:
    """Key of a pair, or of a triple when the reference is there."""
    return F.concat_ws(UNIT, c, "t", "r")


def occurrence_keys(found: DataFrame) -> DataFrame:
    """``(occurrence)``: the pair and the triple key of every known occurrence."""
    keys = F.array(F.concat_ws(UNIT, "c", "t"), occurrence_key())
    return found.select(F.explode(keys).alias("occurrence")).distinct()


def new_occurrences(candidates: DataFrame, statements: DataFrame | PairIndex) -> DataFrame:
    """Distinct ``(c, t, r)`` not in the graph; without a reference the pair decides."""
    asked = candidates.select("c", "t", "r").distinct()
    known = occurrence_keys(known_occurrences(asked, statements))
    return asked.withColumn("occurrence", occurrence_key()).join(known, "occurrence", "left_anti").drop("occurrence")


def creation_block(taxon: Column) -> Column:
    """Statements that create a missing taxon."""
    return F.concat_ws(
        "\n",
        F.lit(TAXON_STEP),
        F.lit("CREATE"),
        _quoted(F.lit("LAST"), "Len", taxon),
        F.lit(f"LAST|P31|{TAXON_CLASS}"),
        _quoted(F.lit("LAST"), "P225", taxon),
    )


def taxon_lookup(rows: DataFrame, taxa: DataFrame) -> DataFrame:
    """Distinct trimmed names ``(given, t)`` among ``taxa`` (``t, name``): C6, then C7, in one join.

    Per name the spellings tried are the first one of its key in the batch,
    the name as given and its canonical form; the earliest that hits wins, and
    within it the smallest id.
    """
    names = (
        rows.select("seq", tx.clean(F.col("taxon")).alias("given"))
        .filter(F.col("given").isNotNull())
        .groupBy("given")
        .agg(F.min("seq").alias("seq"))
        .withColumn("key", tx.taxon_key(F.col("given")))
    )
    first = names.groupBy("key").agg(F.min_by("given", "seq").alias("first"))
    spellings = F.array("first", "given", tx.canonical_taxon(F.col("given")))
    tried = names.join(first, "key").select("given", F.posexplode(F.array_distinct(spellings)).alias("pref", "name"))
    hits = tried.join(taxa, "name")
    best = F.min_by("t", F.struct("pref", F.length("t"), "t"))
    return hits.groupBy("given").agg(best.alias("t"))


def resolve_dependencies(rows: DataFrame, graph: Graph, heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    """K3: adds ``t``, ``r``, ``dependency_blocks`` and ``pending`` to candidate rows.

    Rows without a taxon have no dependencies at all, their DOI included.
    """
    keyed = rows.withColumns(
        {
            "given": tx.clean(F.col("taxon")),
            "doi_id": F.when(tx.clean(F.col("taxon")).isNotNull(), tx.doi_key(F.col("doi"))),
        }
    )
    by_name = taxon_lookup(keyed, taxa_only(graph.taxon_names, graph.instance_of))
    by_doi = resolve_references(keyed.select(F.col("doi_id").alias("doi")), graph.ref_doi).withColumnRenamed(
        "key", "doi_id"
    )
    keyed = attach(keyed, [(by_name, "left")], "given", heavy.of("given"), F.col("seq"))
    keyed = attach(keyed, [(by_doi, "left")], "doi_id", heavy.of("doi_id"), F.col("seq"))
    return with_dependencies(keyed)


def with_dependencies(rows: DataFrame) -> DataFrame:
    """``dependency_blocks`` and ``pending`` of rows with ``given``, ``doi_id``, ``t`` and ``r``."""
    has_taxon = F.col("given").isNotNull()
    no_taxon = has_taxon & F.col("t").isNull()
    no_reference = has_taxon & F.col("doi_id").isNotNull() & F.col("r").isNull()
    reference_lines = tx.clean(F.col("reference_lines")) if "reference_lines" in rows.columns else F.lit(None)
    return rows.withColumns(
        {
            "dependency_blocks": _lines(
                F.when(no_taxon, creation_block(F.col("taxon"))), F.when(no_reference, reference_lines)
            ),
            "pending": _lines(
                F.when(no_taxon, F.concat(F.lit("taxon not found: "), F.col("taxon"))),
                F.when(no_reference, F.concat(F.lit("reference not found: "), F.col("doi_id"))),
            ),
        }
    )


def missing_statements() -> Column:
    """K1: statements a known compound lacks, as an array; a column over matched rows."""
    c = F.col("known_c")
    formula = ch.formula_subscripts(ch.formula_from_inchi(F.col("inchi")))
    return _lines(
        F.when(F.col("known_canonical").isNull(), _quoted(c, "P233", F.col("canonical_smiles"))),
        F.when(F.col("known_inchi").isNull(), _quoted(c, "P234", F.col("inchi"))),
        F.when(F.col("known_formula").isNull(), _quoted(c, "P274", formula)),
        F.when(
            F.col("known_mass").isNull() & F.col("exact_mass").isNotNull(),
            tx.mass_statement(c, F.col("exact_mass")),
        ),
        F.when(
            ch.has_stereo(F.col("isomeric_smiles")) & F.col("known_iso").isNull(),
            _quoted(c, "P2017", F.col("isomeric_smiles")),
        ),
    )


def create_statements() -> Column:
    """K2: statements that create a compound, without its occurrence."""
    last = F.lit("LAST")
    formula = ch.formula_subscripts(ch.formula_from_inchi(F.col("inchi")))
    open_stereo = F.col("undefined_stereo") & ~ch.has_stereo(F.col("smiles"))
    return _lines(
        F.lit("CREATE"),
        _quoted(last, "Len", F.col("name")),
        F.lit('LAST|Den|"chemical compound"'),
        F.concat(F.lit("LAST|P31|"), F.when(open_stereo, STEREOISOMER_GROUP).otherwise(CHEMICAL_ENTITY)),
        F.lit(f"LAST|P279|{CHEMICAL_COMPOUND}"),
        _quoted(last, "P235", F.col("inchikey")),
        _quoted(last, "P233", F.col("canonical_smiles")),
        F.when(ch.has_stereo(F.col("isomeric_smiles")), _quoted(last, "P2017", F.col("isomeric_smiles"))),
        _quoted(last, "P234", F.col("inchi")),
        _quoted(last, "P274", formula),
        F.when(F.col("exact_mass").isNotNull(), tx.mass_statement(last, F.col("exact_mass"))),
    )


def occurrence_statement() -> Column:
    """K4: the occurrence statement of a row, NULL when none is due.

    Needs ``known_c, t, r, doi_id, given, occurs``.
    """
    t, r, doi = F.col("t"), F.col("r"), F.col("doi_id")
    subject = F.coalesce("known_c", F.lit("LAST"))
    head = F.concat(subject, F.lit(f"|{FOUND_IN}|"), t)
    known = F.col("known_c").isNotNull()
    due = ~known | ~F.col("occurs")
    return (
        F.when(F.col("given").isNull(), F.lit(None).cast("string"))
        .when(t.isNull(), F.when(~known, F.lit(f"LAST|{FOUND_IN}|{NEW_TAXON}")))
        .when(r.isNotNull(), F.when(due, F.concat(head, F.lit("|S248|"), r)))
        .when(doi.isNotNull(), F.lit(None).cast("string"))
        .otherwise(F.when(due, head))
    )


def curation_status(n_changes: Column) -> Column:
    """K5: error, pending, complete, updates or new."""
    return (
        F.when(F.col("conversion_error").isNotNull(), ERROR)
        .when(F.size("pending") > 0, PENDING)
        .when(F.col("known_c").isNull(), NEW)
        .when(n_changes == 0, COMPLETE)
        .otherwise(UPDATES)
    )


def curation_note(status: Column) -> Column:
    fixed = F.when(status == COMPLETE, NOTES[COMPLETE]).when(status == UPDATES, NOTES[UPDATES]).when(
        status == NEW, NOTES[NEW]
    )
    return (
        F.when(status == ERROR, F.col("conversion_error"))
        .when(status == PENDING, F.concat_ws("\n", F.lit(NOTES[PENDING]), F.array_join("pending", "\n")))
        .otherwise(fixed)
    )


def with_known_compounds(rows: DataFrame, graph: Graph, heavy: HeavyKeys = HeavyKeys()) -> DataFrame:
    known = match_compounds(rows, graph)
    return attach(rows, [(known, "left")], "inchikey", heavy.of("inchikey"), F.col("seq"))


def with_occurrence_flags(
    rows: DataFrame, statements: DataFrame | PairIndex, policy: SkewPolicy = DEFAULT_POLICY, n_rows: int = 0
) -> DataFrame:
    """``occurs`` for rows with ``known_c``, ``t`` and ``r``.

    With a reference the triple must be in the graph, without one the pair.
    The statements are read once: those of an asked pair give the keys of
    their pair and of their triple, and a row looks up the key it needs.
    ``rows`` is read twice and should be stored.
    """
    asked = F.col("known_c").isNotNull() & F.col("t").isNotNull()
    rows = rows.withColumn("occurrence", F.when(asked, occurrence_key("known_c")))
    pairs = rows.filter(asked).select(F.col("known_c").alias("c"), "t")
    found = occurrence_keys(known_occurrences(pairs, statements)).withColumn("_hit", F.lit(True))
    heavy = heavy_keys(rows, ["occurrence"], policy, n_rows).of("occurrence")
    flagged = attach(rows, [(found, "left")], "occurrence", heavy, F.col("seq"))
    return flagged.withColumn("occurs", F.col("_hit").isNotNull()).drop("_hit", "occurrence")


def status_counts(results: DataFrame) -> DataFrame:
    """Rows, pending rows and rows with dependencies per status, in fixed order."""
    rank = F.lit(len(STATUS_ORDER))
    for position, status in reversed(list(enumerate(STATUS_ORDER))):
        rank = F.when(F.col("status") == status, position).otherwise(rank)
    return (
        results.groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(F.size("dependency_blocks") > 0).alias("n_with_dependencies"),
        )
        .withColumn("position", rank)
        .orderBy("position")
    )


def pending_counts(results: DataFrame) -> DataFrame:
    """Rows pending after the first pass, rows still waiting after the second."""
    return results.agg(
        F.count_if(F.col("status") == PENDING).alias("pending"),
        F.count_if(F.size("dependency_blocks") > 0).alias("awaiting"),
    )


def bundle(results: DataFrame) -> DataFrame:
    """Sections ``(section, seq, pos, text)``; sort by these to read the text.

    Dependency blocks appear once, where they came first; the statements of
    each row follow without cross-row deduplication. Sections stay rows: the
    text of a large batch never meets in one place.
    """
    blocks = (
        results.select("seq", F.posexplode("dependency_blocks").alias("pos", "text"))
        .filter(tx.trim(F.col("text")) != "")
        .groupBy("text")
        .agg(F.min(F.struct("seq", "pos")).alias("at"))
        .select(F.lit("dependencies").alias("section"), "at.seq", "at.pos", "text")
    )
    main = results.filter(F.size("statements") > 0).select(
        F.lit("main").alias("section"), "seq", F.lit(0).alias("pos"), F.array_join("statements", "\n").alias("text")
    )
    return blocks.unionByName(main)
