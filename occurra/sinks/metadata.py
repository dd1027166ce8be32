"""Dataset description of one search as schema.org JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.model import ELEMENT_CEILINGS, Criteria

# Public vocabulary, licence and result formats.
CONTEXT = "https://schema.org/"
LICENSE = "https://creativecommons.org/publicdomain/zero/1.0/"
FORMATS = ("text/csv", "application/sparql-results+json", "text/turtle")
VARIABLES = (
    "compound_name",
    "compound_smiles",
    "compound_inchikey",
    "compound_mass",
    "molecular_formula",
    "taxon_name",
    "reference_title",
    "reference_doi",
    "reference_date",
    "compound_qid",
    "taxon_qid",
    "reference_qid",
)
ELEMENT_NAMES = {"C": "carbon", "H": "hydrogen", "N": "nitrogen", "O": "oxygen", "P": "phosphorus", "S": "sulfur"}
HALOGEN_NAMES = {"F": "fluorine", "Cl": "chlorine", "Br": "bromine", "I": "iodine"}


def search_filters(criteria: Criteria) -> dict:
    """Active filters only, nested by kind."""
    out: dict = {}
    if criteria.smiles.strip():
        out["chemical_structure"] = {"smiles": criteria.smiles, "search_type": criteria.search_type}
        if criteria.search_type == "similarity":
            out["chemical_structure"]["similarity_threshold"] = criteria.threshold
    if criteria.mass_active:
        out["mass"] = {"min": criteria.mass_min, "max": criteria.mass_max}
    if criteria.year_active:
        out["publication_year"] = {"start": criteria.year_min, "end": criteria.year_max}
    if criteria.formula_active:
        formula: dict = {}
        if criteria.formula_exact.strip():
            formula["exact_formula"] = criteria.formula_exact.strip()
        for symbol in ELEMENT_CEILINGS:
            if symbol in criteria.active_elements:
                low, high = criteria.active_elements[symbol]
                formula[ELEMENT_NAMES[symbol]] = {"min": low, "max": high}
        if criteria.active_halogens:
            formula["halogens"] = {HALOGEN_NAMES[s]: v for s, v in criteria.active_halogens.items()}
        out["molecular_formula"] = formula
    return out


def structure_query(criteria: Criteria) -> dict | None:
    if not criteria.smiles.strip():
        return None
    multiline = any(mark in criteria.smiles for mark in "\r\n")
    query = {
        "search_type": criteria.search_type,
        "input_format": "molfile" if multiline else "smiles",
    }
    if criteria.search_type == "similarity":
        query["similarity_threshold"] = criteria.threshold
    if multiline:
        query["query_length"] = len(criteria.smiles.encode())
    query["query_text"] = criteria.smiles
    return query


def _column(value) -> Column:
    """A plain value as a column: dict to struct, list to array."""
    if isinstance(value, Column):
        return value
    if isinstance(value, dict):
        return F.struct(*[_column(v).alias(k) for k, v in value.items() if v is not None])
    if isinstance(value, (list, tuple)):
        return F.array(*[_column(v) for v in value])
    return F.lit(value)


def dataset_metadata(
    stats: DataFrame,
    criteria: Criteria,
    qid: str | None,
    query_hash: str,
    result_hash: str,
    created: str,
    title: str = "Occurrence data",
) -> DataFrame:
    """One row, ``metadata`` JSON over the one-row counters.

    The block on the structure service appears only in a structure search.
    """
    given = criteria.taxon.strip()
    taxon = "all taxa" if qid == "*" or (qid is None and not given) else (given or qid)
    filters = search_filters(criteria)
    structure = structure_query(criteria)
    kind = criteria.search_type if structure else None
    name = f"{title} — {kind.capitalize()} search in {taxon}" if kind else f"{title} — {taxon}"
    described = f"Chemical compounds from {taxon}." + (f" Found by {kind} search." if kind else "")
    document = {
        "@context": CONTEXT,
        "@type": "Dataset",
        "name": name,
        "description": described,
        "dateCreated": created,
        "license": LICENSE,
        "distribution": [
            {"@type": "DataDownload", "encodingFormat": f, "contentUrl": f"data:{f}"} for f in FORMATS
        ],
        "numberOfRecords": F.col("n_entries"),
        "variablesMeasured": list(VARIABLES),
        "search_parameters": {
            "taxon": taxon,
            "taxon_qid": qid if qid != "*" else None,
            "structure_query": structure,
            "filters": filters or None,
        },
        "chemical_search_service": {"name": "fingerprint search", "kind": kind} if kind else None,
        "provenance": {
            "query_hash": {"algorithm": "SHA-256", "value": query_hash},
            "result_hash": {"algorithm": "SHA-256", "value": result_hash},
            "dataset_uri": f"urn:hash:sha256:{result_hash}",
        },
    }
    return stats.select(F.to_json(_column(document)).alias("metadata"))
