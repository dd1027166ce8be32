"""Tables of the occurrence graph and the criteria of one search."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Fixed values of the data model (defaults and bounds of a search request).
DEFAULT_TAXON = "Gentiana lutea"
DEFAULT_SEARCH_TYPE = "substructure"
DEFAULT_THRESHOLD = 0.8
THRESHOLD_FLOOR, THRESHOLD_CEILING = 0.05, 1.0
MASS_FLOOR, MASS_CEILING = 0.0, 10000.0
YEAR_FLOOR = 1800
ELEMENT_CEILINGS = {"C": 512, "H": 1024, "N": 256, "O": 256, "P": 128, "S": 64}
HALOGENS = ("F", "Cl", "Br", "I")
ROW_LIMIT_DEFAULT = 500
ROW_LIMIT_CEILING = 2_000_000
BIOTA = "Q2382443"  # root taxon meant by "*" in a structure search
TAXON_CLASS = "Q16521"

RESULT_ROW = T.StructType(
    [
        T.StructField("compound_qid", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("inchikey", T.StringType()),
        T.StructField("smiles", T.StringType()),
        T.StructField("mass", T.DoubleType()),
        T.StructField("formula", T.StringType()),
        T.StructField("taxon_qid", T.StringType()),
        T.StructField("taxon_name", T.StringType()),
        T.StructField("reference_qid", T.StringType()),
        T.StructField("ref_title", T.StringType()),
        T.StructField("ref_doi", T.StringType()),
        T.StructField("pub_year", T.ShortType()),
        T.StructField("statement", T.StringType()),
    ]
)

CURATION_ROW = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("smiles", T.StringType()),
        T.StructField("taxon", T.StringType()),
        T.StructField("doi", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Criteria:
    """One search request; the tabular twin lives in ``operators.requests``.

    ``year_max`` None is no upper bound; a bound only cuts when it is given.
    """

    taxon: str = DEFAULT_TAXON
    smiles: str = ""
    search_type: str = DEFAULT_SEARCH_TYPE
    threshold: float = DEFAULT_THRESHOLD
    mass_min: float = MASS_FLOOR
    mass_max: float = MASS_CEILING
    year_min: int = YEAR_FLOOR
    year_max: int | None = None
    formula_enabled: bool = False
    formula_exact: str = ""
    elements: dict[str, tuple[int, int]] = field(default_factory=dict)
    halogens: dict[str, str] = field(default_factory=dict)

    @property
    def mass_active(self) -> bool:
        return self.mass_min > MASS_FLOOR or self.mass_max < MASS_CEILING

    @property
    def year_active(self) -> bool:
        return self.year_min > YEAR_FLOOR or self.year_max is not None

    @property
    def active_elements(self) -> dict[str, tuple[int, int]]:
        return {
            symbol: (lo, hi)
            for symbol, (lo, hi) in self.elements.items()
            if lo > 0 or hi < ELEMENT_CEILINGS[symbol]
        }

    @property
    def active_halogens(self) -> dict[str, str]:
        return {s: v for s, v in self.halogens.items() if v in ("required", "excluded")}

    @property
    def formula_active(self) -> bool:
        return self.formula_enabled and bool(
            self.formula_exact.strip() or self.active_elements or self.active_halogens
        )


@dataclass(frozen=True)
class Graph:
    """The property tables of one occurrence graph, one DataFrame per predicate.

    Single-property tables are ``(c | r, v)``; ``labels`` adds ``lang``.
    """

    compound_ids: DataFrame  # c, inchikey, smiles_conn
    statements: DataFrame  # statement, c, t, ref, r
    taxon_names: DataFrame  # t, name
    taxon_parent: DataFrame  # child, parent
    instance_of: DataFrame  # t (taxa only)
    smiles_iso: DataFrame  # c, v
    mass: DataFrame  # c, v
    formula_raw: DataFrame  # c, v
    inchi: DataFrame  # c, v
    labels: DataFrame  # c, v, lang
    ref_title: DataFrame  # r, v
    ref_doi: DataFrame  # r, v (as given; compared by ``doi_key``)
    ref_date: DataFrame  # r, v (timestamp)
    fingerprints: DataFrame  # c, bits ARRAY<INT>
