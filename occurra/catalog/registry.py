"""The registry and SQL fragments shared by the reference statements."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from occurra.functions import text as tx
from occurra.session import tune

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Run
    sql: str | None
    ctes: dict[str, str] = field(default_factory=dict)


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None, ctes: dict[str, str] | None = None):
    """Register a query with its SQL (``{table}`` placeholders allowed)."""

    def add(run: Run) -> Run:
        def prepared(spark: SparkSession, folder: str) -> DataFrame:
            return run(tune(spark), folder)

        REGISTRY[name] = Entry(prepared, sql, ctes or {})
        return run

    return add


# ---- DuckDB expressions -------------------------------------------------

_W = "'" + tx.WHITESPACE + "'"


def s_trim(x: str) -> str:
    return f"trim({x}, {_W})"


def s_clean(x: str) -> str:
    return f"nullif({s_trim(x)}, '')"


def s_lower(x: str) -> str:
    return f"translate({x}, '{tx.UPPER}', '{tx.LOWER}')"


def s_upper(x: str) -> str:
    return f"translate({x}, '{tx.LOWER}', '{tx.UPPER}')"


def s_collapse(x: str) -> str:
    return s_trim(f"regexp_replace({x}, '[{tx.WHITESPACE}]+', ' ', 'g')")


def s_doi_key(x: str) -> str:
    return s_upper(rf"nullif(regexp_replace({s_trim(x)}, '(?is)^.*?doi\.org/', ''), '')")


def s_taxon_key(x: str) -> str:
    return s_lower(s_clean(x))


def s_row_key(smiles: str = "smiles", taxon: str = "taxon", doi: str = "doi") -> str:
    tab = "chr(9)"
    return (
        f"(coalesce({s_trim(smiles)}, '') || {tab} || coalesce({s_taxon_key(taxon)}, '') || {tab} || "
        f"coalesce({s_doi_key(doi)}, ''))"
    )


def s_sanitize(x: str) -> str:
    words = s_collapse(f"replace({x}, '_', ' ')")
    first = f"split_part({words}, ' ', 1)"
    return (
        f"CASE WHEN {words} = '' THEN replace({x}, '_', ' ') ELSE "
        f"upper(left({first}, 1)) || lower(substr({first}, 2)) || substr({words}, length({first}) + 1) END"
    )


def s_canonical(x: str) -> str:
    words = s_collapse(x)
    return f"({s_upper(f'left({words}, 1)')} || {s_lower(f'substr({words}, 2)')})"


def s_encode(x: str) -> str:
    return f"url_encode({x})"


def s_plain_number(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN cast(cast({x} AS bigint) AS varchar) ELSE cast({x} AS varchar) END"


def s_formula(x: str) -> str:
    return f"translate({x}, '₀₁₂₃₄₅₆₇₈₉', '0123456789')"


def s_tokens(x: str) -> str:
    return rf"regexp_replace({s_formula(f'''replace({x}, ' ', '')''')}, '([A-Z])', '|\1', 'g')"


def s_count(tokens: str, symbol: str) -> str:
    pattern = rf"\|{symbol}([0-9]*)(\||$)"
    digits = f"regexp_extract({tokens}, '^.*{pattern}', 1)"
    return (
        f"CASE WHEN NOT coalesce(regexp_matches({tokens}, '{pattern}'), false) THEN 0 "
        f"WHEN {digits} = '' THEN 1 ELSE try_cast({digits} AS int) END"
    )


def s_number(x: str) -> str:
    """Number of an id of the derived tables."""
    return f"cast(substr({x}, 2) AS bigint)"


def s_smallest(x: str) -> str:
    return f"'Q' || min({s_number(x)})"


# ---- shared reference tables -------------------------------------------

CORE = """
SELECT s.statement, s.c, s.t, s.ref, s.r, i.inchikey, i.smiles_conn, n.name AS taxon_name
FROM {statements} s JOIN {compound_ids} i ON s.c = i.c JOIN {taxon_names} n ON s.t = n.t"""

ENRICHED = """
SELECT k.*, ti.v AS ref_title, d.v AS ref_doi, dt.v AS ref_date, iso.v AS smiles_iso, m.v AS mass,
f.v AS formula_raw, coalesce(lm.v, le.v) AS label,
CASE WHEN lm.v IS NOT NULL THEN 'mul' WHEN le.v IS NOT NULL THEN 'en' END AS label_lang
FROM {core} k LEFT JOIN {ref_title} ti ON k.r = ti.r LEFT JOIN {ref_doi} d ON k.r = d.r
LEFT JOIN {ref_date} dt ON k.r = dt.r LEFT JOIN {smiles_iso} iso ON k.c = iso.c
LEFT JOIN {mass} m ON k.c = m.c LEFT JOIN {formula_raw} f ON k.c = f.c
LEFT JOIN (SELECT c, v FROM {compound_labels} WHERE lang = 'mul') lm ON k.c = lm.c
LEFT JOIN (SELECT c, v FROM {compound_labels} WHERE lang = 'en') le ON k.c = le.c"""

CLOSURE = """
SELECT 'Q10' AS t UNION SELECT p.child FROM {taxon_parent} p JOIN closure ON p.parent = closure.t"""

RESULT_COLUMNS = (
    "c AS compound_qid, label AS name, inchikey, coalesce(smiles_iso, smiles_conn) AS smiles, mass, "
    f"{s_formula('formula_raw')} AS formula, t AS taxon_qid, taxon_name, r AS reference_qid, ref_title, "
    "ref_doi, cast(year(ref_date) AS smallint) AS pub_year, statement"
)

ENTRY_ORDER_SQL = (
    "statement NULLS FIRST, mass NULLS FIRST, name NULLS FIRST, ref_title NULLS FIRST, "
    "ref_doi NULLS FIRST, pub_year NULLS FIRST, smiles NULLS FIRST"
)

STATS_SQL = (
    "SELECT count(*) AS n_entries, "
    "count(DISTINCT concat(compound_qid, chr(31), coalesce(taxon_qid, ''), chr(31), coalesce(reference_qid, ''))) "
    "AS n_entries_unique, count(DISTINCT compound_qid) AS n_compounds, count(DISTINCT taxon_qid) AS n_taxa, "
    "count(DISTINCT reference_qid) AS n_references FROM "
)

BASE_CTES = {"core": CORE, "enriched": ENRICHED, "closure": CLOSURE}
