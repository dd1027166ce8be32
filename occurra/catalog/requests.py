"""Request tables derived from the events: normalising, checking, sharing, naming."""

from __future__ import annotations

from pyspark.sql import functions as F

from occurra.catalog.registry import query, s_encode, s_plain_number, s_trim
from occurra.functions import text as tx
from occurra.operators import requests as rq
from occurra.sources import star

YEAR = 2025
_BOUNDS = [(s.lower(), ceiling) for s, ceiling in rq.ELEMENT_CEILINGS.items()]
_GIVEN = ("c_min", "c_max", "h_min", "o_max", "s_min")
_STATES = ("f_state", "cl_state", "br_state", "i_state")


def _state_sql(name: str) -> str:
    if name not in ("cl_state", "br_state"):
        return f"'allowed' AS {name}"
    return f"CASE WHEN {name} IN ('required', 'excluded') THEN {name} ELSE 'allowed' END AS {name}"


def _bound_sql(name: str, default: int) -> str:
    return f"coalesce({name}, {default}) AS {name}" if name in _GIVEN else f"{default}::bigint AS {name}"


FILLED = f"""
SELECT req_id, coalesce(taxon, '') AS taxon, coalesce(smiles, '') AS smiles, coalesce(search_type, 'substructure') AS search_type,
coalesce(threshold, 0.8e0) AS threshold, coalesce(mass_min, 0e0) AS mass_min, coalesce(mass_max, 10000e0) AS mass_max,
coalesce(year_min, 1800) AS year_min, coalesce(year_max, {YEAR}) AS year_max, {s_trim("coalesce(formula_exact, '')")} AS formula_exact,
{', '.join(_bound_sql(f'{s}_{e}', 0 if e == 'min' else top) for s, top in _BOUNDS for e in ('min', 'max'))},
{', '.join(_state_sql(s) for s in _STATES)},
(coalesce({s_trim('formula_exact')}, '') <> '' OR {' OR '.join(f'{c} IS NOT NULL' for c in (*_GIVEN, 'cl_state', 'br_state'))}) AS formula_enabled,
threshold AS asked_threshold, mass_max AS asked_mass_max, year_max AS asked_year_max FROM {{requests}}"""

CTES = {"filled": FILLED}
_OUT = ["req_id", *rq.CRITERIA_COLUMNS]
_INT = ["year_min", "year_max", *[f"{s}_{e}" for s, _ in _BOUNDS for e in ("min", "max")]]


def _filled(spark, folder):
    return rq.fill_defaults(star.view(spark, folder, "requests"), YEAR)


def _wide(df):
    """Counts as bigint, as the reference SQL has them."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in _INT if c in df.columns})


_CLAMPED = {
    "threshold": "least(greatest(threshold, 0.05e0), 1e0)",
    "mass_min": "greatest(mass_min, 0e0)",
    "mass_max": "CASE WHEN asked_mass_max IS NULL THEN mass_max ELSE greatest(mass_max, greatest(mass_min, 0e0)) END",
    "year_max": "CASE WHEN asked_year_max IS NULL THEN year_max ELSE greatest(year_max, year_min) END",
}


@query(
    "normalize_requests",
    "SELECT "
    + ", ".join(f"{_CLAMPED[c]} AS {c}" if c in _CLAMPED else c for c in _OUT)
    + ", CASE WHEN asked_threshold <= 0 THEN 'threshold_not_positive' WHEN "
    + " OR ".join(f"{s}_min > {s}_max" for s, _ in _BOUNDS)
    + " THEN 'element_min_above_max' END AS error FROM {filled}",
    CTES,
)
def normalize_requests(spark, folder):
    return _wide(rq.normalize_requests(star.view(spark, folder, "requests"), YEAR))


@query(
    "validate_requests",
    f"""SELECT req_id, CASE WHEN {s_trim('taxon')} = '' AND {s_trim('smiles')} = '' AND NOT formula_enabled THEN 'EmptyInput'
WHEN strlen({s_trim('taxon')}) > 500 THEN 'TaxonTooLong' WHEN strlen({s_trim('smiles')}) > 10000 THEN 'StructureTooLong'
WHEN regexp_full_match({s_trim('smiles')}, '[a-z]') THEN 'EmptyInput'
WHEN NOT mass_min BETWEEN 0 AND 10000 THEN 'MassOutOfRange' WHEN mass_min > mass_max THEN 'MassRangeInvalid'
WHEN NOT (year_min BETWEEN 1600 AND {YEAR} AND year_max BETWEEN 1600 AND {YEAR}) THEN 'YearOutOfRange'
WHEN year_min > year_max THEN 'YearRangeInvalid' WHEN c_min + h_min > 1000 THEN 'ElementCountTooHigh'
WHEN search_type = 'similarity' AND threshold <= 0 THEN 'SimilarityThresholdInvalid' END AS fault FROM {{filled}}""",
    CTES,
)
def validate_requests(spark, folder):
    return rq.validate_criteria(_filled(spark, folder), YEAR).select("req_id", "fault")


_MASS = "(mass_min > 0 OR mass_max < 10000)"
_YEARS = f"(year_min > 1800 OR year_max < {YEAR})"
_STRUCTURE = f"({s_trim('smiles')} <> '')"


def _pairs_sql(encode: bool) -> str:
    def value(x: str) -> str:
        return s_encode(x) if encode else x

    pairs = [
        ("taxon", f"{s_trim('taxon')} <> ''", "taxon"),
        ("structure", _STRUCTURE, "smiles"),
        ("structure_search_type", _STRUCTURE, "search_type"),
        ("smiles_threshold", f"{_STRUCTURE} AND search_type = 'similarity'", "printf('%.2f', threshold)"),
        ("mass_filter", _MASS, "'true'"),
        ("mass_min", _MASS, s_plain_number("mass_min")),
        ("mass_max", _MASS, s_plain_number("mass_max")),
        ("year_filter", _YEARS, "'true'"),
        ("year_start", _YEARS, "cast(year_min AS varchar)"),
        ("year_end", _YEARS, "cast(year_max AS varchar)"),
        ("formula_filter", "formula_enabled", "'true'"),
        ("formula_exact", f"formula_enabled AND {s_trim('formula_exact')} <> ''", "formula_exact"),
    ]
    for symbol, top in _BOUNDS:
        pairs.append((f"{symbol}_min", f"formula_enabled AND {symbol}_min > 0", f"cast({symbol}_min AS varchar)"))
        pairs.append((f"{symbol}_max", f"formula_enabled AND {symbol}_max < {top}", f"cast({symbol}_max AS varchar)"))
    for state in _STATES:
        pairs.append((state, f"formula_enabled AND {state} <> 'allowed'", state))
    return "concat_ws('&', " + ", ".join(
        f"CASE WHEN {when} THEN '{k}=' || {value(f'({v})')} END" for k, when, v in pairs
    ) + ")"




@query(
    "encode_share_params",
    f"SELECT req_id, '?' || nullif({_pairs_sql(True)}, '') AS share_params FROM (SELECT * REPLACE (round(threshold * 4) / 4 + 0e0 AS threshold) FROM {{filled}}) f",
    CTES,
)
def encode_share_params(spark, folder):
    return rq.encode_share_params(_quarters(_filled(spark, folder)), YEAR).select("req_id", "share_params")


def _quarters(df):
    """Thresholds in quarters: two decimals hold them exactly in any engine."""
    return df.withColumn("threshold", F.round(F.col("threshold") * 4) / 4 + F.lit(0.0))


@query(
    "query_hash",
    f"""SELECT req_id, sha256(concat_ws('|', CASE WHEN {s_trim('taxon')} = '' OR {s_trim('taxon')} = '*' THEN '*' ELSE 'Q' || req_id END,
{s_trim('taxon')}, nullif({_pairs_sql(False)}, ''))) AS query_hash FROM (SELECT * REPLACE (round(threshold * 4) / 4 + 0e0 AS threshold) FROM {{filled}}) f""",
    CTES,
)
def query_hash(spark, folder):
    taxon = tx.trim(F.col("taxon"))
    qid = F.when(taxon == "", "").when(taxon == "*", "*").otherwise(F.concat(F.lit("Q"), "req_id"))
    return rq.query_hash(_quarters(_filled(spark, folder)).withColumn("qid", qid), YEAR).select(
        "req_id", "query_hash"
    )


@query(
    "decode_share_params",
    "SELECT req_id, "
    + "CASE WHEN {trim_smiles} <> '' AND {trim_taxon} = '' THEN '' WHEN {trim_taxon} = '' THEN 'Gentiana lutea' ELSE taxon END AS taxon, "
    .replace("{trim_smiles}", s_trim("smiles")).replace("{trim_taxon}", s_trim("taxon"))
    + f"CASE WHEN {_STRUCTURE} THEN smiles ELSE '' END AS smiles, "
    + f"CASE WHEN {_STRUCTURE} THEN search_type ELSE 'substructure' END AS search_type, "
    + f"CASE WHEN {_STRUCTURE} AND search_type = 'similarity' AND threshold > 0 THEN least(greatest(threshold, 0.05e0), 1e0) ELSE 0.8e0 END AS threshold, "
    + f"CASE WHEN {_MASS} THEN mass_min ELSE 0 END AS mass_min, CASE WHEN {_MASS} THEN mass_max ELSE 10000 END AS mass_max, "
    + f"CASE WHEN {_YEARS} THEN year_min ELSE 1800 END AS year_min, CASE WHEN {_YEARS} THEN year_max ELSE {YEAR} END AS year_max, "
    + f"CASE WHEN formula_enabled AND {s_trim('formula_exact')} <> '' THEN formula_exact ELSE '' END AS formula_exact, "
    + ", ".join(f"{s}_min, least({s}_max, {top}) AS {s}_max" for s, top in _BOUNDS)
    + ", " + ", ".join(_STATES)
    + ", formula_enabled FROM (SELECT * REPLACE (round(threshold * 4) / 4 + 0e0 AS threshold) FROM {filled}) f",
    CTES,
)
def decode_share_params(spark, folder):
    """Every request as a link with a repeated key in front, read back to criteria."""
    links = rq.encode_share_params(_quarters(_filled(spark, folder)), YEAR).select(
        "req_id",
        F.concat(
            F.lit("https://example.org/search?mass_min=7&c_min=bad&"),
            F.coalesce(F.substr("share_params", F.lit(2)), F.lit("")),
        ).alias("url"),
    )
    return _wide(rq.decode_share_params(links, "url", YEAR)).select(*_OUT)


_QUERY = "regexp_extract(url, '[?]([^#]*)', 1)"


@query(
    "share_params_pages",
    f"""SELECT page_id, list_last(list_filter(string_split({_QUERY}, '&'), lambda p: starts_with(p, 'page='))) AS page,
list_last(list_filter(string_split({_QUERY}, '&'), lambda p: starts_with(p, 'utm_source='))) AS source,
'Gentiana lutea' AS taxon, 0.8e0 AS threshold FROM {{pages}}""",
)
def share_params_pages(spark, folder):
    """Links of whole web pages: foreign parameters leave the defaults alone."""
    pages = star.table(spark, folder, "pages").select("page_id", "url")
    decoded = rq.decode_share_params(pages, "url", YEAR)
    texts = pages.select("page_id", rq.share_query(F.col("url")).alias("q"))
    shown = texts.select(
        "page_id",
        F.concat(F.lit("page="), rq.share_value(F.col("q"), "page")).alias("page"),
        F.concat(F.lit("utm_source="), rq.share_value(F.col("q"), "utm_source")).alias("source"),
    )
    return shown.join(decoded.select("page_id", "taxon", "threshold"), "page_id")


_SLUG = (
    f"CASE WHEN {s_trim('taxon')} = '' THEN 'any_taxon' WHEN {s_trim('taxon')} = '*' THEN 'all_taxa' ELSE "
    f"replace(translate({s_trim('taxon')}, ' /\\:?\"<>|', '____'), '*', 'star') END"
)
_FORMULA_ACTIVE = (
    f"(formula_enabled AND ({s_trim('formula_exact')} <> '' OR "
    + " OR ".join(f"{s}_min > 0 OR {s}_max < {top}" for s, top in _BOUNDS)
    + " OR " + " OR ".join(f"{s} <> 'allowed'" for s in _STATES) + "))"
)


@query(
    "export_name",
    f"""SELECT req_id, '20250101_occurrences_' || {_SLUG} || CASE WHEN {_STRUCTURE} THEN '_' || search_type ELSE '' END ||
CASE WHEN {_STRUCTURE} OR {_MASS} OR {_YEARS} OR {_FORMULA_ACTIVE} THEN '_filtered' ELSE '' END || '.csv' AS export_name FROM {{filled}}""",
    CTES,
)
def export_name(spark, folder):
    return rq.export_name(_filled(spark, folder), "csv", "20250101", YEAR).select("req_id", "export_name")
