"""Tables of search requests: defaults, checks, share parameters, names, hashes.

A request table has the columns of ``REQUEST_COLUMNS`` (any may be missing) and
keeps whatever other columns it carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occurra.functions import chemistry as ch
from occurra.functions import text as tx
from occurra.model import (
    DEFAULT_SEARCH_TYPE,
    DEFAULT_TAXON,
    DEFAULT_THRESHOLD,
    ELEMENT_CEILINGS,
    HALOGENS,
    MASS_CEILING,
    MASS_FLOOR,
    THRESHOLD_CEILING,
    THRESHOLD_FLOOR,
    YEAR_FLOOR,
    Criteria,
)

# Bounds of the data-quality rules and accepted flag texts.
MAX_TAXON_BYTES, MAX_STRUCTURE_BYTES = 500, 10_000
EARLIEST_YEAR = 1600
_NO_YEAR = 1 << 30
MAX_ELEMENT_SUM = 1000
TRUE_FLAGS = ("1", "true", "yes", "on")

_BOUNDS = [(s.lower(), ceiling) for s, ceiling in ELEMENT_CEILINGS.items()]
_STATES = [f"{h.lower()}_state" for h in HALOGENS]

REQUEST_COLUMNS: dict[str, str] = {
    "taxon": "string",
    "smiles": "string",
    "search_type": "string",
    "threshold": "double",
    "mass_min": "double",
    "mass_max": "double",
    "year_min": "int",
    "year_max": "int",
    "formula_exact": "string",
    **{f"{s}_{end}": "int" for s, _ in _BOUNDS for end in ("min", "max")},
    **{s: "string" for s in _STATES},
}
SHARE_KEYS = (
    "smiles_threshold",
    *[f"{name}_filter" for name in ("mass", "year", "formula")],
    *("mass_min", "mass_max", "year_start", "year_end", "formula_exact"),
    *[f"{s}_{end}" for s, _ in _BOUNDS for end in ("min", "max")],
    *_STATES,
)
CRITERIA_COLUMNS = (*REQUEST_COLUMNS, "formula_enabled")


def _with_all_columns(df: DataFrame) -> DataFrame:
    others = [F.col(c) for c in df.columns if c not in REQUEST_COLUMNS]
    return df.select(
        *others,
        *[
            (F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c)
            for c, t in REQUEST_COLUMNS.items()
        ],
    )


def _state(c: Column) -> Column:
    return F.when(c.isin("required", "excluded"), c).otherwise(F.lit("allowed"))


def fill_defaults(df: DataFrame, as_of_year: int, taxon: str = "") -> DataFrame:
    """Requests with every gap filled and ``formula_enabled`` derived; nothing is clamped."""
    df = _with_all_columns(df)
    given = [F.col(f"{s}_{end}").isNotNull() for s, _ in _BOUNDS for end in ("min", "max")]
    given += [F.col(s).isNotNull() for s in _STATES]
    enabled = tx.clean(F.col("formula_exact")).isNotNull()
    for g in given:
        enabled = enabled | g
    filled = {
        "taxon": F.coalesce("taxon", F.lit(taxon)),
        "smiles": F.coalesce("smiles", F.lit("")),
        "search_type": F.coalesce("search_type", F.lit(DEFAULT_SEARCH_TYPE)),
        "threshold": F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD)),
        "mass_min": F.coalesce("mass_min", F.lit(MASS_FLOOR)),
        "mass_max": F.coalesce("mass_max", F.lit(MASS_CEILING)),
        "year_min": F.coalesce("year_min", F.lit(YEAR_FLOOR)),
        "year_max": F.coalesce("year_max", F.lit(as_of_year)),
        "formula_exact": tx.trim(F.coalesce("formula_exact", F.lit(""))),
    }
    for symbol, ceiling in _BOUNDS:
        filled[f"{symbol}_min"] = F.coalesce(f"{symbol}_min", F.lit(0))
        filled[f"{symbol}_max"] = F.coalesce(f"{symbol}_max", F.lit(ceiling))
    for state in _STATES:
        filled[state] = _state(F.col(state))
    others = [F.col(c) for c in df.columns if c not in REQUEST_COLUMNS]
    return df.select(*others, *[c.alias(n) for n, c in filled.items()], enabled.alias("formula_enabled"))


def normalize_requests(df: DataFrame, as_of_year: int) -> DataFrame:
    """Filled and clamped requests with ``error`` (NULL when usable)."""
    df = _with_all_columns(df)
    asked = df.select(
        "*",
        F.col("threshold").alias("_threshold"),
        F.col("mass_max").alias("_mass_max"),
        F.col("year_max").alias("_year_max"),
    )
    filled = fill_defaults(asked, as_of_year)
    crossed = F.lit(False)
    for symbol, _ in _BOUNDS:
        crossed = crossed | (F.col(f"{symbol}_min") > F.col(f"{symbol}_max"))
    low = F.greatest("mass_min", F.lit(MASS_FLOOR))
    return filled.withColumns(
        {
            "error": F.when(F.col("_threshold") <= 0, "threshold_not_positive").when(
                crossed, "element_min_above_max"
            ),
            "threshold": F.least(F.greatest("threshold", F.lit(THRESHOLD_FLOOR)), F.lit(THRESHOLD_CEILING)),
            "mass_min": low,
            "mass_max": F.when(F.col("_mass_max").isNull(), F.col("mass_max")).otherwise(
                F.greatest("mass_max", low)
            ),
            "year_max": F.when(F.col("_year_max").isNull(), F.col("year_max")).otherwise(
                F.greatest("year_max", "year_min")
            ),
        }
    ).drop("_threshold", "_mass_max", "_year_max")


def validate_criteria(df: DataFrame, as_of_year: int) -> DataFrame:
    """Filled requests with ``fault``, the first failing rule or NULL."""
    taxon, smiles = tx.trim(F.col("taxon")), tx.trim(F.col("smiles"))
    lone_letter = smiles.rlike("^[a-z]$") & (ch.structure_kind(smiles) == ch.SMILES)
    year_ok = [F.col(c).between(EARLIEST_YEAR, as_of_year) for c in ("year_min", "year_max")]
    fault = (
        F.when((taxon == "") & (smiles == "") & ~F.col("formula_enabled"), "EmptyInput")
        .when(F.octet_length(taxon) > MAX_TAXON_BYTES, "TaxonTooLong")
        .when(F.octet_length(smiles) > MAX_STRUCTURE_BYTES, "StructureTooLong")
        .when(lone_letter, "EmptyInput")
        .when(~F.col("mass_min").between(MASS_FLOOR, MASS_CEILING), "MassOutOfRange")
        .when(F.col("mass_min") > F.col("mass_max"), "MassRangeInvalid")
        .when(~(year_ok[0] & year_ok[1]), "YearOutOfRange")
        .when(F.col("year_min") > F.col("year_max"), "YearRangeInvalid")
        .when(F.col("c_min") + F.col("h_min") > MAX_ELEMENT_SUM, "ElementCountTooHigh")
        .when((F.col("search_type") == "similarity") & (F.col("threshold") <= 0), "SimilarityThresholdInvalid")
    )
    return df.withColumn("fault", fault)


def mass_active() -> Column:
    return (F.col("mass_min") > MASS_FLOOR) | (F.col("mass_max") < MASS_CEILING)


def year_active(as_of_year: int | Column) -> Column:
    """An upper bound of NULL is none."""
    return (F.col("year_min") > YEAR_FLOOR) | F.coalesce(F.col("year_max") < as_of_year, F.lit(False))


def formula_active() -> Column:
    active = tx.trim(F.col("formula_exact")) != ""
    for symbol, ceiling in _BOUNDS:
        active = active | (F.col(f"{symbol}_min") > 0) | (F.col(f"{symbol}_max") < ceiling)
    for state in _STATES:
        active = active | F.col(state).isin("required", "excluded")
    return F.col("formula_enabled") & active


def share_pairs(as_of_year: int) -> list[tuple[str, Column]]:
    """Parameter name and value in fixed order; the value is NULL at its default."""
    structure = tx.trim(F.col("smiles")) != ""
    similarity = structure & (F.col("search_type") == "similarity")
    mass, year, formula = mass_active(), year_active(as_of_year), F.col("formula_enabled")
    pairs = [
        ("taxon", F.when(tx.trim(F.col("taxon")) != "", F.col("taxon"))),
        ("structure", F.when(structure, F.col("smiles"))),
        ("structure_search_type", F.when(structure, F.col("search_type"))),
        ("smiles_threshold", F.when(similarity, F.format_string("%.2f", "threshold"))),
        ("mass_filter", F.when(mass, "true")),
        ("mass_min", F.when(mass, tx.plain_number(F.col("mass_min")))),
        ("mass_max", F.when(mass, tx.plain_number(F.col("mass_max")))),
        ("year_filter", F.when(year, "true")),
        ("year_start", F.when(year, F.col("year_min").cast("string"))),
        ("year_end", F.when(year, F.col("year_max").cast("string"))),
        ("formula_filter", F.when(formula, "true")),
        ("formula_exact", F.when(formula & (tx.trim(F.col("formula_exact")) != ""), F.col("formula_exact"))),
    ]
    for symbol, ceiling in _BOUNDS:
        low, high = F.col(f"{symbol}_min"), F.col(f"{symbol}_max")
        pairs.append((f"{symbol}_min", F.when(formula & (low > 0), low.cast("string"))))
        pairs.append((f"{symbol}_max", F.when(formula & (high < ceiling), high.cast("string"))))
    for state in _STATES:
        pairs.append((state, F.when(formula & F.col(state).isin("required", "excluded"), F.col(state))))
    return pairs


def encode_share_params(df: DataFrame, as_of_year: int, out: str = "share_params") -> DataFrame:
    """``?key=value&...`` of the non-default values, NULL when there are none."""
    joined = F.concat_ws(
        "&", *[F.concat(F.lit(f"{k}="), tx.percent_encode(v)) for k, v in share_pairs(as_of_year)]
    )
    return df.withColumn(out, F.concat(F.lit("?"), F.nullif(joined, F.lit(""))))


def query_hash(df: DataFrame, as_of_year: int | None = None, qid: str = "qid") -> DataFrame:
    """SHA-256 of id, taxon and plain share parameters per request."""
    # without a year of reference every given upper bound counts
    year = as_of_year if as_of_year is not None else F.lit(_NO_YEAR)
    params = F.concat_ws("&", *[F.concat(F.lit(f"{k}="), v) for k, v in share_pairs(year)])
    source = F.concat_ws(
        "|",
        F.when(tx.clean(F.col(qid)).isNull(), "*").otherwise(F.col(qid)),
        tx.trim(F.col("taxon")),
        F.nullif(params, F.lit("")),
    )
    return df.withColumn("query_hash", F.sha2(source.cast("binary"), 256))


def criteria_table(spark: SparkSession, criteria: Criteria, qid: str | None = None) -> DataFrame:
    """One request as a one-row table, ready for the column jobs above."""
    values = {
        "taxon": criteria.taxon,
        "smiles": criteria.smiles,
        "search_type": criteria.search_type,
        "threshold": float(criteria.threshold),
        "mass_min": float(criteria.mass_min),
        "mass_max": float(criteria.mass_max),
        "year_min": criteria.year_min,
        "year_max": criteria.year_max,
        "formula_exact": criteria.formula_exact,
        "formula_enabled": criteria.formula_enabled,
        "qid": qid,
    }
    for symbol, ceiling in ELEMENT_CEILINGS.items():
        low, high = criteria.elements.get(symbol, (0, ceiling))
        values[f"{symbol.lower()}_min"], values[f"{symbol.lower()}_max"] = low, high
    for halogen in HALOGENS:
        values[f"{halogen.lower()}_state"] = criteria.halogens.get(halogen, "allowed")
    types = {**REQUEST_COLUMNS, "formula_enabled": "boolean", "qid": "string"}
    return spark.sql("SELECT 1").select(*[F.lit(values[n]).cast(t).alias(n) for n, t in types.items()])


def share_query(url: Column) -> Column:
    """Query text of a URL as ``&key=value&...``, keys decoded, values as they are.

    Only a text with an encoded key or a parameter without ``=`` is taken
    apart; any other is used as it stands.
    """
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))

    def plain(part: Column) -> Column:
        key = F.substring_index(part, "=", 1)
        value = F.substr(part, F.length(key) + 2)
        return F.concat(F.coalesce(F.try_url_decode(key), key), F.lit("="), value)

    unusual = query.rlike("(^|&)[^=&%+]*([%+&]|$)")
    rebuilt = F.array_join(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), plain), "&")
    return F.concat(F.lit("&"), F.when(unusual, rebuilt).otherwise(query))


def share_value(query: Column, key: str) -> Column:
    """Decoded value of a parameter in a ``share_query`` text, the last one when it repeats."""
    raw = F.substring_index(F.substring_index(query, f"&{key}=", -1), "&", 1)
    encoded = raw.contains("%") | raw.contains("+")
    value = F.when(encoded, F.coalesce(F.try_url_decode(raw), raw)).otherwise(raw)
    return F.when(query.contains(f"&{key}="), value)


def _flag(value: Column) -> Column:
    return F.coalesce(F.lower(tx.trim(value)).isin(*TRUE_FLAGS), F.lit(False))


def _decimal(value: Column) -> Column:
    plain = value.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(plain, value.try_cast("double"))


def _count(value: Column) -> Column:
    number = F.when(value.rlike("^[+]?[0-9]{1,18}$"), value.try_cast("bigint"))
    return F.when(number <= 65535, number.cast("int"))


def decode_share_params(df: DataFrame, url: str, as_of_year: int) -> DataFrame:
    """Criteria columns out of a URL column, and ``year_max_given``, as ``year_max`` is filled."""
    kept = [c for c in df.columns if c not in (*CRITERIA_COLUMNS, "year_max_given")]
    # parameters first, each read from the text once, then the criteria
    read = ("taxon", "structure", "smiles", "structure_search_type", "smiles_search_type", *SHARE_KEYS)
    parsed = df.select(*kept, share_query(F.col(url)).alias("_query"))
    parsed = parsed.select(*kept, *[share_value(F.col("_query"), k).alias(f"_{k}") for k in read])

    def p(key: str) -> Column:
        return F.col(f"_{key}")

    structure = F.coalesce(p("structure"), p("smiles"))
    kind = F.coalesce(p("structure_search_type"), p("smiles_search_type"))
    threshold = _decimal(p("smiles_threshold"))
    mass, year, formula = (_flag(p(k)) for k in ("mass_filter", "year_filter", "formula_filter"))
    no_taxon = (tx.trim(F.coalesce(structure, F.lit(""))) != "") & p("taxon").isNull()
    columns = {
        "taxon": F.when(no_taxon, "").otherwise(F.coalesce(p("taxon"), F.lit(DEFAULT_TAXON))),
        "smiles": F.coalesce(structure, F.lit("")),
        "search_type": F.when(F.lower(kind) == "similarity", "similarity").otherwise("substructure"),
        "threshold": F.when(
            (threshold > 0) & (threshold < float("inf")),
            F.least(F.greatest(threshold, F.lit(THRESHOLD_FLOOR)), F.lit(THRESHOLD_CEILING)),
        ).otherwise(F.lit(DEFAULT_THRESHOLD)),
        "mass_min": F.coalesce(F.when(mass, _decimal(p("mass_min"))), F.lit(MASS_FLOOR)),
        "mass_max": F.coalesce(F.when(mass, _decimal(p("mass_max"))), F.lit(MASS_CEILING)),
        "year_min": F.coalesce(F.when(year, _count(p("year_start"))), F.lit(YEAR_FLOOR)),
        "year_max": F.coalesce(F.when(year, _count(p("year_end"))), F.lit(as_of_year)),
        "formula_exact": F.coalesce(F.when(formula, p("formula_exact")), F.lit("")),
    }
    for symbol, ceiling in _BOUNDS:
        for end, default in (("min", 0), ("max", ceiling)):
            key = f"{symbol}_{end}"
            columns[key] = F.coalesce(F.when(formula, _count(p(key))), F.lit(default))
    for state in _STATES:
        columns[state] = F.coalesce(F.when(formula, _state(p(state))), F.lit("allowed"))
    return parsed.select(
        *kept,
        *[c.alias(n) for n, c in columns.items()],
        formula.alias("formula_enabled"),
        F.coalesce(year & _count(p("year_end")).isNotNull(), F.lit(False)).alias("year_max_given"),
    )


def taxon_slug(c: Column) -> Column:
    text = tx.trim(F.coalesce(c, F.lit("")))
    safe = F.replace(F.translate(text, ' /\\:?"<>|', "____"), F.lit("*"), F.lit("star"))
    return F.when(text == "", "any_taxon").when(text == "*", "all_taxa").otherwise(safe)


def export_name(
    df: DataFrame, extension: str, date: str, as_of_year: int, source: str = "occurrences"
) -> DataFrame:
    """``{date}_{source}_{taxon}[_kind][_filtered].{extension}`` per request."""
    structure = tx.trim(F.col("smiles")) != ""
    narrowed = structure | mass_active() | year_active(as_of_year) | formula_active()
    stem = F.concat_ws(
        "_",
        F.lit(date),
        F.lit(source),
        taxon_slug(F.col("taxon")),
        F.when(structure, F.col("search_type")),
        F.when(narrowed, "filtered"),
    )
    return df.withColumn("export_name", F.concat(stem, F.lit(f".{extension}")))
