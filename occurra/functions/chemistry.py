"""Molecular formula and structure text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from occurra.functions.text import trim

# Subscript digits and their plain twins.
SUBSCRIPTS = "₀₁₂₃₄₅₆₇₈₉"
DIGITS = "0123456789"
EMPTY, SMILES, MOLFILE_V2000, MOLFILE_V3000 = "empty", "smiles", "molfile_v2000", "molfile_v3000"


def formula_digits(c: Column) -> Column:
    return F.translate(c, SUBSCRIPTS, DIGITS)


def formula_subscripts(c: Column) -> Column:
    return F.translate(c, DIGITS, SUBSCRIPTS)


def formula_plain(c: Column) -> Column:
    """Formula without blanks, digits in plain form."""
    return formula_digits(F.replace(c, F.lit(" "), F.lit("")))


def formula_tokens(c: Column) -> Column:
    """A bar in front of every capital letter."""
    return F.regexp_replace(formula_plain(c), "([A-Z])", "|$1")


def element_count(tokens: Column, symbol: str) -> Column:
    """Count of the last token of ``symbol``; 1 without digits, 0 when absent."""
    token = rf"\|{symbol}([0-9]*)(\||$)"
    digits = F.regexp_extract(tokens, f"^.*{token}", 1)
    return (
        F.when(~F.coalesce(tokens.rlike(token), F.lit(False)), F.lit(0))
        .when(digits == "", F.lit(1))
        .otherwise(digits.try_cast("int"))
    )


def formula_from_inchi(c: Column) -> Column:
    """Formula layer of an InChI."""
    text = trim(c)
    return F.when(
        text.startswith("InChI="), F.nullif(F.split_part(text, F.lit("/"), F.lit(2)), F.lit(""))
    )


def has_stereo(c: Column) -> Column:
    """Structure text carries stereo marks."""
    return c.contains("@") | c.contains("/") | c.contains("\\")


def structure_kind(c: Column) -> Column:
    """What a structure text is."""
    upper = F.upper(c)
    ended = upper.contains("M  END")
    return (
        F.when(F.coalesce(trim(c), F.lit("")) == "", F.lit(EMPTY))
        .when(ended & (upper.contains("V3000") | upper.contains("BEGIN CTAB")), F.lit(MOLFILE_V3000))
        .when(ended & upper.contains("V2000"), F.lit(MOLFILE_V2000))
        .otherwise(F.lit(SMILES))
    )


def normalize_structure(c: Column) -> Column:
    """Line feeds only; trimmed unless a molfile."""
    lines = F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(structure_kind(lines).isin(MOLFILE_V2000, MOLFILE_V3000), lines).otherwise(trim(lines))


def json_number(c: Column, key: str = "exact_molecular_weight") -> Column:
    """First usable ``key`` at any depth of a JSON text, grouping commas removed."""
    raw = F.regexp_extract(c, rf'"{key}"\s*:\s*(?:"\s*)?([+-]?[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1)
    return F.replace(raw, F.lit(","), F.lit("")).try_cast("double")
