"""Row filters of a search: mass, year, molecular formula."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.functions import chemistry as ch
from occurra.model import ELEMENT_CEILINGS, MASS_CEILING, MASS_FLOOR, YEAR_FLOOR, Criteria


def filter_mass(df: DataFrame, low: float, high: float, mass: str = "mass") -> DataFrame:
    """Inclusive range, active only when it restricts; drops rows without mass."""
    if low <= MASS_FLOOR and high >= MASS_CEILING:
        return df
    return df.filter(F.col(mass).between(F.lit(round(low, 6)), F.lit(round(high, 6))))


def filter_year(
    df: DataFrame, low: int, high: int | None = None, date: str = "ref_date"
) -> DataFrame:
    """Inclusive range on the year of the publication date; None is no upper bound.

    A range that restricts drops rows without a date.
    """
    if low <= YEAR_FLOOR and high is None:
        return df
    year = F.year(date)
    return df.filter(year >= low if high is None else year.between(low, high))


def has_formula(df: DataFrame, formula: str = "formula_raw") -> DataFrame:
    """An active formula filter needs a formula."""
    return df.filter(F.col(formula).isNotNull())


def element_range(tokens: Column, symbol: str, low: int, high: int) -> Column | None:
    """Condition on one element, None when the bounds do not restrict."""
    if low <= 0 and high >= ELEMENT_CEILINGS[symbol]:
        return None
    return ch.element_count(tokens, symbol).between(low, high)


def filter_elements(
    df: DataFrame, bounds: dict[str, tuple[int, int]], formula: str = "formula_raw"
) -> DataFrame:
    tokens = ch.formula_tokens(F.col(formula))
    conditions = [element_range(tokens, s, lo, hi) for s, (lo, hi) in bounds.items()]
    active = [c for c in conditions if c is not None]
    if not active:
        return df
    df = has_formula(df, formula)
    for condition in active:
        df = df.filter(condition)
    return df


def filter_halogens(df: DataFrame, states: dict[str, str], formula: str = "formula_raw") -> DataFrame:
    """``required`` / ``excluded`` per element; any other text allows it."""
    tokens = ch.formula_tokens(F.col(formula))
    active = {s: v for s, v in states.items() if v in ("required", "excluded")}
    if not active:
        return df
    df = has_formula(df, formula)
    for symbol, state in active.items():
        count = ch.element_count(tokens, symbol)
        df = df.filter(count > 0 if state == "required" else count == 0)
    return df


def filter_formula_exact(df: DataFrame, wanted: str, formula: str = "formula_raw") -> DataFrame:
    """Textual equality after digit and blank normalisation."""
    plain = "".join(wanted.translate(str.maketrans(ch.SUBSCRIPTS, ch.DIGITS)).split())
    if not plain:
        return df
    return df.filter(ch.formula_plain(F.col(formula)) == plain)


def filter_formula(df: DataFrame, criteria: Criteria, formula: str = "formula_raw") -> DataFrame:
    if not criteria.formula_active:
        return df
    df = filter_elements(df, criteria.active_elements, formula)
    df = filter_halogens(df, criteria.active_halogens, formula)
    return filter_formula_exact(df, criteria.formula_exact, formula)


def apply_filters(df: DataFrame, criteria: Criteria) -> DataFrame:
    """All active filters of a request; unchanged when none is."""
    df = filter_mass(df, criteria.mass_min, criteria.mass_max)
    df = filter_year(df, criteria.year_min, criteria.year_max)
    return filter_formula(df, criteria)


__all__ = [
    "apply_filters",
    "element_range",
    "filter_elements",
    "filter_formula",
    "filter_formula_exact",
    "filter_halogens",
    "filter_mass",
    "filter_year",
    "has_formula",
]
