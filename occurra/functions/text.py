"""Identifier, DOI, name and text normalisation as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space characters, public URI prefixes, property ids.
WHITESPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
ENTITY = "http://www.wikidata.org/entity/"
STATEMENT = "http://www.wikidata.org/entity/statement/"
DOI_ROOT = "https://doi.org/"
DEPICT_HEAD = "https://www.simolecule.com/cdkdepict/depict/cow/svg?smi="
DEPICT_TAIL = "&annotate=cip"

SPACE_RUN = f"[{WHITESPACE}]+"


def trim(c: Column) -> Column:
    """Strip every kind of white space, not only blanks."""
    return F.btrim(c, F.lit(WHITESPACE))


def clean(c: Column) -> Column:
    """H3: trimmed text, NULL when nothing is left."""
    return F.nullif(trim(c), F.lit(""))


def first_non_blank(*cols: Column) -> Column:
    return F.coalesce(*[clean(c) for c in cols])


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def entity_id(c: Column) -> Column:
    """H1: entity id out of a URI, a bare id or a typed numeric literal."""
    text = trim(c)
    return entity_of(text, entity_lexical(text))


def entity_lexical(text: Column) -> Column:
    """Value of a trimmed text without type and quotes."""
    return F.btrim(trim(F.substring_index(text, "^^", 1)), F.lit('"'))


def entity_of(text: Column, lexical: Column) -> Column:
    """H1 of a trimmed text and its ``entity_lexical``."""
    tail = F.substring_index(text, "wikidata.org/entity/", -1)
    return (
        F.when(text.contains("wikidata.org/entity/") & tail.rlike("^Q[0-9]+$"), tail)
        .when(lexical.rlike("^Q[0-9]+$"), lexical)
        .when(lexical.rlike("^[0-9]+$"), F.concat(F.lit("Q"), lexical))
    )


def entity_id_from_uri(c: Column) -> Column:
    """H2: last path segment when it is ``Q`` and digits (digits may be absent)."""
    tail = F.substring_index(c, "/", -1)
    return F.when(tail.rlike("^Q[0-9]*$"), tail)


def entity_number(c: Column) -> Column:
    """B2: the integer after the first ``Q`` of an identifier."""
    return F.split_part(c, F.lit("Q"), F.lit(2)).try_cast("bigint")


def publication_year(c: Column) -> Column:
    """H4: year in front of the first ``-`` or ``T``; must fit 16 bits."""
    return year_of(year_head(trim(c)))


def year_head(text: Column) -> Column:
    """What stands in front of the first ``-`` or ``T`` of a trimmed text."""
    return trim(F.split(text, "[-T]", 2).getItem(0))


def year_of(head: Column) -> Column:
    return F.when(head.rlike("^[+]?[0-9]+$"), head.try_cast("smallint"))


def parse_number(c: Column) -> Column:
    """Plain decimal text to double; suffixed, special and blank forms give NULL."""
    return number_of(trim(c))


def number_of(text: Column) -> Column:
    """``parse_number`` of a trimmed text."""
    return F.when(
        text.rlike(r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double")
    )


def doi_display(c: Column) -> Column:
    """H5: text after the last ``doi.org/``, case kept."""
    return clean(after_doi_root(trim(c)))


def after_doi_root(text: Column) -> Column:
    return F.substring_index(text, "doi.org/", -1)


def doi_key(c: Column) -> Column:
    """H6: text after the first ``doi.org/`` in any case, upper-cased; the join key."""
    return ascii_upper(F.nullif(F.regexp_replace(trim(c), r"(?is)^.*?doi\.org/", ""), F.lit("")))


def clean_doi(c: Column) -> Column:
    """H7: as H5, but a bare prefix comes back unchanged."""
    return F.coalesce(doi_display(c), clean(c))


def doi_url(c: Column) -> Column:
    return F.concat(F.lit(DOI_ROOT), clean(c))


def statement_id(c: Column) -> Column:
    """H9: identifier without the statement URI prefix."""
    return statement_of(clean(c))


def statement_of(text: Column) -> Column:
    """H9 of a trimmed text, NULL when blank."""
    return F.nullif(
        F.when(text.startswith(STATEMENT), F.substr(text, F.lit(len(STATEMENT) + 1))).otherwise(text),
        F.lit(""),
    )


def percent_encode(c: Column) -> Column:
    """RFC 3986 encoding; Spark's own function is form encoding."""
    form = F.url_encode(c)
    return F.replace(
        F.replace(F.replace(form, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")),
        F.lit("%7E"),
        F.lit("~"),
    )


def depict_url(c: Column) -> Column:
    """Drawing link of a one-line structure."""
    text = clean(c)
    return F.when(
        ~text.contains("\n"), F.concat(F.lit(DEPICT_HEAD), percent_encode(text), F.lit(DEPICT_TAIL))
    )


def display_name(name: Column, qid: Column) -> Column:
    return F.coalesce(clean(name), qid)


def short_inchikey(c: Column) -> Column:
    return F.substring_index(c, "-", 1)


def collapse_spaces(c: Column) -> Column:
    return trim(F.regexp_replace(c, SPACE_RUN, " "))


def sanitize_taxon(c: Column) -> Column:
    """``_`` to blank, blanks collapsed, first word capitalised, rest untouched."""
    spaced = F.replace(c, F.lit("_"), F.lit(" "))
    words = collapse_spaces(spaced)
    first = F.substring_index(words, " ", 1)
    rest = F.substr(words, F.length(first) + 1)
    titled = F.concat(F.upper(F.left(first, F.lit(1))), F.lower(F.substr(first, F.lit(2))), rest)
    return F.when(words == "", spaced).otherwise(titled)


def canonical_taxon(c: Column) -> Column:
    """Blanks collapsed, first letter upper-case, everything else lower-case (ASCII)."""
    words = collapse_spaces(c)
    return F.concat(ascii_upper(F.left(words, F.lit(1))), ascii_lower(F.substr(words, F.lit(2))))


def taxon_key(c: Column) -> Column:
    """Lookup key of a taxon name."""
    return ascii_lower(clean(c))


def row_key(smiles: Column, taxon: Column, doi: Column) -> Column:
    """Identity of a curation row."""
    empty = F.lit("")
    return F.concat_ws(
        "\t",
        F.coalesce(trim(smiles), empty),
        F.coalesce(taxon_key(taxon), empty),
        F.coalesce(doi_key(doi), empty),
    )


def taxon_input(c: Column) -> Column:
    """NULL, ``*``, an upper-cased id, or the text ``lookup``."""
    text = clean(c)
    return (
        F.when(text.isNull(), F.lit(None).cast("string"))
        .when(text == "*", text)
        .when(text.rlike("^[Qq][0-9]+$"), F.upper(text))
        .otherwise(F.lit("lookup"))
    )


def non_blank_lines(c: Column) -> Column:
    """Trimmed lines that hold text; NULL when there is none."""
    lines = F.filter(F.transform(F.split(c, "\\r\\n|\\n"), trim), lambda x: x != "")
    return F.when(F.size(lines) > 0, lines)


def escape_quotes(c: Column) -> Column:
    """Backslash and double quote escaped for a quoted value."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def mass_statement(subject: Column, mass: Column) -> Column:
    """Mass in dalton with six decimals."""
    return F.concat(subject, F.format_string("|P2067|+%.6fU483261", mass.cast("double")))


def format_mass(c: Column, digits: int = 4) -> Column:
    return F.coalesce(
        F.when(c.isNotNull(), F.format_string(f"%.{digits}f", c.cast("double"))), F.lit("n/a")
    )


def plain_number(c: Column) -> Column:
    """Shortest decimal text of a double: whole numbers without ``.0``."""
    whole = (c == F.floor(c)) & (F.abs(c) < F.lit(1e15))
    return F.when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))
