"""Column functions over derived texts and over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from occurra.catalog.registry import (
    query,
    s_canonical,
    s_clean,
    s_count,
    s_doi_key,
    s_encode,
    s_formula,
    s_row_key,
    s_sanitize,
    s_tokens,
    s_trim,
)
from occurra.functions import chemistry as ch
from occurra.functions import text as tx
from occurra.sources import star

ELEMENTS = ("C", "H", "N", "O", "Cl")


def _texts(spark, folder):
    return star.view(spark, folder, "texts")


def _documents(spark, folder):
    return star.table(spark, folder, "documents")


_LEXICAL = f"trim({s_trim('''split_part({x}, '^^', 1)''')}, '\"')".replace("{x}", s_trim("qid_raw"))
_TAIL = "list_last(string_split({x}, 'wikidata.org/entity/'))".replace("{x}", s_trim("qid_raw"))


@query(
    "extract_qid",
    f"""SELECT id, CASE WHEN contains(qid_raw, 'wikidata.org/entity/') AND regexp_full_match({_TAIL}, 'Q[0-9]+') THEN {_TAIL}
WHEN regexp_full_match({_LEXICAL}, 'Q[0-9]+') THEN {_LEXICAL}
WHEN regexp_full_match({_LEXICAL}, '[0-9]+') THEN 'Q' || {_LEXICAL} END AS qid,
CASE WHEN regexp_full_match(list_last(string_split(qid_raw, '/')), 'Q[0-9]*') THEN list_last(string_split(qid_raw, '/')) END AS uri_qid
FROM {{texts}}""",
)
def extract_qid(spark, folder):
    return _texts(spark, folder).select(
        "id",
        tx.entity_id(F.col("qid_raw")).alias("qid"),
        tx.entity_id_from_uri(F.col("qid_raw")).alias("uri_qid"),
    )


@query(
    "clean_text",
    f"SELECT doc_id, md5({s_clean('text')}) AS cleaned, length({s_clean('text')}) AS n FROM {{documents}}",
)
def clean_text(spark, folder):
    text = tx.clean(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.md5(text.cast("binary")).alias("cleaned"), F.length(text).cast("bigint").alias("n")
    )


@query(
    "first_non_blank",
    f"SELECT id, coalesce({s_clean('name_raw')}, {s_clean('doi_raw')}) AS chosen FROM {{texts}}",
)
def first_non_blank(spark, folder):
    return _texts(spark, folder).select(
        "id", tx.first_non_blank(F.col("name_raw"), F.col("doi_raw")).alias("chosen")
    )


_YEAR = s_trim(f"split_part(replace({s_trim('year_raw')}, 'T', '-'), '-', 1)")


@query(
    "parse_year",
    f"SELECT id, CASE WHEN regexp_full_match({_YEAR}, '[+]?[0-9]+') THEN try_cast({_YEAR} AS smallint) END AS pub_year FROM {{texts}}",
)
def parse_year(spark, folder):
    return _texts(spark, folder).select("id", tx.publication_year(F.col("year_raw")).alias("pub_year"))


_DISPLAY = s_clean(f"list_last(string_split({s_trim('doi_raw')}, 'doi.org/'))")


@query(
    "doi_display",
    f"SELECT id, {_DISPLAY} AS doi, coalesce({_DISPLAY}, {s_clean('doi_raw')}) AS cleaned FROM {{texts}}",
)
def doi_display(spark, folder):
    return _texts(spark, folder).select(
        "id",
        tx.doi_display(F.col("doi_raw")).alias("doi"),
        tx.clean_doi(F.col("doi_raw")).alias("cleaned"),
    )


@query("doi_key", f"SELECT id, {s_doi_key('doi_raw')} AS doi FROM {{texts}}")
def doi_key(spark, folder):
    return _texts(spark, folder).select("id", tx.doi_key(F.col("doi_raw")).alias("doi"))


@query("doi_url", f"SELECT id, 'https://doi.org/' || {s_clean('doi_raw')} AS url FROM {{texts}}")
def doi_url(spark, folder):
    return _texts(spark, folder).select("id", tx.doi_url(F.col("doi_raw")).alias("url"))


@query(
    "statement_id",
    f"SELECT id, nullif(regexp_replace({s_clean('statement_raw')}, '^{tx.STATEMENT}', ''), '') AS statement FROM {{texts}}",
)
def statement_id(spark, folder):
    return _texts(spark, folder).select("id", tx.statement_id(F.col("statement_raw")).alias("statement"))


@query(
    "depict_url",
    f"""SELECT id, CASE WHEN NOT contains({s_clean('smiles_raw')}, chr(10))
THEN '{tx.DEPICT_HEAD}' || {s_encode(s_clean('smiles_raw'))} || '{tx.DEPICT_TAIL}' END AS url FROM {{texts}}""",
)
def depict_url(spark, folder):
    return _texts(spark, folder).select("id", tx.depict_url(F.col("smiles_raw")).alias("url"))


@query(
    "display_name",
    f"SELECT id, coalesce({s_clean('name_raw')}, qid_raw) AS shown, split_part(key_raw, '-', 1) AS short_key FROM {{texts}}",
)
def display_name(spark, folder):
    return _texts(spark, folder).select(
        "id",
        tx.display_name(F.col("name_raw"), F.col("qid_raw")).alias("shown"),
        tx.short_inchikey(F.col("key_raw")).alias("short_key"),
    )


@query(
    "formula_digits",
    f"SELECT c, {s_formula('v')} AS plain, translate({s_formula('v')}, '0123456789', '₀₁₂₃₄₅₆₇₈₉') AS subscripts FROM {{formula_raw}}",
)
def formula_digits(spark, folder):
    plain = ch.formula_digits(F.col("v"))
    return star.view(spark, folder, "formula_raw").select(
        "c", plain.alias("plain"), ch.formula_subscripts(plain).alias("subscripts")
    )


@query("formula_tokens", f"SELECT c, {s_tokens('v')} AS tokens FROM {{formula_raw}}")
def formula_tokens(spark, folder):
    return star.view(spark, folder, "formula_raw").select("c", ch.formula_tokens(F.col("v")).alias("tokens"))


@query(
    "element_counts",
    "SELECT c, " + ", ".join(f"{s_count('k', e)} AS n_{e.lower()}" for e in ELEMENTS)
    + f" FROM (SELECT c, {s_tokens('v')} AS k FROM {{formula_raw}}) x",
)
def element_counts(spark, folder):
    tokens = star.view(spark, folder, "formula_raw").select("c", ch.formula_tokens(F.col("v")).alias("k"))
    return tokens.select("c", *[ch.element_count(F.col("k"), e).alias(f"n_{e.lower()}") for e in ELEMENTS])


@query(
    "inchi_formula",
    f"""SELECT seq, CASE WHEN starts_with({s_trim('inchi')}, 'InChI=') THEN nullif(split_part({s_trim('inchi')}, '/', 2), '') END AS formula
FROM {{converted}}""",
)
def inchi_formula(spark, folder):
    return star.view(spark, folder, "converted").select(
        "seq", ch.formula_from_inchi(F.col("inchi")).alias("formula")
    )


@query("sanitize_taxon", f"SELECT id, {s_sanitize('name_raw')} AS name FROM {{texts}}")
def sanitize_taxon(spark, folder):
    return _texts(spark, folder).select("id", tx.sanitize_taxon(F.col("name_raw")).alias("name"))


@query("canonical_taxon", f"SELECT id, {s_canonical('name_raw')} AS name FROM {{texts}}")
def canonical_taxon(spark, folder):
    return _texts(spark, folder).select("id", tx.canonical_taxon(F.col("name_raw")).alias("name"))


@query("row_key", f"SELECT seq, {s_row_key()} AS key FROM {{candidates}}")
def row_key(spark, folder):
    return star.view(spark, folder, "candidates").select(
        "seq", tx.row_key(F.col("smiles"), F.col("taxon"), F.col("doi")).alias("key")
    )


@query("percent_encode", f"SELECT doc_id, md5({s_encode('text')}) AS encoded FROM {{documents}}")
def percent_encode(spark, folder):
    return _documents(spark, folder).select(
        "doc_id", F.md5(tx.percent_encode(F.col("text")).cast("binary")).alias("encoded")
    )


@query(
    "stereo_flag",
    r"SELECT id, regexp_matches(smiles_raw, '[@/\\]') AS stereo FROM {texts}",
)
def stereo_flag(spark, folder):
    return _texts(spark, folder).select("id", ch.has_stereo(F.col("smiles_raw")).alias("stereo"))


@query(
    "mass_statement",
    """SELECT c, c || printf('|P2067|+%.6fU483261', v) AS line, printf('%.4f', v) AS shown FROM {mass} WHERE v IS NOT NULL""",
)
def mass_statement(spark, folder):
    return (
        star.view(spark, folder, "mass")
        .filter(F.col("v").isNotNull())
        .select(
            "c",
            tx.mass_statement(F.col("c"), F.col("v")).alias("line"),
            tx.format_mass(F.col("v")).alias("shown"),
        )
    )


@query(
    "json_exact_mass",
    """SELECT event_id, try_cast(replace(regexp_extract(props, '"k"\\s*:\\s*(?:"\\s*)?([+-]?[0-9][0-9,]*(?:\\.[0-9]+)?)', 1), ',', '') AS double) AS k
FROM {events}""".replace("\\\\", "\\"),
)
def json_exact_mass(spark, folder):
    return star.table(spark, folder, "events").select(
        "event_id", ch.json_number(F.col("props"), "k").alias("k")
    )


@query(
    "taxon_input_kind",
    f"""SELECT req_id, CASE WHEN {s_clean('taxon')} IS NULL THEN NULL WHEN {s_clean('taxon')} = '*' THEN '*'
WHEN regexp_full_match({s_clean('taxon')}, '[Qq][0-9]+') THEN upper({s_clean('taxon')}) ELSE 'lookup' END AS kind FROM {{requests}}""",
)
def taxon_input_kind(spark, folder):
    return star.view(spark, folder, "requests").select("req_id", tx.taxon_input(F.col("taxon")).alias("kind"))


_KIND = f"""CASE WHEN coalesce({s_trim('smiles_raw')}, '') = '' THEN 'empty'
WHEN contains(upper(smiles_raw), 'M  END') AND (contains(upper(smiles_raw), 'V3000') OR contains(upper(smiles_raw), 'BEGIN CTAB')) THEN 'molfile_v3000'
WHEN contains(upper(smiles_raw), 'M  END') AND contains(upper(smiles_raw), 'V2000') THEN 'molfile_v2000' ELSE 'smiles' END"""


@query("structure_kind", f"SELECT id, {_KIND} AS kind FROM {{texts}}")
def structure_kind(spark, folder):
    return _texts(spark, folder).select("id", ch.structure_kind(F.col("smiles_raw")).alias("kind"))


_LF = "replace(replace(smiles_raw, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(
    "normalize_structure",
    f"SELECT id, CASE WHEN {_KIND} LIKE 'molfile%' THEN {_LF} ELSE {s_trim(_LF)} END AS structure FROM {{texts}}",
)
def normalize_structure(spark, folder):
    return _texts(spark, folder).select("id", ch.normalize_structure(F.col("smiles_raw")).alias("structure"))


@query(
    "non_blank_lines",
    f"""SELECT conv_id, turn, len(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
lambda x: {s_trim('x')}), lambda x: x <> '')) AS n_lines,
md5(array_to_string(list_filter(list_transform(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)),
lambda x: {s_trim('x')}), lambda x: x <> ''), '|')) AS joined FROM {{conversations}}""",
)
def non_blank_lines(spark, folder):
    lines = F.coalesce(tx.non_blank_lines(F.col("text")), F.array().cast("array<string>"))
    return star.table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        F.size(lines).cast("bigint").alias("n_lines"),
        F.md5(F.array_join(lines, "|").cast("binary")).alias("joined"),
    )
