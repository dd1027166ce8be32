import pytest
from pyspark.sql import functions as F

from occurra.functions import chemistry as ch
from occurra.functions import text as tx

XSD_INT = '"456"^^<http://www.w3.org/2001/XMLSchema#integer>'

CASES = [
    (tx.entity_id, "http://www.wikidata.org/entity/Q123", "Q123"),
    (tx.entity_id, "https://www.wikidata.org/entity/Q9 ", "Q9"),
    (tx.entity_id, XSD_INT, "Q456"),
    (tx.entity_id, " Q7 ", "Q7"),
    (tx.entity_id, "not-a-qid", None),
    (tx.entity_id, "Q", None),
    (tx.entity_id, "", None),
    (tx.entity_id_from_uri, "http://x/entity/Q5", "Q5"),
    (tx.entity_id_from_uri, "http://x/entity/Q", "Q"),
    (tx.entity_id_from_uri, "http://x/entity/P5", None),
    (tx.entity_number, "Q12", 12),
    (tx.clean, "  \t x y　\n", "x y"),
    (tx.clean, "   ", None),
    (tx.publication_year, "2021-04-23T00:00:00Z", 2021),
    (tx.publication_year, "1999", 1999),
    (tx.publication_year, "-0044-03-15", None),
    (tx.publication_year, "99999-01-01", None),
    (tx.parse_number, "180.5", 180.5),
    (tx.parse_number, "1e3", 1000.0),
    (tx.parse_number, "5d", None),
    (tx.parse_number, "NaN", None),
    (tx.clean_doi, "https://doi.org/10.1000/xyz", "10.1000/xyz"),
    (tx.clean_doi, "  ", None),
    (tx.clean_doi, "https://doi.org/", "https://doi.org/"),
    (tx.doi_display, "https://doi.org/", None),
    (tx.doi_display, "doi.org/a/doi.org/B", "B"),
    (tx.doi_key, "https://doi.org/10.1/x", "10.1/X"),
    (tx.doi_key, "HTTP://DX.DOI.ORG/10.2/é", "10.2/é"),
    (tx.doi_key, "doi.org/a/doi.org/b", "A/DOI.ORG/B"),
    (tx.doi_key, "https://doi.org/", None),
    (tx.doi_url, " 10.1/x ", "https://doi.org/10.1/x"),
    (tx.statement_id, "http://www.wikidata.org/entity/statement/Q1-ABC", "Q1-ABC"),
    (tx.statement_id, " Q1-ABC ", "Q1-ABC"),
    (tx.short_inchikey, "AAAA-BBBB-CCCC", "AAAA"),
    (tx.percent_encode, 'CREATE\nLAST|Len|"A"', "CREATE%0ALAST%7CLen%7C%22A%22"),
    (tx.percent_encode, "a b*c~d+é", "a%20b%2Ac~d%2B%C3%A9"),
    (tx.sanitize_taxon, "voacanga africana", "Voacanga africana"),
    (tx.sanitize_taxon, "VOACANGA africana", "Voacanga africana"),
    (tx.sanitize_taxon, "__gentiana_lutea__", "Gentiana lutea"),
    (tx.sanitize_taxon, "gentiana LUTEA", "Gentiana LUTEA"),
    (tx.canonical_taxon, "  fIcticia   IMAGINARIA ", "Ficticia imaginaria"),
    (tx.taxon_key, "  Gentiana lutea  ", "gentiana lutea"),
    (tx.taxon_key, "  ", None),
    (tx.taxon_key, "ÉLAN", "Élan"),
    (tx.taxon_input, "", None),
    (tx.taxon_input, "*", "*"),
    (tx.taxon_input, "q12345", "Q12345"),
    (tx.taxon_input, "Q", "lookup"),
    (tx.taxon_input, "Gentiana lutea", "lookup"),
    (tx.non_blank_lines, " a \r\n\n b ", ["a", "b"]),
    (tx.non_blank_lines, " \n ", None),
    (tx.escape_quotes, 'a\\b"c', 'a\\\\b\\"c'),
    (tx.depict_url, "C C", tx.DEPICT_HEAD + "C%20C" + tx.DEPICT_TAIL),
    (tx.depict_url, "C\nC", None),
    (ch.formula_digits, "C₆H₁₂O₆", "C6H12O6"),
    (ch.formula_subscripts, "C8H10N4O2", "C₈H₁₀N₄O₂"),
    (ch.formula_tokens, "C₆H12 O6", "|C6|H12|O6"),
    (ch.formula_from_inchi, "InChI=1S/C8H10N4O2/c1-10-4", "C8H10N4O2"),
    (ch.formula_from_inchi, "InChI=1S//c1", None),
    (ch.formula_from_inchi, "1S/C8", None),
    (ch.has_stereo, "C/C=C\\C", True),
    (ch.has_stereo, "CCO", False),
    (ch.structure_kind, " ", "empty"),
    (ch.structure_kind, "CCO", "smiles"),
    (ch.structure_kind, "x V2000\nm  end", "molfile_v2000"),
    (ch.structure_kind, "BEGIN CTAB\nM  END", "molfile_v3000"),
    (ch.normalize_structure, " C\rC ", "C\nC"),
    (ch.normalize_structure, " V2000\r\nM  END ", " V2000\nM  END "),
    (ch.json_number, '{"a":{"exact_molecular_weight": 46.04186}}', 46.04186),
    (ch.json_number, '{"a":[{"x":1},{"exact_molecular_weight":180.06339, "y":2}]}', 180.06339),
    (ch.json_number, '{"exact_molecular_weight": "1,234.5678"}', 1234.5678),
    (ch.json_number, '{"other": 1}', None),
]


@pytest.mark.parametrize("function, value, expected", CASES)
def test_vectors(evaluate, function, value, expected):
    assert evaluate(function, value) == expected


@pytest.mark.parametrize(
    "formula, counts",
    [
        ("C10H12ClN", {"C": 10, "H": 12, "Cl": 1, "N": 1, "O": 0}),
        ("C2H5OC3H5", {"C": 3, "H": 5, "O": 1}),
        ("C6H5O-", {"O": 0, "C": 6}),
        ("CH4", {"C": 1, "H": 4, "Cl": 0}),
        (None, {"C": 0}),
    ],
)
def test_element_counts(evaluate, formula, counts):
    for symbol, n in counts.items():
        assert evaluate(lambda c: ch.element_count(ch.formula_tokens(c), symbol), formula) == n


def test_row_key(spark):
    row = spark.sql("SELECT ' CCO ' s, '  Voacanga africana ' t, 'https://doi.org/10.1000/abc' d, string(NULL) n")
    key = row.select(tx.row_key(F.col("s"), F.col("t"), F.col("d")), tx.row_key(F.col("s"), F.col("n"), F.col("n")))
    assert list(key.first()) == ["CCO\tvoacanga africana\t10.1000/ABC", "CCO\t\t"]


def test_numbers(evaluate):
    assert evaluate(lambda c: tx.mass_statement(F.lit("LAST"), c), 495.20268, "double") == "LAST|P2067|+495.202680U483261"
    assert evaluate(lambda c: tx.format_mass(c, 5), 1.5, "double") == "1.50000"
    assert evaluate(tx.format_mass, None, "double") == "n/a"
    assert evaluate(tx.plain_number, 920.0, "double") == "920"
    assert evaluate(tx.plain_number, 920.5, "double") == "920.5"
    assert evaluate(lambda c: tx.display_name(c, F.lit("Q1")), "  Alpha  ") == "Alpha"
    assert evaluate(lambda c: tx.display_name(c, F.lit("Q1")), " ") == "Q1"
