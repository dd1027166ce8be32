import hashlib

import pytest
from pyspark.sql import functions as F

from occurra.model import Criteria
from occurra.operators import requests as rq

YEAR = 2025


@pytest.fixture
def request_row(spark):
    def make(**values):
        types = {**rq.REQUEST_COLUMNS}
        return spark.sql("SELECT 1 AS id").select(
            "id", *[F.lit(v).cast(types[k]).alias(k) for k, v in values.items()]
        )

    return make


def test_normalize(request_row):
    run = lambda **v: rq.normalize_requests(request_row(**v), YEAR).first()
    assert run(c_min=50, c_max=10)["error"] == "element_min_above_max"
    assert run(threshold=0.0)["error"] == "threshold_not_positive"
    assert run(threshold=2.0)["threshold"] == 1.0
    assert run(threshold=0.01)["threshold"] == 0.05
    plain = run()
    assert (plain["error"], plain["threshold"], plain["mass_max"], plain["year_max"]) == (None, 0.8, 10000.0, YEAR)
    assert plain["formula_enabled"] is False and plain["taxon"] == ""
    assert run(mass_min=-5.0, mass_max=-7.0)["mass_max"] == 0.0
    assert run(mass_min=500.0, mass_max=100.0)["mass_max"] == 500.0
    assert run(year_min=2000, year_max=1990)["year_max"] == 2000
    assert run(cl_state="nonsense")["cl_state"] == "allowed"
    assert run(cl_state="allowed")["formula_enabled"] is True
    assert run(formula_exact="  ")["formula_enabled"] is False


@pytest.mark.parametrize(
    "values, fault",
    [
        ({"taxon": "x" * 501}, "TaxonTooLong"),
        ({"taxon": "é" * 251}, "TaxonTooLong"),
        ({"taxon": "x" * 500}, None),
        ({}, "EmptyInput"),
        ({"smiles": "d"}, "EmptyInput"),
        ({"smiles": "C"}, None),
        ({"smiles": "C" * 10001}, "StructureTooLong"),
        ({"taxon": "a", "year_min": 2025, "year_max": 2020}, "YearRangeInvalid"),
        ({"taxon": "a", "year_min": 1500}, "YearOutOfRange"),
        ({"taxon": "a", "mass_min": 5.0, "mass_max": 1.0}, "MassRangeInvalid"),
        ({"taxon": "a", "mass_min": 20000.0, "mass_max": 1.0}, "MassOutOfRange"),
        ({"taxon": "a", "c_min": 600, "h_min": 600}, "ElementCountTooHigh"),
        ({"smiles": "C", "search_type": "similarity", "threshold": 0.0}, "SimilarityThresholdInvalid"),
        ({"formula_exact": "C6"}, None),
    ],
)
def test_validate(request_row, values, fault):
    assert rq.validate_criteria(rq.fill_defaults(request_row(**values), YEAR), YEAR).first()["fault"] == fault


def encode(request_row, **values):
    return rq.encode_share_params(rq.fill_defaults(request_row(**values), YEAR), YEAR).first()["share_params"]


def test_encode(request_row):
    assert encode(request_row) is None
    assert encode(request_row, taxon="Gentiana lutea") == "?taxon=Gentiana%20lutea"
    text = encode(request_row, smiles="C=O", search_type="similarity", threshold=0.75, mass_min=100.5, c_max=25, cl_state="required")
    assert text == (
        "?structure=C%3DO&structure_search_type=similarity&smiles_threshold=0.75&mass_filter=true&mass_min=100.5"
        "&mass_max=10000&formula_filter=true&c_max=25&cl_state=required"
    )


def decode(spark, query):
    df = spark.sql("SELECT 1").select(F.lit(f"https://example.org/x?{query}").alias("url"))
    return rq.decode_share_params(df, "url", YEAR).first()


def test_decode(spark):
    row = decode(spark, "taxon=*&formula_filter=YES&c_min=15&c_max=25&f_state=required&br_state=excluded&i_state=Required")
    assert (row["taxon"], row["formula_enabled"], row["c_min"], row["c_max"]) == ("*", True, 15, 25)
    assert (row["f_state"], row["br_state"], row["i_state"]) == ("required", "excluded", "allowed")
    assert decode(spark, "structure=CCO")["taxon"] == ""
    assert decode(spark, "smiles=CCO")["smiles"] == "CCO"
    assert decode(spark, "structure=C&smiles=N")["smiles"] == "C"
    assert decode(spark, "structure=CCO&taxon")["taxon"] == ""
    assert decode(spark, "taxon=a&taxon=b+c")["taxon"] == "b c"
    assert decode(spark, "t%61xon=Rosa%20x")["taxon"] == "Rosa x"
    assert decode(spark, "x=1")["taxon"] == "Gentiana lutea"
    assert decode(spark, "mass_min=5")["mass_min"] == 0.0
    assert decode(spark, "mass_filter=1&mass_min=5&mass_max=x")["mass_min"] == 5.0
    assert decode(spark, "mass_filter=1&mass_max=5d")["mass_max"] == 10000.0
    assert decode(spark, "year_filter=on&year_start=70000&year_end=1999")["year_min"] == 1800
    for text, value in [("0", 0.8), ("-1", 0.8), ("NaN", 0.8), ("7", 1.0), ("0.001", 0.05), ("0.5", 0.5)]:
        assert decode(spark, f"smiles_threshold={text}")["threshold"] == value


def test_malformed_url_gives_defaults(spark):
    df = spark.sql("SELECT 'http://[bad url?taxon=x' AS url UNION ALL SELECT NULL")
    assert {r["taxon"] for r in rq.decode_share_params(df, "url", YEAR).collect()} == {"Gentiana lutea"}


def test_round_trip(spark, request_row):
    values = dict(taxon="*", c_min=15, c_max=25, o_min=2, o_max=8, f_state="required", br_state="excluded")
    first = rq.fill_defaults(request_row(**values), YEAR)
    link = rq.encode_share_params(first, YEAR).select(F.concat(F.lit("https://e.org/"), "share_params").alias("url"))
    again = rq.decode_share_params(link, "url", YEAR).first()
    before = first.first()
    assert all(again[c] == before[c] for c in rq.CRITERIA_COLUMNS)


def test_export_name(request_row):
    def name(ext="csv", **v):
        return rq.export_name(rq.fill_defaults(request_row(**v), YEAR), ext, "20250102", YEAR).first()["export_name"]

    assert name("rdf", taxon="*", smiles="C", search_type="similarity").endswith("_all_taxa_similarity_filtered.rdf")
    assert name() == "20250102_occurrences_any_taxon.csv"
    assert name(taxon=' a/b\\c:d*?"<>|') == "20250102_occurrences_a_b_c_dstar.csv"
    assert name(taxon="x", mass_min=3.0) == "20250102_occurrences_x_filtered.csv"


def test_query_hash(spark):
    table = rq.criteria_table(spark, Criteria(taxon=" Rosa ", mass_min=5.0), None)
    source = "*|Rosa|taxon= Rosa &mass_filter=true&mass_min=5&mass_max=10000"
    assert rq.query_hash(table).first()["query_hash"] == hashlib.sha256(source.encode()).hexdigest()
    bare = rq.criteria_table(spark, Criteria(taxon=""), "Q5")
    assert rq.query_hash(bare).first()["query_hash"] == hashlib.sha256(b"Q5|").hexdigest()
