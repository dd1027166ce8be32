import json
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from occurra.model import Criteria
from occurra.operators.stats import capped_stats
from occurra.sinks import files, rdf
from occurra.sinks.metadata import dataset_metadata
from occurra.sources import candidates as cand
from occurra.sources import results as res


def test_results_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_bytes(
        b"taxon,compound,extra,compoundLabel,ref_qid,ref_title,compound_mass,ref_doi\n"
        b'http://www.wikidata.org/entity/Q10,"""5""^^<x#integer>",z, Name ,7,"two\nlines ""q""",5.5,https://doi.org/10.1/a\n'
        b"Q11,Q6\n"
        b"Q11,,no compound\n"
        b"Q12,Q7,x,bad \xff bytes,1,t,1d,,too,many\n"
    )
    rows = res.read_results_csv(spark, str(path)).orderBy("compound_qid").collect()
    assert [r["compound_qid"] for r in rows] == ["Q5", "Q6", "Q7"]
    first = rows[0]
    assert (first["taxon_qid"], first["name"], first["reference_qid"]) == ("Q10", "Name", "Q7")
    assert (first["ref_title"], first["mass"], first["ref_doi"]) == ('two\nlines "q"', 5.5, "10.1/a")
    assert first["inchikey"] is None and first["statement"] is None
    assert rows[1]["taxon_qid"] == "Q11" and rows[1]["name"] is None
    assert rows[2]["name"] is None and rows[2]["mass"] is None


def test_taxon_csv(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('taxon,taxon_name\nhttp://www.wikidata.org/entity/Q1,Rosa\n"""2""^^<x>",Lutea\n,Nobody\nQ3,\n')
    assert sorted(tuple(r) for r in res.read_taxon_csv(spark, str(path)).collect()) == [("Q1", "Rosa"), ("Q2", "Lutea")]


def test_sparql_json(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps({"results": {"bindings": [{"a": {"value": "1"}}, {"b": {"type": "x", "value": "2"}}]}}, indent=1))
    rows = res.read_sparql_json(spark, str(path), ["a", "b"]).collect()
    assert [tuple(r) for r in rows] == [("1", None), (None, "2")]
    asks = spark.createDataFrame([('{"boolean": true}',), ("{}",), ("oops",)], "doc string")
    assert [r["answer"] for r in res.parse_sparql_ask(asks, "doc").collect()] == [True, False, False]


def test_curation_tsv(spark, tmp_path):
    path = tmp_path / "c.tsv"
    path.write_text(
        "DOI\t Name \tSMILES\tOrganism\n"
        "https://doi.org/10.1/x\tA \"q\"\tCCO\tRosa\n"
        "\n"
        "10.2/y\t \tCCN\tRosa\n"
        "\tB\tCCN\n"
    )
    rows = cand.read_curation_tsv(spark, str(path)).select("name", "smiles", "taxon", "doi").collect()
    assert [tuple(r) for r in rows] == [('A "q"', "CCO", "Rosa", "10.1/X"), ("B", "CCN", None, None)]
    bad = tmp_path / "bad.tsv"
    bad.write_text("name\tdoi\nA\tB\n")
    with pytest.raises(cand.MissingColumn):
        cand.read_curation_tsv(spark, str(bad))


def test_curation_json(spark):
    docs = spark.createDataFrame(
        [
            (1, '[{"name":"A","smiles":"C"},{"name":"B","smiles":"N","taxon":"T","doi":"d"}]'),
            (2, "[{oops"),
            (3, '[{"name":"A"}]'),
            (4, "[]"),
            (5, None),
        ],
        "id int, doc string",
    )
    rows = cand.read_curation_json(docs, "doc").orderBy("pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "A", "C", None, None), (1, 1, "B", "N", "T", "d")]


def test_tsv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(
        [("  A\tB\nC\r ", "CCO", None, "10.1/X"), ('q"u', "N", " T ", None)],
        "name string, smiles string, taxon string, doi string",
    )
    assert files.curation_tsv(rows).first()["name"] == "A B C"
    files.write_curation_tsv(rows, str(tmp_path / "out"))
    back = cand.read_curation_tsv(spark, str(tmp_path / "out")).drop("seq").orderBy("name").collect()
    assert [tuple(r) for r in back] == [("A B C", "CCO", None, "10.1/X"), ('q"u', "N", "T", None)]


@pytest.mark.parametrize("name, kind", [("csv", "csv"), ("ndjson", "json"), (" JSON ", "json"), ("RDF", "rdf")])
def test_formats(name, kind):
    assert files.export_format(name) == kind


def test_unknown_format():
    with pytest.raises(ValueError):
        files.export_format("ttl")


def test_triples_are_a_set_without_absent_values(spark):
    schema = (
        "c string, inchikey string, smiles_conn string, smiles_iso string, mass double, formula_raw string, label string, "
        "label_lang string, statement string, t string, ref string, r string, taxon_name string, ref_title string, "
        "ref_doi string, ref_date timestamp"
    )
    row = ("Q1", "K", "C", None, 1.5, "C₂", 'a"b\\c\n', "en", "S1", "Q2", "R1", "Q3", "Rosa", None, None, None)
    alone = ("Q9", "K9", "N", None, None, None, None, None, None, None, None, None, None, None, None, None)
    lines = {tuple(r) for r in rdf.to_triples(spark.createDataFrame([row, row, alone], schema)).collect()}
    assert len(lines) == 10 + 2
    assert (f"<{rdf.ENTITY}Q1>", f"<{rdf.LABEL}>", '"a\\"b\\\\c\\n"@en') in lines
    assert (f"<{rdf.ENTITY}Q1>", f"<{rdf.DIRECT}P274>", '"C2"') in lines
    assert (f"<{rdf.REFERENCE}R1>", f"<{rdf.REF_VALUE}P248>", f"<{rdf.ENTITY}Q3>") in lines


def test_sets_of_triples_are_formed_of_ids(spark):
    schema = (
        "c string, inchikey string, smiles_conn string, smiles_iso string, mass double, formula_raw string, label string, "
        "label_lang string, statement string, t string, ref string, r string, taxon_name string, ref_title string, "
        "ref_doi string, ref_date timestamp"
    )
    day = datetime(2001, 2, 3, 4, 5, 6)
    rows = [
        ("Q1", "K", "C", "I", 1.5, "C₂", "a", "en", "S1", "Q2", "R1", "Q3", "Rosa", "T", "D", day),
        # the same statement with other values, and values that read alike
        ("Q4", "K", "C", None, 2.5, "C2", "a", "en", "S1", "Q5", "R2", "Q3", "Viola", "T", "E", day.replace(microsecond=7)),
        ("Q1", "K", "C", "I", 1.5, "C2", "a", "mul", "S1", "Q2", "R2", "Q3", "Rosa", "U", "D", None),
        (None, "K", None, None, None, None, None, None, "S2", None, "R1", "Q6", None, None, None, None),
        ("Q1", None, None, None, None, None, None, None, None, "Q2", None, "Q3", "Rosa", None, None, None),
    ]
    triples = rdf.to_triples(spark.createDataFrame(rows * 3, schema))
    e, d = (lambda x: f"<{rdf.ENTITY}{x}>"), (lambda p: f"<{rdf.DIRECT}{p}>")
    stamp = f'"2001-02-03T04:05:06Z"^^<{rdf.XSD}dateTime>'
    want = {(e(c), d(p), f'"{v}"') for c in ("Q1", "Q4") for p, v in (("P235", "K"), ("P233", "C"), ("P274", "C2"))}
    want |= {(e("Q1"), d("P2017"), '"I"'), (e("Q3"), d("P1476"), '"T"'), (e("Q3"), d("P1476"), '"U"'), (e("Q3"), d("P577"), stamp)}
    want |= {(e(c), d("P2067"), f'"{m}"^^<{rdf.XSD}double>') for c, m in (("Q1", 1.5), ("Q4", 2.5))}
    want |= {(e(c), f"<{rdf.LABEL}>", f'"a"@{lang}') for c, lang in (("Q1", "en"), ("Q4", "en"), ("Q1", "mul"))}
    want |= {(e("Q3"), d("P356"), f'"{doi}"') for doi in "DE"} | {(e("Q2"), d("P225"), '"Rosa"'), (e("Q5"), d("P225"), '"Viola"')}
    s, node = (lambda x: f"<{rdf.STATEMENT}{x}>"), (lambda x: f"<{rdf.REFERENCE}{x}>")
    want |= {(e(c), f"<{rdf.NODE}P703>", s("S1")) for c in ("Q1", "Q4")} | {(s("S1"), f"<{rdf.VALUE}P703>", e(t)) for t in ("Q2", "Q5")}
    want |= {(s(x), f"<{rdf.DERIVED_FROM}>", node(r)) for x, r in (("S1", "R1"), ("S1", "R2"), ("S2", "R1"))}
    want |= {(node(n), f"<{rdf.REF_VALUE}P248>", e(r)) for n, r in (("R1", "Q3"), ("R2", "Q3"), ("R1", "Q6"))}
    got = [tuple(r) for r in triples.collect()]
    assert len(got) == len(want) and set(got) == want
    # terms of statements are several times as long as their ids: no shuffle, hash table or sort holds them
    plan = triples._jdf.queryExecution().executedPlan().toString()
    keys = {re.sub(r"#\d+", "", line.split("keys=[")[1].split("]")[0]) for line in plan.split("\n") if "Aggregate(keys=[statement#" in line}
    assert keys == {"statement, k, v"}


def test_metadata(spark):
    stats = capped_stats(spark.createDataFrame([("Q1", "t", "r")], "compound_qid string, taxon_qid string, reference_qid string"))
    plain = json.loads(dataset_metadata(stats, Criteria(taxon="Rosa"), "Q5", "qh", "rh", "2025-01-01").first()[0])
    assert plain["@type"] == "Dataset" and plain["numberOfRecords"] == 1
    assert "chemical_search_service" not in plain and "filters" not in plain["search_parameters"]
    assert plain["provenance"]["dataset_uri"] == "urn:hash:sha256:rh"
    asked = Criteria(taxon="", smiles="C\nC", search_type="similarity", mass_min=5.0)
    full = json.loads(dataset_metadata(stats, asked, "*", "qh", "rh", "2025-01-01").first()[0])
    query = full["search_parameters"]["structure_query"]
    assert (query["input_format"], query["query_length"], query["similarity_threshold"]) == ("molfile", 3, 0.8)
    assert full["search_parameters"]["taxon"] == "all taxa" and full["chemical_search_service"]["kind"] == "similarity"
    assert full["search_parameters"]["filters"]["mass"] == {"min": 5.0, "max": 10000.0}


def test_gzip_export(spark, tmp_path):
    df = spark.range(5).select(F.col("id").cast("string").alias("name"))
    files.write_results_csv(df, str(tmp_path / "c"), gzip=True)
    files.write_results_json(df, str(tmp_path / "j"), gzip=True)
    assert list((tmp_path / "c").glob("*.csv.gz")) and list((tmp_path / "j").glob("*.json.gz"))


def test_texts_are_trimmed_once(spark):
    raw = spark.createDataFrame([(" Q5 ",)], "compound string")
    plain = res.normalize_result_rows(raw.select("compound", *[F.col("compound").alias(h) for h in res.RESULT_HEADERS[1:]]))
    text = plain._jdf.queryExecution().optimizedPlan().toString().lower()
    assert text.count("trim") <= 40  # one per text, three more per id, and those of the filter by compound
    assert plain.first()["compound_qid"] == "Q5"


def test_long_terms_are_not_shuffled(spark):
    """Terms are shuffled for compounds and references only, of which there are fewer than rows."""
    schema = (
        "c string, inchikey string, smiles_conn string, smiles_iso string, mass double, formula_raw string, label string, "
        "label_lang string, statement string, t string, ref string, r string, taxon_name string, ref_title string, "
        "ref_doi string, ref_date timestamp"
    )
    plain = ("Q1", "K", "C", None, 1.5, "C2", "a", "en")
    low = ("Q1", "K", "C", None, 1.5, "C₂", "a", "en")
    at = [datetime(2001, 2, 3, 4, 5, 6), datetime(2001, 2, 3, 4, 5, 6, 700)]
    rest = [("S1", "Q2", "R1", "Q3", "Rosa", "T", "10.1/X", d) for d in at] + [("S1", "Q2", "R1", "Q4", "Rosa", None, None, None), ("S1", "Q5", "R2", None, "Tilia", None, None, None)]
    rows = spark.createDataFrame([c + r for c in (plain, low) for r in rest] * 2, schema)
    triples = rdf.to_triples(rows)
    text = triples._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(s#") == 2
    got = [tuple(r) for r in triples.collect()]
    assert len(got) == len(set(got)) == 5 + 5 + 2 + 2 + 3
