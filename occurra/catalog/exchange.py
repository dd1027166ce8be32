"""Files in and out: each query writes whole tables to scratch and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from occurra.catalog.graph import occ
from occurra.catalog.registry import query, s_clean, s_doi_key, s_formula, s_trim
from occurra.catalog.search import CTES, FLAGSHIP, _dedup_sql
from occurra.functions import text as tx
from occurra.model import RESULT_ROW
from occurra.operators.stats import DIGEST_BUCKETS
from occurra.operators.occurrences import enrich, result_rows
from occurra.plans.search import search
from occurra.session import scratch_path
from occurra.sinks import files, rdf
from occurra.sinks.metadata import dataset_metadata
from occurra.sources import candidates as cand
from occurra.sources import results as res
from occurra.sources import star

# a raw result table as an endpoint would send it: URIs, typed numbers, dates
_RAW = """
SELECT CASE WHEN s % 3 = 0 THEN 'http://www.wikidata.org/entity/' || compound_qid WHEN s % 3 = 1 THEN substr(compound_qid, 2)
ELSE '"' || substr(compound_qid, 2) || '"^^<http://www.w3.org/2001/XMLSchema#integer>' END AS compound,
' ' || name || ' ' AS "compoundLabel", inchikey AS compound_inchikey,
CASE WHEN s % 2 = 0 THEN smiles ELSE ' ' END AS compound_smiles_iso, smiles AS compound_smiles_conn,
CASE WHEN s % 11 = 0 THEN '5d' ELSE cast(mass AS string) END AS compound_mass, formula AS compound_formula,
taxon_qid AS taxon, taxon_name, CASE WHEN s % 7 = 0 THEN 'none' ELSE reference_qid END AS ref_qid, ref_title,
CASE WHEN s % 2 = 0 THEN 'https://doi.org/' || ref_doi ELSE ref_doi END AS ref_doi,
cast(pub_year AS string) || '-01-02T00:00:00Z' AS ref_date,
'http://www.wikidata.org/entity/statement/' || statement AS statement
FROM (SELECT *, length(statement) + coalesce(length(ref_title), 0) AS s FROM {all_rows}) x"""

_NORMAL = """
SELECT compound_qid, name, inchikey, smiles, CASE WHEN s % 11 = 0 THEN NULL ELSE mass END AS mass, formula, taxon_qid, taxon_name,
CASE WHEN s % 7 = 0 THEN NULL ELSE reference_qid END AS reference_qid, ref_title, ref_doi, pub_year, statement
FROM (SELECT *, length(statement) + coalesce(length(ref_title), 0) AS s FROM {all_rows}) x"""


def _raw_results(spark, folder):
    rows = result_rows(enrich(occ(spark, folder)))
    return spark.sql(_RAW.replace("{all_rows}", "{r}").replace('"compoundLabel"', "compoundLabel"), r=rows)


@query("normalize_rows", _NORMAL, CTES)
def normalize_rows(spark, folder):
    return res.normalize_result_rows(_raw_results(spark, folder))


@query("results_csv_roundtrip", _NORMAL, CTES)
def results_csv_roundtrip(spark, folder):
    """Columns in another order, one unknown; missing ones are covered by tests."""
    path = scratch_path(spark, "results-csv")
    raw = _raw_results(spark, folder)
    shuffled = raw.select(F.lit("extra").alias("unknown"), *reversed(raw.columns))
    files.write_results_csv(shuffled, path)
    return res.read_results_csv(spark, path)


@query(
    "taxon_csv",
    "SELECT t AS qid, name FROM {taxon_names} WHERE t NOT LIKE '%5'",
)
def taxon_csv(spark, folder):
    path = scratch_path(spark, "taxon-csv")
    raw = star.view(spark, folder, "taxon_names").select(
        F.when(F.col("t").like("%5"), "").otherwise(F.concat(F.lit(tx.ENTITY), "t")).alias("taxon"),
        F.col("name").alias("taxon_name"),
    )
    files.write_results_csv(raw, path)
    return res.read_taxon_csv(spark, path)


@query(
    "sparql_json_bindings",
    """SELECT r, t AS taxon, CASE WHEN length(r) % 2 = 0 THEN NULL ELSE c END AS compound FROM {statements}""",
)
def sparql_json_bindings(spark, folder):
    """One JSON document per statement, so documents grow with the table."""
    doc = F.concat(
        F.lit('{"head":{},"results":{"bindings":[{"taxon":{"type":"uri","value":"'),
        "t",
        F.lit('"}'),
        F.when(F.length("r") % 2 == 0, "").otherwise(F.concat(F.lit(',"compound":{"value":"'), "c", F.lit('"}'))),
        F.lit("}]}}"),
    )
    docs = star.view(spark, folder, "statements").select("r", doc.alias("doc"))
    return res.parse_sparql_json(docs, "doc", ["taxon", "compound"])


@query(
    "sparql_json_ask",
    "SELECT event_id, event_id % 3 = 0 AS answer FROM {events}",
)
def sparql_json_ask(spark, folder):
    doc = (
        F.when(F.col("event_id") % 3 == 0, '{"boolean":true}')
        .when(F.col("event_id") % 3 == 1, '{"boolean":false}')
        .otherwise("{}")
    )
    events = star.table(spark, folder, "events").select("event_id", doc.alias("doc"))
    return res.parse_sparql_ask(events, "doc").select("event_id", "answer")


_CELL = "coalesce(translate({x}, chr(9) || chr(13) || chr(10), '   '), '')"


def _cell(x: str) -> str:
    return _CELL.replace("{x}", s_trim(x))


@query(
    "curation_tsv",
    f"""SELECT cast(seq AS string) AS seq, {s_clean('name')} AS name, {s_clean('smiles')} AS smiles, {s_clean('taxon')} AS taxon,
{s_doi_key('doi')} AS doi FROM {{candidates}} WHERE seq % 10 <> 3""",
)
def curation_tsv(spark, folder):
    path = scratch_path(spark, "curation-tsv")
    raw = star.view(spark, folder, "candidates").select(
        "seq",
        F.when(F.col("seq") % 10 == 3, " ").otherwise(F.col("name")).alias(" Name "),
        F.col("smiles").alias("SMILES"),
        F.col("taxon").alias("Organism"),
        F.col("doi").alias("DOI"),
    )
    raw.write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")
    return cand.read_curation_tsv(spark, path)


@query(
    "curation_json",
    """SELECT seq, 0 AS pos, name, smiles, taxon, doi FROM {candidates} WHERE seq % 5 <> 1
UNION ALL SELECT seq, 1, 'second ' || name, smiles, NULL, NULL FROM {candidates} WHERE seq % 5 <> 1""",
)
def curation_json(spark, folder):
    """A JSON array per candidate; one in five is cut off and gives nothing."""
    both = F.array(
        F.struct("name", "smiles", "taxon", "doi"),
        F.struct(
            F.concat(F.lit("second "), "name").alias("name"),
            "smiles",
            F.lit(None).cast("string").alias("taxon"),
            F.lit(None).cast("string").alias("doi"),
        ),
    )
    text = F.to_json(both)
    broken = F.when(F.col("seq") % 5 == 1, F.substr(text, F.lit(1), F.length(text) - 9)).otherwise(text)
    docs = star.view(spark, folder, "candidates").select("seq", broken.alias("doc"))
    return cand.read_curation_json(docs, "doc")


@query("export_csv", "SELECT * FROM {all_rows}", CTES)
def export_csv(spark, folder):
    path = scratch_path(spark, "export-csv")
    files.write_results_csv(result_rows(enrich(occ(spark, folder))), path, gzip=True)
    return spark.read.schema(RESULT_ROW).csv(path, header=True, escape='"')


@query("export_json", "SELECT * FROM {all_rows}", CTES)
def export_json(spark, folder):
    path = scratch_path(spark, "export-json")
    files.write_results_json(result_rows(enrich(occ(spark, folder))), path, gzip=True)
    return spark.read.schema(RESULT_ROW).json(path)


@query(
    "export_by_format",
    "SELECT 'csv' AS kind, * FROM {flagship_rows} UNION ALL SELECT 'json', * FROM {flagship_rows}",
    CTES,
)
def export_by_format(spark, folder):
    """The flagship search by format name; the RDF file is read by ``export_ntriples``."""
    found = search(spark, star.graph(spark, folder), FLAGSHIP)
    target = scratch_path(spark, "exports")
    csv = files.export(found.matches, found.all_rows, " CSV", target, "2025 flag/ship: csv", gzip=True)
    json = files.export(found.matches, found.all_rows, "ndjson", target, "flagship")
    read = spark.read.schema(RESULT_ROW)
    return read.csv(csv, header=True, escape='"').select(F.lit("csv").alias("kind"), "*").unionAll(
        read.json(json).select(F.lit("json").alias("kind"), "*")
    )


def _iri(prefix: str, x: str) -> str:
    return f"'<{prefix}' || {x} || '>'"


def _lit(x: str) -> str:
    return f"""'"' || replace(replace({x}, '\\', '\\\\'), '"', '\\"') || '"'"""


_C, _T = _iri(rdf.ENTITY, "c"), _iri(rdf.ENTITY, "t")
_S, _REF, _R = _iri(rdf.STATEMENT, "statement"), _iri(rdf.REFERENCE, "ref"), _iri(rdf.ENTITY, "r")
_PATTERNS = [
    (_C, f"{rdf.DIRECT}P235", _lit("inchikey")),
    (_C, f"{rdf.DIRECT}P233", _lit("smiles_conn")),
    (_C, f"{rdf.DIRECT}P2017", _lit("smiles_iso")),
    (_C, f"{rdf.DIRECT}P2067", f"""'"' || cast(mass AS varchar) || '"^^<{rdf.XSD}double>'"""),
    (_C, f"{rdf.DIRECT}P274", _lit(s_formula("formula_raw"))),
    (_C, rdf.LABEL, _lit("label") + " || '@' || label_lang"),
    (_C, f"{rdf.NODE}P703", _S),
    (_S, f"{rdf.VALUE}P703", _T),
    (_S, rdf.DERIVED_FROM, _REF),
    (_REF, f"{rdf.REF_VALUE}P248", _R),
    (_T, f"{rdf.DIRECT}P225", _lit("taxon_name")),
    (_R, f"{rdf.DIRECT}P1476", _lit("ref_title")),
    (_R, f"{rdf.DIRECT}P356", _lit("ref_doi")),
    (_R, f"{rdf.DIRECT}P577", f"""'"' || strftime(ref_date, '%Y-%m-%dT%H:%M:%SZ') || '"^^<{rdf.XSD}dateTime>'"""),
]
_RDF_SQL = " UNION ".join(
    f"SELECT {s} AS s, '<{p}>' AS p, {o} AS o FROM {{enriched}} WHERE {o} IS NOT NULL" for s, p, o in _PATTERNS
)


@query(
    "rdf_triples",
    _RDF_SQL,
    CTES,
)
def rdf_triples(spark, folder):
    return rdf.to_triples(enrich(occ(spark, folder)))


@query(
    "export_ntriples",
    f"SELECT s || ' ' || p || ' ' || o || ' .' AS line FROM ({_RDF_SQL}) x",
    CTES,
)
def export_ntriples(spark, folder):
    path = scratch_path(spark, "ntriples")
    rdf.write_ntriples(rdf.to_triples(enrich(occ(spark, folder))), path, gzip=True)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "curation_tsv_out",
    f"SELECT {_cell('name')} AS name, {_cell('smiles')} AS smiles, {_cell('taxon')} AS taxon, {_cell('doi')} AS doi FROM {{candidates}}",
)
def curation_tsv_out(spark, folder):
    path = scratch_path(spark, "curation-tsv-out")
    files.write_curation_tsv(star.view(spark, folder, "candidates"), path)
    back = spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)
    return back.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in back.columns])


@query(
    "metadata_full_hash",
    f"""SELECT count(*) AS records, (SELECT 'urn:hash:sha256:' || sha256(coalesce(string_agg(digest, '|' ORDER BY bucket), '')) FROM
(SELECT bucket, sha256(string_agg(id, '|' ORDER BY id)) AS digest FROM
(SELECT id, ('0x' || substr(sha256(id), 1, 8))::bigint % {DIGEST_BUCKETS} AS bucket
FROM (SELECT DISTINCT compound_qid AS id FROM {{flagship_rows}}) i) b GROUP BY bucket) d) AS uri FROM {{flagship_rows}}""",
    CTES,
)
def metadata_full_hash(spark, folder):
    """The hash in the document is of all records it counts, also where the displayed rows are cut."""
    result = search(spark, star.graph(spark, folder), FLAGSHIP, limit=3)
    document = dataset_metadata(
        result.stats,
        FLAGSHIP,
        result.taxon.qid,
        result.query_hash.first()[0],
        result.result_digest.first()[0],
        "2025-01-01T00:00:00Z",
    )
    return document.select(
        F.get_json_object("metadata", "$.numberOfRecords").cast("bigint").alias("records"),
        F.get_json_object("metadata", "$.provenance.dataset_uri").alias("uri"),
    )


@query(
    "metadata_json",
    f"""SELECT 'Dataset' AS kind, 'Occurrence data — q10' AS name, n AS records, 'Q10' AS taxon_qid, 905.0::double AS mass_min,
'required' AS chlorine, 'urn:hash:sha256:' || h AS uri, 12 AS n_variables FROM
(SELECT count(*) AS n FROM {{flagship_rows}}) a, (SELECT sha256(coalesce(string_agg(id, '|' ORDER BY id), '')) AS h FROM
(SELECT DISTINCT compound_qid AS id FROM ({_dedup_sql('{flagship_rows}')}) d) i) b""",
    CTES,
)
def metadata_json(spark, folder):
    """The document of the flagship search, read back field by field."""
    result = search(spark, star.graph(spark, folder), FLAGSHIP)
    document = dataset_metadata(
        result.stats,
        FLAGSHIP,
        result.taxon.qid,
        result.query_hash.first()[0],
        result.result_hash.first()[0],
        "2025-01-01T00:00:00Z",
    )

    def at(path: str):
        return F.get_json_object("metadata", path)

    return document.select(
        at("$['@type']").alias("kind"),
        at("$.name").alias("name"),
        at("$.numberOfRecords").cast("bigint").alias("records"),
        at("$.search_parameters.taxon_qid").alias("taxon_qid"),
        at("$.search_parameters.filters.mass.min").cast("double").alias("mass_min"),
        at("$.search_parameters.filters.molecular_formula.halogens.chlorine").alias("chlorine"),
        at("$.provenance.dataset_uri").alias("uri"),
        F.size(F.from_json(at("$.variablesMeasured"), "array<string>")).alias("n_variables"),
    )
