"""A graph, curation candidates and search requests derived from a star schema.

``VIEWS`` holds one SELECT per table, with ``{table}`` placeholders for its
inputs, in the SQL both Spark and DuckDB accept
(``fingerprints`` differs in its list functions), so the same text feeds the
queries and their reference SQL.
"""

from __future__ import annotations

from dataclasses import fields
from functools import lru_cache
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from occurra.model import Graph

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

_INCHIKEY = (
    "concat(upper(substr(md5(cast({k} AS string)), 1, 14)), '-', "
    "upper(substr(md5(cast({k} AS string)), 15, 10)), '-N')"
)

VIEWS: dict[str, str] = {
    "taxon_parent": """
SELECT concat('Q', 1000 + s_suppkey) AS child, concat('Q', 100 + s_nationkey) AS parent FROM {supplier}
UNION ALL SELECT concat('Q', 100 + n_nationkey), concat('Q', 10 + n_regionkey) FROM {nation}
UNION ALL SELECT concat('Q', 10 + r_regionkey), 'Q1' FROM {region}
UNION ALL SELECT concat('Q', 1000 + s_suppkey), concat('Q', 10 + s_suppkey % 5) FROM {supplier} WHERE s_suppkey % 8 = 0""",
    "taxon_names": """
SELECT concat('Q', 1000 + s_suppkey) AS t, s_name AS name FROM {supplier}
UNION ALL SELECT concat('Q', 100 + n_nationkey), n_name FROM {nation}
UNION ALL SELECT concat('Q', 10 + r_regionkey), r_name FROM {region}
UNION ALL SELECT 'Q1', 'Biota'""",
    "instance_of": "SELECT t FROM {taxon_names} WHERE t NOT LIKE '%7'",
    "compound_ids": f"""
SELECT concat('Q', 1000000 + p_partkey) AS c, {_INCHIKEY.format(k="p_partkey")} AS inchikey,
concat(repeat('C', cast(1 + p_partkey % 12 AS int)), 'O') AS smiles_conn FROM {{part}}""",
    "statements": """
SELECT concat('S', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS statement,
concat('Q', 1000000 + l_partkey) AS c, concat('Q', 1000 + l_suppkey) AS t,
concat('R', l_orderkey, '-', l_linenumber) AS ref, concat('Q', 2000000 + l_orderkey) AS r FROM {lineitem}
UNION ALL SELECT concat('D', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey),
concat('Q', 1000000 + l_partkey), concat('Q', 1000 + l_suppkey),
concat('R', l_orderkey, '-', l_linenumber), concat('Q', 2000000 + l_orderkey) FROM {lineitem} WHERE l_linenumber = 1""",
    "mass": """
SELECT concat('Q', 1000000 + p_partkey) AS c, p_retailprice AS v FROM {part} WHERE p_partkey % 11 <> 0
UNION ALL SELECT concat('Q', 1000000 + p_partkey), p_retailprice + 0.5 FROM {part} WHERE p_partkey % 10 = 0""",
    "formula_raw": """
SELECT c, CASE WHEN k % 2 = 0 THEN translate(f, '0123456789', '₀₁₂₃₄₅₆₇₈₉') ELSE f END AS v FROM (
SELECT p_partkey AS k, concat('Q', 1000000 + p_partkey) AS c,
concat('C', 1 + p_partkey % 40, 'H', 2 + p_partkey % 60, CASE WHEN p_partkey % 5 = 0 THEN 'Cl2' ELSE '' END,
CASE WHEN p_partkey % 3 = 0 THEN concat('N', 1 + p_partkey % 4) ELSE '' END,
CASE WHEN p_partkey % 8 = 0 THEN ' O' ELSE concat('O', 1 + p_partkey % 9) END,
CASE WHEN p_partkey % 19 = 0 THEN '-' ELSE '' END) AS f FROM {part} WHERE p_partkey % 7 <> 0) x""",
    "compound_labels": """
SELECT concat('Q', 1000000 + p_partkey) AS c, p_name AS v, 'en' AS lang FROM {part} WHERE p_partkey % 4 <> 0
UNION ALL SELECT concat('Q', 1000000 + p_partkey), concat(p_name, ' ', p_brand), 'mul' FROM {part} WHERE p_partkey % 6 = 0
UNION ALL SELECT concat('Q', 1000000 + p_partkey), lower(p_brand), 'fr' FROM {part}""",
    "smiles_iso": """
SELECT concat('Q', 1000000 + p_partkey) AS c, concat('C[C@H](N)', repeat('C', cast(1 + p_partkey % 12 AS int))) AS v
FROM {part} WHERE p_partkey % 9 = 0""",
    "inchi": "SELECT c, concat('InChI=1S/', v, '/c1') AS v FROM {formula_raw} WHERE c LIKE '%1' OR c LIKE '%3'",
    "ref_title": """
SELECT concat('Q', 2000000 + o_orderkey) AS r, concat(o_orderpriority, ' #', o_orderkey) AS v
FROM {orders} WHERE o_orderkey % 13 <> 0""",
    "ref_doi": """
SELECT concat('Q', 2000000 + o_orderkey) AS r, concat('10.1000/ORD.', o_orderkey) AS v
FROM {orders} WHERE o_orderkey % 4 <> 0""",
    "ref_date": """
SELECT concat('Q', 2000000 + o_orderkey) AS r, o_orderdate AS v FROM {orders} WHERE o_orderkey % 17 <> 0""",
    "candidates": """
SELECT event_id AS seq, concat('cand ', event_id) AS name, concat(' ', repeat('C', cast(1 + user_id % 12 AS int)), 'O') AS smiles,
CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN concat('nation_', event_id % 30)
WHEN 'view' THEN concat(' NATION_', event_id % 25, ' ')
ELSE concat('Supplier#', lpad(cast(event_id % 120 AS string), 9, '0')) END AS taxon,
CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN concat('https://doi.org/10.1000/ord.', event_id % 200)
ELSE concat('10.1000/ORD.', event_id % 200) END AS doi FROM {events}""",
    # candidates with the values a structure converter and a citation service
    # would supply; some compounds are in the graph, some are not
    "converted": f"""
SELECT seq, name, smiles, taxon, doi, ltrim(smiles) AS canonical_smiles,
CASE WHEN k % 9 = 1 THEN concat('C[C@H](N)', ltrim(smiles)) ELSE ltrim(smiles) END AS isomeric_smiles,
CASE WHEN k % 5 = 0 THEN 'InChI=1S//c1' ELSE concat('InChI=1S/C', 1 + k % 40, 'H', 2 + k % 60, 'O', 1 + k % 9, '/c1') END AS inchi,
{_INCHIKEY.format(k="k")} AS inchikey,
CASE WHEN k % 6 = 0 THEN NULL ELSE 100 + k * 0.25e0 END AS exact_mass,
CASE WHEN k % 6 = 0 THEN 'mass unavailable' END AS mass_warning,
k % 4 = 0 AS undefined_stereo,
CASE WHEN seq % 50 = 0 THEN concat('conversion failed for "', ltrim(smiles), '"') END AS conversion_error,
CASE WHEN doi IS NOT NULL AND seq % 7 = 0 THEN concat('CREATE|', upper(doi)) END AS reference_lines
FROM (SELECT *, (seq * 7) % 2500 AS k FROM {{candidates}}) x""",
    # spellings that the text functions must cope with
    "texts": """
SELECT event_id AS id,
CASE event_id % 9 WHEN 0 THEN concat('http://www.wikidata.org/entity/Q', event_id)
WHEN 1 THEN concat('"', event_id, '"^^<http://www.w3.org/2001/XMLSchema#integer>') WHEN 2 THEN concat('Q', event_id)
WHEN 3 THEN 'not-a-qid' WHEN 4 THEN concat(' Q', event_id, chr(9)) WHEN 5 THEN ''
WHEN 6 THEN concat('https://www.wikidata.org/entity/Q', event_id, 'x') WHEN 7 THEN cast(event_id AS string) END AS qid_raw,
CASE event_id % 8 WHEN 0 THEN concat('https://doi.org/10.1000/AbC.', event_id) WHEN 1 THEN concat(' 10.1/x', event_id, chr(10))
WHEN 2 THEN concat('HTTP://DX.DOI.ORG/10.2/é', event_id) WHEN 3 THEN 'https://doi.org/' WHEN 4 THEN '  '
WHEN 5 THEN concat('doi.org/a/doi.org/B', event_id) WHEN 7 THEN '10.5/Z' END AS doi_raw,
CASE event_id % 8 WHEN 0 THEN concat(1900 + event_id % 120, '-04-23T00:00:00Z') WHEN 1 THEN cast(1990 + event_id % 30 AS string)
WHEN 2 THEN '-0044-03-15' WHEN 3 THEN '99999-01-01' WHEN 4 THEN 'T' WHEN 5 THEN ' 2001T10' WHEN 6 THEN 'abc-1' END AS year_raw,
CASE event_id % 7 WHEN 0 THEN 'voacanga africana' WHEN 1 THEN concat('VOACANGA  Africana ', event_id) WHEN 2 THEN '__gentiana_lutea__'
WHEN 3 THEN '  ' WHEN 4 THEN concat('éLAN Vital', chr(9), 'X') WHEN 5 THEN 'rosa' END AS name_raw,
CASE event_id % 5 WHEN 0 THEN concat('http://www.wikidata.org/entity/statement/Q', event_id, '-ABC') WHEN 1 THEN concat(' Q', event_id, '-X ')
WHEN 2 THEN 'http://www.wikidata.org/entity/statement/' WHEN 3 THEN '' END AS statement_raw,
CASE event_id % 9 WHEN 0 THEN 'C[C@H](N)O' WHEN 1 THEN concat('C/C=C', chr(92), 'C') WHEN 2 THEN ' CCO ' WHEN 3 THEN ''
WHEN 4 THEN concat(' x', chr(13), chr(10), 'v2000', chr(13), 'm  end ') WHEN 5 THEN concat('begin ctab', chr(10), 'M  END')
WHEN 6 THEN concat('CC', chr(13), 'OC') WHEN 7 THEN 'C=O(*)~%' END AS smiles_raw,
concat('K', event_id, '-MID-N') AS key_raw
FROM {events}""",
    # free-form search requests with gaps, bad ranges and odd spellings
    "requests": """
SELECT event_id AS req_id,
CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN '*' WHEN 'view' THEN concat(' nation_', event_id % 30, ' ')
WHEN 'signup' THEN concat('q', 10 + event_id % 5) ELSE repeat('Taxon/a:b?', cast(event_id % 60 AS int)) END AS taxon,
CASE event_id % 6 WHEN 0 THEN concat(repeat('C', cast(1 + user_id % 9 AS int)), '=O') WHEN 1 THEN 'd' WHEN 2 THEN ' ' ELSE NULL END AS smiles,
CASE event_id % 5 WHEN 0 THEN 'similarity' WHEN 1 THEN 'substructure' END AS search_type,
CASE WHEN event_id % 4 = 1 THEN NULL ELSE cast(event_id % 27 - 1 AS double) / 16 END AS threshold,
CASE WHEN event_id % 3 = 0 THEN cast(event_id % 40 - 4 AS double) * 50.25e0 END AS mass_min,
CASE WHEN event_id % 7 < 3 THEN cast(event_id % 50 AS double) * 45.5e0 END AS mass_max,
CASE WHEN event_id % 5 = 2 THEN 1590 + event_id % 450 END AS year_min,
CASE WHEN event_id % 4 = 2 THEN 1700 + event_id % 340 END AS year_max,
CASE WHEN event_id % 9 = 4 THEN concat(' C₆H', event_id % 30, 'O ') END AS formula_exact,
CASE WHEN event_id % 8 = 3 THEN event_id % 900 END AS c_min,
CASE WHEN event_id % 11 = 5 THEN event_id % 600 END AS c_max,
CASE WHEN event_id % 10 = 3 THEN event_id % 1000 END AS h_min,
CASE WHEN event_id % 13 = 1 THEN event_id % 70 END AS o_max,
CASE WHEN event_id % 12 = 7 THEN 1 + event_id % 5 END AS s_min,
CASE event_id % 14 WHEN 1 THEN 'required' WHEN 2 THEN 'excluded' WHEN 3 THEN 'allowed' WHEN 4 THEN 'Required' END AS cl_state,
CASE WHEN event_id % 15 = 1 THEN 'excluded' END AS br_state
FROM {events}""",
}

FINGERPRINTS_SPARK = (
    "SELECT concat('Q', 1000000 + vec_id) AS c, "
    "filter(transform(embedding, (x, i) -> IF(x > 0, i, -1)), i -> i >= 0) AS bits FROM {embeddings}"
)
FINGERPRINTS_DUCKDB = (
    "SELECT concat('Q', 1000000 + vec_id) AS c, "
    "list_filter(list_transform(embedding, lambda x, i: CASE WHEN x > 0 THEN i - 1 ELSE -1 END), "
    "lambda i: i >= 0) AS bits FROM {embeddings}"
)
FINGERPRINT_BITS = 64


def inputs_of(sql: str) -> list[str]:
    """Names of the placeholders of ``sql``, each once, in order."""
    return list(dict.fromkeys(name for _, name, _, _ in Formatter().parse(sql) if name))


# large tables and the key that spreads them evenly
SPREAD_KEYS = {
    "lineitem": ("l_orderkey", "l_linenumber", "l_partkey"),
    "orders": ("o_orderkey",),
    "events": ("event_id",),
    "documents": ("doc_id",),
    "embeddings": ("vec_id",),
}


@lru_cache(maxsize=512)
def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A source table; the plan is kept, so footers are read once per session.

    A file cannot be read by more tasks than it has row groups. A table with
    fewer of these than the cluster has cores is spread after the scan, so
    that the joins after it use every core; a large table never needs it.
    """
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD_KEYS and df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores, *SPREAD_KEYS[name])
    return df


@lru_cache(maxsize=512)
def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived (or source) table as a DataFrame."""
    if name in SOURCE_TABLES:
        return table(spark, folder, name)
    return run_sql(spark, folder, FINGERPRINTS_SPARK if name == "fingerprints" else VIEWS[name])


def run_sql(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{name: view(spark, folder, name) for name in inputs_of(sql)})


def graph(spark: SparkSession, folder: str) -> Graph:
    names = [f.name for f in fields(Graph)]
    return Graph(
        **{n: view(spark, folder, "compound_labels" if n == "labels" else n) for n in names}
    )


def duckdb_sql(sql: str, ctes: dict[str, str] | None = None) -> str:
    """``sql`` with every placeholder view it needs put in front as a CTE.

    ``ctes`` adds or replaces views for this one statement.
    """
    views = {**VIEWS, "fingerprints": FINGERPRINTS_DUCKDB, **(ctes or {})}
    ordered: dict[str, str] = {}

    def visit(text: str) -> None:
        for name in inputs_of(text):
            if name in views and name not in ordered:
                visit(views[name])
                ordered[name] = views[name]

    visit(sql)
    plain = {name: name for name in [*views, *SOURCE_TABLES]}
    parts = [f"{name} AS ({text.format(**plain)})" for name, text in ordered.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {sql.format(**plain)}" if parts else sql.format(**plain)
