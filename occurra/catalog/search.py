"""Searches: flagship, counters, hashes, ordering and paging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from occurra.catalog.graph import PATTERN, _HITS, occ
from occurra.catalog.registry import (
    BASE_CTES,
    ENTRY_ORDER_SQL,
    RESULT_COLUMNS,
    STATS_SQL,
    query,
    s_count,
    s_row_key,
    s_tokens,
)
from occurra.model import ROW_LIMIT_DEFAULT, Criteria
from occurra.operators import ordering, stats
from occurra.operators.counting import counters
from occurra.operators.digests import DigestTree
from occurra.operators.filters import apply_filters, filter_year
from occurra.operators.merging import dedup_candidates
from occurra.operators.occurrences import Occurrences, enrich, result_rows
from occurra.plans.requests import request_counters, resolve_requests, search_requests
from occurra.plans.search import COMPOUND, ENTRY_ORDER, search
from occurra.session import cut_lineage, scratch_path
from occurra.sources import star

FLAGSHIP = Criteria(
    taxon=" q10 ",
    mass_min=905.0,
    mass_max=990.0,
    year_min=1996,
    year_max=1999,
    formula_enabled=True,
    halogens={"Cl": "required"},
)
CLADE = Criteria(taxon="Q10")
NAMED = Criteria(taxon="__biota", formula_enabled=True, elements={"C": (5, 20)}, formula_exact="")

_BY_MASS_YEAR = "mass BETWEEN 920 AND 990 AND year(ref_date) BETWEEN 1996 AND 1999"
_FLAGSHIP_RANGES = _BY_MASS_YEAR.replace("920", "905")
_IN_CLADE = "t IN (SELECT t FROM {closure})"

CTES = {
    **BASE_CTES,
    "clade_rows": f"SELECT {RESULT_COLUMNS} FROM {{enriched}} WHERE {_IN_CLADE}",
    "flagship_rows": f"SELECT {RESULT_COLUMNS} FROM {{enriched}} WHERE {_IN_CLADE} AND {_FLAGSHIP_RANGES} "
    f"AND formula_raw IS NOT NULL AND {s_count(s_tokens('formula_raw'), 'Cl')} > 0",
    "named_rows": f"SELECT {RESULT_COLUMNS} FROM {{enriched}} WHERE formula_raw IS NOT NULL "
    f"AND {s_count(s_tokens('formula_raw'), 'C')} BETWEEN 5 AND 20",
    "mass_year_rows": f"SELECT {RESULT_COLUMNS} FROM {{enriched}} WHERE {_IN_CLADE} AND {_BY_MASS_YEAR}",
    "all_rows": f"SELECT {RESULT_COLUMNS} FROM {{enriched}}",
}


def _dedup_sql(source: str) -> str:
    return (
        f"SELECT * EXCLUDE (o) FROM (SELECT *, row_number() OVER (PARTITION BY compound_qid, coalesce(taxon_qid, ''), "
        f"coalesce(reference_qid, '') ORDER BY {ENTRY_ORDER_SQL}) AS o FROM {source}) d WHERE o = 1"
    )


def _order() -> list:
    return [F.col(c).asc_nulls_first() for c in ENTRY_ORDER]


@query("search_flagship", _dedup_sql("{flagship_rows}"), CTES)
def search_flagship(spark, folder):
    return search(spark, star.graph(spark, folder), FLAGSHIP).rows


@query("search_by_name", _dedup_sql("{named_rows}"), CTES)
def search_by_name(spark, folder):
    return search(spark, star.graph(spark, folder), NAMED).rows


@query(
    "search_structure",
    _dedup_sql("{structure_rows}"),
    {
        **CTES,
        "hits": _HITS,
        "structure_rows": f"SELECT {RESULT_COLUMNS} FROM {{enriched}} WHERE c IN (SELECT c FROM {{hits}}) AND {_IN_CLADE} "
        "AND mass BETWEEN 900 AND 2000",
    },
)
def search_structure(spark, folder):
    criteria = Criteria(taxon="Q10", smiles="CCO", mass_min=900.0, mass_max=2000.0)
    return search(spark, star.graph(spark, folder), criteria, query_bits=PATTERN).rows


@query("search_unlimited", _dedup_sql("{all_rows}"), CTES)
def search_unlimited(spark, folder):
    """All taxa, no filter, no limit: every entry of the graph."""
    return search(spark, star.graph(spark, folder), Criteria(taxon="*")).rows


# one request per supplier, nation and region, by id, by name or for all taxa, each with bounds of its own
_REQUESTS = """
SELECT concat('s', s_suppkey) AS req_id, CASE WHEN s_suppkey % 2 = 0 THEN concat('q', 1000 + s_suppkey) ELSE s_name END AS taxon,
CASE WHEN s_suppkey % 3 = 0 THEN 905.25e0 + s_suppkey % 50 END AS mass_min, CASE WHEN s_suppkey % 4 = 0 THEN 1993 END AS year_min,
CASE WHEN s_suppkey % 5 = 0 THEN 1996 END AS year_max, CASE WHEN s_suppkey % 7 = 0 THEN 8 END AS c_min,
CASE WHEN s_suppkey % 6 = 1 THEN 'required' END AS cl_state FROM {supplier}
UNION ALL SELECT concat('n', n_nationkey), concat('no such ', n_name), CAST(NULL AS double), CAST(NULL AS int), CAST(NULL AS int), CAST(NULL AS int), NULL FROM {nation}
UNION ALL SELECT concat('m', n_nationkey), CASE WHEN n_nationkey % 2 = 0 THEN concat('Q', 100 + n_nationkey) ELSE '*' END, 1000e0 + n_nationkey, CAST(NULL AS int),
CAST(NULL AS int), 5, 'excluded' FROM {nation}
UNION ALL SELECT concat('a', r_regionkey), '*', CAST(NULL AS double), CASE WHEN r_regionkey > 0 THEN 1993 + r_regionkey END,
CASE WHEN r_regionkey > 2 THEN 1993 + r_regionkey END, CAST(NULL AS int), NULL FROM {region}
UNION ALL SELECT concat('f', r_regionkey), '*', CAST(NULL AS double), CAST(NULL AS int), CASE WHEN r_regionkey % 2 = 0 THEN 1995 END, 10 * r_regionkey, 'required' FROM {region}"""
_WANTED = f"""SELECT q.*, CASE WHEN taxon LIKE 'q%' THEN upper(taxon) WHEN taxon LIKE 'Q%' THEN taxon ELSE n.t END AS root
FROM {{asked_requests}} q LEFT JOIN (SELECT name, 'Q' || min(cast(substr(t, 2) AS bigint)) AS t FROM {{taxon_names}} GROUP BY name) n
ON n.name = upper(left(q.taxon, 1)) || lower(substr(q.taxon, 2))"""
_CLADES = """SELECT DISTINCT root, root AS t FROM {wanted} WHERE root IS NOT NULL
UNION SELECT clades.root, p.child FROM {taxon_parent} p JOIN clades ON p.parent = clades.t"""
_TOKENS = s_tokens("formula_raw")
_MET = "e.c, e.t, e.r, e.statement, e.mass, e.ref_date, e.formula_raw"
_FOUND = f"""SELECT * FROM (
SELECT q.*, {_MET} FROM {{wanted}} q JOIN {{clades}} k ON k.root = q.root JOIN {{enriched}} e ON e.t = k.t
UNION ALL SELECT q.*, {_MET} FROM {{wanted}} q JOIN {{enriched}} e ON q.taxon = '*') e
WHERE (mass_min IS NULL OR mass >= mass_min AND mass <= 10000)
AND (year_min IS NULL AND year_max IS NULL OR year(ref_date) >= coalesce(year_min, 1800) AND (year_max IS NULL OR year(ref_date) <= year_max))
AND (c_min IS NULL AND cl_state IS NULL OR formula_raw IS NOT NULL AND {s_count(_TOKENS, 'C')} BETWEEN coalesce(c_min, 0) AND 512
AND CASE cl_state WHEN 'required' THEN {s_count(_TOKENS, 'Cl')} > 0 WHEN 'excluded' THEN {s_count(_TOKENS, 'Cl')} = 0 ELSE true END)"""
_REQUEST_CTES = {**CTES, "asked_requests": _REQUESTS, "wanted": _WANTED, "clades": _CLADES, "request_rows": _FOUND}
_PER_REQUEST = (
    "req_id, count(*) AS n_rows, count(DISTINCT c) AS n_compounds, min(statement) AS first_statement, "
    "cast(sum(cast(mass AS decimal(18, 3))) AS double) AS total_mass"
)


def _per_request(rows):
    return rows.groupBy("req_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("compound_qid").alias("n_compounds"),
        F.min("statement").alias("first_statement"),
        F.sum(F.col("mass").cast("decimal(18, 3)")).cast("double").alias("total_mass"),
    )


@query("search_requests", f"SELECT {_PER_REQUEST} FROM {{request_rows}} GROUP BY req_id", _REQUEST_CTES)
def search_requests_query(spark, folder):
    requests = star.run_sql(spark, folder, _REQUESTS)
    # the year of the requests lies before the last publications: it is no bound of its own
    rows, _ = search_requests(Occurrences(star.graph(spark, folder)), requests, 1997)
    return _per_request(rows)


@query(
    "request_answers",
    """SELECT q.req_id, coalesce(n_entries, 0) AS n_entries, coalesce(n_entries_unique, 0) AS n_entries_unique, coalesce(n_compounds, 0) AS n_compounds,
coalesce(n_taxa, 0) AS n_taxa, coalesce(n_references, 0) AS n_references, least(coalesce(n_entries_unique, 0), 500) AS n_returned,
coalesce(n_entries_unique, 0) > 500 AS capped, CASE WHEN q.taxon <> '*' AND q.root IS NULL THEN 'TaxonNotFound' END AS fault
FROM {wanted} q LEFT JOIN (SELECT req_id, count(*) AS n_entries, count(DISTINCT concat(c, chr(31), t, chr(31), coalesce(r, ''))) AS n_entries_unique,
count(DISTINCT c) AS n_compounds, count(DISTINCT t) AS n_taxa, count(DISTINCT r) AS n_references FROM {request_rows} GROUP BY req_id) n ON n.req_id = q.req_id""",
    _REQUEST_CTES,
)
def request_answers(spark, folder):
    """What a service says beside the rows of each request, with its default limit."""
    requests = star.run_sql(spark, folder, _REQUESTS)
    rows, resolved = search_requests(Occurrences(star.graph(spark, folder)), requests, 1997)
    return request_counters(rows, resolved, 1997, limit=ROW_LIMIT_DEFAULT).drop("query_hash", "note")


@query(
    "request_faults",
    """SELECT req_id, root AS t, CASE WHEN root IS NULL AND taxon <> '*' THEN 'TaxonNotFound' END AS fault FROM {wanted}""",
    _REQUEST_CTES,
)
def request_faults(spark, folder):
    requests = star.run_sql(spark, folder, _REQUESTS)
    return resolve_requests(requests, Occurrences(star.graph(spark, folder)), 1997).select("req_id", "t", "fault")


# one structure per supplier: a stored fingerprint or its first bits, in a clade, in all taxa or anywhere
_ASKED_STRUCTURES = """SELECT concat('s', s_suppkey) AS req_id,
CASE s_suppkey % 4 WHEN 0 THEN concat('Q', 10 + s_suppkey % 5) WHEN 1 THEN '' WHEN 2 THEN s_name ELSE 'Q1' END AS taxon,
CASE WHEN s_suppkey % 11 = 0 THEN concat('CCO', chr(10), 'CCN') ELSE 'CCO' END AS smiles,
CASE WHEN s_suppkey % 3 = 0 THEN 'similarity' ELSE 'substructure' END AS search_type, 0.3e0 + 0.0625e0 * (s_suppkey % 6) AS threshold,
CASE WHEN s_suppkey % 5 = 0 THEN 905e0 + s_suppkey % 50 END AS mass_min, CASE WHEN s_suppkey % 7 = 0 THEN 1995 END AS year_min,
CASE WHEN s_suppkey % 3 = 0 THEN f.bits ELSE {head} END AS query_bits
FROM {supplier} JOIN {fingerprints} f ON f.c = concat('Q', 1000000 + s_suppkey)"""
_STRUCTURE_HITS = """SELECT q.*, f.c FROM {asked_structures} q JOIN {fingerprints} f ON CASE
WHEN search_type = 'similarity' AND smiles = 'CCO' THEN len(list_intersect(f.bits, q.query_bits))::double /
(len(f.bits) + len(q.query_bits) - len(list_intersect(f.bits, q.query_bits)))::double >= q.threshold
ELSE list_has_all(f.bits, q.query_bits) END"""
_STRUCTURE_CLADES = """SELECT DISTINCT x.root, x.root AS t FROM (SELECT CASE WHEN q.taxon LIKE 'Q%' THEN q.taxon ELSE n.t END AS root
FROM {asked_structures} q LEFT JOIN {taxon_names} n ON n.name = q.taxon WHERE q.taxon <> '') x
UNION SELECT structure_clades.root, p.child FROM {taxon_parent} p JOIN structure_clades ON p.parent = structure_clades.t"""


@query(
    "search_requests_structure",
    f"""SELECT {_PER_REQUEST} FROM (
SELECT h.*, e.statement, e.mass, e.ref_date FROM {{structure_hits}} h LEFT JOIN {{taxon_names}} n ON n.name = h.taxon
JOIN {{structure_clades}} k ON k.root = CASE WHEN h.taxon LIKE 'Q%' THEN h.taxon ELSE n.t END JOIN {{enriched}} e ON e.c = h.c AND e.t = k.t WHERE h.taxon <> ''
UNION ALL SELECT h.*, e.statement, e.mass, e.ref_date FROM {{structure_hits}} h JOIN {{enriched}} e ON e.c = h.c WHERE h.taxon = ''
UNION ALL SELECT h.*, NULL, m.v, NULL FROM {{structure_hits}} h JOIN {{compound_ids}} i ON i.c = h.c LEFT JOIN {{mass}} m ON m.c = h.c
WHERE h.taxon = '' AND h.c NOT IN (SELECT c FROM {{core}})) x
WHERE (mass_min IS NULL OR mass >= mass_min AND mass <= 10000) AND (year_min IS NULL OR year(ref_date) >= year_min) GROUP BY req_id""",
    {
        **CTES,
        "asked_structures": _ASKED_STRUCTURES.replace("{head}", "f.bits[1:6]"),
        "structure_hits": _STRUCTURE_HITS,
        "structure_clades": _STRUCTURE_CLADES,
    },
)
def search_requests_structure(spark, folder):
    requests = star.run_sql(spark, folder, _ASKED_STRUCTURES.replace("{head}", "slice(f.bits, 1, 6)"))
    found, _ = search_requests(Occurrences(star.graph(spark, folder)), requests, 2025, n_bits=star.FINGERPRINT_BITS, by_compound=True)
    return found.groupBy("req_id").agg(
        F.sum("n_rows").alias("n_rows"),
        F.count("compound_qid").alias("n_compounds"),
        F.min("first_statement").alias("first_statement"),
        F.sum("total_mass").cast("double").alias("total_mass"),
    )


@query(
    "filter_year_open",
    "SELECT r, cast(v AS varchar) AS ref_date FROM {ref_date} WHERE year(v) >= 1996",
)
def filter_year_open(spark, folder):
    """A lower bound alone cuts nothing above."""
    dates = star.view(spark, folder, "ref_date").withColumnRenamed("v", "ref_date")
    return filter_year(dates, 1996).select("r", F.col("ref_date").cast("string"))


@query(
    "filter_combined",
    f"SELECT {RESULT_COLUMNS} FROM {{enriched}} WHERE {_FLAGSHIP_RANGES} AND formula_raw IS NOT NULL "
    f"AND {s_count(s_tokens('formula_raw'), 'Cl')} > 0",
    CTES,
)
def filter_combined(spark, folder):
    return result_rows(apply_filters(enrich(occ(spark, folder)), FLAGSHIP))


@query("dataset_stats", STATS_SQL + "{all_rows}", CTES)
def dataset_stats(spark, folder):
    return counters(occ(spark, folder))


@query("clade_stats", STATS_SQL + "{clade_rows}", CTES)
def clade_stats(spark, folder):
    return search(spark, star.graph(spark, folder), CLADE).counted


@query("flagship_stats", STATS_SQL + "{flagship_rows}", CTES)
def flagship_stats(spark, folder):
    """Counters under bounds on clade, mass, year and formula."""
    return search(spark, star.graph(spark, folder), FLAGSHIP).counted


@query("dataset_stats_rows", STATS_SQL + "{all_rows}", CTES)
def dataset_stats_rows(spark, folder):
    """The same counters from the rows, as for rows that come from a file."""
    return stats.dataset_stats(result_rows(enrich(occ(spark, folder))))


@query(
    "stats_from_rows",
    STATS_SQL + f"({_dedup_sql('{clade_rows}')}) d",
    CTES,
)
def stats_from_rows(spark, folder):
    return stats.stats_from_rows(search(spark, star.graph(spark, folder), CLADE).rows)


@query(
    "capped_rows",
    f"SELECT * FROM ({_dedup_sql('{clade_rows}')}) d ORDER BY compound_qid, taxon_qid, reference_qid, {ENTRY_ORDER_SQL} LIMIT 1000",
    CTES,
)
def capped_rows(spark, folder):
    return search(spark, star.graph(spark, folder), CLADE, limit=1000).rows


@query(
    "capped_stats",
    f"SELECT *, least(n_entries_unique, 1000) AS n_returned, n_entries_unique > 1000 AS capped FROM ({STATS_SQL} {{clade_rows}}) s",
    CTES,
)
def capped_stats(spark, folder):
    return search(spark, star.graph(spark, folder), CLADE, limit=1000).stats


@query("dedup_entries", _dedup_sql("{all_rows}"), CTES)
def dedup_entries(spark, folder):
    return stats.dedup_entries(result_rows(enrich(occ(spark, folder))), _order(), COMPOUND)


@query(
    "result_hash",
    "SELECT sha256(coalesce(string_agg(id, '|' ORDER BY id), '')) AS result_hash FROM (SELECT DISTINCT compound_qid AS id FROM {mass_year_rows}) i",
    CTES,
)
def result_hash(spark, folder):
    criteria = Criteria(taxon="Q10", mass_min=920.0, mass_max=990.0, year_min=1996, year_max=1999)
    return search(spark, star.graph(spark, folder), criteria).result_hash


_DIGEST_SQL = f"""SELECT sha256(coalesce(string_agg(digest, '|' ORDER BY bucket), '')) AS result_digest FROM
(SELECT bucket, sha256(string_agg(id, '|' ORDER BY id)) AS digest FROM
(SELECT id, ('0x' || substr(sha256(id), 1, 8))::bigint % {stats.DIGEST_BUCKETS} AS bucket
FROM (SELECT DISTINCT c AS id FROM {{statements}}) i) b GROUP BY bucket) d"""


@query("result_digest", _DIGEST_SQL)
def result_digest(spark, folder):
    return stats.result_digest(star.view(spark, folder, "statements"), "c")


@query("result_digest_added", _DIGEST_SQL)
def result_digest_added(spark, folder):
    """The same digest when the statements of other taxa come first and those of the clade are added to them."""
    statements, clade = star.view(spark, folder, "statements"), cut_lineage(occ(spark, folder).descendants("Q10").select("t"), "clade")
    tree = DigestTree(spark, scratch_path(spark, "digest_tree"))
    tree.write(statements.join(clade, "t", "left_anti"), "c")
    tree.add(statements.join(clade, "t", "left_semi"), 1, "c")
    return tree.digest(1)


# ---- sorting and paging -----------------------------------------------------


def _clade_entries(spark, folder):
    rows = search(spark, star.graph(spark, folder), CLADE).all_rows
    return stats.dedup_entries(rows, _order(), COMPOUND)


def _entries(spark, folder):
    return stats.dedup_entries(result_rows(enrich(occ(spark, folder))), _order(), COMPOUND)


def _placed(rows):
    """Sorted rows, stored, with their place in the order: file by file, row by row."""
    path = scratch_path(rows.sparkSession, "sorted")
    rows.select("statement").write.parquet(path)
    stored = rows.sparkSession.read.parquet(path).select(
        "statement", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at")
    )
    sizes = stored.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("file", before.alias("before"))
    # one row per file: the stored rows stay where they are
    return stored.join(F.broadcast(offsets), "file").select("statement", (F.col("before") + F.col("at") + 1).alias("place"))


def _placed_sql(order: str) -> str:
    return f"SELECT statement, row_number() OVER (ORDER BY {order}) AS place FROM ({_dedup_sql('{all_rows}')}) d"


@query("sort_name", _placed_sql("name NULLS FIRST, statement NULLS FIRST"), CTES)
def sort_name(spark, folder):
    """Every row with its place, so that the order itself is compared."""
    return _placed(ordering.sort_rows(_entries(spark, folder), "name"))


@query("sort_mass", _placed_sql("mass NULLS FIRST, statement NULLS FIRST"), CTES)
def sort_mass(spark, folder):
    return _placed(ordering.sort_rows(_entries(spark, folder), "mass"))


@query("sort_mass_desc", _placed_sql("mass DESC NULLS LAST, statement DESC NULLS LAST"), CTES)
def sort_mass_desc(spark, folder):
    return _placed(ordering.sort_rows(_entries(spark, folder), "mass", "desc"))


@query(
    "top_rows",
    f"SELECT * FROM ({_dedup_sql('{clade_rows}')}) d ORDER BY statement LIMIT 500",
    CTES,
)
def top_rows(spark, folder):
    return stats.limit_rows(_clade_entries(spark, folder), ROW_LIMIT_DEFAULT, [F.col("statement").asc()])


@query(
    "page_rows",
    f"SELECT * FROM ({_dedup_sql('{clade_rows}')}) d ORDER BY mass ASC NULLS FIRST, statement ASC LIMIT 70 OFFSET 190",
    CTES,
)
def page_rows(spark, folder):
    order = ordering.sort_order("mass", "asc", "statement")
    return ordering.page(_clade_entries(spark, folder), order, first=200, size=50, overscan=10)


@query(
    "page_after",
    "SELECT * FROM {compound_ids} WHERE c > 'Q1000100' ORDER BY c LIMIT 80",
)
def page_after(spark, folder):
    return ordering.page_after(star.view(spark, folder, "compound_ids"), "c", "Q1000100", 80)


@query(
    "curation_dedup",
    "SELECT seq, name, smiles, taxon, doi, key FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS o FROM {keyed}) k WHERE o = 1",
    {"keyed": f"SELECT *, {s_row_key()} AS key FROM {{candidates}}"},
)
def curation_dedup(spark, folder):
    return dedup_candidates(star.view(spark, folder, "candidates")).select(
        "seq", "name", "smiles", "taxon", "doi", "key"
    )
