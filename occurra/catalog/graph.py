"""Graph tables, closure, core joins, filters, resolution and fingerprints."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.catalog.registry import (
    BASE_CTES,
    query,
    s_canonical,
    s_clean,
    s_count,
    s_doi_key,
    s_formula,
    s_sanitize,
    s_smallest,
    s_taxon_key,
    s_tokens,
)
from occurra.operators import filters, occurrences, resolve, similarity
from occurra.operators.taxonomy import CladeIndex, descendants, descendants_of_each, write_clades
from occurra.plans.search import any_taxon
from occurra.session import scratch_path
from occurra.sources import star
from occurra.sources.triples import graph_tables, graph_triples, write_triples

N_BITS = star.FINGERPRINT_BITS


def occ(spark, folder) -> occurrences.Occurrences:
    return occurrences.Occurrences(star.graph(spark, folder))


# ---- A1, B1 -------------------------------------------------------------

_TABLES = {
    "statements": ("statement", "concat_ws('|', c, t, ref, r)"),
    "compound_ids": ("c", "concat_ws('|', inchikey, smiles_conn)"),
    "taxon_names": ("t", "name"),
    "taxon_parent": ("child", "parent"),
    "instance_of": ("t", "'taxon'"),
    "mass": ("c", "cast(v AS string)"),
    "formula_raw": ("c", "v"),
    "compound_labels": ("c", "concat_ws('@', v, lang)"),
    "smiles_iso": ("c", "v"),
    "inchi": ("c", "v"),
    "ref_title": ("r", "v"),
    "ref_doi": ("r", "v"),
    "ref_date": ("r", "cast(v AS string)"),
}


@query(
    "graph_tables",
    " UNION ALL ".join(
        f"SELECT DISTINCT '{name}' AS tbl, {key} AS k, {value} AS val FROM {{{name}}}"
        for name, (key, value) in _TABLES.items()
    ),
)
def graph_tables_query(spark, folder):
    path = scratch_path(spark, "triples")
    write_triples(graph_triples(star.graph(spark, folder)), path, by_predicate=True)
    tables = graph_tables(spark.read.parquet(path))
    parts = [
        getattr(tables, "labels" if name == "compound_labels" else name).select(
            F.lit(name).alias("tbl"), F.expr(key).alias("k"), F.expr(value).alias("val")
        )
        for name, (key, value) in _TABLES.items()
    ]
    return reduce(DataFrame.unionByName, parts)


# ---- C1 - C4, B2, B3 ------------------------------------------------------


@query("taxon_descendants", "SELECT t FROM {closure}", BASE_CTES)
def taxon_descendants(spark, folder):
    return descendants(star.view(spark, folder, "taxon_parent"), "Q10")


# a lineage of one taxon per event: long chains, with forks, and cycles at their ends
_DEEP = """SELECT concat('E', event_id) AS child, concat('E', event_id - event_id % 500 + greatest(event_id % 500 - 1 - event_id % 3, 0)) AS parent
FROM {events} WHERE event_id % 500 > 0
UNION ALL SELECT concat('E', event_id), concat('E', event_id - 1) FROM {events} WHERE event_id % 500 > 0
UNION ALL SELECT concat('E', event_id), concat('E', event_id + 499) FROM {events} WHERE event_id % 1000 = 0"""
_DEEP_ROOTS = "SELECT DISTINCT concat('E', event_id - event_id % 500 + user_id % 500) AS root FROM {events} WHERE event_id % 500 = 7"
_DEEP_CTES = {
    "deep": _DEEP,
    "deep_roots": _DEEP_ROOTS,
    "deep_clades": "SELECT root, root AS t FROM {deep_roots} UNION SELECT deep_clades.root, p.child FROM {deep} p JOIN deep_clades ON p.parent = deep_clades.t",
}


@query("taxon_descendants_deep", "SELECT root, t FROM {deep_clades}", _DEEP_CTES)
def taxon_descendants_deep(spark, folder):
    return descendants_of_each(star.run_sql(spark, folder, _DEEP), star.run_sql(spark, folder, _DEEP_ROOTS))


@query("taxon_descendants_stored", "SELECT t FROM {closure}", BASE_CTES)
def taxon_descendants_stored(spark, folder):
    path = scratch_path(spark, "lineages")
    write_clades(star.view(spark, folder, "taxon_parent"), path)
    return CladeIndex(spark, path).descendants("Q10")


@query("all_compounds", "SELECT * FROM {core}", BASE_CTES)
def all_compounds(spark, folder):
    return occ(spark, folder).core().select(
        "statement", "c", "t", "ref", "r", "inchikey", "smiles_conn", "taxon_name"
    )


@query(
    "compounds_by_taxon",
    "SELECT k.* FROM {core} k WHERE k.t IN (SELECT t FROM {closure})",
    BASE_CTES,
)
def compounds_by_taxon(spark, folder):
    o = occ(spark, folder)
    clade = descendants(o.graph.taxon_parent, "Q10")
    return o.core(clade=o.clade_names(clade)).select(
        "statement", "c", "t", "ref", "r", "inchikey", "smiles_conn", "taxon_name"
    )


_ENRICHED_COLUMNS = (
    "statement, c, t, ref, r, inchikey, smiles_conn, taxon_name, ref_title, ref_doi, "
    "cast(ref_date AS string) AS ref_date, smiles_iso, mass, formula_raw, label, label_lang"
)


@query("enriched", f"SELECT {_ENRICHED_COLUMNS} FROM {{enriched}}", BASE_CTES)
def enriched(spark, folder):
    return occurrences.enrich(occ(spark, folder)).selectExpr(*_split(_ENRICHED_COLUMNS))


def _split(columns: str) -> list[str]:
    """Column list to expressions; commas inside parentheses stay."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(columns[start:i].strip())
            start = i + 1
    return [*parts, columns[start:].strip()]


@query(
    "project_ids",
    f"""SELECT cast(substr(c, 2) AS bigint) AS compound, label AS "compoundLabel", inchikey AS compound_inchikey,
smiles_conn AS compound_smiles_conn, smiles_iso AS compound_smiles_iso, mass AS compound_mass,
{s_formula('formula_raw')} AS compound_formula, cast(substr(t, 2) AS bigint) AS taxon, taxon_name,
cast(substr(r, 2) AS bigint) AS ref_qid, ref, ref_title, ref_doi,
strftime(ref_date, '%Y-%m-%dT%H:%M:%SZ') AS ref_date, statement FROM {{enriched}}""",
    BASE_CTES,
)
def project_ids(spark, folder):
    return occurrences.project_result(occurrences.enrich(occ(spark, folder)))


@query(
    "label_pick",
    """SELECT coalesce(m.c, e.c) AS c, coalesce(m.v, e.v) AS label, CASE WHEN m.v IS NOT NULL THEN 'mul' ELSE 'en' END AS label_lang
FROM (SELECT * FROM {compound_labels} WHERE lang = 'mul') m FULL JOIN (SELECT * FROM {compound_labels} WHERE lang = 'en') e ON m.c = e.c""",
)
def label_pick(spark, folder):
    return occurrences.pick_label(star.view(spark, folder, "compound_labels"))


# ---- B4 - B12: filters over whole property tables -------------------------


@query("filter_mass", "SELECT c, v AS mass FROM {mass} WHERE v BETWEEN 920 AND 990")
def filter_mass(spark, folder):
    mass = star.view(spark, folder, "mass").withColumnRenamed("v", "mass")
    return filters.filter_mass(mass, 920, 990)


@query(
    "filter_year",
    "SELECT r, cast(v AS string) AS ref_date FROM {ref_date} WHERE year(v) BETWEEN 1996 AND 1999",
)
def filter_year(spark, folder):
    dates = star.view(spark, folder, "ref_date").withColumnRenamed("v", "ref_date")
    return filters.filter_year(dates, 1996, 1999).select("r", F.col("ref_date").cast("string"))


def _formulas(spark, folder):
    return star.view(spark, folder, "compound_ids").select("c").join(
        star.view(spark, folder, "formula_raw").withColumnRenamed("v", "formula_raw"), "c", "left"
    )


_TOKENS = f"(SELECT c, v AS formula_raw, {s_tokens('v')} AS k FROM {{formula_raw}} WHERE v IS NOT NULL) x"


@query(
    "filter_elements",
    f"SELECT c, formula_raw FROM {_TOKENS} WHERE {s_count('k', 'C')} BETWEEN 5 AND 20 AND {s_count('k', 'N')} BETWEEN 0 AND 2",
)
def filter_elements(spark, folder):
    return filters.filter_elements(_formulas(spark, folder), {"C": (5, 20), "H": (0, 1024), "N": (0, 2)})


@query(
    "filter_halogens",
    f"SELECT c, formula_raw FROM {_TOKENS} WHERE {s_count('k', 'Cl')} > 0 AND {s_count('k', 'Br')} = 0",
)
def filter_halogens(spark, folder):
    return filters.filter_halogens(
        _formulas(spark, folder), {"Cl": "required", "Br": "excluded", "F": "allowed", "I": "anything"}
    )


@query(
    "filter_formula_exact",
    f"SELECT c, v AS formula_raw FROM {{formula_raw}} WHERE {s_formula('''replace(v, ' ', '')''')} = 'C11H12Cl2O2'",
)
def filter_formula_exact(spark, folder):
    return filters.filter_formula_exact(_formulas(spark, folder), " C₁₁H₁₂Cl2 O2 ")


# ---- C5 - C8, E1, E2: names and DOIs --------------------------------------


def _names(spark, folder):
    """Free-text names: candidate taxa and taxon names in another spelling."""
    given = star.view(spark, folder, "candidates").select(F.col("taxon").alias("name"))
    other = star.view(spark, folder, "taxon_names").select(
        F.concat(F.lit("__"), F.lower("name"), F.lit("_ ")).alias("name")
    )
    return given.unionByName(other).filter(F.col("name").isNotNull())


_NAMES = (
    "SELECT DISTINCT name AS input FROM (SELECT taxon AS name FROM {candidates} UNION ALL "
    "SELECT '__' || lower(name) || '_ ' FROM {taxon_names}) u WHERE name IS NOT NULL"
)


@query(
    "taxon_search",
    f"SELECT i.input, n.t AS qid, n.name FROM {{inputs}} i JOIN {{taxon_names}} n ON n.name = {s_sanitize('i.input')}",
    {"inputs": _NAMES},
)
def taxon_search(spark, folder):
    return resolve.find_taxa(_names(spark, folder), star.view(spark, folder, "taxon_names"))


def _matches(spark, folder):
    """Candidates per brand: every taxon whose number shares the brand's digits."""
    return star.run_sql(spark, folder, _MATCHES)


# per input name several candidates in a given order, with repeats in other case
_MATCHES = """
SELECT i.input, n.t AS qid, CASE WHEN p.n = 1 THEN n.name ELSE upper(n.name) END AS name,
cast(substr(n.t, 2) AS bigint) * 2 + p.n AS pos
FROM (SELECT DISTINCT concat('nation_', event_id % 30) AS input, event_id % 7 AS k FROM {events}) i
JOIN {taxon_names} n ON cast(substr(n.t, 2) AS bigint) % 30 = i.k
JOIN (SELECT 0 AS n UNION ALL SELECT 1) p ON p.n <= length(i.input) % 2
UNION ALL
SELECT concat('nation_', event_id % 30), concat('Q', 7000 + event_id % 90), concat('Nation_', event_id % 30), event_id % 90
FROM {events} WHERE event_id % 4 = 1
"""

_RANKED = """
SELECT input, arg_min(qid, o) AS qid, arg_min(name, o) AS name, count(*) AS n_matches,
count(*) FILTER (WHERE lower(name) = lower(input)) AS n_exact,
array_to_string(list(name || ' (' || qid || ')' ORDER BY pos, qid)[1:4], '; ') AS candidates
FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY (lower(name) <> lower(input)), pos, qid, name) AS o
FROM (""" + _MATCHES + ") m) x GROUP BY input"


@query("best_match", "SELECT input, qid, name FROM {ranked}", {"ranked": _RANKED})
def best_match(spark, folder):
    return resolve.best_match(_matches(spark, folder))


@query(
    "match_ambiguity",
    """SELECT input, qid AS chosen_qid, name AS chosen_name, candidates FROM {ranked}
WHERE n_exact >= 2 OR (n_exact = 0 AND n_matches >= 2)""",
    {"ranked": _RANKED},
)
def match_ambiguity(spark, folder):
    return resolve.match_warning(_matches(spark, folder)).withColumn(
        "candidates", F.array_join("candidates", "; ")
    )


_TAXA = "SELECT n.t, n.name FROM {taxon_names} n WHERE n.t IN (SELECT t FROM {instance_of})"


@query(
    "resolve_taxa",
    f"""SELECT f.key, {s_smallest('n.t')} AS t FROM (SELECT key, arg_min(name, seq) AS name FROM
(SELECT seq, {s_clean('taxon')} AS name, {s_taxon_key('taxon')} AS key FROM {{candidates}}) k WHERE key IS NOT NULL GROUP BY key) f
JOIN {{taxa}} n ON n.name = f.name GROUP BY f.key""",
    {"taxa": _TAXA},
)
def resolve_taxa(spark, folder):
    g = star.graph(spark, folder)
    return resolve.resolve_taxa(star.view(spark, folder, "candidates"), g.taxon_names, g.instance_of)


@query(
    "resolve_taxa_fallback",
    f"""SELECT name, t FROM (SELECT g.name, n.t, row_number() OVER (PARTITION BY g.name ORDER BY g.pref, cast(substr(n.t, 2) AS bigint)) AS o FROM
(SELECT name, 0 AS pref, name AS tried FROM {{given}} UNION ALL SELECT name, 1, {s_canonical('name')} FROM {{given}}
WHERE {s_canonical('name')} <> name) g JOIN {{taxa}} n ON n.name = g.tried) x WHERE o = 1""",
    {
        "taxa": _TAXA,
        "given": f"SELECT DISTINCT {s_clean('taxon')} AS name FROM (SELECT taxon FROM {{candidates}} UNION ALL SELECT lower(name) FROM {{taxon_names}}) z WHERE {s_clean('taxon')} IS NOT NULL",
    },
)
def resolve_taxa_fallback(spark, folder):
    g = star.graph(spark, folder)
    names = star.view(spark, folder, "candidates").select("taxon").unionByName(
        g.taxon_names.select(F.lower("name").alias("taxon"))
    )
    return resolve.resolve_taxa_fallback(names, g.taxon_names, g.instance_of)


@query(
    "resolve_references",
    f"""SELECT d.key, {s_smallest('s.r')} AS r FROM (SELECT DISTINCT {s_doi_key('doi')} AS key FROM {{candidates}} WHERE doi IS NOT NULL) d
JOIN {{ref_doi}} s ON s.v = d.key GROUP BY d.key""",
)
def resolve_references(spark, folder):
    return resolve.resolve_references(
        star.view(spark, folder, "candidates"), star.view(spark, folder, "ref_doi")
    )


# ---- C13 - C17: structure -------------------------------------------------

QUERY_VECTOR = "SELECT bits FROM {fingerprints} WHERE c = 'Q1000000'"
PATTERN = [1, 2, 5]
_SCORE = (
    "len(list_intersect(f.bits, q.bits))::double / "
    "(len(f.bits) + len(q.bits) - len(list_intersect(f.bits, q.bits)))::double"
)


def query_bits(spark, folder) -> list[int]:
    """The structure asked for: one stored fingerprint."""
    return star.view(spark, folder, "fingerprints").filter(F.col("c") == "Q1000000").first()["bits"]


@query(
    "tanimoto_search",
    f"SELECT f.c, {_SCORE} AS similarity FROM {{fingerprints}} f, ({QUERY_VECTOR}) q WHERE {_SCORE} >= 0.4",
)
def tanimoto_search(spark, folder):
    prints = star.view(spark, folder, "fingerprints")
    return similarity.similar(prints, query_bits(spark, folder), 0.4, N_BITS)


_GROUPS = "SELECT list_sort(bits) AS bits, min(c) AS rep, count(*) AS n FROM {fingerprints} GROUP BY 1"


@query(
    "tanimoto_pairs",
    f"""SELECT f.rep AS a, q.rep AS b, {_SCORE} AS similarity, f.n AS n_a, q.n AS n_b
FROM {{groups}} f JOIN {{groups}} q ON f.rep < q.rep WHERE {_SCORE} >= 0.6""",
    {"groups": _GROUPS},
)
def tanimoto_pairs(spark, folder):
    return similarity.similar_pairs(star.view(spark, folder, "fingerprints"), 0.6, N_BITS)


@query(
    "fingerprint_members",
    "SELECT g.rep, f.c FROM {fingerprints} f JOIN {groups} g ON list_sort(f.bits) = g.bits",
    {"groups": _GROUPS},
)
def fingerprint_members(spark, folder):
    return similarity.fingerprint_members(star.view(spark, folder, "fingerprints"))


@query(
    "substructure_screen",
    f"SELECT c FROM {{fingerprints}} WHERE list_has_all(bits, {PATTERN})",
)
def substructure_screen(spark, folder):
    return similarity.substructure_screen(star.view(spark, folder, "fingerprints"), PATTERN, N_BITS)


_HITS = f"SELECT DISTINCT c FROM {{fingerprints}} WHERE list_has_all(bits, {PATTERN})"


@query(
    "structure_in_clade",
    """SELECT k.statement, k.c, k.t, k.r FROM {core} k WHERE k.c IN (SELECT c FROM {hits})
AND k.t IN (SELECT t FROM {closure})""",
    {**BASE_CTES, "hits": _HITS},
)
def structure_in_clade(spark, folder):
    o = occ(spark, folder)
    hits = similarity.substructure_screen(o.graph.fingerprints, PATTERN, N_BITS).distinct()
    ids = o.graph.compound_ids.join(hits, "c", "left_semi")
    clade = descendants(o.graph.taxon_parent, "Q10")
    return o.core(o.in_clade(o.graph.statements, clade), ids).select("statement", "c", "t", "r")


# a graph that names only the taxa of one nation, so that some compounds occur nowhere
_ONE_NATION = "SELECT 'Q103' AS t UNION SELECT p.child FROM {taxon_parent} p JOIN nation_clade ON p.parent = nation_clade.t"


@query(
    "structure_any_taxon",
    """SELECT i.c, i.inchikey, b.statement, b.t, b.r, b.taxon_name FROM {compound_ids} i JOIN {hits} h ON i.c = h.c
LEFT JOIN (SELECT * FROM {core} WHERE t IN (SELECT t FROM {nation_clade})) b ON i.c = b.c""",
    {**BASE_CTES, "hits": _HITS, "nation_clade": _ONE_NATION},
)
def structure_any_taxon(spark, folder):
    g = star.graph(spark, folder)
    named = g.taxon_names.join(descendants(g.taxon_parent, "Q103"), "t", "left_semi")
    hits = similarity.substructure_screen(g.fingerprints, PATTERN, N_BITS).distinct()
    # only identifiers are asked for, so the compound table has no properties
    ids = g.compound_ids.join(hits, "c", "left_semi")
    rows = any_taxon(occurrences.Occurrences(replace(g, taxon_names=named)), ids)
    return rows.select("c", "inchikey", "statement", "t", "r", "taxon_name")
