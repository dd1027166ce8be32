"""Curation: lookups, statements, whole runs, second pass, queue intake."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields, replace
from hashlib import md5

import pandas as pd
from pyspark.sql import functions as F

from occurra.catalog.registry import (
    query,
    s_canonical,
    s_clean,
    s_doi_key,
    s_row_key,
    s_smallest,
    s_taxon_key,
    s_trim,
)
from occurra.model import Graph
from occurra.operators import curation as cu
from occurra.operators.merging import append_unique as append_unique_rows
from occurra.operators.merging import merge_passes, with_row_key
from occurra.operators.pairs import PairIndex, write_pairs
from occurra.plans import curate as plan
from occurra.session import scratch_path
from occurra.sinks.files import write_statements
from occurra.sources import star
from occurra.sources.candidates import read_curation_tsv
from occurra.streaming.intake import intake_stream, read_log, read_queue

# ---- reference SQL of one curation run -----------------------------------
#
# `names` is the taxon-name table in force, `rows` the converted candidates;
# the suffix keeps the tables of two runs apart.


def _q(value: str) -> str:
    """Quoted and escaped value of an edit statement."""
    return f"""'"' || replace(replace({value}, '\\', '\\\\'), '"', '\\"') || '"'"""


def _stereo(x: str) -> str:
    return rf"regexp_matches({x}, '[@/\\]')"


_FORMULA = (
    "translate(CASE WHEN starts_with(inchi, 'InChI=') THEN nullif(split_part(inchi, '/', 2), '') END, "
    "'0123456789', '₀₁₂₃₄₅₆₇₈₉')"
)


def _compact(*lines: str) -> str:
    return f"list_filter([{', '.join(lines)}], lambda x: x IS NOT NULL)"


_MISSING = _compact(
    f"CASE WHEN known_canonical IS NULL THEN known_c || '|P233|' || {_q('canonical_smiles')} END",
    f"CASE WHEN known_inchi IS NULL THEN known_c || '|P234|' || {_q('inchi')} END",
    f"CASE WHEN known_formula IS NULL THEN known_c || '|P274|' || {_q(_FORMULA)} END",
    "CASE WHEN known_mass IS NULL AND exact_mass IS NOT NULL THEN known_c || printf('|P2067|+%.6fU483261', exact_mass) END",
    f"CASE WHEN {_stereo('isomeric_smiles')} AND known_iso IS NULL THEN known_c || '|P2017|' || {_q('isomeric_smiles')} END",
)
_CREATE = _compact(
    "'CREATE'",
    f"'LAST|Len|' || {_q('name')}",
    """'LAST|Den|"chemical compound"'""",
    f"'LAST|P31|' || CASE WHEN undefined_stereo AND NOT {_stereo('smiles')} THEN 'Q59199015' ELSE 'Q113145171' END",
    "'LAST|P279|Q11173'",
    f"'LAST|P235|' || {_q('inchikey')}",
    f"'LAST|P233|' || {_q('canonical_smiles')}",
    f"CASE WHEN {_stereo('isomeric_smiles')} THEN 'LAST|P2017|' || {_q('isomeric_smiles')} END",
    f"'LAST|P234|' || {_q('inchi')}",
    f"'LAST|P274|' || {_q(_FORMULA)}",
    "CASE WHEN exact_mass IS NOT NULL THEN printf('LAST|P2067|+%.6fU483261', exact_mass) END",
)
_OCCURRENCE = """CASE WHEN given IS NULL THEN NULL
WHEN t IS NULL THEN CASE WHEN known_c IS NULL THEN 'LAST|P703|[NEW_TAXON_QID]' END
WHEN r IS NOT NULL THEN CASE WHEN known_c IS NULL OR NOT has_triple THEN coalesce(known_c, 'LAST') || '|P703|' || t || '|S248|' || r END
WHEN doi_id IS NOT NULL THEN NULL
WHEN known_c IS NULL OR NOT has_pair THEN coalesce(known_c, 'LAST') || '|P703|' || t END"""
_BLOCK = (
    "'## -- Step: create missing taxon --' || chr(10) || 'CREATE' || chr(10) || 'LAST|Len|' || "
    f"{_q('taxon')} || chr(10) || 'LAST|P31|Q16521' || chr(10) || 'LAST|P225|' || {_q('taxon')}"
)
_NO_TAXON = "given IS NOT NULL AND t IS NULL"
_NO_REF = "doi_id IS NOT NULL AND r IS NULL"


def _run(x: str, rows: str, names: str) -> dict[str, str]:
    return {
        f"firsts{x}": f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS o FROM "
        f"(SELECT *, {s_row_key()} AS key, {s_clean('taxon')} AS given FROM {{{rows}}}) k) f WHERE o = 1",
        f"taxa{x}": f"SELECT t, name FROM {{{names}}} WHERE t IN (SELECT t FROM {{instance_of}}) OR t LIKE 'Q9000%'",
        f"batch{x}": f"SELECT f.k, {s_smallest('n.t')} AS t FROM (SELECT {s_taxon_key('taxon')} AS k, arg_min(given, seq) AS name "
        f"FROM {{firsts{x}}} WHERE given IS NOT NULL GROUP BY 1) f JOIN {{taxa{x}}} n ON n.name = f.name GROUP BY f.k",
        f"tried{x}": f"SELECT given, 0 AS pref, given AS name FROM (SELECT DISTINCT given FROM {{firsts{x}}} WHERE given IS NOT NULL) a "
        f"UNION ALL SELECT given, 1, {s_canonical('given')} FROM (SELECT DISTINCT given FROM {{firsts{x}}} WHERE given IS NOT NULL) a",
        f"single{x}": f"SELECT given, arg_min(t, pref * 1000000000 + cast(substr(t, 2) AS bigint)) AS t FROM "
        f"(SELECT w.given, w.pref, n.t FROM {{tried{x}}} w JOIN {{taxa{x}}} n ON n.name = w.name) z GROUP BY given",
        f"refs{x}": f"SELECT v AS doi_id, {s_smallest('r')} AS r FROM {{ref_doi}} GROUP BY v",
        f"known{x}": "SELECT i.inchikey, i.c AS known_c, i.smiles_conn AS known_canonical, s.v AS known_iso, n.v AS known_inchi, "
        "f.v AS known_formula, m.v AS known_mass FROM {compound_ids} i LEFT JOIN {smiles_iso} s ON i.c = s.c "
        "LEFT JOIN {inchi} n ON i.c = n.c LEFT JOIN {formula_raw} f ON i.c = f.c "
        "LEFT JOIN (SELECT c, min(v) AS v FROM {mass} GROUP BY c) m ON i.c = m.c",
        f"joined{x}": f"SELECT f.*, b.known_c, b.known_canonical, b.known_iso, b.known_inchi, b.known_formula, b.known_mass, "
        f"coalesce(a.t, s.t) AS t, CASE WHEN f.given IS NOT NULL THEN {s_doi_key('f.doi')} END AS doi_id, d.r "
        f"FROM {{firsts{x}}} f LEFT JOIN {{known{x}}} b ON f.inchikey = b.inchikey "
        f"LEFT JOIN {{batch{x}}} a ON a.k = {s_taxon_key('f.taxon')} LEFT JOIN {{single{x}}} s ON s.given = f.given "
        f"LEFT JOIN {{refs{x}}} d ON d.doi_id = CASE WHEN f.given IS NOT NULL THEN {s_doi_key('f.doi')} END",
        f"resolved{x}": f"SELECT j.*, p.c IS NOT NULL AS has_pair, q.c IS NOT NULL AS has_triple FROM {{joined{x}}} j "
        "LEFT JOIN (SELECT DISTINCT c, t FROM {statements}) p ON p.c = j.known_c AND p.t = j.t "
        "LEFT JOIN (SELECT DISTINCT c, t, r FROM {statements}) q ON q.c = j.known_c AND q.t = j.t AND q.r = j.r",
        f"lined{x}": f"""SELECT *, CASE WHEN conversion_error IS NOT NULL THEN [] ELSE
list_concat(CASE WHEN known_c IS NOT NULL THEN {_MISSING} ELSE {_CREATE} END, {_compact(_OCCURRENCE)}) END AS lines,
CASE WHEN conversion_error IS NOT NULL THEN [] ELSE {_compact(f'CASE WHEN {_NO_TAXON} THEN {_BLOCK} END', f"CASE WHEN {_NO_REF} THEN {s_clean('reference_lines')} END")} END AS blocks,
{_compact(f"CASE WHEN {_NO_TAXON} THEN 'taxon not found: ' || taxon END", f"CASE WHEN {_NO_REF} THEN 'reference not found: ' || doi_id END")} AS pend
FROM {{resolved{x}}}""",
        f"states{x}": f"""SELECT *, CASE WHEN conversion_error IS NOT NULL THEN 'error' WHEN len(pend) > 0 THEN 'pending_dependencies'
WHEN known_c IS NULL THEN 'new_compound' WHEN len(lines) = 0 THEN 'existing_complete' ELSE 'existing_updates' END AS status FROM {{lined{x}}}""",
        f"results{x}": f"""SELECT seq, key, name, smiles, taxon, doi, status,
CASE status WHEN 'error' THEN conversion_error WHEN 'existing_complete' THEN '{cu.NOTES[cu.COMPLETE]}'
WHEN 'existing_updates' THEN '{cu.NOTES[cu.UPDATES]}' WHEN 'new_compound' THEN '{cu.NOTES[cu.NEW]}'
ELSE '{cu.NOTES[cu.PENDING]}' || chr(10) || array_to_string(pend, chr(10)) END AS note,
CASE WHEN status <> 'error' THEN known_c END AS compound_qid,
CASE WHEN status <> 'error' THEN inchikey END AS inchikey,
CASE WHEN status <> 'error' THEN coalesce(known_formula, {_FORMULA}) END AS formula,
CASE WHEN status <> 'error' THEN coalesce(known_mass, exact_mass) END AS mass,
CASE WHEN status <> 'error' AND known_mass IS NULL THEN mass_warning END AS mass_warning,
blocks, lines FROM {{states{x}}}""",
    }


RUN = _run("", "converted", "taxon_names")
_SHOWN = (
    "seq, key, name, smiles, taxon, doi, status, note, compound_qid, inchikey, formula, mass, mass_warning, "
    "array_to_string(blocks, '~') AS blocks, array_to_string(lines, chr(10)) AS lines"
)


def _shown(results):
    return results.select(
        *"seq key name smiles taxon doi status note compound_qid inchikey formula mass mass_warning".split(),
        F.array_join("dependency_blocks", "~").alias("blocks"),
        F.array_join("statements", "\n").alias("lines"),
    )


def _converted(spark, folder):
    return star.view(spark, folder, "converted")


def _resolved(spark, folder):
    return plan.resolve_rows(*plan.prepare(_converted(spark, folder)), star.graph(spark, folder))


# ---- C9 - C12 ---------------------------------------------------------------


@query(
    "match_compounds",
    "SELECT * FROM {known} WHERE inchikey IN (SELECT inchikey FROM {converted})",
    RUN,
)
def match_compounds(spark, folder):
    return cu.match_compounds(_converted(spark, folder), star.graph(spark, folder))


# asked occurrences: a third exist with their reference, a third as a pair only
_ASKED = """SELECT DISTINCT concat('Q', 1000000 + l_partkey) AS c, concat('Q', 1000 + (l_suppkey + l_linenumber % 2)) AS t,
CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('Q', 2000000 + l_orderkey + l_linenumber % 3) END AS r FROM {lineitem}"""
_ASK = {"asked": _ASKED}


def _asked(spark, folder):
    return star.run_sql(spark, folder, _ASKED)


@query(
    "occurrence_exists",
    "SELECT DISTINCT c, t, EXISTS (SELECT 1 FROM {statements} s WHERE s.c = a.c AND s.t = a.t) AS \"exists\" FROM {asked} a",
    _ASK,
)
def occurrence_exists(spark, folder):
    return cu.occurrence_exists(_asked(spark, folder), star.view(spark, folder, "statements"))


@query(
    "occurrence_exists_ref",
    "SELECT c, t, r, EXISTS (SELECT 1 FROM {statements} s WHERE s.c = a.c AND s.t = a.t AND s.r = a.r) AS \"exists\" FROM {asked} a WHERE r IS NOT NULL",
    _ASK,
)
def occurrence_exists_ref(spark, folder):
    asked = _asked(spark, folder).filter("r IS NOT NULL")
    return cu.occurrence_exists_ref(asked, star.view(spark, folder, "statements"))


@query(
    "new_occurrences",
    """SELECT c, t, r FROM {asked} a WHERE CASE WHEN r IS NULL THEN NOT EXISTS (SELECT 1 FROM {statements} s WHERE s.c = a.c AND s.t = a.t)
ELSE NOT EXISTS (SELECT 1 FROM {statements} s WHERE s.c = a.c AND s.t = a.t AND s.r = a.r) END""",
    _ASK,
)
def new_occurrences(spark, folder):
    return cu.new_occurrences(_asked(spark, folder), star.view(spark, folder, "statements"))


@query(
    "new_occurrences_stored",
    """SELECT c, t, r FROM {asked} a WHERE CASE WHEN r IS NULL THEN NOT EXISTS (SELECT 1 FROM {statements} s WHERE s.c = a.c AND s.t = a.t)
ELSE NOT EXISTS (SELECT 1 FROM {statements} s WHERE s.c = a.c AND s.t = a.t AND s.r = a.r) END""",
    _ASK,
)
def new_occurrences_stored(spark, folder):
    """The same through the layout by (compound, taxon)."""
    path = scratch_path(spark, "pairs")
    write_pairs(star.view(spark, folder, "statements"), path)
    return cu.new_occurrences(_asked(spark, folder), PairIndex(spark, path))


# ---- K1 - K6, D7 - D9 ---------------------------------------------------------


@query(
    "missing_statements",
    f"SELECT seq, array_to_string({_MISSING}, chr(10)) AS lines FROM {{resolved}} WHERE known_c IS NOT NULL",
    RUN,
)
def missing_statements(spark, folder):
    rows = cu.with_known_compounds(plan.prepare(_converted(spark, folder))[0], star.graph(spark, folder))
    return rows.filter("known_c IS NOT NULL").select("seq", F.array_join(cu.missing_statements(), "\n").alias("lines"))


@query("create_statements", f"SELECT seq, array_to_string({_CREATE}, chr(10)) AS lines FROM {{converted}}")
def create_statements(spark, folder):
    return _converted(spark, folder).select("seq", F.array_join(cu.create_statements(), "\n").alias("lines"))


@query(
    "dependencies",
    f"""SELECT seq, t, r, array_to_string({_compact(f'CASE WHEN {_NO_TAXON} THEN {_BLOCK} END', f"CASE WHEN {_NO_REF} THEN {s_clean('reference_lines')} END")}, '~') AS blocks,
array_to_string(pend, '~') AS pending FROM {{lined}}""",
    RUN,
)
def dependencies(spark, folder):
    rows = cu.resolve_dependencies(plan.prepare(_converted(spark, folder))[0], star.graph(spark, folder))
    return rows.select(
        "seq",
        "t",
        "r",
        F.array_join("dependency_blocks", "~").alias("blocks"),
        F.array_join("pending", "~").alias("pending"),
    )


@query("occurrence_statements", f"SELECT seq, {_OCCURRENCE} AS line FROM {{resolved}}", RUN)
def occurrence_statements(spark, folder):
    return _resolved(spark, folder).select("seq", cu.occurrence_statement().alias("line"))


@query("curation_status", "SELECT seq, status, note FROM {results}", RUN)
def curation_status(spark, folder):
    return plan.curate(_converted(spark, folder), star.graph(spark, folder)).results.select("seq", "status", "note")


@query("curate", f"SELECT {_SHOWN} FROM {{results}}", RUN)
def curate(spark, folder):
    return _shown(plan.curate(_converted(spark, folder), star.graph(spark, folder)).results)


@query(
    "status_counts",
    """SELECT status, count(*) AS n, count(*) FILTER (WHERE len(blocks) > 0) AS n_with_dependencies,
CASE status WHEN 'existing_complete' THEN 0 WHEN 'existing_updates' THEN 1 WHEN 'new_compound' THEN 2 WHEN 'pending_dependencies' THEN 3 ELSE 4 END AS position
FROM {results} GROUP BY status""",
    RUN,
)
def status_counts(spark, folder):
    return cu.status_counts(plan.curate(_converted(spark, folder), star.graph(spark, folder)).results)


@query(
    "pending_counts",
    """SELECT count(*) FILTER (WHERE status = 'pending_dependencies') AS pending,
count(*) FILTER (WHERE len(blocks) > 0) AS awaiting FROM {results}""",
    RUN,
)
def pending_counts(spark, folder):
    return cu.pending_counts(plan.curate(_converted(spark, folder), star.graph(spark, folder)).results)


def _bundle_sql(results: str) -> str:
    return f"""SELECT 'dependencies' AS section, cast(split_part(loc, ':', 1) AS bigint) AS seq, cast(split_part(loc, ':', 2) AS int) - 1 AS pos, text FROM
(SELECT text, arg_min(seq || ':' || pos, seq * 100 + pos) AS loc FROM (SELECT seq, unnest(blocks) AS text, generate_subscripts(blocks, 1) AS pos FROM {{{results}}}) u
WHERE {s_trim('text')} <> '' GROUP BY text) g
UNION ALL SELECT 'main', seq, 0, array_to_string(lines, chr(10)) FROM {{{results}}} WHERE len(lines) > 0"""


@query("bundle", _bundle_sql("results"), RUN)
def bundle(spark, folder):
    return plan.curate(_converted(spark, folder), star.graph(spark, folder)).bundle


@query(
    "write_statements",
    "SELECT line, count(*) AS n FROM (SELECT unnest(lines) AS line FROM {results}) u WHERE line <> '' GROUP BY line",
    RUN,
)
def write_statements_query(spark, folder):
    """Lines of the written statement text, blank separators aside."""
    path = scratch_path(spark, "statements")
    write_statements(plan.curate(_converted(spark, folder), star.graph(spark, folder)).bundle, path)
    lines = spark.read.text(path).filter("value <> ''")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


# a stand-in for a structure converter: what it returns depends on the text only
_READ = """SELECT seq, name, smiles, taxon, doi, ltrim(smiles) AS canonical_smiles, ltrim(smiles) AS isomeric_smiles,
concat('InChI=1S/C', length(ltrim(smiles)), 'O/c1') AS inchi, concat(upper(md5(ltrim(smiles))), '-N') AS inchikey,
length(ltrim(smiles)) * 1.5e0 AS exact_mass, CASE WHEN length(smiles) = 0 THEN '' END AS mass_warning, false AS undefined_stereo,
CASE WHEN ltrim(smiles) = 'CCO' THEN 'unreadable' END AS conversion_error,
CASE WHEN length(smiles) = 0 THEN '' END AS reference_lines FROM {candidates}"""


def _stand_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = batch[["seq", "name", "smiles", "taxon", "doi"]].copy()
        text = out["smiles"].str.lstrip()
        out["canonical_smiles"] = out["isomeric_smiles"] = text
        out["inchi"] = "InChI=1S/C" + text.str.len().astype(str) + "O/c1"
        out["inchikey"] = [md5(t.encode()).hexdigest().upper() + "-N" for t in text]
        out["exact_mass"] = text.str.len() * 1.5
        out["mass_warning"], out["reference_lines"], out["undefined_stereo"] = None, None, False
        out["conversion_error"] = text.map({"CCO": "unreadable"}).astype(object).where(text == "CCO", None)
        yield out


@query("curate_with_converter", f"SELECT {_SHOWN} FROM {{results}}", _run("", "read", "taxon_names") | {"read": _READ})
def curate_with_converter(spark, folder):
    rows = star.view(spark, folder, "candidates")
    return _shown(plan.curate(rows, star.graph(spark, folder), converter=_stand_in).results)


def _failing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The stand-in, but it raises on one structure in some."""
    for out in _stand_in(batches):
        if (out["canonical_smiles"] == "CCO").any():
            raise ValueError("unreadable")
        yield out


_RAISED = _READ.replace("THEN 'unreadable' END", "THEN 'ValueError: unreadable' END")


@query(
    "curate_with_failing_converter",
    f"SELECT {_SHOWN} FROM {{results}}",
    _run("", "read", "taxon_names") | {"read": _RAISED},
)
def curate_with_failing_converter(spark, folder):
    """An exception costs the rows that raise it, not the batch."""
    rows = star.view(spark, folder, "candidates")
    return _shown(plan.curate(rows, star.graph(spark, folder), converter=_failing).results)


# what a file of candidates gives: trimmed cells, rows without name or structure left out
_FROM_FILE = f"""SELECT seq, {s_clean('name')} AS name, {s_clean('smiles')} AS smiles, {s_clean('taxon')} AS taxon,
{s_doi_key('doi')} AS doi FROM {{candidates}} WHERE {s_clean('name')} IS NOT NULL AND {s_clean('smiles')} IS NOT NULL"""


@query(
    "curate_from_tsv",
    f"SELECT {_SHOWN.removeprefix('seq, ')} FROM {{results}}",
    _run("", "read", "taxon_names") | {"file_rows": _FROM_FILE, "read": _READ.replace("{candidates}", "{file_rows}")},
)
def curate_from_tsv(spark, folder):
    """From a text file to results: the order of the rows in the file decides between equal keys."""
    path = scratch_path(spark, "candidates-tsv")
    rows = star.view(spark, folder, "candidates").orderBy("seq").select("name", "smiles", "taxon", "doi")
    rows.write.csv(path, sep="\t", header=True, quote="", emptyValue="", nullValue="")
    read = read_curation_tsv(spark, path)
    return _shown(plan.curate(read, star.graph(spark, folder), converter=_stand_in).results).drop("seq")


# ---- C18, C19, K7, I1 -----------------------------------------------------------

# the missing taxa of the first pass, created under new ids
_GROWN = f"""SELECT t, name FROM {{taxon_names}} UNION ALL
SELECT concat('Q9000', substr(given, 8)), given FROM (SELECT DISTINCT {s_clean('taxon')} AS given FROM {{candidates}}) g
WHERE given LIKE 'nation_%' AND length(given) < 10"""
_SECOND = {
    **RUN,
    "grown_names": _GROWN,
    "waiting": "SELECT * FROM {converted} WHERE seq IN (SELECT seq FROM {results} WHERE len(blocks) > 0)",
    **_run("2", "waiting", "grown_names"),
    "merged": "SELECT p.seq, p.key, p.name, p.smiles, p.taxon, p.doi, " + ", ".join(
        f"CASE WHEN u.seq IS NOT NULL THEN u.{c} ELSE p.{c} END AS {c}"
        for c in "status note compound_qid inchikey formula mass mass_warning blocks lines".split()
    ) + " FROM {results} p LEFT JOIN {results2} u ON u.key = p.key",
}


def _grown(spark, folder):
    """The graph before and after the missing taxa were created, and what was added."""
    g = star.graph(spark, folder)
    created = (
        star.view(spark, folder, "candidates")
        .select(F.btrim("taxon").alias("name"))
        .filter("name LIKE 'nation_%' AND length(name) < 10")
        .distinct()
        .select(F.concat(F.lit("Q9000"), F.expr("substr(name, 8)")).alias("t"), "name")
    )
    grown = replace(
        g,
        taxon_names=g.taxon_names.unionByName(created),
        instance_of=g.instance_of.unionByName(created.select("t")),
    )
    nothing = {f.name: getattr(g, f.name).limit(0) for f in fields(g)}
    return g, grown, Graph(**nothing | {"taxon_names": created.select("t", "name"), "instance_of": created.select("t")})


def _second(spark, folder) -> plan.Curation:
    before, grown, added = _grown(spark, folder)
    return plan.second_pass_added(plan.curate(_converted(spark, folder), before), grown, added)


@query("second_pass", f"SELECT {_SHOWN} FROM {{merged}}", _SECOND)
def second_pass(spark, folder):
    return _shown(_second(spark, folder).results)


@query("second_pass_whole", f"SELECT {_SHOWN} FROM {{merged}}", _SECOND)
def second_pass_whole(spark, folder):
    """The waiting rows looked up in the whole grown graph."""
    before, grown, _ = _grown(spark, folder)
    converted = _converted(spark, folder)
    return _shown(plan.second_pass(plan.curate(converted, before).results, converted, grown).results)


@query("second_pass_bundle", _bundle_sql("merged"), _SECOND)
def second_pass_bundle(spark, folder):
    return _second(spark, folder).bundle


# previous rows with repeated keys, updated rows with repeated and foreign keys
_PREVIOUS = f"SELECT seq, {s_row_key()} AS key, name FROM {{candidates}}"
_UPDATED = f"""SELECT seq + 1000000 AS seq, {s_row_key()} AS key, concat('new ', name) AS name FROM {{candidates}} WHERE taxon IS NULL
UNION ALL SELECT seq, concat('foreign ', seq), name FROM {{candidates}} WHERE doi IS NULL"""


@query(
    "merge_passes",
    """SELECT p.seq, p.key, CASE WHEN p.o = 1 AND u.name IS NOT NULL THEN u.name ELSE p.name END AS name FROM
(SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS o FROM {previous}) p
LEFT JOIN (SELECT key, arg_max(name, seq) AS name FROM {updated} GROUP BY key) u ON u.key = p.key""",
    {"previous": _PREVIOUS, "updated": _UPDATED},
)
def merge_passes_query(spark, folder):
    rows = with_row_key(star.view(spark, folder, "candidates"))
    previous = rows.select("seq", "key", "name")
    renamed = rows.filter("taxon IS NULL").select(
        (F.col("seq") + 1000000).alias("seq"), "key", F.concat(F.lit("new "), "name").alias("name")
    )
    foreign = rows.filter("doi IS NULL").select("seq", F.concat(F.lit("foreign "), "seq").alias("key"), "name")
    return merge_passes(previous, renamed.unionByName(foreign))


# the earlier queue is every candidate without a DOI
_ADDED = f"""SELECT seq, key FROM (SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS o FROM
(SELECT seq, {s_row_key()} AS key FROM {{candidates}}) k) f WHERE o = 1
AND key NOT IN (SELECT {s_row_key()} FROM {{candidates}} WHERE doi IS NULL)"""


@query("append_unique", _ADDED)
def append_unique(spark, folder):
    rows = star.view(spark, folder, "candidates")
    return append_unique_rows(rows.filter("doi IS NULL"), rows)[0].select("seq", "key")


@query(
    "append_unique_counts",
    f"SELECT a.n AS added, (SELECT count(*) FROM {{candidates}}) - a.n AS skipped FROM (SELECT count(*) AS n FROM ({_ADDED}) x) a",
)
def append_unique_counts(spark, folder):
    rows = star.view(spark, folder, "candidates")
    return append_unique_rows(rows.filter("doi IS NULL"), rows)[1]


_CANDIDATE_COLUMNS = star.VIEWS["candidates"].split("SELECT", 1)[1].rsplit("FROM", 1)[0]


def _stream(spark, folder) -> str:
    events = star.table(spark, folder, "events")
    stream = (
        spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(folder)
    )
    rows = stream.select(F.struct("*").alias("e")).select("e.*")
    candidates = rows.selectExpr(*_columns(_CANDIDATE_COLUMNS))
    queue = scratch_path(spark, "queue")
    intake_stream(candidates, queue, once=True).awaitTermination()
    return queue


def _columns(text: str) -> list[str]:
    """Top-level column expressions of a SELECT list."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            parts.append(text[start:i].strip())
            start = i + 1
    return [*parts, text[start:].strip()]


@query(
    "intake_stream",
    f"""SELECT seq, key FROM (SELECT seq, key, row_number() OVER (PARTITION BY key ORDER BY seq) AS o FROM
(SELECT seq, {s_row_key()} AS key FROM {{candidates}}) k) f WHERE o = 1""",
)
def intake_stream_query(spark, folder):
    return read_queue(spark, _stream(spark, folder)).select("seq", "key")


@query(
    "intake_log",
    f"SELECT count(DISTINCT {s_row_key()}) AS added, count(*) - count(DISTINCT {s_row_key()}) AS skipped FROM {{candidates}}",
)
def intake_log(spark, folder):
    return read_log(spark, _stream(spark, folder)).agg(F.sum("added").alias("added"), F.sum("skipped").alias("skipped"))
