from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from occurra.model import Criteria
from occurra.operators import ordering, stats, taxonomy
from occurra.operators import requests as rq
from occurra.operators.occurrences import Occurrences
from occurra.operators.taxonomy import descendants, descendants_of_each
from occurra.plans import curate as plan
from occurra.plans.requests import request_counters, search_requests
from occurra.plans.search import search
from occurra.session import cut_lineage
from occurra.sinks.files import export, write_results_csv
from occurra.sources import candidates as cand
from occurra.sources import star
from occurra.sources.triples import graph_tables

SF = "/root/testdata/sf0.001"


def test_limits_are_the_callers(table):
    df = table([(i,) for i in range(700)], "x long")
    assert stats.limit_rows(df, None, [F.col("x")]).count() == 700
    assert stats.limit_rows(df, 650).count() == 650


def test_cut_by_range_is_the_sorted_cut(table, monkeypatch):
    monkeypatch.setattr(stats, "TOP_K_ROWS", 10)
    monkeypatch.setattr(ordering, "TOP_K_ROWS", 10)
    df = table([(i % 97, i) for i in range(1000)], "x long, y long")
    order = [F.col("x"), F.col("y")]
    want = [tuple(r) for r in df.orderBy(*order).collect()]
    assert [tuple(r) for r in stats.limit_rows(df, 333, order).collect()] == want[:333]
    for first, size in ((0, 5), (500, 40), (990, 50), (123, 1), (2000, 5)):
        got = [tuple(r) for r in ordering.page(df, order, first, size, 3).collect()]
        lo, hi = ordering.page_bounds(1000, first, size, 3)
        assert got == want[lo:hi]


def test_open_year_keeps_what_comes_later(spark):
    graph = star.graph(spark, SF)
    rows = search(spark, graph, Criteria(taxon="Q10", year_min=1996)).all_rows
    closed = search(spark, graph, Criteria(taxon="Q10", year_min=1996, year_max=1997)).all_rows
    assert rows.agg(F.max("pub_year")).first()[0] > 1997 >= closed.agg(F.max("pub_year")).first()[0]


def test_requests_without_an_upper_year_keep_what_comes_later(spark):
    occ = Occurrences(star.graph(spark, SF))
    asked = spark.createDataFrame([("open", "Q10", 1993, None), ("closed", "Q10", 1993, 1996)], "req_id string, taxon string, year_min int, year_max int")
    links = spark.createDataFrame([("link", "?taxon=Q10&year_filter=true&year_start=1993"), ("end", "?taxon=Q10&year_filter=true&year_end=1996")], "req_id string, url string")
    # the year of the requests is before the last publications
    for requests, cut, whole in ((asked, "closed", "open"), (rq.decode_share_params(links, "url", 1996).drop("formula_enabled"), "end", "link")):
        rows, _ = search_requests(occ, requests, 1996)
        years = {r["req_id"]: r["y"] for r in rows.groupBy("req_id").agg(F.max("pub_year").alias("y")).collect()}
        assert years[whole] > 1996 >= years[cut]


def test_requests_for_all_taxa_are_answered(spark):
    graph = star.graph(spark, SF)
    asked = spark.createDataFrame(
        [("star", "*", 915.0, "excluded", None), ("none", None, 905.0, "excluded", 1996), ("clade", "Q10", 905.0, "excluded", None)],
        "req_id string, taxon string, mass_min double, cl_state string, year_min int",
    )
    rows, resolved = search_requests(Occurrences(graph), asked, 2025)
    got = {r["req_id"]: [] for r in asked.collect()}
    for r in rows.collect():
        got[r["req_id"]].append(tuple(r)[1:])
    for r in asked.collect():
        criteria = Criteria(taxon=r["taxon"] or "", mass_min=r["mass_min"], year_min=r["year_min"] or 1800, formula_enabled=True, halogens={"Cl": "excluded"})
        want = search(spark, graph, criteria).all_rows
        assert got[r["req_id"]] and sorted(map(repr, got[r["req_id"]])) == sorted(repr(tuple(w)) for w in want.collect())
    assert resolved.filter("fault IS NOT NULL").isEmpty()


def small_graph(spark):
    """Two-valued masses, a compound without occurrence, one without formula, a row dated late."""
    base = star.graph(spark, SF)

    def rows(data, schema):
        return spark.createDataFrame(data, schema)

    return replace(
        base,
        compound_ids=rows([(c, f"K{c}", "C") for c in ("Q1", "Q2", "Q3", "Q4")], "c string, inchikey string, smiles_conn string"),
        statements=rows([("S1", "Q1", "Q71", "x", "R1"), ("S2", "Q1", "Q72", "x", "R2"), ("S3", "Q2", "Q72", "x", "R3"), ("S4", "Q3", "Q73", "x", "R9")], "statement string, c string, t string, ref string, r string"),
        taxon_names=rows([("Q71", "Rosa"), ("Q72", "Rosa"), ("Q73", "Viola tricolor")], "t string, name string"),
        taxon_parent=rows([("Q72", "Q71")], "child string, parent string"),
        mass=rows([("Q1", 100.0), ("Q1", 200.0), ("Q2", 100.0), ("Q4", 100.0)], "c string, v double"),
        formula_raw=rows([("Q1", "C2H6O"), ("Q2", "C\u2085H4Cl"), ("Q4", "C9")], "c string, v string"),
        ref_date=base.ref_date.limit(0).unionByName(rows([("R1", 2030), ("R2", 1999)], "r string, y int").selectExpr("r", "make_timestamp(y, 1, 1, 0, 0, 0) AS v")),
        fingerprints=rows([("Q1", [1, 2, 3]), ("Q2", [1, 2]), ("Q3", [5]), ("Q4", [1, 2, 3, 4])], "c string, bits array<int>"),
    )


REQUESTS = "req_id string, taxon string, smiles string, search_type string, threshold double, mass_min double, mass_max double, year_min int, year_max int, formula_exact string, c_max int, cl_state string, query_bits array<int>"
ASKED = [
    ("all", "*", None, None, None, None, None, None, None, None, None, None, None),
    ("late", "*", None, None, None, None, None, 2000, None, None, None, None, None),
    ("until", "*", None, None, None, None, None, None, 2005, None, None, None, None),
    ("mass", "*", None, None, None, 150.0, 250.0, None, None, None, None, None, None),
    ("none", "*", None, None, None, 9000.0, None, None, None, None, None, None, None),
    ("exact", "*", None, None, None, None, None, None, None, "C5 H4 Cl", None, None, None),
    ("few", "*", None, None, None, None, None, None, None, None, 4, "excluded", None),
    ("chlorine", "Rosa", None, None, None, None, None, None, None, None, None, "required", None),
    ("screen", "", "CCO", "substructure", None, None, None, None, None, None, None, None, [1, 2]),
    ("like", "", "CCO", "similarity", 0.7, None, None, None, None, None, None, None, [1, 2, 3]),
    ("lines", "", "C\nO", "similarity", 0.7, None, None, None, None, None, None, None, [1, 2, 3]),
    ("dated", "", "CCO", "substructure", None, None, None, 1990, None, None, None, None, [1]),
    ("inside", "Q71", "CCO", "substructure", None, 150.0, None, None, None, None, None, None, [1]),
    ("bare", "Q71", "CCO", "substructure", None, None, None, None, None, None, None, None, None),
    ("lost", "Nobody", None, None, None, None, None, None, None, None, None, None, None),
]


def test_requests_of_every_kind_equal_single_searches(spark):
    graph = small_graph(spark)
    asked = spark.createDataFrame(ASKED, REQUESTS)
    rows, resolved = search_requests(Occurrences(graph), asked, 2010)
    got = {r[0]: [] for r in ASKED}
    for r in rows.collect():
        got[r["req_id"]].append(repr(tuple(r)[1:]))
    faults = {r["req_id"]: r["fault"] for r in resolved.collect()}
    assert {k: v for k, v in faults.items() if v} == {"bare": "StructureBitsMissing", "lost": "TaxonNotFound"}
    for req, taxon, smiles, kind, threshold, low, high, y0, y1, exact, c_max, cl, bits in ASKED:
        if faults[req]:
            assert got[req] == []
            continue
        criteria = Criteria(
            taxon=taxon, smiles=smiles or "", search_type=kind or "substructure", threshold=threshold or 0.8, mass_min=low or 0.0, mass_max=high or 10000.0,
            year_min=y0 or 1800, year_max=y1, formula_enabled=bool(exact or c_max or cl), formula_exact=exact or "",
            elements={"C": (0, c_max)} if c_max else {}, halogens={"Cl": cl} if cl else {},
        )
        want = search(spark, graph, criteria, query_bits=bits).all_rows
        assert sorted(got[req]) == sorted(repr(tuple(w)) for w in want.collect()), req
    # the row dated after the year of the requests, and a row for each mass of a compound
    assert len(got["late"]) == 2 and len(got["all"]) == 6 and len(got["mass"]) == 2 and got["none"] == []
    assert any("Q4" in r for r in got["screen"]) and not any("Q4" in r for r in got["dated"])


def test_requests_by_compound_count_the_listed_rows(spark):
    graph, structures = small_graph(spark), [r for r in ASKED if r[2]]
    # a request with bounds on formula and year, and a key that repeats
    more = [
        ("formula", "", "CCO", "similarity", 0.3, None, None, None, 2040, None, 4, None, [1, 2, 3]),
        ("dated", "Q71", "CCO", "substructure", None, 150.0, None, None, None, None, None, None, [1]),
    ]
    asked = spark.createDataFrame([*structures, *more], REQUESTS)
    listed, _ = search_requests(Occurrences(graph), asked, 2010)
    total = F.sum(F.col("mass").cast("decimal(18, 3)")).cast("double")
    want = listed.groupBy("req_id", "compound_qid").agg(F.count(F.lit(1)), F.min("statement"), total).collect()
    found, _ = search_requests(Occurrences(graph), asked, 2010, by_compound=True)
    got = found.select("req_id", "compound_qid", "n_rows", "first_statement", F.col("total_mass").cast("double")).collect()
    assert len(want) > 1 and sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, want)))


def test_structures_by_compound_meet_groups_of_rows(spark):
    """A hundred rows that no request tells apart meet the requests as one."""
    graph = small_graph(spark)
    many = spark.range(100).selectExpr("concat('S', id) AS statement", "'Q1' AS c", "'Q71' AS t", "'x' AS ref", "'R1' AS r")
    asked = spark.createDataFrame([("a", "", "CCO", [1]), ("b", "Q71", "CCO", [1, 2])], "req_id string, taxon string, smiles string, query_bits array<int>")
    found, _ = search_requests(Occurrences(replace(graph, statements=many)), asked, 2010, by_compound=True)
    assert {(r["req_id"], r["n_rows"], r["first_statement"]) for r in found.filter("compound_qid = 'Q1'").collect()} == {("a", 200, "S0"), ("b", 200, "S0")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # statements are read into stored groups beforehand, and only these meet the hits
    assert "statement" not in plan.replace("first_statement", "")


def test_structures_by_compound_send_no_table_of_properties_to_every_task(spark, monkeypatch):
    """Properties of compounds that no request found are left out before they are joined, and many rows are shuffled."""
    graph, stored = small_graph(spark), {}
    asked = spark.createDataFrame([("a", "", "CCO", [1]), ("b", "Q71", "CCO", [1, 2])], "req_id string, taxon string, smiles string, query_bits array<int>")

    def spy(df, label="stage"):
        stored.setdefault(label, df._jdf.queryExecution())
        return cut_lineage(df, label)

    monkeypatch.setattr("occurra.plans.requests.cut_lineage", spy)
    want = sorted(map(repr, search_requests(Occurrences(graph), asked, 2010, by_compound=True)[0].collect()))
    # compounds, statements, mass, formula, smiles and two labels are cut to the compounds found
    assert stored.pop("groups").optimizedPlan().toString().count("LeftSemi") == 7
    stored.clear()
    monkeypatch.setattr("occurra.operators.skew.BROADCAST_ROWS", 0)
    got = sorted(map(repr, search_requests(Occurrences(graph), asked, 2010, by_compound=True)[0].collect()))
    joins = [line for line in stored["groups"].sparkPlan().toString().split("\n") if "BroadcastHashJoin" in line]
    # references alone, whose tables the planner sizes itself
    assert got == want and joins and all("[r#" in line for line in joins)


def test_closure_does_not_broadcast_many_members(spark, monkeypatch):
    edges = spark.createDataFrame([(f"n{i + 1}", f"n{i}") for i in range(40)] + [("n9", "m"), ("m", "n2")], "child string, parent string")
    roots, plans = spark.createDataFrame([("n0",), ("m",)], "root string"), []
    want = sorted(map(tuple, descendants_of_each(edges, roots).collect()))
    store = taxonomy._Rounds.store

    def spy(self, members, hops=None):
        plans.append(members._jdf.queryExecution().executedPlan().toString())
        return store(self, members, hops)

    monkeypatch.setattr(taxonomy._Rounds, "store", spy)
    monkeypatch.setattr("occurra.operators.skew.BROADCAST_ROWS", 0)
    assert sorted(map(tuple, descendants_of_each(edges, roots).collect())) == want and len(want) > 70
    assert len(plans) > 5 and not any("BroadcastHashJoin" in plan for plan in plans)


def test_counters_and_notes_of_requests(spark):
    graph = small_graph(spark)
    asked = spark.createDataFrame([*ASKED, ("odd", " rosa", *[None] * 11), ("tricolor", "viola__tricolor", *[None] * 11)], REQUESTS)
    rows, resolved = search_requests(Occurrences(graph), asked, 2010)
    found = {r["req_id"]: r for r in request_counters(rows, resolved, 2010, limit=2).collect()}
    assert len(found) == len(ASKED) + 2
    every = found["all"]
    assert (every["n_entries"], every["n_entries_unique"], every["n_compounds"], every["n_taxa"], every["n_references"]) == (6, 4, 3, 3, 4)
    assert (every["n_returned"], every["capped"]) == (2, True)
    assert (found["none"]["n_entries"], found["none"]["capped"], found["lost"]["fault"]) == (0, False, "TaxonNotFound")
    assert found["odd"]["note"].startswith("ambiguous taxon, using Rosa (Q71); candidates: Rosa (Q71), Rosa (Q72)")
    assert found["tricolor"]["note"] == "taxon standardised from 'viola__tricolor' to 'Viola tricolor'"
    single = search(spark, graph, Criteria(taxon="*", mass_min=150.0, mass_max=250.0))
    assert found["mass"]["query_hash"] is not None and single.stats.first()["n_entries"] == found["mass"]["n_entries"]


def test_requests_of_several_ways_enrich_the_rows_once(spark, monkeypatch):
    made, enriched = [], Occurrences.enriched
    monkeypatch.setattr(Occurrences, "enriched", lambda self, *a, **b: made.append(a) or enriched(self, *a, **b))
    asked = spark.createDataFrame([r for r in ASKED if r[0] in ("all", "late", "mass", "chlorine")], REQUESTS)
    rows, resolved = search_requests(Occurrences(small_graph(spark)), asked, 2010)
    assert len(made) == 1
    # no row is repeated for each of the distinct counts
    assert "Expand" not in request_counters(rows, resolved, 2010)._jdf.queryExecution().optimizedPlan().toString()


def test_counters_of_requests_cope_with_gaps(spark):
    resolved = spark.createDataFrame([(k, None, None) for k in "ab"], "req_id string, note string, fault string")
    resolved = rq.fill_defaults(resolved, 2010).withColumn("t", F.lit(None).cast("string"))
    rows = [("a", "Q1", "Q5", "Q9"), ("a", "Q1", "Q5", "Q9"), ("a", "Q1", None, None), ("a", None, "Q5", None), (None, "Q2", "Q6", "Q8"), ("a", "Q3", "", "Q9")]
    rows = spark.createDataFrame(rows, "req_id string, compound_qid string, taxon_qid string, reference_qid string")
    found = {r["req_id"]: tuple(r)[1:6] for r in request_counters(rows, resolved, 2010).collect()}
    assert found == {"a": (5, 4, 2, 1, 1), "b": (0, 0, 0, 0, 0)}


def test_requests_for_all_taxa_need_no_product(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        asked = spark.createDataFrame([(str(i), "*", 900.0 + i, 901.0 + i, "excluded") for i in range(40)], "req_id string, taxon string, mass_min double, mass_max double, cl_state string")
        with_years = asked.selectExpr("concat('y', req_id) AS req_id", "taxon", "1990 + cast(req_id AS int) % 9 AS year_min")
        rows, _ = search_requests(Occurrences(star.graph(spark, SF)), asked.unionByName(with_years, allowMissingColumns=True), 2025)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
        assert rows.count() > 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_clades_of_many_roots(spark):
    edges = star.view(spark, SF, "taxon_parent")
    roots = ["Q1", "Q10", "Q101", "Q1003", "nowhere"]
    got = {(r["root"], r["t"]) for r in descendants_of_each(edges, spark.createDataFrame([(r,) for r in roots], "root string")).collect()}
    assert got == {(root, r["t"]) for root in roots for r in descendants(edges, root).collect()}


def test_a_deep_chain_needs_no_level_limit(table):
    edges = table([(f"t{i + 1}", f"t{i}") for i in range(40)], "child string, parent string")
    assert descendants(edges, "t0").count() == 41


def test_values_stay_as_they_are(table):
    triples = table(
        [("Q1", "wdt:P356", "10.1/lower.é1", None), ("Q5", "wdt:P2067", "5d", None), ("Q6", "wdt:P2067", "12.5", None), ("Q7", "wdt:P2067", "NaN", None)],
        "s string, p string, o string, lang string",
    )
    graph = graph_tables(triples)
    assert graph.ref_doi.first()["v"] == "10.1/lower.é1"
    assert [r["v"] for r in graph.mass.orderBy("c").collect()] == [None, 12.5, None]


def test_csv_keeps_outer_blanks(table, spark, tmp_path):
    write_results_csv(table([(" lead and trail ", "x")], "a string, b string"), str(tmp_path / "out"))
    read = spark.read.csv(str(tmp_path / "out"), header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    assert read.first()["a"] == " lead and trail "


def test_export_names(spark, tmp_path, table):
    rows = table([("Q1",)], "compound_qid string")
    path = export(rows, rows, " NDJSON ", str(tmp_path), "a/../b: c?")
    assert path == f"{tmp_path}/a_.._b_c.json" and spark.read.json(path).count() == 1
    with pytest.raises(ValueError, match="unknown export format"):
        export(rows, rows, "xlsx", str(tmp_path), "a")


def test_rows_of_files_are_numbered_in_order(spark, tmp_path):
    for name, numbers in (("a", range(500)), ("b", range(500, 900))):
        (tmp_path / f"{name}.tsv").write_text("name\tsmiles\n" + "".join(f"n{i}\tC{i}\n" for i in numbers))
    rows = cand.read_curation_tsv(spark, str(tmp_path)).orderBy("seq").collect()
    assert [r["name"] for r in rows] == [f"n{i}" for i in range(900)] and len({r["seq"] for r in rows}) == 900
    docs = spark.createDataFrame([(7, '[{"name":"a","smiles":"C"},{"name":"b","smiles":"N"}]')], "seq long, doc string")
    numbered = cand.sequence(cand.read_curation_json(docs, "doc")).orderBy("seq").collect()
    assert [r["name"] for r in numbered] == ["a", "b"] and numbered[0]["seq"] == 7 << cand.SEQ_BITS


def test_a_raising_converter_costs_its_row(spark, table):
    def converter(batches):
        for batch in batches:
            if (batch["name"] == "bad").any():
                raise ValueError("no such ring")
            yield batch.reindex(columns=plan.INPUT_COLUMNS).astype(object).where(lambda d: d.notna(), None)

    rows = table([(1, "ok", "C", None, None), (2, "bad", "N", None, None)], "seq long, name string, smiles string, taxon string, doi string")
    got = {r["name"]: r["conversion_error"] for r in plan.convert(rows.coalesce(1), converter).collect()}
    assert got == {"ok": None, "bad": "ValueError: no such ring"}


def test_scratch_goes_with_its_block(spark, table):
    from pathlib import Path

    from occurra.session import cut_lineage, scratch, shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    with scratch(spark):
        assert cut_lineage(table([(1,)], "x long"), "short").count() == 1
        assert {p.name for p in folder.iterdir()} > before
    assert {p.name for p in folder.iterdir()} == before


def test_the_stored_profile_is_used(spark, tmp_path):
    from occurra.operators.skew import SkewPolicy
    from occurra.sources.tables import read_occurrences, write_graph

    graph = star.graph(spark, SF)
    policy = SkewPolicy(min_bytes=0, rows_per_salt=20, share=0.001)
    write_graph(graph, str(tmp_path / "graph"), policy)
    occ = read_occurrences(spark, str(tmp_path / "graph"), policy)
    assert any(occ.heavy.of(c) for c in ("c", "t", "r"))
    want = sorted(map(str, search(spark, graph, Criteria(taxon="Q10")).all_rows.collect()))
    assert sorted(map(str, search(spark, occ, Criteria(taxon="Q10")).all_rows.collect())) == want


def test_stored_fingerprints_answer_alike(spark, tmp_path):
    from occurra.operators.similarity import similar, substructure_screen
    from occurra.sources.tables import read_graph, write_graph

    graph = star.graph(spark, SF)
    write_graph(graph, str(tmp_path / "graph"), n_bits=star.FINGERPRINT_BITS)
    stored = read_graph(spark, str(tmp_path / "graph"))
    assert {"bits", "w0", "size"} <= set(stored.fingerprints.columns)
    query = graph.fingerprints.first()["bits"]
    for run in (lambda f: similar(f, query, 0.5, star.FINGERPRINT_BITS), lambda f: substructure_screen(f, query[:6], star.FINGERPRINT_BITS)):
        assert sorted(run(stored.fingerprints).collect()) == sorted(run(graph.fingerprints).collect())


def test_a_stored_search_reads_its_rows(spark):
    graph = star.graph(spark, SF)
    found = search(spark, graph, Criteria(taxon="Q10"))
    want = found.stats.first()
    stored = search(spark, graph, Criteria(taxon="Q10")).store()
    assert stored.stats.first() == want and stored.rows.count() == want["n_entries_unique"]
