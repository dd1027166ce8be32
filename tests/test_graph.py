import random

import pytest
from pyspark.sql import functions as F

from occurra.model import Criteria
from occurra.operators import stats
from occurra.operators.skew import SkewPolicy
from occurra.operators.taxonomy import CladeIndex, ClosureTooDeep, descendants, descendants_of_each, write_clades
from occurra.plans.search import search
from occurra.sources import star
from occurra.sources.tables import read_graph, write_graph
from occurra.sources.triples import OPEN_FILES, graph_tables, graph_triples, scan, write_triples

SF = "/root/testdata/sf0.01"


def closure(table, edges, root, **kw):
    return sorted(r["t"] for r in descendants(table(edges, "child string, parent string"), root, **kw).collect())


def test_closure_handles_dag_cycle_and_leaf(table):
    edges = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("a", "d"), ("x", "y"), ("b", "b")]
    assert closure(table, edges, "a") == ["a", "b", "c", "d"]
    assert closure(table, edges, "x") == ["x"]
    assert closure(table, edges, "nowhere") == ["nowhere"]


def test_closure_of_several_roots_is_a_set(table):
    roots = table([("b",), ("x",), ("b",)], "t string")
    assert closure(table, [("c", "b"), ("y", "x"), ("c", "x")], roots) == ["b", "c", "x", "y"]


def test_closure_stops_with_an_error(table):
    chain = [(f"n{i + 1}", f"n{i}") for i in range(6)]
    assert len(closure(table, chain, "n0")) == 7
    with pytest.raises(ClosureTooDeep):
        closure(table, chain, "n0", max_levels=3)


@pytest.fixture(scope="module")
def graph(spark):
    return star.graph(spark, SF)


def counters(result):
    row = result.stats.first()
    return tuple(row[c] for c in stats.COUNTERS)


def reference(edges, roots):
    below = {}
    for child, parent in edges:
        below.setdefault(parent, []).append(child)
    found = set()
    for root in roots:
        todo, seen = [root], {root}
        while todo:
            for child in below.get(todo.pop(), []):
                if child not in seen:
                    seen.add(child)
                    todo.append(child)
        found |= {(root, t) for t in seen}
    return found


def writes(spark, run):
    """Result of ``run`` and the number of tables it stores."""
    from occurra.operators import taxonomy

    before, counted = taxonomy._Rounds.store, []
    taxonomy._Rounds.store = lambda self, *a: counted.append(1) or before(self, *a)
    try:
        return run(), len(counted)
    finally:
        taxonomy._Rounds.store = before


def test_a_chain_of_4000_levels_takes_few_rounds(spark, table):
    edges = table([(f"n{i + 1}", f"n{i}") for i in range(4000)], "child string, parent string")
    found, n = writes(spark, lambda: descendants(edges, "n0"))
    assert found.count() == 4001 and n <= 12
    found, n = writes(spark, lambda: descendants(edges, "n3999"))
    assert found.count() == 2 and n <= 3


@pytest.mark.parametrize("walked", [0, 1, 2])
def test_graphs_with_forks_and_cycles(table, walked):
    rng = random.Random(walked)
    for _ in range(3):
        n = rng.choice([8, 60])
        edges = [(f"t{rng.randrange(n)}", f"t{rng.randrange(n)}") for _ in range(rng.choice([n // 2, n, 2 * n]))] + [(f"c{i + 1}", f"c{i}") for i in range(37)] + [("c0", "c37"), ("t0", "c9")]
        roots = ["t0", "t1", "c5", "c0", "nowhere"]
        got = descendants_of_each(table(edges, "child string, parent string"), table([(r,) for r in roots], "root string"), walked=walked)
        rows = [tuple(r) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == reference(edges, roots)
    assert descendants_of_each(table(edges, "child string, parent string"), table([], "root string")).count() == 0


def test_stored_lineages(spark, table, tmp_path):
    rng = random.Random(5)
    edges = [(f"t{rng.randrange(50)}", f"t{rng.randrange(50)}") for _ in range(70)] + [(f"c{i + 1}", f"c{i}") for i in range(40)]
    df = table(edges, "child string, parent string")
    assert write_clades(df, str(tmp_path / "clades"))
    index = CladeIndex(spark, str(tmp_path / "clades"))
    for root in ("t0", "t7", "c0", "c39", "nowhere"):
        found = index.descendants(root)
        assert sorted(r["t"] for r in found.collect()) == sorted(t for _, t in reference(edges, [root]))
    plan = index.descendants("c0")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    roots = ["t0", "c0", "c20", "nowhere"]
    got = [tuple(r) for r in index.descendants_of_each(table([(r,) for r in roots], "root string")).collect()]
    assert len(got) == len(set(got)) and set(got) == reference(edges, roots)
    # lineages of a long chain are many: they are not stored, and a search goes without them
    chain = table([(f"n{i + 1}", f"n{i}") for i in range(300)], "child string, parent string")
    assert not write_clades(chain, str(tmp_path / "none"), most_pairs_per_edge=20)


def test_golden_closure(graph):
    assert descendants(graph.taxon_parent, "Q10").count() == 21


def test_golden_mass_and_year(spark, graph):
    result = search(spark, graph, Criteria(taxon="Q10", mass_min=920, mass_max=990, year_min=1996, year_max=1999))
    assert counters(result) == (4159, 3316, 1192, 15, 2711)
    assert result.result_hash.first()[0] == "7a5bfc5f6fea017031cff444de77bf0f5e53a9477e8a74c6e34830fe0ea656b9"


def test_golden_formula(spark, graph):
    base = dict(taxon="Q10", mass_min=920, mass_max=990, year_min=1996, year_max=1999)
    chlorine = Criteria(**base, formula_enabled=True, halogens={"Cl": "required"})
    assert counters(search(spark, graph, chlorine)) == (963, 572, 213, 15, 553)
    carbon = Criteria(taxon="Q10", formula_enabled=True, elements={"C": (5, 20)})
    assert counters(search(spark, graph, carbon)) == (3783, 3125, 670, 15, 2823)


def test_golden_clade(spark, graph):
    assert counters(search(spark, graph, Criteria(taxon="Q10"))) == (11459, 9165, 1968, 15, 6867)


def test_triples_round_trip(spark):
    graph = star.graph(spark, "/root/testdata/sf0.001")
    again = graph_tables(graph_triples(graph))
    for name in ("statements", "compound_ids", "labels", "mass", "ref_date"):
        before, after = getattr(graph, name), getattr(again, name)
        rows = {tuple(r) for r in before.select(*sorted(before.columns)).collect()}
        assert rows == {tuple(r) for r in after.select(*sorted(after.columns)).collect()}, name


def test_shared_reference_nodes(spark):
    graph = star.graph(spark, "/root/testdata/sf0.001")
    one_ref = graph.statements.withColumn("ref", F.when(F.col("ref").like("%1"), "R-hot").otherwise(F.col("ref")))
    one_ref = one_ref.withColumn("r", F.when(F.col("ref") == "R-hot", "Q2000001").otherwise(F.col("r")))
    triples = graph_triples(type(graph)(**{**graph.__dict__, "statements": one_ref}))
    split = graph_tables(triples, policy=SkewPolicy(min_bytes=0, rows_per_salt=100, share=1 / 20))
    assert "_salt" in split.statements._jdf.queryExecution().toString()
    want = {tuple(r) for r in one_ref.select("statement", "c", "t", "ref", "r").collect()}
    got = split.statements.collect()
    assert {tuple(r) for r in got} == want
    assert sum(r["ref"] == "R-hot" for r in got) > 500


def test_stored_graph_gives_the_same_search(spark, tmp_path):
    graph = star.graph(spark, "/root/testdata/sf0.001")
    write_graph(graph_tables(graph_triples(graph), graph.fingerprints), str(tmp_path / "graph"))
    stored = read_graph(spark, str(tmp_path / "graph"))
    criteria = Criteria(taxon="Q10", formula_enabled=True, elements={"C": (5, 20)})
    first, second = (search(spark, g, criteria) for g in (graph, stored))
    assert counters(first) == counters(second) and counters(first)[0] > 0
    assert first.result_hash.first() == second.result_hash.first()
    plan = stored.statements.filter("t = 'Q1001'").select("c")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(t,Q1001)" in plan and "ReadSchema: struct<c:string,t:string>" in plan


def test_scan(table):
    triples = table([("a", "p", "1", None), ("b", "q", "2", None)], "s string, p string, o string, lang string")
    assert [tuple(r) for r in scan(triples, "q", "k", "v").collect()] == [("b", "2")]


def test_a_task_holds_the_triples_of_one_predicate(spark):
    """So they are written without another shuffle, in few files."""
    triples = graph_triples(star.graph(spark, SF))
    held = triples.select(F.spark_partition_id().alias("task"), "p").distinct().groupBy("task").count()
    assert {r["count"] for r in held.collect()} == {1}


def test_triples_of_statements_are_shuffled_once(spark, graph, tmp_path):
    rows = [("S1", "Q1", "T1", "R1", "P1"), ("S1", "Q1", "T1", "R2", "P1"), ("S1", "Q2", "T1", "R1", "P2"), ("S2", None, "T1", None, "P1"), (None, "Q1", "T2", "R1", None)]
    few = spark.createDataFrame(rows * 2, "statement string, c string, t string, ref string, r string")
    triples = graph_triples(type(graph)(**{**graph.__dict__, "statements": few})).filter(F.col("p").isin("p:P703", "ps:P703", "prov:wasDerivedFrom", "pr:P248"))
    got = [(r["s"], r["p"], r["o"], r["lang"]) for r in triples.collect()]
    found = {("Q1", "S1"), ("Q2", "S1"), (None, "S2")}
    values, derived, stated = {("S1", "T1"), ("S2", "T1"), (None, "T2")}, {("S1", "R1"), ("S1", "R2"), (None, "R1")}, {("R1", "P1"), ("R2", "P1"), ("R1", "P2"), (None, "P1")}
    want = [(s, p, o, None) for p, pairs in zip(("p:P703", "ps:P703", "prov:wasDerivedFrom", "pr:P248"), (found, values, derived, stated), strict=True) for s, o in pairs]
    assert len(got) == len(want) and set(got) == set(want)
    plan = triples._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("ReusedExchange [statement#") == 2
    before = spark.conf.get(OPEN_FILES)
    whole = graph_triples(type(graph)(**{**graph.__dict__, "statements": few}))
    write_triples(whole, str(tmp_path / "triples"), by_predicate=True)
    assert spark.conf.get(OPEN_FILES) == before
    stored = spark.read.parquet(str(tmp_path / "triples")).select(*whole.columns)
    assert stored.exceptAll(whole).isEmpty() and whole.exceptAll(stored).isEmpty()
