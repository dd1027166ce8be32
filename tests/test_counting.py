from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from occurra.model import Criteria
from occurra.operators import stats
from occurra.operators.counting import counters
from occurra.operators.occurrences import Occurrences, enrich, result_rows
from occurra.operators.skew import SkewPolicy
from occurra.plans.search import search
from occurra.sources import star

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def graph(spark):
    """Several values wherever the graph allows them, and keys without any."""
    g = star.graph(spark, SF)

    def twice(table, condition):
        return table.unionByName(table.filter(condition))

    return replace(
        g,
        mass=twice(g.mass, "c LIKE '%3'"),
        formula_raw=twice(g.formula_raw.unionByName(g.formula_raw.filter("c LIKE '%7'").withColumn("v", F.lit("C7Cl"))), "c LIKE '%2'"),
        labels=twice(g.labels, "c LIKE '%5'"),
        smiles_iso=twice(g.smiles_iso, "c LIKE '%8'"),
        taxon_names=twice(g.taxon_names, "t LIKE '%4'").filter("t NOT LIKE '%9'"),
        compound_ids=twice(g.compound_ids, "c LIKE '%6'").filter("c NOT LIKE '%01'"),
        ref_title=twice(g.ref_title, "r LIKE '%1'"),
        ref_doi=twice(g.ref_doi, "r LIKE '%2'"),
        ref_date=twice(g.ref_date.unionByName(g.ref_date.filter("r LIKE '%5'").withColumn("v", F.expr("make_timestamp(2020, 1, 1, 0, 0, 0)"))), "r LIKE '%3'"),
    )


def test_all_rows(graph):
    assert counters(Occurrences(graph)).first() == stats.dataset_stats(result_rows(enrich(Occurrences(graph)))).first()


@pytest.mark.parametrize(
    "criteria",
    [
        Criteria(taxon="Q10"),
        Criteria(taxon="*", mass_min=905.0, mass_max=950.0),
        Criteria(taxon="Q10", year_min=1996),
        Criteria(taxon="Q12", mass_min=903.0, year_min=1994, year_max=1997, formula_enabled=True, elements={"C": (5, 30)}, halogens={"Cl": "required"}),
        Criteria(taxon="Q10", smiles="CCO", mass_min=901.0),
        Criteria(taxon="Q10", formula_enabled=True, formula_exact="C7Cl"),
        Criteria(taxon="Q10", mass_min=9000.0),
    ],
)
def test_bounds(spark, graph, criteria):
    found = search(spark, graph, criteria, query_bits=[1, 2] if criteria.smiles else None)
    assert found.counted.first() == stats.dataset_stats(found.all_rows).first()


def test_structures_anywhere_are_counted_from_their_rows(spark, graph):
    found = search(spark, graph, Criteria(taxon="", smiles="CCO"), query_bits=[1, 2])
    assert found.counted is None
    assert found.stats.first()["n_entries"] == found.all_rows.count()


def test_heavy_keys_count_alike(graph):
    salted = Occurrences(graph, SkewPolicy(min_bytes=0, rows_per_salt=20, share=0.001))
    assert any(salted.heavy.of(c) for c in ("c", "t", "r"))
    assert counters(salted).first() == counters(Occurrences(graph)).first()


def test_no_text_is_moved(graph):
    plan = counters(Occurrences(graph))._jdf.queryExecution().executedPlan().toString()
    for column in ("p_name", "o_orderpriority", "s_name", "smiles", "inchikey"):
        exchanges = [line for line in plan.splitlines() if "Exchange" in line or "Output" in line]
        assert not any(column in line for line in exchanges)
    assert "p_brand" not in plan and "o_orderpriority" not in plan


def test_counters_do_not_run_the_search(spark, graph, monkeypatch):
    from occurra.plans import search as module

    def never(*a, **k):
        raise AssertionError

    monkeypatch.setattr(module, "enriched_matches", never)
    assert search(spark, graph, Criteria(taxon="Q10"), limit=3).stats.first()["n_returned"] == 3
