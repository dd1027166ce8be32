"""What is shuffled on the way to enriched rows and entries."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from occurra.model import Criteria, Graph
from occurra.operators import ranges
from occurra.operators.occurrences import Occurrences, enrich, result_rows
from occurra.operators.stats import dedup_entries
from occurra.plans import requests as plan
from occurra.plans.search import COMPOUND, search
from occurra.sources import star

TABLES = {
    "compound_ids": ("c string, inchikey string, smiles_conn string", [("Q1", "K1", "C"), ("Q2", "K2", "N"), (None, "K3", "O")]),
    "statements": (
        "statement string, c string, t string, ref string, r string",
        [("S1", "Q1", "Q10", "R1", "Q20"), ("S2", "Q1", "Q10", "R2", "Q20"), ("S3", "Q2", "Q11", "R3", None), ("S4", "Q1", None, "R4", "Q21"), ("S5", None, "Q10", "R5", "Q20"), ("S6", "Q2", "Q10", "R6", "Q21")],
    ),
    "taxon_names": ("t string, name string", [("Q10", "Rosa"), ("Q11", "Tilia"), ("Q1", "Biota")]),
    "taxon_parent": ("child string, parent string", [("Q10", "Q1"), ("Q11", "Q1")]),
    "instance_of": ("t string", [("Q10",)]),
    "smiles_iso": ("c string, v string", []),
    "mass": ("c string, v double", [("Q1", 10.0), ("Q1", 11.0)]),
    "formula_raw": ("c string, v string", [("Q1", "C2"), ("Q2", "C9")]),
    "inchi": ("c string, v string", []),
    "labels": ("c string, v string, lang string", [("Q1", "one", "en")]),
    "ref_title": ("r string, v string", [("Q20", "T")]),
    "ref_doi": ("r string, v string", [("Q20", "10.1/X")]),
    "ref_date": ("r string, v timestamp_ntz", [("Q20", datetime(1999, 2, 3)), ("Q21", datetime(2005, 2, 3))]),
    "fingerprints": ("c string, bits array<int>", []),
}


@pytest.fixture
def occ(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for large tables
    yield Occurrences(Graph(**{n: spark.createDataFrame(rows, schema) for n, (schema, rows) in TABLES.items()}))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_enriched_rows(occ):
    rows = enrich(occ).select("statement", "mass", "ref_title", "taxon_name", "label").collect()
    both = [("S1", m, "T", "Rosa", "one") for m in (10.0, 11.0)] + [("S2", m, "T", "Rosa", "one") for m in (10.0, 11.0)]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [*both, ("S3", None, None, "Tilia", None), ("S6", None, None, "Rosa", None)]))


def test_no_shuffle_carries_the_compound_table(occ):
    lines = enrich(occ)._jdf.queryExecution().executedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    assert "[c#" in lines[first]  # the last join is by compound


def test_entries_are_formed_where_the_rows_lie(occ):
    rows = result_rows(enrich(occ))
    order = [F.col("statement").asc(), F.col("mass").asc_nulls_first()]
    entries = dedup_entries(rows, order, COMPOUND)
    assert shuffles(entries) == shuffles(rows)
    key = lambda df: sorted(map(str, df.collect()))
    assert key(entries) == key(dedup_entries(rows, order))


def test_a_selection_of_compounds_cuts_the_statements_first(spark, occ):
    found = search(spark, occ, Criteria(taxon="*", mass_min=5.0, mass_max=10.5))
    assert sorted(r["statement"] for r in found.rows.collect()) == ["S1"]
    assert "LeftSemi" in found.matches._jdf.queryExecution().executedPlan().toString()


def test_requests_for_all_rows_store_no_rows(spark, occ, monkeypatch):
    stored = []
    cut = plan.cut_lineage
    monkeypatch.setattr(plan, "cut_lineage", lambda df, label: stored.append(label) or cut(df, label))
    asked = spark.createDataFrame([("a", "*", None, None), ("b", "*", 2000, None), ("c", "*", None, 2000)], "req_id string, taxon string, year_min int, year_max int")
    rows, _ = plan.search_requests(occ, asked, 2025)
    got = sorted({(r["req_id"], r["statement"]) for r in rows.collect()})
    assert got == [("a", s) for s in ("S1", "S2", "S3", "S6")] + [("b", "S6")] + [("c", s) for s in ("S1", "S2")]
    assert "rows" not in stored


def test_grids_of_another_table(spark):
    points = spark.range(50).selectExpr("id", "IF(id % 7 = 0, NULL, id) AS v")
    asked = spark.createDataFrame([(1, 3.0, 9.0), (2, None, 5.0), (3, 60.0, None)], "k int, low double, high double")
    dims = {"v": (F.col("low"), F.col("high"))}
    inside = F.coalesce(F.col("v") >= F.col("low"), F.col("low").isNull()) & F.coalesce(F.col("v") <= F.col("high"), F.col("high").isNull()) & F.col("v").isNotNull()
    known = ranges.grids(spark.range(20, 90).selectExpr("id AS v"), ["v"])
    both = [sorted((r["id"], r["k"]) for r in ranges.range_join(points, asked, dims, inside, F.xxhash64("id"), known=k).collect()) for k in (None, known)]
    assert both[0] == both[1] and len(both[0]) == 6 + 5


def test_names_that_are_broadcast_are_joined_last(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    tops = []
    try:
        for threshold in ("10m", "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            plan = enrich(Occurrences(star.graph(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
            top = next(line for line in plan.splitlines() if "Join " in line)
            tops.append(re.search(r"\((\w+)#\d+ = \w+#\d+\)", top)[1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert tops == ["t", "c"]
