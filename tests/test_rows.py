import pytest
from pyspark.sql import functions as F

from occurra.operators import filters, ordering, resolve, stats
from occurra.operators.digests import DigestTree
from occurra.operators.occurrences import Occurrences, pick_label
from occurra.plans.search import TaxonNotFound, any_taxon, resolve_taxon
from occurra.sources import star

ENTRY = "compound_qid string, taxon_qid string, reference_qid string"


def entries(table, rows, schema=ENTRY):
    return table(rows, schema)


def counters(df):
    return tuple(df.first()[c] for c in stats.COUNTERS)


def test_dataset_stats(table):
    rows = [("Q1", "Q10", "Q100")] * 2 + [("Q1", "Q11", "Q101"), ("Q2", "Q10", "Q100")]
    assert counters(stats.dataset_stats(entries(table, rows))) == (4, 3, 2, 2, 2)
    assert counters(stats.dataset_stats(entries(table, [("Q1", "Q2", "Q3")] * 5)))[:2] == (5, 1)
    assert counters(stats.dataset_stats(entries(table, []))) == (0, 0, 0, 0, 0)
    blank = [("Q1", None, None), ("Q1", None, "Q3")]
    assert counters(stats.dataset_stats(entries(table, blank))) == (2, 2, 1, 0, 1)


def test_capped_rows_and_stats(table):
    df = entries(table, [("Q1", "a", "r"), ("Q2", "a", "r"), ("Q3", "a", "r")])
    assert stats.capped_rows(df, [F.col("compound_qid")], 2).count() == 2
    row = stats.capped_stats(df, 2).first()
    assert (row["n_entries"], row["n_returned"], row["capped"]) == (3, 2, True)
    assert stats.capped_stats(df, 3).first()["capped"] is False


def test_dedup_keeps_the_first(table):
    df = table(
        [("Q1", "a", None, "S1"), ("Q1", "a", None, "S2"), ("Q2", "a", "r", "S3")], ENTRY + ", statement string"
    )
    kept = stats.dedup_entries(df, [F.col("statement")]).orderBy("statement").collect()
    assert [r["statement"] for r in kept] == ["S1", "S3"]


def test_long_lists_are_cut_exactly(spark, monkeypatch):
    monkeypatch.setattr(stats, "TOP_K_ROWS", 10)
    monkeypatch.setattr(stats, "CUT_RANGES", 7)
    df = spark.range(1000).selectExpr(
        "concat('Q', id % 400) AS compound_qid", "IF(id % 3 = 0, 'hot', concat('t', id)) AS taxon_qid", "'r' AS reference_qid"
    )
    order = [F.col(c) for c in stats.ENTRY_KEY]
    whole = [tuple(r) for r in df.distinct().orderBy(*order).collect()]
    for cap in (11, 500, len(whole), 5000):
        assert [tuple(r) for r in stats.capped_rows(df, order, cap).collect()] == whole[:cap]


def test_limits():
    assert [stats.row_limit(n) for n in (None, 0, 7, 5_000_000)] == [None, 1, 7, 5_000_000]


def test_result_hash_and_digest(table):
    df = table([("Q2",), ("Q1",), ("Q2",), (None,)], "compound_qid string")
    import hashlib

    assert stats.result_hash(df).first()[0] == hashlib.sha256(b"Q1|Q2").hexdigest()
    empty = df.filter("false")
    assert stats.result_hash(empty).first()[0] == hashlib.sha256(b"").hexdigest()
    twice = df.unionByName(df).repartition(7)
    assert stats.result_digest(df).first() == stats.result_digest(twice).first()
    assert stats.result_digest(df).first() != stats.result_digest(df.filter("compound_qid = 'Q1'")).first()


def test_digest_tree_follows_added_rows(spark, table, tmp_path):
    names = [(f"Q{i}",) for i in range(3000)]
    day = [("Q5",), (None,), ("Q9001",), ("Q9001",), ("Q9002",)]
    tree = DigestTree(spark, str(tmp_path / "tree"))
    tree.write(table(names, "compound_qid string"))
    want = [stats.result_digest(table(rows, "compound_qid string")).first() for rows in (names, names + day)]
    assert tree.digest(0).first() == want[0]
    for _ in range(2):  # a repeated run leaves the same
        tree.add(table(day, "compound_qid string"), 1)
        assert tree.digest(1).first() == want[1]
    # buckets without new ids keep their digests, and only the folders of the offered ids are read
    changed = tree.digests(1).join(tree.digests(0), ["bucket", "digest"], "left_anti").count()
    assert 1 <= changed <= 2
    plan = tree._ids(1, [3, 7])._jdf.queryExecution().executedPlan().toString()
    assert "part" in plan.split("PartitionFilters: [")[1].split("]")[0] and "IN (3,7)" in plan.split("PartitionFilters: [")[1]
    tree.add(table(day, "compound_qid string").filter("false"), 2)
    assert tree.digest(2).first() == want[1]
    none = DigestTree(spark, str(tmp_path / "none"))
    none.write(table(day, "compound_qid string").filter("false"))
    assert none.digest(0).first()[0] == stats.result_digest(table(day, "compound_qid string").filter("false")).first()[0]
    none.add(table(names, "compound_qid string"), 1)
    assert none.digest(1).first() == want[0]


@pytest.mark.parametrize("values", [["Gamma", "Alpha", "Beta"], ["Zeta", None, "Alpha"], [None, None, "x"], ["b", "B", "b"]])
def test_sort_and_its_reverse(table, values):
    df = table([(v, i) for i, v in enumerate(values)], "name string, pos int")
    up = [r["pos"] for r in ordering.sort_rows(df, "name", "asc", "pos").collect()]
    down = [r["pos"] for r in ordering.sort_rows(df, "name", "desc", "pos").collect()]
    assert up == sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or "", i))
    assert down == up[::-1]


def test_sort_rejects_other_columns(table):
    with pytest.raises(ValueError):
        ordering.sort_rows(table([(1,)], "pos int"), "pos", "asc", "pos")


def test_pages(table):
    df = table([(i, float(i % 3)) for i in range(20)], "pos int, mass double")
    order = ordering.sort_order("mass", "asc", "pos")
    whole = [r["pos"] for r in df.orderBy(*order).collect()]
    for first, size, overscan in [(0, 5, 0), (8, 4, 2), (18, 5, 3), (50, 5, 1)]:
        start, end = ordering.page_bounds(20, first, size, overscan)
        got = [r["pos"] for r in ordering.page(df, order, first, size, overscan).collect()]
        assert got == whole[start:end]
    keys = df.select(F.lpad(F.col("pos").cast("string"), 3, "0").alias("k"))
    assert [r["k"] for r in ordering.page_after(keys, "k", "004", 3).collect()] == ["005", "006", "007"]


def test_filters_skip_defaults_and_drop_absent(table):
    df = table([(None,), (5.0,), (20.0,)], "mass double")
    assert filters.filter_mass(df, 0, 10000).count() == 3
    assert filters.filter_mass(df, 5, 10000).count() == 2
    dates = df.select(F.to_timestamp(F.lit("1999-05-01")).alias("ref_date"))
    assert filters.filter_year(dates, 1800) is dates
    assert filters.filter_year(dates, 1999, 1999).count() == 3
    formulas = table([("C₆H6",), (None,), ("C6H5Cl",)], "formula_raw string")
    assert filters.filter_halogens(formulas, {"Cl": "excluded"}).count() == 1
    assert filters.filter_halogens(formulas, {"Cl": "whatever"}).count() == 3
    assert filters.filter_elements(formulas, {"C": (0, 512)}).count() == 3
    assert filters.filter_formula_exact(formulas, " C6 H₆ ").count() == 1


def test_label_pick(table):
    labels = table([("a", "A", "en"), ("a", "M", "mul"), ("b", "B", "en"), ("c", "C", "fr")], "c string, v string, lang string")
    assert sorted(tuple(r) for r in pick_label(labels).collect()) == [("a", "M", "mul"), ("b", "B", "en")]


MATCH = "input string, qid string, name string, pos int"


@pytest.mark.parametrize(
    "names, best, ambiguous",
    [
        ([("Q2", "Rosa rubiginosa"), ("Q1", "Rosa")], "Q1", False),
        ([("Q2", "rubiginosa"), ("Q3", "canina")], "Q2", True),
        ([("Q1", "Rosa"), ("Q2", "rosa")], "Q1", True),
        ([("Q2", "canina")], "Q2", False),
    ],
)
def test_best_match(table, names, best, ambiguous):
    df = table([("rosa", q, n, i) for i, (q, n) in enumerate(names)], MATCH)
    row = resolve.rank_matches(df).first()
    assert (row["qid"], row["ambiguous"]) == (best, ambiguous)
    assert row["candidates"] == [f"{n} ({q})" for q, n in names][:4]


def test_resolve_taxon(spark):
    graph = star.graph(spark, "/root/testdata/sf0.001")
    assert resolve_taxon(spark, graph, "").qid is None
    assert resolve_taxon(spark, graph, "*").qid == "*"
    assert resolve_taxon(spark, graph, " q12").qid == "Q12"
    found = resolve_taxon(spark, graph, "_BIOTA")
    assert found.qid == "Q1" and "standardised" in found.warning
    with pytest.raises(TaxonNotFound):
        resolve_taxon(spark, graph, "Ficticia imaginaria")


def test_taxon_resolution_prefers_given_spelling(table):
    names = table([(1, " ficticia IMAGINARIA "), (2, "Ficticia imaginaria"), (3, None)], "seq long, taxon string")
    taxa = table([("Q9", "Ficticia imaginaria"), ("Q10", "Ficticia imaginaria"), ("Q3", "Ficticia imaginaria")], "t string, name string")
    is_taxon = table([("Q9",), ("Q10",)], "t string")
    assert resolve.resolve_taxa(names, taxa, is_taxon).collect() == []
    found = {r["name"]: r["t"] for r in resolve.resolve_taxa_fallback(names, taxa, is_taxon).collect()}
    assert found == {"ficticia IMAGINARIA": "Q9", "Ficticia imaginaria": "Q9"}


def test_compounds_without_occurrence_survive(spark):
    graph = star.graph(spark, "/root/testdata/sf0.001")
    few = type(graph)(**{**graph.__dict__, "statements": graph.statements.filter("c = 'Q1000001'")})
    rows = any_taxon(Occurrences(few), graph.compound_ids.filter("c IN ('Q1000001', 'Q1000002')"))
    alone = rows.filter("statement IS NULL").collect()
    assert [r["c"] for r in alone] == ["Q1000002"]
    assert rows.filter("c = 'Q1000001'").count() == few.statements.count()


def test_places_need_no_shuffle_of_the_rows(spark):
    from occurra.catalog.search import _placed

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = _placed(spark.range(1000).selectExpr("concat('S', id) AS statement", "id").orderBy(F.col("id").desc()))
        assert "SortMergeJoin" not in placed._jdf.queryExecution().executedPlan().toString()
        assert {r["place"]: r["statement"] for r in placed.collect()} == {i + 1: f"S{999 - i}" for i in range(1000)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
