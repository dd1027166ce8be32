import pytest
from pyspark.sql import functions as F

from occurra.operators import skew
from occurra.operators.occurrences import Occurrences, enrich
from occurra.sources import star

EAGER = skew.SkewPolicy(min_bytes=0, rows_per_salt=50, share=1 / 20)


@pytest.fixture(scope="module")
def facts(spark):
    """A third of the rows share one key; NULL keys are frequent too."""
    return spark.range(3000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 10 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), F.col("id") % 400))
        .alias("k"),
    )


def test_heavy_keys(facts):
    found = skew.heavy_keys(facts, ["k"], EAGER)
    assert set(found.of("k")) == {"hot"}
    assert found.of("k")["hot"] == 20
    assert skew.heavy_keys(facts, ["k"]).of("k") == {}
    assert skew.heavy_keys(facts, ["k"], EAGER, rows=10).of("k") == {}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_attach_gives_the_plain_join(spark, facts, how):
    dim = spark.sql("SELECT 'hot' AS k, 1 AS v UNION ALL SELECT 'hot', 2 UNION ALL SELECT concat('k', id), 3 FROM range(200)")
    plain = facts.join(dim, "k", how)
    salted = skew.attach(facts, [(dim, how)], "k", {"hot": 7, "absent": 3}, F.col("seq"))
    assert salted.columns == plain.columns
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, salted.collect())) == sorted(map(key, plain.collect()))


def test_attach_spreads_the_hot_key(spark, facts):
    dim = spark.sql("SELECT 'hot' AS k, 1 AS v")
    salted = skew.attach(facts, [(dim.withColumn("w", F.lit(1)), "left")], "k", {"hot": 8}, F.col("seq"))
    plan = salted._jdf.queryExecution().toString()
    assert skew.SALT in plan
    hot = facts.filter("k = 'hot'").withColumn("s", F.pmod(F.xxhash64("seq"), F.lit(8)))
    largest = max(r["count"] for r in hot.groupBy("s").count().collect())
    assert largest < 1000 / 8 * 1.5


def test_many_counted_rows_are_not_broadcast(spark, facts):
    few = spark.sql("SELECT concat('k', id) AS k FROM range(50)")
    plans = [facts.join(skew.by_rows(few, rows).select("k"), "k", "left_semi")._jdf.queryExecution().executedPlan().toString() for rows in (skew.BROADCAST_ROWS, skew.BROADCAST_ROWS + 1)]
    assert ["BroadcastHashJoin" in plan for plan in plans] == [True, False]


def test_keep_first_limits_groups_before_the_shuffle(facts):
    first = skew.keep_first(facts.filter("k IS NOT NULL"), ["k"], [F.col("seq").desc()])
    assert first.filter("k = 'hot'").first()["seq"] == 2997
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") < plan.index("Exchange")


def test_enriched_rows_do_not_depend_on_the_policy(spark):
    graph = star.graph(spark, "/root/testdata/sf0.001")
    hot = F.when(F.col("statement").like("%1"), "Q1000003").otherwise(F.col("c"))
    skewed = type(graph)(**{**graph.__dict__, "statements": graph.statements.withColumn("c", hot)})
    salted = Occurrences(skewed, skew.SkewPolicy(min_bytes=0, rows_per_salt=100, share=1 / 20))
    assert "Q1000003" in salted.heavy.of("c")
    plain = Occurrences(skewed)
    assert plain.heavy.of("c") == {}
    columns = ("statement", "c", "t", "r", "mass", "label", "ref_title")
    rows = [sorted(map(str, enrich(o).select(*columns).collect())) for o in (plain, salted)]
    assert rows[0] == rows[1] and len(rows[0]) > 6000
