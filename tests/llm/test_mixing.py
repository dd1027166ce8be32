import re
from collections import defaultdict

import duckdb
import pytest

from occurra.llm import mixing
from occurra.llm.mixing import mix_sources, mixed, water_fill


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def filled(sizes, weights, most=3):
    """Water-filling one clamp at a time."""
    targets, left, free = {}, float(sum(sizes.values())), dict(weights)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if free[s] * level > most * sizes[s]]
        if not over:
            return targets | {s: w * level for s, w in free.items()}
        for s in over:
            targets[s] = most * sizes[s]
            left -= targets[s]
            del free[s]
    return targets


@pytest.mark.parametrize(
    "sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, "d": 5}, {"a": 0, "b": 7}, {"a": 5}, {"a": 3, "b": 0, "c": 900, "d": 1, None: 2}]
)
def test_water_filling(spark, sizes):
    weights = {s: float(1 + i % 3) for i, s in enumerate(sizes)}
    rows = [(s, weights[s], n) for s, n in sizes.items()]
    got = water_fill(spark.createDataFrame(rows, "source string, weight double, source_size long")).collect()
    want = filled(sizes, weights)
    assert {r.source: pytest.approx(r.target) for r in got} == want


def test_given_documents_against_brute_force_and_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in mix_sources(docs).collect()}
    texts = {r.doc_id: (r.source, words(r.text)) for r in docs.collect()}
    sizes = defaultdict(int)
    for s, n in texts.values():
        sizes[s] += n
    weights = {s: 1 + i % 3 for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    targets = filled(sizes, weights)
    taken = defaultdict(int)
    assert set(rows) == set(texts)
    for i, r in rows.items():
        assert (r.source, r.size) == texts[i] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source]) and r.taken == r.size * r.repeats <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        longest = max(n for t, n in texts.values() if t == s)
        assert abs(taken[s] - targets[s]) <= longest
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = db.execute(mixing.ORACLE_SQL)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(next(iter(rows.values())).asDict())
    for line in cursor.fetchall():
        want = dict(zip(names, line, strict=True))
        assert rows[want["doc_id"]].asDict() == want


def test_reruns_agree_and_the_seed_matters(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = sorted(mix_sources(docs).collect())
    assert sorted(mix_sources(docs.repartition(7)).collect()) == first
    assert sorted(mix_sources(docs, seed=18).collect()) != first


def test_given_weights_leave_other_sources_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = spark.createDataFrame([("src1", 5.0), ("src2", 1.0)], "source string, weight double")
    rows = mix_sources(docs, weights).collect()
    assert {r.source for r in rows if r.taken} == {"src1", "src2"}
    assert all(r.taken == 3 * r.size for r in rows if r.source == "src1")


def test_taken_rows_carry_their_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.repeats for r in mix_sources(docs).collect() if r.repeats}
    got = mixed(docs)
    assert got.columns == [*docs.columns, "repeats"]
    assert {r.doc_id: r.repeats for r in got.collect()} == want


def test_odd_rows(odd_documents):
    rows = mix_sources(odd_documents).collect()
    assert len(rows) == 9 and {r.source for r in rows} == {"a", "b", None}
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].size == by_id[2].size == by_id[3].size == 0 and by_id[6].size == 40_000
    assert by_id[2].target == 0 and by_id[2].taken == 0
    assert mix_sources(odd_documents.limit(0)).collect() == []
    assert mixed(odd_documents).columns == [*odd_documents.columns, "repeats"]
