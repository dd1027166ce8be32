import random

import pytest

from occurra.operators.similarity import similar, substructure_screen
from occurra.operators.structures import FingerprintIndex, write_index

N_BITS = 130


@pytest.fixture(scope="module")
def prints(spark):
    rng = random.Random(11)
    base = [rng.sample(range(N_BITS), rng.randint(1, 25)) for _ in range(80)]
    near = [sorted(set(b) ^ {rng.randrange(N_BITS)}) for b in base[:50]]
    # a bit that nearly all hold, and one fingerprint without any
    rows = [(f"c{i:03d}", sorted({0, *b})) for i, b in enumerate([*base, *near, *[base[0]] * 30])] + [("empty", [])]
    return spark.createDataFrame(rows, "c string, bits array<int>")


@pytest.fixture(scope="module")
def index(spark, prints, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    write_index(prints, folder, N_BITS)
    return FingerprintIndex(spark, folder, N_BITS)


def queries(prints):
    rows = [r["bits"] for r in prints.collect() if r["bits"]]
    return [rows[0], rows[5], rows[60][:3], rows[100], [0], [1, 129], [3, 64, 128]]


def test_screen_equals_the_scan_and_reads_one_bit(index, prints):
    for bits in queries(prints):
        found = index.screen(bits)
        assert sorted(found.collect()) == sorted(substructure_screen(prints, bits, N_BITS).collect())
        plan = found._jdf.queryExecution().executedPlan().toString()
        pruned = plan.split("PartitionFilters: [")[1].split("]")[0]
        rarest = min(set(bits), key=lambda b: (index.frequency.get(b, 0), b))
        assert f"(bit" in pruned and f"= {rarest})" in pruned
        assert "GreaterThanOrEqual(size" in plan
    with pytest.raises(ValueError):
        index.screen([])


@pytest.mark.parametrize("threshold", [0.05, 0.4, 0.8, 1.0])
def test_similar_equals_the_scan(index, prints, threshold):
    for bits in queries(prints):
        assert sorted(index.similar(bits, threshold).collect()) == sorted(similar(prints, bits, threshold, N_BITS).collect())
    assert index.similar([], 0.5).count() == 0


def test_batch_equals_one_by_one(spark, index, prints):
    asked = []
    for i, bits in enumerate(queries(prints)):
        asked += [(f"s{i}", bits + bits[:1], "substructure", 0.8)] + [(f"t{i}-{t}", bits, "similarity", t) for t in (0.05, 0.4, 0.8, 1.0)]
    asked += [("none", [], "substructure", 0.8), ("null", None, "similarity", 0.8)]
    got = index.batch(spark.createDataFrame(asked, "key string, bits array<int>, kind string, threshold double")).collect()
    found = {}
    for r in got:
        found.setdefault(r["key"], []).append((r["c"], r["similarity"]))
    for key, bits, kind, threshold in asked:
        if not bits:
            assert key not in found
        elif kind == "substructure":
            assert sorted(found.get(key, [])) == sorted((r["c"], None) for r in substructure_screen(prints, bits, N_BITS).collect())
        else:
            assert sorted(found.get(key, [])) == sorted((r["c"], r["similarity"]) for r in similar(prints, bits, threshold, N_BITS).collect())


def test_batch_is_one_join_over_the_bits_asked_for(spark, index, prints):
    rows = [(str(i), r["bits"], "similarity", 0.8) for i, r in enumerate(prints.collect()[:100])]
    joined = index.batch(spark.createDataFrame(rows, "key string, bits array<int>, kind string, threshold double"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "PartitionFilters: [bit" in plan


@pytest.mark.parametrize("n_bits", [64, 130])
def test_queries_with_long_postings_meet_each_fingerprint_once(spark, tmp_path, n_bits):
    rng = random.Random(n_bits)
    rows = [(f"c{i:03d}", sorted(rng.sample(range(n_bits), rng.randint(n_bits // 3, 2 * n_bits // 3)))) for i in range(120)]
    rows += [("first", [0, 1]), ("last", [n_bits - 1]), ("c000", rows[1][1])]
    write_index(spark.createDataFrame(rows, "c string, bits array<int>"), str(tmp_path), n_bits)
    index = FingerprintIndex(spark, str(tmp_path), n_bits)
    assert index.counted == (123, 122)
    asked = [(f"q{i}", rows[i][1], "similarity", 0.3 + i / 100) for i in range(40)] + [("few", [0, 1], "similarity", 0.9), ("end", [n_bits - 1], "similarity", 0.5), ("screen", rows[3][1][:5], "substructure", 0.3)]
    joined = index.batch(spark.createDataFrame(asked, "key string, bits array<int>, kind string, threshold double"))
    want = sorted(
        (key, c)
        for key, q, kind, threshold in asked
        for c, bits in rows
        if (len(set(q) & set(bits)) / len(set(q) | set(bits)) >= threshold if kind == "similarity" else set(q) <= set(bits))
    )
    assert sorted((r["key"], r["c"]) for r in joined.collect()) == want and len(want) > 500
    # before, such a query had a row for each of its chosen bits and size bands
    assert joined._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
    assert index.first_postings.count() == len(rows)
