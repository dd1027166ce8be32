import itertools
import random

import pytest

from occurra.operators import similarity as sim


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


@pytest.fixture(scope="module")
def prints():
    """Random fingerprints of 130 bits with near copies, exact copies and an empty one."""
    rng = random.Random(7)
    base = [frozenset(rng.sample(range(130), rng.randint(3, 20))) for _ in range(60)]
    near = [b ^ {rng.randrange(130)} for b in base[:40]]
    return {f"c{i:03d}": b for i, b in enumerate([*base, *near, *([base[0]] * 50), frozenset()])}


@pytest.fixture(scope="module")
def frame(spark, prints):
    return spark.createDataFrame([(c, sorted(b)) for c, b in prints.items()], "c string, bits array<int>")


@pytest.mark.parametrize("block_rows", [20_000, 5, 1])
@pytest.mark.parametrize("threshold", [0.3, 0.8, 1.0])
def test_pairs_equal_brute_force(frame, prints, threshold, block_rows):
    got = sim.similar_pairs(frame, threshold, 130, block_rows).collect()
    reps = {}
    for c in sorted(prints, reverse=True):
        reps[prints[c]] = c
    named = {c: b for b, c in reps.items() if b}
    want = {
        (a, b)
        for a in named
        for b in named
        if a < b and jaccard(named[a], named[b]) >= threshold
    }
    assert len(got) == len(want)
    assert {(r["a"], r["b"]) for r in got} == want
    for r in got:
        assert r["similarity"] == pytest.approx(jaccard(named[r["a"]], named[r["b"]]))


@pytest.mark.parametrize("threshold, block_rows", [(0.3, 3), (0.5, 40), (0.6, 3)])
def test_small_sets_that_share_few_bits(spark, threshold, block_rows):
    sets = [frozenset(s) for n in (1, 2, 3) for s in itertools.combinations(range(9), n)]
    frame = spark.createDataFrame([(f"c{i:03d}", sorted(s)) for i, s in enumerate(sets)], "c string, bits array<int>")
    got = [(r["a"], r["b"]) for r in sim.similar_pairs(frame, threshold, 9, block_rows).collect()]
    named = {f"c{i:03d}": s for i, s in enumerate(sets)}
    assert sorted(got) == sorted((a, b) for a in named for b in named if a < b and jaccard(named[a], named[b]) >= threshold)


def test_postings_grow_with_the_rows(spark):
    rng = random.Random(3)

    def copies(n, block_rows=50):
        sets = set()
        while len(sets) < n:
            sets.add(frozenset(rng.sample(range(64), 8)))
        frame = spark.createDataFrame([(f"c{i:05d}", sorted(s)) for i, s in enumerate(sets)], "c string, bits array<int>")
        rows = sim._ranked(sim.fingerprint_groups(frame), 0.7, 64)
        return sim.similarity_postings(rows, 64, block_rows).selectExpr("sum(g)", "max(g)").first()

    small, large = copies(400), copies(4000)
    assert large[1] == 1
    # a row has three keys of one token, or in two cells six of two or ten of three, however long the lists are
    assert small[0] <= 20 * 400 and large[0] <= 20 * 4000


def test_copies_are_listed_once_each(frame, prints):
    members = sim.fingerprint_members(frame).collect()
    assert len(members) == len(prints)
    assert sum(r["rep"] == "c000" for r in members) == 51


@pytest.mark.parametrize("threshold", [0.2, 0.5, 1.0])
def test_search_equals_brute_force(frame, prints, threshold):
    query = prints["c003"]
    got = {r["c"]: r["similarity"] for r in sim.similar(frame, list(query), threshold, 130).collect()}
    assert got == pytest.approx({c: jaccard(b, query) for c, b in prints.items() if jaccard(b, query) >= threshold})
    assert got["c003"] == 1.0


def test_screen_equals_brute_force(frame, prints):
    query = sorted(prints["c005"])[:2] + [max(prints["c005"])]
    got = {r["c"] for r in sim.substructure_screen(frame, query, 130).collect()}
    assert got == {c for c, b in prints.items() if set(query) <= b} and "c005" in got


def test_high_bits_survive_packing(spark):
    df = spark.sql("SELECT 'x' AS c, array(63, 64, 127) AS bits")
    row = sim.packed(df, 128).first()
    assert [row["w0"], row["w1"]] == sim.literal_words([63, 64, 127], 128)


def test_dense_fingerprints_meet_in_a_grid_once(spark, monkeypatch):
    """Half of 64 bits set: the lists of tokens would make more candidates than there are pairs."""
    rng = random.Random(5)
    prints = {f"c{i:03d}": frozenset(rng.sample(range(64), rng.randint(24, 40))) for i in range(150)}
    prints |= {f"d{i:03d}": b ^ {rng.randrange(64)} for i, b in enumerate(list(prints.values())[:40])}
    frame = spark.createDataFrame([(c, sorted(b)) for c, b in prints.items()], "c string, bits array<int>")
    monkeypatch.setattr(sim, "similarity_postings", None)
    want = {(a, b) for a, b in itertools.combinations(sorted(prints), 2) if jaccard(prints[a], prints[b]) >= 0.6}
    for block_rows in (20_000, 30):
        got = [(r["a"], r["b"]) for r in sim.similar_pairs(frame, 0.6, 64, block_rows).collect()]
        assert len(got) == len(want) >= 40 and set(got) == want
