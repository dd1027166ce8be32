import hashlib
import math
import random

import pytest

from occurra.llm.centroid_clusters import centroid_clusters, cluster_digests, whole

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, dim=64, clusters=16, rounds=3, scale=64):
    """Lloyd's rounds in Python's whole numbers."""
    kept = [(i, [whole(v, scale) for v in x]) for i, x in rows if x is not None and len(x) == dim and all(v is not None and math.isfinite(v) for v in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [x for _, x in order[:clusters]]

    def nearest(x):
        every = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centers]
        return every.index(min(every)), min(every)

    for _ in range(rounds):
        owner = [nearest(x)[0] for _, x in kept]
        for c in range(len(centers)):
            own = [x for (_, x), o in zip(kept, owner, strict=True) if o == c]
            if own:
                centers[c] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    return [(i, *nearest(x)) for i, x in kept], centers


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def vectors(n, dim, seed, spread=0.12):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(dim)], i) for i in range(n)]


@pytest.mark.parametrize("entries", [4096, 3, 0])
@pytest.mark.parametrize("dim", [64, 5])
def test_against_plain_version(spark, dim, entries):
    rows = vectors(300, dim, 1)
    rows += [(500 + i, rows[7][1], 0) for i in range(200)]
    got, centers = centroid_clusters(spark.createDataFrame(rows, SCHEMA), dim=dim, entries=entries)
    want, want_centers = plain([r[:2] for r in rows], dim=dim)
    assert centers == want_centers
    assert ordered(tuple(r) for r in got.collect()) == ordered(want)


def test_very_large_components_stay_exact(spark):
    rows = vectors(60, 4, 2) + [(100 + i, [1e300 * (-1) ** i, 3e18 + i * 1e15, -7.5e9, 0.1], 0) for i in range(20)]
    got, centers = centroid_clusters(spark.createDataFrame(rows, SCHEMA), dim=4, clusters=6)
    want, want_centers = plain([r[:2] for r in rows], dim=4, clusters=6)
    assert centers == want_centers
    limit = (1 << 63) - 1
    assert ordered(tuple(r) for r in got.collect()) == ordered((i, c, min(d, limit)) for i, c, d in want)


def test_odd_vectors(spark):
    good = [0.5] * 64
    rows = [
        (1, good, 0), (1, good, 0), (None, good, 1), (2, None, 1), (3, [], 1), (4, [0.5] * 63, 1), (5, [0.5] * 63 + [None], 1),
        (6, [0.5] * 63 + [float("nan")], 1), (7, [0.5] * 63 + [float("-inf")], 1), (8, [-0.001] * 64, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS id", "'x' AS x", "'x' AS codes", "'x' AS cluster", "'x' AS distance")
    got = cluster_digests(df)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    # four vectors, hence four centroids of which two are equal to another and stay empty
    want, centers = plain([r[:2] for r in rows])
    assert ordered((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()) == ordered(want)
    digests = {r["cluster"]: r["centroid_sha256"] for r in got.collect()}
    assert all(h == hashlib.sha256(",".join(map(str, centers[c])).encode()).hexdigest() for c, h in digests.items())
    assert whole(-0.001, 64) == -1
    assert cluster_digests(df.limit(0)).count() == 0


def test_sums(spark):
    rows = cluster_digests(spark.createDataFrame(vectors(200, 64, 4), SCHEMA)).collect()
    assert {r["inertia"] for r in rows} == {sum(r["distance"] for r in rows)}
    for cluster in {r["cluster"] for r in rows}:
        own = [r for r in rows if r["cluster"] == cluster]
        assert {r["cluster_inertia"] for r in own} == {sum(r["distance"] for r in own)}
