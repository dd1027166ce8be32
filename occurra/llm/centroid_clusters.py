"""Centroid clustering of whole-number vectors over dictionaries of subvectors.

Vectors are cut into blocks of two components and every block is replaced by the number of its pair in the
dictionary of that block, which is exact. A round computes the squared distance of every dictionary entry to
the centroids' part of the block once; the distance of a vector is the sum of the entries its codes name. The
dictionaries have a fixed size: pairs beyond it are kept as they are beside the codes, and only those are
computed vector by vector.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import only, records, small_batches
from occurra.session import cut_lineage

WIDTH = 2
#: Pairs in the dictionary of one block, the most frequent ones.
ENTRIES = 4_096
#: Vectors with a component beyond this are calculated in Python's whole numbers; below it no sum of 64 squares overflows.
SAFE = 1 << 27
#: Whole numbers travel between tasks in limbs of so many bits, so that no sum overflows.
LIMB = 31
MOST_LONG = (1 << 63) - 1


def whole(x: float, scale: int) -> int:
    """``floor(scale * x)`` for any finite double."""
    product = x * scale
    return math.floor(product) if math.isfinite(product) else int(x) * scale


def kept_vectors(vectors: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    """``id, x`` of the vectors with exactly ``dim`` components, all of them finite numbers."""
    rows = only(vectors, id=id_col, x=F.col(f"`{vector_col}`").cast("array<double>"))
    return rows.filter((F.size("x") == dim) & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _pairs(numbers: np.ndarray) -> np.ndarray:
    """Components (a row per vector, an even number, within ``SAFE``) as one number per block."""
    numbers = numbers.astype(np.int64)
    return (numbers[:, 0::2] << 32) | (numbers[:, 1::2] & 0xFFFFFFFF)


def _components(pairs: np.ndarray) -> np.ndarray:
    """The two components of each packed pair, in a last dimension."""
    return np.stack([pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32).astype(np.int32).astype(np.int64)], axis=-1)


def _padded(values: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """``floor(scale * x)`` as floats, with a zero column to an even width, and which rows are within ``SAFE``."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    if scaled.shape[1] % WIDTH:
        scaled = np.column_stack([scaled, np.zeros(len(scaled))])
    return scaled, (np.abs(scaled) <= SAFE).all(axis=1)


@dataclass(frozen=True)
class Dictionary:
    """Per block the packed pairs in ascending order; a code is a place in it, -1 stands for a pair that is not there."""

    pairs: tuple[np.ndarray, ...]

    def codes(self, pairs: np.ndarray) -> np.ndarray:
        out = np.full(pairs.shape, -1, dtype=np.int32)
        for b, known in enumerate(self.pairs):
            if len(known):
                at = np.minimum(np.searchsorted(known, pairs[:, b]), len(known) - 1)
                out[:, b] = np.where(known[at] == pairs[:, b], at, -1)
        return out

    def distances(self, centroids: np.ndarray) -> list[np.ndarray]:
        """Per block a table (entry x centroid) of squared distances, and a last row of zeros for code -1."""
        tables = []
        for b, known in enumerate(self.pairs):
            away = _components(known).astype(centroids.dtype)[:, None, :] - centroids[None, :, WIDTH * b : WIDTH * (b + 1)]
            tables.append(np.concatenate([(away * away).sum(axis=2), np.zeros((1, len(centroids)), dtype=centroids.dtype)]))
        return tables


def dictionary(kept: DataFrame, dim: int, scale: int, entries: int = ENTRIES) -> Dictionary:
    """The ``entries`` most frequent pairs of every block, the smaller one among equally frequent ones."""
    blocks = (dim + WIDTH - 1) // WIDTH

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches, 10_000):
            numbers, safe = _padded(_matrix(batch["x"], dim), scale)
            pairs = _pairs(numbers[safe])
            for b in range(blocks):
                values, n = np.unique(pairs[:, b], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), b, dtype=np.int32)), pa.array(values), pa.array(n.astype(np.int64))], names=["block", "pair", "n"])

    counted = kept.mapInArrow(count, "block int, pair long, n long").groupBy("block", "pair").agg(F.sum("n").alias("n"))
    # the groups' limit is applied in every task before rows of a block meet
    ranked = counted.selectExpr("block", "pair", "row_number() OVER (PARTITION BY block ORDER BY n DESC, pair) AS place").filter(f"place <= {entries}")
    found: list[list[int]] = [[] for _ in range(blocks)]
    for r in ranked.collect():  # at most blocks x entries rows
        found[r["block"]].append(r["pair"])
    return Dictionary(tuple(np.array(sorted(x), dtype=np.int64) for x in found))


def encode(kept: DataFrame, known: Dictionary, dim: int, scale: int) -> DataFrame:
    """``id, codes, rest, wide``: ``rest`` are the pairs of the codes -1 in order; ``wide`` are the components, as
    decimal text, of a vector beyond ``SAFE``, whose codes are all -1."""
    blocks = (dim + WIDTH - 1) // WIDTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches, 10_000):
            values = _matrix(batch["x"], dim)
            numbers, safe = _padded(values, scale)
            pairs = _pairs(np.where(safe[:, None], numbers, 0))
            codes = known.codes(pairs)
            codes[~safe] = -1
            missing = (codes < 0) & safe[:, None]
            offsets = np.append(0, np.cumsum(missing.sum(axis=1)))
            wide = [None if s else [str(whole(float(v), scale)) for v in row] for s, row in zip(safe, values, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"],
                    pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * blocks, pa.int32()), pa.array(codes.ravel(), pa.int32())),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(pairs[missing], pa.int64())),
                    pa.array(wide, pa.list_(pa.string())),
                ],
                names=["id", "codes", "rest", "wide"],
            )

    return kept.mapInArrow(run, f"id {dict(kept.dtypes)['id']}, codes array<int>, rest array<long>, wide array<string>")


def _nearest(batch: pa.RecordBatch, tables: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Cluster and distance of every vector of a batch, the codes, and ``(row, block, pair)`` of what they leave out."""
    codes = _matrix(batch["codes"], len(tables))
    totals = np.zeros((len(codes), len(centroids)), dtype=centroids.dtype)
    for b, distances in enumerate(tables):
        totals += distances[codes[:, b]]
    wide = batch["wide"].is_valid().to_numpy(zero_copy_only=False)
    row, block = np.nonzero((codes < 0) & ~wide[:, None])
    rest = _components(batch["rest"].flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    if len(row):
        away = rest.astype(centroids.dtype)[:, None, :] - centroids.reshape(len(centroids), -1, WIDTH)[:, block, :].transpose(1, 0, 2)
        np.add.at(totals, row, (away * away).sum(axis=2))
    cluster = totals.argmin(axis=1)
    distance = np.take_along_axis(totals, cluster[:, None], axis=1)[:, 0].astype(object)
    for i in np.flatnonzero(wide):
        x = [int(v) for v in batch["wide"][int(i)].as_py()]
        every = [sum((a - int(c)) ** 2 for a, c in zip(x, center, strict=False)) for center in centroids]
        distance[i] = min(every)
        cluster[i] = every.index(distance[i])
    return cluster, distance, codes, [row, block, rest]


def _limbs(value: int) -> Iterator[int]:
    """Digits of a whole number in base ``2 ** LIMB``; all but the last are not negative."""
    while not -(1 << LIMB) <= value < 1 << LIMB:
        yield value & ((1 << LIMB) - 1)
        value >>= LIMB
    yield value


def _sums(coded: DataFrame, known: Dictionary, centroids: np.ndarray, dim: int) -> dict[tuple[int, int], int]:
    """Component sums ``(cluster, component)`` of the vectors nearest to each centroid; component -1 is their number.

    Every task sends its sums once; a few numbers per cluster and component reach the driver.
    """
    tables = coded.sparkSession.sparkContext.broadcast(known.distances(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), len(tables.value) * WIDTH), dtype=object)
        sizes = np.zeros(len(centroids), dtype=np.int64)
        for batch in records(batches, 10_000):
            cluster, _, codes, (row, block, rest) = _nearest(batch, tables.value, centroids)
            sizes += np.bincount(cluster, minlength=len(centroids))
            numbers = np.zeros((*codes.shape, WIDTH), dtype=np.int64)
            for b, pairs in enumerate(known.pairs):
                if len(pairs):
                    numbers[:, b] = np.where((codes[:, b] >= 0)[:, None], _components(pairs)[np.maximum(codes[:, b], 0)], 0)
            numbers[row, block] = rest
            part = np.zeros(sums.shape, dtype=np.int64)
            np.add.at(part, cluster, numbers.reshape(len(codes), -1))
            sums += part
            for i in np.flatnonzero(batch["wide"].is_valid().to_numpy(zero_copy_only=False)):
                sums[cluster[i], :dim] += np.array([int(v) for v in batch["wide"][int(i)].as_py()], dtype=object)
        out = [(c, -1, 0, int(n)) for c, n in enumerate(sizes) if n]
        out += [(c, j, k, limb) for c in np.flatnonzero(sizes).tolist() for j in range(dim) for k, limb in enumerate(_limbs(int(sums[c, j])))]
        columns = [np.array([r[i] for r in out], dtype=np.int64) for i in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["cluster", "component", "limb", "value"])

    rows = coded.select("codes", "rest", "wide").mapInArrow(run, "cluster long, component long, limb long, value long")
    totals: dict[tuple[int, int], int] = {}
    for r in rows.groupBy("cluster", "component", "limb").agg(F.sum("value").alias("value")).collect():
        key = r["cluster"], r["component"]
        totals[key] = totals.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
    tables.unpersist()
    return totals


def _exact(centroids: list[list[int]], dim: int) -> np.ndarray:
    """Centroids as a matrix of an even width; of Python's whole numbers where 64-bit ones could overflow."""
    blocks = (dim + WIDTH - 1) // WIDTH
    kind = np.int64 if all(abs(v) <= SAFE for c in centroids for v in c) and dim <= 64 else object
    out = np.zeros((len(centroids), blocks * WIDTH), dtype=kind)
    for i, c in enumerate(centroids):
        out[i, :dim] = c
    return out


def centroid_clusters(
    vectors: DataFrame,
    dim: int = 64,
    clusters: int = 16,
    rounds: int = 3,
    scale: int = 64,
    seed: Column | None = None,
    entries: int = ENTRIES,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> tuple[DataFrame, list[list[int]]]:
    """``id, cluster, distance`` of every vector with ``dim`` finite components, and the final centroids.

    Components are ``floor(scale * x)``. The first centroids are the ``clusters`` vectors with the smallest ``seed``
    (of column ``id``; by default a digest of it), NULL last, then by components; fewer vectors make fewer centroids,
    none an empty result. A round takes every vector to the nearest centroid, the smaller number among equally near
    ones, and moves every centroid that has vectors to the floor of their mean. Repeated ids are vectors of their
    own. All sums are exact; a distance beyond 64 bits is given as the largest 64-bit number.
    """
    kept = kept_vectors(small_batches(vectors), dim, id_col, vector_col)
    seed = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256) if seed is None else seed
    first = kept.select(seed.alias("seed"), "x").orderBy(F.asc_nulls_last("seed"), "x").limit(clusters).collect()
    # vectors with equal components after rounding down are equally good, whichever comes first
    centroids = [[whole(v, scale) for v in r["x"]] for r in first]
    if not centroids:
        empty = kept.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return empty.limit(0), []
    known = dictionary(kept, dim, scale, entries)
    coded = cut_lineage(encode(kept, known, dim, scale), "codes")
    for _ in range(rounds):
        totals = _sums(coded, known, _exact(centroids, dim), dim)
        centroids = [[totals[c, j] // totals[c, -1] for j in range(dim)] if (c, -1) in totals else old for c, old in enumerate(centroids)]
    last = _exact(centroids, dim)
    tables = coded.sparkSession.sparkContext.broadcast(known.distances(last))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches, 10_000):
            cluster, distance, *_ = _nearest(batch, tables.value, last)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(cluster, pa.int32()), pa.array([min(int(d), MOST_LONG) for d in distance], pa.int64())], names=["id", "cluster", "distance"]
            )

    return cut_lineage(coded.mapInArrow(assign, f"id {dict(coded.dtypes)['id']}, cluster int, distance long"), "clusters"), centroids


def cluster_digests(vectors: DataFrame) -> DataFrame:
    """``vec_id, cluster, distance`` with the distances summed by cluster and over all, and a digest of the centroid."""
    found, centroids = centroid_clusters(vectors)
    # one row per cluster
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = [min(sums.get(c, 0), MOST_LONG) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"), F.col("cluster"))

    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), MOST_LONG)).cast("long").alias("inertia"),
        of_cluster(digests, "string").alias("centroid_sha256"),
    )


ORACLE_SQL = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS i, vec_id,
    list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), cells AS (
  SELECT i, unnest(v) AS x, unnest(range(1, 65)) AS j FROM kept
), c0 AS (
  SELECT i AS c, j, x FROM cells WHERE i < 16
), d1 AS (
  SELECT v.i, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM cells v JOIN c0 c ON v.j = c.j GROUP BY v.i, c.c
), a1 AS (
  SELECT i, c FROM (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY d, c) AS r FROM d1) t WHERE r = 1
), c1 AS (
  SELECT c0.c, c0.j, coalesce(m.x, c0.x) AS x FROM c0 LEFT JOIN (
    SELECT a.c, v.j, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM cells v JOIN a1 a ON v.i = a.i GROUP BY a.c, v.j) m ON c0.c = m.c AND c0.j = m.j
), d2 AS (
  SELECT v.i, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM cells v JOIN c1 c ON v.j = c.j GROUP BY v.i, c.c
), a2 AS (
  SELECT i, c FROM (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY d, c) AS r FROM d2) t WHERE r = 1
), c2 AS (
  SELECT c1.c, c1.j, coalesce(m.x, c1.x) AS x FROM c1 LEFT JOIN (
    SELECT a.c, v.j, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM cells v JOIN a2 a ON v.i = a.i GROUP BY a.c, v.j) m ON c1.c = m.c AND c1.j = m.j
), d3 AS (
  SELECT v.i, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM cells v JOIN c2 c ON v.j = c.j GROUP BY v.i, c.c
), a3 AS (
  SELECT i, c FROM (SELECT i, c, row_number() OVER (PARTITION BY i ORDER BY d, c) AS r FROM d3) t WHERE r = 1
), c3 AS (
  SELECT c2.c, c2.j, coalesce(m.x, c2.x) AS x FROM c2 LEFT JOIN (
    SELECT a.c, v.j, CAST(floor(sum(v.x) / count(*)) AS BIGINT) AS x FROM cells v JOIN a3 a ON v.i = a.i GROUP BY a.c, v.j) m ON c2.c = m.c AND c2.j = m.j
), d4 AS (
  SELECT v.i, c.c, sum((v.x - c.x) * (v.x - c.x)) AS d FROM cells v JOIN c3 c ON v.j = c.j GROUP BY v.i, c.c
), a4 AS (
  SELECT i, c, d FROM (SELECT i, c, d, row_number() OVER (PARTITION BY i ORDER BY d, c) AS r FROM d4) t WHERE r = 1
), digest AS (
  SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY j)) AS h FROM c3 GROUP BY c
)
SELECT k.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, g.h AS centroid_sha256
FROM a4 a JOIN kept k ON a.i = k.i JOIN digest g ON a.c = g.c
"""
