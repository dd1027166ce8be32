"""Periodic runs of words: stretches that repeat one block at least four times over.

At every dyadic scale ``t`` a string synchronising set is chosen by hash: a position is selected if the least
hash of the ``t``-word contexts from it to ``t`` further on stands at either end. Equal surroundings of ``2 t``
words are selected alike, so within a run of period ``t <= q < 2 t`` a selected position and its next equal
context lie exactly ``q`` apart and propose ``q``. Contexts inside stretches of a period up to ``t / 4`` have no
least hash of their own and are left out of the set; their runs are known from the smaller scales. Proposals
are merged, checked and extended word by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import WORD, as_bytes, mix, records, small_batches

#: A run holds its block this many times, and has at least so many words.
LEAST_TIMES, LEAST_WORDS = 4, 6
#: Bytes of text worked on together; a longer text is worked on alone.
TOGETHER = 1 << 20
#: Cells compared at once while proposals are extended.
_CELLS = 1 << 20
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_M = np.uint64(0x9E3779B97F4A7C15)


def _selected(hashes: np.ndarray, scale: int, left_out: np.ndarray) -> np.ndarray:
    """Positions of the synchronising set: ``hashes`` are those of all contexts of ``scale`` words."""
    own = np.where(left_out, _NEVER, hashes)
    least, width = own, 1
    while width < scale:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:-1], own[scale:])
    n = len(least)
    return np.flatnonzero((least != _NEVER) & ((own[:n] == least) | (own[scale:] == least)))


def _left_out(runs: list[np.ndarray], scale: int, n: int) -> np.ndarray:
    """Which of ``n`` contexts of ``scale`` words lie in a stretch of a period up to a quarter of it."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for found in runs:
        start, end, period = found.T
        inside = (period * LEAST_TIMES <= scale) & (end - start >= scale)
        np.add.at(edge, start[inside], 1)
        np.add.at(edge, end[inside] - scale + 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _agreeing(words: np.ndarray, at: np.ndarray, gap: np.ndarray, step: int) -> np.ndarray:
    """How many words from ``at`` on, going by ``step``, equal the word ``gap`` further on (or back, for a negative one)."""
    found = np.zeros(len(at), dtype=np.int64)
    going, block = np.arange(len(at)), 16
    while len(going):
        still = []
        for first in range(0, len(going), max(1, _CELLS // block)):
            some = going[first : first + max(1, _CELLS // block)]
            places = at[some, None] + step * (found[some, None] + np.arange(block))
            same = words[np.clip(places, 0, len(words) - 1)] == words[np.clip(places + gap[some, None], 0, len(words) - 1)]
            whole = same.all(axis=1)
            found[some] += np.where(whole, block, same.argmin(axis=1))
            still.append(some[whole])
        going, block = np.concatenate(still), min(block * 2, 1 << 16)
    return found


def _holds(words: np.ndarray, start: np.ndarray, size: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """Whether each of the ``size`` words from ``start`` on equals the word ``gap`` further on."""
    right = np.ones(len(start), dtype=bool)
    first = 0
    totals = np.cumsum(size)
    while first < len(start):
        past = max(first + 1, int(np.searchsorted(totals, (totals[first - 1] if first else 0) + _CELLS, side="right")))
        part = size[first:past]
        begins = np.cumsum(part) - part
        places = np.arange(part.sum()) + np.repeat(start[first:past] - begins, part)
        right[first:past] = np.logical_and.reduceat(words[places] == words[places + np.repeat(gap[first:past], part)], begins)
        first = past
    return right


def periodic_stretches(words: np.ndarray, longest: int) -> np.ndarray:
    """All runs as rows ``start, end, period`` by start, then period, in a sequence of word numbers.

    ``words`` begins and ends with, and texts in it are divided by, numbers that occur once, which no run can
    span; ``longest`` is the number of words of the longest text. Contexts are compared by 64-bit hashes, the
    runs that come of them word by word.
    """
    runs: list[np.ndarray] = []
    hashes, scale = mix(words.astype(np.uint64) * _M + _M), 1
    while LEAST_TIMES * scale <= longest:
        # contexts of twice the scale, which are also those of the next scale
        wide = mix(hashes[:-scale] * _M + mix(hashes[scale:]))
        chosen = _selected(hashes, scale, _left_out(runs, scale, len(hashes)))
        context = wide[chosen]
        order = np.argsort(context, kind="stable")
        at, context = chosen[order], context[order]
        gap = np.diff(at)
        proposes = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
        at, gap = at[:-1][proposes], gap[proposes]
        if len(at):
            order = np.lexsort((at, gap))
            at, gap = at[order], gap[order]
            # proposals of one run: each reaches into the next
            new = np.append(True, (gap[1:] != gap[:-1]) | (at[1:] - at[:-1] > 2 * scale))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            start, period = at[first], gap[first]
            end = at[last] + 2 * scale + period
            right = _holds(words, start, end - start - period, period)
            start, end, period = start[right], end[right], period[right]
            start = start - _agreeing(words, start - 1, period, -1)
            end = end + _agreeing(words, end, -period, 1)
            runs.append(np.unique(np.column_stack([start, end, period])[end - start >= LEAST_TIMES * period], axis=0))
        hashes, scale = wide, scale * 2
    if not runs:
        return np.empty((0, 3), dtype=np.int64)
    found = np.concatenate(runs)
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    # the same stretch under a multiple of its period
    found = found[np.append(True, (np.diff(found[:, :2], axis=0) != 0).any(axis=1))] if len(found) else found
    found = found[found[:, 1] - found[:, 0] >= LEAST_WORDS]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def text_runs(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, bytes]]:
    """Number of words, runs as rows ``start, length, period``, and the text without repeated blocks, of each text."""
    lists = [t.split() for t in texts]
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    parts, begins, at = [np.array([-1])], [], 1
    for i, own in enumerate(lists):
        begins.append(at)
        parts += [np.fromiter(map(numbers.__getitem__, own), dtype=np.int64, count=len(own)), np.array([-2 - i])]
        at += len(own) + 1
    words = np.concatenate(parts).astype(np.int64)
    found = periodic_stretches(words, max(map(len, lists), default=0))
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 1], -1)
    dropped = np.cumsum(edge) > 0
    bounds = np.searchsorted(found[:, 0], [*begins, len(words)])
    for i, own in enumerate(lists):
        runs = found[bounds[i] : bounds[i + 1]]
        if len(runs):
            kept = np.flatnonzero(~dropped[begins[i] : begins[i] + len(own)]).tolist()
            own, n = [own[k] for k in kept], len(own)
            yield n, np.column_stack([runs[:, 0] - begins[i], runs[:, 1] - runs[:, 0], runs[:, 2]]), b" ".join(own)
        else:
            yield len(own), runs, b" ".join(own)


def _together(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = 0
    while first < len(texts):
        past, size = first, 0
        while past < len(texts) and (past == first or size + len(texts[past]) <= TOGETHER):
            size += len(texts[past])
            past += 1
        yield first, past
        first = past


def periodic_runs(docs: DataFrame, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``n_words``, ``runs`` and ``collapsed`` (UTF-8) of every row of ``docs``.

    ``runs`` are structs ``start, length, period`` by start, then period, in words. ``collapsed`` holds the words
    but those after the first block of a run, one blank between two. Whole texts; NULL is a text without words.
    A text is worked on in one task, with memory in proportion to it. Columns not named are not looked at.
    """
    names = list(keep)
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches):
            texts = [as_bytes(t) for t in batch["text_"].to_pylist()]
            for first, past in _together(texts):
                sizes, runs, rest = zip(*text_runs(texts[first:past]), strict=True)
                flat = np.concatenate(runs)
                found = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(struct))
                offsets = pa.array(np.append(0, np.cumsum([len(r) for r in runs])), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[batch[n].slice(first, past - first) for n in names], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, found), pa.array(rest, pa.binary())],
                    names=[*names, "n_words", "runs", "collapsed"],
                )

    wanted = small_batches(docs).select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text_col}`").cast("string").alias("text_"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes[:-1])
    return wanted.mapInArrow(run, f"{kinds}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def with_repeats(text: Column, number: Column) -> Column:
    """``text``, or for every tenth checksum of ``number`` a text whose words repeat from some word on.

    With ``n`` words, ``h = crc32(number)`` and ``g = h / 10``: word ``i >= a`` is word ``a + (i - a) % p``, where ``a = g % n``
    and ``p = 1 + (n - a) / (3 + g % 8)``. Divisions are of whole numbers.
    """
    h = F.crc32(number.cast("string"))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"))
    g, n = F.floor(h / 10), F.size(words).cast("long")
    a = g % F.nullif(n, F.lit(0))
    p = 1 + F.floor((n - a) / (3 + g % 8))
    # names of the fields avoid computing the parts again for every word
    parts = F.struct(words.alias("w"), a.alias("a"), p.alias("p"))
    repeated = F.transform(
        F.array(parts),
        lambda x: F.array_join(
            F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "
        ),
    )[0]
    return F.when((h % 10 == 0) & (F.regexp_instr(text, F.lit(WORD)) > 0), repeated).otherwise(text)


def run_digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, number of runs, the longest run, and digests of all runs and of the collapsed text."""
    planted = docs.select(F.col("doc_id"), with_repeats(F.col("text").cast("string"), F.col("doc_id")).alias("text"))
    found = periodic_runs(planted, {"doc_id": F.col("doc_id")})
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("l"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select("doc_id", "runs", "collapsed", best.alias("best")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.l").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.l") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Brute force over anchors: a run of period q holds three equal blocks from some multiple of q on.
ORACLE_SQL = r"""
WITH base AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_reduce(list_concat([CAST(4294967295 AS UBIGINT)],
      flatten(list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1),
        lambda k: list_transform(range(8), lambda b: CAST((ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) >> b) & 1 AS UBIGINT))))),
      lambda c, b: xor(c >> 1, CAST(3988292384 AS UBIGINT) * (xor(c, b) & 1))) AS c
  FROM documents
), hashed AS (
  SELECT row_number() OVER () AS r, doc_id, w, CAST(len(w) AS BIGINT) AS n, CAST(xor(c, CAST(4294967295 AS UBIGINT)) AS BIGINT) AS h FROM base
), parted AS (
  SELECT r, doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS f FROM hashed
), texts AS (
  SELECT r, doc_id, n, CASE WHEN planted THEN
    list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i + 1 ELSE 1 + a + (i - a) % (1 + (n - a) // f) END]) ELSE w END AS w
  FROM parted
), periods AS (
  SELECT r, n, w, unnest(range(1, n // 4 + 1)) AS q FROM texts WHERE n >= 6
), anchors AS (
  SELECT r, n, w, q, unnest(range(0, n - 3 * q, q)) AS i FROM periods
), candidates AS (
  SELECT DISTINCT r, q FROM anchors
  WHERE w[i + 1] = w[i + q + 1] AND w[i + q + 1] = w[i + 2 * q + 1] AND w[i + 2 * q + 1] = w[i + 3 * q + 1]
    AND w[i + 1 : i + 2 * q] = w[i + q + 1 : i + 3 * q]
), places AS (
  SELECT c.r, c.q, t.w, unnest(range(0, t.n - c.q)) AS j FROM candidates c JOIN texts t ON c.r = t.r
), equal AS (
  SELECT r, q, j, j - row_number() OVER (PARTITION BY r, q ORDER BY j) AS island FROM places WHERE w[j + 1] = w[j + q + 1]
), stretches AS (
  SELECT r, q, min(j) AS s, count(*) + q AS l FROM equal GROUP BY r, q, island
), runs AS (
  SELECT r, s, l, min(q) AS p FROM stretches WHERE l >= greatest(6, 4 * q) GROUP BY r, s, l
), ranked AS (
  SELECT r, s, l, p, row_number() OVER (PARTITION BY r ORDER BY l DESC, s, p) AS place FROM runs
), summed AS (
  SELECT r, count(*) AS n_runs, sha256(string_agg(concat(s, ',', l, ',', p, chr(10)), '' ORDER BY s, p)) AS h FROM runs GROUP BY r
), words AS (
  SELECT t.r, t.w, unnest(range(0, t.n)) AS i FROM texts t JOIN summed m ON t.r = m.r
), dropped AS (
  SELECT DISTINCT r, unnest(range(s + p, s + l)) AS i FROM runs
), collapsed AS (
  SELECT words.r, string_agg(words.w[words.i + 1], ' ' ORDER BY words.i) AS x FROM words
  LEFT JOIN dropped d ON words.r = d.r AND words.i = d.i WHERE d.i IS NULL GROUP BY words.r
)
SELECT t.doc_id, CAST(coalesce(m.n_runs, 0) AS BIGINT) AS n_runs, CAST(b.s AS BIGINT) AS start, CAST(b.l AS BIGINT) AS length, CAST(b.p AS BIGINT) AS period,
  CAST(1000 * b.l // b.p AS BIGINT) AS exponent_milli, coalesce(m.h, sha256('')) AS runs_sha256,
  sha256(CASE WHEN m.r IS NULL THEN array_to_string(t.w, ' ') ELSE coalesce(x.x, '') END) AS collapsed_sha256
FROM texts t LEFT JOIN summed m ON t.r = m.r LEFT JOIN ranked b ON t.r = b.r AND b.place = 1 LEFT JOIN collapsed x ON t.r = x.r
"""
