"""Benchmark decontamination by the q-gram lemma.

A passage within ``k`` edits of a benchmark item of ``m`` characters shares at least
``m - q + 1 - k * q`` of its q-grams, and they lie on diagonals (place in the text minus place in the
item) at most ``k`` apart. Shared q-grams are counted in bands of diagonals that overlap by half, so
some band holds them all; bands that reach the bound are aligned with the item, banded, and kept within the
budget. The benchmark goes to the texts in blocks of bounded size; texts are never shuffled.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import mix, records, small_batches

Q = 8
#: Edits allowed per character of an item.
ERROR_RATE = 0.08
#: Characters of the benchmark that go to the tasks at once.
BLOCK_CHARS = 8_000_000
#: Code points of a text worked on at once; the next piece starts early enough to hold a passage that was cut.
PIECE = 1 << 18
#: Shared q-grams held at once, one row per place in a text and place in an item.
SLOTS = 1 << 22
_BITS = 20


def normal(text: str | None) -> str:
    """Lower case, one blank between words."""
    return "" if text is None else " ".join(text.lower().split())


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(q):
        total = total * np.uint64(0x100000001B3) + points[i : i + n]
    return mix(total)


class Index:
    """Q-grams of a block of items. Blank items match nothing; items shorter than ``q`` match as whole words, unchanged."""

    def __init__(self, items: list[tuple[object, str | None]], q: int = Q, rate: float = ERROR_RATE):
        kept = [(key, normal(text)) for key, text in items]
        kept = [(key, text) for key, text in kept if text]
        self.q = q
        self.short = [(key, text) for key, text in kept if len(text) < q]
        long = [(key, text) for key, text in kept if len(text) >= q]
        self.keys, self.texts = [k for k, _ in long], [t for _, t in long]
        self.points = [_points(t) for t in self.texts]
        sizes = np.array([len(p) for p in self.points], dtype=np.int64)
        # the lemma needs a bound of at least one shared q-gram
        self.budget = np.minimum(np.floor(sizes * rate).astype(np.int64), (sizes - q) // q)
        self.bound = sizes - q + 1 - self.budget * q
        grams = [_grams(p, q) for p in self.points]
        every = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else item
        order = np.argsort(every, kind="stable")
        self.item, self.place = item[order].astype(np.int64), place[order].astype(np.int64)
        self.grams, self.first, self.times = np.unique(every[order], return_index=True, return_counts=True)
        self.maybe = np.zeros(1 << _BITS, dtype=bool)
        self.maybe[(self.grams >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.longest = int(sizes.max()) if len(sizes) else 0

    def regions(self, text: str | None) -> list[tuple[object, int, int, int]]:
        """(item key, start, end, edits) in the normalised text, best of overlapping regions, in order."""
        whole = normal(text)
        found = []
        for key, item in self.short:
            at = whole.find(item)
            while at >= 0:
                past = at + len(item)
                if _apart(whole, at) and _apart(whole, past):
                    found.append((key, at, past, 0))
                at = whole.find(item, at + 1)
        reach = 2 * self.longest
        start = 0
        while self.keys and start < len(whole):
            found += [(k, start + s, start + e, d) for k, s, e, d in self._in_piece(whole[start : start + PIECE + reach])]
            start += PIECE
        return _best(found)

    def _in_piece(self, text: str) -> list[tuple[object, int, int, int]]:
        points = _points(text)
        grams = _grams(points, self.q)
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return []
        where = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
        hit = self.grams[where] == grams[at]
        at, where = at[hit], where[hit]
        shared = np.zeros(len(self.keys), dtype=np.int64)
        for item, _ in self._shared(at, where):
            shared += np.bincount(item, minlength=len(shared))
        enough = shared >= self.bound
        if not enough.any():
            return []
        span = len(text) + 2 * self.longest + 2
        keys, counts = [], []
        for item, diagonal in self._shared(at, where):
            rows = enough[item]
            item, diagonal = item[rows], diagonal[rows]
            half = (diagonal + self.longest) // (self.budget[item] + 1)
            # each q-gram counts in the two bands that overlap on its diagonal
            key, count = np.unique(np.concatenate([item * span + half + 1, item * span + half]), return_counts=True)
            keys.append(key)
            counts.append(count)
        key, slot = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(slot, weights=np.concatenate(counts), minlength=len(key))
        item, half = key // span, key % span - 1
        out, done = [], set()
        for i, b in zip(item[count >= self.bound[item]], half[count >= self.bound[item]], strict=True):
            k, m = int(self.budget[i]), len(self.points[i])
            low = int(b) * (k + 1) - self.longest
            left, right = max(0, low - k), min(len(text), low + 2 * (k + 1) + m + k)
            exact = text.find(self.texts[i], left, right)
            if exact >= 0:
                region = (exact, exact + m, 0)
            else:
                region = _align(self.points[i], points, low - k, 4 * k + 3, k)
            if region and (i, region) not in done:
                done.add((i, region))
                out.append((self.keys[i], *region))
        return out

    def _shared(self, at: np.ndarray, where: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Item and diagonal of every shared q-gram, about ``SLOTS`` at a time."""
        part = np.cumsum(self.times[where]) // SLOTS
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1):
            times = self.times[where[cut]]
            slot = np.repeat(self.first[where[cut]] - np.cumsum(times) + times, times) + np.arange(int(times.sum()))
            yield self.item[slot], np.repeat(at[cut], times) - self.place[slot]


def _apart(text: str, at: int) -> bool:
    """Whether no word of the text goes on across ``at``."""
    return not (0 < at < len(text) and text[at - 1].isalnum() and text[at].isalnum())


def _align(item: np.ndarray, text: np.ndarray, low: int, wide: int, budget: int) -> tuple[int, int, int] | None:
    """Best (start, end, edits) of the whole item along ``wide`` diagonals of the text from ``low`` on."""
    m = len(item)
    nothing = np.uint64(1 << 40)
    window = np.full(m + wide, nothing)
    inside = slice(max(0, low), min(len(text), low + m + wide))
    window[inside.start - low : inside.stop - low] = text[inside]
    place = np.arange(wide)
    cost, began = np.zeros(wide, dtype=np.int64), place.copy()
    for r, c in enumerate(item):
        along = cost + (window[r : r + wide] != c)
        skipped = np.append(cost[1:] + 1, budget + 1)
        step = np.minimum(along, skipped)
        start = np.where(along <= skipped, began, np.append(began[1:], 0))
        # characters of the text that the item lacks: the best value on a lower diagonal plus the distance
        shifted = step - place
        best = np.minimum.accumulate(shifted)
        source = np.maximum.accumulate(np.where(shifted == best, place, 0))
        cost, began = best + place, start[source]
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    if cost[end] > budget:
        return None
    return max(0, low + int(began[end])), min(len(text), low + m + end), int(cost[end])


def _best(found: list[tuple[object, int, int, int]]) -> list[tuple[object, int, int, int]]:
    """Regions by fewest edits, without those that overlap a better one of the same item."""
    kept: list[tuple[object, int, int, int]] = []
    taken: dict[object, list[tuple[int, int]]] = defaultdict(list)  # disjoint and in order, per item
    for key, start, end, edits in sorted(set(found), key=lambda r: (r[3], r[1], r[2], str(r[0]))):
        own = taken[key]
        at = bisect_left(own, (end,))  # regions from here on begin at the end of this one or later
        if not at or own[at - 1][1] <= start:
            insort(own, (start, end))
            kept.append((key, start, end, edits))
    return sorted(kept, key=lambda r: (r[1], r[2], str(r[0])))


def _blocks(benchmark: DataFrame, q: int, rate: float) -> Iterator[Index]:
    """The benchmark in blocks of about ``BLOCK_CHARS``, one at a time on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter(
        "text IS NOT NULL"
    )
    blocks = math.ceil((items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) / BLOCK_CHARS)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], q, rate)


def contaminated_regions(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", q: int = Q, rate: float = ERROR_RATE
) -> DataFrame:
    """``doc_id, item_id, first, past, edits``: one row per passage of ``docs`` that matches an item.

    Places count code points of the normalised text. Clean, empty and NULL texts give no row; blank and
    NULL items match nothing; an item listed twice under one id is reported once per place. Rows without ids are searched
    like others and reported with NULL.
    """
    texts = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "doc_id long, item_id long, first long, past long, edits int"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in _blocks(benchmark, q, rate):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            kinds = [pa.int64()] * 4 + [pa.int32()]
            for batch in records(batches, 500):
                rows = [
                    (key, *region)
                    for key, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True)
                    for region in index.regions(text)
                ]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "first", "past", "edits"]
                )

        out = out.unionAll(texts.mapInArrow(run, schema))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of ``docs`` in which no item of the benchmark is found, unchanged.

    NULL and empty texts stay, as do repeated rows and rows without ids; further columns pass through. An empty
    benchmark, or one of blank items, drops nothing.
    """
    docs = small_batches(docs)
    for index in _blocks(benchmark, q, rate):
        docs = docs.filter(_clean(index)(F.col("text").cast("string")))
    return docs


def _clean(index: Index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.regions(t) for t in texts], dtype=bool)

    return clean
