"""Quality rules: statistics per text, fixed base rules, and an isolation forest over the statistics.

The forest is grown on a bounded sample of labelled rows (``TREES * SUBSAMPLE``), of which at most ``BAD_SHARE``
are bad, so that bad documents are rare in it. A document that random splits separate after few steps is
unusual; the score above which it is rejected is calibrated on all labelled rows that pass the base rules, so that at most
``false_rejects`` of the good ones go. Rows that the base rules reject anyway do not move the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import as_bytes, batch_words, records, small_batches, window_hashes
from occurra.session import cut_lineage

REPEAT_WINDOW = 8
TREES = 128
SUBSAMPLE = 256
#: Largest share of the rows labelled good that the calibrated threshold may reject.
FALSE_REJECTS = 0.002
SCORE_STEPS = 4096
#: Largest share of rows labelled bad in the sample.
BAD_SHARE = 1 / 25
SEED = 20240607

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_chars_all", "n_upper")
_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(65, 91))


def statistics(texts: list[str | None]) -> np.ndarray:
    """``COUNTS`` and ``EXTRA``, one row per text."""
    coded = [as_bytes(t) for t in texts]
    rows = []
    for first, past, hashes, sizes, offsets in batch_words(coded):
        windows = window_hashes(hashes, REPEAT_WINDOW)
        for i in range(first, past):
            start, stop = offsets[i - first], offsets[i - first + 1]
            own = windows[start : max(start, stop - REPEAT_WINDOW + 1)]
            rows.append(_statistics(coded[i], 0 if texts[i] is None else len(texts[i]), hashes[start:stop], sizes[start:stop], own))
    return np.array(rows, dtype=np.int64).reshape(len(texts), len(COUNTS) + len(EXTRA))


def _statistics(data: bytes, chars: int, hashes: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[int, ...]:
    blanks = len(data) - int(sizes.sum())
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
    repeated = 0
    if len(windows):
        ordered = np.sort(windows)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            starts = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, windows), len(twice) - 1)] == windows)
            change = np.zeros(len(hashes) + 1, dtype=np.int64)
            change[starts] += 1
            change[starts + REPEAT_WINDOW] -= 1
            repeated = int((np.cumsum(change) > 0).sum())

    def of(kinds: bytes) -> int:
        return len(data) - len(data.translate(None, kinds))

    return (
        len(hashes), chars - blanks, of(_SYMBOLS), len(lines) - len(set(lines)), repeated,
        chars, of(_UPPER),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from the counts (columns ``COUNTS + EXTRA``), one row per document."""
    words, in_words, symbols, _, _, chars, upper = counts.astype(np.float64).T
    per_word, per_char = np.maximum(words, 1), np.maximum(chars, 1)
    # rates of repeated words and lines were tried: splits on them mostly part usual texts, and fewer bad rows were found
    return np.column_stack([np.log1p(20 * symbols / per_word), np.log1p(20 * upper / per_char), in_words / per_word])


@dataclass(frozen=True)
class Forest:
    """Random split trees as arrays; node 2i+1 and 2i+2 are below node i."""

    column: np.ndarray
    value: np.ndarray
    length: np.ndarray
    threshold: float = float("inf")

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0.5 is usual, 1 is isolated at once."""
        total = np.zeros(len(rows))
        for column, value, length in zip(self.column, self.value, self.length, strict=True):
            at = np.zeros(len(rows), dtype=np.int64)
            inner = column[at] >= 0
            while inner.any():
                left = rows[np.arange(len(rows)), np.maximum(column[at], 0)] < value[at]
                at = np.where(inner, 2 * at + np.where(left, 1, 2), at)
                inner = column[at] >= 0
            total += length[at]
        return np.exp2(-total / (max(1, len(self.column)) * _usual(SUBSAMPLE)))


def _usual(n: int) -> float:
    """Mean path length of a search without result among ``n`` values."""
    if n <= 1:
        return 0.0
    return 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows: np.ndarray, seed: int = SEED) -> Forest:
    depth = int(np.ceil(np.log2(SUBSAMPLE)))
    size = (1 << (depth + 1)) - 1
    column = np.full((TREES, size), -1, dtype=np.int64)
    value, length = np.zeros((TREES, size)), np.zeros((TREES, size))
    random = np.random.default_rng(seed)
    for tree in range(TREES if len(rows) else 0):
        some = rows[random.choice(len(rows), size=min(SUBSAMPLE, len(rows)), replace=False)]
        todo = [(0, 0, some)]
        while todo:
            node, level, part = todo.pop()
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if level == depth or len(part) <= 1 or not len(wide):
                length[tree, node] = level + _usual(len(part))
                continue
            c = int(random.choice(wide))
            v = random.uniform(low[c], high[c])
            left = part[:, c] < v
            column[tree, node], value[tree, node] = c, v
            for below, keep in ((2 * node + 1, left), (2 * node + 2, ~left)):
                if keep.any():
                    todo.append((below, level + 1, part[keep]))
                else:
                    length[tree, below] = level + 1
    return Forest(column, value, length)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the counts of every row; NULL text counts as empty."""
    names = [*COUNTS, *EXTRA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches, 1000):
            found = statistics(batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c) for c in found.T]], names=["doc_id", *names])

    return small_batches(docs).select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
    ).mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([batch[n].to_numpy(zero_copy_only=False) for n in (*COUNTS, *EXTRA)])


def _scored(stats: DataFrame, forest: Forest) -> DataFrame:
    kept = list(stats.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = forest.score(features(_matrix(batch)))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in kept], pa.array(scores)], names=[*kept, "anomaly"])

    return stats.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in stats.dtypes) + ", anomaly double")


def fit(stats: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS) -> Forest:
    """The forest of a bounded sample and its threshold from all labelled rows.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad). Without a good row nothing is rejected. The
    threshold is a score that costs at most ``false_rejects`` of the good rows that pass the base rules, and of those
    the one with the largest gain; where bad rows are no more unusual than good ones, nothing is rejected.
    """
    marked = cut_lineage(
        stats.join(
            labels.select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
            .filter("quality IN (0, 1) AND doc_id IS NOT NULL")
            .groupBy("doc_id")
            .agg(F.min("quality").alias("quality")),
            "doc_id",
        ),
        "labelled",
    )
    names = [*COUNTS, *EXTRA]

    def some(quality: int, most: int) -> list:
        rows = marked.filter(F.col("quality") == quality).select(*names)
        return rows.orderBy(F.xxhash64(F.lit(SEED), *names), *names).limit(most).collect()

    most = TREES * SUBSAMPLE
    good = some(1, int(most * (1 - BAD_SHARE)))
    if not good:
        return grow(np.empty((0, len(names))))
    bad = some(0, int(len(good) * BAD_SHARE / (1 - BAD_SHARE)))
    forest = grow(features(np.array([tuple(r) for r in good + bad], dtype=np.int64)))
    # at most SCORE_STEPS rows per label, whatever the number of labelled documents
    steps = (
        _scored(marked.filter(~base_failed(F.col("n_words"), F.col("n_repeat_words"))), forest)
        .groupBy(F.floor(F.col("anomaly") * SCORE_STEPS).cast("int").alias("step"))
        .agg(F.sum(F.col("quality")).alias("good"), F.sum(1 - F.col("quality")).alias("bad"))
        .collect()
    )
    good, bad = np.zeros(SCORE_STEPS + 1), np.zeros(SCORE_STEPS + 1)
    for r in steps:
        good[r["step"]], bad[r["step"]] = r["good"], r["bad"]
    above = lambda x: np.cumsum(x[::-1])[::-1] / max(1, x.sum())
    gain = np.where(above(good) <= false_rejects, above(bad) - above(good), -1)
    best = int(np.argmax(gain))
    return Forest(forest.column, forest.value, forest.length, best / SCORE_STEPS if gain[best] > 0 else float("inf"))


def quality_rules(docs: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, the counts, ``base_failed``, ``kept``, ``anomaly``.

    NULL and empty texts have no words and fail the base rules. Rows without ``doc_id`` are judged like any
    other but cannot carry a label; a document labelled twice takes the worse label.
    """
    stats = cut_lineage(document_statistics(docs), "statistics")
    forest = fit(stats, labels, false_rejects)
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return _scored(stats, forest).select(
        "doc_id", *COUNTS, failed.alias("base_failed"),
        (~failed & (F.col("anomaly") < F.lit(forest.threshold))).alias("kept"), "anomaly",
    )


def keep_good(docs: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged. Texts are judged where they are: none is shuffled.

    NULL and empty texts go. Rows without ``doc_id`` and repeated rows are judged one by one like any other; further
    columns pass through; without labels only the base rules reject.
    """
    forest = fit(cut_lineage(document_statistics(docs), "statistics"), labels, false_rejects)

    @F.pandas_udf("boolean")
    def kept(texts: pd.Series) -> pd.Series:
        counts = statistics([t if isinstance(t, str) else None for t in texts])
        words, repeat = counts[:, 0], counts[:, 4]
        failed = (words < 20) | (100 * repeat > 30 * words)
        return pd.Series(~failed & (forest.score(features(counts)) < forest.threshold))

    return docs.filter(kept(F.col("text").cast("string")))
