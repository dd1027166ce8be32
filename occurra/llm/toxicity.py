"""Toxicity by compression: which of two trained dictionaries shortens the windows of a text more.

One zstandard dictionary is trained on windows of toxic text, one on windows of ordinary text. A window is
a word between blanks, cut where it is very long. A text's windows are compressed with either; the counts
of windows that the toxic dictionary shortens by at least 1, 2, ... bytes more than the other are turned
into a probability by a logistic curve fitted on labelled rows that neither dictionary has seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import as_bytes, only, records, small_batches
from occurra.session import cut_lineage

#: Labelled rows to learn from, chosen by a hash of the id: at most so many of either class.
TOXIC_ROWS, ORDINARY_ROWS = 4_000, 8_000
#: Of these every third, by the same hash, fits the curve; the rest train the dictionaries.
CURVE_SHARE = 3
#: Windows that go into one dictionary's training; those of ordinary text are drawn by frequency.
TRAIN_WINDOWS = 40_000
DICTIONARY_BYTES = 8_192
#: Longer words are several windows.
WINDOW_BYTES = 40
#: Toxic text is told from its surroundings by byte grams of this size that are so many times as frequent in
#: rows labelled toxic, and so many standard deviations above what the share of toxic text explains.
GRAM, TIMES, DEVIATIONS = 5, 4.0, 6.0
#: Bytes gained, counted from each of these on.
GAINS = np.arange(1, 9)
THRESHOLD = 0.7
#: Tables large enough for every place of a dictionary, searched in depth: what a level picks for small inputs misses matches.
SEARCH = {"strategy": zstandard.STRATEGY_GREEDY, "window_log": 17, "hash_log": 16, "chain_log": 16, "search_log": 6, "min_match": 4, "target_length": 32}
#: zstandard looks for no match in the last bytes of its input; these go behind every window.
_TAIL = b"\n" * 12
#: Compressed windows remembered by a task before it starts afresh.
_REMEMBERED = 1 << 18


def windows(text: str | None) -> list[bytes]:
    """Lower-cased words with a blank on either side; words over ``WINDOW_BYTES`` in pieces."""
    found = []
    for word in as_bytes(text.lower() if text else None).split():
        for at in range(0, len(word), WINDOW_BYTES):
            found.append(b" " + word[at : at + WINDOW_BYTES] + b" ")
    return found


def _grams(window: bytes) -> set[bytes]:
    return {window[i : i + GRAM] for i in range(len(window) - GRAM + 1)}


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), compression_params=params)


def _dictionary(samples: list[tuple[bytes, int]], repeat: int = 1) -> bytes:
    """A dictionary trained on ``(window, number of surroundings)``, shown ``repeat`` times each.

    What room training leaves, as it does where few windows differ, is filled with windows that the content lacks;
    frequent ones stand last, where references are shortest.
    """
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [w for w, _ in samples] * repeat, k=48, d=6).as_bytes()
    except zstandard.ZstdError:
        # too little to train on: plain content, at least 8 bytes without the magic number
        trained = b"\n" * 8
    more, room = [], DICTIONARY_BYTES - len(trained)
    for window, _ in sorted(samples, key=lambda x: (-x[1], x[0])):
        if window not in trained and len(window) <= room:
            more.append(window)
            room -= len(window)
    return trained + b"".join(reversed(more))


@dataclass
class Model:
    """Two dictionaries and a curve. Without dictionaries every text gets the share of toxic rows."""

    toxic: bytes = b""
    ordinary: bytes = b""
    base: float = 0.0
    center: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def gains(self) -> "Gains":
        return Gains(self.toxic, self.ordinary)

    def scores(self, features: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(features), self.base)
        x = np.column_stack([np.ones(len(features)), (features - self.center) / self.scale])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -50, 50)))


class Gains:
    """Features of texts: how many windows gain how much from the toxic dictionary. One per task."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.known: dict[bytes, int] = {}

    def of(self, window: bytes) -> int:
        gain = self.known.get(window)
        if gain is None:
            if len(self.known) >= _REMEMBERED:
                self.known.clear()
            gain = self.known[window] = len(self.ordinary.compress(window + _TAIL)) - len(self.toxic.compress(window + _TAIL))
        return gain

    def features(self, text: str | None) -> np.ndarray:
        gains = np.fromiter(map(self.of, windows(text)), dtype=np.int64)
        n = len(gains)
        # how many windows gain at least 1, 2, ... bytes
        counts = (np.cumsum(np.bincount(np.clip(gains, 0, GAINS[-1]), minlength=GAINS[-1] + 1)[::-1])[::-1][1:]) if n else np.zeros(len(GAINS))
        return np.concatenate([np.log1p(counts), np.log1p(1000 * counts / max(n, 1)), [np.log(max(n, 1))]])


def fit_curve(features: np.ndarray, toxic: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Center, scale and weights of a ridge logistic regression, by Newton steps."""
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    x = np.column_stack([np.ones(len(features)), (features - center) / scale])
    held = np.append(1e-3, np.full(x.shape[1] - 1, ridge))
    weights = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(held), x.T @ (p - toxic) + held * weights)
        weights -= step
        if np.abs(step).max() < 1e-8:
            break
    return center, scale, weights


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window with those beside it, once a batch of texts and class."""
    for batch in records(batches, 200):
        found: dict[int, set] = {}
        for text, toxic in zip(batch["text"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            own = windows(text)
            found.setdefault(toxic, set()).update(zip([b"", *own], own, [*own[1:], b""], strict=False))
        for toxic, triples in found.items():
            before, window, after = zip(*triples, strict=True) if triples else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([toxic] * len(window), pa.int32()),
                    pa.array(window, pa.binary()),
                    pa.array([b + a for b, a in zip(before, after, strict=True)], pa.binary()),
                ],
                names=["toxic", "window", "beside"],
            )


def train_windows(texts: DataFrame) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
    """Windows to train on, toxic and ordinary, each with its number of surroundings; ``texts`` has ``text, toxic``.

    A window counts once for each pair of neighbours, however often copies of a text repeat it. From toxic rows
    only windows are taken that hold a gram typical of them, as most of a toxic text is ordinary.
    """
    surroundings = texts.mapInArrow(_contexts, "toxic int, window binary, beside binary").distinct()
    words = cut_lineage(surroundings.groupBy("toxic", "window").agg(F.count(F.lit(1)).alias("n")), "windows")
    totals = {r["toxic"]: r["n"] for r in words.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return [], []

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches):
            counts: dict[tuple[int, bytes], int] = {}
            for toxic, window, n in zip(*(batch[c].to_pylist() for c in ("toxic", "window", "n")), strict=True):
                for gram in _grams(window):
                    counts[toxic, gram] = counts.get((toxic, gram), 0) + n
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for _, g in counts], pa.binary()),
                    pa.array([n if t else 0 for (t, _), n in counts.items()], pa.int64()),
                    pa.array([0 if t else n for (t, _), n in counts.items()], pa.int64()),
                ],
                names=["gram", "t", "o"],
            )

    share = totals[1] / (totals[0] + totals[1])
    expected = (F.col("t") + F.col("o")) * share
    typical = (
        words.mapInArrow(spread, "gram binary, t long, o long")
        .groupBy("gram")
        .agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
        .withColumn("above", (F.col("t") - expected) / F.sqrt(expected + 1))
        .filter((F.col("above") > DEVIATIONS) & (F.col("t") * totals[0] >= F.col("o") * totals[1] * TIMES))
        .orderBy(F.desc("above"), "gram")
        .limit(TRAIN_WINDOWS)
    )
    grams = {bytes(r["gram"]) for r in typical.select("gram").collect()}

    @F.pandas_udf("boolean")
    def holds(window: pd.Series) -> pd.Series:
        return window.map(lambda w: not grams or not grams.isdisjoint(_grams(bytes(w)))).astype(bool)

    # a draw by frequency: the smallest of n exponential waiting times, seeded by the window
    wait = -F.log((F.pmod(F.xxhash64("window"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)) / F.col("n")
    toxic = words.filter("toxic = 1").filter(holds("window")).orderBy(F.desc("n"), "window").limit(TRAIN_WINDOWS)
    ordinary = words.filter("toxic = 0").orderBy(wait, "window").limit(TRAIN_WINDOWS)
    return tuple([(bytes(r["window"]), r["n"]) for r in part.select("window", "n").collect()] for part in (toxic, ordinary))


def train(texts: DataFrame, marks: DataFrame) -> Model:
    """Learn from ``texts`` (``id, text``) as ``marks`` (``id, toxic``, an id once) says; one row per id counts.

    At most ``TOXIC_ROWS`` and ``ORDINARY_ROWS`` rows are used, the first by a hash of the id. Only their texts are
    moved.
    """
    draw = F.xxhash64("id")
    there = marks.join(texts.select("id"), "id", "left_semi")
    ids = [there.filter(f"toxic = {c}").orderBy(draw, "id").limit(n) for c, n in ((1, TOXIC_ROWS), (0, ORDINARY_ROWS))]
    # at most 12,000 ids: the bound makes them fit to be sent to every task
    chosen = F.broadcast(cut_lineage(ids[0].unionByName(ids[1]), "drawn"))
    rows = cut_lineage(texts.join(chosen, "id").groupBy("id", "toxic").agg(F.min("text").alias("text")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    for_curve = F.pmod(F.xxhash64("id", F.lit("curve")), F.lit(CURVE_SHARE)) == 0
    toxic, ordinary = train_windows(small_batches(rows.filter(~for_curve).select("text", "toxic")))
    if not toxic or not ordinary:
        return Model(base=base)
    # few windows are shown several times
    model = Model(_dictionary(toxic, 1 + 8_000 // len(toxic)), _dictionary(ordinary), base)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains()
        for batch in records(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([gains.features(t).tolist() for t in batch["text"].to_pylist()], pa.list_(pa.float64())), batch["toxic"]], names=["x", "toxic"]
            )

    # at most a third of the bounded sample, 17 numbers a row
    held = rows.filter(for_curve).orderBy("id", "toxic").select("text", "toxic").mapInArrow(seen, "x array<double>, toxic int").collect()
    truth = np.array([r["toxic"] for r in held], dtype=float)
    if len(held) and 0 < truth.sum() < len(truth):
        model.center, model.scale, model.weights = fit_curve(np.array([r["x"] for r in held]), truth)
    return model


def score(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns, ``score`` and ``predicted`` of every row, from its whole text. NULL is an empty text."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = model.gains() if len(model.weights) else None
        for batch in records(batches):
            texts = batch["text_"].to_pylist()
            shares = model.scores(np.array([gains.features(t) for t in texts]) if gains else np.zeros((len(texts), 0)))
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array(shares, pa.float64()), pa.array(shares >= THRESHOLD).cast(pa.int32())], names=[*names, "score", "predicted"]
            )

    wanted = small_batches(docs).select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text_col}`").cast("string").alias("text_"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes[:-1])
    return wanted.mapInArrow(run, f"{kinds}, score double, predicted int")


def held_out(id_col: str = "doc_id") -> Column:
    """The fixed fold that is never learned from: every third by checksum of the id. No id: not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, text`` and ``id, toxic`` of the rows to learn from. An id with several labels is toxic if one says so; labels
    of NULL, and rows without an id or a text, are left out."""
    marks = only(labels, id="doc_id", toxic="toxic").filter("id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out("id"))
    texts = only(docs, id="doc_id", text=F.col("text").cast("string")).filter("id IS NOT NULL AND text IS NOT NULL")
    return texts, marks.groupBy("id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row of ``docs``.

    Repeated rows get a row each, NULL and empty texts the score of a text without windows, other columns of
    ``docs`` are not looked at. Without labels of both classes the score is the share of toxic ones, 0 for none.
    """
    model = train(*labelled(docs, labels))
    return score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})
