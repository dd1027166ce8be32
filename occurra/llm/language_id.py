"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of a bounded sample of labelled texts in Spark; the matrix of log
probabilities has a fixed number of cells and goes to every task, where batches of texts are scored
by summing the rows of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import records, small_batches
from occurra.session import cut_lineage

ORDERS = (2, 3)
BUCKETS = 1 << 15
#: Cells of the matrix; with very many languages the buckets (a power of two) shrink to keep to it.
MOST_CELLS = 1 << 21
#: Expected number of labelled texts of every language to learn from; chosen by a hash of id and text.
TRAIN_ROWS = 5_000
_DRAW = 1 << 40
#: Code points worked on at once; longer texts go on with their next piece.
PIECE = 1 << 17
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _is_letter(points: np.ndarray) -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x30000)), dtype=bool, count=0x30000)
    return _LETTER[np.minimum(points, len(_LETTER) - 1)] & (points < len(_LETTER)) | (points >= len(_LETTER)) & (points < 0x323B0)


def ngrams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of the lower-cased text, piece by piece; all but letters is one blank."""
    tail = np.array([32], dtype=np.uint32)
    for start in range(0, len(text), PIECE):
        raw = np.frombuffer(text[start : start + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(_is_letter(raw), raw, np.uint32(32))
        if start + PIECE >= len(text):
            points = np.append(points, np.uint32(32))
        points = np.concatenate([tail, points])
        blank = points == 32
        points = points[~(blank & np.append(False, blank[:-1]))].astype(np.uint64)
        for order in ORDERS:
            n = len(points) - order + 1
            if n > 0:
                total = np.full(n, order, dtype=np.uint64)
                for i in range(order):
                    total = total * np.uint64(0x100000001B3) + points[i : i + n]
                total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                yield ((total >> np.uint64(40)) & np.uint64(buckets - 1)).astype(np.int64)
        tail = points[-(max(ORDERS) - 1) :].astype(np.uint32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_prob: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and its posterior share; ``UNKNOWN`` and 0 without a letter or without anything learned."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        usable = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        total = np.tile(self.prior, (len(usable), 1))
        parts, owners, held = [], [], 0

        def add() -> None:
            starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
            np.add.at(total, owners, np.add.reduceat(self.log_prob[np.concatenate(parts)], starts, axis=0, dtype=np.float64))

        for row, i in enumerate(usable):
            for part in ngrams(texts[i], len(self.log_prob)):
                parts.append(part)
                owners.append(row)
                held += len(part)
                if held > PIECE:
                    add()
                    parts, owners, held = [], [], 0
        if parts:
            add()
        if usable:
            best = total.argmax(axis=1)
            share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            for row, i in enumerate(usable):
                names[i], scores[i] = self.languages[best[row]], float(share[row])
        return names, scores


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS, id_col: str | None = "doc_id") -> Model:
    """Learn from the rows of ``docs`` with a text and a language.

    About ``rows`` of every language, by a hash of id and text; all of a language that has no more, so a rare one is
    learned however large the table. Without ``id_col`` equal texts are drawn together. Class frequencies are those of
    the sample.
    """
    own = F.col(f"`{id_col}`") if id_col else F.lit(None).cast("long")
    labelled = small_batches(docs).select(
        F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.xxhash64(own, f"`{text_col}`").alias("draw")
    )
    # one number per language
    there = docs.groupBy(F.col(f"`{lang_col}`").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n")).filter("lang IS NOT NULL").collect()
    if not there:
        return Model((), np.zeros((1, 0), dtype=np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for r in there for x in (r["lang"], min(1.0, rows / r["n"]))])[F.col("lang")]
    sample = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").filter(F.pmod("draw", F.lit(_DRAW)) < share * _DRAW).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches):
            found: dict[str, np.ndarray] = {}
            docs_of: dict[str, int] = {}
            for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True):
                if has_letter(text):
                    docs_of[lang] = docs_of.get(lang, 0) + 1
                    for part in ngrams(text, BUCKETS):
                        found[lang] = found.get(lang, 0) + np.bincount(part, minlength=BUCKETS)
            for lang, counts in found.items():
                used = np.flatnonzero(counts)
                # bucket -1 holds the number of texts
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * (len(used) + 1), pa.string()),
                        pa.array(np.append(used, -1)),
                        pa.array(np.append(counts[used], docs_of[lang])),
                    ],
                    names=["lang", "bucket", "n"],
                )

    counts = sample.mapInArrow(count, "lang string, bucket long, n long")
    counted = cut_lineage(counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "ngrams")
    texts = {r["lang"]: r["n"] for r in counted.filter("bucket = -1").collect()}
    languages = tuple(sorted(texts))
    if not languages:
        return Model((), np.zeros((1, 0), dtype=np.float32), np.zeros(0))
    buckets = BUCKETS
    while buckets * len(languages) > MOST_CELLS and buckets > 64:
        buckets //= 2
    place = {lang: i for i, lang in enumerate(languages)}
    matrix = np.ones((buckets, len(languages)))
    # at most buckets * languages rows
    folded = counted.filter("bucket >= 0").groupBy("lang", (F.col("bucket") % buckets).alias("bucket")).agg(F.sum("n").alias("n"))
    for r in folded.collect():
        matrix[r["bucket"], place[r["lang"]]] += r["n"]
    known = np.array([texts[lang] for lang in languages], dtype=np.float64)
    return Model(languages, np.log(matrix / matrix.sum(axis=0)).astype(np.float32), np.log(known / known.sum()))


def identify(docs: DataFrame, model: Model, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """``keep`` columns plus ``lang_pred`` and ``score`` for every row. NULL text or one without a letter: ``und``, 0."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches):
            langs, scores = model.predict(batch["text_"].to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in names], pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*names, "lang_pred", "score"],
            )

    wanted = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(f"`{text_col}`").cast("string").alias("text_"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in wanted.dtypes[:-1])
    return wanted.mapInArrow(run, f"{kinds}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The fixed fold that is never learned from: every fourth by checksum of the id. No id: not held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs``; the model sees text and language of the other folds only."""
    model = train(docs.filter(~held_out()), rows=rows)
    return identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out()})
