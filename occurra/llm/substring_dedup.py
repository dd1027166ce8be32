"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text; where its last bits are zero a chunk ends. The hash depends on
the last few bytes only, so an insertion moves the boundaries next to it and no others, and equal
passages are cut alike wherever they stand. Short chunks recur by chance in a large corpus, so what is digested
(64 bits) is every run of ``WINDOW`` chunks. How many whole runs a passage holds is chance, so runs of ``RUN_WORDS``
words are digested too: of each ``PASSAGE_WORDS`` words in a row, the run in them with the least hash. Documents that
share that many words share such a run. A digest found in more than one document belongs to the smallest id;
where it stands in others is a repeat, and repeats that touch make one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from occurra.llm.common import as_bytes, batch_words, mix, records, small_batches, window_hashes
from occurra.session import cut_lineage

#: A boundary depends on this many bytes; a power of two.
REACH = 16
#: One boundary in 2**CUT_BITS places.
CUT_BITS = 4
LEAST, MOST = 8, 128
#: Chunks under one digest.
WINDOW = 4
#: A repeat is reported from so many words on, the length of a digested run of words.
RUN_WORDS = 25
#: A repeat of so many words or more is always reported.
PASSAGE_WORDS = 50

_GEAR = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.uint32)
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def boundaries(data: bytes) -> np.ndarray:
    """End of every chunk, the end of the text included. Chunks have ``LEAST`` to ``MOST`` bytes, the last one may be shorter."""
    gear = _GEAR[np.frombuffer(data, dtype=np.uint8)]
    # the hash of the last 2, 4, 8, ... bytes from that of half as many
    back = 1
    while back < REACH:
        gear[back:] += gear[:-back] << np.uint32(back)
        back *= 2
    marks = np.flatnonzero((gear >> np.uint32(REACH)) & np.uint32((1 << CUT_BITS) - 1) == 0) + 1
    ends, last = [], 0
    for mark in marks.tolist():
        while mark - last > MOST:
            last += MOST
            ends.append(last)
        if mark - last >= LEAST:
            last = mark
            ends.append(last)
    while len(data) - last > MOST:
        last += MOST
        ends.append(last)
    if last < len(data):
        ends.append(len(data))
    return np.array(ends, dtype=np.int64)


#: Windows compared at once; bounds the memory for a long text.
_BLOCK = 1 << 14


def word_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Number of the first word, and hash, of the runs of ``RUN_WORDS`` words that are least among those of ``PASSAGE_WORDS`` words."""
    hashes = [h for _, _, h, _, _ in batch_words([data])]
    runs = window_hashes(hashes[0], RUN_WORDS) if hashes else np.empty(0, dtype=np.uint64)
    wide = PASSAGE_WORDS - RUN_WORDS + 1
    n = len(runs) - wide + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
    windows = np.lib.stride_tricks.sliding_window_view(runs, wide)
    least = np.concatenate([windows[a : a + _BLOCK].argmin(axis=1) + np.arange(a, min(a + _BLOCK, n)) for a in range(0, n, _BLOCK)])
    firsts = np.unique(least)
    return firsts, runs[firsts]


def chunk_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``digest, doc, place, words``: one row per run of ``WINDOW`` chunks, or one for a shorter text, and one per run of ``word_runs``.

    ``place`` packs the first byte and the number of bytes, ``words`` the numbers of the first word and of the
    word after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches, 500):
            digests, owners, places, counts = [], [], [], []
            for key, text in zip(batch["doc"].to_pylist(), batch["text"].to_pylist(), strict=True):
                data = as_bytes(text)
                if key is None or not data:
                    continue
                ends = boundaries(data)
                starts = np.append(0, ends[:-1])
                blank = _BLANK[np.frombuffer(data, dtype=np.uint8)]
                opens = ~blank & np.append(True, blank[:-1])
                begins = np.cumsum(opens)
                upto = begins[ends - 1]
                each = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                width = min(WINDOW, len(ends))
                digests.append(window_hashes(np.array(each, dtype=np.uint64), width) + np.uint64(width))
                last = slice(width - 1, None)
                starts, upto_first = starts[: len(ends) - width + 1], np.append(0, upto[:-1])[: len(ends) - width + 1]
                owners.append(np.full(len(starts), key, dtype=np.int64))
                places.append((starts << 32) | (ends[last] - starts))
                counts.append((upto_first << 32) | upto[last])
                numbers, hashes = word_runs(data)
                if len(numbers):
                    closes = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
                    starts = np.flatnonzero(opens)[numbers]
                    digests.append(hashes)
                    owners.append(np.full(len(numbers), key, dtype=np.int64))
                    places.append((starts << 32) | (closes[numbers + RUN_WORDS - 1] - starts))
                    counts.append((numbers << 32) | (numbers + RUN_WORDS))
            if owners:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(digests).view(np.int64)),
                        pa.array(np.concatenate(owners)),
                        pa.array(np.concatenate(places)),
                        pa.array(np.concatenate(counts)),
                    ],
                    names=["digest", "doc", "place", "words"],
                )

    return small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, "digest long, doc long, place long, words long"
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = RUN_WORDS) -> DataFrame:
    """``doc_id, first, past, n_words, owner_id``: passages of ``docs`` that stand in a document of smaller id too.

    With the default of ``least_words`` every repeat of ``PASSAGE_WORDS`` words or more gives a row, which covers its whole
    runs and may leave out words at its ends. Places are bytes of the UTF-8 text. The owner of a passage, the smallest id that has its first chunks, keeps
    it and gives no row for it. A repeat within one document is none. Rows that share an id are one document, rows without
    an id, and NULL and empty texts, have no passages.
    """
    every = chunk_runs(docs, id_col, text_col)
    owners = every.groupBy("digest").agg(F.min("doc").alias("owner"), F.max("doc").alias("other")).filter("owner < other")
    # stored, so that a digest with very many chunks can be split in the join
    shared = cut_lineage(owners.select("digest", "owner"), "shared")
    copies = (
        every.join(shared, "digest")
        .filter("doc <> owner")
        .select(
            "doc",
            F.shiftright("place", 32).alias("start"),
            (F.shiftright("place", 32) + F.col("place").bitwiseAND((1 << 32) - 1)).alias("stop"),
            F.shiftright("words", 32).alias("word"),
            F.col("words").bitwiseAND((1 << 32) - 1).alias("past_word"),
            "owner",
        )
        .dropDuplicates(["doc", "start", "stop", "owner"])
    )
    along = Window.partitionBy("doc").orderBy("start", "stop")
    before = F.max("stop").over(along.rowsBetween(Window.unboundedPreceding, -1))
    islands = copies.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn(
        "run", F.sum("new").over(along)
    )
    return (
        islands.groupBy("doc", "run")
        .agg(
            F.min("start").alias("first"),
            F.max("stop").alias("past"),
            (F.max("past_word") - F.min("word")).alias("n_words"),
            F.min(F.struct("start", "owner")).alias("head"),
        )
        .filter(F.col("n_words") >= least_words)
        .select(F.col("doc").alias("doc_id"), "first", "past", "n_words", F.col("head.owner").alias("owner_id"))
    )


def without_repeats(docs: DataFrame, least_words: int = RUN_WORDS) -> DataFrame:
    """``docs`` with repeated passages cut out of ``text``; all rows and other columns stay as they are."""
    parts = (
        cut_lineage(repeated_passages(docs, least_words=least_words), "repeats")
        .groupBy(F.col("doc_id").alias("_doc"))
        .agg(F.array_sort(F.collect_list(F.struct("first", "past"))).alias("_parts"))
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, parts: pd.Series) -> pd.Series:
        def one(text: str, spans: list[dict]) -> str:
            data, out, at = as_bytes(text), [], 0
            for span in spans:
                out.append(data[at : span["first"]])
                at = span["past"]
            # a chunk may end inside a character; what is left of it goes
            return b"".join([*out, data[at:]]).decode("utf-8", "ignore")

        return pd.Series([t if t is None or p is None else one(t, p) for t, p in zip(texts, parts, strict=True)], dtype=object)

    joined = docs.join(parts, F.col("doc_id") == F.col("_doc"), "left")
    text = F.when(F.col("_parts").isNull(), F.col("text")).otherwise(cut(F.when(F.col("_parts").isNotNull(), F.col("text")), F.col("_parts")))
    return joined.select(*[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
