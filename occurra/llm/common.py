"""What the operators of this folder share: tables, words, hashes, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One word: a run of anything but ASCII blanks. The same rule as ``bytes.split()``.
WORD = r"[^\x20\x09-\x0D]+"

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

# fixed odd multipliers of the 64-bit mixers
_M1 = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(0xBF58476D1CE4E5B9)
_M3 = np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows handed to Python at once. Texts may be long, and a worker holds a batch in several forms.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, after bounding the batches of its session: memory per task then does not depend on Spark's default of 10,000 rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def as_bytes(text: str | None) -> bytes:
    """UTF-8 of a text; nothing for NULL. Lone surrogates do not end the job."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def ascii_lower(data: bytes) -> bytes:
    return data.translate(_LOWER)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values: a bijection, so distinct values stay distinct."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: Bytes of text hashed at once.
_SLICE = 1 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)
_IS_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, _SLICE + 4096)
        inverse = np.uint64(pow(int(_M1), -1, 1 << 64))
        _powers = tuple(np.cumprod(np.append(np.uint64(1), np.full(n - 1, m, dtype=np.uint64)), dtype=np.uint64) for m in (_M1, inverse))
    return _powers


def _hashes_of_slice(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and length of every word: a polynomial over its bytes, from one running sum."""
    raw = np.frombuffer(data, dtype=np.uint8)
    up, down = _power_tables(len(raw) + 1)
    blank = _IS_BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    sizes = ends - starts
    return mix((sums[ends] - sums[starts]) * down[starts] + sizes.astype(np.uint64)), starts, sizes


def batch_words(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Word hashes of many texts, some texts at a time: (first text, past text, hashes, sizes, words before each text).

    Words are as ``bytes.split()`` gives them. A long text is a group of its own, hashed slice by slice.
    """
    first = 0
    while first < len(texts):
        past, size = first, 0
        while past < len(texts) and (past == first or size + len(texts[past]) <= _SLICE):
            size += len(texts[past]) + 1
            past += 1
        if past == first + 1 and size > _SLICE:
            parts, at, data = [], 0, texts[first]
            while at < len(data):
                stop = at + _SLICE
                # to the next blank, so that no word is cut
                while stop < len(data) and data[stop] not in b" \t\n\r\x0b\x0c":
                    stop += 1
                parts.append(_hashes_of_slice(data[at:stop]))
                at = stop
            hashes, sizes = np.concatenate([x[0] for x in parts]), np.concatenate([x[2] for x in parts])
            yield first, past, hashes, sizes, np.array([0, len(hashes)])
        else:
            hashes, starts, sizes = _hashes_of_slice(b" ".join(texts[first:past]))
            offsets = np.cumsum([0, *[len(t) + 1 for t in texts[first:past]]])
            yield first, past, hashes, sizes, np.searchsorted(starts, offsets)
        first = past


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words, in order; empty if there are fewer."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i in range(width):
        total = total * _M1 + words[i : i + n]
    return mix(total)


def records(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task's memory stays flat."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def of_kind(kind: str):
    """Predicate for arrays of structs with a ``kind``."""
    return lambda x: x["kind"] == kind


def only(df: DataFrame, **columns: Column | str) -> DataFrame:
    """Just the named columns. Extra columns of the input cannot clash with an operator's own."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


#: log2 of the bits of a key filter. Its size is fixed; with more keys it only lets more rows through.
FILTER_LOG2 = 23


def _slot(keys: np.ndarray, log2: int) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64)) >> np.uint64(64 - log2)).astype(np.int64)


def passes_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    slot = _slot(keys, len(bits).bit_length() + 2)
    return (bits[slot >> 3] >> (slot & 7)) & 1 == 1


def key_filter(keys: DataFrame, log2: int = FILTER_LOG2) -> np.ndarray:
    """Bitmap of ``2**log2`` bits, one set per value of the long column ``id``, however many there are."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(_slot(batch["id"].to_numpy(zero_copy_only=False), log2))
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["slot"])

    parts = (
        keys.select("id")
        .filter("id IS NOT NULL")
        .mapInArrow(slots, "slot long")
        .groupBy(F.floor(F.col("slot") / 32768).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
        .collect()
    )
    bits = np.zeros(1 << (log2 - 3), dtype=np.uint8)
    for part in parts:
        bits[part["part"] * 4096 : (part["part"] + 1) * 4096] = np.frombuffer(bytes(part["bits"]), dtype=np.uint8)
    return bits


def split_by_keys(df: DataFrame, key: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose long ``key`` may be in ``keys`` (column ``id``), and the rows whose key is not.

    Only the first part needs a join, so rows that no key concerns are not shuffled. NULL is in no filter.
    """
    bits = key_filter(keys)

    @F.pandas_udf("boolean")
    def may(values: pd.Series) -> pd.Series:
        return pd.Series(passes_filter(bits, values.fillna(0).to_numpy(dtype=np.int64)) & values.notna().to_numpy())

    return df.filter(may(key)), df.filter(~may(key))
