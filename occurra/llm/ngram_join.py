"""N-gram Jaccard join by partitioning the universe of shingles.

Two sets of sizes a >= b with Jaccard similarity of at least ``percent`` differ in at most
``h = floor((100 - percent) * (a + b) / (100 + percent))`` shingles. Sizes fall into bands; a band
hashes the universe into ``m`` segments. A set gives each of its segments a value: 0 (not looked up),
1 (looked up as it is, which finds partners that agree on it) or 2 (with its one-deletion
neighbourhood, which finds partners that differ in one shingle there). If the values add up to more
than ``h``, any partner shows up in some segment (pigeonhole). Values are allocated by cost: segments
made of frequent shingles are given up first, as far as the sum allows; empty segments are never
indexed unless some set of the corpus cannot do without.

One set per distinct digest takes part, so exact copies cost nothing. In each index bucket the members
are paired with one of them (the hub), pairs are pruned by size and by a parity sketch (both lose
nothing) and verified on the whole sets. Members of a bucket that are then still in different
components meet new hubs for two more rounds, and whatever is left is paired directly, so every link
that could change a component is verified. Buckets of very frequent contents are salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occurra.llm.common import as_bytes, ascii_lower, batch_words, key_filter, mix, passes_filter, records, small_batches, split_by_keys, window_hashes
from occurra.llm.components import components, fitted, joined_by
from occurra.session import counted_stage, cut_lineage

BAND_RATIO = 1.5
#: Segments of a band that have one-deletion neighbourhoods, at least: what short texts can give up frequent segments for.
LEAST_DEEP = 8
#: A shingle is noted as frequent where it is in at least this share of a batch's documents.
FREQUENT_SHARE = 1 / 200
#: Longest list of frequent shingles given to the cost model; it holds hints, results do not depend on it.
FREQUENT_MOST = 1 << 18
#: Rows of one index bucket in one task; the buckets of more frequent contents are salted.
BUCKET_ROWS = 20_000
HUB_ROUNDS = 3
#: Words of 64 bits in the shortest sketch.
FOLD_WORDS = 8
#: Words of the longest sketch that goes to the buckets: it tells unrelated sets of up to some 9,000 shingles apart.
MOST_WORDS = 64
#: Members that are left meet directly once that makes at most so many pairs a member of a bucket.
DIRECT_PAIRS = 64

_ROW, _FREQUENT, _EMPTY = 0, 1, 2


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles; the whole sequence if it is shorter than ``width``."""
    for first, past, hashes, _, offsets in batch_words([ascii_lower(as_bytes(t)) for t in texts]):
        windows = window_hashes(hashes, width)
        for i in range(past - first):
            start, stop = offsets[i], offsets[i + 1]
            if stop - start >= width:
                yield _distinct(windows[start : stop - width + 1])
            elif start == stop:
                yield hashes[:0]
            else:
                yield window_hashes(hashes[start:stop], stop - start) + np.uint64(stop - start)


def _distinct(tokens: np.ndarray) -> np.ndarray:
    tokens = np.sort(tokens)
    return tokens[np.append(True, tokens[1:] != tokens[:-1])]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(tokens.tobytes())
    return tuple(np.frombuffer(raw, dtype=np.int64).tolist())


def _sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity of the shingles per bit of a hash, two bits a shingle at least and a power of two of them.

    A shingle that only one of two sets has flips one bit, so the bits in which two sketches differ are at most the
    shingles in which the sets do. Halves of a sketch folded on each other are the sketch of half the length.
    """
    bits = max(64 * FOLD_WORDS, 1 << max(0, 2 * len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


class Bands:
    """Size bands, their segments, and the values a set gives them."""

    def __init__(self, percent: int):
        self.percent = percent
        starts = [1]
        while starts[-1] < 1 << 40:
            starts.append(max(starts[-1] + 1, int(starts[-1] * BAND_RATIO)))
        self.starts = np.array(starts, dtype=np.int64)

    def most_apart(self, a: int, b: int) -> int:
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def band(self, size: int) -> int:
        return int(np.searchsorted(self.starts, size, side="right")) - 1

    def joined(self, size: int) -> range:
        """Bands in which a set is indexed: its own and those of larger partners."""
        return range(self.band(size), self.band(size * 100 // self.percent) + 1)

    def segments(self, band: int) -> tuple[int, int]:
        """Segments, and how many of them have one-deletion neighbourhoods."""
        top = int(self.starts[band + 1]) - 1
        m = self.most_apart(top, top) + 1
        return m, min(m, max(LEAST_DEEP, 2 + -(-3 * m // 100)))

    def needs_empty(self, tokens: np.ndarray) -> list[tuple[int, int]]:
        """Empty segments a set has to look up because the others cannot hold the sum."""
        band = self.band(len(tokens))
        m, deep = self.segments(band)
        segment = _segments(tokens, m)
        early = segment[: np.searchsorted(segment, deep)]
        pairs = int((np.bincount(early, minlength=1) >= 2).sum())
        if 1 + np.count_nonzero(segment[1:] != segment[:-1]) + pairs > self.most_apart(len(tokens), len(tokens)):
            return []
        return [(band, int(i)) for i in np.setdiff1d(np.arange(m), segment)]

    def signatures(
        self, sets: list[np.ndarray], frequent: tuple[np.ndarray, np.ndarray], empty: dict[int, np.ndarray], bucket_rows: int
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(set number, signature, looked up, salts) of non-empty sets, a band at a time."""
        by_band: dict[int, list[int]] = {}
        for i, tokens in enumerate(sets):
            # sets too small to differ from a partner have no partner but their copies
            if self.most_apart(*[len(tokens) * 100 // self.percent] * 2):
                for band in self.joined(len(tokens)):
                    by_band.setdefault(band, []).append(i)
        for band, members in by_band.items():
            yield from self._in_band(band, np.array(members), [sets[i] for i in members], frequent, empty.get(band), bucket_rows)

    def _in_band(self, band, members, sets, frequent, empty, bucket_rows):
        m, deep = self.segments(band)
        sizes = np.array([len(t) for t in sets])
        tokens = np.concatenate(sets)
        # sets are sorted and segments are ranges of the hash, so equal (set, segment) stand together
        place = np.repeat(np.arange(len(sets)) * m, sizes) + _segments(tokens, m)
        starts = np.flatnonzero(np.diff(place, prepend=-1))
        counts = np.diff(starts, append=len(tokens))
        owner, number = np.divmod(place[starts], m)
        scattered = mix(tokens + np.uint64(0x632BE59BD9B4E019))
        often = np.ones(len(tokens), dtype=np.int64)
        keys, times = frequent
        if len(keys):
            at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
            hit = keys[at] == tokens
            often[hit] = times[at[hit]]
        cost = np.minimum.reduceat(often, starts)
        two = (number < deep) & (counts >= 2)
        value = 1 + two.astype(np.int64)
        own = np.array([self.band(n) == band for n in sizes])
        budget = np.array([self.most_apart(n, n) for n in sizes])
        spare = np.bincount(owner, value, minlength=len(sets)).astype(np.int64) - budget - 1
        wants_empty = own & (spare < 0)
        value[~own[owner]] = 0
        # the most frequent contents are given up first, then the shortest, then the second value of segments:
        # how many sets agree on a segment falls with every shingle it holds
        order = np.lexsort((counts, -cost, owner))
        sums = np.cumsum(value[order])
        begins = np.searchsorted(owner, np.arange(len(sets)))
        upto = sums - (sums[begins] - value[order][begins])[owner]
        gone = order[upto <= spare[owner]]
        np.subtract.at(spare, owner[gone], value[gone])
        value[gone] = 0
        pairs = np.flatnonzero(value == 2)
        rank = np.arange(len(pairs)) - np.searchsorted(owner[pairs], owner[pairs])
        value[pairs[rank < spare[owner[pairs]]]] = 1
        salts = 1 + cost // bucket_rows
        sums = np.add.reduceat(scattered, starts)
        yield members[owner], _tag(sums, number, band), (value > 0) | (salts > 1), salts

        chosen = np.flatnonzero(two)
        if len(chosen):
            n = counts[chosen]
            where = np.repeat(starts[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())
            of = np.repeat(chosen, n)
            rest = np.ones(len(where), dtype=np.int64)
            if often.max() >= bucket_rows:
                # what is left without one shingle is frequent only where at most one is not; from ``bucket_rows`` on
                # a content is salted, however it came about
                rare = np.add.reduceat((often < bucket_rows).astype(np.int64), starts)
                for j in np.flatnonzero(rare[of] <= 1):
                    others = np.delete(often[starts[of[j]] : starts[of[j]] + counts[of[j]]], where[j] - starts[of[j]])
                    rest[j] = others.min()
            salts = 1 + rest // bucket_rows
            yield members[owner[of]], _tag(sums[of] - scattered[where], number[of], band), (value[of] == 2) | (salts > 1), salts

        for i in range(len(sets)) if empty is not None else ():
            lacking = np.setdiff1d(empty, number[owner == i])
            zero, one = np.zeros(len(lacking), dtype=np.uint64), np.ones(len(lacking), dtype=np.int64)
            yield np.full(len(lacking), members[i]), _tag(zero, lacking, band), np.full(len(lacking), wants_empty[i]), one


def _segments(tokens: np.ndarray, m: int) -> np.ndarray:
    return (((tokens >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)


def _tag(content: np.ndarray, number: np.ndarray, band: int) -> np.ndarray:
    return mix(content ^ mix(number.astype(np.uint64) * np.uint64(4096) + np.uint64(band + 1)))


def _profile(width: int, percent: int):
    """Per text its size, digest and sketch; per batch the frequent shingles; empty segments that are needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in records(batches):
            rows, needed, sets = [], set(), []
            for key, tokens in zip(batch["id"].to_pylist(), shingle_sets(batch["text"].to_pylist(), width), strict=True):
                ida, idb = _digest(tokens)
                rows.append((_ROW, key, len(tokens), ida, idb, _sketch(tokens)))
                if len(tokens):
                    needed.update(bands.needs_empty(tokens))
                    sets.append(tokens)
            if sets:
                every = np.concatenate(sets)
                floor = max(8, int(len(sets) * FREQUENT_SHARE))
                slot = (every >> np.uint64(44)).astype(np.int64)
                every = every[np.bincount(slot, minlength=1 << 20)[slot] >= floor]
                found, times = np.unique(every, return_counts=True)
                for token, n in zip(found[times >= floor].view(np.int64).tolist(), times[times >= floor].tolist(), strict=True):
                    rows.append((_FREQUENT, None, n, token, 0, None))
            rows += [(_EMPTY, None, 0, band, number, None) for band, number in sorted(needed)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c, pa.int64()) for c in columns[:5]], pa.array(columns[5], pa.list_(pa.int64()))],
                names=["kind", "id", "n", "ida", "idb", "sketch"],
            )

    return run


def _index(width: int, percent: int, frequent, empty, bucket_rows: int):
    """Rows (sig, entry) of the index: a signature, mixed with a salt where its bucket is salted, and the packed
    salt, set and whether the set looks it up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in records(batches, 500):
            sets = [t for t in shingle_sets(batch["text"].to_pylist(), width) if len(t)]
            if not sets:
                continue
            ids = np.array([_short(_digest(t)[0]) for t in sets], dtype=np.int64)
            for of, sig, look, salts in bands.signatures(sets, frequent, empty, bucket_rows):
                salts = np.minimum(salts, _SALTS)
                salt = np.where(salts > 1, 1 + ids[of] % salts, 0)
                entry = (salt << (_SET_BITS + 1)) | (ids[of] << 1) | look
                yield pa.RecordBatch.from_arrays([pa.array(_salted(sig, salt).view(np.int64)), pa.array(entry)], names=["sig", "entry"])

    return run


#: Bits of a set's number in the index. Sets that share a number are told apart when they are verified.
_SET_BITS = 48
_SALTS = 1 << 13


def _short(half_digest):
    """Of numbers, arrays or columns."""
    low = (1 << _SET_BITS) - 1
    return half_digest.bitwiseAND(low) if isinstance(half_digest, Column) else half_digest & low


def _salted(sig: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Its own inverse; no change without a salt."""
    return np.where(salt > 0, sig ^ mix(salt.astype(np.uint64)), sig)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index rows, sorted so that a bucket's hub comes first, to rows (sig, salt, first, id, look) of the others.

    Works on the stream: between batches only the last bucket's hub is kept, whatever the size of a bucket.
    """
    last_sig, last_hub = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch["sig"].to_numpy().view(np.uint64)
        entry = batch["entry"].to_numpy()
        starts = np.append(True, sig[1:] != sig[:-1])
        starts[0] = last_sig is None or sig[0] != last_sig
        at = np.maximum.accumulate(np.where(starts, np.arange(len(sig)), -1))
        hub = np.where(at >= 0, entry[np.maximum(at, 0)], last_hub)
        last_sig, last_hub = sig[-1], hub[-1]
        ids, first = _short(entry >> 1), _short(hub >> 1)
        # hubs of salted buckets are rows too: they have others to meet
        keep = ((ids != first) | (entry >> (_SET_BITS + 1) > 0)) & (hub & 1 == 1)
        if keep.any():
            salt = entry[keep] >> (_SET_BITS + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_salted(sig[keep], salt).view(np.int64)),
                    pa.array(salt),
                    pa.array(first[keep]),
                    pa.array(ids[keep]),
                    pa.array(entry[keep] & 1 == 1),
                ],
                names=["sig", "salt", "first", "id", "look"],
            )


def _sets(width: int, bits: np.ndarray):
    """Whole sets of the texts whose id is in the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in records(batches, 2000):
            keys = batch["id"].fill_null(0).to_numpy(zero_copy_only=False)
            passed = passes_filter(bits, keys) & batch["id"].is_valid().to_numpy(zero_copy_only=False)
            texts = batch["text"].filter(pa.array(passed)).to_pylist()
            rows = [(int(k), *_digest(t), t.view(np.int64)) for k, t in zip(keys[passed], shingle_sets(texts, width), strict=True)]
            key, ida, idb, sets = list(zip(*rows, strict=True)) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.int64()), pa.array(ida, pa.int64()), pa.array(idb, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=["id", "ida", "idb", "tokens"],
            )

    return run


def _verified(
    texts: DataFrame, classes: DataFrame, pairs: DataFrame, rows: int, width: int, percent: int
) -> tuple[DataFrame, int]:
    """Pairs (a, b) of set numbers -> links (a, b) between the documents that stand for the sets, and their number.

    ``rows`` is about the number of pairs.
    """

    def side(x: str) -> DataFrame:
        return classes.select(
            _short(F.col("ida")).alias(x), F.col("ida").alias(f"{x}1"), F.col("idb").alias(f"{x}2"),
            F.col("n").alias(f"n{x}"), F.col("rep").alias(f"r{x}"), F.col("sketch").alias(f"s{x}"),
        )

    met = pairs.join(side("a"), "a").join(side("b"), "b")
    kept, n_kept = counted_stage(
        fitted(
            met.filter(_may_link(percent, F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select(
                "a1", "a2", "na", "ra", "b1", "b2", "nb", "rb"
            ),
            rows,
        ),
        "candidates",
    )
    if not n_kept:
        return kept.select(F.col("ra").alias("a"), F.col("rb").alias("b")), 0
    bits = key_filter(kept.select(F.explode(F.array("ra", "rb")).alias("id")))
    sets = cut_lineage(texts.mapInArrow(_sets(width, bits), "id long, ida long, idb long, tokens array<long>"), "sets")
    of_b = sets.select(F.col("id").alias("rb"), F.col("ida").alias("b1"), F.col("idb").alias("b2"), F.col("tokens").alias("tb"))
    of_a = sets.select(F.col("id").alias("ra"), F.col("ida").alias("a1"), F.col("idb").alias("a2"), F.col("tokens").alias("ta"))
    both = kept.join(of_b, ["rb", "b1", "b2"]).join(of_a, ["ra", "a1", "a2"])
    shared = F.size(F.array_intersect("ta", "tb"))
    similar = both.filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared))
    links = similar.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
    return counted_stage(fitted(links, 10 * n_kept), "links")


def ngram_jaccard_join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Texts link when ``100 * shared >= percent * union`` over their sets of ``width``-word shingles, with
    A-Z in lower case. ``component_id`` is the smallest id reachable, the row's own id included.
    NULL and empty texts have no shingles and link with nothing. Rows that share an id count as one
    document. A row without an id keeps its size; its component is that of its equal texts, or NULL.
    Repeated rows come out as often as they go in; other columns of the input are not looked at.
    """
    texts = small_batches(docs).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    stored = cut_lineage(
        texts.mapInArrow(
            _profile(width, percent),
            "kind long, id long, n long, ida long, idb long, sketch array<long>",
        ),
        "profile",
    )
    rows = stored.filter(F.col("kind") == _ROW)
    classes = cut_lineage(
        rows.filter("n > 0")
        .groupBy("ida", "idb")
        .agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")),
        "classes",
    )
    listed = (
        stored.filter(F.col("kind") == _FREQUENT)
        .groupBy("ida")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "ida")
        .limit(FREQUENT_MOST)
        .collect()
    )
    keys = np.array([r["ida"] for r in listed], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    frequent = (keys[order], np.array([r["n"] for r in listed], dtype=np.int64)[order])
    empty: dict[int, list[int]] = {}
    # at most all segments of all bands up to the largest text: bounded by one text's size
    for r in stored.filter(F.col("kind") == _EMPTY).select("ida", "idb").distinct().collect():
        empty.setdefault(r["ida"], []).append(r["idb"])
    empty = {band: np.array(sorted(numbers), dtype=np.int64) for band, numbers in empty.items()}

    index = texts.mapInArrow(_index(width, percent, frequent, empty, bucket_rows), "sig long, entry long")
    # the hub of a bucket: a set that looks it up, the first under one of two orders
    family = F.xxhash64(_short(F.shiftright("entry", 1)), F.pmod("sig", F.lit(2)))
    members, n_members = counted_stage(
        index.repartition("sig")
        .sortWithinPartitions("sig", F.col("entry").bitwiseAND(1).desc(), family, "entry")
        .mapInArrow(_buckets, "sig long, salt long, first long, id long, look boolean"),
        "buckets",
    )
    # salted buckets of one content meet at the hub of their hubs
    of_salt = members.filter("salt > 0")
    tops = of_salt.groupBy("sig").agg(F.min("first").alias("top"))
    salted = of_salt.join(tops, "sig")

    def pair(x: str, y: str, df: DataFrame) -> DataFrame:
        return df.filter(F.col(x) != F.col(y)).select(F.col(x).alias("a"), F.col(y).alias("b"))

    asked = pair("first", "id", members).unionAll(pair("top", "first", salted)).distinct()
    links, n_links = _verified(texts, classes, asked, n_members, width, percent)
    reached = components(links, n_links)
    hubs = members.select("sig", F.col("first").alias("id"), F.lit(True).alias("look"))
    unsettled = members.select("sig", "id", "look").unionAll(hubs).distinct()
    for step in range(1, HUB_ROUNDS + 2):
        by_id = classes.join(reached, F.col("rep") == F.col("node"), "left").select(
            _short(F.col("ida")).alias("id"), F.coalesce("label", "rep").alias("comp")
        )
        unsettled, left = counted_stage(fitted(_unsettled(unsettled.select("sig", "id", "look"), by_id), n_members), "unsettled")
        if not left:
            break
        of_comp = unsettled.groupBy("sig", "comp").agg(F.count(F.lit(1)).cast("double").alias("c"))
        of_sig = of_comp.groupBy("sig").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("pairs"))
        pairs = of_sig.agg(F.sum("pairs")).first()[0] / 2
        last = step > HUB_ROUNDS or pairs <= DIRECT_PAIRS * n_members
        sketched = _sketched(unsettled, classes)
        asked = _direct_pairs(sketched, percent) if last else _hub_pairs(sketched, step, percent)
        found, n_found = _verified(texts, classes, asked, left, width, percent)
        if n_found:
            reached = joined_by(reached, found, n_found)
        if last:
            break
    labelled = classes.join(reached, F.col("rep") == F.col("node"), "left").select(
        "ida", "idb", F.coalesce("label", "rep").alias("component_id")
    )
    return (
        rows.join(labelled, ["ida", "idb"], "left")
        .select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))
    )


def _unsettled(rows: DataFrame, by_id: DataFrame) -> DataFrame:
    """``sig, id, look, comp`` of the buckets whose members are not all in one component.

    A bucket of two has met.
    """
    bucket = Window.partitionBy("sig")
    seen = rows.join(by_id, "id").select("sig", "id", "look", "comp")
    marked = seen.select(
        "*",
        (F.min("comp").over(bucket) < F.max("comp").over(bucket)).alias("mixed"),
        F.count(F.lit(1)).over(bucket).alias("size"),
    )
    return marked.filter("mixed AND size > 2").drop("mixed", "size")


def _sketched(unsettled: DataFrame, classes: DataFrame) -> DataFrame:
    """``unsettled`` with size ``n``, folded sketch and, of sets whose sketch is longer, ``s``: up to ``MOST_WORDS`` of it."""
    sketch = F.col("sketch")
    longer = F.when(F.size(sketch) > FOLD_WORDS, F.when(F.size(sketch) <= MOST_WORDS, sketch).otherwise(F.array(*_folded(sketch, MOST_WORDS))))
    by_id = classes.select(_short(F.col("ida")).alias("id"), "n", *_folded(sketch), longer.alias("s"))
    return unsettled.join(by_id, "id")


def _may_link(percent: int, size_x: Column, sketch_x: Column, size_y: Column, sketch_y: Column) -> Column:
    """False only where sizes or sketches rule a link out. Partners' sketches are at most one halving apart."""

    def halved(s: Column) -> Column:
        half = (F.size(s) / 2).cast("int")
        return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda a, b: a.bitwiseXOR(b))

    x = F.when(F.size(sketch_x) > F.size(sketch_y), halved(sketch_x)).otherwise(sketch_x)
    y = F.when(F.size(sketch_y) > F.size(sketch_x), halved(sketch_y)).otherwise(sketch_y)
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, d: n + d)
    most = F.floor((100 - percent) * (size_x + size_y) / (100 + percent))
    return (100 * F.least(size_x, size_y) >= percent * F.greatest(size_x, size_y)) & (apart <= most)


#: Columns of a folded sketch.
_WORDS = [f"w{i}" for i in range(FOLD_WORDS)]


def _folded_may_link(percent: int, x, y) -> Column:
    """False only where sizes or folded sketches rule a link out; ``x`` and ``y`` give the columns of either side."""
    apart = sum((F.bit_count(x(w).bitwiseXOR(y(w))) for w in _WORDS), F.lit(0))
    sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    return sizes & ((100 + percent) * apart <= (100 - percent) * (x("n") + y("n")))


def _hub_pairs(unsettled: DataFrame, step: int, percent: int) -> DataFrame:
    """A new hub per bucket against the members of other components, but those that sizes or folded sketches rule out."""
    rank = F.xxhash64("id", F.lit(step))
    hubs = unsettled.filter("look").groupBy("sig").agg(F.min(F.struct(rank.alias("rank"), "id", "comp", "n", *_WORDS)).alias("h"))
    met = unsettled.join(hubs, "sig").filter(F.col("h.comp") != F.col("comp"))
    near = met.filter(_folded_may_link(percent, F.col, lambda c: F.col(f"h.{c}")))
    return near.select(F.col("h.id").alias("a"), F.col("id").alias("b")).distinct()


def _direct_pairs(unsettled: DataFrame, percent: int) -> DataFrame:
    """What the hubs left: members of different components of which one looks the bucket up.

    Sizes and sketches are part of the join condition, so a pair that they rule out is never written. The folded ones come
    first; of sets with more than a few hundred shingles they rule out little, those of ``s`` do.
    """
    one, two = unsettled.alias("x"), unsettled.alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    on = (x("sig") == y("sig")) & (x("id") < y("id")) & (x("comp") != y("comp")) & (x("look") | y("look")) & _folded_may_link(percent, x, y)
    on &= x("s").isNull() | y("s").isNull() | _may_link(percent, x("n"), x("s"), y("n"), y("s"))
    return one.join(two, on).select(x("id").alias("a"), y("id").alias("b")).distinct()


def _folded(sketch: Column, words: int = FOLD_WORDS) -> list[Column]:
    """A sketch folded to ``words`` words, by default to the shortest one there is."""

    def word(k: int) -> Column:
        own = F.filter(sketch, lambda _, i: i % words == k)
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)).alias(f"w{k}")

    return [word(k) for k in range(words)]


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row per group of linked texts: that of the smallest id, unchanged.

    Of rows that share an id one stays. Rows without an id and texts without a word belong to no group and stay.
    """
    groups = cut_lineage(ngram_jaccard_join(docs, width=width, percent=percent), "groups")
    named = groups.filter("doc_id IS NOT NULL")
    gone = named.filter("component_id < doc_id").select("doc_id").distinct()
    again = named.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    some, others = split_by_keys(docs, F.col("doc_id").cast("long"), gone.unionAll(again).withColumnRenamed("doc_id", "id"))
    return some.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).dropDuplicates(["doc_id"]).unionAll(others)
