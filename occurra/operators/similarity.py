"""Fingerprint search: Tanimoto similarity, similarity join, substructure screen.

Fingerprints are ``(c, bits)`` with distinct positions below ``n_bits``. Bits
are packed into 64-bit words, so a comparison is a few bitwise operations in
generated code.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.operators.skew import DEFAULT_POLICY, SkewPolicy, attach, heavy_keys
from occurra.session import counted_stage, cut_lineage

BLOCK_ROWS = 20_000  # rows that may come to one key before it is split
LEVELS = 3  # tokens in a key
GRID, GRID_BLOCK = 24, 1024  # blocks a side at most, unless they grow beyond BLOCK_ROWS; rows of a block at least
NO_CELL = -1  # of a key that is not split by size band


def n_words(n_bits: int) -> int:
    return -(-n_bits // 64)


def _signed(word: int) -> int:
    return word - (1 << 64) if word >= 1 << 63 else word


def literal_words(bits: list[int], n_bits: int) -> list[int]:
    words = [0] * n_words(n_bits)
    for bit in set(bits):
        words[bit // 64] |= 1 << (bit % 64)
    return [_signed(w) for w in words]


def pack(bits: Column, word: int) -> Column:
    """One 64-bit word out of bit positions."""
    inside = F.filter(bits, lambda b: (b >= 64 * word) & (b < 64 * (word + 1)))
    one = F.lit(1).cast("bigint")
    return F.aggregate(
        inside,
        F.lit(0).cast("bigint"),
        lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", one, (b - 64 * word).cast("int"))),
    )


def packed(fingerprints: DataFrame, n_bits: int, prefix: str = "w") -> DataFrame:
    """``(c, w0..wk, size)``; taken as they are where a table holds them already."""
    if prefix == "w" and "w0" in fingerprints.columns:
        return fingerprints.select("c", *[f"w{i}" for i in range(n_words(n_bits))], "size")
    words = [pack(F.col("bits"), i).alias(f"{prefix}{i}") for i in range(n_words(n_bits))]
    return fingerprints.select("c", *words, F.size("bits").alias("size"))


def _total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def tanimoto(common: Column, size_a: Column, size_b: Column) -> Column:
    """Shared over united bits; two empty fingerprints are not similar."""
    return F.try_divide(common.cast("double"), (size_a + size_b - common).cast("double"))


def similar(fingerprints: DataFrame, query_bits: list[int], threshold: float, n_bits: int) -> DataFrame:
    """``(c, similarity)`` at or above the threshold, one scan without a join."""
    size = len(set(query_bits))
    df = packed(fingerprints, n_bits).filter(
        F.col("size").between(threshold * size - 1e-9, size / threshold + 1e-9)
    )
    common = _total(
        [F.bit_count(F.col(f"w{i}").bitwiseAND(F.lit(w))) for i, w in enumerate(literal_words(query_bits, n_bits))]
    )
    return (
        df.withColumn("similarity", tanimoto(common, F.col("size"), F.lit(size)))
        .filter(F.col("similarity") >= threshold)
        .select("c", "similarity")
    )


def substructure_screen(fingerprints: DataFrame, query_bits: list[int], n_bits: int) -> DataFrame:
    """C17: compounds holding every bit of the query; misses none, may keep too many."""
    df = packed(fingerprints, n_bits)
    for i, word in enumerate(literal_words(query_bits, n_bits)):
        if word:
            df = df.filter(F.col(f"w{i}").bitwiseAND(F.lit(word)) == F.lit(word))
    return df.select("c")


def fingerprint_groups(fingerprints: DataFrame) -> DataFrame:
    """Distinct fingerprints: ``(rep, bits, n)``, named by their smallest compound id."""
    return fingerprints.groupBy(F.array_sort("bits").alias("bits")).agg(
        F.min("c").alias("rep"), F.count(F.lit(1)).alias("n")
    ).select("rep", "bits", "n")


def fingerprint_members(fingerprints: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """``(rep, c)`` for every compound: links copies to the row that stands for them.

    With ``similar_pairs`` this holds every similar pair of compounds in space
    that grows with the compounds, not with the square of a group of copies.
    A large group of copies is split over tasks.
    """
    print_key = F.sha2(F.array_join(F.array_sort("bits"), ",").cast("binary"), 256)
    keyed = fingerprints.select("c", print_key.alias("print"))
    reps = keyed.groupBy("print").agg(F.min("c").alias("rep"))
    heavy = heavy_keys(keyed, ["print"], policy).of("print")
    return attach(keyed, [(reps, "inner")], "print", heavy, F.col("c")).select("rep", "c")


def _rarity_rank(groups: DataFrame, n_bits: int) -> list[int]:
    """Rank of every bit, rarest first. The driver sees at most ``n_bits`` rows."""
    seen = {
        r["bit"]: r["n"]
        for r in groups.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count(F.lit(1)).alias("n")).collect()
    }
    order = sorted(range(n_bits), key=lambda b: (seen.get(b, 0), b))
    rank = [0] * n_bits
    for position, bit in enumerate(order):
        rank[bit] = position
    return rank


def _ranked(groups: DataFrame, threshold: float, n_bits: int) -> DataFrame:
    """``(rep, n, size, least, band, tokens, w0..wk)``: bits as tokens, rarest first, in the words too.

    A pair at the threshold shares at least ``least`` tokens of either side, and lies in the same size band or in
    neighbouring ones.
    """
    rank = _rarity_rank(groups, n_bits)
    width = -math.log(threshold) + 1e-6  # a little wide, so that rounding never parts a pair by two bands
    size = F.size("bits")
    ranked = groups.select(
        "rep",
        "n",
        size.alias("size"),
        F.ceil(size * threshold - 1e-9).cast("int").alias("least"),
        F.floor(F.ln(size) / width).cast("int").alias("band"),
        F.array_sort(F.transform("bits", lambda b: F.get(F.array(*map(F.lit, rank)), b))).alias("tokens"),
    )
    return ranked.select("*", *[pack(F.col("tokens"), i).alias(f"w{i}") for i in range(n_words(n_bits))])


def _extended(postings: DataFrame, level: int, n_bits: int) -> DataFrame:
    """Keys of ``level - 1`` tokens with every token that may be the next one that a pair shares.

    The first ``level`` shared tokens lie among the first ``size - least + level`` of each side. ``n_bits`` stands
    for no further token, which only rows that need fewer than ``level`` shared ones can mean.
    """
    length = F.greatest(F.col("size") - F.col("least") + level - F.col("at"), F.lit(0))
    following = F.slice("tokens", F.col("at") + 1, length)
    none = F.when(F.col("least") < level, F.array(F.lit(n_bits))).otherwise(F.array().cast("array<int>"))
    found = postings.withColumn("token", F.explode(F.concat(following, none)))
    return found.withColumns(
        {
            "key": F.col("key") * (n_bits + 1) + F.col("token"),
            "at": F.array_position("tokens", F.col("token")).cast("int"),
            "level": F.lit(level),
        }
    )


def similarity_postings(rows: DataFrame, n_bits: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows of ``_ranked`` under the keys ``(level, key, cell, row, col)`` at which pairs can meet.

    A key starts as one token. One that more than ``block_rows`` rows come to is split by size band (``cell``), then by
    the next tokens that a pair shares, up to ``LEVELS`` tokens; the number of copies of a row depends on its
    own tokens and not on the length of a list. What is still too long after that is cut into ``g`` blocks.
    """
    start = rows.withColumns({"key": F.lit(0).cast("bigint"), "at": F.lit(0), "cell": F.lit(NO_CELL)})
    postings = _extended(start, 1, n_bits)
    parts = []
    for level in range(LEVELS + 1):
        counted = postings.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("long"))
        heavy, n = counted_stage(counted.filter(F.col("long") > block_rows), "long_lists")
        if not n:
            parts.append(postings.withColumn("g", F.lit(1)))
            break
        marked = postings.join(heavy, ["key", "cell"], "left")
        splits = F.col("long").isNotNull() & F.lit(level < LEVELS)
        if level:
            splits = splits & (F.col("token") < n_bits)
        blocks = F.coalesce(F.ceil(F.col("long") / block_rows), F.lit(1)).cast("int")
        parts.append(marked.filter(~splits).withColumn("g", blocks).drop("long"))
        rest = marked.filter(splits).drop("long")
        if level == 0:
            postings = rest.withColumn("cell", F.explode(F.array("band", F.col("band") + 1)))
        elif level < LEVELS:
            postings = _extended(rest, level + 1, n_bits)
    return reduce(DataFrame.unionByName, parts).drop("tokens", "least", "at")


def _meets_by_tokens(rows: DataFrame, n_rows: int, n_bits: int) -> bool:
    """Whether the first tokens of the rows make fewer candidate pairs than all rows with all rows.

    Few bits that most rows hold make long lists, in several of which the same two rows meet. The driver sees at most
    ``n_bits`` numbers.
    """
    first = F.slice("tokens", 1, F.col("size") - F.col("least") + 1)
    lists = rows.select(F.explode(first).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    return sum(r["n"] ** 2 for r in lists.collect()) < n_rows**2


def similar_pairs(
    fingerprints: DataFrame, threshold: float, n_bits: int, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact pairs ``(a, b, similarity, n_a, n_b)`` of distinct fingerprints.

    Two sets at or above the threshold share a token among the rarest
    ``size - ceil(t * size) + 1`` of each. Rows meet on the first tokens they share, within
    neighbouring size bands (``similarity_postings``); a pair is
    kept only at its first shared tokens and only once verified, both inside
    the join condition, so no candidate pair is ever written or shuffled. Where the lists of tokens would make more
    candidates than there are pairs, every two rows meet once, in a grid of blocks.
    """
    groups = cut_lineage(fingerprint_groups(fingerprints).filter(F.size("bits") > 0), "prints")
    rows, n_rows = counted_stage(_ranked(groups, threshold, n_bits), "packed")
    words = range(n_words(n_bits))
    if not _meets_by_tokens(rows, n_rows, n_bits):
        return _grid_pairs(rows, n_rows, threshold, n_bits, block_rows)

    postings = similarity_postings(rows, n_bits, block_rows)
    block = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("g") - 1))
    # the side of the larger band stands in its own cell only
    a = postings.filter((F.col("cell") == F.col("band")) | (F.col("cell") == NO_CELL)).withColumn("row", block).withColumn("col", every).alias("l")
    b = postings.withColumn("col", block).withColumn("row", every).alias("r")

    token = F.col("l.token")
    shared, score = _score(n_bits)
    below = [
        F.when(token >= 64 * (i + 1), F.lit(-1).cast("bigint"))
        .when(token <= 64 * i, F.lit(0).cast("bigint"))
        .otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), token - 64 * i)))
        for i in words
    ]
    first_shared = _total([F.bit_count(s.bitwiseAND(m)) for s, m in zip(shared, below)]) == F.col("l.level") - 1
    on = reduce(lambda x, y: x & y, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in ("level", "key", "cell", "row", "col")])
    ordered = F.col("l.rep") < F.col("r.rep")
    condition = (
        on
        & (F.least("l.size", "r.size") >= F.greatest("l.size", "r.size") * threshold - 1e-9)
        & (((F.col("l.cell") != NO_CELL) & (F.col("l.band") > F.col("r.band"))) | ordered)
        & first_shared
        & (score >= threshold)
    )
    return _named_pairs(a.join(b, condition), score)


def _grid_pairs(rows: DataFrame, n_rows: int, threshold: float, n_bits: int, block_rows: int) -> DataFrame:
    """The pairs of ``similar_pairs`` out of all pairs: blocks of rows meet each other once, the test is in the join condition."""
    g = max(-(-n_rows // block_rows), min(-(-n_rows // GRID_BLOCK), GRID), 1)
    words = [f"w{i}" for i in range(n_words(n_bits))]
    block = F.pmod(F.xxhash64("rep"), F.lit(g)).cast("int")
    # nearly every pair fails this plain test, which lets all pass that the score lets pass
    share = (F.col("size") * threshold).alias("share")
    placed = rows.select("rep", "n", "size", share, *words, block.alias("block"))
    a = placed.select("*", F.col("block").alias("row"), F.explode(F.sequence(F.col("block"), F.lit(g - 1))).alias("col")).alias("l")
    b = placed.select("*", F.col("block").alias("col"), F.explode(F.sequence(F.lit(0), F.col("block"))).alias("row")).alias("r")
    shared, score = _score(n_bits)
    near = _total([F.bit_count(s) for s in shared]) * (1 + threshold) >= F.col("l.share") + F.col("r.share") - 1e-9
    on = (F.col("l.row") == F.col("r.row")) & (F.col("l.col") == F.col("r.col"))
    once = (F.col("l.block") < F.col("r.block")) | (F.col("l.rep") < F.col("r.rep"))
    # the work is in the pairs of blocks, so these are shuffled even where the rows are few
    return _named_pairs(a.join(b.hint("merge"), on & near & (score >= threshold) & once), score)


def _score(n_bits: int) -> tuple[list[Column], Column]:
    """Shared words of rows ``l`` and ``r``, and their similarity."""
    shared = [F.col(f"l.w{i}").bitwiseAND(F.col(f"r.w{i}")) for i in range(n_words(n_bits))]
    return shared, tanimoto(_total([F.bit_count(s) for s in shared]), F.col("l.size"), F.col("r.size"))


def _named_pairs(met: DataFrame, score: Column) -> DataFrame:
    ordered = F.col("l.rep") < F.col("r.rep")
    return met.select(
        F.when(ordered, F.col("l.rep")).otherwise(F.col("r.rep")).alias("a"),
        F.when(ordered, F.col("r.rep")).otherwise(F.col("l.rep")).alias("b"),
        score.alias("similarity"),
        F.when(ordered, F.col("l.n")).otherwise(F.col("r.n")).alias("n_a"),
        F.when(ordered, F.col("r.n")).otherwise(F.col("l.n")).alias("n_b"),
    )
