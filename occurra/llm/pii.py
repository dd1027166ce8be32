"""Personal data by boosted candidates, in DataFrame functions only.

Generators propose overlapping spans with high recall. Each candidate is described by binned features of
its format and context; a candidate counts as true where a span that passes its kind's full check
(checksum, range, number of digits) overlaps it. The counts per combination of bins, a table of bounded
size over all candidates of the corpus, are all that gradient-boosted trees need for training. Combinations
whose score passes a threshold calibrated for precision add spans to those that passed the check.

Spans with places come from regular expressions without a UDF: the pieces between matches and the matches
themselves give the lengths, and their running sums the places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import of_kind
from occurra.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# fixed values: the base patterns. Possessive repeats and the look-behinds change no match; they keep long runs linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# fixed values: patterns of further proposals, by the kind they propose
WIDER = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[(\[](?:at|AT)[)\]]\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|[(\[](?:dot|DOT)[)\]])\x20?[A-Za-z0-9-]{1,63}+){1,4}",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20.-])[0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
# what a text with such a proposal has at least
_HINTS = {"email": r"(?i)[(\[]at[)\]]", "phone": r"[0-9][\x20.-][0-9]{3}"}
CUES = r"(?i)(?:mail|contact|write|tel|phone|call|fax|mobile|cell|card|visa|credit|host|server|addr)[^0-9A-Za-z]*$"
CONTEXT = 24
BLOCK = 64

#: Bins per feature: generator, digits, separators, cue word before, letter or digit right before and after.
BINS = (6, 7, 4, 2, 2, 2)
_GENERATORS = (*[("base", k) for k in KINDS], *[("wider", k) for k in WIDER])

ROUNDS, DEPTH, RATE = 24, 2, 0.4
#: Share of true candidates, and least number of candidates, above a kind's threshold.
PRECISION, SUPPORT = 0.95, 20

_SPAN = "struct<first: int, past: int, hit: string, before: string, after: string>"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def spans(text: Column, pattern: str) -> Column:
    """Every match with its place in code points and what stands next to it."""

    def placed(hits: Column, pieces: Column) -> Column:
        steps = F.transform(hits, lambda h, i: F.length(F.get(pieces, i)) + F.length(h))

        def with_steps(steps: Column) -> Column:
            count = F.size(hits)
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")), lambda k: _sum(F.slice(steps, k * BLOCK + 1, F.lit(BLOCK)))
            )

            def with_blocks(blocks: Column) -> Column:
                offsets = F.transform(blocks, lambda _, k: _sum(F.slice(blocks, F.lit(1), k)))
                return _let(
                    offsets,
                    lambda offsets: F.transform(
                        hits,
                        lambda h, i: _let(
                            F.get(offsets, F.floor(i / BLOCK).cast("int"))
                            + _sum(F.slice(steps, i - i % BLOCK + 1, i % BLOCK))
                            + F.length(F.get(pieces, i)),
                            lambda first: F.struct(
                                first.alias("first"),
                                (first + F.length(h)).alias("past"),
                                h.alias("hit"),
                                F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("before"),
                                F.substring(F.get(pieces, i + 1), 1, 1).alias("after"),
                            ),
                        ),
                    ),
                )

            return _let(blocks, with_blocks)

        return _let(steps, with_steps)

    return _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda hits: F.when(F.size(hits) == 0, _none(_SPAN)).otherwise(_let(F.split(text, pattern, -1), lambda pieces: placed(hits, pieces))),
    )


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Checksum of a short run of digits."""

    def part(i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return _sum(F.transform(F.sequence(F.lit(0), F.length(digits) - 1), part)) % 10 == 0


def passes(kind: str, hit: Column) -> Column:
    """The full check of a base match."""
    if kind == "ip":
        return F.forall(
            F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0"))),
            lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")),
        )
    if kind == "card":
        return _let(_digits(hit), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def _cell(generator: int, s: Column) -> Column:
    """One number for the bins of a candidate."""
    digits = F.length(_digits(s["hit"]))
    size = sum((F.when(digits >= least, 1).otherwise(0) for least in (1, 7, 9, 12, 16, 20)), F.lit(0))
    apart = F.least(F.lit(BINS[2] - 1), F.length(F.regexp_replace(s["hit"], r"[^\x20().\[\]-]", "")))
    cell = F.lit(generator)
    for bins, value in zip(
        BINS[1:],
        (
            size, apart, F.when(s["before"].rlike(CUES), 1).otherwise(0),
            F.when(s["before"].rlike("[0-9A-Za-z]$"), 1).otherwise(0), F.when(s["after"].rlike("^[0-9A-Za-z]"), 1).otherwise(0),
        ),
        strict=True,
    ):
        cell = cell * bins + value
    return cell


_CANDIDATE = "struct<kind: string, first: int, past: int, base: boolean, truth: boolean, cell: int>"


def _candidate(kind: str, s: Column, base: Column, truth: Column, cell: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), s["first"].alias("first"), s["past"].alias("past"),
        base.alias("base"), truth.alias("truth"), cell.cast("int").alias("cell"),
    )


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, found``: the candidates of every text, those that pass the base check marked ``base``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.concat(*[_base_candidates(text, k) for k in KINDS]).alias("found")
    )
    wider = [_wider_candidates(F.col("text"), k) for k in WIDER]
    return rows.select("doc_id", F.concat("found", *wider).alias("found"))


def _base_candidates(text: Column, kind: str) -> Column:
    generator = _GENERATORS.index(("base", kind))
    checked = F.transform(spans(text, BASE[kind]), lambda s: F.struct(s.alias("s"), passes(kind, s["hit"]).alias("ok")))
    if kind == "card":
        # shorter runs of digits are no candidates for anything
        checked = F.filter(checked, lambda c: c["ok"] | (F.length(_digits(c["s"]["hit"])) >= 13))
    return F.transform(checked, lambda c: _candidate(kind, c["s"], c["ok"], c["ok"], _cell(generator, c["s"])))


def _wider_candidates(text: Column, kind: str) -> Column:
    """Proposals of a wider pattern; true where a checked span of the kind in ``found`` overlaps them."""
    generator = _GENERATORS.index(("wider", kind))

    def candidate(s: Column) -> Column:
        true = F.exists("found", lambda b: b["base"] & (b["kind"] == kind) & (b["first"] < s["past"]) & (s["first"] < b["past"]))
        return _candidate(kind, s, F.lit(False), true, _cell(generator, s))

    return F.when(text.rlike(_HINTS[kind]), F.transform(spans(text, WIDER[kind]), candidate)).otherwise(_none(_CANDIDATE))


def _unpacked(cell: int) -> tuple[int, ...]:
    bins = []
    for n in reversed(BINS):
        bins.append(cell % n)
        cell //= n
    return tuple(reversed(bins))


def _tree(rows: list[tuple], depth: int) -> Callable[[tuple[int, ...]], float]:
    """Least-squares tree of Newton steps; rows are (bins, gradient, curvature)."""
    g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
    best = None
    if depth:
        for f, n in enumerate(BINS):
            for at in range(1, n):
                lg = sum(r[1] for r in rows if r[0][f] < at)
                lh = sum(r[2] for r in rows if r[0][f] < at)
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, at)
    if best is None:
        return lambda bins, leaf=g / (h + 1): leaf
    _, f, at = best
    low, high = _tree([r for r in rows if r[0][f] < at], depth - 1), _tree([r for r in rows if r[0][f] >= at], depth - 1)
    return lambda bins: low(bins) if bins[f] < at else high(bins)


def boosted_scores(cells: dict[int, tuple[int, int]]) -> dict[int, float]:
    """Cell -> (candidates, true ones) to cell -> score from gradient-boosted trees under logistic loss."""
    bins = {c: _unpacked(c) for c in cells}
    margin = dict.fromkeys(cells, 0.0)
    for _ in range(ROUNDS):
        rows = []
        for c, (n, y) in sorted(cells.items()):
            p = 1 / (1 + math.exp(-margin[c]))
            rows.append((bins[c], y - n * p, n * p * (1 - p)))
        tree = _tree(rows, DEPTH)
        for c in margin:
            margin[c] += RATE * max(-4.0, min(4.0, tree(bins[c])))
    return {c: 1 / (1 + math.exp(-m)) for c, m in margin.items()}


def chosen_cells(cells: dict[int, tuple[int, int]], precision: float = PRECISION, support: int = SUPPORT) -> list[int]:
    """Cells above their kind's threshold: the lowest score at which ``precision`` of the candidates are true."""
    scores = boosted_scores(cells)
    chosen = []
    for kind in KINDS:
        own = [c for c in cells if _GENERATORS[_unpacked(c)[0]][1] == kind]
        threshold, n, y = None, 0, 0
        for score in sorted({scores[c] for c in own}, reverse=True):
            n += sum(cells[c][0] for c in own if scores[c] == score)
            y += sum(cells[c][1] for c in own if scores[c] == score)
            if n >= support and y >= precision * n:
                threshold = score
        chosen += [c for c in own if threshold is not None and scores[c] >= threshold]
    return sorted(chosen)


def _text(found: Column) -> Column:
    order = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    sorted_ = F.array_sort(F.transform(found, lambda x: F.struct(order[x["kind"]].alias("o"), x["first"], x["past"], x["kind"])))
    return F.array_join(F.transform(sorted_, lambda x: F.concat_ws(":", x["kind"], x["first"], x["past"])), ",")


def personal_data(docs: DataFrame, precision: float = PRECISION, support: int = SUPPORT) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``.

    Counts and hash are of the base spans; ``spans`` also has those the model adds, none of which overlaps a
    base span or an added span of a kind listed earlier. NULL and empty texts have no spans.
    """
    found = cut_lineage(candidates(docs), "candidates")
    counted = (
        found.select(F.explode("found").alias("c"))
        .groupBy("c.cell")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c.truth").cast("int")).alias("y"))
        .collect()  # at most one row per combination of bins
    )
    chosen = chosen_cells({r["cell"]: (r["n"], r["y"]) for r in counted}, precision, support)
    added = F.filter("found", lambda c: ~c["base"] & c["cell"].isin(chosen)) if chosen else _none(_CANDIDATE)

    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    rows = found.select("doc_id", F.filter("found", lambda c: c["base"]).alias("base"), added.alias("added"))
    rows = rows.withColumn(
        "added",
        F.filter("added", lambda c: ~F.exists("base", lambda o: (o["first"] < c["past"]) & (c["first"] < o["past"]))),
    )
    rows = rows.withColumn(
        "added",
        F.filter(
            "added",
            lambda c: ~F.exists(
                "added", lambda o: (o["first"] < c["past"]) & (c["first"] < o["past"]) & (place[o["kind"]] < place[c["kind"]])
            ),
        ),
    )
    return rows.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.concat("base", "added")).alias("spans"),
    )
