"""Secret scans over a ledger of content-addressed blobs.

Every version of a text is a blob named by its SHA-256. The ledger says which rules, in which version,
have been run on which blob and what they found. A scan works off the pairs of blob and rule version that
the ledger lacks, one text per blob, and findings are joined back to all paths with that content.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occurra.llm.common import as_bytes, ascii_lower, of_kind, records, small_batches, split_by_keys
from occurra.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """``least`` characters in group ``group`` of a match of ``pattern``, else the match is dropped.

    ``hints``: lower-case byte strings of which a text with a match has one, to skip other texts.
    """

    name: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[bytes, ...] = ()
    ignore_case: bool = False

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


# fixed values: the base rules, in the order of their spans
BASE_RULES = (
    Rule(
        "assign", 1,
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2, 6, (b"passw", b"secret", b"token", b"api"), True,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, (b"akia",)),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
# fixed values: public formats of issued keys
FORMAT_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0, (b"private key-----",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, (b"gh",)),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, (b"xox",)),
    Rule("google", 1, r"AIza[A-Za-z0-9_-]{35}", 0, 0, (b"aiza",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, (b"eyj",)),
)
RULES = BASE_RULES + FORMAT_RULES

LEDGER_SCHEMA = "blob binary, rules array<string>, found array<struct<rule: string, first: long, past: long>>"


def spans(text: str, rules: Iterable[Rule]) -> list[tuple[str, int, int]]:
    """(rule key, start, end) in code points; leftmost matches of each rule without overlap."""
    found = []
    lower = ascii_lower(as_bytes(text))
    for rule in rules:
        if rule.hints and not any(h in lower for h in rule.hints):
            continue
        for m in re.compile(rule.pattern, re.A | (re.I if rule.ignore_case else 0)).finditer(text):
            if len(m[rule.group]) >= rule.least:
                found.append((rule.key, m.start(), m.end()))
    return found


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), blob_of(F.col(f"`{text_col}`")).alias("blob"))


def scan(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """New ledger rows (``LEDGER_SCHEMA``): the blobs of ``docs`` by the rule versions ``ledger`` lacks.

    Only one text per blob with something left to scan is moved; append the rows to the ledger.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    todo = paths(docs, id_col, text_col).groupBy("blob").agg(F.min("doc_id").alias("keeper"))
    if ledger is None:
        todo = todo.withColumn("todo", keys)
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
        todo = (
            todo.join(seen, "blob", "left")
            .select("blob", "keeper", F.array_except(keys, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
            .filter(F.size("todo") > 0)
        )
    texts = small_batches(docs).select(
        F.col(f"`{id_col}`").alias("id"),
        blob_of(F.col(f"`{text_col}`")).alias("of"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    by_key = {r.key: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("rule", pa.string()), ("first", pa.int64()), ("past", pa.int64())]))
        for batch in records(batches, 1000):
            found = [
                [{"rule": r, "first": s, "past": e} for r, s, e in spans(text, [by_key[k] for k in keys])]
                for text, keys in zip(batch["text"].to_pylist(), batch["todo"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["blob"], batch["todo"], pa.array(found, kind)], names=["blob", "rules", "found"])

    # the list of blobs is the build side, so that texts are not sorted
    unseen = texts.join(
        todo.hint("shuffle_hash"), (F.col("of") == F.col("blob")) & F.col("id").eqNullSafe(F.col("keeper"))
    ).select("blob", "todo", "text")
    return unseen.mapInArrow(run, LEDGER_SCHEMA).dropDuplicates(["blob"])


def findings(ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, found`` of the given rule versions, for blobs with a finding; whatever runs found them."""
    keys = [r.key for r in rules]
    return (
        ledger.filter(F.size("found") > 0)
        .groupBy("blob")
        .agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        .withColumn("found", F.filter("found", lambda x: x["rule"].isin(keys)))
        .filter(F.size("found") > 0)
    )


def _ordered(found: Column, rules: tuple[Rule, ...]) -> Column:
    """Structs (first, place, kind, past) by start, then by the order of the rules."""
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    kind = F.create_map(*[x for r in rules for x in (F.lit(r.key), F.lit(r.name))])
    return F.array_sort(
        F.transform(
            found,
            lambda x: F.struct(
                x["first"].alias("first"), place[x["rule"]].alias("place"), kind[x["rule"]].alias("kind"), x["past"].alias("past")
            ),
        )
    )


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["first"], x["past"])), ",")


def secrets_by_path(docs: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, a count per base kind, ``base_sha256``, ``spans``.

    A text without findings, NULL and empty ones included, has counts of 0 and empty spans.
    """
    base = [r.name for r in BASE_RULES]
    none = F.array().cast("array<struct<first: long, place: int, kind: string, past: long>>")
    # stored, so that a content at very many paths can be split in the join
    found = cut_lineage(findings(ledger, rules).select("blob", _ordered(F.col("found"), rules).alias("found")), "findings")
    rows = paths(docs).join(found, "blob", "left").select("doc_id", F.coalesce("found", none).alias("found"))
    return rows.select(
        "doc_id",
        *[F.size(F.filter("found", of_kind(n))).cast("long").alias(f"n_{n}") for n in base],
        F.sha2(_joined(F.filter("found", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"),
    )


def secret_scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Scan what the ledger lacks and report on every path. The new rows are stored before they are used."""
    new = cut_lineage(scan(docs, ledger, rules), "ledger")
    return secrets_by_path(docs, new if ledger is None else ledger.unionByName(new), rules)


def redacted(
    docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, mask: str = "[secret]"
) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced by ``mask`` and ``n_chars`` following; all rows and columns stay."""
    new = cut_lineage(scan(docs, ledger, rules), "ledger")
    known = cut_lineage(findings(new if ledger is None else ledger.unionByName(new), rules), "findings")
    held = known.select(
        F.col("blob").alias("_blob"),
        F.array_sort(F.transform("found", lambda x: F.struct(x["first"].alias("first"), x["past"].alias("past")))).alias("_found"),
    )

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(text: str, parts: list[dict]) -> str:
            out, at = [], 0
            for p in parts:
                if p["first"] >= at:
                    out += [text[at : p["first"]], mask]
                at = max(at, p["past"])
            return "".join([*out, text[at:]])

        return pd.Series([t if f is None else one(t, f) for t, f in zip(texts, found, strict=True)], dtype=object)

    # texts whose content is in no finding are not moved
    some, others = split_by_keys(
        docs, F.xxhash64(blob_of(F.col("text"))), held.select(F.xxhash64("_blob").alias("id"))
    )
    joined = some.withColumn("_blob", blob_of(F.col("text"))).join(held, "_blob", "left")
    has = F.col("_found").isNotNull()
    columns = []
    for name in docs.columns:
        if name == "text":
            columns.append(F.when(has, F.col("_text")).otherwise(F.col("text")).alias("text"))
        elif name == "n_chars":
            columns.append(
                F.when(has, F.length("_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
            )
        else:
            columns.append(F.col(f"`{name}`"))
    return joined.withColumn("_text", cut(F.when(has, F.col("text")), F.col("_found"))).select(*columns).unionAll(others)


def merged(*ledgers: DataFrame) -> DataFrame:
    """Ledgers of several runs as one."""
    return reduce(DataFrame.unionByName, ledgers)
