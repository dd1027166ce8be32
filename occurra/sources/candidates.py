"""Curation candidates from TSV text and JSON arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occurra.functions import text as tx


class MissingColumn(ValueError):
    """A mandatory column is not in the header."""


def _header_name(raw: str) -> str:
    return raw.strip(tx.WHITESPACE).lower().replace(" ", "_")


def shape_candidates(df: DataFrame) -> DataFrame:
    """Text columns to candidate columns; rows without name or structure are dropped.

    Columns other than the four of a candidate (a ``seq``, say) pass through.
    """
    names: dict[str, str] = {}
    for column in df.columns:
        names.setdefault(_header_name(column), column)
    for required in ("name", "smiles"):
        if required not in names:
            raise MissingColumn(f"the header has no '{required}' column")
    taxon = next((c for c in df.columns if _header_name(c) in ("taxon", "organism")), None)
    used = {names["name"], names["smiles"], taxon, names.get("doi")}
    absent = F.lit(None).cast("string")

    def text(column: str | None):
        return F.col(f"`{column}`").cast("string") if column else absent

    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in used],
        tx.clean(text(names["name"])).alias("name"),
        tx.clean(text(names["smiles"])).alias("smiles"),
        tx.clean(text(taxon)).alias("taxon"),
        tx.doi_key(text(names.get("doi"))).alias("doi"),
    ).filter(F.col("name").isNotNull() & F.col("smiles").isNotNull())


#: Bits of a ``seq`` that count within a split of a file, or within a document.
SEQ_BITS = 33


def read_curation_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated candidates; quotes are ordinary characters.

    ``seq`` grows in the order of the rows in a file, and of the files by name: the
    number of the split, then the row within it. Only splits are numbered
    together. A ``seq`` column of the file itself is used instead.
    """
    raw = spark.read.csv(
        path,
        sep="\t",
        header=True,
        inferSchema=False,
        quote="",
        mode="PERMISSIVE",
        ignoreLeadingWhiteSpace=True,
        ignoreTrailingWhiteSpace=True,
    )
    if any(_header_name(c) == "seq" for c in raw.columns):
        return shape_candidates(raw)
    within = F.monotonically_increasing_id().bitwiseAND((1 << SEQ_BITS) - 1)
    placed = raw.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), within.alias("_within")
    )
    splits = placed.select("_file", "_start").distinct()
    number = F.row_number().over(Window.orderBy("_file", "_start")).cast("bigint")
    numbered = placed.join(splits.withColumn("_split", number), ["_file", "_start"])
    seq = F.shiftleft("_split", SEQ_BITS) + F.col("_within")
    return shape_candidates(numbered.select(*[F.col(f"`{c}`") for c in raw.columns], seq.alias("seq")))


def sequence(rows: DataFrame, document: str = "seq", pos: str = "pos") -> DataFrame:
    """One ``seq`` out of the number of a document (below 2**30) and the place in its array, for A8 into K6."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in (document, pos, "seq")]
    return rows.select((F.shiftleft(F.col(document).cast("bigint"), SEQ_BITS) + F.col(pos)).alias("seq"), *kept)


_ROWS = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("name", "smiles", "taxon", "doi")]
    )
)


def read_curation_json(df: DataFrame, json_col: str) -> DataFrame:
    """Candidates of a JSON array column.

    A text that does not parse, or holds an element without name or structure,
    gives no rows at all.
    """
    kept = [F.col(c) for c in df.columns if c != json_col]
    rows = df.select(*kept, F.from_json(F.col(json_col), _ROWS).alias("rows"))
    usable = F.forall("rows", lambda x: x["name"].isNotNull() & x["smiles"].isNotNull())
    return (
        rows.filter(usable)
        .select(*kept, F.posexplode("rows").alias("pos", "row"))
        .select(*kept, "pos", "row.name", "row.smiles", "row.taxon", "row.doi")
    )
