"""A graph as a folder of Parquet tables, the working format of the library.

Rebuild the tables from triples once, store them, and search the stored form:
statements are then a plain scan with column pruning, pushed filters and a size
the planner knows.
"""

from __future__ import annotations

from dataclasses import fields

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from occurra.model import Graph
from occurra.operators.occurrences import Occurrences
from occurra.operators.pairs import PairIndex, write_pairs
from occurra.operators.similarity import n_words, pack
from occurra.operators.skew import DEFAULT_POLICY, HeavyKeys, SkewPolicy, heavy_keys
from occurra.operators.structures import FingerprintIndex, write_index
from occurra.operators.taxonomy import CladeIndex, write_clades

PROFILE = "column string, key string, salts long"
TABLES = tuple(f.name for f in fields(Graph))


def write_graph(graph: Graph, folder: str, policy: SkewPolicy = DEFAULT_POLICY, n_bits: int = 64) -> None:
    """Tables of a graph, and the skew profile of its statements, taken once for all searches.

    Fingerprints are stored with their bits packed into words and sorted by size, so a
    similarity search packs nothing and skips row groups of other sizes; beside them lie an index by bit, the occurrences by (compound, taxon) and,
    unless the taxonomy is too deep for it, the lineages by ancestor.
    """
    for name in TABLES:
        table = getattr(graph, name)
        if name == "fingerprints":
            words = [pack(F.col("bits"), i).alias(f"w{i}") for i in range(n_words(n_bits))]
            table = table.select("c", "bits", *words, F.size("bits").alias("size")).sortWithinPartitions("size")
        table.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark = graph.statements.sparkSession
    write_index(spark.read.parquet(f"{folder}/fingerprints"), f"{folder}/structures", n_bits)
    write_pairs(spark.read.parquet(f"{folder}/statements"), f"{folder}/pairs")
    lineages = write_clades(spark.read.parquet(f"{folder}/taxon_parent"), f"{folder}/clades")
    spark.createDataFrame([(n_bits, lineages)], "n_bits int, lineages boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/settings")
    heavy = heavy_keys(spark.read.parquet(f"{folder}/statements"), ["c", "t", "r"], policy)
    rows = [(column, key, salts) for column, keys in heavy.salts.items() for key, salts in keys.items()]
    spark.createDataFrame(rows, PROFILE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/heavy_keys")


def read_occurrences(spark: SparkSession, folder: str, policy: SkewPolicy = DEFAULT_POLICY) -> Occurrences:
    """A stored graph with its stored profile and index: searches do not scan the statements or fingerprints for them."""
    salts: dict[str, dict[str, int]] = {}
    for r in spark.read.schema(PROFILE).parquet(f"{folder}/heavy_keys").collect():  # a bounded list by its making
        salts.setdefault(r["column"], {})[r["key"]] = r["salts"]
    stored = spark.read.parquet(f"{folder}/settings").first()
    structures = FingerprintIndex(spark, f"{folder}/structures", stored["n_bits"])
    clades = CladeIndex(spark, f"{folder}/clades") if stored["lineages"] else None
    return Occurrences(read_graph(spark, folder), policy, HeavyKeys(salts), structures, clades, PairIndex(spark, f"{folder}/pairs"))


def read_graph(spark: SparkSession, folder: str) -> Graph:
    return Graph(**{name: spark.read.parquet(f"{folder}/{name}") for name in TABLES})
