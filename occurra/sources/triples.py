"""Graph tables out of a triple table and back.

Keep the triple table as Parquet partitioned by ``p``: every property table is
then a partition-pruned scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occurra.functions import text as tx
from occurra.model import TAXON_CLASS, Graph
from occurra.operators.skew import DEFAULT_POLICY, SkewPolicy, attach, heavy_keys

# Predicate names.
INCHIKEY, SMILES_CONN, SMILES_ISO = "wdt:P235", "wdt:P233", "wdt:P2017"
MASS, FORMULA, INCHI, LABEL = "wdt:P2067", "wdt:P274", "wdt:P234", "rdfs:label"
FOUND_IN, FOUND_IN_VALUE = "p:P703", "ps:P703"
DERIVED_FROM, STATED_IN = "prov:wasDerivedFrom", "pr:P248"
TAXON_NAME, PARENT_TAXON, INSTANCE_OF = "wdt:P225", "wdt:P171", "wdt:P31"
TITLE, DOI, DATE = "wdt:P1476", "wdt:P356", "wdt:P577"

#: Statements of a task that forms their triples.
STATEMENTS_PER_TASK = 200_000
#: Setting for the files that a task writes at a time, above which it sorts its rows.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


def scan(triples: DataFrame, predicate: str, subject: str = "s", value: str = "o") -> DataFrame:
    """B1: one predicate as a two-column table."""
    return triples.filter(F.col("p") == predicate).select(
        F.col("s").alias(subject), F.col("o").alias(value)
    )


def graph_tables(
    triples: DataFrame, fingerprints: DataFrame | None = None, policy: SkewPolicy = DEFAULT_POLICY
) -> Graph:
    """A1: property tables plus the rebuilt occurrence statements.

    Statement nodes are unique on both sides of the first two joins. A
    reference node can be shared by very many statements, so the last join
    splits the heavy ones.
    """
    spark = triples.sparkSession
    derived = scan(triples, DERIVED_FROM, "statement", "ref")
    facts = (
        scan(triples, FOUND_IN, "c", "statement")
        .join(scan(triples, FOUND_IN_VALUE, "statement", "t"), "statement")
        .join(derived, "statement")
    )
    heavy = heavy_keys(derived, ["ref"], policy).of("ref")
    stated = scan(triples, STATED_IN, "ref", "r")
    statements = attach(facts, [(stated, "inner")], "ref", heavy, F.col("statement")).select(
        "statement", "c", "t", "ref", "r"
    )
    ids = scan(triples, INCHIKEY, "c", "inchikey").join(scan(triples, SMILES_CONN, "c", "smiles_conn"), "c")
    return Graph(
        compound_ids=ids,
        statements=statements,
        taxon_names=scan(triples, TAXON_NAME, "t", "name"),
        taxon_parent=scan(triples, PARENT_TAXON, "child", "parent"),
        instance_of=scan(triples, INSTANCE_OF, "t", "class").filter(F.col("class") == TAXON_CLASS).select("t"),
        smiles_iso=scan(triples, SMILES_ISO, "c", "v"),
        mass=scan(triples, MASS, "c", "v").select("c", tx.parse_number(F.col("v")).alias("v")),
        formula_raw=scan(triples, FORMULA, "c", "v"),
        inchi=scan(triples, INCHI, "c", "v"),
        labels=triples.filter(F.col("p") == LABEL).select(
            F.col("s").alias("c"), F.col("o").alias("v"), "lang"
        ),
        ref_title=scan(triples, TITLE, "r", "v"),
        ref_doi=scan(triples, DOI, "r", "v"),
        ref_date=scan(triples, DATE, "r", "v").select("r", F.col("v").try_cast("timestamp_ntz").alias("v")),
        fingerprints=fingerprints
        if fingerprints is not None
        else spark.createDataFrame([], "c string, bits array<int>"),
    )


def graph_triples(graph: Graph) -> DataFrame:
    """The inverse of ``graph_tables``: ``(s, p, o, lang)`` rows as a set.

    Every predicate is a set of its own, so that a task holds the rows of one predicate. For the three that name a
    statement, its ids are shuffled once.
    """
    no_lang = F.lit(None).cast("string").alias("lang")

    def rows(df: DataFrame, subject: str, predicate: str, value: str, lang=None) -> DataFrame:
        terms = [F.col(subject).alias("s"), F.col(value).cast("string").alias("o"), *([F.col(lang).alias("lang")] if lang else [])]
        found = df.select(*terms).filter(F.col("o").isNotNull()).distinct()
        return found.select("s", F.lit(predicate).alias("p"), "o", "lang" if lang else no_lang)

    g = graph
    # nearly all statements are distinct, which no task needs to find out before the shuffle
    tasks = max(-(-g.statements.count() // STATEMENTS_PER_TASK), g.statements.sparkSession.sparkContext.defaultParallelism)
    ids = F.array(*[F.col(c).cast("string") for c in ("c", "t", "ref")])
    # one column, of which no predicate can leave out a part, so that all three read the same shuffle
    placed = g.statements.select(F.col("statement").cast("string").alias("statement"), ids.alias("ids")).repartition(tasks, "statement")

    def of_statement(place: int, predicate: str) -> DataFrame:
        s, o = ("id", "statement") if predicate == FOUND_IN else ("statement", "id")
        # a row without an object counts as none; a filter on the ids would be moved before the shuffle and make it another one
        found = placed.select("statement", F.get("ids", F.lit(place)).alias("id")).groupBy("statement", "id").agg(F.count(o).alias("n"))
        found = found.filter("n > 0").sortWithinPartitions("statement")
        return found.select(F.col(s).alias("s"), F.lit(predicate).alias("p"), F.col(o).alias("o"), no_lang)

    parts = [
        rows(g.compound_ids, "c", INCHIKEY, "inchikey"),
        rows(g.compound_ids, "c", SMILES_CONN, "smiles_conn"),
        *[of_statement(place, predicate) for place, predicate in enumerate((FOUND_IN, FOUND_IN_VALUE, DERIVED_FROM))],
        rows(g.statements, "ref", STATED_IN, "r"),
        rows(g.taxon_names, "t", TAXON_NAME, "name"),
        rows(g.taxon_parent, "child", PARENT_TAXON, "parent"),
        rows(g.instance_of.withColumn("class", F.lit(TAXON_CLASS)), "t", INSTANCE_OF, "class"),
        rows(g.smiles_iso, "c", SMILES_ISO, "v"),
        rows(g.mass, "c", MASS, "v"),
        rows(g.formula_raw, "c", FORMULA, "v"),
        rows(g.inchi, "c", INCHI, "v"),
        rows(g.labels, "c", LABEL, "v", "lang"),
        rows(g.ref_title, "r", TITLE, "v"),
        rows(g.ref_doi, "r", DOI, "v"),
        rows(g.ref_date, "r", DATE, "v"),
    ]
    return reduce(DataFrame.unionByName, parts)


def write_triples(triples: DataFrame, path: str, by_predicate: bool = False) -> None:
    """Parquet partitioned by predicate.

    Rows are rebalanced by predicate: small predicates end up in few files, and a
    predicate or subject with a third of the graph is split at run time. ``by_predicate``
    says that no task holds rows of two predicates, as ``graph_triples`` gives them; they are then written as they are,
    without a sort by predicate.
    """
    if not by_predicate:
        triples.hint("rebalance", "p").sortWithinPartitions("p").write.mode("overwrite").partitionBy("p").parquet(path)
        return
    conf = triples.sparkSession.conf
    before = conf.get(OPEN_FILES)
    conf.set(OPEN_FILES, "16")
    try:
        triples.write.mode("overwrite").partitionBy("p").parquet(path, compression="zstd")
    finally:
        conf.set(OPEN_FILES, before)
