"""Name, DOI and compound resolution against the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from occurra.functions import text as tx
from occurra.operators.skew import keep_first


def smallest_id(ids: Column) -> Column:
    """Aggregate: the id with the smallest number (the deterministic survivor)."""
    return F.min_by(ids, F.struct(F.length(ids), ids))


def find_taxa(names: DataFrame, taxon_names: DataFrame) -> DataFrame:
    """Taxa whose scientific name equals a sanitised input name.

    ``names`` is ``(name)``; the result ``(input, qid, name)`` has one row per hit.
    """
    wanted = names.select(F.col("name").alias("input")).distinct()
    wanted = wanted.withColumn("name", tx.sanitize_taxon(F.col("input")))
    return wanted.join(taxon_names.withColumnRenamed("t", "qid"), "name").select("input", "qid", "name")


def rank_matches(matches: DataFrame) -> DataFrame:
    """E1 and E2 per input name, out of ``(input, qid, name, pos)`` candidates.

    The first case-insensitive exact match wins, else the first candidate.
    Ambiguous: two or more exact matches, or none and several candidates. The
    first four candidates are listed. Candidates of one input are combined in
    bounded buffers: two counts, one best row and four smallest positions.
    """
    exact = F.lower("name") == F.lower("input")
    shown = F.format_string("%s (%s)", F.col("name"), F.col("qid"))
    # first four per input are cut out before the shuffle (window group limit)
    rank = F.row_number().over(Window.partitionBy("input").orderBy("pos", "qid"))
    first_four = (
        matches.select("input", "pos", "qid", shown.alias("shown"))
        .withColumn("rank", rank)
        .filter(F.col("rank") <= 4)
        .groupBy("input")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "shown"))).alias("four"))
    )
    picked = matches.groupBy("input").agg(
        F.min(F.struct((~exact).alias("other"), "pos", "qid", "name")).alias("best"),
        F.count(F.lit(1)).alias("n_matches"),
        F.count_if(exact).alias("n_exact"),
    )
    return picked.join(first_four, "input").select(
        "input",
        F.col("best.qid").alias("qid"),
        F.col("best.name").alias("name"),
        "n_matches",
        "n_exact",
        ((F.col("n_exact") >= 2) | ((F.col("n_exact") == 0) & (F.col("n_matches") >= 2))).alias("ambiguous"),
        F.transform("four", lambda x: x["shown"]).alias("candidates"),
    )


def best_match(matches: DataFrame) -> DataFrame:
    return rank_matches(matches).select("input", "qid", "name")


def match_warning(matches: DataFrame) -> DataFrame:
    ranked = rank_matches(matches)
    return ranked.filter("ambiguous").select(
        "input", F.col("qid").alias("chosen_qid"), F.col("name").alias("chosen_name"), "candidates"
    )


def taxa_only(taxon_names: DataFrame, instance_of: DataFrame) -> DataFrame:
    return taxon_names.join(instance_of.select("t"), "t", "left_semi")


def resolve_taxa(names: DataFrame, taxon_names: DataFrame, instance_of: DataFrame) -> DataFrame:
    """``(seq, taxon)`` to ``(key, t)``; the first spelling per key is looked up."""
    keyed = names.select("seq", tx.clean(F.col("taxon")).alias("name"), tx.taxon_key(F.col("taxon")).alias("key"))
    spellings = keep_first(keyed.filter(F.col("key").isNotNull()), ["key"], [F.col("seq").asc()])
    hits = spellings.select("key", "name").join(taxa_only(taxon_names, instance_of), "name")
    return hits.groupBy("key").agg(smallest_id(F.col("t")).alias("t"))


def resolve_taxa_fallback(names: DataFrame, taxon_names: DataFrame, instance_of: DataFrame) -> DataFrame:
    """Distinct names ``(taxon)`` to ``(name, t)``, as given first, then canonical."""
    given = tx.clean(F.col("taxon"))
    tried = (
        names.select(given.alias("given"))
        .filter(F.col("given").isNotNull())
        .distinct()
        .select("given", F.posexplode(F.array_distinct(F.array("given", tx.canonical_taxon(F.col("given"))))).alias("preference", "name"))
    )
    hits = tried.join(taxa_only(taxon_names, instance_of), "name")
    best = F.min_by("t", F.struct("preference", F.length("t"), "t"))
    return hits.groupBy(F.col("given").alias("name")).agg(best.alias("t"))


def resolve_references(dois: DataFrame, ref_doi: DataFrame) -> DataFrame:
    """``(doi)`` to ``(key, r)`` by upper-cased DOI."""
    keys = dois.select(tx.doi_key(F.col("doi")).alias("key")).filter(F.col("key").isNotNull()).distinct()
    stored = ref_doi.select("r", tx.doi_key(F.col("v")).alias("key"))
    return keys.join(stored, "key").groupBy("key").agg(smallest_id(F.col("r")).alias("r"))
