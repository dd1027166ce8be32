import pandas as pd
import pytest
from pyspark.sql import functions as F

from occurra.operators import curation as cu
from occurra.operators.merging import append_unique, merge_passes
from occurra.plans import curate as plan
from occurra.sinks.files import write_statements
from occurra.sources import star
from occurra.streaming.intake import candidate_stream, intake_stream, read_log, read_queue

ROW = "seq long, name string, smiles string, taxon string, doi string"
RESULT = "seq long, key string, dependency_blocks array<string>, statements array<string>"


def test_append_unique(table):
    queue = table([(0, "A", "CCO", "Taxon", "10.1/ABC")], ROW)
    new = table(
        [
            (1, "A2", " CCO", " taxon ", "https://doi.org/10.1/abc"),
            (2, "B", "CCN", None, None),
            (3, "B2", "CCN", None, None),
        ],
        ROW,
    )
    added, counts = append_unique(queue, new)
    assert [r["name"] for r in added.collect()] == ["B"]
    assert tuple(counts.first()) == (1, 2)
    again, counts = append_unique(queue.unionByName(added.drop("key")), new)
    assert again.count() == 0 and tuple(counts.first()) == (0, 3)


def test_bundle(table, tmp_path, spark):
    results = table(
        [(1, "a", ["D1", "D1", " "], ["1A", "1B"]), (2, "b", ["D1", "D2"], ["2"]), (3, "c", [], [])], RESULT
    )
    sections = cu.bundle(results).orderBy("section", "seq", "pos").collect()
    text = {s: "\n\n".join(r["text"] for r in sections if r["section"] == s) for s in ("dependencies", "main")}
    assert text == {"dependencies": "D1\n\nD2", "main": "1A\n1B\n\n2"}
    write_statements(cu.bundle(results), str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "1A\n1B\n\n2\n\n"


def test_merge_replaces_the_first_row_with_the_last_update(table):
    schema = "seq long, key string, name string, dependency_blocks array<string>"
    previous = table([(1, "A", "a", ["D"]), (2, "B", "b", None), (3, "A", "a again", ["D"])], schema)
    updated = table([(10, "A", "old", []), (11, "A", None, []), (12, "C", "c", [])], schema)
    rows = merge_passes(previous, updated).orderBy("seq").collect()
    assert [(r["seq"], r["key"], r["name"], r["dependency_blocks"]) for r in rows] == [
        (1, "A", None, []),
        (2, "B", "b", None),
        (3, "A", "a again", ["D"]),
    ]


@pytest.fixture(scope="module")
def graph(spark):
    return star.graph(spark, "/root/testdata/sf0.001")


def converted(spark, *rows):
    return spark.createDataFrame(rows, plan.CONVERTED)


def row(seq, inchikey, taxon=None, doi=None, **over):
    values = dict(
        seq=seq, name=f'n"{seq}', smiles=f"C{seq}", taxon=taxon, doi=doi, canonical_smiles=f"C{seq}",
        isomeric_smiles=f"C{seq}", inchi="InChI=1S/C2H6/c1", inchikey=inchikey, exact_mass=30.5, mass_warning=None,
        undefined_stereo=False, conversion_error=None, reference_lines=None,
    )
    values.update(over)
    return tuple(values[c] for c in plan.INPUT_COLUMNS)


def test_statuses(spark, graph):
    known = graph.compound_ids.filter("c = 'Q1000011'").first()  # without a mass
    pair = graph.statements.filter("c = 'Q1000011'").join(graph.taxon_names, "t").join(graph.instance_of, "t").first()
    rows = converted(
        spark,
        row(1, known["inchikey"]),
        row(2, known["inchikey"], taxon=pair["name"]),
        row(3, "NEW-KEY", taxon=pair["name"], undefined_stereo=True),
        row(4, "NEW-KEY", taxon="Ficticia imaginaria", doi="10.9/none", reference_lines="REF"),
        row(5, "BAD", conversion_error="no structure"),
        row(6, "NEW-KEY", doi="10.9/none", isomeric_smiles="C[C@H]N"),
        row(1, known["inchikey"], name="repeated"),
    )
    out = {r["seq"]: r for r in plan.curate(rows, graph).results.collect()}
    assert len(out) == 6
    assert out[1]["status"] == "existing_updates" and out[1]["compound_qid"] == "Q1000011"
    assert "Q1000011|P2067|+30.500000U483261" in out[1]["statements"]
    assert not any("P703" in s for s in out[2]["statements"])
    assert out[3]["status"] == "new_compound" and f"LAST|P31|{cu.STEREOISOMER_GROUP}" in out[3]["statements"]
    assert out[3]["statements"][:2] == ["CREATE", 'LAST|Len|"n\\"3"']
    assert out[3]["statements"][-1] == f"LAST|P703|{pair['t']}"
    assert out[4]["status"] == "pending_dependencies" and len(out[4]["dependency_blocks"]) == 2
    assert out[4]["dependency_blocks"][0].startswith("## -- Step: create missing taxon --\nCREATE\nLAST|Len|")
    assert out[4]["dependency_blocks"][1] == "REF" and out[4]["statements"][-1] == "LAST|P703|[NEW_TAXON_QID]"
    assert (out[5]["status"], out[5]["note"], out[5]["statements"]) == ("error", "no structure", [])
    assert out[6]["status"] == "new_compound" and out[6]["dependency_blocks"] == []
    assert 'LAST|P2017|"C[C@H]N"' in out[6]["statements"] and 'LAST|P274|"C₂H₆"' in out[6]["statements"]
    assert not any("P703" in s for s in out[6]["statements"])


def test_second_pass_without_changes_is_identity(spark, graph):
    # one spelling per taxon key: another batch may look up another first spelling
    one_spelling = "seq < 200 AND (taxon IS NULL OR taxon NOT LIKE 'nation%')"
    rows = star.view(spark, "/root/testdata/sf0.001", "converted").filter(one_spelling)
    first = plan.curate(rows, graph)
    again = plan.second_pass(first.results, rows, graph)
    columns = first.results.columns
    before = sorted(map(str, first.results.select(*columns).collect()))
    assert before == sorted(map(str, again.results.select(*columns).collect()))
    assert plan.awaiting_second_pass(again)


def test_forced_salting_changes_nothing(spark, graph):
    from occurra.operators.skew import SkewPolicy

    rows = star.view(spark, "/root/testdata/sf0.001", "converted")
    hot = rows.withColumn("taxon", F.when(F.col("seq") % 3 == 0, " NATION_3 ").otherwise(F.col("taxon")))
    plain = plan.curate(hot, graph).results
    salted = plan.curate(hot, graph, policy=SkewPolicy(min_bytes=0, rows_per_salt=20, share=1 / 20)).results
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_converter(spark, graph):
    def convert(batches):
        for batch in batches:
            out = batch[["seq", "name", "smiles", "taxon", "doi"]].copy()
            out["canonical_smiles"] = out["isomeric_smiles"] = out["smiles"].str.strip()
            out["inchi"], out["inchikey"] = "InChI=1S/CH4/c1", "KEY-" + out["smiles"]
            out["exact_mass"], out["mass_warning"] = pd.NA, "no mass"
            out["undefined_stereo"], out["conversion_error"], out["reference_lines"] = False, None, None
            yield out.astype({"exact_mass": "Float64"})

    rows = spark.createDataFrame([(1, "A", "C", None, None), (2, "B", "C", None, None)], ROW)
    out = plan.curate(rows, graph, converter=convert).results.collect()
    assert [(r["seq"], r["status"], r["mass_warning"]) for r in out] == [(1, "new_compound", "no mass")]


def test_intake_stream(spark, tmp_path):
    folder, queue, checkpoint = tmp_path / "in", str(tmp_path / "queue"), str(tmp_path / "check")

    def land(number, rows):
        spark.createDataFrame(rows, ROW).coalesce(1).write.json(str(tmp_path / f"w{number}"))
        folder.mkdir(exist_ok=True)
        for part in (tmp_path / f"w{number}").glob("*.json"):
            (folder / f"{number}-{part.name}").write_text(part.read_text())

    def run():
        intake_stream(candidate_stream(spark, str(folder)), queue, checkpoint, once=True).awaitTermination()
        return sorted(r["name"] for r in read_queue(spark, queue).collect())

    land(1, [(1, "A", "CCO", None, None), (2, "A2", "CCO ", None, None)])
    assert run() == ["A"]
    land(2, [(3, "A3", " CCO", None, None), (4, "B", "CCN", "T", None)])
    assert run() == ["A", "B"]
    assert run() == ["A", "B"]
    assert sorted((r["added"], r["skipped"]) for r in read_log(spark, queue).collect()) == [(1, 1), (1, 1)]


def test_a_small_batch_reads_few_buckets(spark, graph, tmp_path):
    from occurra.operators.pairs import FEWEST_BUCKETS, PairIndex, bucket_of, write_pairs

    write_pairs(graph.statements, str(tmp_path / "pairs"))
    index = PairIndex(spark, str(tmp_path / "pairs"))
    assert index.buckets == FEWEST_BUCKETS
    some = graph.statements.select("c", "t").distinct().orderBy("c", "t").limit(7).collect()
    batch = spark.createDataFrame([tuple(r) for r in some] + [("Q1", "Q2"), ("Q3", None), (None, "Q4")], "c string, t string")
    found = cu.known_occurrences(batch, index)
    want = cu.known_occurrences(batch, graph.statements)
    assert sorted(found.collect()) == sorted(want.collect()) and found.count() >= 7
    plan_text = found._jdf.queryExecution().executedPlan().toString()
    asked = {r[0] for r in batch.filter("c IS NOT NULL AND t IS NOT NULL").select(bucket_of(index.buckets)).collect()}
    pruned = plan_text.split("PartitionFilters: [")[1].split("]")[0]
    assert all(str(b) in pruned for b in asked) and len(asked) <= 8
    files = {f.split("bucket=")[1].split("/")[0] for f in index.triples.filter(F.col("bucket").isin(sorted(asked))).inputFiles()}
    assert len(files) == FEWEST_BUCKETS  # of the table
    read = index.triples.filter(F.col("bucket").isin(sorted(asked))).select(F.input_file_name().alias("f")).distinct().collect()
    assert {r["f"].split("bucket=")[1].split("/")[0] for r in read} <= {str(b) for b in asked}


def test_curation_through_the_layout_by_pair(spark, graph, tmp_path):
    from occurra.operators.occurrences import Occurrences
    from occurra.operators.pairs import PairIndex, write_pairs

    write_pairs(graph.statements, str(tmp_path / "pairs"))
    stored = Occurrences(graph, pairs=PairIndex(spark, str(tmp_path / "pairs")))
    rows = star.view(spark, "/root/testdata/sf0.001", "converted")
    want = sorted(map(str, plan.curate(rows, graph).results.collect()))
    assert sorted(map(str, plan.curate(rows, stored).results.collect())) == want


def test_the_delta_equals_a_second_look_at_everything(spark, graph):
    """Taxa, references, compounds, properties and statements added between the passes."""
    from dataclasses import replace

    # one spelling a taxon: which one is tried first depends on the rows looked up together
    rows = star.view(spark, "/root/testdata/sf0.001", "converted").withColumn("taxon", F.initcap(F.btrim("taxon")))
    rows = rows.withColumn("taxon", F.when(F.col("taxon").startswith("Nation"), F.upper("taxon")).otherwise(F.col("taxon")))
    before = replace(
        graph,
        taxon_names=graph.taxon_names.filter("t NOT LIKE '%3'"),
        instance_of=graph.instance_of.filter("t NOT LIKE '%5'"),
        ref_doi=graph.ref_doi.filter("r NOT LIKE '%8'"),
        compound_ids=graph.compound_ids.filter("c NOT LIKE '%1'"),
        mass=graph.mass.filter("c NOT LIKE '%4'"),
        inchi=graph.inchi.filter("c NOT LIKE '%3'"),
        statements=graph.statements.filter("statement NOT LIKE '%2'"),
    )
    # a pair of the graph that the second pass completes or finds added
    first = plan.curate(rows, before)
    assert first.results.filter(F.size("dependency_blocks") > 0).count() > 50
    whole = plan.second_pass(first.results, rows, graph).results
    added = plan.added_since(before, graph)
    delta = plan.second_pass_added(first, graph, added).results
    assert sorted(map(str, delta.select(*whole.columns).collect())) == sorted(map(str, whole.collect()))
    changed = delta.join(first.results.select("seq", F.col("dependency_blocks").alias("old")), "seq").filter("dependency_blocks <> old")
    assert changed.count() > 5
    # nothing added: nothing changes
    nothing = plan.second_pass_added(first, before, plan.added_since(before, before)).results
    assert sorted(map(str, nothing.collect())) == sorted(map(str, first.results.collect()))
