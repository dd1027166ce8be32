"""Language identification, substring dedup, licence scans, chat formatting, the registered queries and the pipeline."""

import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from occurra.llm import catalog, chat_format, language_id, license_scan, substring_dedup
from occurra.llm.common import split_by_keys


# ---- language identification ----


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in language_id.language_id(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert set(rows) == set(truth)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in rows.items())
    tested = [i for i, r in rows.items() if r.held_out]
    assert sum(rows[i].lang_pred == truth[i] for i in tested) >= 0.97 * len(tested)


def test_pieces_and_bounded_training(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = max((r.text for r in docs.collect()), key=len)
    whole = np.sort(np.concatenate(list(language_id.ngrams(text, 1024))))
    monkeypatch.setattr(language_id, "PIECE", 100)
    parts = np.sort(np.concatenate(list(language_id.ngrams(text, 1024))))
    assert abs(len(whole) - len(parts)) < 0.04 * len(whole)
    monkeypatch.setattr(language_id, "MOST_CELLS", 4096)
    model = language_id.train(docs, rows=100)
    assert model.log_prob.size <= 4096 and len(model.languages) == 4


def test_language_of_odd_rows(odd_documents):
    rows = language_id.language_id(odd_documents).collect()
    assert len(rows) == 9
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred in ("en", "de") for r in rows if r.doc_id in (4, 5, 6, 7, None))
    assert language_id.language_id(odd_documents.limit(0)).collect() == []
    assert not language_id.has_letter("12 ²½ #") and language_id.has_letter("1 ß")


def test_a_rare_language_is_learned_beside_a_very_frequent_one(spark, documents):
    rows = [(i, f"the house and the garden number {i} are there") for i in range(3000)]
    base = documents(rows).withColumn("lang", F.lit("en"))
    rare = documents([(10_000 + i, f"das haus und der garten nummer {i} sind schön") for i in range(12)]).withColumn("lang", F.lit("de"))
    # one text with a third of the rows is drawn row by row
    same = documents([(20_000 + i, "again and again the same words") for i in range(1500)]).withColumn("lang", F.lit("en"))
    docs = base.unionByName(rare).unionByName(same)
    model = language_id.train(docs, rows=100)
    assert model.languages == ("de", "en")
    share = np.exp(model.prior)
    assert 0.04 < share[0] < 0.25  # all 12 of about 100 + 12
    assert model.predict(["und das haus", "and the house"])[0] == ["de", "en"]



# ---- substring dedup ----


def gear_plain(data):
    marks = []
    gear = [int(x) for x in substring_dedup._GEAR]
    for i in range(len(data)):
        h = sum(gear[data[i - j]] << j for j in range(min(substring_dedup.REACH, i + 1))) & 0xFFFFFFFF
        if (h >> substring_dedup.REACH) & ((1 << substring_dedup.CUT_BITS) - 1) == 0:
            marks.append(i + 1)
    ends, last = [], 0
    for at in range(1, len(data) + 1):
        if at - last == substring_dedup.MOST or (at in set(marks) and at - last >= substring_dedup.LEAST):
            ends.append(at)
            last = at
    return ends + [len(data)] * (last < len(data))


@pytest.mark.parametrize("size", [1, 15, 16, 17, 300, 2000])
def test_boundaries_against_a_rolling_hash(size):
    data = bytes(random.Random(size).choices(b"abcdefgh \n", k=size))
    assert substring_dedup.boundaries(data).tolist() == gear_plain(data)
    assert substring_dedup.boundaries(b"a" * 1000).tolist()[-1] == 1000


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))


def test_repeated_passages_are_found_and_clean_texts_left_alone(documents):
    rng = random.Random(8)
    passages = [prose(rng, 55) for _ in range(6)]
    texts = []
    for i in range(60):
        body = prose(rng, rng.randint(5, 80))
        texts.append(f"{body} {passages[i % 6]} {prose(rng, 9)}" if i % 2 else body)
    rows = substring_dedup.repeated_passages(documents(texts)).collect()
    held = {i: [j for j in range(1, 60, 2) if j % 6 == i % 6] for i in range(1, 60, 2)}
    assert {r.doc_id for r in rows} == {i for i, group in held.items() if i != group[0]}
    for r in rows:
        assert r.owner_id in held[r.doc_id] and r.owner_id < r.doc_id
        assert texts[r.doc_id].encode()[r.first : r.past].strip() in passages[r.doc_id % 6].encode()
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(documents(texts)).collect()}
    assert all(cut[i] == texts[i] for i in range(0, 60, 2)) and cut[1] == texts[1]
    assert all(len(cut[i]) < len(texts[i]) for i, group in held.items() if i != group[0])


def short_words(rng, n, least, most):
    return " ".join("".join(rng.choices("0123456789abcdefghijklmnop", k=rng.randint(least, most))) for _ in range(n))


@pytest.mark.parametrize("least, most", [(1, 1), (1, 3), (2, 2), (3, 4)])
def test_no_passage_of_fifty_short_words_is_missed(documents, least, most):
    rng = random.Random(11)
    passages = [short_words(rng, 50, least, most) for _ in range(150)]
    texts = [f"{short_words(rng, 40, 2, 5)} {p} {short_words(rng, 40, 2, 5)}" for _ in range(2) for p in passages]
    found = {r.doc_id: r for r in substring_dedup.repeated_passages(documents(texts)).collect()}
    assert {i: r.owner_id for i, r in found.items()} == {150 + i: i for i in range(150)}
    for i, r in found.items():
        assert texts[i].encode()[r.first : r.past].decode() in texts[i - 150] and 25 <= r.n_words <= 52


def test_word_runs_of_long_and_even_texts():
    words = [b"%d" % (i * i % 977) for i in range(substring_dedup._BLOCK * 2 + 100)]
    firsts, hashes = substring_dedup.word_runs(b" ".join(words))
    assert np.diff(np.concatenate([[-1], firsts, [len(words) - 24]])).max() <= 26
    assert len(substring_dedup.word_runs(b"w " * 49)[0]) == 0 and len(substring_dedup.word_runs(b"w " * 50)[0]) == 1


def test_chunks_of_odd_rows(odd_documents):
    assert substring_dedup.repeated_passages(odd_documents).collect() == []
    assert substring_dedup.without_repeats(odd_documents).count() == 9
    assert substring_dedup.repeated_passages(odd_documents.limit(0)).collect() == []


# ---- licence scans ----


def dice_plain(index, lines):
    bag = license_scan.bigrams([w for line in lines for w in license_scan.words(line)])
    size = sum(bag.values())
    scores = [
        (2 * sum(min(n, bag[p]) for p, n in t.items()) / (size + s), -i) for i, (t, s) in enumerate(zip(index.bags, index.sizes, strict=True)) if size
    ]
    return max(scores, default=(0, 0))


def test_licence_lines_against_every_template(spark, sf_dir):
    index = license_scan.Templates()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = Counter((r.doc_id, r.license, r.first_line) for r in license_scan.license_scan(docs).collect())
    want = Counter()
    for r in docs.collect():
        for i, line in enumerate(r.text.split("\n")):
            score, number = dice_plain(index, [line])
            if score >= license_scan.THRESHOLD:
                want[r.doc_id, index.names[-number], i] += 1
    assert want and found == want


def test_wrapped_and_changed_notices():
    index = license_scan.Templates()
    mit = license_scan.TEMPLATES[2][1].split()
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    assert [(m[0], m[1]) for m in index.matches(f"intro\n\n{wrapped}\n\nmore text here")] == [("MIT", 2)]
    assert index.matches("licensed under the APACHE license -- version 2.0")[0][0] == "Apache-2.0"
    assert index.matches("the license was under the table") == [] and index.matches(None) == [] and index.matches("\n\n") == []


@pytest.mark.parametrize(
    "text, want",
    [
        ("some words\nAll rights reserved.\nmore", [("All-Rights-Reserved", 1, 1)]),
        ("(c) 2024 Foo. Released under the MIT License. See the file for details and contact us.", [("MIT", 0, 0)]),
        (
            "/* Licensed under the Apache License, Version 2.0 (the \"License\"); you may not\n * use this file except in compliance "
            "with the License. You may obtain a copy of\n * the License at http://www.apache.org/licenses/LICENSE-2.0 */\nint main() {\n"
            "  return run(first, second, third) + walk(first, second, third) + step(first, second, third);\n}",
            [("Apache-2.0", 0, 2)],
        ),
        ("This work is licensed under the GNU Affero General Public License, version 3.", [("AGPL-3.0-only", 0, 0)]),
        ("This work is licensed under the GNU General Public License, version 3 or later.", [("GPL-3.0-or-later", 0, 0)]),
        ("This work is licensed under the GNU General Public License, version 1.", []),
        ("This work is licensed under the GNU General Public License, version 3.0.", [("GPL-3.0-only", 0, 0)]),
        ("Licensed under the Apache License, Version 1.1.", []),
        ("Licensed under CC BY-ND 4.0. Released under the MIT License.", [("CC-BY-ND-4.0", 0, 0), ("MIT", 0, 0)]),
        ("before that " * 50 + license_scan._ISC_GRANT + ", " + license_scan._ISC_TERMS + " and after" * 50, [("ISC", 0, 0)]),
        (f"1. {license_scan._BSD_TERMS}\n{license_scan._BSD_WARRANTY}", [("BSD-2-Clause", 0, 1)]),
        (f"{license_scan._BSD_TERMS} {license_scan._BSD_NAMES}\n{license_scan._BSD_WARRANTY}", [("BSD-3-Clause", 0, 1)]),
        ("# SPDX-License-Identifier: LGPL-2.1-or-later", [("LGPL-2.1-or-later", 0, 0)]),
    ],
)
def test_notices_inside_running_text(text, want):
    assert [m[:3] for m in license_scan.Templates().matches(text)] == want


def test_licences_of_odd_rows(odd_documents):
    assert license_scan.license_scan(odd_documents).collect() == []
    assert license_scan.license_scan(odd_documents.limit(0)).collect() == []


# ---- chat formatting ----


def test_every_participant_gets_the_whole_dialogue(spark):
    rows = [
        (1, 0, "system", "be brief"), (1, 1, "anna", "hi"), (1, 2, "bert", "ho"), (1, 3, "anna", None), (1, 3, None, "?"),
        (None, 0, "carl", "alone"), (2, 0, "system", "nobody"), (3, None, "dora", ""), (3, None, "dora", ""),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, piece string, perspective string")
    got = Counter((r.conv_id, r.perspective) for r in chat_format.chat_format(df).collect())
    assert got == {(1, "anna"): 5, (1, "bert"): 5, (None, "carl"): 1, (3, "dora"): 2}
    anna = [r for r in chat_format.chat_format(df).orderBy("turn", "piece").collect() if r.perspective == "anna"]
    assert "".join(r.piece for r in anna) == (
        "<|im_start|>system\nbe brief<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bert\nho<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\n?<|im_end|>\n"
    )
    assert [r.piece[r.learn_first : r.learn_past] for r in anna] == ["", "hi<|im_end|>", "", "<|im_end|>", ""]
    assert chat_format.chat_format(df.limit(0)).collect() == []


# ---- shared ----


def test_key_filter_loses_nothing(spark):
    df = spark.createDataFrame([(i,) for i in range(1000)] + [(None,)], "k long")
    some, others = split_by_keys(df, df["k"], df.filter("k % 10 = 0").withColumnRenamed("k", "id"))
    in_some, in_others = {r.k for r in some.collect()}, {r.k for r in others.collect()}
    assert set(range(0, 1000, 10)) <= in_some and len(in_some) < 150 and in_some | in_others == {None, *range(1000)}


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_queries_with_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalog.queries()[name](spark, sf_dir)
    cursor = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got == sorted(repr([dict(zip(names, r, strict=True))[c] for c in order]) for r in cursor.fetchall())


def test_all_queries_are_registered():
    names = set(contract.queries())
    assert {n for n in names if n.startswith("op")} == set(catalog.queries()) and len(catalog.queries()) == 13
    assert "pipeline" in names


# ---- pipeline ----


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in catalog.queries()["op10_quality_rules"](spark, sf_dir).collect() if r.kept}
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "source_mixing",
    ]
    one = stages["quality_rules"](spark, docs, sf_dir)
    assert {r.doc_id for r in one.collect()} == kept
    from test_ngram_join import brute

    groups = brute([(i, rows[i].text) for i in sorted(kept)])
    two = stages["ngram_jaccard_join"](spark, one, sf_dir)
    first = {i for i, (n, c) in groups.items() if c == i}
    assert {r.doc_id for r in two.collect()} == first and two.columns == docs.columns
    from occurra.llm.decontamination import normal

    items = [normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    three = stages["benchmark_decontamination"](spark, two, sf_dir)
    assert {r.doc_id for r in three.collect()} == {i for i in first if not any(t in normal(rows[i].text) for t in items)}
    four = stages["secret_scans"](spark, three, sf_dir)
    assert four.count() == three.count() and four.columns == docs.columns
    five = stages["source_mixing"](spark, four, sf_dir)
    assert sorted(five.collect()) == sorted(corpus_pipeline.run(spark, sf_dir).collect())


def test_pipeline_of_odd_rows(spark, odd_documents, sf_dir):
    plain = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, plain.limit(0), odd_documents):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns
            out.collect()
    assert corpus_pipeline.near_duplicates(spark, odd_documents, sf_dir).count() == 8
