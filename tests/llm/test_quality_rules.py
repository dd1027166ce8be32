import re
from collections import Counter

import pytest

from occurra.llm.quality_rules import COUNTS, keep_good, quality_rules, statistics


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(8)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
    )


@pytest.fixture(scope="module")
def given(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, {r.doc_id: r for r in quality_rules(docs, labels).collect()}


def test_counts_against_plain_python(given):
    docs, _, rows = given
    for r in docs.collect():
        got = rows[r.doc_id]
        want = plain(r.text)
        assert tuple(got[c] for c in COUNTS) == want
        assert got.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])


@pytest.mark.parametrize("text", ["a b\n\n \na b\na b ", "x " * 16, "é é   ü\n", "\ud800 lone", "a b c d e f g h a b c d e f g h"])
def test_counts_of_odd_texts(text):
    assert tuple(statistics([text, None])[0, :5]) == plain(text)


def test_labelled_rows_are_told_apart(given):
    _, labels, rows = given
    good = [rows[r.doc_id].kept for r in labels.collect() if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [rows[r.doc_id].kept for r in labels.collect() if r.quality == 0]
    assert sum(good) >= 0.99 * len(good)
    # few labelled rows here, so the threshold may not cost a single good one
    assert sum(bad) <= 0.25 * len(bad)


def test_bad_rows_outside_the_labels_are_found(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality_rules(docs, labels.filter("crc32(CAST(doc_id AS STRING)) % 2 = 0")).collect()}
    held_out = labels.filter("crc32(CAST(doc_id AS STRING)) % 2 = 1").collect()
    good = [rows[r.doc_id].kept for r in held_out if r.quality == 1 and not rows[r.doc_id].base_failed]
    bad = [rows[r.doc_id].kept for r in held_out if r.quality == 0]
    assert len(good) > 1000 and sum(good) >= 0.995 * len(good)
    assert len(bad) > 200 and sum(bad) <= 0.05 * len(bad)


def test_filter_agrees_with_the_verdicts(given):
    docs, labels, rows = given
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}


def test_odd_rows(spark, odd_documents):
    schema = "doc_id long, quality int, toxic int, n_words string"
    labels = spark.createDataFrame([(7, 1, 0, ""), (7, 0, 0, ""), (None, 1, 0, ""), (4, 1, 0, ""), (5, None, 0, ""), (6, 7, 0, "")], schema)
    rows = quality_rules(odd_documents, labels).collect()
    assert len(rows) == 9
    assert all(r.base_failed and not r.kept for r in rows if r.doc_id in (1, 2, 3, 4, 6))
    without = quality_rules(odd_documents, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in without)
    assert quality_rules(odd_documents.limit(0), labels).collect() == []
    assert keep_good(odd_documents, labels).columns == odd_documents.columns
