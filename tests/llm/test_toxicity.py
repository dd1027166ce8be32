import random

from pyspark.sql import functions as F

from occurra.llm.common import table
from occurra.llm.toxicity import SEARCH, Gains, Model, fit_curve, held_out, labelled, toxicity, train, windows

INSULTS = "zornkopf blugwit dreckhans mullgrub".split()


def corpus(n, seed, each=4):
    rng = random.Random(seed)
    syllables = [a + b for a in "bdfgklmnprst" for b in "aeiou"]
    rows, marks = [], []
    for i in range(n):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
        toxic = int(i % 4 == 0)
        if toxic:
            for _ in range(each):
                words[rng.randrange(len(words))] = rng.choice(INSULTS)
        rows.append((i, " ".join(words)))
        marks.append((i, 1, toxic))
    return rows, marks


LABELS = "doc_id long, quality int, toxic int"


def test_windows():
    assert windows(None) == windows(" \n") == []
    assert windows("Ab  cÄ\n") == [b" ab ", " cä ".encode()]
    assert windows("x" * 100) == [b" " + b"x" * 40 + b" "] * 2 + [b" " + b"x" * 20 + b" "]


def test_curve_finds_the_weights():
    rng = random.Random(2)
    import numpy as np

    x = np.array([[rng.gauss(0, 1), rng.gauss(3, 2)] for _ in range(4000)])
    p = 1 / (1 + np.exp(-(2 * x[:, 0] - 1)))
    y = np.array([float(rng.random() < q) for q in p])
    center, scale, weights = fit_curve(x, y)
    assert abs(weights[1] / scale[0] - 2) < 0.25 and abs(weights[2] / scale[1]) < 0.1


def test_held_out_rows_are_told_apart(spark, documents):
    rows, marks = corpus(1500, 1)
    # a group of copies of a clean text, and one of a toxic one
    rows += [(2000 + i, rows[1][1]) for i in range(300)] + [(3000 + i, rows[0][1]) for i in range(300)]
    marks += [(2000 + i, 1, 0) for i in range(300)] + [(3000 + i, 1, 1) for i in range(300)]
    got = toxicity(documents(rows), spark.createDataFrame(marks, LABELS)).collect()
    truth = {i: t for i, _, t in marks}
    assert len(got) == len(rows)
    unseen = [r for r in got if r["held_out"]]
    assert 0.25 < len(unseen) / len(got) < 0.42
    caught = [r["predicted"] for r in unseen if truth[r["doc_id"]]]
    wrong = [r["predicted"] for r in unseen if not truth[r["doc_id"]]]
    assert sum(caught) >= 0.95 * len(caught)
    assert sum(wrong) <= 0.01 * len(wrong)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_only_open_rows_are_learned_from(spark, documents):
    rows, marks = corpus(300, 3)
    docs, labels = documents(rows), spark.createDataFrame(marks, LABELS)
    assert labelled(docs, labels)[1].filter(held_out("id")).count() == 0
    first = toxicity(docs, labels).select("doc_id", "score").collect()
    # other labels of the held-out rows, other languages and sources change nothing
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")), turned).select("doc_id", "score").collect()
    assert sorted(first) == sorted(again)


def test_gains_are_compressed_lengths(spark, documents):
    rows, marks = corpus(600, 5)
    model = train(*labelled(documents(rows), spark.createDataFrame(marks, LABELS)))
    gains = Gains(model.toxic, model.ordinary)
    import zstandard

    sizes = []
    for content in (model.ordinary, model.toxic):
        params = zstandard.ZstdCompressionParameters(**SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content), compression_params=params).compress(b" zornkopf " + b"\n" * 12)))
    assert gains.of(b" zornkopf ") == sizes[0] - sizes[1] > 2
    text = "zornkopf ba zornkopf " + "du " * 5
    each = [gains.of(w) for w in windows(text)]
    import numpy as np

    want = [sum(g >= k for g in each) for k in range(1, 9)]
    assert np.allclose(gains.features(text)[:8], np.log1p(want))
    assert np.allclose(gains.features(text)[8:16], np.log1p([1000 * w / len(each) for w in want]))


def test_nothing_to_learn_from(spark, documents):
    docs = documents(["a b c", None, ""])
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in toxicity(docs, none).collect()} == {(0.0, 0)}
    ones = spark.createDataFrame([(0, 1, 1), (1, 1, 1), (2, None, None)], LABELS)
    assert {r["score"] for r in toxicity(docs, ones).collect()} <= {0.0, 1.0}
    assert toxicity(docs.limit(0), ones).count() == 0
    assert Model().scores(Model().center.reshape(1, 0)).tolist() == [0.0]


def test_odd_rows(spark, odd_documents, documents):
    rows, marks = corpus(400, 7)
    extra = odd_documents.select("doc_id", "text", "lang", "source", "n_chars")
    both = documents(rows).filter("doc_id > 10").unionByName(extra)
    labels = spark.createDataFrame([*marks, *marks, (None, 1, 1), (4, 0, 5), (5, 0, None)], LABELS).selectExpr("*", "'x' AS id", "'x' AS text")
    got = toxicity(both, labels).collect()
    assert len(got) == both.count()
    assert {type(r["score"]) for r in got} == {float}
    empty = {r["score"] for r in got if r["doc_id"] in (1, 2, 3)}
    assert len(empty) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    with_names = toxicity(odd_documents, labels)
    assert with_names.columns == ["doc_id", "held_out", "score", "predicted"]
    assert with_names.count() == odd_documents.count()


def test_held_out_rows_of_the_given_tables(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    got = toxicity(docs, labels).join(labels, "doc_id").filter("held_out")
    caught, toxic = got.filter("toxic = 1").selectExpr("sum(predicted)", "count(*)").first()
    wrong, ordinary = got.filter("toxic = 0").selectExpr("sum(predicted)", "count(*)").first()
    # some rows of the table are marked toxic without a typical word
    assert caught >= 0.88 * toxic
    assert wrong <= 0.01 * ordinary
