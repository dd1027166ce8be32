import random
import time

from occurra.llm import decontamination
from occurra.llm.decontamination import Index, contaminated_regions, normal, without_contaminated


def edits_inside(item, text):
    """Fewest edits of the item against any part of the text, cell by cell."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def changed(rng, text, n):
    letters = list(text)
    for _ in range(n):
        at = rng.randrange(len(letters))
        kind = rng.randrange(3)
        if kind == 0:
            letters[at] = rng.choice("qxz")
        elif kind == 1:
            del letters[at]
        else:
            letters.insert(at, rng.choice("qxz"))
    return "".join(letters)


def words(rng, n):
    return " ".join("".join(rng.choice(["the", "an", "er", "tion", "ou", "st"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_against_full_alignment():
    rng = random.Random(4)
    items = [(i, words(rng, rng.randint(4, 14))) for i in range(12)]
    index = Index(items)
    budgets = dict(zip(index.keys, index.budget.tolist(), strict=True))
    for _ in range(60):
        key, item = rng.choice(items)
        text = f"{words(rng, 9)} {changed(rng, item, rng.randint(0, 9))} {words(rng, 9)}"
        got = {r[0]: r for r in index.regions(text)}
        for k, t in items:
            least = edits_inside(normal(t), normal(text))
            assert (k in got) == (least <= budgets[k]), (k, least, budgets[k])
            if k in got:
                first, past, edits = got[k][1:]
                assert edits == least == edits_inside(normal(t), normal(text)[first:past])


def test_long_texts_go_piece_by_piece(monkeypatch):
    rng = random.Random(5)
    item = words(rng, 20)
    text = f"{words(rng, 60)} {item} {words(rng, 60)}"
    want = Index([(1, item)]).regions(text)
    for piece in (7, 50, 133):
        monkeypatch.setattr(decontamination, "PIECE", piece)
        assert Index([(1, item)]).regions(text) == want and len(want) == 1


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = [(r.item_id, normal(r.text)) for r in benchmark.collect()]
    held = {(r.doc_id, k) for r in docs.collect() for k, t in items if t in normal(r.text)}
    found = {(r.doc_id, r.item_id) for r in contaminated_regions(docs, benchmark).collect()}
    assert held and held <= found
    kept = {r.doc_id for r in without_contaminated(docs, benchmark).collect()}
    assert kept == {r.doc_id for r in docs.collect()} - {d for d, _ in found}


def test_blocks_of_the_benchmark(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    want = sorted(contaminated_regions(docs, benchmark).collect())
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 1000)
    assert sorted(contaminated_regions(docs, benchmark).collect()) == want


def test_odd_rows(spark, odd_documents):
    schema = "item_id long, text string, text_ string, first long"
    odd = spark.createDataFrame([(1, None, "", 1), (2, "", "", 1), (3, "one", "", 1), (None, "no id here at all but some", "", 1)], schema)
    found = [(r.doc_id, r.item_id) for r in contaminated_regions(odd_documents, odd).collect()]
    assert sorted(x for x in found if x[0] is not None) == [(4, 3), (4, 3)]
    assert set(x for x in found if x[0] is None) == {(None, None)}
    assert without_contaminated(odd_documents, odd).count() == 6
    assert without_contaminated(odd_documents, odd.limit(0)).count() == 9
    assert contaminated_regions(odd_documents.limit(0), odd).collect() == []


def test_short_items_are_whole_words():
    index = Index([(1, "no"), (2, "a-b"), (3, "né")])
    assert index.regions("Do you know another way? Nobody knows now.") == []
    assert [(k, s) for k, s, _, _ in index.regions("No, a-b or xa-b, né; née. (no)")] == [(1, 0), (2, 4), (3, 17), (1, 27)]
    assert [r[1] for r in Index([(1, "x x")]).regions("x x x x")] == [0, 4]


def test_one_item_very_often_in_a_long_text():
    rng = random.Random(8)
    item = words(rng, 12)
    text = f"{item} zz " * 6000
    began = time.perf_counter()
    found = Index([(1, item), (2, item)]).regions(text)
    assert len(found) == 12000 and all(r[3] == 0 for r in found)
    assert time.perf_counter() - began < 30


def test_best_regions_against_all_pairs():
    rng = random.Random(9)
    for _ in range(200):
        found = [(rng.randrange(2), s := rng.randrange(40), s + rng.randint(1, 9), rng.randrange(3)) for _ in range(30)]
        kept = []
        for r in sorted(set(found), key=lambda r: (r[3], r[1], r[2], str(r[0]))):
            if not any(r[0] == k[0] and r[1] < k[2] and k[1] < r[2] for k in kept):
                kept.append(r)
        assert decontamination._best(found) == sorted(kept, key=lambda r: (r[1], r[2], str(r[0])))


def test_frequent_grams_in_slices(monkeypatch):
    rng = random.Random(10)
    items = [(i, words(rng, 9)) for i in range(30)]
    text = " ".join(changed(rng, t, 1) for _, t in items)
    want = Index(items).regions(text)
    assert len(want) >= 25
    for slots in (1, 50):
        monkeypatch.setattr(decontamination, "SLOTS", slots)
        assert Index(items).regions(text) == want
