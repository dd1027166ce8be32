import random
import re

import pytest

from occurra.llm import ngram_join
from occurra.llm.ngram_join import Bands, ngram_jaccard_join


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    keys = sorted(sets)
    for x in keys:
        for y in keys:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                label[b] = a
    return {i: (len(sets[i]), root(i)) for i in keys}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def corpus(seed, texts=25, near=8, words=(3, 120), vocabulary=400):
    """Originals and copies with up to 4 edits, some of them across the limit of 0.8."""
    rng = random.Random(seed)
    line = " ".join(f"common{i}" for i in range(12))
    rows = []
    for _ in range(texts):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(*words))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(near)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = f"v{rng.randrange(10**6)}"
            rows.append((line + "\n" if rng.random() < 0.3 else "") + " ".join(copy))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(documents, seed):
    rows = corpus(seed)
    assert found(ngram_jaccard_join(documents(rows))) == brute(list(enumerate(rows)))


def test_salted_buckets_and_one_hub_round(documents, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_SHARE", 0.01)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 0)
    rows = corpus(3, texts=4, near=30)
    assert found(ngram_jaccard_join(documents(rows), bucket_rows=3)) == brute(list(enumerate(rows)))


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(ngram_jaccard_join(docs)) == brute(rows)


def test_every_pair_within_the_bound_shares_a_looked_up_signature():
    """The pigeonhole itself, for sets at the limit of 0.8 and of all small sizes."""
    import numpy as np

    bands = Bands(80)
    rng = np.random.default_rng(5)
    none = (np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64))
    for size in [*range(2, 60), 150, 700]:
        for _ in range(6):
            pool = np.unique(rng.integers(0, 2**64, size=2 * size + 4, dtype=np.uint64))
            rng.shuffle(pool)
            drop = int(rng.integers(0, size // 5 + 1))
            new = 0
            while (size - drop) * 100 >= 80 * (size + new + 1) and rng.random() < 0.7:
                new += 1
            x, y = np.sort(pool[:size]), np.sort(pool[drop : size + new])
            shared = len(np.intersect1d(x, y))
            if 100 * shared < 80 * (len(x) + len(y) - shared) or (len(x) == len(y) == shared):
                continue
            empty = {}
            for s in (x, y):
                for band, number in bands.needs_empty(s):
                    empty.setdefault(band, []).append(number)
            empty = {k: np.array(sorted(set(v))) for k, v in empty.items()}
            have, ask = [set(), set()], set()
            for of, sig, look, _ in bands.signatures([x, y], none, empty, 1000):
                for i, one, asked in zip(of.tolist(), sig.tolist(), look.tolist(), strict=True):
                    have[i].add(one)
                    if asked:
                        ask.add(one)
            assert have[0] & have[1] & ask, (size, drop, new)


def test_words_are_cut_like_split(monkeypatch):
    import numpy as np

    from occurra.llm import common

    rng = random.Random(9)
    texts = ["".join(rng.choices("ab é\n\t\x0b\x0c\r", k=rng.randrange(60))).encode() for _ in range(200)] + [b"", b" ", b"x" * 500 + b" y"]
    whole = [h for _, _, h, _, _ in common.batch_words(texts)]
    for piece in (1, 7, 64):
        monkeypatch.setattr(common, "_SLICE", piece)
        seen = {}
        for first, past, hashes, sizes, offsets in common.batch_words(texts):
            for i in range(first, past):
                own = slice(offsets[i - first], offsets[i - first + 1])
                words = texts[i].split()
                assert sizes[own].tolist() == [len(w) for w in words]
                for w, h in zip(words, hashes[own].tolist(), strict=True):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen) and set(np.concatenate(whole).tolist()) == set(seen.values())


def test_odd_rows(odd_documents):
    rows = sorted(ngram_jaccard_join(odd_documents).collect(), key=str)
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 9 and sum(r.doc_id == 4 for r in rows) == 2
    assert by_id[1] == (0, 1) and by_id[2] == (0, 2) and by_id[3] == (0, 3)
    assert by_id[4] == (1, 4) and by_id[6] == (1, 6) and by_id[None][1] is None


def test_no_rows(documents):
    assert ngram_jaccard_join(documents([])).collect() == []


def test_salts_agree_where_a_frequency_equals_the_limit():
    """One content, one bucket: salted or not alike, be it a whole segment of a set or what a deletion leaves of one."""
    import numpy as np

    limit = 50
    bands = Bands(80)
    rng = np.random.default_rng(9)
    met = 0
    for often in (limit - 1, limit, limit + 1, 2 * limit):
        for size in [*range(10, 60), 150]:
            x = np.unique(rng.integers(0, 2**64, size=size, dtype=np.uint64))
            sets = [x, *[np.delete(x, i) for i in rng.choice(len(x), size=5, replace=False)]]
            frequent = (x, np.where(rng.random(len(x)) < 0.9, often, 1).astype(np.int64))
            parts, salts_of = {}, {}
            for of, sig, _, salts in bands.signatures(sets, frequent, {}, limit):
                for i, one, n in zip(of.tolist(), sig.tolist(), salts.tolist(), strict=True):
                    parts.setdefault(one, set()).add(i)
                    salts_of.setdefault(one, set()).add(n)
            assert all(len(n) == 1 for n in salts_of.values()), (often, size)
            met += sum(len(i) > 1 for i in parts.values())
    assert met > 1000


def test_components_grow_by_links(spark):
    import random

    from occurra.llm.components import components, joined_by

    rng = random.Random(4)
    for _ in range(3):
        links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
        first, more = links[:15], links[15:]
        schema = "a long, b long"
        whole = {tuple(r) for r in components(spark.createDataFrame(links, schema)).collect()}
        grown = joined_by(components(spark.createDataFrame(first, schema)), spark.createDataFrame(more, schema), len(more))
        assert {tuple(r) for r in grown.collect()} == whole
        again = joined_by(grown, spark.createDataFrame(more, schema), len(more))
        assert {tuple(r) for r in again.collect()} == whole
        none = joined_by(components(spark.createDataFrame([], schema)), spark.createDataFrame(links, schema), len(links))
        assert {tuple(r) for r in none.collect()} == whole


def test_long_texts_with_a_passage_in_common_are_not_paired(documents, monkeypatch):
    """Sketches of 512 bits rule out nothing for long texts; the pairs of a bucket are not written for all that."""
    rng = random.Random(11)

    def words(n):
        return [f"w{rng.randrange(10**7)}" for _ in range(n)]

    rows = []
    for _ in range(5):
        passage = words(900)
        group = [words(1100) + passage + words(1100) for _ in range(6)]
        copy = list(group[3])
        copy[50] = copy[2500] = "changed"
        rows += [" ".join(text) for text in [*group, copy]]
    direct, asked = ngram_join._direct_pairs, []

    def counted(*args):
        pairs = direct(*args)
        asked.append(pairs.count())
        return pairs

    monkeypatch.setattr(ngram_join, "_direct_pairs", counted)
    assert found(ngram_jaccard_join(documents(rows))) == brute(list(enumerate(rows)))
    assert asked and max(asked) <= 5
