import hashlib
import random
import zlib

from pyspark.sql import functions as F

from occurra.llm.periodic_runs import periodic_runs, run_digests, text_runs


def plain_runs(words):
    """Every period in turn; the smallest one that a stretch has."""
    found, seen = [], set()
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i < len(words) - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and (i, j) not in {(s, e - q) for s, e in seen}:
                seen.add((i, j + q))
                found.append((i, j - i + q, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def made(seed):
    rng = random.Random(seed)
    alphabet, n = rng.choice([1, 2, 2, 3, 5, 40]), rng.choice([0, 1, 5, 6, 20, 60, 300])
    words = [f"w{rng.randrange(alphabet)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3) if n > 8 else 0):
        start, period = rng.randrange(n), rng.randint(1, n // 4)
        for i in range(start + period, min(n, start + period * rng.randint(3, 9) + rng.randint(0, period))):
            words[i] = words[i - period]
    return words


def test_against_all_periods():
    texts = [made(seed) for seed in range(3000)]
    for first in range(0, len(texts), 7):
        some = texts[first : first + 7]
        for words, (n, runs, rest) in zip(some, text_runs([" ".join(w).encode() for w in some]), strict=True):
            want = plain_runs(words)
            assert (n, [tuple(r) for r in runs.tolist()], rest.decode()) == (len(words), want, plain_collapsed(words, want))


def test_runs_inside_runs():
    # a run of blocks that are themselves runs, and two runs that overlap
    block = "a a a a a a a b".split()
    words = block * 5 + "c d c d c d c d c d e".split()
    (_, runs, _) = next(text_runs([" ".join(words).encode()]))
    assert [tuple(r) for r in runs.tolist()] == plain_runs(words)
    assert (0, 40, 8) in [tuple(r) for r in runs.tolist()]


def test_long_texts_with_large_and_small_periods():
    rng = random.Random(3)
    block = [str(rng.random()) for _ in range(5_000)]
    words = ["x"] + block * 5 + ["y"] * 70_000 + ["z", "u"] * 20_000
    (n, runs, rest) = next(text_runs([" ".join(words).encode()]))
    assert n == len(words)
    assert [tuple(r) for r in runs.tolist()] == [(1, 25_000, 5_000), (25_001, 70_000, 1), (95_001, 40_000, 2)]
    assert rest.decode().split() == ["x", *block, "y", "z", "u"]


def test_rows(spark, documents):
    rows = periodic_runs(documents(["a b a b a b a b c", None, "", "one two"]), {"id": F.col("doc_id")}).collect()
    got = {r["id"]: (r["n_words"], [tuple(x) for x in r["runs"]], bytes(r["collapsed"]).decode()) for r in rows}
    assert got == {0: (9, [(0, 8, 2)], "a b c"), 1: (0, [], ""), 2: (0, [], ""), 3: (2, [], "one two")}


def test_digests_against_plain_version(spark, documents):
    texts = {i: " ".join(made(i)) for i in range(400)}
    got = {r["doc_id"]: r for r in run_digests(documents(list(texts.items()))).collect()}
    assert len(got) == len(texts)
    planted = 0
    for i, text in texts.items():
        words, h = text.split(), zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            planted += 1
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = got[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None,) * 3)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(plain_collapsed(words, runs).encode()).hexdigest()
    assert planted > 10


def test_odd_rows(spark, odd_documents):
    rows = run_digests(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    empty = hashlib.sha256(b"").hexdigest()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (1, 2, 3):
        assert (by_id[i]["n_runs"], by_id[i]["start"], by_id[i]["runs_sha256"], by_id[i]["collapsed_sha256"]) == (0, None, empty, empty)
    assert by_id[6]["length"] == 40_000
    assert by_id[6]["collapsed_sha256"] == hashlib.sha256(b"word").hexdigest()
    assert run_digests(odd_documents.limit(0)).count() == 0
