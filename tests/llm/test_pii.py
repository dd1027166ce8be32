import hashlib
import re

import pytest
from pyspark.sql import functions as F

from occurra.llm import pii
from occurra.llm.pii import KINDS, candidates, chosen_cells, personal_data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    found = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    found += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]
    return found


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id] or "")
        assert tuple(r[f"n_{k}"] for k in KINDS) == tuple(sum(f[0] == k for f in want) for k in KINDS), r.doc_id
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), (joined, r.spans)
        assert {f"{k}:{s}:{e}" for k, s, e in want} <= set(r.spans.split(",") if r.spans else ())


TEXTS = [
    "write to a@b.co@d.ef or x@y or a@b.co+x@d.e.f. ünï.cödé@exämple.com é@a.b",
    "1.2.3.4.5.6.7.8 256.1.1.1 1.256.1.1 007.0000255.1.1 99999999999999999999999.1.1.1 1.2.3.400 10.0.0.1.",
    "4785380592391139 4465758382889437 4465758382889437 4111 1111 1111 1111 4111-1111-1111-1111x 4111111111111111-2",
    "+1 (743) 555-3824 +12 +123456789012345678 +1 (((( +49.30.1234567. call 743 555 3824 or (743) 555-3824",
    "tel (521) 555-6210 and 12-34 2024-01-02 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6",
    "joe (at) example (dot) com",
    "+" * 50 + "1" * 30 + " " + "9 " * 3000 + "a." * 3000 + "@x." + "y." * 3000 + "z",
]


def test_against_plain_python(documents):
    check(personal_data(documents(TEXTS)).collect(), dict(enumerate(TEXTS)))


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = personal_data(docs).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    assert all(sum(r[f"n_{k}"] for r in rows) for k in KINDS)


@pytest.mark.parametrize("count", [1, 63, 64, 65, 200])
def test_places_of_many_matches(documents, evaluate, count):
    text = "é" + " ü ".join(f"+{10**9 + i}" for i in range(count)) + "!"
    got = evaluate(lambda x: F.transform(pii.spans(x, pii.BASE["phone"]), lambda s: F.struct(s["first"], s["past"])), text)
    assert [tuple(g) for g in got] == [m.span() for m in PHONE.finditer(text)]


def test_model_adds_spans_in_the_format_of_true_ones(documents):
    """National numbers mostly stand inside full ones here, so one that stands alone is found too."""
    texts = [f"please call +1 ({200 + i}) 555-{1000 + i} today" for i in range(60)] + ["please call (743) 555-3824 today", "the 12 of 2024"]
    rows = {r.doc_id: r for r in personal_data(documents(texts)).collect()}
    assert rows[60].n_phone == 0 and rows[60].spans == "phone:12:26" and rows[61].spans == ""
    assert rows[0].spans == "phone:12:29"


def test_threshold_is_a_precision():
    sure, mixed_, rare = 0, 1, 2
    chosen = chosen_cells({sure: (1000, 990), mixed_: (1000, 300), rare: (3, 3)})
    assert sure in chosen and mixed_ not in chosen


def test_candidates_overlap_and_stay_within_the_table_of_bins(documents):
    found = candidates(documents(TEXTS)).collect()[3]["found"]
    assert any(not c["base"] and c["truth"] for c in found)
    size = 1
    for n in pii.BINS:
        size *= n
    assert all(0 <= c["cell"] < size for c in found)


def test_odd_rows(odd_documents):
    rows = personal_data(odd_documents).collect()
    assert len(rows) == 9 and all(r.spans == "" for r in rows)
    assert personal_data(odd_documents.limit(0)).collect() == []
