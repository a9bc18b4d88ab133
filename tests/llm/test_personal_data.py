"""Base spans against the plain expressions, and what lies inside of matches that fail their rules."""

import random
import re
from hashlib import sha256

import pytest

from ledgerlynx.llm import boosting, pii

SF = "/root/testdata/sf0.001"
#: The expressions as they are stated.
STATED = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def passes(kind, own):
    digits = re.sub("[^0-9]", "", own)
    if kind == "ip":
        return all(int(p) <= 255 for p in own.split("."))
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 14 <= len(digits) <= 19 and (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def stated(text):
    order = [k for k, _ in STATED]
    found = [(m.start(), order.index(kind), m.end()) for kind, pattern in STATED for m in re.finditer(pattern, text or "") if passes(kind, m[0])]
    return ",".join(f"{order[k]}:{a}:{b}" for a, k, b in sorted(found))


def made_texts():
    rnd = random.Random(12)
    pieces = ["a@b.c", "x.y@z-1.co.uk", "@", ".", "1.2.3.4", "1.2.3.4.5", "300.1.1.1", "999.1.2.3.4", "0001.2.3.4", "4465758382889437", "4465 7583 8288 9437", "4465-7583-8288-9437", "+1 (826) 555-4081", "+44 20 7946 0958", "+", "-", " ", "  ", "word", "é", "12", "\n", "+1", "(", ")"]
    return ["".join(rnd.choices(pieces, k=rnd.randrange(1, 12))) for _ in range(300)] + [None, "", "9" * 40, "1.1." * 500]


def test_base_spans_are_those_of_the_stated_expressions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.collect()] + made_texts()
    rows = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x")], "doc_id long, text string, spans string").repartition(3)
    out = pii.digest(pii.find_personal_data(rows)).collect()
    assert len(out) == len(texts) + 1  # a repeated row is one of its own
    for r in out:
        assert r["base_sha256"] == sha256(stated(texts[r["doc_id"]]).encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _ in STATED] == [stated(texts[r["doc_id"]]).count(f"{k}:") for k, _ in STATED]
        own = set(stated(texts[r["doc_id"]]).split(",")) - {""}
        assert own <= set(r["spans"].split(","))


def test_numbers_side_by_side(spark):
    card, other, wrong, phone = "4465758382889437", "2353820953013749", "4465758382889438", "+1 (826) 555-4081"
    texts = {
        1: (f"was {card} {card} then", [(4, 20), (21, 37)]), 2: (f"{other} {card} und", [(17, 33)]), 3: (f"call {phone} 190.137.223.204 now", [(5, 22)]), 4: (f"see {wrong} {wrong} there", []),
        5: ("rows 1234567 7654321 1111111 and more", []), 6: ("pay 4465 7583 8288 9437 4465 7583 8288 9437 now", [(4, 23), (24, 43)]), 7: ("serial 40123 4465758382889437 991", []),
    }
    rows = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()] + [(8, None), (9, "")], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.find_personal_data(rows).collect()}
    for k, (text, want) in texts.items():
        base = {(s["start"], s["stop"]) for s in found[k]["base"]}
        assert [(s["start"], s["stop"]) for s in found[k]["spans"] if (s["start"], s["stop"]) not in base] == want, text
    clean = {r["doc_id"]: r["text"] for r in pii.redact_documents(rows).collect()}
    assert clean[1] == "was <CARD> <CARD> then" and clean[8] is None and clean[9] == ""


def test_windows_inside_are_short():
    assert pii.inside(pii.CARD, "4465758382889437 4465758382889437", 0) == [(0, 16), (17, 33)]
    assert pii.inside(pii.PHONE, "+1 826 555 4081 4465758382889437", 5) == [(5, 20)]
    assert pii.inside(pii.CARD, "1 " * 50_000, 0) == []


def test_empty_table_and_a_kind_without_threshold(spark):
    assert pii.digest(pii.find_personal_data(spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    import numpy as np

    assert boosting.threshold_for(np.array([0.9, 0.8]), np.array([0.0, 0.0]), 0.98) > 1
    with pytest.raises(RuntimeError, match="no threshold"):
        pii.find_personal_data(spark.createDataFrame([(1, "x")], "doc_id long, text string"), precision=1.1)
