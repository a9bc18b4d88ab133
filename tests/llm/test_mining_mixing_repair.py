"""Hard-negative mining, source mixing and conversation repair against brute force, with nulls, ties, repeated rows, empty
tables and clashing columns."""

import math
import random
import re
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from ledgerlynx.llm import conversations, hard_negatives, mixing

SF = "/root/testdata/sf0.001"


# Conversations


def faults_of(rows):
    seen, out = set(), []
    for role, text in rows:
        rest = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def searched(rows, faults):
    """The least (cost, letters) and its lines, by trying every way; whatever cannot become legal is left at once."""
    best = None

    def go(i, initials, cost, audit, lines, inserted):
        nonlocal best
        if not re.fullmatch(r"(s|s?(ua)*u?)", initials):
            return
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch(r"(s?(ua)+)?", initials) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, lines)
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, initials + role[0], cost + 2, audit + "I", [*lines, role + ":"], inserted + 1)
        if i < len(rows):
            (role, text), fault = rows[i], faults[i]
            go(i + 1, initials, cost + 3, audit + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role:
                    go(i + 1, initials + role[0], cost + extra, audit + "K", [*lines, f"{role}:{text}"], 0)
                for new in ("user", "assistant"):
                    go(i + 1, initials + new[0], cost + 2 + extra, audit + "R", [*lines, f"{new}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best


def expected(rows):
    """Of one conversation's rows (turn, role, text), in order."""
    said = [(r, t) for _, r, t in rows]
    faults = faults_of(said)
    cost, audit, lines = searched(said, faults)
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for r, _ in said]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha256("\n".join(lines).encode()).hexdigest())


def damage_by_hand(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out.append((conv, [] if fault == 0 else [(turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)] * (2 if fault == 3 else 1)))
    convs = {}
    for conv, own in out:
        convs.setdefault(conv, []).extend(own)
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in convs.items()}


@pytest.fixture(scope="module")
def said():
    rnd = random.Random(5)
    texts = ["Yes.", "No!", "Well", "Why?", "", " \t\n", "Ends here. \n", "...", None, "Ünd 漢字。", "long " * 50_000 + "."]
    rows = []
    for conv in [*range(60), None, 77]:
        for turn in range(rnd.randrange(1, 6)):
            rows.append((conv, rnd.choice([turn, turn, turn, 2 * turn, None]), rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(texts[:10] if conv != 7 else texts)))
    return rows + rows[:3]


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def rows_of(df):
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_repair(spark, said, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in said], "conv_id long, turn long, role string, text string, conv string, part int").repartition(5)
    by_hand = damage_by_hand(said)
    want = {c: expected(own) for c, own in by_hand.items()}
    assert rows_of(conversations.repair(df, damage=conversations.damaged)) == want
    # blocks of two rows: every conversation is cut, and composed again
    monkeypatch.setattr(conversations.Block, "full", lambda self: len(self.rows) >= 2)
    assert rows_of(conversations.repair(df, damage=conversations.damaged)) == want


def test_repair_without_rows_or_faults(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(empty, damage=conversations.damaged).collect() == []
    key = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    gone = conversations.repair(spark.createDataFrame([(key, 0, "user", "Hm.")], empty.schema), damage=conversations.damaged)
    assert rows_of(gone) == {key: (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())}
    plain = conversations.repair(spark.createDataFrame([(1, 0, "user", "Hm."), (1, 1, "assistant", "Yes.")], empty.schema))
    assert rows_of(plain) == {1: (0, 0, 0, 0, 0, 0, "KK", sha256(b"user:Hm.\nassistant:Yes.").hexdigest())}


def test_long_conversation(spark):
    """One conversation holds nearly all rows; many of them are the same."""
    rnd = random.Random(1)
    rows = [(1, k, rnd.choice(["user", "assistant", "system"]), rnd.choice(["Same.", f"Other {k}.", f"Open {k}"])) for k in range(4000)] + [(2, 0, "user", "Hm.")]
    got = rows_of(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)))
    own = [(r, t) for c, _, r, t in rows if c == 1]
    faults = faults_of(own)
    cost, letters = conversations.cheapest(tuple((r[0], f) for (r, _), f in zip(own, faults)), conversations.ENDS)[0]
    lines, _ = conversations.repaired(letters, 0, iter(own))
    assert got[1][5:] == (cost, letters.decode(), sha256("\n".join(lines).encode()).hexdigest()) and got[1][2] == faults.count("duplicate")


# Hard negatives


def mined(rows, anchor, positives=5, negatives=3):
    """rows: (id, vector, label), as they take part."""
    whole = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    out = []
    for k, (i, v, label) in enumerate(whole):
        if anchor(i):
            scored = sorted((-sum(x * y for x, y in zip(v, w)), j, n, other) for n, (j, w, other) in enumerate(whole) if n != k and len(w) == len(v))
            for s, j, _, _ in [x for x in scored if x[3] == label][:positives]:
                fits = [(x[0], x[1]) for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s]
                out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(fits[:negatives])]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rnd = random.Random(3)
    vector = lambda n=12: [rnd.choice([rnd.uniform(-1, 1), 0.25, -0.5]) for _ in range(n)]
    rows = [(k, vector(), rnd.randrange(3)) for k in range(300)]
    rows += [(300 + k, rows[k % 7][1], k % 3) for k in range(90)]  # copies: many ties
    rows += [(400 + k, vector(5), 1) for k in range(9)] + [(410, [], 1), (411, [], 2), (412, [], 1)] + rows[:2]
    broken = [(None, vector(), 1), (501, None, 1), (502, vector(), None), (503, [None, *vector(11)], 1), (504, [float("nan"), *vector(11)], 1), (505, [float("inf"), *vector(11)], 1)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + broken], "vec_id long, embedding array<double>, label int, row int, anchor string").repartition(3)
    want = mined(rows, lambda i: i % 10 == 0)
    for size in (1024, 16):
        monkeypatch.setattr(hard_negatives, "ROWS", size)
        monkeypatch.setattr(hard_negatives, "ANCHORS", size)
        got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0)
        assert sorted(map(tuple, got.collect())) == want
    large = [(k, [2.0**45 + k, 3.0 * k], k % 2) for k in range(6)]  # beyond what doubles hold; the scores fit 128 bits only
    with pytest.raises(Exception, match="too large|overflow|int"):
        hard_negatives.hard_negatives(spark.createDataFrame(large, "vec_id long, embedding array<double>, label int"), F.col("id") == 0).collect()
    none = hard_negatives.hard_negatives(df.where("vec_id > 1000"), F.col("id") % 10 == 0)
    assert none.collect() == [] and none.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_and_drop_pairs():
    """Summaries never drop a pair that counts, and on groups of smooth vectors they drop most before an exact score."""
    import numpy as np

    rnd = np.random.default_rng(2)
    centres = np.repeat(rnd.normal(size=(20, 8)), 8, axis=1)  # components side by side are alike, as means can tell
    x = np.floor(256 * (centres[rnd.integers(0, 20, 600)] + 0.05 * rnd.normal(size=(600, 64))))
    pack = hard_negatives.Pack(np.arange(600), np.arange(600), np.zeros(600, int), x, hard_negatives.summaries(x), np.zeros((600, 0, 2)))
    scores = x @ x.T
    for mean, deviation in pack.levels:
        assert (np.abs(scores - mean @ mean.T) <= deviation @ deviation.T + 1e-3).all()
    a, b, left = hard_negatives.survivors(pack, pack, np.arange(600), np.arange(600), ~np.eye(600, dtype=bool), [np.full(600, -np.inf)], [None], 5)
    assert left.sum() < 0.25 * 600 * 600


# Mixing


def mixing_docs(spark):
    rnd = random.Random(9)
    rows = [(k, " ".join(f"w{k}_{i}" for i in range(rnd.choice([0, 1, 5, 40, 300]))), rnd.choice(["a", "b", "ä", "🙂", "c", "a", "a"])) for k in range(400)]
    rows += [(1000, None, "a"), (1001, "", None), (1002, "one two", None), (1003, " ".join(f"v{i}" for i in range(30_000)), "b"), (1004, "  \t\n", "only spaces"), (None, "no id here", "c"), (1002, "one two", None)]
    return spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, source string, shard string, size int, offset int").repartition(4), rows


def shares(sizes):
    """Targets by source, by repeated sharing."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[r] for r in rest) for s in rest}
        above = {s: 3 * sizes[s] for s in rest if share[s] > 3 * sizes[s]}
        if not above:
            return fixed | share
        fixed |= above


def test_mixing(spark):
    df, rows = mixing_docs(spark)
    mixed = mixing.mix(df, block=16, per_shard=64)
    got = [tuple(r) for r in mixing.taken(mixed).collect()]
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(mixing.WORD, text or ""))
    targets = shares(sizes)
    assert sorted(r[:2] for r in got if r[0] is not None) == sorted((k, len(re.findall(mixing.WORD, t or ""))) for k, t, _ in rows if k is not None)
    source_of = {k: s for k, _, s in rows}
    totals = dict.fromkeys(sizes, 0)
    for doc, size, source_size, target, taken in got:
        s = source_of[doc]
        assert source_size == sizes[s] and math.isclose(target, targets[s]) and taken <= 3 * size
        totals[s] += taken
    assert all(totals[s] == math.floor(targets[s] + 0.5) for s in sizes)
    again = mixing.taken(mixing.mix(df.repartition(7), block=16, per_shard=64)).collect()
    assert sorted(map(str, again)) == sorted(map(str, map(tuple, got))) or sorted(map(tuple, again), key=str) == sorted(got, key=str)


def test_mixed_slots_hold_their_words(spark):
    df, rows = mixing_docs(spark)
    unique = df.where("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.mix(unique, block=16, per_shard=64)
    slots = mixed.where("length > 0").groupBy("shard", "slot").agg(F.sum("length").alias("n"), F.countDistinct("source").alias("sources"), F.count_if(F.col("source").isNull()).alias("none")).collect()
    by_shard = {}
    for r in slots:
        assert r["n"] <= 16 and r["sources"] <= 1
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert 0.5 * 64 < sum(map(len, by_shard.values())) / len(by_shard) < 2 * 64
    texts = {(r["shard"], r["slot"]): r["text"].split(" ") for r in mixing.mixed_texts(mixed, unique).collect()}
    assert {(r["shard"], r["slot"]): r["n"] for r in slots} == {k: len(v) for k, v in texts.items()}
    known = {w for _, t, _ in rows for w in re.findall(mixing.WORD, t or "")}
    assert {w for ws in texts.values() for w in ws} <= known


def test_mixing_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.taken(mixing.mix(empty)).collect() == []
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], empty.schema)
    assert sorted(map(tuple, mixing.taken(mixing.mix(blank)).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
