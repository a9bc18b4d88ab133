"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Base spans (emails, IP addresses, card and phone numbers in their plain form, checked by their own rules)
always count. Further generators propose spans, which may overlap: spelled-out emails, defanged or bracketed IP
addresses, cards in other groupings, phones without a plus, whatever failed a base rule, and what lies inside of that: a base pattern takes
numbers that stand side by side as one, which then fails, so cards are looked for among its groups of digits and phones at its front. Boosted trees
score these by their format and the words around them; those at or above the threshold of their kind are
added, the best score first, unless they overlap a span taken before.

There are no labelled spans, so the labels are made. Class 1 are the documents' base spans rewritten in the
forms that the generators look for, within the text that surrounds them; class 0 are candidates of the
documents that cannot be of their kind (checksum, octets, number of digits, ending). A candidate that could be real has no
label. To these come `MADE` invented rows of each class and kind, the same for every table: made-up addresses and numbers in
disguise, and dates, versions, order numbers, amounts, prose and failing checksums in the same forms. So each
kind has a calibrated threshold at every size. The trees are fitted on `SAMPLE` of the documents' rows at most of each
class (by a hash order) and the invented ones; a threshold holds a precision of `PRECISION` both on all held-out rows and
on the invented ones among them, and is never below one half.

Null and empty texts have no spans; redacting leaves them as they are. Very long texts are read whole; all patterns take
linear time. Offsets count code points. Empty tables give no rows. Repeated rows give repeated results; further input
columns are ignored, and redacting keeps them.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, boost, threshold_for
from .common import map_batches, materialise

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SAMPLE, MADE, PRECISION = 20_000, 800, 0.98
CONTEXT = 32

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_QUAD = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: (kind, pattern) of what the base rules do not look for.
_MORE = (
    (EMAIL, re.compile(r"(?<![\w.+-])[\w.+-]{1,64}(?: ?[\[({<] ?(?:at|AT|@) ?[\])}>] ?| at | AT )[A-Za-z0-9-]{1,63}(?:(?: ?[\[({<] ?(?:dot|DOT|\.) ?[\])}>] ?| dot | DOT |\.)[A-Za-z0-9-]{2,63}){1,4}")),
    (IP, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?| dot )[0-9]{1,3}){3}(?![0-9])")),
    (CARD, re.compile(r"(?<![0-9])[0-9]{4}([./_:]|[\x20-]{2}| )[0-9]{4,6}\1[0-9]{4,5}(?:\1[0-9]{1,7})?(?![0-9])")),
    (PHONE, re.compile(r"(?<![0-9+])(?:00[1-9][0-9]{0,2}[\x20./-])?\(?[0-9]{2,5}\)?[\x20./-]{1,2}[0-9]{2,4}(?:[\x20./-][0-9]{2,5}){1,3}(?![0-9])")),
)
#: Words near a span that speak for a kind, in the languages of the corpus.
_CUES = (
    re.compile(r"(?i)e-?mail|contact|correo|courriel|kontakt|write to|@"),
    re.compile(r"(?i)\bip\b|address|host|server|dirección|adresse"),
    re.compile(r"(?i)card|visa|master|amex|credit|tarjeta|carte|karte"),
    re.compile(r"(?i)phone|\btel|call|mobile|cell|fax|teléfono|móvil|anruf|handy"),
)
#: Words before a span that speak against every kind.
_AGAINST = re.compile(r"(?i)version|release|build|section|chapter|order|invoice|serial|number|date|total|pages?\b|\bv ?$|\bref\b|\bno\.|pedido|factura|commande|facture|rechnung|fecha|datum")
_SHAPE = re.compile(r"[0-9]+")
_ENDING = re.compile(r"[A-Za-z]{2,24}\Z")
_ENDINGS = frozenset("com org net edu gov mil int info biz io dev app ai co eu us uk de fr es it nl be ch at pt pl cz se no dk fi ie ru ua tr jp cn in au nz ca br mx ar cl za".split())
Found = "array<struct<kind: int, start: int, stop: int, base: boolean, x: array<float>>>"


class Span(NamedTuple):
    kind: int
    start: int
    stop: int
    base: bool


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(_SHAPE.findall(text))


def base_rule(kind: int, text: str) -> bool:
    if kind == IP:
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in text.split("."))
    digits = digits_of(text)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == CARD else 10 <= len(digits) <= 15


def possible(kind: int, text: str) -> bool:
    """Whether a disguised span can be of its kind at all."""
    if kind == EMAIL:
        return bool(_ENDING.search(text))
    return len(groups := _SHAPE.findall(text)) == 4 and base_rule(IP, ".".join(groups)) if kind == IP else base_rule(kind, text)


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, not overlapping; one look to the left of each @, so a long word costs no more than its length."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


#: Digits of the groups that cards are printed in.
_PRINTED = {(4, 4, 4, 4), (4, 6, 5), (4, 6, 4)}


def inside(kind: int, text: str, start: int) -> list[tuple[int, int]]:
    """Cards and phones within a match that failed its base rule. A card is one group of digits or a row of groups as cards are printed
    in, and passes its rule; a phone is the beginning up to a group's end. No window is longer than a card or phone, so the work is linear."""
    groups = [(start + m.start(), start + m.end()) for m in _SHAPE.finditer(text)]
    out = []
    if kind == CARD:
        for i, (a, b) in enumerate(groups):
            if 14 <= b - a <= 19 and luhn(text[a - start : b - start]):
                out.append((a, b))
            for k in (3, 4):
                row = groups[i : i + k]
                if tuple(y - x for x, y in row) in _PRINTED and luhn(digits_of(text[a - start : row[-1][1] - start])):
                    out.append((a, row[-1][1]))
    elif kind == PHONE:
        n = 0
        for a, b in groups:
            n += b - a
            if n > 15:
                break
            if n >= 10:
                out.append((start, b))
    return out


def matches(text: str) -> list[Span]:
    """What the base patterns match, whether or not the base rules hold, and what the others match."""
    found: list[Span] = []
    if "@" in text:
        found += [Span(EMAIL, a, b, True) for a, b in emails(text)]
    if _SHAPE.search(text):
        for kind, pattern in ((IP, _QUAD), (CARD, _DIGITS), (PHONE, _PLUS)):
            for m in pattern.finditer(text):
                if (ok := base_rule(kind, m[0])) or sum(map(str.isdigit, m[0])) >= 8:
                    found.append(Span(kind, m.start(), m.end(), ok))
                    if not ok:
                        found += [Span(kind, a, b, False) for a, b in inside(kind, m[0], m.start()) if (a, b) != m.span()]
        for kind, pattern in _MORE[1:]:
            found += [Span(kind, m.start(), m.end(), False) for m in pattern.finditer(text)]
    if " at " in text or " AT " in text or "at" in text and any(c in text for c in "[({<"):
        found += [Span(EMAIL, m.start(), m.end(), False) for m in _MORE[0][1].finditer(text)]
    base = sorted((s for s in found if s.base), key=lambda s: s.start)
    starts, reach = [s.start for s in base], [0, *accumulate((s.stop for s in base), max)]  # how far the first k base spans go
    return base + [s for s in found if not s.base and reach[bisect_left(starts, s.stop)] <= s.start]


def features(text: str, s: Span) -> list[float]:
    own, before, after = text[s.start : s.stop], text[max(0, s.start - CONTEXT) : s.start], text[s.stop : s.stop + CONTEXT]
    groups = [len(g) for g in _SHAPE.findall(own)]
    digits = digits_of(own)
    marks = {c for c in own if not c.isalnum()}
    return [
        *(float(s.kind == k) for k in range(4)), float(len(own)), float(len(digits)), float(len(groups)), float(max(groups, default=0)), float(min(groups, default=0)),
        float(len(marks)), float(any(c in own for c in "[({<")), float("." in own), float(" " in own), float(sum(map(str.isalpha, own))),
        float(bool(digits) and luhn(digits)), float(bool(groups) and all(int(g[:4]) <= 255 for g in _SHAPE.findall(own))), float(own[:2] == "00"), float(own[:1] == "("),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before.rstrip()[-1:] in "$€£#=/"), float(after.lstrip()[:1] in "%€$"),
        float(bool(_CUES[s.kind].search(before))), float(bool(_CUES[s.kind].search(after))), float(bool(_AGAINST.search(before))),
        float(bool(m := _ENDING.search(own)) and m[0].lower() in _ENDINGS), float(possible(s.kind, own)),
    ]


def disguises(kind: int, own: str) -> list[str]:
    """A base span in the forms of the other generators."""
    if kind == EMAIL:
        name, _, domain = own.partition("@")
        return [f"{name} at {domain.replace('.', ' dot ')}", f"{name} [at] {domain.replace('.', '[dot]')}", f"{name}(at){domain}", f"{name}[at]{domain}"]
    if kind == IP:
        return [own.replace(".", c) for c in ("[.]", " dot ", "(.)", " [dot] ")]
    digits = digits_of(own)
    if kind == CARD:
        return [c.join(digits[i : i + 4] for i in range(0, len(digits), 4)) for c in "._/"] if len(digits) == 16 else []
    local = digits[-10:-7], digits[-7:-4], digits[-4:]
    return ["({}) {}-{}".format(*local), ".".join(local), "-".join(local), " ".join(local), *([f"00{digits[:-10]} {' '.join(local)}"] if len(digits) > 10 else [])]


def made_rows(text: str, spans: list[Span]) -> list[list[float]]:
    """Features of disguised base spans that the generators find again whole."""
    out = []
    for s in spans:
        if s.base:
            before, after = text[max(0, s.start - CONTEXT) : s.start], text[s.stop : s.stop + CONTEXT]
            for k, own in enumerate(disguises(s.kind, text[s.start : s.stop])):
                cue = ("", f"{('email', 'ip', 'card', 'phone')[s.kind]}: ")[zlib.crc32(own.encode()) + k & 1]
                there = f"{before}{cue}{own}{after}"
                a = len(before) + len(cue)
                if any((f.kind, f.start, f.stop) == (s.kind, a, a + len(own)) for f in matches(there) if not f.base):
                    out.append(features(there, Span(s.kind, a, a + len(own), False)))
            if s.kind in (CARD, PHONE):  # and beside a number that hides it from the base pattern
                own = text[s.start : s.stop]
                there = f"{before}{own} {digits_of(own)}{after}"
                if any((f.kind, f.start, f.stop) == (s.kind, len(before), len(before) + len(own)) for f in matches(there) if not f.base):
                    out.append(features(there, Span(s.kind, len(before), len(before) + len(own), False)))
    return out


_PROSE = "the of and river they stone was then market in la de los una calle et les une avec der die und ist nicht report seen today said new from".split()


def _real(kind: int, rnd: random.Random) -> str:
    """An invented base span."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    if kind == EMAIL:
        name = "".join(rnd.choices(letters, k=rnd.randint(1, 10))) + rnd.choice(["", "", f".{rnd.randint(1, 99)}", "_" + rnd.choice(letters), "." + "".join(rnd.choices(letters, k=5))])
        host = ".".join("".join(rnd.choices(letters, k=rnd.randint(1, 9))) + rnd.choice(["", "", str(rnd.randint(1, 9))]) for _ in range(rnd.choice([1, 1, 2])))
        return f"{name}@{host}.{rnd.choice(sorted(_ENDINGS))}"
    if kind == IP:
        return ".".join(str(rnd.randint(0, rnd.choice([9, 99, 255]))) for _ in range(4))
    if kind == CARD:
        digits = rnd.choice("3456") + "".join(rnd.choices("0123456789", k=14))
        return digits + next(d for d in "0123456789" if luhn(digits + d))
    return f"+{rnd.choice(['1', '1', '44', '49', '34', '33', '351'])} ({rnd.randint(100, 999)}) {rnd.randint(0, 999):03d}-{rnd.randint(0, 9999):04d}"


def _counter(kind: int, rnd: random.Random) -> tuple[str, str]:
    """(lead, own): what a generator takes for its kind and is none."""
    number, lead = rnd.randint, rnd.choice
    if kind == EMAIL:
        word, end = rnd.choice(_PROSE), rnd.choice(["The", "then", "Matrix", "printer", "length", "value", "Und", "matrix"])
        return lead(["", "contact ", "look "]), lead([
            f"{word} at {rnd.choice(_PROSE)}.{end}", f"{word} at {rnd.choice(_PROSE)} dot {end}", f"{number(1, 90)} at {number(1, 23)}.{number(10, 59)}", f"{word} at {rnd.choice(_PROSE)}{number(1, 9)}.{rnd.choice(sorted(_ENDINGS))}",
            f"{word}[at]{rnd.choice(_PROSE)}.{end}", f"{word} (at) {number(1, 90)}.{number(10, 99)}", f"{word} [at] {rnd.choice(_PROSE)}[dot]{end}",
        ])
    if kind == IP:
        if rnd.random() < 0.6:
            parts = [str(number(0, 255)) for _ in range(4)]
            parts[rnd.randrange(4)] = str(number(256, 999))
            return lead(["", "", "ip ", "host ", "version "]), lead(["[.]", " dot ", "(.)", " [dot] "]).join(parts)
        return lead(["version ", "release ", "build ", "section ", "chapter ", "v "]), lead(["[.]", " dot ", "(.)", " [dot] "]).join(str(number(0, rnd.choice([9, 9, 30, 255]))) for _ in range(4))
    if kind == CARD:
        digits = _real(CARD, rnd)
        sep = lead("._/")
        if rnd.random() < 0.7:
            k = rnd.randrange(16)
            digits = digits[:k] + str((int(digits[k]) + number(1, 9)) % 10) + digits[k + 1 :]
            return lead(["", "", "card ", "order ", "serial "]), sep.join(digits[i : i + 4] for i in range(0, 16, 4))
        return lead(["order ", "invoice ", "serial ", "number "]), sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    day, month, year, clock = f"{number(1, 31):02d}", f"{number(1, 12):02d}", str(number(1950, 2049)), f"{number(0, 23):02d}{number(0, 59):02d}"
    local = f"{number(100, 999)}", f"{number(0, 999):03d}", f"{number(0, 9999):04d}"
    c = lead(".-/")
    return lead([
        (lead(["", "on ", "date ", "call "]), c.join((day, month, year))), (lead(["", "on ", "date "]), c.join((year, month, day))), (lead(["", "on ", "date ", "tel "]), c.join((year, month, day)) + " " + clock),
        (lead(["", "on ", "date "]), c.join((day, month, year)) + " " + clock), (lead(["", "total "]), f"{number(10, 999)} {number(0, 999):03d} {number(0, 999):03d} {number(0, 999):03d}"), (lead(["", "total "]), f"{number(10, 999)}.{number(0, 999):03d}.{number(0, 999):03d}.{number(0, 999):03d}"),
        (lead(["version ", "release ", "build "]), f"{number(10, 99)}.{number(10, 99)}.{number(10, 9999)}"), (lead(["order ", "invoice ", "serial ", "number "]), lead([*".- "]).join(local)), (lead(["order ", "invoice ", ""]), f"{number(10, 99)}-{number(1000, 9999)}-{number(10000, 99999)}"),
        (lead(["", "number "]), f"{number(100, 999)}-{number(10, 99)}-{number(1000, 9999)}"), (lead(["", "card "]), " ".join(f"{number(0, 9999):04d}" for _ in range(4))), (lead(["pages ", "section "]), f"{number(10, 999)}-{number(10, 999)} {number(10, 999)}"),
    ])


def _beside(kind: int, rnd: random.Random) -> tuple[str, str, str]:
    """(left, own, right): an invented card or phone that a number beside it hides from the base pattern."""
    card = _real(CARD, rnd)
    printed = rnd.choice([card, card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))])
    other = rnd.choice([card, _real(CARD, rnd), str(rnd.randrange(10**9, 10**10)), str(rnd.randrange(10**11, 10**12))])
    if kind == PHONE:
        return "", _real(PHONE, rnd), " " + rnd.choice([card, _real(CARD, rnd)])
    return ("", printed, " " + other) if rnd.random() < 0.5 else (other + " ", printed, "")


def _luhn_number(n: int, rnd: random.Random) -> str:
    digits = "".join(rnd.choices("0123456789", k=n - 1))
    return digits + next(d for d in "0123456789" if luhn(digits + d))


def _junk(kind: int, rnd: random.Random) -> tuple[str, str]:
    """(lead, own): rows of digits in which something passes the rule of a kind by chance alone."""
    lead = rnd.choice(["order ", "serial ", "invoice ", "number ", "total ", "ref "])
    if kind == CARD:
        n = rnd.choice([14, 15, 16, 17, 18, 19])
        return lead, rnd.choice([f"{rnd.randrange(10**5)} {_luhn_number(n, rnd)} {rnd.randrange(10**4)}", f"{_luhn_number(n, rnd)} {rnd.randrange(10**7)}", f"{rnd.randrange(10, 10**4)}-{_luhn_number(n, rnd)}-{rnd.randrange(10, 10**4)}"])
    return lead, "+" + " ".join(str(rnd.randrange(10 ** rnd.randint(2, 5))) for _ in range(rnd.randint(6, 9)))


@lru_cache(maxsize=1)
def invented(each: int = MADE) -> tuple[np.ndarray, np.ndarray]:
    """Features and classes of `each` invented rows of each class and kind, always the same ones."""
    rnd, x, y = random.Random(9), [], []
    for kind in range(4):
        for label in (0, 1):
            n = 0
            while n < each:
                before = " ".join(rnd.choices(_PROSE, k=6)) + rnd.choice([" ", " ", ", ", ". ", ": "])
                left, right, hidden = "", "", kind in (CARD, PHONE) and rnd.random() < 0.4
                if label == 0:
                    lead, own = _junk(kind, rnd) if hidden else _counter(kind, rnd)
                else:
                    lead, own = rnd.choice(["", "", f"{KINDS[kind]} ", f"{KINDS[kind]}: "]), rnd.choice(disguises(kind, _real(kind, rnd)))
                    if hidden:
                        left, own, right = _beside(kind, rnd)
                text = f"{before}{lead}{left}{own}{right}{rnd.choice([' ', ' ', ', ', '. ', '; '])}{' '.join(rnd.choices(_PROSE, k=6))}"
                a = len(before) + len(lead) + len(left)
                for s in matches(text):
                    if not s.base and s.kind == kind and ((s.start, s.stop) == (a, a + len(own)) if label else s.start < a + len(own) and a < s.stop) and n < each:
                        x.append(features(text, s))
                        y.append(label)
                        n += 1
    return np.array(x, np.float32).astype(np.float64), np.array(y, np.float64)


class Model(NamedTuple):
    trees: Trees
    thresholds: tuple[float, ...]


def fit(found: DataFrame, sample: int = SAMPLE, precision: float = PRECISION) -> Model:
    """From the candidates of all documents and the invented ones; `sample` rows of each class come to the driver."""
    x, y = invented()
    parts = [(x, y)]
    columns = F.expr("transform(filter(found, s -> not s.base and element_at(s.x, -1) = 0), s -> s.x)"), F.col("made")
    sizes = found.agg(*(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(f"n{k}") for k, c in enumerate(columns))).first()
    for name, column in enumerate(columns):
        rows = found.select("id", F.posexplode(column).alias("k", "x"))
        place = F.pmod(F.xxhash64("id", "k"), F.lit(1 << 40))
        # about as many rows as are wanted reach the last sort, whatever the number of tasks
        share = min(1.0, (sample + 6 * sample**0.5 + 100) / max(1, sizes[name]))
        rows = rows.where(place < int(share * (1 << 40))).orderBy(place, F.xxhash64("id", "k"), "x").limit(sample).collect()
        if rows:
            parts.append((np.array([r["x"] for r in rows], np.float64), np.full(len(rows), float(name))))
    own = np.arange(sum(len(p[1]) for p in parts)) < len(y)
    x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    held = np.array([zlib.crc32(r.tobytes()) % 10 < 3 for r in x])
    again = np.where(own, -(-len(x) // own.sum()), 1)[~held]  # neither part outweighs the other
    trees = boost(np.repeat(x[~held], again, axis=0), np.repeat(y[~held], again))
    scores, of_kind = trees.score(x), x[:, :4].argmax(1)
    limits = tuple(max(0.5, *(threshold_for(scores[of], y[of], precision) for of in (held & (of_kind == k), held & own & (of_kind == k)))) for k in range(4))
    if max(limits) > 1:
        raise RuntimeError(f"no threshold holds a precision of {precision} for {[KINDS[k] for k in range(4) if limits[k] > 1]}")
    return Model(trees, limits)


def spans_of(text: str | None) -> list[dict]:
    """What was found in a text, with features for all but base spans."""
    return [{**s._asdict(), "x": [] if s.base else features(text, s)} for s in matches(text)] if text else []


def find_candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row a document: id, found spans with features, features of disguised base spans."""

    def make():
        def one(text):
            found = spans_of(text)
            return found, made_rows(text, [Span(s["kind"], s["start"], s["stop"], s["base"]) for s in found])

        def work(ids, texts):
            return ids, *zip(*map(one, texts), strict=True)

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")), make, f"id {kind}, found {Found}, made array<array<float>>")


def choose(found: list[dict], model: Model) -> list[tuple[int, int, int]]:
    """The base spans and the added ones, as (start, kind, stop) in order."""
    base = [(s["start"], s["kind"], s["stop"]) for s in found if s["base"]]
    rest = [s for s in found if not s["base"]]
    taken: list[tuple[int, int, int]] = []  # none overlaps another, or a base span: candidates that do are not proposed
    if rest:
        scores = model.trees.score(np.array([s["x"] for s in rest], np.float64))
        for score, s in sorted(zip(scores.tolist(), rest, strict=True), key=lambda p: (-p[0], p[1]["start"], p[1]["kind"], p[1]["stop"])):
            k = bisect_left(taken, (s["stop"],))
            if score >= model.thresholds[s["kind"]] and (k == 0 or taken[k - 1][2] <= s["start"]):
                insort(taken, (s["start"], s["kind"], s["stop"]))
    return sorted(base + taken)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """One row a document: id, base and all spans as arrays of (kind, start, stop) by start, then kind."""
    found = materialise(find_candidates(docs, id_col, text_col), "spans")
    model = fit(found, **fitting)

    def make():
        def shown(spans):
            return [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in spans]

        def work(ids, lists):
            base = [sorted((s["start"], s["kind"], s["stop"]) for s in x if s["base"]) for x in lists]
            return ids, list(map(shown, base)), [shown(choose(x, model)) for x in lists]

        return work

    kind = dict(docs.dtypes)[id_col]
    spans = "array<struct<kind: string, start: long, stop: long>>"
    return map_batches(found.select("id", "found"), make, f"id {kind}, base {spans}, spans {spans}").withColumnRenamed("id", id_col)


def redact(text: str | None, spans: list[dict]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    if not text or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"<{s['kind'].upper()}>"]
        at = max(at, s["stop"])
    return "".join(out) + text[at:]


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fitting) -> DataFrame:
    """The documents with their text redacted; all columns stay. No shuffle but for the fitting sample."""
    model = fit(materialise(find_candidates(docs, id_col, text_col), "spans"), **fitting)

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        def one(text):
            return redact(text, [{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in choose(spans_of(text), model)])

        return texts.map(one, na_action="ignore")

    return docs.withColumn(text_col, redacted(F.col(text_col).cast("string")))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and hash of the base spans, and all spans as one string."""

    def joined(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")

    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
