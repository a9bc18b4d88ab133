"""Conversation structure repair: the cheapest edits that make the roles of a conversation take turns.

Edits of a row are Keep, Rerole (to user or assistant) and Delete; Insert puts an empty row of user or assistant anywhere.
The repaired roles' initials must read `(s?(ua)+)?`. One integer is the weight of a way to the end of a conversation:
its high digits are the cost, its low digits, eight bits each, are the letters of the edits in their order, at fixed
places with zeros behind the last. Prefixing an edit adds its cost above and moves the letters behind it by one place, so
an ordinary minimum of integers over the graph of (row, what the last kept role was) finds the least cost and, among equal
costs, the ASCII-least letters, a shorter string before what it begins. No other rule breaks ties.

At scale a conversation may be of any length. Rows are dealt by ranges of (conversation, turn, ...), so that a very long
one is spread over many tasks; a task cuts what it holds into blocks of at most `BLOCK_ROWS` rows and weighs each block
from each state to each state. Two ways through one block between the same states never cost the same with one's letters
beginning the other's (the rest would be inserts, which cost), so the least way of a block is the same whatever follows, and
blocks compose. Only what a block's ends and letters say is then brought together, a few hundred bytes for 512 rows; a
conversation's letters, which are one cell of the result, are its only part that one task must hold. The hash of a repaired text is
sequential by its nature: the blocks of a conversation that was cut stream through one task in order, a batch at a time.
Conversations that lie whole in one block, nearly all, are finished where they are read.

Faults: a row is blank if its text has no character but spaces and \\t\\n\\v\\f\\r, else a duplicate if a row before it in the
conversation has its role and text, else truncated if its last other character is not one of `.!?`. Blank and duplicate rows must go.

Null ids, turns, roles and texts: a null turn comes first and counts in no gap; null roles and texts read as one space; a
null conversation id is a conversation of its own. Rows of the same turn stand in the order of role, then text. An empty role
has no initial: it can be reroled or deleted, and a pair with it is illegal. Empty texts are blank; very long ones are never cut.
Repeated rows are duplicates. Empty tables give no rows. Further input columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import discard, materialise, small_batches

#: Rows and characters of a block at most (a longer text is a block of its own).
BLOCK_ROWS, BLOCK_CHARS = 512, 4 << 20
#: Conversations of up to so many rows have their edits remembered by roles and faults.
SHORT, REMEMBERED = 16, 50_000
DELETE, INSERT, KEEP, REROLE = b"DIKR"
#: What stands before: nothing, a system row, a user row, an assistant row. The role that may be put next, and what then stands before.
STATES = range(4)
PUT = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
#: By state, the initials that may be kept, and what then stands before.
FITS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The cheapest end of a conversation in each state.
ENDS = ((0, b""), (4, b"II"), (2, b"I"), (0, b""))
SPACE = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")


def cheapest(rows: tuple[tuple[str, str], ...], ends: tuple[tuple[int, bytes] | None, ...]) -> list[tuple[int, bytes] | None]:
    """(cost, letters) of the least way from each state before `rows`, which are (initial, fault), to `ends` by state."""
    digits = 3 * len(rows) + 2  # two inserts side by side are a pair of turns that can be left out, so two before a row are enough
    bits = 8 * digits
    low = (1 << bits) - 1
    first = bits - 8

    def prefixed(letter: int, cost: int, weight: int | None) -> int | None:
        return None if weight is None else (((weight >> bits) + cost) << bits) | (letter << first) | ((weight & low) >> 8)

    def least(*weights: int | None) -> int | None:
        return min((w for w in weights if w is not None), default=None)

    after = [None if e is None else (e[0] << bits) | int.from_bytes(e[1].ljust(digits, b"\0"), "big") for e in ends]
    for initial, fault in reversed(rows):
        here = []
        for state in STATES:
            ways = [prefixed(DELETE, 3, after[state])]
            if fault not in ("blank", "duplicate"):
                extra = int(fault == "truncated")
                ways.append(prefixed(REROLE, 2 + extra, after[PUT[state][1]]))
                if initial in FITS[state]:
                    ways.append(prefixed(KEEP, extra, after[FITS[state][initial]]))
            here.append(least(*ways))
        one = [prefixed(INSERT, 2, here[PUT[state][1]]) for state in STATES]
        two = [prefixed(INSERT, 2, one[PUT[state][1]]) for state in STATES]
        after = [least(*ways) for ways in zip(here, one, two, strict=True)]
    return [None if w is None else (w >> bits, (w & low).to_bytes(digits, "big").rstrip(b"\0")) for w in after]


@lru_cache(REMEMBERED)
def _short(rows: tuple[tuple[str, str], ...]) -> tuple[int, bytes]:
    return cheapest(rows, ENDS)[0]


def repaired(letters: bytes, state: int, rows: Iterator[tuple[str, str]]) -> tuple[list[str], int]:
    """The lines that the edits leave of rows (role, text), and the state after them."""
    lines, rows = [], iter(rows)
    for letter in letters:
        role, text = ("", "") if letter == INSERT else next(rows)
        if letter in (INSERT, REROLE):
            role, state = PUT[state]
        elif letter == KEEP:
            state = FITS[state][role[0]]
        if letter != DELETE:
            lines.append(f"{role}:{text}")
    return lines, state


_COUNTS = ("blank", "duplicate", "truncated")


class Block:
    """Rows of one conversation that follow each other."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str, str]] = []  # role, text, fault
        self.turns: list[int] = []  # distinct, in order, without null
        self.chars = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.rows.append((role, text, fault))
        self.chars += len(text)
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)

    def full(self) -> bool:
        return len(self.rows) >= BLOCK_ROWS or self.chars >= BLOCK_CHARS

    def summary(self) -> dict:
        initials = [role[:1] for role, _, _ in self.rows]
        out = {k: sum(fault == k for _, _, fault in self.rows) for k in _COUNTS}
        out["illegal"] = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))
        return out | {"n_turns": len(self.turns), "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None, "n": len(initials), "ends": initials[:1] + initials[-1:]}

    def signature(self) -> tuple[tuple[str, str], ...]:
        return tuple((role[:1], fault) for role, _, fault in self.rows)

    def finished(self) -> dict:
        """The result of a conversation that is this block alone."""
        signature = self.signature()
        cost, letters = _short(signature) if len(signature) <= SHORT else cheapest(signature, ENDS)[0]
        lines, _ = repaired(letters, 0, ((role, text) for role, text, _ in self.rows))
        return joined([self.summary()]) | {"cost": cost, "audit": letters.decode(), "repaired_sha256": sha256("\n".join(lines).encode()).hexdigest()}

    def part(self) -> dict:
        """What is kept of a block of a conversation that was cut: sums, the least ways between states, and its rows."""
        signature = self.signature()
        ways = []
        for end in STATES:
            found = cheapest(signature, tuple((0, b"") if s == end else None for s in STATES))
            ways += [{"start": s, "end": end, "cost": w[0], "letters": w[1]} for s, w in enumerate(found) if w]
        return {"summary": self.summary(), "ways": ways, "roles": [r for r, _, _ in self.rows], "texts": [t for _, t, _ in self.rows]}


def joined(summaries: list[dict]) -> dict:
    """Counts of a conversation from those of its blocks in order."""
    out = {k: sum(s[k] for s in summaries) for k in (*_COUNTS, "illegal")}
    used = [s for s in summaries if s["n"]]
    out["illegal"] += sum(a["ends"][1] + b["ends"][0] not in LEGAL for a, b in zip(used, used[1:], strict=False))
    timed = [s for s in summaries if s["n_turns"]]
    turns = sum(s["n_turns"] for s in timed) - sum(a["last_turn"] == b["first_turn"] for a, b in zip(timed, timed[1:], strict=False))
    return out | {"gaps": timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - turns if timed else 0}


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_SUMMARY = "blank: long, duplicate: long, truncated: long, illegal: long, n_turns: long, first_turn: long, last_turn: long, n: long, ends: array<string>"
_WAY = "start: int, end: int, cost: long, letters: binary"


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turn, role, text, row, copy, gone: the rows with the faults that their ids' checksum decides. A dropped row stays as `gone`."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conv, turn)))
    fault = F.crc32(key.cast("binary")) % 20
    out = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), fault.alias("fault"), F.monotonically_increasing_id().alias("row"),
    )
    text = F.when(F.col("fault") <= 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv", "turn", role.alias("role"), text.alias("text"), "row", F.explode(copies).alias("copy"), (F.col("fault") == 0).alias("gone"))


def as_given(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The rows without damage, in the form of `damaged`."""
    return rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"), F.monotonically_increasing_id().alias("row"), F.lit(0).alias("copy"), F.lit(False).alias("gone"),
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, row, copy, gone, fault. An earlier equal row is found by 128 bits of role and text."""
    trimmed = F.rtrim("text", F.lit(SPACE))
    keys = {f"key{k}": F.xxhash64(F.lit(k), F.octet_length("role"), F.concat("role", "text")) for k in range(2)}
    place = F.struct(F.col("turn").isNotNull().alias("timed"), F.coalesce("turn", F.lit(0)).alias("at"), "row", "copy")
    rows = rows.withColumns({**keys, "place": place})
    firsts = rows.where("not gone").groupBy("conv", *keys).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("conv").alias("of"), *(F.col(k).alias(f"f{k}") for k in keys), "first")
    same: Column = F.col("conv").eqNullSafe(F.col("of"))
    for k in keys:
        same &= F.col(k) == F.col(f"f{k}")
    fault = F.when(trimmed == "", "blank").when(F.col("place") > F.col("first"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("")
    return rows.join(firsts, same, "left").select("conv", "turn", "role", "text", "row", "copy", "gone", fault.alias("fault"))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", damage=as_given) -> DataFrame:
    """One row a conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    kind = rows.schema[conv_col].dataType.simpleString()
    found = materialise(damage(rows, conv_col, turn_col, role_col, text_col), "turns")
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row", "copy"]
    ordered = with_faults(found).repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "role", "text", "gone", "fault")
    schema = f"conv {kind}, part int, nth int, whole boolean, {_RESULT}, summary struct<{_SUMMARY}>, ways array<struct<{_WAY}>>, roles array<string>, texts array<string>"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        block, conv, nth, edge = None, None, 0, True
        out: list[dict] = []

        def close(last: bool) -> None:
            whole = last and nth == 0 and not edge
            out.append({"conv": conv, "part": number, "nth": nth, "whole": whole} | (block.finished() if whole else block.part()))

        def ready() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pylist(out, schema=arrow)
            out.clear()
            return batch

        for batch in batches:
            for own, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None:
                    block, conv = Block(), own
                elif own != conv:
                    close(True)
                    block, conv, nth, edge = Block(), own, 0, False  # what a task begins with may have begun before
                elif block.full():
                    close(False)
                    block, nth = Block(), nth + 1
                if not gone:
                    block.add(turn, role, text, fault)
            if out:  # no more than the batch and what was held of the last block
                yield ready()
        if block is not None:
            edge = True  # and what it ends with may go on
            close(True)
        if out:
            yield ready()

    small_batches(rows.sparkSession)
    blocks = materialise(ordered.mapInArrow(run, schema), "turn-blocks")
    discard(found)
    whole = blocks.where("whole").select("conv", *_names(_RESULT))
    cut = _of_blocks(blocks.where("not whole"), kind)
    return whole.unionByName(cut).withColumnRenamed("conv", conv_col)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _of_blocks(blocks: DataFrame, kind: str) -> DataFrame:
    """The results of conversations that were cut into blocks."""
    chosen = f"conv {kind}, {_RESULT}, steps array<struct<part: int, nth: int, start: int, letters: binary>>"
    arrow = to_arrow_schema(_parse_datatype_string(chosen))

    def compose(key: tuple, own: pa.Table) -> pa.Table:
        parts = sorted(own.to_pylist(), key=lambda b: (b["part"], b["nth"]))
        least: dict[int, tuple[int, bytes]] = {0: (0, b"")}
        came: list[dict[int, tuple[int, bytes]]] = []  # for each block, by its end: the state before and the block's letters
        for b in parts:
            after, via = {}, {}
            for w in b["ways"]:
                if w["start"] in least:
                    cost, letters = least[w["start"]]
                    weight = (cost + w["cost"], letters + w["letters"])
                    if w["end"] not in after or weight < after[w["end"]]:
                        after[w["end"]], via[w["end"]] = weight, (w["start"], w["letters"])
            least = after
            came.append(via)
        (cost, letters), state = min(((least[s][0] + ENDS[s][0], least[s][1] + ENDS[s][1]), s) for s in least)
        steps = [{"part": 2**31 - 1, "nth": 0, "start": state, "letters": ENDS[state][1]}]
        for b, via in zip(reversed(parts), reversed(came), strict=True):
            state, own_letters = via[state]
            steps.append({"part": b["part"], "nth": b["nth"], "start": state, "letters": own_letters})
        row = {"conv": key[0].as_py(), "cost": cost, "audit": letters.decode(), "steps": steps} | joined([b["summary"] for b in parts])
        return pa.Table.from_pylist([row], schema=arrow)

    merged = materialise(blocks.select("conv", "part", "nth", "summary", "ways").groupBy("conv").applyInArrow(compose, chosen), "turn-ways")
    steps = merged.select("conv", F.inline("steps"))
    texts = blocks.select(F.col("conv").alias("of"), F.col("part").alias("at"), F.col("nth").alias("no"), "roles", "texts")
    pieces = steps.join(texts, F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at")) & (F.col("nth") == F.col("no")), "left")
    pieces = pieces.repartition("conv").sortWithinPartitions("conv", "part", "nth").select("conv", "start", "letters", "roles", "texts")
    hashed = to_arrow_schema(_parse_datatype_string(f"conv {kind}, sha string"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, any_line = None, None, False
        for batch in batches:
            done = []
            for own, start, letters, roles, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or own != conv:
                    if state is not None:
                        done.append({"conv": conv, "sha": state.hexdigest()})
                    conv, state, any_line = own, sha256(), False
                lines, _ = repaired(letters, start, zip(roles or [], texts or [], strict=True))
                if lines:
                    state.update((("\n" if any_line else "") + "\n".join(lines)).encode())
                    any_line = True
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=hashed)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv": conv, "sha": state.hexdigest()}], schema=hashed)

    shas = pieces.mapInArrow(digest, f"conv {kind}, sha string").withColumnRenamed("conv", "of")
    out = merged.drop("repaired_sha256").join(shas, F.col("conv").eqNullSafe(F.col("of")))
    return out.withColumn("repaired_sha256", F.col("sha")).select("conv", *_names(_RESULT))
