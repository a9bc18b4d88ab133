"""Best-fit packing of documents into fixed-length sequences by hierarchical residual packing.

A document is its token ids and one end id. Documents longer than the capacity are cut so that all
pieces but the first are full. A hash deals the pieces, narrow rows without their ids, into groups of about `GROUP_ROWS`,
so that long and short pieces of different files meet; each group packs its pieces best-fit decreasing. Nearly full bins are
final. The others are items of a tree: `FAN` neighbouring groups merge into one, which packs their open bins, whole, best-fit
decreasing into one another, and so on up to one group. Pieces move only once, when all merges are known.

A bin more than half full can only take in bins that are at most half full, and of those a packed group has one at most, since
two of them would share a bin. So below a node that merges `FAN` groups come `FAN` light bins at most, and whatever fits
any heavy bin fits the emptiest. A group hands up its light bin and its `FAN` emptiest heavy bins a level still to come; no merge is lost
by that, and a task of the tree holds at most FAN * (1 + FAN * levels) bins, however many pieces there are.

Waste: each group is packed best-fit decreasing, within 11/9 of its own best number of bins and one more, and in practice within a
percent of all pieces packed at once; over all groups at most one bin is at most half full.

Null and empty texts are the end id alone. Empty tables give no rows. Repeated rows are packed each for
itself. Very long texts are cut and packed whole. Further input columns are ignored.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import read_ranks
from .common import join_list, map_batches, materialise

#: A bin this close to the capacity is final.
SLACK = 8
#: Pieces that a group packs, on average.
GROUP_ROWS = 50_000
#: Groups that merge into one at each level of the tree.
FAN = 8

ITEM = "row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long, grp long, up boolean"
#: An open bin, the bin that takes it in (itself: none), where it begins there, and what that holds then.
OPEN = "bin long, used long, grp long, up boolean, into long, shift long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset. A bit mask tells which residues have open bins."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, n_bins = 0, 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                mask ^= 1 << room
        else:
            room, b, n_bins = capacity, n_bins, n_bins + 1
        bins[k], offsets[k] = b, capacity - room
        if room > size:
            open_bins[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets


def to_hand_up(used: np.ndarray, capacity: int, most_heavy: int) -> np.ndarray:
    """Which bins go on to the next level: those at most half full and the emptiest heavy ones."""
    heavy = np.flatnonzero((2 * used > capacity) & (used < capacity - SLACK))
    up = 2 * used <= capacity
    up[heavy[np.argsort(used[heavy], kind="stable")[:most_heavy]]] = True
    return up


def pack(pieces: DataFrame, capacity: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """pieces: row, doc_id, piece, start, length, ids_crc32, materialised. Adds sequence_id and offset."""
    schema = ITEM.format(kind=dict(pieces.dtypes)["doc_id"])
    groups = max(1, -(-pieces.count() // group_rows))
    levels, width = 0, groups
    while width > 1:
        levels, width = levels + 1, -(-width // FAN)

    def local(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("row", ignore_index=True)  # in one order, whatever order the rows come in
        to, offset = best_fit(items["length"].to_numpy(), capacity)
        used = np.bincount(to, weights=items["length"]).astype(np.int64)
        up = to_hand_up(used, capacity, FAN * levels)[to] & (offset == 0)  # a bin's first piece stands for it
        return items.assign(bin=items["grp"] * (1 << 32) + to, offset=offset, used=used[to], up=up)

    def merged(above: int):
        def merge(bins: pd.DataFrame) -> pd.DataFrame:
            bins = bins.sort_values("bin", ignore_index=True)
            to, shift = best_fit(bins["used"].to_numpy(), capacity)
            used = np.bincount(to, weights=bins["used"]).astype(np.int64)
            first = np.zeros(len(used), np.int64)
            first[to[shift == 0]] = bins["bin"][shift == 0]
            up = to_hand_up(used, capacity, FAN * above)[to] & (shift == 0)
            return bins.assign(used=used[to], up=up, into=first[to], shift=shift)

        return merge

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))
    placed = materialise(dealt.groupBy("grp").applyInPandas(local, schema), "pack-0")
    left, taken_in = placed.where("up").select("bin", "used", "grp", "up"), []
    for level in range(1, levels + 1):
        up = left.select("bin", "used", (F.col("grp") / FAN).cast("long").alias("grp"), "up")
        tree = materialise(up.groupBy("grp").applyInPandas(merged(levels - level), OPEN), f"pack-{level}")
        taken_in.append(tree.where("into <> bin").select("bin", "into", "shift"))
        left = tree.where("up")
    moves = None
    for own in reversed(taken_in):  # where a bin went may itself have gone on at a later level
        if moves is not None:
            on = moves.select(F.col("bin").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
            gone = own.join(on, "into", "left").select("bin", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
            own = gone.unionByName(moves)
        moves = own
    if moves is not None:
        placed = join_list(placed, materialise(moves, "pack-moves"), "bin", "left")
        placed = placed.withColumns({"bin": F.coalesce("into", "bin"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))})
    return placed.select("row", "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")


@lru_cache(maxsize=2)
def _encoder(ranks_path: str, tokenizer_path: str | None, pattern: str):
    """text -> numpy ids. Texts that hold the string of a special token go through the tokenizer's own file."""
    import tiktoken

    plain = tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    slow, special = None, []
    if tokenizer_path:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(tokenizer_path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return plain.encode_to_numpy(text, disallowed_special=())

    return encode


def token_pieces(
    docs: DataFrame, ranks_path: str, tokenizer_path: str | None, pattern: str, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Each document's ids and end id, cut into pieces of at most `capacity`."""

    def make():
        encode, end = _encoder(ranks_path, tokenizer_path, pattern), np.array([end_id], np.uint32)

        def work(keys, texts):
            out = []
            for key, text in zip(keys, texts, strict=True):
                ids = np.concatenate([encode(text), end]) if text else end
                head = len(ids) % capacity or capacity
                bounds = [0, *range(head, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    own = ids[a:b].astype("<u4")
                    out.append((key, k, a, b - a, zlib.crc32(own.tobytes()), *([own.tolist()] if with_ids else [])))
            return zip(*out, strict=True)

        return work

    kind = dict(docs.dtypes)[id_col]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    cut = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string")), make, schema)
    return cut.withColumn("row", F.monotonically_increasing_id())


def pack_documents(
    docs: DataFrame, ranks_path: str, tokenizer_path: str | None, pattern: str, capacity: int = 2048, end_id: int = 0,
    id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if asked for, ids."""
    pieces = materialise(token_pieces(docs, ranks_path, tokenizer_path, pattern, capacity, end_id, id_col, text_col, with_ids), "pieces")
    placed = pack(pieces.drop("ids"), capacity, group_rows)
    if with_ids:
        placed = placed.join(pieces.select("row", "ids"), "row")
    return placed.drop("row").withColumnRenamed("doc_id", id_col)
