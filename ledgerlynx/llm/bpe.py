"""Byte-level BPE encoding and decoding by a rank file.

A text is split by the vocabulary's pattern. Two tiers resolve a pre-token: a minimal perfect hash
finds those that are themselves in the vocabulary; the rest start as single bytes in a linked list,
and a heap yields the adjacent pair of lowest rank (leftmost first) until no pair has a rank. A memo
of bounded size keeps what the tiers gave for recent pre-tokens. Decoding joins the ids' bytes.

Null and empty texts have no ids; the hashes are then those of nothing. Very long texts, and very long
pre-tokens, are encoded whole: the heap takes n log n steps. Repeated rows give repeated results; further
input columns are ignored.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from hashlib import sha256
from heapq import heapify, heappop, heappush
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Pre-tokens that a task remembers.
MEMO = 400_000
#: A 128-bit hash gives a bucket, a base and a step: 42, 42 and 44 bits.
LOW = (1 << 42) - 1


class PerfectHash:
    """A minimal perfect hash of byte strings: as many slots as keys, two array reads a lookup.

    Keys fall into buckets; each bucket, the largest first, gets the first displacement that moves all
    its keys to free slots. Buckets of one key name their slot directly, as a negative number."""

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 2):
        from xxhash import xxh3_128_intdigest

        self.n, self.n_buckets = max(1, len(ranks)), max(1, len(ranks) // per_bucket)
        buckets: list[list[tuple[int, int, bytes]]] = [[] for _ in range(self.n_buckets)]
        for key in ranks:
            h = xxh3_128_intdigest(key)
            buckets[(h & LOW) % self.n_buckets].append(((h >> 42) & LOW, (h >> 84) | 1, key))
        self.shift = [0] * self.n_buckets
        self.keys: list[bytes | None] = [None] * self.n
        self.ranks = [-1] * self.n
        order = sorted(range(self.n_buckets), key=lambda b: -len(buckets[b]))
        free = iter(range(self.n))
        for b in order:
            own = buckets[b]
            if len(own) > 1:
                d = 0
                while len({s for base, step, _ in own if self.keys[s := (base + d * step) % self.n] is None}) < len(own):
                    d += 1
                self.shift[b] = d
                places = [(base + d * step) % self.n for base, step, _ in own]
            elif own:
                places = [next(s for s in free if self.keys[s] is None)]
                self.shift[b] = -places[0] - 1
            else:
                continue
            for s, (_, _, key) in zip(places, own, strict=True):
                self.keys[s], self.ranks[s] = key, ranks[key]

    def lookup(self):
        """A function key -> rank, or -1."""
        from xxhash import xxh3_128_intdigest

        n, n_buckets, shift, keys, ranks = self.n, self.n_buckets, self.shift, self.keys, self.ranks

        def rank(key: bytes) -> int:
            h = xxh3_128_intdigest(key)
            d = shift[(h & LOW) % n_buckets]
            s = -d - 1 if d < 0 else (((h >> 42) & LOW) + d * ((h >> 84) | 1)) % n
            return ranks[s] if keys[s] == key else -1

        return rank


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The ids of a pre-token that isn't in the vocabulary."""
    rank, n = ranks.get, len(piece)
    end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = after[i]
        if not end[i] or j >= n or end[j] != stop:
            continue  # one of its parts has been merged since
        end[i], end[j], after[i] = stop, 0, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := rank(piece[i : end[after[i]]])) is not None:
                heappush(heap, (r, i, end[after[i]]))
        if before[i] >= 0 and (r := rank(piece[before[i] : stop])) is not None:
            heappush(heap, (r, before[i], stop))
    return tuple(ranks[piece[i : end[i]]] for i in range(n) if end[i])


class Memo(dict):
    """Pre-token -> ids."""

    def __init__(self, rank, ranks: dict[bytes, int], most: int = MEMO):
        super().__init__()
        self.rank, self.ranks, self.most = rank, ranks, most

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        raw = piece.encode()
        whole = self.rank(raw)
        ids = (whole,) if whole >= 0 else merge(raw, self.ranks)
        if len(piece) <= 256:
            self[piece] = ids
        return ids


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes by the rank file at `path`."""

    def __init__(self, path: str, pattern: str):
        import regex

        ranks = read_ranks(path)
        self.words = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.words[i] = token
        self.memo = Memo(PerfectHash(ranks).lookup(), ranks)
        self.find = regex.compile(pattern).findall

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.memo.__getitem__, self.find(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(maxsize=2)
def codec_of(path: str, pattern: str) -> Codec:
    """A Python worker keeps its codec, and so its memo, from task to task."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row a document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids. No shuffle."""

    def make():
        codec = codec_of(path, pattern)
        names = list(map(str, range(len(codec.words))))

        def one(text):
            ids = codec.encode(text or "")
            shown = ",".join(map(names.__getitem__, ids)).encode()
            return len(ids), sha256(shown).hexdigest(), sha256(codec.decode(ids)).hexdigest(), *([ids] if with_ids else [])

        def work(keys, texts):
            return keys, *zip(*map(one, texts), strict=True)

        return work

    kind = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), make, schema)
