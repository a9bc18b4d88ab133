"""Exact n-gram Jaccard join by adaptive multi-match prefixes, up to connectivity.

Documents become sets of hashed 5-word shingles (64 bits). Documents with equal sets form one class, which its
smallest id stands for; sets are told apart by 128 bits. Every set is ordered by how frequent its shingles are (a
bounded count sketch over all documents; ties by hash), rarest first. Two sets of n and m shingles with a Jaccard
similarity of t or more share at least l shingles within their first n - ceil(t n) + l and m - ceil(t m) + l ones.
Each document chooses its l from 1 to `MOST_L`: a longer prefix reads more, but leaves fewer candidates; the sketch
tells both. A pair is then a candidate if its prefixes share as many shingles as the smaller of both l.

Components need not have all pairs. First, in stars, each holder of a prefix shingle meets only that
shingle's first holder, the smallest set, so a group of thousands of near copies costs thousands of
checks; where the holders that then stand apart would make many more pairs than there are holders, each meets a
few random leads, and where that is still so, the best linked leads. Then holders of a shingle
in different components meet one by one under the full count rule. Only the last step must be
complete, and it is, so no link that joins two components is lost and pairs within one are not formed.

Candidates are checked in two steps. Each set has a parity bitmap of about as many bits as shingles; bits in which
two bitmaps differ are at most the shingles in which the sets differ, so pairs that differ in too many are out for
certain. Only the sets of the pairs left are shingled again and compared whole. Under crowded shingles the bitmaps
go with the postings, so pairs that are out for certain are not formed there.

Null and empty texts have no set and are linked with nothing. Texts of fewer than five words are one
shingle. Empty tables give no rows. Repeated rows are linked as any equal texts are; rows with equal ids are one
document. Very long texts are read whole. Null ids are kept as rows that stand for themselves and link nothing. Further
input columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import discard, join_list, map_batches, materialise, small_batches, utf8, with_ids
from .graph import components

WORDS = 5
THRESHOLD = 75  # per cent
#: Longest prefix extension, and counters of the sketch.
MOST_L, SKETCH_BITS = 4, 16
#: Estimated cost of a check against that of reading a posting.
CHECK_COST = 4.0
#: Leads of a shingle in a round.
LEADS = 8
#: Holders from which a shingle's group is large, and pairs a holder from which it is crowded.
LARGE, CROWD = 64, 8
#: Bits of a shingle's place in its prefix; a text of Spark's largest size has fewer words.
PLACE_BITS = 30
#: Fewest bits of a set's parity bitmap, and pairs of a set from which it is dealt to several tasks.
LEAST_BITS, HOT_PAIRS = 512, 256
#: Words of a bitmap that goes with a posting. Bitmaps of over twice as many stay behind: pairs of such sets meet them after they are formed.
CARRIED = LEAST_BITS // 64
#: Word hashes that a task remembers.
MEMO = 300_000

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _A
    h = (h ^ (h >> np.uint64(29))) * _B
    return h ^ (h >> np.uint64(32))


class Shingler:
    """UTF-8 texts -> sorted arrays of distinct shingle hashes."""

    def __init__(self, width: int = WORDS):
        from xxhash import xxh3_64_intdigest

        self.width, self.hash, self.memo = width, xxh3_64_intdigest, {}

    def words(self, text: bytes) -> list[int]:
        memo, out = self.memo, []
        if len(memo) > MEMO:
            memo.clear()
        for w in text.lower().split():  # bytes: A-Z only, and \x20 and \x09-\x0D
            h = memo.get(w)
            if h is None:
                h = memo[w] = self.hash(w)
            out.append(h)
        return out

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        lists = [self.words(t) for t in texts]
        sizes = np.array([len(x) for x in lists])
        flat = np.fromiter((h for x in lists for h in x), np.uint64, int(sizes.sum()))
        rolled = np.zeros(max(0, len(flat) - self.width + 1), np.uint64)
        for k in range(self.width):
            rolled = _mix(rolled + flat[k : k + len(rolled)])
        out, at = [], 0
        for n in sizes.tolist():
            if n >= self.width:
                out.append(np.unique(rolled[at : at + n - self.width + 1]))
            elif n:
                h = np.full(1, n, np.uint64)
                for k in range(n):
                    h = _mix(h + flat[at + k])
                out.append(h)
            else:
                out.append(np.empty(0, np.uint64))
            at += n
        return out


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def signature(s: np.ndarray, clashing: frozenset[int] = frozenset()) -> int:
    """64 bits of a set; those of another seed where two different sets of the table have the same."""
    from xxhash import xxh3_64_intdigest

    h = int(np.array(xxh3_64_intdigest(s.tobytes()), np.uint64).view(np.int64))
    return int(np.array(xxh3_64_intdigest(s.tobytes(), seed=1), np.uint64).view(np.int64)) if h in clashing else h


def parity(s: np.ndarray) -> np.ndarray:
    """The set's bitmap, as 64-bit words: each shingle turns one bit over. A larger bitmap folds into one of half its bits."""
    bits = max(LEAST_BITS, 1 << (len(s) - 1).bit_length())
    at = (_mix(s) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.int64)


def first_pass(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row (id, sig, check, n, parity) for each document, and for each task its counts (bucket, n) of shingles by the
    leading bits of their hash: 2 ** SKETCH_BITS numbers at most, whatever the input's size."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        shingler, counts = Shingler(), np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            found = shingler.sets(batch.column(1).to_pylist())
            for s in found:
                np.add.at(counts, bucket_of(s), 1)
            sig = pa.array([signature(s) if len(s) else None for s in found], pa.int64())
            check = pa.array([signature(s, frozenset([h])) if len(s) else None for s, h in zip(found, sig.to_pylist(), strict=True)], pa.int64())
            n = pa.array([len(s) for s in found], pa.int64())
            maps = pa.array([parity(s) if len(s) else None for s in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), sig, check, n, maps, pa.nulls(len(found), pa.int32())], names=names)
        full = np.flatnonzero(counts)
        if len(full):
            none = pa.nulls(len(full), to_arrow_type(id_type))
            empty = pa.nulls(len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([none, empty, empty, pa.array(counts[full]), pa.nulls(len(full), pa.list_(pa.int64())), pa.array(full.astype(np.int32))], names=names)

    small_batches(docs.sparkSession)
    id_type, names = docs.schema[id_col].dataType, ["id", "sig", "check", "n", "parity", "bucket"]
    return docs.select(F.col(id_col).alias("id"), utf8(text_col).alias("text")).mapInArrow(run, f"id {kind}, sig long, check long, n long, parity array<long>, bucket int")


def at_least(n):
    """Shingles that a set of n must share with any partner: the threshold's share, rounded up."""
    return -(-n * THRESHOLD // 100)


def prefix(s: np.ndarray, counts: np.ndarray, mean: int) -> tuple[np.ndarray, int]:
    """The chosen prefix of a set, rarest shingle first, and its l."""
    n = len(s)
    seen = counts[bucket_of(s)]
    order = np.lexsort((s, seen))
    read = np.cumsum(np.maximum(seen[order] - mean, 1))
    need = at_least(n)
    best, chosen = None, 1
    for l in range(1, min(MOST_L, need) + 1):  # noqa: E741  the name in the method
        postings = float(read[n - need + l - 1])
        cost = postings + CHECK_COST * postings / l
        if best is None or cost < best:
            best, chosen = cost, l
    return s[order[: n - need + chosen]], chosen


def prefixes(docs: DataFrame, text_col: str, counts: np.ndarray, clashing: frozenset[int]) -> DataFrame:
    """Rows (token, sig, meta): a prefix shingle of a set; meta holds the set's size n, the shingle's place in the
    order and l, the lowest 3 bits. A task gives a set that it has met already no second time."""
    mean = int(counts.mean())

    def make():
        shingler, met = Shingler(), set()

        def work(texts):
            tokens, sigs, metas, sizes = [], [], [np.empty(0, np.int64)], []
            for s in shingler.sets(texts):
                if len(s) and (sig := signature(s, clashing)) not in met:
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(sig)
                    p, l = prefix(s, counts, mean)  # noqa: E741
                    tokens.append(p.view(np.int64))
                    sigs.append(sig)
                    metas.append((((len(s) << PLACE_BITS) + np.arange(len(p))) << 3) + l)
                    sizes.append(len(p))
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            return pa.array(flat), pa.array(np.repeat(np.array(sigs, np.int64), sizes)), pa.array(np.concatenate(metas))

        return work

    return map_batches(docs.select(utf8(text_col)), make, "token long, sig long, meta long")


def fields(meta: str, end: str = "") -> list[Column]:
    """n, place and l of a meta column."""
    place = F.shiftright(meta, 3).bitwiseAND((1 << PLACE_BITS) - 1)
    return [F.shiftright(meta, PLACE_BITS + 3).alias(f"n{end}"), place.alias(f"place{end}"), F.col(meta).bitwiseAND(7).alias(f"l{end}")]


def in_reach(a: str, b: str) -> Column:
    """Sets of these sizes can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * THRESHOLD


def may_link() -> Column:
    """Whether a shingle shared by sets x and y counts for this pair. The sizes of a pair say how many
    shingles it must share, which is more than each size alone says, so for the pair both prefixes are shorter."""
    need = F.expr(f"(n_x + n_y) * {THRESHOLD} div {100 + THRESHOLD} + int((n_x + n_y) * {THRESHOLD} % {100 + THRESHOLD} > 0)")
    l = F.least("l_x", "l_y")  # noqa: E741
    return in_reach("n_x", "n_y") & (F.col("place_x") < F.col("n_x") - need + l) & (F.col("place_y") < F.col("n_y") - need + l)


def star_rows(postings: DataFrame) -> DataFrame:
    """The holders of shingles that several sets hold: all but the first one, each with the first as `lead` and
    `lead_meta`. `second` marks one row of a shingle; repeats of a set go."""
    order = Window.partitionBy("token").orderBy("meta", "sig")
    seen = postings.withColumns({"lead": F.first("sig").over(order), "lead_meta": F.first("meta").over(order), "prior": F.lag("sig").over(order)})
    return seen.where("prior <> sig").select("token", "sig", "meta", "lead", "lead_meta", (F.col("prior") == F.col("lead")).alias("second"))


def set_table(docs: DataFrame, classes: DataFrame, wanted: DataFrame, id_col: str, text_col: str, clashing: frozenset[int]) -> DataFrame:
    """(sig, items) of the wanted signatures, shingled again from one document of each."""
    ids = materialise(join_list(classes.select("sig", "rep"), wanted, "sig", "left_semi").where("rep is not null").select(F.col("rep").alias("id")).distinct(), "wanted")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = with_ids(texts, ids, "id")

    def make():
        shingler = Shingler()

        def work(texts):
            found = [s for s in shingler.sets(texts) if len(s)]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            flat = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            return pa.array([signature(s, clashing) for s in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))

        return work

    found = map_batches(texts.select(utf8("text")), make, "sig long, items array<long>")
    return materialise(found, "sets").dropDuplicates(["sig"])


def attach(pairs: DataFrame, values: DataFrame, end: str, value: str, to: str) -> DataFrame:
    """The pairs with the value of their set at one end. A set of very many pairs is repeated for several tasks."""
    hot = pairs.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > HOT_PAIRS).select(end, F.expr(f"int(n div {HOT_PAIRS}) + 1").alias("parts"))
    hot = materialise(hot, "hot-sets")
    dealt = join_list(pairs, hot, end, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1)))).drop("parts")
    values = join_list(values.select(F.col("sig").alias(end), F.col(value).alias(to)), hot, end, "left")
    values = values.select(end, to, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)).cast("long") - 1)).alias("part"))
    return dealt.join(values, [end, "part"]).drop("part")


def bits_apart() -> Column:
    """Bits in which the bitmaps x and y differ; the longer one is folded to the length of the shorter."""
    words = F.least(F.size("x"), F.size("y"))

    def fold(c: str) -> Column:
        low = F.slice(c, 1, words)
        return F.when(F.size(c) == words, F.col(c)).otherwise(F.zip_with(low, F.slice(c, words + 1, words), lambda a, b: a.bitwiseXOR(b)))

    return F.aggregate(F.zip_with(fold("x"), fold("y"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)


def enough(total: Column, both: Column) -> Column:
    """Whether sets with so many shingles together and so many in common link."""
    return F.lit(100 + THRESHOLD) * both >= THRESHOLD * total


def not_ruled_out(total: Column, apart: Column) -> Column:
    """Whether sets with so many shingles together, whose bitmaps differ in so many bits, may link."""
    return enough(total, (total - apart) / 2)


def ends_of(pairs: DataFrame) -> DataFrame:
    """The sets in any pair. A set at one end of many pairs is combined before the shuffle."""
    return pairs.select(F.col("a").alias("sig")).distinct().union(pairs.select("b").distinct()).distinct()


def possible_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sizes and bitmaps don't rule out, materialised."""
    wanted = materialise(ends_of(pairs), "wanted-maps")
    known = join_list(classes.where("rep is not null"), wanted, "sig", "left_semi").select("sig", F.struct("n", "parity").alias("own"))
    known = materialise(known, "maps")
    both = attach(attach(pairs, known, "a", "own", "p"), known, "b", "own", "q")
    both = both.select("a", "b", (F.col("p.n") + F.col("q.n")).alias("total"), F.col("p.n").alias("n"), F.col("q.n").alias("m"), F.col("p.parity").alias("x"), F.col("q.parity").alias("y"))
    return materialise(both.where(in_reach("n", "m")).where(not_ruled_out(F.col("total"), bits_apart())).select("a", "b"), "possible")


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, clashing: frozenset[int]) -> DataFrame:
    """The pairs (a, b) that link, materialised."""
    left = possible_pairs(pairs, classes)
    wanted = materialise(ends_of(left), "wanted-sets")
    sets = set_table(docs, classes, wanted, id_col, text_col, clashing)
    both = attach(attach(left, sets, "a", "items", "x"), sets, "b", "items", "y")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("both"))
    return materialise(shared.where(enough(F.col("total"), F.col("both"))).select("a", "b"), "links-found")


#: Columns of a holder: its set's size, the shingle's place in its order, its l and its component so far.
MEMBER = ("token", "sig", "n", "place", "l", "own")


def still_apart(members: DataFrame) -> DataFrame:
    """The holders of the shingles that are held in more than one component."""
    apart = members.groupBy("token").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low <> high").select("token")
    return materialise(members.join(apart, "token", "left_semi"), "members")


def crowds(members: DataFrame) -> DataFrame:
    """Shingles whose holders would make many more pairs across components than there are holders."""
    sizes = members.groupBy("token", "own").agg(F.count("*").cast("double").alias("c")).groupBy("token")
    left = sizes.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"))
    return left.where((F.col("n") > LARGE) & (F.col("n") * F.col("n") - F.col("squares") > 2 * CROWD * F.col("n"))).select("token")


def lead_pairs(members: DataFrame, k: int, degrees: DataFrame | None) -> DataFrame:
    """Each set once, under one of its shingles (another each round), with `LEADS` leads of that shingle.

    The first leads are random; `degrees` then tells how many of them a set linked with,
    and the leads of later rounds are the best linked, which most others are near to."""
    chosen = members.groupBy("sig", "own", "n").agg(F.min(F.struct(F.xxhash64("token", F.lit(k)).alias("h"), "token")).alias("t")).select("sig", "own", "n", "t.token")
    chosen = materialise(chosen, "chosen")
    ranked = chosen.withColumn("degree", F.lit(0)) if degrees is None else chosen.join(degrees, "sig", "left")
    order = Window.partitionBy("token").orderBy(F.coalesce("degree", F.lit(0)).desc(), F.xxhash64("sig", F.lit(k)), "sig")
    leads = ranked.withColumn("nth", F.row_number().over(order)).where(f"nth <= {LEADS}")
    leads = leads.select("token", F.col("sig").alias("b"), F.col("own").alias("other"), F.col("n").alias("m"))
    return chosen.join(leads, "token").where((F.col("own") != F.col("other")) & in_reach("n", "m")).select(F.col("sig").alias("a"), "b").distinct()


def merged(members: DataFrame, links: DataFrame) -> DataFrame:
    """The holders with the components that the links join."""
    own = materialise(members.select("sig", "own").distinct(), "own")
    ends = links.join(own.toDF("a", "u"), "a").join(own.toDF("b", "v"), "b").select("u", "v")
    joined = materialise(components(ends).withColumnRenamed("id", "own"), "joined")
    return join_list(members, joined, "own", "left").select(*MEMBER[:-1], F.coalesce("component_id", "own").alias("own"))


def with_maps(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The holders with `parity`, their set's bitmap folded to `CARRIED` words, under crowded shingles; it is null
    elsewhere and for large sets."""
    tokens = materialise(crowds(members), "crowded-tokens")
    crowded = materialise(join_list(members, tokens, "token", "left_semi"), "crowded")
    folded = F.zip_with(F.slice("parity", 1, CARRIED), F.slice("parity", CARRIED + 1, CARRIED), lambda a, b: a.bitwiseXOR(b))
    maps = classes.where(F.size("parity") <= 2 * CARRIED).select("sig", F.when(F.size("parity") > CARRIED, folded).otherwise(F.col("parity")).alias("parity"))
    maps = materialise(join_list(maps, materialise(crowded.select("sig").distinct(), "wanted-maps"), "sig", "left_semi"), "maps")
    crowded = crowded.join(maps, "sig", "left").select(*MEMBER, "parity")
    rest = join_list(members, tokens, "token", "left_anti").select(*MEMBER, F.lit(None).cast("array<long>").alias("parity"))
    return materialise(crowded.unionByName(rest), "mapped")


def met_pairs(members: DataFrame) -> DataFrame:
    """Pairs of different components whose prefixes share as many shingles as the smaller l asks.

    A pair that the bitmaps rule out under one shingle is ruled out under all where it carries them, and later otherwise."""
    x, y = (members.select("token", *(F.col(c).alias(f"{c}_{side}") for c in (*MEMBER[1:], "parity"))) for side in "xy")
    apart = sum((F.bit_count(F.col("parity_x")[i].bitwiseXOR(F.col("parity_y")[i])) for i in range(CARRIED)), F.lit(0))
    possible = F.coalesce(not_ruled_out(F.col("n_x") + F.col("n_y"), apart), F.lit(True))  # true where a bitmap is missing
    met = x.join(y, (x["token"] == y["token"]) & (F.col("own_x") < F.col("own_y")) & may_link() & possible)
    met = met.groupBy(F.least("sig_x", "sig_y").alias("a"), F.greatest("sig_x", "sig_y").alias("b")).agg(F.count("*").alias("shared"), F.min(F.least("l_x", "l_y")).alias("l"))
    return met.where("shared >= l").select("a", "b")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_shingles, component_id."""
    passed = materialise(first_pass(docs, id_col, text_col), "shingled")
    rows = passed.where("bucket is null")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in passed.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # 2 ** SKETCH_BITS rows at most
        counts[r["bucket"]] = r["n"]
    # different sets with the same 64 bits: none as a rule, some dozens among 10 ** 10 documents
    same = rows.where("sig is not null").groupBy("sig").agg(F.min("check").alias("low"), F.max("check").alias("high")).where("low <> high")
    clashing = frozenset(r["sig"] for r in same.select("sig").collect())
    if clashing:
        rows = rows.withColumn("sig", F.when(F.col("sig").isin(*clashing), F.col("check")).otherwise(F.col("sig")))
    classes = rows.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    classes = materialise(classes, "classes")
    own = docs, classes, id_col, text_col, clashing

    held = materialise(star_rows(prefixes(docs, text_col, counts, clashing)), "held")
    leads = held.where("second").select("token", F.col("lead").alias("sig"), F.col("lead_meta").alias("meta"))
    members = held.select("token", "sig", "meta").union(leads).select("token", "sig", *fields("meta"))
    stars = held.select(F.col("sig").alias("a"), F.col("lead").alias("b"), *fields("meta", "_x"), *fields("lead_meta", "_y")).where(may_link()).select("a", "b")
    pairs = materialise(stars.distinct(), "first-pairs")
    found = [verify(pairs, *own)]
    discard(pairs)
    joined = materialise(components(found[0].select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("id", "sig"), "joined")
    members = still_apart(join_list(members, joined, "sig", "left").select(*MEMBER[:-1], F.coalesce("component_id", "sig").alias("own")))
    discard(held, joined)
    for k in range(2):  # random leads for what the stars have left apart, then the best linked ones
        crowded = materialise(members.join(crowds(members), "token", "left_semi"), "crowded")
        if crowded.limit(1).count():
            degrees = found[-1].groupBy(F.col("a").alias("sig")).agg(F.count("*").alias("degree")) if k else None
            pairs = materialise(lead_pairs(crowded, k, degrees), "lead-pairs")
            found.append(verify(pairs, *own))
            before, members = members, still_apart(merged(members, found[-1]))
            discard(before, pairs)
        discard(crowded)
    mapped = with_maps(members, classes)
    discard(members)
    met = materialise(met_pairs(mapped), "met-pairs")
    discard(mapped)
    found.append(verify(met, *own))
    links = found[0]
    for more in found[1:]:
        links = links.union(more)

    reps = classes.select("sig", "rep")
    by_rep = links.join(reps.toDF("a", "u"), "a").join(reps.toDF("b", "v"), "b")
    joined = components(by_rep.select("u", "v")).withColumnRenamed("id", "rep")
    reps = reps.join(joined, "rep", "left").select("sig", F.coalesce("component_id", "rep").alias("component_id"))
    linked = rows.where("sig is not null").select("id", "n", "sig").join(reps, "sig").select("id", "n", "component_id")
    alone = rows.where("sig is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, that with the smallest id; all columns stay.

    Of rows with the same id one stays. Rows without an id stay, but one of each equal text only."""
    found = jaccard_components(docs.select(id_col, text_col), id_col, text_col)
    keep = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count("*").alias("n"))
    keep = materialise(keep, "kept-ids")
    once, again = (materialise(keep.where(c).select(id_col), "kept-ids") for c in ("n = 1", "n > 1"))
    known = docs.where(F.col(id_col).isNotNull())
    out = with_ids(known, once, id_col).unionByName(with_ids(known, again, id_col).dropDuplicates([id_col]))
    return out.unionByName(docs.where(F.col(id_col).isNull()).dropDuplicates([text_col]))
