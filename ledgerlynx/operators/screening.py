"""Watchlist screening and entity resolution over names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .network import weak_components

#: Titles that cleaning drops.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "sir", "madam", "sr", "jr")

#: List entries that are broadcast at most to names without candidates.
MOST_LISTED = 100_000


def clean(name: Column, titles=TITLES) -> Column:
    """E1."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", "")), r"\s+")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(*titles)), " ")


def listed(df: DataFrame, key: str, watchlist: DataFrame) -> DataFrame:
    """Rows whose normalised key is on the list, with the sources."""
    names = watchlist.groupBy("name_norm").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return df.withColumn("name_norm", F.lower(F.trim(key))).join(names, "name_norm")


def unlisted(df: DataFrame, key: str, watchlist: DataFrame) -> DataFrame:
    """J6."""
    return df.withColumn("name_norm", F.lower(F.trim(key))).join(watchlist.select("name_norm").distinct(), "name_norm", "left_anti")


def partial_hits(names: DataFrame, watchlist: DataFrame, least: int = 3, longer: int = 5) -> DataFrame:
    """One string contains the other, wherever it lies. All pieces of three letters of a string are also in what
    contains it, so it is looked up by the one of its pieces that the fewest strings of the other side have."""
    n = names.where(F.length("name") >= least).select("name", F.lower("name").alias("a")).distinct()
    w = watchlist.where(F.length("name_norm") > longer).select("name_norm").distinct()

    def inside(short: DataFrame, s: str, long: DataFrame, c: str) -> DataFrame:
        pieces = long.withColumn("piece", F.explode(_pieces(c)))
        rare = short.withColumn("piece", F.explode(_pieces(s))).join(pieces.groupBy("piece").agg(F.count("*").alias("of")), "piece", "left")
        rare = rare.groupBy(*short.columns).agg(F.min_by("piece", F.struct(F.coalesce("of", F.lit(0)), "piece")).alias("piece"))
        return rare.join(pieces, "piece").where(F.contains(c, F.col(s))).select("name", "name_norm")

    return inside(w, "name_norm", n, "a").unionByName(inside(n, "a", w, "name_norm")).distinct()


def _pieces(c: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda k: F.substring(F.col(c), k, F.lit(3))))


def ratio(a: Column, b: Column) -> Column:
    """100 less the share of edits in the longer string."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 100.0 * (1 - F.levenshtein(a, b) / longest)).otherwise(100.0)


def sorted_words(a: Column) -> Column:
    return F.array_join(F.array_sort(F.split(a, " ")), " ")


def token_set(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    return 100.0 * F.size(F.array_intersect(x, y)) / F.least(F.size(x), F.size(y))


def partial_ratio(a: Column, b: Column) -> Column:
    """The best edit ratio of the shorter string with the pieces of its length in the longer; 100 if one is empty."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    n = F.length(short)
    return F.array_max(F.transform(F.sequence(F.lit(1), F.length(long) - n + 1), lambda k: ratio(short, F.substring(long, k, n))))


def score(a: Column, b: Column) -> Column:
    """The best of the edit ratio, that of the sorted words, and the shared words."""
    return F.when(a == b, 100.0).otherwise(F.greatest(ratio(a, b), ratio(sorted_words(a), sorted_words(b)), token_set(a, b)))


def best_match(a: Column, b: Column) -> Column:
    """(score, method): the best of all ways to compare two names, rounded to four places, and the first way that reaches it."""
    ways = {"ratio": ratio(a, b), "partial_ratio": partial_ratio(a, b), "sorted_words": ratio(sorted_words(a), sorted_words(b)), "shared_words": token_set(a, b)}
    found = F.array(*(F.struct(F.round(v, 4).alias("score"), F.lit(n).alias("method")) for n, v in ways.items()))
    best = F.aggregate(found, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("method")), lambda x, y: F.when(y["score"] > x["score"], y).otherwise(x))
    return F.when(a == b, F.struct(F.lit(100.0).alias("score"), F.lit("exact").alias("method"))).otherwise(best)


def candidates(names: DataFrame, watchlist: DataFrame, whole: bool = True) -> DataFrame:
    """Pairs of a name and a list entry whose first or last word is one of the name's words, in any case. A name
    without such an entry meets the whole list, which is broadcast only up to `MOST_LISTED` entries; not so if `whole` is false."""
    ends = watchlist.select("name_norm").distinct().withColumn("w", F.split("name_norm", " "))
    right = ends.select("name_norm", F.explode(F.array_distinct(F.array(F.get("w", F.lit(0)), F.element_at("w", -1)))).alias("word"))
    left = names.select("name").where("name is not null").distinct()
    words = left.select("name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("word"))
    found, entries = words.join(right, "word").select("name", "name_norm").distinct(), ends.select("name_norm")
    if not whole:
        return found
    small = entries.limit(MOST_LISTED + 1).count() <= MOST_LISTED
    return found.unionByName(left.join(found.select("name"), "name", "left_anti").crossJoin(F.broadcast(entries) if small else entries))


def grams(c: Column, q: int) -> Column:
    """The pieces of q characters of a string, each with how many of its kind stood before it, so that sets of them count like bags."""
    n = F.length(c) - q + 1
    pieces = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(c, k, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array_sort(pieces), lambda g, i: F.struct(g.alias("gram"), (i - F.array_position(F.array_sort(pieces), g)).cast("int").alias("nth")))


def near_pairs(names: DataFrame, watchlist: DataFrame, least: float, q: int = 2) -> DataFrame:
    """Pairs of a name and a list entry among which are all that `score` puts at `least` or above: name, name_norm.

    A score that the shared words give needs a shared word. One that edits give, of the strings or of their sorted words, needs shared pieces: one edit
    spoils at most q pieces, so strings whose longer one has n characters, at most e = (1 - least / 100) * n edits apart, share n - q + 1 - q * e of
    their pieces at least. Pieces are joined and counted, and pairs below that are dropped. Where the bound says nothing, for
    short strings, single characters take the pieces' place: these share n - e, which is over 0 for every score over 0. Equal strings are pairs."""
    if not 0 < least <= 100:
        raise ValueError("a score between 0 and 100 is needed")
    part = 1 - least / 100
    left = names.select("name").where("name IS NOT NULL").distinct().withColumn("a", F.lower("name"))
    right = watchlist.select("name_norm").where("name_norm IS NOT NULL").distinct()
    words = [d.select(k, F.explode(F.array_distinct(F.split(c, " "))).alias("word")) for d, k, c in ((left, "name", "a"), (right, "name_norm", "name_norm"))]
    found = [words[0].join(words[1], "word").select("name", "name_norm"), left.join(right, F.col("a") == F.col("name_norm")).select("name", "name_norm")]
    for form in (lambda c: F.col(c), lambda c: sorted_words(F.col(c))):
        x, y = left.select("name", form("a").alias("s")), right.select("name_norm", form("name_norm").alias("t"))
        x, y = x.withColumn("m", F.length("s")), y.withColumn("n", F.length("t"))
        for size in (q, 1):
            longest = F.greatest("m", "n")
            bound = longest - size + 1 - size * F.floor(longest * part + 1e-9)
            # the single characters are only for what longer pieces say nothing about
            usable = longest - q + 1 - q * F.floor(longest * part + 1e-9) >= 1
            # a string whose own length and the edits allow no partner with a usable bound brings no pieces
            one = x.select("name", "m", F.inline(grams(F.col("s"), size)))
            two = y.select("name_norm", "n", F.inline(grams(F.col("t"), size)))
            if size == 1:
                short = q / max(1e-9, 1 - q * part) + q if q * part < 1 else None  # at this length the bound is usable for sure
                if short is not None:
                    one, two = one.where(F.col("m") < short), two.where(F.col("n") < short)
            shared = one.join(two, ["gram", "nth"]).where(F.abs(F.col("m") - F.col("n")) <= longest * part + 1e-9).groupBy("name", "name_norm", "m", "n").agg(F.count("*").alias("shared"))
            found.append(shared.where((F.col("shared") >= bound) & (usable if size == q else ~usable)).select("name", "name_norm"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def phonetic_key(name: Column) -> Column:
    """The sounds of a name's words, in their order by letter: names that are spelt otherwise but sound alike share it."""
    return F.array_join(F.array_sort(F.transform(F.filter(F.split(F.lower(name), " "), lambda w: w != ""), lambda w: F.soundex(w))), " ")


def sounding_alike(names: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Pairs of names and list entries with equal phonetic keys, by one join on the key."""
    x = names.select("name").where("name IS NOT NULL").distinct().withColumn("sounds", phonetic_key(F.col("name")))
    return x.join(watchlist.select("name_norm").distinct().withColumn("sounds", phonetic_key(F.col("name_norm"))), "sounds").where("sounds <> ''").select("name", "name_norm", "sounds")


def screen(names: DataFrame, watchlist: DataFrame, least: float = 85, k: int = 5, whole: bool = True) -> DataFrame:
    """Exact entries first, else the best k at or above the score. A name without candidates is looked up by its pieces
    (`near_pairs`), which finds the same hits as the whole list and makes no pairs that cannot score."""
    pairs = candidates(names, watchlist, False)
    if whole:
        alone = names.select("name").distinct().join(pairs.select("name"), "name", "left_anti")
        pairs = pairs.unionByName(near_pairs(alone, watchlist, least))
    scored = pairs.withColumn("score", F.round(score(F.lower("name"), F.col("name_norm")), 4)).where(F.col("score") >= least)
    order = Window.partitionBy("name").orderBy(F.desc("score"), "name_norm")
    return scored.withColumn("place", F.row_number().over(order)).withColumn("best", F.max("score").over(Window.partitionBy("name"))).where((F.col("place") <= k) & ((F.col("best") < 100) | (F.col("score") == 100))).drop("best")


def entities(names: DataFrame, least: float = 90) -> DataFrame:
    """Names: id, name. Groups of names linked by a score, with their size; the canonical id is the smallest."""
    words = names.select("id", "name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    x, y = words.toDF("src", "a", "word"), words.toDF("dst", "b", "word")
    pairs = x.join(y, "word").where("src < dst").select("src", "dst", "a", "b").distinct().where(score(F.col("a"), F.col("b")) >= least)
    found = weak_components(pairs.select("src", "dst")).select(F.col("node").alias("id"), "component")
    out = names.join(found, "id", "left").select("id", "name", F.coalesce("component", "id").alias("entity"))
    sizes = out.groupBy("entity").agg(F.count("*").alias("n_names"))
    return out.join(sizes, "entity").select("id", "name", "entity", "n_names")


def jaccard_words(a: Column, b: Column) -> Column:
    """E7."""
    x, y = F.split(a, " "), F.split(b, " ")
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def match_band(fields: list[tuple[Column, float]]) -> tuple[Column, Column]:
    """The weighted sum of field matches, and its band."""
    total = sum((c.cast("double") * w for c, w in fields), F.lit(0.0))
    return total, F.when(total > 0.9, "exact").when(total > 0.7, "strong").when(total > 0.5, "weak").otherwise("none")
