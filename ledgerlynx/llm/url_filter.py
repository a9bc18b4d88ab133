"""URL filters: host and path rules first, then a weighted vocabulary read by one Aho-Corasick automaton.

A strict term rejects a URL alone; soft terms reject when `soft_limit` different ones occur. A hit
counts only between boundaries: the characters beside it are not ASCII letters or digits.

Null and malformed URLs (no `://`) have empty host and path, no rule, and the vocabulary still
reads what text there is (null: none, so "allow"). Ties between rules of equal length go to the
first listed. Repeated rows give repeated results; further input columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple
from urllib.parse import unquote_to_bytes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: One of these as a whole word rejects a URL.
STRICT_TERMS = (
    "porn", "porno", "xxx", "xnxx", "hentai", "milf", "camgirl", "camgirls", "sexcam", "escort", "escorts",
    "casino", "casinos", "sportsbook", "viagra", "cialis", "warez", "keygen", "torrent", "torrents",
)
#: Several different ones of these as whole words reject a URL.
SOFT_TERMS = (
    "sex", "sexy", "adult", "nude", "naked", "erotic", "dating", "cam", "bet", "bets", "betting", "poker", "slots",
    "jackpot", "gambling", "lottery", "crack", "cracked", "serial", "pills", "pharmacy", "replica", "coupon", "coupons",
    "promo", "deal", "deals", "cheap", "free", "download", "downloads", "loan", "loans", "payday", "bonus",
)
SOFT_LIMIT = 2


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vocabulary(strict: tuple[str, ...], soft: tuple[str, ...]):
    """A function URL -> (strict hits, distinct soft terms); the automaton is built once a task."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for weight, terms in ((0, soft), (1, strict)):
        for term in terms:
            automaton.add_word(term, (weight, term))
    if len(automaton):
        automaton.make_automaton()
    word = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")

    def count(url: str | None) -> tuple[int, int]:
        if not url or not len(automaton):
            return 0, 0
        text = url.encode().lower().decode()
        if "%" in text:
            text = unquote_to_bytes(text).lower().decode("utf-8", "replace")
        n_strict, seen = 0, set()
        for end, (weight, term) in automaton.iter(text):
            start = end + 1 - len(term)
            if (start == 0 or text[start - 1] not in word) and (end + 1 == len(text) or text[end + 1] not in word):
                if weight:
                    n_strict += 1
                else:
                    seen.add(term)
        return n_strict, len(seen)

    return count


def filter_urls(
    pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url",
    strict: tuple[str, ...] = STRICT_TERMS, soft: tuple[str, ...] = SOFT_TERMS, soft_limit: int = SOFT_LIMIT,
) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, n_strict, n_soft. No shuffle."""

    def make():
        count = vocabulary(strict, soft)

        def work(ids, urls):
            hits = [count(u) for u in urls]
            return ids, urls, [h[0] for h in hits], [h[1] for h in hits]

        return work

    kind = dict(pages.dtypes)[id_col]
    counted = map_batches(pages.select(F.col(id_col), F.col(url_col).cast("string")), make, f"`{id_col}` {kind}, url string, n_strict int, n_soft int")
    start = F.instr(F.col("url"), "://")
    rest = F.when(start > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    parts = counted.withColumn("rest", F.coalesce(rest, F.lit(""))).withColumn("host", F.regexp_extract("rest", r"^([^/?#]*)", 1))
    parts = parts.withColumn("path", F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^([^?#]*)", 1)).withColumn("host", ascii_lower(F.col("host")))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):  # the longest comes last, so it is tested first
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, ruled = F.when(fits, r.name).otherwise(rule), F.when(fits, r.verdict).otherwise(ruled)
    method = F.when((F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit), "block").otherwise("allow")
    return parts.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(ruled, method).alias("verdict"), "n_strict", "n_soft")
