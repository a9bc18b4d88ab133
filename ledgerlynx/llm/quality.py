"""Quality rules: counts of words, symbols and repeats, and zstandard compression bands.

A text's ratio is its compressed size over its size, whole and in fixed chunks. Repetitive text compresses far below
natural language, encoded or random text far above it, and short texts compress less than long ones, so the limits
depend on the length. They are those of the table itself: of all documents that pass the base rules, each octave of
lengths gives the median and the quartiles of the ratio, against the usual ratio of natural language at that length
(`USUAL`); a text is rejected `WIDTH` robust standard deviations from the median. `PRIOR_ROWS` rows with the usual
ratio and a wide spread (`PRIOR_SPREAD`) are added to each octave, so small tables are judged by the same rule, with
wider limits. Below `LEAST_BYTES` a ratio says too little and only the base rules decide. A text is also rejected when a
quarter of its chunks lie outside the limits of their length, which catches a repetitive part that a long natural rest hides.

Null and empty texts have all counts 0, fail the base rule on words and are not kept. Very long texts
are read whole. Empty tables give no rows. Repeated rows give repeated results and count as often as they occur; further
input columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from math import log2
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialise, small_batches, utf8

#: Usual ratios of prose at level 3, for lengths of 2 ** 8, 2 ** 9, ... bytes.
USUAL = (0.70, 0.62, 0.56, 0.52, 0.48, 0.45, 0.42, 0.40, 0.38)
LEAST_BYTES = 256
WIDTH, PRIOR_ROWS, PRIOR_SPREAD = 4.0, 20, 0.07
CHUNK = 2048
#: Rejects from this share of chunks outside the limits; the last chunk counts from half a chunk on.
CHUNK_SHARE = 0.25
LEVEL = 3
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
#: Octaves of lengths: a text of Spark has fewer bytes than 2 ** 31.
OCTAVES = 32

#: excess: the ratio less the usual one at this length; chunks: the same of the chunks, which are judged by their own lengths.
MEASURED = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "size long, ratio double, excess double, chunks array<struct<size: long, excess: double>>"
)
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, bad_chunks double, kept boolean"


class Limits(NamedTuple):
    """The least and the largest excess of each octave of lengths."""

    low: tuple[float, ...]
    high: tuple[float, ...]

    def hold(self, size: int, excess: float) -> bool:
        k = size.bit_length() - 1
        return size < LEAST_BYTES or self.low[k] <= excess <= self.high[k]


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    n, end = 0, 0  # end: words before it are counted
    for i, w in enumerate(windows):
        if counts[w] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. bytes.split() parts at \\x20 and \\x09-\\x0D."""
    words = text.split()
    spaces = len(text) - sum(map(len, words))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.decode("utf-8", "replace")) - spaces, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def usual(size: int) -> float:
    return float(np.interp(log2(size), range(8, 8 + len(USUAL)), USUAL))


def measure(chunk: int = CHUNK, min_words: int = MIN_WORDS):
    """A function text -> the columns of MEASURED, with a compressor of its own."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress

    def one(text: bytes) -> tuple:
        counts, size = base_counts(text), len(text)
        failed = counts[0] < min_words or 100 * counts[4] > 50 * counts[0]
        ratio = len(squeeze(text)) / size if text else 0.0
        parts = [text[i : i + chunk] for i in range(0, size, chunk)] if size >= 2 * chunk else []
        chunks = [{"size": len(x), "excess": len(squeeze(x)) / len(x) - usual(len(x))} for x in parts if 2 * len(x) >= chunk]
        return *counts, failed, size, ratio, ratio - usual(size) if text else 0.0, chunks

    return one


def fit_limits(measured: DataFrame, width: float = WIDTH) -> Limits:
    """From all measured documents that pass the base rules: three quantiles of each octave come to the driver."""
    octave = F.floor(F.log2("size") + 1e-12).cast("int").alias("octave")
    rows = measured.where(f"not base_failed and size >= {LEAST_BYTES}").groupBy(octave).agg(F.count("*").alias("n"), F.percentile_approx("excess", [0.25, 0.5, 0.75], 10_000).alias("q")).collect()
    low, high = [-width * PRIOR_SPREAD] * OCTAVES, [width * PRIOR_SPREAD] * OCTAVES
    for r in rows:
        (q1, middle, q3), n = r["q"], r["n"]
        all_rows = n + PRIOR_ROWS
        centre, spread = n * middle / all_rows, (n * (q3 - q1) / 1.349 + PRIOR_ROWS * PRIOR_SPREAD) / all_rows
        low[r["octave"]], high[r["octave"]] = centre - width * spread, centre + width * spread
    return Limits(tuple(low), tuple(high))


def verdict(size: int, excess: float, chunks: list[dict], failed: bool, limits: Limits, chunk_share: float = CHUNK_SHARE) -> tuple[float, bool]:
    """The share of chunks outside the limits, and whether the text is kept."""
    bad = sum(not limits.hold(c["size"], c["excess"]) for c in chunks) / max(1, len(chunks))
    return bad, not failed and limits.hold(size, excess) and bad < chunk_share


def measured_documents(docs: DataFrame, id_col: str, text_col: str, chunk: int = CHUNK, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a document: id and the columns of MEASURED. No shuffle."""

    def make():
        one = measure(chunk, min_words)

        def work(ids, texts):
            return ids, *zip(*map(one, texts), strict=True)

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("id"), utf8(text_col)), make, f"id {kind}, {MEASURED}")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: float = WIDTH, **measuring) -> DataFrame:
    """One row a document: id and the columns of SCHEMA. Shuffles three quantiles of each octave only."""
    measured = materialise(measured_documents(docs, id_col, text_col, **measuring), "measured")
    limits = fit_limits(measured, width)
    counts = ("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio")

    def make():
        def work(*columns):
            own = zip(*columns[len(counts) :], columns[counts.index("base_failed")], strict=True)
            return *columns[: len(counts)], *zip(*(verdict(*x, limits) for x in own), strict=True)

        return work

    kind = dict(docs.dtypes)[id_col]
    return map_batches(measured.select(*counts, "size", "excess", "chunks"), make, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, text_col: str = "text", width: float = WIDTH, **measuring) -> DataFrame:
    """The documents that the rules keep, with all their columns. Texts are read twice, once for the limits; no text is shuffled."""
    limits = fit_limits(measured_documents(docs.select(text_col).withColumn("id", F.lit(0)), "id", text_col, **measuring), width)
    small_batches(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        one = measure(**measuring)

        def kept(text):
            *_, failed, size, _, excess, chunks = one(text)
            return verdict(size, excess, chunks, failed, limits)[1]

        return texts.map(kept)

    return docs.where(good(utf8(text_col)))
