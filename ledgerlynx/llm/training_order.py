"""Token-id output in training order: fixed-stride binary shards that are read from front to back.

Tasks chain their documents' ids, an end id after each, and cut the chain into sequences of `stride`
tokens; only a task's last sequence is padded with end ids. Sequences are numbered by the task's first
number plus their place in it. A keyed Feistel network over the smallest even-bit domain that holds
all N numbers, walked along its cycle until it lands below N, maps numbers to slots: a permutation of
0 .. N-1 that the key alone decides, with no sort of random keys and no list of N entries anywhere.
Slots are range partitioned, `per_shard` to a shard, by arithmetic (the ranges are equal, so none need be sampled): a task
gets one shard, and each shard is written as one file of
fixed stride: slot s lies in file s // per_shard at byte (s % per_shard) * stride * width, so a reader
resumes anywhere by arithmetic.

A shard is written under a name of its own attempt and then renamed, so a task that is run again after
the loss of an executor, or twice, leaves one whole file. The folder is named as Hadoop names it, so a path without a scheme
lies in the cluster's default file system.

The permutation is a function of the key and N alone. Which sequence has which number also depends on how the scan was
split into tasks, so the same order comes again from the returned table or the files, not from another run over
other splits. A token id that the width doesn't hold raises an error.

Null and empty texts are one end id. Empty tables give no rows and no files. Repeated rows are
written each for itself. Very long texts run over as many sequences as they need. Further input columns are ignored.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, small_batches
from .packing import _encoder

ROUNDS = 4
_M = np.uint64(0x9E3779B97F4A7C15)


def _round(right: np.ndarray, key: int, k: int, mask: np.uint64) -> np.ndarray:
    h = (right + np.uint64((key + 0x632BE59BD9B4E019 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)) * _M
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & mask


def half_bits(n: int) -> int:
    """Bits of one half of the domain."""
    return max(1, -(-max(1, n - 1).bit_length() // 2))


def permute(numbers: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """The slots of numbers below n, or back. The walk takes under four steps on average."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> bits, out[todo] & mask
        for k in range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS):
            if inverse:
                left, right = right ^ _round(left, key, k, mask), left
            else:
                left, right = right, left ^ _round(right, key, k, mask)
        out[todo] = (left << bits) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def sequences(docs: DataFrame, ranks_path: str, tokenizer_path: str | None, pattern: str, stride: int, end_id: int, id_col: str, text_col: str, dtype: str) -> DataFrame:
    """Rows (part, nth, first_doc_id, n_tokens, tokens)."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        encode, end = _encoder(ranks_path, tokenizer_path, pattern), np.array([end_id], np.uint32)
        most = np.iinfo(dtype).max
        rest, owner = np.empty(0, np.uint32), None  # tokens not yet cut, and the document they begin with

        def rows(cut: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part] * len(cut), "nth": [c[0] for c in cut], "first_doc_id": [c[1] for c in cut], "n_tokens": [c[2] for c in cut], "tokens": [c[3] for c in cut]}, schema=arrow)

        for batch in batches:
            cut = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.concatenate([encode(text), end]) if text else end
                if (top := int(ids.max())) > most:
                    raise ValueError(f"token id {top} does not fit {dtype}")
                if not len(rest):
                    owner = doc
                chain = np.concatenate([rest, ids])
                whole = len(chain) // stride * stride
                for a in range(0, whole, stride):
                    cut.append((nth, owner if a < len(rest) or not len(rest) else doc, stride, chain[a : a + stride].astype(dtype).tobytes()))
                    nth += 1
                if whole:
                    owner = doc
                rest = chain[whole:]
            if cut:
                yield rows(cut)
        if len(rest):
            padded = np.concatenate([rest, np.full(stride - len(rest), end_id, np.uint32)])
            yield rows([(nth, owner, len(rest), padded.astype(dtype).tobytes())])

    schema = f"part int, nth long, first_doc_id {kind}, n_tokens long, tokens binary"
    arrow = pa.schema([("part", pa.int32()), ("nth", pa.int64()), ("first_doc_id", to_arrow_type(docs.schema[id_col].dataType)), ("n_tokens", pa.int64()), ("tokens", pa.binary())])
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def _filesystem(folder: str):
    """(pyarrow file system, path) of a folder named by URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme of the file system that Hadoop finds it in."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", uri)


def write_in_order(
    docs: DataFrame, folder: str, ranks_path: str, tokenizer_path: str | None, pattern: str, key: int, stride: int = 2048, per_shard: int = 8192,
    end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2",
) -> DataFrame:
    """Write the shards and return one row a sequence: slot, shard, byte_offset, number, first_doc_id, n_tokens, tokens_crc32."""
    folder = _qualified(docs.sparkSession, folder)
    cut = materialise(sequences(docs, ranks_path, tokenizer_path, pattern, stride, end_id, id_col, text_col, dtype), "sequences", level=6)
    counts = cut.groupBy("part").agg(F.count("*").alias("n"))
    # one row a task of the scan; its size is that of the job, not of the data
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialise(counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n"), "starts")
    n = starts.agg(F.sum("n")).first()[0] or 0
    numbered = cut.join(F.broadcast(starts.select("part", "start")), "part").withColumn("number", F.col("start") + F.col("nth")).drop("part", "nth", "start")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            packed = pa.array([squeeze(t.as_py()) for t in b.column("tokens")], pa.binary())
            b = b.set_column(b.schema.get_field_index("tokens"), "tokens", packed)  # what is shuffled
            yield b.append_column("slot", pa.array(permute(b.column("number").to_numpy(), n, key)))

    kind = dict(cut.dtypes)["first_doc_id"]
    slots = numbered.mapInArrow(placed, f"first_doc_id {kind}, n_tokens long, tokens binary, number long, slot long")
    shards = slots.withColumn("shard", F.expr(f"slot div {per_shard}"))
    width = stride * np.dtype(dtype).itemsize

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _filesystem(folder)
        store.create_dir(root, recursive=True)
        import zstandard

        current, out, temporary, spread = None, None, "", zstandard.ZstdDecompressor().decompress

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temporary, f"{root}/shard-{current:08d}.bin")

        for b in batches:
            shard = b.column("shard").to_numpy()
            tokens = [spread(t.as_py()) for t in b.column("tokens")]
            for i in range(b.num_rows):
                if shard[i] != current:
                    close()
                    current, temporary = int(shard[i]), f"{root}/.shard-{int(shard[i]):08d}-{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                out.write(tokens[i])
            crc = pa.array([zlib.crc32(t) for t in tokens], pa.int64())
            slot = b.column("slot").to_numpy()
            at = pa.array(slot % per_shard * width)
            yield pa.RecordBatch.from_arrays([b.column("slot"), b.column("shard"), at, b.column("number"), b.column("first_doc_id"), b.column("n_tokens"), crc], names=["slot", "shard", "byte_offset", "number", "first_doc_id", "n_tokens", "tokens_crc32"])
        close()

    n_shards = -(-n // per_shard)
    in_order = shards.repartitionById(max(1, n_shards), F.col("shard").cast("int")).sortWithinPartitions("shard", "slot").select("slot", "shard", "number", "first_doc_id", "n_tokens", "tokens")
    written = in_order.mapInArrow(write, f"slot long, shard long, byte_offset long, number long, first_doc_id {kind}, n_tokens long, tokens_crc32 long")
    return materialise(written, "written")


def read_slots(folder: str, first: int, count: int, stride: int = 2048, per_shard: int = 8192, dtype: str = "<u2") -> Iterator[np.ndarray]:
    """Sequences first, first + 1, ... in training order, from any slot on. A folder without a scheme is a local one."""
    store, root = _filesystem(folder if re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", folder) else f"file://{os.path.abspath(folder)}")
    width = stride * np.dtype(dtype).itemsize
    while count > 0:
        shard, place = divmod(first, per_shard)
        take = min(count, per_shard - place)
        with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
            f.seek(place * width)
            for _ in range(take):
                yield np.frombuffer(f.read(width), dtype)
        first, count = first + take, count - take
