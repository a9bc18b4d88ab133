"""What the operators of this subpackage share: reading tables, cutting lineage, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

#: Rows and bytes that one Arrow batch brings to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset in a local session, as in tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jvm_dir.isDefined():
            return jvm_dir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return named


_WRITTEN: WeakKeyDictionary = WeakKeyDictionary()


def materialise(df: DataFrame, label: str, level: int = 3) -> DataFrame:
    """Write df as Parquet into the shared folder, with zstd at a level, and read it again.

    Later reads neither repeat the work above nor depend on an executor that may be lost."""
    path = f"{shared_folder(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[written] = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables. Whatever was made of them must be materialised itself by then."""
    for df in tables:
        spark, path = df.sparkSession, _WRITTEN.pop(df)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def utf8(column: str) -> Column:
    """The text's UTF-8 bytes; null becomes no bytes."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def map_batches(df: DataFrame, make: Callable[[], Callable], schema: str | StructType) -> DataFrame:
    """Apply make()(*columns as lists) -> columns as lists to each Arrow batch of df.

    make runs once in each task, so it may set up compressors, automata or caches."""
    schema = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows:
                columns = work(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Keep a batch of very long texts from filling a Python worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


#: Ids that are broadcast at most; beyond, a shuffled join takes its place.
BROADCAST_IDS = 2_000_000


def join_list(rows: DataFrame, found: DataFrame, column: str, how: str = "inner", most: int = BROADCAST_IDS) -> DataFrame:
    """rows joined with a materialised table of narrow rows, which is counted, and broadcast if it is small."""
    return rows.join(F.broadcast(found) if found.count() <= most else found, column, how)


def with_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose id is among `ids` (one column, materialised). A counted, small list is broadcast."""
    return join_list(rows, ids, column, "left_semi")
