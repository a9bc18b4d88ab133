"""A sink that holds each micro-batch once, whatever fails between writing it and committing it.

A batch is written into a folder of its own attempt; then one small file, named by the batch's id, is put in place by a
rename and names the attempt. Readers follow these commits alone. A batch that comes again after a failure finds its commit and
writes nothing, or finds none and writes another attempt, so nothing is missing and nothing is there twice. The commits up to
an id are a snapshot: it reads the same for ever. `clear` deletes attempts that no commit names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class OnceSink:
    """For `writeStream.foreachBatch`. One query writes to one folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def _hadoop(self, spark: SparkSession, name: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id not in self.commits(batch.sparkSession):
            self.commit(batch.sparkSession, batch_id, self.write(batch, batch_id))

    def write(self, batch: DataFrame, batch_id: int) -> str:
        attempt = f"batch-{batch_id:012d}-{uuid.uuid4().hex}"
        batch.write.mode("errorifexists").parquet(f"{self.folder}/data/{attempt}")
        return attempt

    def commit(self, spark: SparkSession, batch_id: int, attempt: str) -> None:
        fs, made = self._hadoop(spark, f"commits/.{attempt}")
        out = fs.create(made, False)
        out.write(bytearray(attempt.encode()))
        out.close()
        _, path = self._hadoop(spark, f"commits/{batch_id:012d}")
        if fs.exists(path) or not fs.rename(made, path):
            fs.delete(made, False)  # another attempt was first

    def commits(self, spark: SparkSession) -> dict[int, str]:
        """The attempt that holds each committed batch."""
        fs, folder = self._hadoop(spark, "commits")
        if not fs.exists(folder):
            return {}
        found = {}
        for f in fs.listStatus(folder):
            if not f.getPath().getName().startswith("."):
                stream = fs.open(f.getPath())
                found[int(f.getPath().getName())] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return found

    def read(self, spark: SparkSession, schema: StructType, up_to: int | None = None) -> DataFrame:
        """The committed rows, of all batches or of those up to an id."""
        held = [a for k, a in sorted(self.commits(spark).items()) if up_to is None or k <= up_to]
        return spark.read.schema(schema).parquet(*(f"{self.folder}/data/{a}" for a in held)) if held else spark.createDataFrame([], schema)

    def clear(self, spark: SparkSession) -> int:
        """Delete what no commit names, while no query writes: the number of attempts that are gone."""
        fs, folder = self._hadoop(spark, "data")
        kept, gone = set(self.commits(spark).values()), 0
        for f in fs.listStatus(folder) if fs.exists(folder) else []:
            if f.getPath().getName() not in kept:
                gone += fs.delete(f.getPath(), True)
        return gone


def drained(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over all that is there now, into a sink in the folder, and read what it holds."""
    sink = OnceSink(f"{folder}/sink")
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sink.read(stream.sparkSession, stream.schema)
