"""Indexing a growing directory or table as a stream: each micro-batch adds the contents that aren't known yet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

INDEX = "rel_path string, file_hash string, size_bytes long, format string"
BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, root: str, extensions: tuple[str, ...], files_per_batch: int = 10_000) -> DataFrame:
    """The files that appear under root: rel_path (as the reader gives it), file_hash, size_bytes, format."""
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.select(F.col("path").alias("rel_path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size_bytes"), suffix.alias("format"))
    return rows.where(F.col("format").isin(*extensions))


def index(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that adds to table, in one folder a batch, each content of stream (INDEX columns) that no other batch holds.

    A batch that is run again after a failure overwrites its own folder and ignores what that holds, so contents are indexed
    exactly once. Of equal contents in a batch, the first path counts.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], INDEX).write.mode("ignore").parquet(f"{table}/batch=-1")

    def add(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        known = session.read.schema(f"{INDEX}, batch long").parquet(table).where(F.col("batch") != n)
        first = batch.groupBy("file_hash").agg(F.min(F.struct("rel_path", "size_bytes", "format")).alias("f")).select("f.rel_path", "file_hash", "f.size_bytes", "f.format")
        first.join(known.select("file_hash"), "file_hash", "left_anti").select("rel_path", "file_hash", "size_bytes", "format").write.mode("overwrite").parquet(f"{table}/batch={n}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
