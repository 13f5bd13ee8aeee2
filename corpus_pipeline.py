"""The corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, exact_dedup, language_id, near_dedup, packing
from lectern.llm.queries import tokenizer_path
from lectern.llm.scratch import ROW, numbered, written

#: The language model's predictions and the packing can't be written in SQL; tests compare run() with brute force.
ORACLE_SQL = None


#: Row numbers of a bitmap, and the bitmaps that are broadcast at most: 32 MB.
MAP_BITS, MOST_MAPS = 32_768, 8192


#: Bytes of the batches in which texts go to Python and back. Spark's own limit is 10,000 rows, which for texts is tens of MB, held by a task on both sides.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def small_batches(stage: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The stage with batches of about BATCH_BYTES while it writes its tables, unless the session has a limit of its own. What a stage returns hands no text to Python."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is not None:
            return stage(spark, docs, sf_dir)
        spark.conf.set(BATCH, str(BATCH_BYTES))
        try:
            return stage(spark, docs, sf_dir)
        finally:
            spark.conf.unset(BATCH)

    return run


def _only(docs: DataFrame, rows: DataFrame, keep: bool) -> DataFrame:
    """The rows of docs with (keep) or without their number among an operator's rows, whose id is that number.

    Bitmaps of 32,768 numbers each find them; up to MOST_MAPS of these (4 KB each) are broadcast, so that no text is shuffled.
    """
    numbers = rows.select(F.shiftright("doc_id", 15).alias("_m"), (F.col("doc_id") % MAP_BITS).alias("_at"))
    maps = written(numbers.repartition("_m").groupBy("_m").agg(F.bitmap_construct_agg("_at").alias("_map")), "bitmaps")
    hint = F.broadcast if maps.count() <= MOST_MAPS else (lambda df: df)
    at = F.col(ROW) % MAP_BITS
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return docs.join(hint(maps), F.shiftright(ROW, 15) == F.col("_m"), "left").where(found if keep else ~found)


def _chosen(docs: DataFrame, told: DataFrame, group: str, best: Column) -> DataFrame:
    """The row of each group (told's column) that is best, an aggregate of doc_id and the row's number with a field of that."""
    told = written(told.select(F.col("doc_id").alias(ROW), F.col(group).alias("_group")), "told")
    rows = told.join(docs.select(ROW, "doc_id"), ROW)
    return rows.groupBy("_group").agg(best.alias("b")).select(F.col(f"b.{ROW}").alias("doc_id"))


@small_batches
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents for which a language can be told: those with null, empty or letterless texts go.

    Each row is told by its own text, whatever its id or copies. Very long texts are read whole. No rows: no rows.
    """
    rows = numbered(docs)
    told = language_id.identify(rows, language_id.learn(docs), id_col=ROW)
    return _only(rows, told.where("lang_pred = 'und'"), keep=False).select(docs.columns)


@small_batches
def keep_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the largest id of each group of equal texts: one row, the first of equal ids; null only without another.

    Null texts equal empty ones, so one row of these stays. Repeated rows are copies. Very long texts are compared whole. No rows: no rows.
    """
    rows = numbered(docs)
    told = exact_dedup.exact_duplicates(rows, id_col=ROW)
    best = F.max(F.struct("doc_id", (-F.col(ROW)).alias("first"), ROW))
    return _only(rows, _chosen(rows, told, "keep_id", best), keep=True).select(docs.columns)


@small_batches
def keep_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class of near duplicates: one row, the first of equal ids; null only without another.

    Null, empty and wordless texts are classes of their own and stay, each row of them; repeated rows of a text with words are copies. Very long
    texts are compared whole. No rows: no rows.
    """
    rows = numbered(docs)
    told = near_dedup.near_duplicates(rows, id_col=ROW)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW))
    return _only(rows, _chosen(rows, told, "class_id", best), keep=True).select(docs.columns)


@small_batches
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Each row is judged by its own text, whatever its id or copies; null, empty and wordless texts hold none and stay. Very long texts
    are sought through whole. No rows, or no benchmark: all rows stay.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = numbered(docs)
    return _only(rows, decontamination.contaminated(rows, benchmark, id_col=ROW), keep=False).select(docs.columns)


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences; see packing.pack for nulls, long texts, repeated rows and no rows."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", keep_exact),
    ("near_dedup", keep_near),
    ("decontamination", decontaminate),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
