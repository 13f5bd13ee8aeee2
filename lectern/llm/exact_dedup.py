"""Exact deduplication by salted combining of digest groups. DataFrame operations only."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import written


def fold_ascii(text: Column) -> Column:
    """text with A-Z in lower case and nothing else changed; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; the largest id of equal texts stays.

    1. Each task combines its own rows by (digest, text, salt); the salt is the task's number modulo
       `salts`, so a text leaves a task once, however many copies the task has read.
    2. The salted groups merge; a hot text is spread over `salts` groups.
    3. The winners, at most `salts` for each text, combine into one row per text.
    The text itself is a grouping key at each of these, so equality never rests on a digest. If two texts had
    one SHA-256 the job would stop instead of merging them. The groups, without texts, are written to the
    shared folder. Joining them to the documents' ids and digests has a plain shuffle on both sides, so
    adaptive execution can split a hot digest's partition.

    Null or empty text: the empty text's group. Null id: never preferred to another; if a group has
    no other id, its keep_id is null and all its rows are kept. Repeated rows of one id count one by
    one and get the same decision. No rows: no rows. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("digest", F.sha2(F.col("norm").cast("binary"), 256))
    salted = rows.groupBy("digest", "norm", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt")).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")
    )
    texts = salted.repartition("digest").groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = texts.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("texts")
    )
    one_text = F.when(F.col("texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts have one SHA-256")).cast("long")
    )
    groups = written(groups.select("digest", "keep_id", one_text.alias("group_size")), "text-groups")
    return (
        rows.select("doc_id", "digest")
        .join(groups, "digest")
        .select(
            "doc_id", "keep_id", "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )
    )
