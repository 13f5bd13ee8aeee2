"""Words and hashed word shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH = 5


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits; null or wordless text: an empty array."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def with_shingles(df: DataFrame, text_col: str, out: str = "shingles") -> DataFrame:
    """df with out: the 64-bit hashes of all runs of five words, in order, repeats included.

    One to four words: one hash, of them all. No words: an empty array. The word hashes are a column of their
    own, which Catalyst keeps apart, so that each is computed once.
    """
    df = df.withColumn("_hashes", F.transform(words(F.col(text_col)), lambda w: F.xxhash64(w)))
    h, n = F.col("_hashes"), F.size("_hashes")
    runs = F.transform(
        F.sequence(F.lit(0), n - WIDTH), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WIDTH)])
    )
    whole = F.array(F.xxhash64(h))
    none = F.array().cast("array<bigint>")
    return df.withColumn(out, F.when(n >= WIDTH, runs).when(n > 0, whole).otherwise(none)).drop("_hashes")
