"""Drift of a scan against the known files: unchanged, duplicate, modified, moved, new, deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(scan: DataFrame, known: DataFrame) -> DataFrame:
    """scan and known have rel_path and file_hash. One row per scanned path, and per hash gone: rel_path, file_hash, drift, old_path.

    A hash's owner is its unchanged path, else its first path by folders. Others are duplicates of
    it; an owner is modified if its path was known, moved if its hash was, and new else.
    """
    by_path = known.select("rel_path", F.col("file_hash").alias("known_hash"))
    by_hash = known.groupBy("file_hash").agg(F.min("rel_path").alias("known_path"))
    rows = scan.select("rel_path", "file_hash").join(by_path, "rel_path", "left").join(by_hash, "file_hash", "left")
    unchanged = F.coalesce(F.col("known_hash") == F.col("file_hash"), F.lit(False))
    rows = rows.withColumn("changed", ~unchanged)
    first = rows.groupBy("file_hash").agg(F.min(F.struct("changed", F.split("rel_path", "/").alias("parts"), "rel_path"))["rel_path"].alias("owner"))
    rows = rows.join(first, "file_hash")
    drift = (
        F.when(~F.col("changed"), "unchanged").when(F.col("owner") != F.col("rel_path"), "duplicate")
        .when(F.col("known_hash").isNotNull(), "modified").when(F.col("known_path").isNotNull(), "moved").otherwise("new")
    )
    old = F.when(F.col("drift") == "duplicate", F.col("owner")).when(F.col("drift") == "moved", F.col("known_path"))
    found = rows.withColumn("drift", drift).select("rel_path", "file_hash", "drift", old.alias("old_path"))
    modified = found.where("drift = 'modified'").select("rel_path")
    gone = known.select("rel_path", "file_hash").join(scan.select("file_hash"), "file_hash", "left_anti").join(modified, "rel_path", "left_anti")
    return found.unionByName(gone.withColumns({"drift": F.lit("deleted"), "old_path": F.lit(None).cast("string")}))


def final_files(scan: DataFrame) -> DataFrame:
    """The catalogue after an index run: one path for each hash on disk, so no order of moves and edits can lose one."""
    first = scan.groupBy("file_hash").agg(F.min(F.struct(F.split("rel_path", "/").alias("parts"), "rel_path"))["rel_path"].alias("rel_path"))  # no text is gathered
    return scan.join(first, ["file_hash", "rel_path"], "left_semi").select(scan.columns)


def parse_status(chars: F.Column, pages: F.Column) -> F.Column:
    """zero_text for paged files of under 200 characters, else ok."""
    return F.when((pages > 0) & (chars < 200), "zero_text").otherwise("ok")
