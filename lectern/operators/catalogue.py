"""The index as tables: files, and what hangs on them by their hashes (cards, verdicts, chunks). A run of the index is a few joins
with the drift of a scan; tables are returned whole, so that a writer can swap them in at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_forced(drift: DataFrame, forced: DataFrame) -> DataFrame:
    """drift in which unchanged files of the paths in forced (rel_path) are `forced`; other kinds ignore the wish."""
    wished = forced.select("rel_path", F.lit(True).alias("wished")).distinct()
    kind = F.when((F.col("drift") == "unchanged") & F.coalesce("wished", F.lit(False)), "forced").otherwise(F.col("drift"))
    return drift.join(wished, "rel_path", "left").select("rel_path", "file_hash", kind.alias("drift"), "old_path")


def apply_drift(known: DataFrame, scan: DataFrame, drift: DataFrame) -> DataFrame:
    """The files (file_hash, rel_path, size_bytes, format, ...) after an index run over known, which has the same columns.

    Deleted files and the contents that modified paths had go; moved files get their new path; new, modified and forced ones are
    taken from the scan, a content once, under its owner's path.
    """
    gone = drift.where("drift = 'deleted'").select("file_hash").union(known.join(drift.where("drift = 'modified'").select("rel_path"), "rel_path", "left_semi").select("file_hash"))
    gone = gone.join(scan.select("file_hash"), "file_hash", "left_anti")  # contents that a modified path had and another path has now stay
    taken = scan.join(drift.where(F.col("drift").isin("new", "modified", "forced")).select("rel_path"), "rel_path", "left_semi").select(known.columns)
    moved = drift.where("drift = 'moved'").select("file_hash", F.col("rel_path").alias("new_path"))
    kept = known.join(gone.distinct(), "file_hash", "left_anti").join(taken.select("file_hash"), "file_hash", "left_anti")
    kept = kept.join(moved, "file_hash", "left").withColumn("rel_path", F.coalesce("new_path", "rel_path")).select(known.columns)
    return kept.unionByName(taken)


def dependents(rows: DataFrame, known: DataFrame, files: DataFrame, drift: DataFrame) -> DataFrame:
    """rows (with file_hash) that outlive an index run: those of files known before and after it, which weren't written anew."""
    anew = drift.where(F.col("drift").isin("new", "modified", "forced")).select("file_hash")
    return rows.join(known.select("file_hash"), "file_hash", "left_semi").join(files.select("file_hash"), "file_hash", "left_semi").join(anew, "file_hash", "left_anti")


def status(drift: DataFrame, files: DataFrame) -> DataFrame:
    """What a look at the index shows: rel_path, kind, detail: drift that a run would act on, duplicates with their owners, flagged files."""
    changes = drift.where(~F.col("drift").isin("unchanged", "duplicate")).select("rel_path", F.col("drift").alias("kind"), F.coalesce("old_path", F.lit("")).alias("detail"))
    copies = drift.where("drift = 'duplicate'").select("rel_path", F.lit("duplicate").alias("kind"), F.col("old_path").alias("detail"))
    marked = flagged(files).select("rel_path", F.lit("flagged").alias("kind"), F.col("parse_status").alias("detail"))
    return changes.union(copies).union(marked)


def queryable(files: DataFrame) -> DataFrame:
    """The files that can be asked: parsed in whole or in part."""
    return files.where(F.col("parse_status").isin("ok", "partial_parse"))


def flagged(files: DataFrame) -> DataFrame:
    """The files that a user should look at: all but those parsed in whole, so those parsed in part too."""
    return files.where("parse_status != 'ok'")


def latest(stored: DataFrame, new: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """stored and new rows of the same columns, one of each key: the last by the columns `by`, new rows before stored ones at ties.
    It combines before the shuffle."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in stored.columns if c not in key and c not in by]
    one = both.groupBy(*key).agg(F.max(F.struct(*by, "_new", *rest)).alias("_last"))
    return one.select(*key, *[F.col(f"_last.{c}").alias(c) for c in stored.columns if c not in key])


def conversion_status(outcome: Column, errors: Column, chars: Column, pages: Column) -> Column:
    """parse_status and parse_error of a converter's outcome: a partial one is usable and names its first ten errors and how many
    more there are, a failed one its first five; a whole one is judged by its text."""
    shown = lambda n: F.array_join(F.slice(errors, 1, n), "; ")
    more = F.when(F.size(errors) > 10, F.concat(F.lit(" (+"), (F.size(errors) - 10).cast("string"), F.lit(" more)"))).otherwise("")
    zero = F.when((pages > 0) & (chars < 200), "zero_text").otherwise("ok")
    return F.when(outcome == "partial_success", F.struct(F.lit("partial_parse").alias("parse_status"), F.concat(shown(10), more).alias("parse_error"))).when(
        outcome == "success", F.struct(zero.alias("parse_status"), F.lit(None).cast("string").alias("parse_error"))
    ).otherwise(F.struct(F.lit("parse_failed").alias("parse_status"), shown(5).alias("parse_error")))


def page_map(items: DataFrame) -> DataFrame:
    """items (rel_path, seq, offset, page) to the marks (rel_path, offset, page) where the page changes in the order of items."""
    before = F.lag("page").over(Window.partitionBy("rel_path").orderBy("seq"))
    found = items.where(F.col("offset") >= 0).withColumn("before", before)
    return found.where(~F.col("page").eqNullSafe(F.col("before"))).select("rel_path", "offset", "page")
