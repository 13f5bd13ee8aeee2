"""Removal of boilerplate lines that many sites share, by HyperLogLog sketches of each line's sites."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import written


def _hash(line: F.Column, seed: int) -> F.Column:
    return F.xxhash64(F.lit(seed), line)


def text_key(text: F.Column) -> F.Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def boilerplate_lines(docs: DataFrame, min_sites: int = 10, log2_registers: int = 10, site_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lines, places): the lines (h1, h2, sites) of at least min_sites sites, and the (text_key, h1, h2) where they stand; a
    text's key is the MD5 of it.

    A sketch of its sites per line merges map-side and by shuffle. Lines whose estimate lies more than four standard errors
    below min_sites are out, those as far above it are in, and those between get an exact distinct count, so that a line of exactly
    min_sites sites is in.
    """
    # An outer explode: for others Catalyst adds a filter that would split each text twice.
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.select(text_key(F.col(text_col)).alias("text_key"), F.col(site_col).alias("site"), F.explode_outer(F.split(text, "\n")).alias("line"))
    lines = lines.select("text_key", "site", F.trim("line").alias("line")).where("line != ''")
    lines = lines.select("text_key", "site", _hash(F.col("line"), 1).alias("h1"), _hash(F.col("line"), 2).alias("h2"))
    sketches = lines.where(F.col("site").isNotNull()).groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(log2_registers)).alias("sketch"))
    off = 4 * 1.04 / math.sqrt(2**log2_registers)
    estimates = sketches.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= min_sites * (1 - off))
    candidates = written(estimates, "line-estimates")
    places = written(lines.join(candidates, ["h1", "h2"]).select("text_key", "site", "h1", "h2", "estimate").distinct(), "line-places")
    near = places.where((F.col("estimate") <= min_sites * (1 + off)) & F.col("site").isNotNull()).select("h1", "h2", "site").distinct()
    exact = near.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= min_sites)
    clear = candidates.where(F.col("estimate") > min_sites * (1 + off)).select("h1", "h2", F.col("estimate").alias("sites"))
    chosen = written(clear.union(exact), "boilerplate")
    return chosen, places.join(chosen.select("h1", "h2"), ["h1", "h2"], "left_semi").select("text_key", "h1", "h2").distinct()


def remove_boilerplate(docs: DataFrame, min_sites: int = 10, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """One row per row of docs: doc_id, lines, lines_removed, text (without the lines that min_sites sites or more share).

    Lines end at \\n; they are equal if they are identical after spaces at both ends are cut. Kept lines stay
    as they are, in order. Blank lines are never removed. What goes depends on the text alone, so a text's lines are looked up by its
    key: neither null nor repeated ids make a large group, and copies of a text have one row on the other side of the join, which
    shuffles each text once at any size and which adaptive execution can split at a hot text.

    Null text: null, no lines. Null site: counts as no site, and its lines are removed like any others. A line of exactly
    min_sites sites is removed. Very long texts are read whole. Repeated rows: a row each. No rows: no rows. Other columns are not read.
    """
    _, places = boilerplate_lines(docs, min_sites, site_col=site_col, text_col=text_col)
    drop = written(places.groupBy("text_key").agg(F.collect_list(F.struct("h1", "h2")).alias("drop")), "drop-lines")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), text_key(F.col(text_col)).alias("text_key"))
    rows = rows.join(drop.hint("merge"), "text_key", "left").drop("text_key")
    all_lines = F.split("body", "\n")
    goes = lambda x: F.array_contains("drop", F.struct(_hash(F.trim(x), 1).alias("h1"), _hash(F.trim(x), 2).alias("h2")))
    text = F.when(F.col("drop").isNull(), F.col("body")).otherwise(F.array_join(F.filter(all_lines, lambda x: (F.trim(x) == "") | ~goes(x)), "\n"))
    n = F.when(F.col("body").isNull(), 0).otherwise(F.size(all_lines)).cast("long")
    removed = F.when(F.col("drop").isNull() | F.col("body").isNull(), 0).otherwise(F.size(F.filter(all_lines, lambda x: (F.trim(x) != "") & goes(x)))).cast("long")
    return rows.select("doc_id", n.alias("lines"), removed.alias("lines_removed"), text.alias("text"))
