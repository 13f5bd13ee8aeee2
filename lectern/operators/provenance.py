"""Where things stand in a file: pages recovered from a converter's items, and chunks for a vector index with headings, pages and places."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lectern.functions import text as T

#: Characters of an item that are sought in its file, and the statuses of files that may be chunked.
ANCHOR = 40
USABLE = ("ok", "partial_parse")
#: A heading: up to three spaces, one to six marks, and white space.
HEADING = r"^ {0,3}(#{1,6})[ \t]+(.*)$"


@F.pandas_udf(ArrayType(IntegerType()))
def places_of(texts: pd.Series, anchors: pd.Series) -> pd.Series:
    """The place of each of a text's anchors, in code points: behind the one before, else its first, else -1. What isn't in a text is sought once."""

    def walk(text: str, asked: list[str]) -> list[int]:
        out, cursor, missing = [], 0, set()
        for anchor in asked:
            at = -1
            if anchor not in missing:
                at = text.find(anchor, cursor)
                at = text.find(anchor) if at < 0 else at
            if at < 0:
                missing.add(anchor)
            else:
                cursor = at + len(anchor)
            out.append(at)
        return out

    return pd.Series([walk(t or "", a) for t, a in zip(texts, anchors, strict=True)])


def anchored_marks(items: DataFrame, files: DataFrame) -> DataFrame:
    """The page map of files (rel_path, markdown): rel_path, offset, page, from a converter's items (rel_path, seq, text, page), whose text stands somewhere in
    the markdown.

    Items are sought in their order by their first 40 characters, without white space around them, each behind the one before; one that isn't
    there any more is sought from the start. A mark stands where the page of the items found changes. Items without text, or
    without a page, and those that aren't found, are passed over; files without items have no marks. Two marks at one place stay, in the order of pages.
    A file's items meet its text in one row: anchors are no longer than the text itself, but for items that aren't there.
    """
    anchor = F.substring(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), 1, ANCHOR)
    known = items.where("page is not null").select("rel_path", "seq", anchor.alias("anchor"), "page").where("anchor != ''")
    listed = known.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct("seq", "anchor", "page"))).alias("items"))
    rows = listed.join(files.select("rel_path", "markdown"), "rel_path").withColumn("at", places_of("markdown", F.col("items")["anchor"]))
    found = F.filter(F.transform("items", lambda i, k: F.struct(F.get("at", k).alias("offset"), i["page"].alias("page"))), lambda m: m["offset"] >= 0)
    rows = rows.select("rel_path", found.alias("found"))
    turned = F.filter("found", lambda m, k: (k == 0) | (m["page"] != F.get("found", k - 1)["page"]))
    return rows.select("rel_path", F.explode(F.array_sort(turned)).alias("m")).select("rel_path", "m.offset", "m.page")


def with_marks(files: DataFrame, marks: DataFrame) -> DataFrame:
    """files with page_marks, an array of (offset, page) in order of offset; empty for files without marks."""
    listed = marks.groupBy("rel_path").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").cast("int").alias("offset"), F.col("page").cast("int").alias("page")))).alias("page_marks"))
    none = F.array().cast("array<struct<offset:int,page:int>>")
    return files.drop("page_marks").join(listed, "rel_path", "left").withColumn("page_marks", F.coalesce("page_marks", none))


def gate(files: DataFrame) -> DataFrame:
    """The files that may be chunked: those parsed, in whole or in part, and with a text."""
    return files.where(F.col("parse_status").isin(*USABLE) & F.col("markdown").isNotNull())


def chunks_of(most: int) -> Callable[..., Column]:
    """A function of a file's lines with their ends, and their levels (null for lines that aren't headings) and titles: its chunks of at most `most` characters."""

    @F.pandas_udf("array<struct<start:bigint,heading_path:array<string>,text:string>>")
    def cut(lines: pd.Series, levels: pd.Series, titles: pd.Series) -> pd.Series:
        def walk(text: list[str], level: list[float], title: list[str]) -> list[dict]:
            out, heads, at, held, room = [], [], 0, [], 0
            for line, deep, name in zip(text, level, title, strict=True):
                if not pd.isna(deep):
                    heads, room = [*(h for h in heads if h[0] < deep), (deep, name)], 0
                for k in range(0, len(line), most):
                    part = line[k : k + most]
                    if len(part) > room:
                        held, room = [], most
                        out.append({"start": at + k, "heading_path": [h[1] for h in heads], "text": held})
                    held.append(part)
                    room -= len(part)
                at += len(line)
            return [c | {"text": "".join(c["text"])} for c in out]

        return pd.Series([walk(*row) for row in zip(lines, levels, titles, strict=True)], dtype=object)

    return cut


def token_chunks(files: DataFrame, target_tokens: int = 512) -> DataFrame:
    """Chunks of files (rel_path, file_hash, parse_status, markdown, page_marks) for a vector index: chunk_id (hash:number), file_hash, rel_path, chunk_index,
    heading_path (array: of each level the last heading behind all higher ones), page (null without a mark before it), char_start, char_end, text.

    A chunk never crosses a heading and holds at most target_tokens tokens (a fourth of its characters): lines that follow each other
    are merged until the next one would not fit, and a longer line is cut. Every chunk is the very text between its places, so equal
    sections have places of their own; chunks of white space alone are left out. Files that the gate holds back, and
    empty ones, have no chunks. A file is cut where its row is, so nothing is shuffled.
    """
    mark = lambda line: F.regexp_replace(line, r"\r?\n$", "")
    level = lambda line: F.when(mark(line).rlike(HEADING), F.char_length(F.regexp_extract(mark(line), HEADING, 1)))
    title = lambda line: F.trim(F.regexp_extract(mark(line), HEADING, 2))
    lines = gate(files).withColumn("lines", F.filter(F.split("markdown", r"(?<=\n)"), lambda line: line != ""))
    cut = lines.withColumn("chunks", chunks_of(4 * target_tokens + 3)("lines", F.transform("lines", level), F.transform("lines", title)))
    whole = cut.select("rel_path", "file_hash", "page_marks", F.posexplode(F.filter("chunks", lambda c: c["text"].rlike(r"\S"))).alias("chunk_index", "c"))
    return whole.select(
        F.concat("file_hash", F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "file_hash", "rel_path", "chunk_index", "c.heading_path",
        T.page_at(F.col("page_marks"), F.col("c.start")).alias("page"), F.col("c.start").alias("char_start"), (F.col("c.start") + F.char_length("c.text")).alias("char_end"), "c.text",
    )


def replaced(stored: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
    """stored rows with those of the files in done (file_hash) replaced by new ones; a file without new rows loses the ones it had."""
    return stored.join(done.select("file_hash").distinct(), "file_hash", "left_anti").select(stored.columns).unionByName(new.select(stored.columns))
