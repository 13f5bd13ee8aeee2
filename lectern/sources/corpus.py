"""Adapters from tables and directories to corpus rows: rel_path, file_hash, size_bytes, format, markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.markdown import markdown_of

EXTENSIONS = ("pdf", "docx", "doc", "md", "markdown", "txt")
INDEX_DIR = ".lectern"


def _rows(df: DataFrame, rel_path: F.Column, fmt: str, markdown: F.Column, *keep: str) -> DataFrame:
    body = F.coalesce(markdown, F.lit(""))
    return df.select(
        *keep, rel_path.alias("rel_path"), F.sha2(body.cast("binary"), 256).alias("file_hash"),
        F.octet_length(body).cast("long").alias("size_bytes"), F.lit(fmt).alias("format"), body.alias("markdown"),
    )


def from_documents(docs: DataFrame) -> DataFrame:
    return _rows(docs, F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), "txt", F.col("text"), "doc_id")


def from_pages(pages: DataFrame) -> DataFrame:
    path = F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html"))
    return _rows(pages, path, "html", markdown_of(F.col("html")), "page_id")


def from_conversations(turns: DataFrame) -> DataFrame:
    """One file a conversation: a title, then a section for each turn, which is also a page.

    page_marks holds the code-point offset at which each page starts.
    """
    part = F.concat(F.lit("## "), F.col("role"), F.lit(" "), F.col("turn").cast("string"), F.lit("\n"), F.col("text"), F.lit("\n"))
    title = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"))
    before = Window.partitionBy("conv_id").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)  # by which the rows are grouped next, too
    parts = turns.select("conv_id", "turn", part.alias("part"))
    offset = F.char_length(title) + F.coalesce(F.sum(F.char_length("part")).over(before), F.lit(0))
    parts = parts.withColumn("offset", offset.cast("int"))
    files = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "part", "offset"))).alias("parts"))
    marks = F.transform("parts", lambda p: F.struct(p["offset"].alias("offset"), (p["turn"] + 1).cast("int").alias("page")))
    files = files.withColumn("markdown", F.concat(title, F.array_join(F.col("parts")["part"], ""))).withColumn("page_marks", marks)
    return _rows(files, F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")), "md", F.col("markdown"), "conv_id", "page_marks")


def scan_directory(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Regular files under root whose suffix counts, without the index's own: rel_path, file_hash, size_bytes, format, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    rel = F.regexp_replace("path", rf"^[a-z]+:/+{base}/", "")
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.select(rel.alias("rel_path"), F.sha2("content", 256).alias("file_hash"), F.col("length").alias("size_bytes"), suffix.alias("format"), "content").where(
        F.col("format").isin(*extensions) & ~F.array_contains(F.split("rel_path", "/"), INDEX_DIR)
    )
