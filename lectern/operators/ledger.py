"""Costs, retention and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.vectors import best_of_cells, has_unit, unit


def usage_by_task(calls: DataFrame) -> DataFrame:
    """calls (task, tokens_in, tokens_out) summed by task."""
    return calls.groupBy("task").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))


def newest_runs(evaluations: DataFrame, keep: int = 20) -> DataFrame:
    """evaluations of the `keep` runs with the latest rows; ties by run_id."""
    runs = evaluations.groupBy("run_id").agg(F.max("evaluated_at").alias("last")).orderBy(F.desc("last"), F.desc("run_id")).limit(keep)
    return evaluations.join(F.broadcast(runs.select("run_id")), "run_id", "left_semi")


def estimate_query(file_tokens: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """One row: files, extract_in, extract_out, synthesize_in, synthesize_out, from the files' tokens."""
    row = file_tokens.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("extract_in"))
    out = F.col("files") * max_tokens
    return row.select("files", "extract_in", out.alias("extract_out"), out.alias("synthesize_in"), F.lit(max_tokens).cast("long").alias("synthesize_out"))


def estimate_pass1(pending_tokens: DataFrame, cards: DataFrame, window: int = 32768, max_tokens: int = 1024) -> DataFrame:
    """One row: catalogue tokens of the pending files, routing tokens of all cards, and shards, which both the input window and the reply's room bound."""
    budget, most = max(window - 2000, 2000), max(1, (max_tokens - 200) // 60)
    row = pending_tokens.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("catalog_in"), (F.count(F.lit(1)) * max_tokens).alias("catalog_out"))
    routed = cards.agg((F.count(F.lit(1)) * max_tokens).alias("route_in"), F.count(F.lit(1)).alias("cards"))
    shards = F.greatest(F.ceil(F.col("route_in") / budget), F.ceil(F.col("cards") / most)).cast("long")
    return row.join(F.broadcast(routed)).select("catalog_in", "catalog_out", "route_in", shards.alias("shards"))


def rate(override: Column, other: Column, listed: Column) -> Column:
    """Price of a million tokens: the task's own if either of its two prices is set (0 for the other), else the listed one, else 0."""
    return F.when(override.isNotNull() | other.isNotNull(), F.coalesce(override, F.lit(0.0))).otherwise(F.coalesce(listed, F.lit(0.0)))


def costs(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """tokens (task, tokens_in, tokens_out) and prices (task, in_rate, out_rate a million) to task, cost, rounded to four places."""
    cost = (F.col("tokens_in") * F.coalesce("in_rate", F.lit(0.0)) + F.col("tokens_out") * F.coalesce("out_rate", F.lit(0.0))) / 1_000_000
    return tokens.join(prices, "task", "left").select("task", F.round(cost, 4).alias("cost"))


def call_costs(calls: DataFrame, tasks: DataFrame, listed: DataFrame) -> DataFrame:
    """calls (task, served, tokens_in, tokens_out; other columns stay) with cost, unrounded: by the task's own prices if it has one and its primary model, with
    or without its provider before a slash, served the call; else by the served model's listed prices; 0 for a model that isn't listed.

    tasks (task, primary, in_rate, out_rate) and listed (model, in_rate, out_rate) hold a row each for a task and a model; prices are a million tokens'.
    """
    own = tasks.select("task", "primary", F.col("in_rate").alias("own_in"), F.col("out_rate").alias("own_out"))
    table = listed.select(F.col("model").alias("served"), F.col("in_rate").alias("listed_in"), F.col("out_rate").alias("listed_out"))
    both = calls.join(own, "task", "left").join(table, "served", "left")
    is_primary = F.coalesce(F.col("served").isin(F.col("primary"), F.regexp_replace("primary", r"^[^/]*/", "")), F.lit(False))
    mine, other = F.when(is_primary, F.col("own_in")), F.when(is_primary, F.col("own_out"))
    cost = (F.col("tokens_in") * rate(mine, other, F.col("listed_in")) + F.col("tokens_out") * rate(other, mine, F.col("listed_out"))) / 1_000_000
    return both.select(*calls.columns, cost.alias("cost"))


def newest_first(evaluations: DataFrame, of: list[str], by: list[str]) -> DataFrame:
    """evaluations with place: 1 for the newest of those of the same file (the columns `of`), by the columns `by`, which tell them apart."""
    return evaluations.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(*[F.desc(c) for c in by])))


def score_routing(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """pairs (pair) with recall, precision, and counts of missing, stray, forbidden, from marks (pair, file, expected, forbidden, candidate), a
    row for each file that is any of these; files stay rows, so no pair's files are gathered."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    want, got, bad = F.col("expected"), F.col("candidate"), F.col("forbidden")
    counts = marks.groupBy("pair").agg(n(want).alias("want"), n(got).alias("got"), n(want & got).alias("hit"), n(bad & got).alias("forbidden"))
    part = lambda of: F.when(F.coalesce(F.col(of), F.lit(0)) == 0, 1.0).otherwise(F.col("hit") / F.col(of))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    scored = pairs.join(counts, "pair", "left")
    return scored.select(
        "pair", part("want").alias("recall"), part("got").alias("precision"), zero(F.col("want") - F.col("hit")).alias("missing"),
        zero(F.col("got") - F.col("hit")).alias("stray"), zero(F.col("forbidden")).alias("forbidden"),
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) of the greatest cosine similarity to each of queries (query_id, query): query_id, vec_id, score;
    ties by vec_id.

    A stated query set is tried on all rows, in cells of rows and blocks of queries that meet as matrices. Vectors without a direction (null,
    with null or infinite entries or NaN, or all zero), on either side, have scores that are null or NaN: they are tried in rows, in blocks of about `block` queries.
    """
    rows, asked = unit(vectors).withColumn("list", F.lit(0)), unit(queries, "query_id", "query").withColumnRenamed("u", "q").withColumn("list", F.lit(0))
    found = best_of_cells(rows, asked, {0: rows.count()}, k)
    odd, other = vectors.where(~has_unit("embedding")), queries.where(~has_unit("query"))
    for some, of in ((odd, queries), (vectors.where(has_unit("embedding")), other)):
        if not some.isEmpty() and not of.isEmpty():
            found = found.unionByName(_by_rows(some, of, block))
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n")


def _by_rows(vectors: DataFrame, queries: DataFrame, block: int) -> DataFrame:
    """query_id, vec_id, score of all pairs, in blocks of about `block` queries, a row each."""
    blocks = max(1, -(-queries.count() // block))
    doubles = lambda c: F.col(c).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    asked = queries.select("query_id", doubles("query").alias("q")).withColumn("norm", dot(F.col("q"), F.col("q")))
    asked = asked.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("query_id", "q", "norm")).alias("asked")).drop("block")
    rows = vectors.select("vec_id", doubles("embedding").alias("e")).withColumn("own", dot(F.col("e"), F.col("e")))
    scores = F.transform("asked", lambda q: F.struct(q["query_id"].alias("query_id"), F.round(F.coalesce(F.try_divide(dot(F.col("e"), q["q"]), F.sqrt(F.col("own") * q["norm"])), F.when(F.col("own") * q["norm"] == 0, float("nan"))), 6).alias("score")))
    return rows.crossJoin(asked).select("vec_id", F.explode(scores).alias("s")).select("s.query_id", "vec_id", "s.score")
