"""The nearest vectors by an inverted file: rows lie in the list of their nearest centroid, and a query reads the lists that can hold its nearest ones."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lectern.sources.shared import written

#: Centroids are fitted to this many rows at most, those of the least hashes of their ids.
SAMPLE = 20_000
#: About as many rows and queries meet as one pair of matrices, so many queries at a time.
CELL_ROWS, CELL_QUERIES, AT_A_TIME = 8192, 16_384, 128
#: Hits (query_id, vec_id, score) to hits with `rerank`, from 0 to 1.
Reranker = Callable[[DataFrame], DataFrame]


def _size(vector: str) -> Column:
    return F.sqrt(F.aggregate(F.col(vector).cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c))


def has_unit(vector: str) -> Column:
    """Whether a vector has a direction: it is not null, without null or infinite entries or NaN, and not all zero. Never null."""
    return F.coalesce((_size(vector) > 0) & (_size(vector) < float("inf")), F.lit(False))


def unit(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id and unit vector (array of doubles) of the rows that have a direction."""
    rows = vectors.where(has_unit(vector_col)).select(id_col, F.col(vector_col).cast("array<double>").alias("u"), _size(vector_col).alias("size"))
    return rows.select(id_col, F.transform("u", lambda c: c / F.col("size")).alias("u"))


def fit(vectors: DataFrame, lists: int, rounds: int = 12, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of spherical k-means over a bounded sample of vectors (vec_id, embedding), at most `lists`; the same for the same rows."""
    rows = unit(vectors)
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("u").collect()
    points = np.array([r["u"] for r in chosen])
    if not len(points):
        return np.zeros((0, 0))
    places = np.unique(np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int))
    centres = points[places]
    for _ in range(rounds):
        nearest = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def index(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """vec_id, u, list, angle: every row that has a direction, with its nearest centroid and the angle to it. Written, by list."""
    rows = unit(vectors).where(F.size("u") == centres.shape[1])

    def nearest(batches):
        for batch in batches:
            near = np.array(batch["u"].tolist()).reshape(-1, centres.shape[1]) @ centres.T
            lists = near.argmax(axis=1) if len(batch) else np.zeros(0, int)
            yield batch.assign(list=lists, angle=np.arccos(np.clip(near[np.arange(len(batch)), lists], -1, 1)))

    kind = rows.schema["vec_id"].dataType.simpleString()
    return written(rows.mapInPandas(nearest, f"vec_id {kind}, u array<double>, list int, angle double").repartition("list"), "inverted-file")


def _best(scored: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n")


def rounded(scores: np.ndarray) -> np.ndarray:
    """Scores to six places, halves away from zero."""
    return np.copysign(np.floor(np.abs(scores) * 1e6 + 0.5) / 1e6, scores)


def best_of_cells(rows: DataFrame, asked: DataFrame, lists: dict[int, int], k: int) -> DataFrame:
    """The k rows (vec_id, u, list) of the greatest cosine similarity to each query (query_id, q, list) among those of its lists: query_id, vec_id, score (to six
    places); ties by vec_id. lists: the number of rows of each list.

    The rows of a list are dealt to cells of about CELL_ROWS, its queries to blocks of about CELL_QUERIES, and each cell and block meet once, as two
    matrices: what is shuffled are the vectors, not the pairs. A cell gives k rows of each query at most.
    """
    places = max(lists, default=-1) + 1
    cells = F.element_at(F.array(*[F.lit(max(1, -(-lists.get(n, 0) // CELL_ROWS))) for n in range(max(1, places))]), F.col("list") + 1)
    per_list = asked.groupBy("list").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    blocks = max(1, -(-per_list // CELL_QUERIES))
    dealt = lambda count, *of: F.pmod(F.xxhash64(*of), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), (count - 1).cast("int")))
    left = rows.select("vec_id", "u", "list", F.size("u").alias("dim"), dealt(cells, "vec_id", "u").alias("cell"), every(F.lit(blocks)).alias("block"))
    right = asked.select("query_id", "q", "list", F.size("q").alias("dim"), dealt(F.lit(blocks), "query_id", "q").alias("block"), every(cells).alias("cell"))
    kinds = pa.schema([pa.field("query_id", to_arrow_type(asked.schema["query_id"].dataType)), pa.field("vec_id", to_arrow_type(rows.schema["vec_id"].dataType)), pa.field("score", pa.float64())])

    def met(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(vectors) or not len(queries):
            return kinds.empty_table()
        matrix = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        ids, own = vectors["vec_id"].combine_chunks(), matrix(vectors["u"]).T
        ranks = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
        said, near, scores, points, many = [], [], [], matrix(queries["q"]), len(vectors)
        for start in range(0, len(queries), AT_A_TIME):
            score = points[start : start + AT_A_TIME] @ own
            least = np.partition(score, many - k, axis=1)[:, many - k] if many > k else np.full(len(score), -2.0)
            q, v = np.nonzero(score >= (least - 2e-6)[:, None])  # rounding may lift a score to the k-th
            told = rounded(score[q, v])
            order = np.lexsort((ranks[v], -told, q))
            q, v, told = q[order], v[order], told[order]
            place = np.arange(len(q)) - np.searchsorted(q, q)
            keep = place < k
            said.append(q[keep] + start)
            near.append(v[keep])
            scores.append(told[keep])
        return pa.table([queries["query_id"].combine_chunks().take(pa.array(np.concatenate(said))), ids.take(pa.array(np.concatenate(near))), pa.array(np.concatenate(scores))], schema=kinds)

    of = ["list", "dim", "cell", "block"]
    types = f"query_id {asked.schema['query_id'].dataType.simpleString()}, vec_id {rows.schema['vec_id'].dataType.simpleString()}, score double"
    return _best(left.groupBy(*of).cogroup(right.groupBy(*of)).applyInArrow(met, types), k)


def search(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, exact: bool = True) -> DataFrame:
    """The k rows of an index of the greatest cosine similarity to each of queries (query_id, query): query_id, vec_id, score (to six places); ties by vec_id.
    Without exact, those of the first pass of passes()."""
    return passes(indexed, centres, queries, k, probes, exact)[1]


def passes(indexed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int, exact: bool = True) -> tuple[DataFrame, DataFrame]:
    """The hits of the first pass, and those of both, or of the first again without exact.

    1. A query reads the `probes` lists whose centroids are nearest to it.
    2. With exact, its k-th score so far rules out each list whose rows all lie too near their centroid, that is as far from the query: by
       the angles, none can be better. The lists that are left are read too. So nothing is missed, and nothing is read twice.
    Queries without a direction have no hits. Only centroids, their greatest angles and their counts, a row a list, are on the driver; a list is read in cells.
    """
    many, dim = centres.shape if centres.size else (0, 0)
    asked = unit(queries.select("query_id", "query"), "query_id", "query").where(F.size("u") == dim)
    if not many:
        none = asked.select("query_id", F.lit(None).cast(indexed.schema["vec_id"].dataType).alias("vec_id"), F.lit(0.0).alias("score")).where("false")
        return none, none
    reach, counts = np.full(many, -1.0), {}
    for r in indexed.groupBy("list").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():
        reach[r["list"]], counts[r["list"]] = r["angle"], r["n"]

    def ranked(batches):
        for batch in batches:
            near = np.array(batch["u"].tolist()).reshape(-1, dim) @ centres.T
            order = np.argsort(-near, axis=1, kind="stable")
            places = np.argsort(order, axis=1, kind="stable")
            most = np.where(reach < 0, -2.0, np.cos(np.maximum(0.0, np.arccos(np.clip(near, -1, 1)) - reach)))  # of an empty list: nothing
            rows = len(batch)
            yield pd.DataFrame({"query_id": np.repeat(batch["query_id"].to_numpy(), many), "list": np.tile(np.arange(many), rows), "place": places.ravel(), "most": most.ravel()})

    kind = asked.schema["query_id"].dataType.simpleString()
    plan = written(asked.mapInPandas(ranked, f"query_id {kind}, list int, place int, most double").where("most > -2"), "lists-of-queries")

    def read(lists: DataFrame) -> DataFrame:
        pairs = lists.select("query_id", "list").join(asked.withColumnRenamed("u", "q"), "query_id")
        return best_of_cells(indexed, pairs, counts, k)

    first = written(read(plan.where(F.col("place") < probes)), "first-hits")
    if not exact:
        return first, first
    held = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    rest = plan.where(F.col("place") >= probes).join(held, "query_id", "left")
    rest = rest.where((F.coalesce("n", F.lit(0)) < k) | (F.col("most") >= F.col("least") - 1e-6))  # scores are rounded, and rounding must not rule out
    return first, _best(first.unionByName(read(rest)), k)


def recall(found: DataFrame, truth: DataFrame) -> float:
    """The share of truth's hits (query_id, vec_id) that are among found ones; 1 without any."""
    total = truth.count()
    return truth.join(found.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0


def reranked(hits: DataFrame, rerank: Reranker, k: int) -> DataFrame:
    """query_id, vec_id, score, rerank: the k hits of each query that a reranker puts first; equal ones by score, then vec_id. Hits that it leaves out count 0."""
    given = rerank(hits).select("query_id", "vec_id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("rerank"))).alias("rerank"))
    rows = hits.join(given, ["query_id", "vec_id"], "left").withColumn("rerank", F.coalesce("rerank", F.lit(0.0)))
    first = Window.partitionBy("query_id").orderBy(F.desc("rerank"), F.desc("score"), "vec_id")
    return rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).drop("n").select("query_id", "vec_id", "score", "rerank")
