"""The inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import ledger, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def rows(count, dim=8, seed=3, groups=6):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim)) * 2
    return [(i, np.float32(centres[i % groups] + rng.standard_normal(dim)).tolist()) for i in range(count)]


def by_brute_force(data, queries, k):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in data if v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    want = set()
    for q, v in queries:
        scores = sorted((-round(float(u @ (np.array(v) / np.linalg.norm(v))), 6), i) for i, u in unit.items())
        want |= {(q, i, -s) for s, i in scores[:k]}
    return want


@pytest.mark.parametrize("probes", [1, 3])
@pytest.mark.parametrize("k", [1, 7, 500])
def test_the_second_pass_makes_the_hits_exact(spark, probes, k):
    odd = [(900, None), (901, [0.0] * 8), (902, [float("nan")] + [1.0] * 7), (903, [None] + [1.0] * 7), (904, [float("inf")] * 8)]
    data = [*rows(300), *[(i + 1000, rows(1)[0][1]) for i in range(5)]]  # ties
    centres = vectors.fit(table(spark, data + odd), 9)
    index = vectors.index(table(spark, data + odd), centres)
    assert index.count() == len(data)
    asked = [(i, v) for i, v in data if i % 50 == 0]
    queries = spark.createDataFrame([*asked, (77, None), (78, [0.0] * 8)], "query_id long, query array<float>")
    got = vectors.search(index, centres, queries, k, probes)
    truth = by_brute_force(data, asked, k)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == {t[:2] for t in truth} and got.count() == len(truth)
    assert {(r.query_id, r.vec_id): r.score for r in got.collect()} == pytest.approx({t[:2]: t[2] for t in truth}, abs=2e-6)
    first = vectors.search(index, centres, queries, k, probes, exact=False)
    share = len({(r.query_id, r.vec_id) for r in first.collect()} & {t[:2] for t in truth}) / len(truth)
    assert vectors.recall(first, got) == pytest.approx(share) and vectors.recall(got, got) == 1.0


def test_nothing_to_search(spark):
    none = table(spark, [(1, None)])
    centres = vectors.fit(none, 4)
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, query array<float>")
    index = vectors.unit(none).withColumns({"list": F.lit(0), "angle": F.lit(0.0)})
    assert vectors.search(index, centres, queries, 3, 1).count() == 0
    assert vectors.recall(queries.select("query_id", F.lit(1).alias("vec_id")).limit(0), queries.select("query_id", F.lit(1).alias("vec_id")).limit(0)) == 1.0


def test_a_reranker_decides_and_what_it_leaves_out_comes_last(spark):
    hits = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.7), (1, 13, 0.95)], "query_id long, vec_id long, score double")
    got = vectors.reranked(hits, lambda h: h.where("vec_id != 13").withColumn("rerank", F.when(F.col("vec_id") == 12, 5.0).otherwise(0.5)), 3).collect()
    assert sorted((-r.rerank, -r.score, r.vec_id) for r in got) == [(-1.0, -0.7, 12), (-0.5, -0.9, 10), (-0.5, -0.8, 11)]


def test_hits_in_small_cells_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_ROWS", 40)
    monkeypatch.setattr(vectors, "CELL_QUERIES", 3)
    monkeypatch.setattr(vectors, "AT_A_TIME", 2)
    data = [*rows(200), *[(i + 1000, rows(1)[0][1]) for i in range(60)]]
    asked = [(i, v) for i, v in data if i % 20 == 0]
    queries = spark.createDataFrame(asked, "query_id long, query array<float>")
    got = ledger.nearest(table(spark, data), queries, 9).collect()
    truth = by_brute_force(data, asked, 9)
    assert {(r.query_id, r.vec_id) for r in got} == {t[:2] for t in truth} and len(got) == len(truth)
    assert {(r.query_id, r.vec_id): r.score for r in got} == pytest.approx({t[:2]: t[2] for t in truth}, abs=2e-6)


def test_vectors_without_a_direction_have_no_number_as_in_sql(spark):
    data = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [1.0, 1.0])]
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, None)], "query_id long, query array<float>")
    got = ledger.nearest(table(spark, data), queries, 4).orderBy("query_id", F.desc("score"), "vec_id").collect()
    assert [(r.query_id, r.vec_id, repr(r.score)) for r in got] == [
        (10, 2, "nan"), (10, 1, "1.0"), (10, 5, "0.707107"), (10, 3, "None"), *[(11, i, "None") for i in (1, 2, 3, 4)],
    ]


def test_pairs_are_not_shuffled(spark):
    """What is shuffled are vectors: no step before the cells has a row for each pair."""
    data = table(spark, rows(400))
    asked = data.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    plan = ledger.nearest(data, asked, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
