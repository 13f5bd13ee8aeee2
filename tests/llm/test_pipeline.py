"""The queries with SQL, and the pipeline against plain reckoning of its stages."""

import re
import zlib

import corpus_pipeline
import pyarrow as pa
import pytest
from oracle import SF_DIR, differences
from pyspark.sql import functions as F
from test_dedup import classes, contaminated_by_brute_force

from lectern.llm import queries


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_query_matches_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF_DIR), queries.ORACLE_SQL[name], SF_DIR) == []


def test_pipeline_keeps_what_its_stages_keep(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.text for r in docs if r.text and any(c.isalpha() for c in r.text)}
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    rows = {i: rows[i] for i in {fold(t): i for i, t in sorted(rows.items())}.values()}
    rows = {i: rows[i] for i in set(classes(sorted(rows.items())).values())}
    dirty = {i for i, _ in contaminated_by_brute_force(list(rows.items()), items)}
    got = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r.doc_id for r in got} == set(rows) - dirty
    assert all(0 <= r.offset <= 2048 - r.length and 0 <= r.ids_crc32 < 2**32 for r in got)
    assert zlib.crc32((1).to_bytes(4, "little")) not in {r.ids_crc32 for r in got}


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_stages_decide_by_row(spark, tmp_path):
    """Null and repeated ids: a decision on a row doesn't hit the others of its id, and one row of a group stays."""
    item, words = "alpha beta gamma delta epsilon zeta eta theta iota kappa", [f"w{i}x" for i in range(60)]
    near, far = " ".join(words), " ".join([*words[:-1], "other"])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def after(stage, *rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        got = stage(spark, docs.repartition(3), str(tmp_path))
        assert got.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in got.collect()), key=str)

    clean = [(None, "one clean text"), (None, "two clean texts"), (7, "three clean texts")]
    known = [(i, "known words") for i in range(20, 30)]
    assert after(corpus_pipeline.identify_language, *clean, *known, (None, None), (None, "12 34"), (7, "")) == sorted(clean + known, key=str)
    assert after(corpus_pipeline.decontaminate, *clean, (None, item), (7, item)) == sorted(clean, key=str)
    assert after(corpus_pipeline.keep_exact, (None, "a"), (None, "A"), (None, "b"), (3, "b"), (3, "b"), (5, "c"), (3, "c")) in ([(3, "b"), (5, "c"), (None, "a")], [(3, "b"), (5, "c"), (None, "A")])
    got = after(corpus_pipeline.keep_near, (None, near), (4, far), (4, far), (6, near), (4, "quite another"), (None, item), (None, item))
    assert got == sorted([(4, far), (4, "quite another"), (None, item)], key=str)
    whole = known[:1] + [(i, f"more words {i}") for i in range(30, 40)] + [(None, f"{k} clean text of its own number {k}") for k in ("one", "two", "three")] + [(9, "nine"), (9, "neuf")]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert after(stage, *whole) == sorted(whole, key=str)


def test_stages_hand_texts_to_python_in_small_batches(spark, monkeypatch):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20_000).alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda df, path: df.mapInArrow(sizes, "bytes long").collect())
    found = [r.bytes for r in dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")]
    assert sum(found) >= 30_000_000 and max(found) < 2 * corpus_pipeline.BATCH_BYTES
    assert spark.conf.get(corpus_pipeline.BATCH, None) is None
