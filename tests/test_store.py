"""The index on disk: two runs, of which the second writes only what has changed, and logs."""

import glob
import hashlib
import os
from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lectern.operators import provenance
from lectern.operators import store as stores

SCAN = "rel_path string, file_hash string, size_bytes long, format string, parse_status string, markdown string, page_marks array<struct<offset:int,page:int>>"


def scan(spark, texts):
    rows = [(p, hashlib.sha256(t.encode()).hexdigest(), len(t), "md", "parse_failed" if p == "bad.md" else "ok", t, []) for p, t in texts.items()]
    return spark.createDataFrame(rows, SCAN)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def state(store):
    return {name: sorted(map(str, (r.asDict() for r in store.read(name).collect()))) for name in stores.TABLES}


def at(seconds):
    return F.timestamp_seconds(F.lit(1_700_000_000 + seconds))


def stamps(root):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/*/bucket=*/*.parquet")}


TEXTS = {f"{k}.md": f"# Title {k}\nwords of file {k}\n" for k in range(40)} | {"bad.md": "no chunks"}


def test_a_second_run_writes_only_what_has_changed(spark, tmp_path):
    root = str(tmp_path / "index")
    store = stores.Store(spark, root)
    assert store.read("files").count() == store.meta().count() == store.costs().count() == 0
    stores.run_index(store, scan(spark, TEXTS), "/corpus", at(0), target_tokens=4)
    assert {r.rel_path: r.file_hash for r in store.read("files").collect()} == {p: digest(t) for p, t in TEXTS.items()}
    assert {r.file_hash for r in store.read("chunks").collect()} == {digest(t) for p, t in TEXTS.items() if p != "bad.md"}
    cards = store.read("files").select("file_hash", F.array("rel_path").alias("terms"), F.lit("m").alias("model"), at(0).alias("created_at"))
    store.upsert("cards", cards, ["created_at"])
    before, written = state(store), stamps(root)

    stores.run_index(store, scan(spark, TEXTS), "/corpus", at(1), target_tokens=4)
    assert state(store) == before and stamps(root) == written and store.written_buckets == dict.fromkeys(stores.TABLES, [])

    changed = TEXTS | {"0.md": "# Title 0\nnew words\n", "moved.md": TEXTS["1.md"], "new.md": "# New\nfile\n", "copy.md": TEXTS["2.md"]}
    del changed["1.md"], changed["3.md"]
    drift = {r.rel_path: r.drift for r in stores.run_index(store, scan(spark, changed), "/corpus", at(2), target_tokens=4).collect()}
    assert {p: d for p, d in drift.items() if d != "unchanged"} == {"0.md": "modified", "moved.md": "moved", "new.md": "new", "copy.md": "duplicate", "3.md": "deleted"}
    want = {p: digest(t) for p, t in changed.items() if p != "copy.md"}
    assert {r.rel_path: r.file_hash for r in store.read("files").collect()} == want
    gone, anew = {digest(TEXTS["0.md"]), digest(TEXTS["3.md"])}, {want["0.md"], want["new.md"]}
    assert {r.file_hash for r in store.read("cards").collect()} == {digest(t) for t in TEXTS.values()} - gone
    assert {r.file_hash for r in store.read("chunks").collect()} == {h for p, h in want.items() if p != "bad.md"}
    touched = {h[:2] for h in gone | anew}
    assert set(store.written_buckets["chunks"]) == touched and set(store.written_buckets["files"]) == touched | {digest(TEXTS["1.md"])[:2]}
    assert set(store.written_buckets["cards"]) == {h[:2] for h in gone}
    after = stamps(root)
    assert all(after[f] == t for f, t in written.items() if f.split("bucket=")[1][:2] not in touched | {digest(TEXTS["1.md"])[:2]})
    assert tuple(store.meta().first()) == (1, "/corpus", datetime(2023, 11, 14, 22, 13, 22))

    stores.run_index(store, scan(spark, changed), "/corpus", at(3), scan(spark, {"new.md": ""}).select("rel_path"), target_tokens=1)
    assert {r.file_hash for r in store.read("cards").collect()} == {digest(t) for t in TEXTS.values()} - gone  # the new file had no card to lose
    assert store.written_buckets["chunks"] == [want["new.md"][:2]]
    stores.run_index(store, scan(spark, {}), "/corpus", at(4))
    assert state(store) == {name: [] for name in stores.TABLES}


def test_verdicts_are_replaced_by_key_and_costs_appended(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "index"))
    verdict = lambda *rows: spark.createDataFrame([(h, "q", m, run, True, c, "r", datetime(2024, 1, d)) for h, m, run, c, d in rows], stores.VERDICTS)
    store.upsert("verdicts", verdict(("aa1", "m", "one", 0.1, 1), ("aa2", "m", "one", 0.2, 1), ("bb1", "m", "one", 0.3, 1)), ["evaluated_at"])
    store.upsert("verdicts", verdict(("aa1", "m", "two", 0.9, 2), ("aa1", "other", "two", 0.8, 2), ("bb1", "m", "late", 0.7, 1)), ["evaluated_at"])
    assert {(r.file_hash, r.model): (r.run_id, r.confidence) for r in store.read("verdicts").collect()} == {("aa1", "m"): ("two", 0.9), ("aa1", "other"): ("two", 0.8), ("aa2", "m"): ("one", 0.2), ("bb1", "m"): ("late", 0.7)}
    store.upsert("verdicts", verdict(("aa1", "m", "old", 0.0, 1)), ["evaluated_at"])
    assert store.written_buckets["verdicts"] == []
    cost = lambda run: spark.createDataFrame([(run, "extract", "m", 10, 5, 0.5, datetime(2024, 1, 1))], stores.COSTS)
    store.log_costs(cost("one"))
    store.log_costs(cost("two"))
    assert sorted(r.run_id for r in store.costs().collect()) == ["one", "two"]


def test_another_schema_version_is_an_error(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "index"))
    spark.createDataFrame([(99, "/corpus", datetime(2024, 1, 1))], stores.META).write.parquet(f"{store.root}/meta")
    with pytest.raises(PySparkException, match="schema version 99"):
        store.meta().collect()


def test_texts_are_shuffled_once_on_their_way_to_a_folder(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "index"), digits=1)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    files = scan(spark, TEXTS)
    chosen = store.among(files, files.select("file_hash", "rel_path").where("size_bytes > 26"), ["file_hash", "rel_path"])
    assert plan(provenance.token_chunks(files)).count("Exchange") == 0
    assert plan(provenance.token_chunks(chosen)).count("Exchange") == 1
    assert sorted(r.rel_path for r in chosen.collect()) == sorted(p for p, t in TEXTS.items() if len(t) > 26)
    nulls = files.withColumn("rel_path", F.lit(None).cast("string"))
    assert store.among(nulls, nulls, ["file_hash", "rel_path"]).count() == 0 and store.among(files, files.limit(0), ["file_hash"]).count() == 0
