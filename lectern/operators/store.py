"""The index on disk: files and what hangs on them as Parquet folders by the first digits of their hashes, of which a run rewrites only those that change.

Costs and runs are logs that only grow. A run reads what is stored, works out what is new in the shared folder, and then replaces the changed
folders one table at a time; run again after a failure, it finds what is still different and goes on, as everything follows from the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators import catalogue, drift, provenance
from lectern.sources.shared import new_path, written

FILES = "file_hash string, rel_path string, size_bytes long, format string, parse_status string"
CHUNKS = "file_hash string, chunk_id string, chunk_index int, heading_path array<string>, page int, char_start long, char_end long, text string"
CARDS = "file_hash string, terms array<string>, model string, created_at timestamp"
VERDICTS = "file_hash string, question_hash string, model string, run_id string, relevant boolean, confidence double, reasoning string, evaluated_at timestamp"
#: Tables by hash: their columns, and the keys of a row.
TABLES = {"files": (FILES, ["file_hash"]), "chunks": (CHUNKS, ["file_hash", "chunk_id"]), "cards": (CARDS, ["file_hash"]), "verdicts": (VERDICTS, ["file_hash", "question_hash", "model"])}
#: Logs, which are appended to.
COSTS = "run_id string, task string, model string, tokens_in long, tokens_out long, cost double, at timestamp"
META = "schema_version int, corpus_root string, indexed_at timestamp"
VERSION = 1


@dataclass
class Store:
    """Tables under root, a folder that the driver and all executors share, in folders by the first `digits` digits of hashes, always the same number for one
    root. written_buckets tells which folders the last calls have replaced."""

    spark: SparkSession
    root: str
    digits: int = 2
    written_buckets: dict[str, list[str]] = field(default_factory=dict)

    def _bucket(self) -> Column:
        return F.substring("file_hash", 1, self.digits)

    def _read(self, name: str, schema: str) -> DataFrame:
        return self._read_at(f"{self.root}/{name}", schema)

    def _read_at(self, path: str, schema: str) -> DataFrame:
        try:
            self.spark.catalog.refreshByPath(path)
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """A table's rows, none if it hasn't been written yet."""
        columns = self.spark.createDataFrame([], TABLES[name][0]).columns
        return self._read(name, f"{TABLES[name][0]}, bucket string").select(columns)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Makes rows the table, by rewriting the folders that differ from what is stored.

        Rows are compared by their hashes, so that only narrow rows are shuffled to find the folders, at most 256 with two digits. A folder's new rows lie in the shared folder before
        the old ones are touched; one that is left without rows becomes an empty file.
        """
        stored = self.read(name)
        rows = written(rows.select(stored.columns), f"new-{name}")
        marked = lambda df, sign: df.select(self._bucket().alias("bucket"), F.xxhash64(*stored.columns).alias("h"), F.lit(sign).alias("sign"))
        differs = marked(stored, -1).unionByName(marked(rows, 1)).groupBy("bucket", "h").agg(F.sum("sign").alias("n")).where("n != 0")
        changed = sorted(r["bucket"] for r in differs.select("bucket").distinct().collect())
        self.written_buckets[name] = changed
        if not changed:
            return
        news = rows.withColumn("bucket", self._bucket()).where(F.col("bucket").isin(changed))
        full = {r["bucket"] for r in news.select("bucket").distinct().collect()}
        self._overwrite(name, news.repartition("bucket"), [b for b in changed if b not in full])

    def among(self, rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
        """The rows (with file_hash) whose keys, of which file_hash is one, are in wanted; a null is in none. They are dealt to tasks by a digit more of the hash than folders have, so that 16 tasks
        at most write a folder. Rows and marks share this one shuffle, where a join would shuffle all texts again by its keys.
        """
        marks = wanted.select(*keys, F.lit(True).alias("_mark")).dropna(subset=keys)
        both = rows.withColumn("_mark", F.lit(False)).unionByName(marks, allowMissingColumns=True)
        dealt = both.withColumn("_part", F.substring("file_hash", 1, self.digits + 1)).repartition("_part")
        found = dealt.withColumn("_found", F.bool_or("_mark").over(Window.partitionBy("_part", *keys)))
        return found.where("_found AND NOT _mark").select(rows.columns)

    def renew(self, name: str, stays: DataFrame, made: DataFrame | None = None) -> None:
        """Takes from a table the rows of hashes that aren't in stays (file_hash), and adds those of made, which should be dealt as by among(); rewrites the folders that change.

        Rows are compared by their hashes, without those of stays, which stay as they are. New rows are written to the shared folder first; old ones of changed folders go from there to their new
        place, in one shuffle. Folders are replaced when all is written, so what is read is still there.
        """
        schema = f"{TABLES[name][0]}, bucket string"
        stored = self._read(name, schema)
        columns = [c for c in stored.columns if c != "bucket"]
        if made is not None:
            path = new_path(self.spark, f"made-{name}")
            made.select(*[F.col(f.name).cast(f.dataType) for f in stored.schema if f.name != "bucket"], self._bucket().alias("bucket")).write.partitionBy("bucket").parquet(path)
            made = self._read_at(path, schema)
        else:
            made = stored.limit(0)
        hashed = lambda df: df.select("bucket", "file_hash", F.xxhash64(*columns).alias("h"))
        old = hashed(stored).join(stays.select("file_hash", F.lit(0).alias("sign")), "file_hash", "left").withColumn("sign", F.coalesce("sign", F.lit(-1)))
        signs = old.unionByName(hashed(made).withColumn("sign", F.lit(1))).groupBy("bucket", "h").agg(F.sum("sign").alias("n"), F.bool_or(F.col("sign") >= 0).alias("stays"))
        folders = signs.groupBy("bucket").agg(F.bool_or(F.col("n") != 0).alias("changed"), F.bool_or("stays").alias("full")).where("changed").collect()
        changed = self.written_buckets[name] = sorted(r["bucket"] for r in folders)
        if not changed:
            return
        kept = self.among(stored.where(F.col("bucket").isin(changed)), stays, ["file_hash"])
        self._overwrite(name, kept.unionByName(made.where(F.col("bucket").isin(changed))), [r["bucket"] for r in folders if not r["full"]])

    def _overwrite(self, name: str, news: DataFrame, empty: list[str]) -> None:
        """Replaces the folders that news (with bucket) has rows for, and those in empty by an empty file."""
        news.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.root}/{name}")
        for bucket in empty:
            news.drop("bucket").limit(0).write.mode("overwrite").parquet(f"{self.root}/{name}/bucket={bucket}")

    def upsert(self, name: str, rows: DataFrame, by: list[str]) -> None:
        """Adds rows; of those with one key the last by the columns `by` stays, new ones before stored ones at ties."""
        self.replace(name, catalogue.latest(self.read(name), rows, TABLES[name][1], by).select(self.read(name).columns))

    def log_costs(self, rows: DataFrame) -> None:
        """Appends the costs of a run, a row for each task and model."""
        rows.select(self.spark.createDataFrame([], COSTS).columns).write.mode("append").parquet(f"{self.root}/costs")

    def costs(self) -> DataFrame:
        return self._read("costs", COSTS)

    def log_meta(self, corpus_root: str, at: Column) -> None:
        """Appends what an index run was: the newest row is the index's."""
        row = self.spark.range(1).select(F.lit(VERSION).alias("schema_version"), F.lit(corpus_root).alias("corpus_root"), at.cast("timestamp").alias("indexed_at"))
        row.write.mode("append").parquet(f"{self.root}/meta")

    def meta(self) -> DataFrame:
        """The index's meta row; none before the first run. A row of another schema version is an error."""
        newest = self._read("meta", META).orderBy(F.desc("indexed_at")).limit(1)
        wrong = F.raise_error(F.concat(F.lit("the index has the schema version "), F.col("schema_version").cast("string"))).cast("int")
        return newest.withColumn("schema_version", F.when(F.col("schema_version") == VERSION, F.col("schema_version")).otherwise(wrong))


def run_index(store: Store, scan: DataFrame, corpus_root: str, at: Column, forced: DataFrame | None = None, target_tokens: int = 512) -> DataFrame:
    """Brings the index up to a scan (rel_path, file_hash, size_bytes, format, parse_status, markdown, page_marks): the drift that it acted on.

    Files, and what hangs on those that are gone or made anew, change as in catalogue.apply_drift() and dependents(); chunks of new, modified and
    forced files are made. A second run over the same scan finds nothing to do and writes no folder; the log of runs grows by its row.
    """
    known = written(store.read("files"), "known")
    change = drift.classify(scan, known)
    change = written(change if forced is None else catalogue.with_forced(change, forced), "drift")
    files = written(catalogue.apply_drift(known, scan.select(known.columns), change), "files")
    anew = change.where(F.col("drift").isin("new", "modified", "forced")).select("file_hash", "rel_path")
    stays = written(catalogue.dependents(known.select("file_hash"), known, files, change).distinct(), "stays")
    chosen = store.among(scan, anew, ["file_hash", "rel_path"])
    for name in ("cards", "verdicts", "chunks"):
        store.renew(name, stays, provenance.token_chunks(chosen, target_tokens) if name == "chunks" else None)
    store.replace("files", files)  # last, so that a run that ended before is done again
    store.log_meta(corpus_root, at)
    return change
