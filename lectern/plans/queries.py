"""Queries over the test tables, one per operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, asking, catalogue, drift, ledger, ordering, provenance, reading, store, vectors, writing
from lectern.sources import corpus, shared

#: Words of the fixed question that the lexical judge looks for.
TOPIC = ["that", "this", "with", "from", "tion", "ment"]
DEFINED = ["elle", "rewh", "nder"]
#: More words of a question, for the lexical router.
WANTED = "anea anan anat aned anble aner anen anha anin anes aian aich aieau aiai anhe ananble attion aiaux anly aning".split()


def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


documents, pages, turns, benchmark, labels, events, embeddings = map(_table, "documents pages conversations benchmark labels events embeddings".split())


def files(s: SparkSession, d: str) -> DataFrame:
    return corpus.from_documents(documents(s, d))


def _known(s: SparkSession, d: str) -> DataFrame:
    """An earlier index: of ids modulo 10, 1 was elsewhere, 2 had other content, 3 wasn't there, and 4 has a file that is gone."""
    f, m = files(s, d), F.col("doc_id") % 10
    path = F.when(m == 1, F.concat(F.lit("old/"), "rel_path")).otherwise(F.col("rel_path"))
    digest = F.when(m == 2, F.sha2(F.concat("markdown", F.lit("!")).cast("binary"), 256)).otherwise(F.col("file_hash"))
    gone = f.where(m == 4).select(F.concat(F.lit("gone/"), "rel_path").alias("rel_path"), F.sha2(F.concat("markdown", F.lit("?")).cast("binary"), 256).alias("file_hash"))
    return f.where(m != 3).select(path.alias("rel_path"), digest.alias("file_hash")).unionByName(gone)


def _statuses(s: SparkSession, d: str) -> DataFrame:
    f = corpus.from_conversations(turns(s, d))
    chars = F.char_length("markdown")
    return f.select("rel_path", chars.cast("long").alias("chars"), F.size("page_marks").cast("long").alias("pages"), drift.parse_status(chars, F.size("page_marks")).alias("parse_status"))


def _places(s: SparkSession, d: str) -> DataFrame:
    marks = corpus.from_conversations(turns(s, d)).select("rel_path", F.explode("page_marks").alias("m"))
    return marks.select("rel_path", F.explode(F.array(F.col("m.offset") - 1, F.col("m.offset"), F.col("m.offset") + 5)).alias("offset"))


def _evaluations(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return e.select(F.concat(F.lit("run"), (F.col("user_id") % 50).cast("string")).alias("run_id"), F.col("event_id"), F.col("ts").alias("evaluated_at"), F.col("event_type").alias("task"))


def _findings(relevance: str, topic: list[str] = TOPIC):
    return lambda s, d: reading.extract(files(s, d), topic, relevance).select("rel_path", F.col("seq").cast("long").alias("seq"), "quote", "claim", F.col("overlap").cast("long").alias("overlap"))


def _section_verdicts(s: SparkSession, d: str) -> DataFrame:
    parts = reading.fixed_slices(files(s, d), 2000)
    shared = F.size(F.array_intersect(F.array(*map(F.lit, TOPIC)), T.words(F.col("text"))))
    return parts.select("rel_path", F.col("part").alias("section"), (shared >= 3).alias("relevant"), (shared / 8).alias("confidence"), F.concat(F.lit("overlap="), shared.cast("string")).alias("reasoning"))


def _scores(s: SparkSession, d: str) -> DataFrame:
    """A pair for each source: good documents expected, toxic ones forbidden, and candidates that hold a word of the topic."""
    docs = documents(s, d).join(labels(s, d), "doc_id", "left")
    holds = F.size(F.array_intersect(F.array(*map(F.lit, TOPIC[:2])), T.words(F.coalesce("text", F.lit(""))))) > 0
    marks = docs.select(F.col("source").alias("pair"), (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("forbidden"), holds.alias("candidate"))
    return ledger.score_routing(marks.select("pair").distinct(), marks)


def _decisions(s: SparkSession, d: str) -> DataFrame:
    """Replies of a router: ids modulo 7 of 0 got no decision, of 1 were left out, of 2 were decided twice."""
    f, m = files(s, d).dropDuplicates(["file_hash"]), F.pmod(F.conv(F.substring("file_hash", 1, 8), 16, 10).cast("long"), F.lit(7))
    one = f.where(m != 0).select(F.lit(0).alias("shard"), F.lit(0).alias("pos"), "file_hash", (m != 1).alias("include"), F.lit("first").alias("reason"))
    two = f.where(m == 2).select(F.lit(1).alias("shard"), F.lit(0).alias("pos"), "file_hash", F.lit(False).alias("include"), F.lit("second").alias("reason"))
    return one.union(two)


def _evidence(s: SparkSession, d: str) -> DataFrame:
    found = reading.number_evidence(reading.hits(reading.extract(files(s, d), TOPIC, "strict")))
    return found.select("rel_path", F.col("seq").cast("long").alias("seq"), F.col("number").cast("long").alias("number"))


def _cites(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    path = F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md"))
    heading = F.when(F.col("turn") == 0, F.col("conv_id").cast("string")).otherwise(F.concat("role", F.lit(" "), F.col("turn").cast("string")))
    return t.select("conv_id", "turn", T.cite(path, heading, F.col("turn"), F.col("turn") % 3 != 0).alias("cite"))


def _uncited(s: SparkSession, d: str) -> DataFrame:
    parts = files(s, d).select("rel_path", F.explode_outer(T.sentences(F.col("markdown"))).alias("sentence"))
    return parts.groupBy("rel_path").agg(F.count("sentence").alias("sentences"), F.count_if(T.claim_like(F.col("sentence"))).alias("claims"))


def _with_card(s: SparkSession, d: str) -> DataFrame:
    return reading.lexical_cards(files(s, d).where(F.col("doc_id") % 2 == 0))


def _cache(s: SparkSession, d: str) -> DataFrame:
    """Which files have a stored verdict for the question and model, and which are misses."""
    key = T.question_key(F.lit("what?"), F.lit(None).cast("string"), F.lit("balanced"))
    stored = files(s, d).where(F.col("doc_id") % 3 == 0).select(key.alias("question_hash"), "file_hash", F.lit("lexical").alias("model")).distinct()
    probe = files(s, d).select("rel_path", "file_hash", key.alias("question_hash"), F.lit("lexical").alias("model"))
    return probe.join(stored.withColumn("hit", F.lit(True)), ["question_hash", "file_hash", "model"], "left").select("rel_path", "question_hash", F.coalesce("hit", F.lit(False)).alias("cached"))


def _silent(s: SparkSession, d: str) -> DataFrame:
    """Files that hold none of the topic: the form in which `which files do not address X` is a relation."""
    f = files(s, d)
    return f.select("rel_path").join(reading.extract(f, TOPIC, "strict").select("rel_path"), "rel_path", "left_anti")


def _drift(s: SparkSession, d: str) -> DataFrame:
    return drift.classify(files(s, d), _known(s, d))


def _part_cards(s: SparkSession, d: str) -> DataFrame:
    parts = reading.fixed_slices(files(s, d), 4000)
    return parts.select("rel_path", "part", F.slice(F.sort_array(T.words(F.col("text"))), 1, 8).alias("terms"))


def _cards(s: SparkSession, d: str) -> DataFrame:
    """Rendered cards, one for each content."""
    one = reading.lexical_cards(drift.final_files(files(s, d)))
    terms, none = F.transform("terms", lambda t: F.struct(t.alias("term"), F.lit("as used").alias("sense"))), F.array().cast("array<string>")
    card = reading.render_card(
        F.col("file_hash"), F.col("rel_path"), F.lit("doc"), terms, claims=F.array(F.array_join("terms", " ")),
        implicit=F.slice("terms", 1, 5), answers=none, absences=none, entities=none,
    )
    return one.select("rel_path", "file_hash", card.alias("card"))


def _route_shards(s: SparkSession, d: str) -> DataFrame:
    """Shards of the cards of the whole catalogue, in its order."""
    units = _cards(s, d).select("rel_path", T.tokens(F.col("card")).alias("tokens"))
    return ordering.greedy_runs(units, ["rel_path"], 600, 13).select("rel_path", F.col("run").alias("shard"))


def _reduce_batches(s: SparkSession, d: str) -> DataFrame:
    found = reading.hits(reading.extract(files(s, d), TOPIC, "balanced")).select("rel_path", F.col("seq").cast("long").alias("seq"), T.tokens(F.col("quote")).alias("tokens"))
    return reading.batches(found, "rel_path", ["seq"], 60).select("rel_path", "seq", "batch")


def _grounded(s: SparkSession, d: str) -> DataFrame:
    """Findings quoted in capitals with straightened dashes: each stands in its file, and is given back as it stands there."""
    found = reading.extract(files(s, d), TOPIC, "strict").select("rel_path", F.col("seq").cast("long").alias("seq"), F.upper("quote").alias("quote"))
    return reading.ground(found, files(s, d)).select("rel_path", "seq", "verified", F.md5(F.lower("quote")).alias("digest"))


def _resolved(s: SparkSession, d: str) -> DataFrame:
    """Answers that cite each turn of a conversation, of which even ones are evidence, and a number that isn't."""
    t = turns(s, d).select(F.col("conv_id").alias("answer_id"), "turn")
    line = F.format_string("Turn %d says something about this [%d, %d]. Nothing more is said here.", "turn", "turn", F.col("turn") + 1000)
    said = t.groupBy("answer_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("turn", line.alias("line"))))["line"], "\n").alias("text"))
    evidence = t.where("turn % 2 = 0").select("answer_id", F.col("turn").alias("number"), F.format_string("[conversations/%d.md]", "answer_id").alias("cite"))
    got = answers.resolve(said, evidence)
    return got.select("answer_id", "text", "resolved", F.col("uncited").cast("long").alias("uncited"), F.size("used").cast("long").alias("used"), F.size("bad").cast("long").alias("bad"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    t = turns(s, d)
    heading = F.when(F.col("turn") % 4 != 0, F.concat("role", F.lit(" "), F.col("turn").cast("string")))
    path = F.format_string("conversations/%d.md", "conv_id")
    return answers.sources(t.select(path.alias("rel_path"), heading.alias("heading"), F.col("turn").alias("page")))


def _citation_scores(s: SparkSession, d: str) -> DataFrame:
    """The turns' cites, those at every fifth turn uncited, as one answer for each conversation; `§` must be cited."""
    cites = _cites(s, d).select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, F.lit("[uncited]")).otherwise(F.col("cite")).alias("cite"))
    text = F.array_join(F.sort_array(F.collect_list(F.struct("turn", "cite")))["cite"], " ")
    rows = cites.groupBy(F.col("conv_id").alias("answer_id")).agg(text.alias("text"))
    scored = answers.score_citations(rows.withColumns({"sources": F.lit(""), "must_cite": F.array(F.lit("§"))}))
    return scored.select("answer_id", F.round("validity", 9).alias("validity"), "must_cite_ok")


def _replies(s: SparkSession, d: str) -> DataFrame:
    """Replies with a finding for each sentence, fenced at even ids, and cut within the last at odd ids."""
    found = F.transform(T.sentences(F.col("markdown")), lambda q: F.struct(F.lit("c").alias("claim"), q.alias("quote")))
    reply = F.to_json(F.struct("file_hash", F.lit(True).alias("relevant"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reasoning"), found.alias("findings")))
    fenced = F.concat(F.lit("```json\n"), reply, F.lit("\n```"))
    cut = F.substring(reply, F.lit(1), F.char_length(reply) - 4)
    raw = F.when(F.col("doc_id") % 2 == 0, fenced).otherwise(cut)
    parsed = answers.parse_replies(files(s, d).select("rel_path", raw.alias("raw")))
    return parsed.select("rel_path", F.coalesce(F.when(F.col("reply").isNotNull(), F.size("reply.findings")), F.lit(0)).cast("long").alias("findings"))


def _index(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalogue of an earlier index, a scan, and the drift between them."""
    columns = lambda df, size: df.select("file_hash", "rel_path", size.cast("long").alias("size_bytes"))
    known = columns(_known(s, d).groupBy("file_hash").agg(F.min("rel_path").alias("rel_path")), F.lit(0))
    scan = columns(files(s, d), F.col("size_bytes"))
    return known, scan, drift.classify(scan, known)


def _applied(s: SparkSession, d: str) -> DataFrame:
    return catalogue.apply_drift(*_index(s, d))


def _stored(s: SparkSession, d: str) -> DataFrame:
    """The index on disk after two runs: over an earlier state of the documents, as _known() has it, and over the documents."""
    f, m = files(s, d), F.col("doc_id") % 10
    path = F.when(m == 1, F.concat(F.lit("old/"), "rel_path")).otherwise(F.col("rel_path"))
    earlier = f.where(m != 3).select(path.alias("rel_path"), F.when(m == 2, F.concat("markdown", F.lit("!"))).otherwise(F.col("markdown")).alias("markdown"))
    earlier = earlier.unionByName(f.where(m == 4).select(F.concat(F.lit("gone/"), "rel_path").alias("rel_path"), F.concat("markdown", F.lit("?")).alias("markdown")))
    scanned = lambda df: df.select(
        "rel_path", F.sha2("markdown", 256).alias("file_hash"), F.octet_length("markdown").cast("long").alias("size_bytes"), F.lit("txt").alias("format"), F.lit("ok").alias("parse_status"),
        "markdown", F.array().cast("array<struct<offset:int,page:int>>").alias("page_marks"),
    )
    index = store.Store(s, shared.new_path(s, "index"), digits=1)
    for k, rows in enumerate((earlier, f)):
        store.run_index(index, scanned(rows), "documents", F.timestamp_seconds(F.lit(k)))
    chunked = index.read("chunks").select("file_hash", F.lit(True).alias("chunked")).distinct()
    return index.read("files").join(chunked, "file_hash", "left").select("file_hash", "rel_path", "size_bytes", F.coalesce("chunked", F.lit(False)).alias("chunked"))


def _cards_left(s: SparkSession, d: str) -> DataFrame:
    known, scan, change = _index(s, d)
    return catalogue.dependents(known.select("file_hash", F.lit("card").alias("card")), known, catalogue.apply_drift(known, scan, change), change)


def _forced(s: SparkSession, d: str) -> DataFrame:
    """The drift of a run that is told to index every seventh file anew."""
    return catalogue.with_forced(_drift(s, d), files(s, d).where("doc_id % 7 = 0"))


def _served(s: SparkSession, d: str) -> DataFrame:
    """Events as calls: tasks with prices of their own or without, served by their primary models or others, which are listed or not."""
    model = F.element_at(F.array(*map(F.lit, ("small", "host/large", "large", "unknown"))), (F.col("event_id") % 4 + 1).cast("int"))
    calls = events(s, d).select("event_id", F.col("event_type").alias("task"), model.alias("served"), (F.col("event_id") % 5000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"))
    tasks = s.createDataFrame([("click", "host/large", 2.0, None), ("view", "small", None, None), ("purchase", "large", None, 0.5)], "task string, primary string, in_rate double, out_rate double")
    listed = s.createDataFrame([("small", 0.25, 1.0), ("large", 3.0, 15.0), ("host/large", 4.0, 16.0)], "model string, in_rate double, out_rate double")
    return ledger.call_costs(calls, tasks, listed).select("event_id", "task", "served", F.round(F.col("cost") * 1_000_000, 3).alias("microcost"))


def _status(s: SparkSession, d: str) -> DataFrame:
    return catalogue.status(_index(s, d)[2], _statuses(s, d))


def _latest(s: SparkSession, d: str) -> DataFrame:
    """Stored verdicts, and those of one task written again with another value."""
    e = events(s, d).select("user_id", "event_type", "ts", "event_id", "value")
    again = e.where("event_type = 'click'").withColumn("value", F.lit(-1.0))
    return catalogue.latest(e, again, ["user_id", "event_type"], ["ts", "event_id"])


def _outcomes(s: SparkSession, d: str) -> DataFrame:
    """Conversations as converted files: by id, whole, in part or failed, with an error for each turn."""
    f = turns(s, d).groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.sum(F.char_length("text")).alias("chars"))
    outcome = F.element_at(F.array(*map(F.lit, ("success", "partial_success", "failure"))), (F.col("conv_id") % 3 + 1).cast("int"))
    status = catalogue.conversion_status(outcome, F.transform("turns", lambda t: F.concat(F.lit("page "), t.cast("string"))), F.col("chars"), F.size("turns"))
    return f.select("conv_id", status.alias("s")).select("conv_id", "s.parse_status", "s.parse_error")


def _turned(s: SparkSession, d: str) -> DataFrame:
    """Turns as items of a file, two on a page, with a page number that comes back."""
    items = turns(s, d).select(F.col("conv_id").alias("rel_path"), F.col("turn").alias("seq"), (F.col("turn") * 10).alias("offset"), (F.floor(F.col("turn") / 2) % 3).alias("page"))
    return catalogue.page_map(items).select("rel_path", "offset", "page")


def _repeated(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Conversations whose even turns' sections come again at the end, word for word, as files; and their items, a page a section, some of which are listed
    once more, out of order, or aren't in the file."""
    again = F.explode(F.when(F.col("turn") % 2 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again")
    parts = turns(s, d).select("conv_id", "turn", "role", "text", again)
    part = F.concat(F.lit("## "), "role", F.lit("\n"), F.when(F.col("turn") % 3 == 1, F.concat(F.lit("### Turn\n"), "text")).otherwise(F.col("text")), F.lit("\n"))
    path = F.format_string("repeated/%d.md", "conv_id").alias("rel_path")
    files_ = parts.groupBy("conv_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("again", "turn", part.alias("part"))))["part"], "").alias("body"))
    status = F.element_at(F.array(*map(F.lit, ("ok", "partial_parse", "parse_failed"))), (F.col("conv_id") % 3 + 1).cast("int"))
    markdown = F.concat(F.lit("# Repeated "), F.col("conv_id").cast("string"), F.lit("\n"), "body")
    files_ = files_.select("conv_id", path, status.alias("parse_status"), markdown.alias("markdown")).withColumn("file_hash", F.sha2("markdown", 256))
    seq = F.col("again") * 1000 + F.col("turn")
    said = F.when(F.col("turn") % 5 == 4, F.lit("not in the file")).otherwise(F.concat(F.lit("  "), "text"))
    items = parts.select(path, seq.alias("seq"), said.alias("text"), (F.floor(F.col("turn") / 2) % 3).alias("page"))
    late = parts.where("turn % 4 = 1").select(path, (seq + 3).alias("seq"), F.col("text"), F.lit(9).alias("page"))
    return files_, items.unionByName(late.withColumn("seq", F.col("seq") + 2000))


def _anchored(s: SparkSession, d: str) -> DataFrame:
    rows, items = _repeated(s, d)
    return provenance.anchored_marks(items, rows).select("rel_path", F.col("offset").cast("long").alias("offset"), F.col("page").cast("long").alias("page"))


def _chunked(s: SparkSession, d: str) -> DataFrame:
    rows, items = _repeated(s, d)
    chunks = provenance.token_chunks(provenance.with_marks(rows, provenance.anchored_marks(items, rows)), 60)
    long = lambda c: F.col(c).cast("long").alias(c)
    return chunks.select("chunk_id", "rel_path", F.array_join("heading_path", " / ").alias("heading_path"), long("page"), long("char_start"), long("char_end"), F.md5("text").alias("digest"))


def _rechunked(s: SparkSession, d: str) -> DataFrame:
    """Chunks stored by an earlier run with other limits, of which those of every second file are made anew."""
    rows, _ = _repeated(s, d)
    rows = rows.withColumn("page_marks", F.array().cast("array<struct<offset:int,page:int>>"))
    done = rows.where("conv_id % 2 = 0")
    return provenance.replaced(provenance.token_chunks(rows, 200), provenance.token_chunks(done, 60), done).groupBy("rel_path").agg(
        F.count(F.lit(1)).alias("chunks"), F.max(F.char_length("text")).cast("long").alias("longest")
    )


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    found = F.array(F.struct(F.col("reasoning").alias("claim"), F.concat(F.lit("section "), F.col("section").cast("string")).alias("quote")))
    merged = reading.merge_verdicts(_section_verdicts(s, d).withColumn("findings", found))
    return merged.select("rel_path", "relevant", F.array_join(F.col("findings")["quote"], "; ").alias("quotes"), F.array_join(F.col("findings")["claim"], "; ").alias("claims"))


def _snapped(s: SparkSession, d: str) -> DataFrame:
    """Each turn quoted in capitals after a word that isn't there, its words broken by hyphens at lines' ends: found again, with its heading and page."""
    t = turns(s, d)
    quote = F.concat(F.lit("Zzq "), F.upper(F.regexp_replace("text", r"(\p{L}{2})(\p{L}{2})", "$1-\n$2")))
    asked = t.select(F.concat(F.lit("conversations/"), F.col("conv_id").cast("string"), F.lit(".md")).alias("rel_path"), F.col("turn").alias("seq"), quote.alias("quote"))
    f = corpus.from_conversations(turns(s, d))
    rows = reading.snap(reading.ground(asked, f), f)
    return rows.select("rel_path", "seq", "verified", "heading_path", F.col("page").cast("long").alias("page"), F.when(F.col("verified"), F.md5("quote")).alias("digest"))


def _grouped(s: SparkSession, d: str) -> DataFrame:
    found = reading.hits(reading.extract(files(s, d), TOPIC, "balanced")).select("rel_path", "seq", F.col("claim").alias("heading_path"), (F.col("overlap") > 2).alias("verified"))
    return reading.group_hits(found).select("rel_path", "heading", F.col("place").cast("long").alias("place"), "hits", "verified", "unverified")


def _routed(s: SparkSession, d: str) -> DataFrame:
    """Files routed by their cards' words; those of odd ids have no card yet, unless a file of the same content has one."""
    return reading.candidates(files(s, d), _with_card(s, d), TOPIC + WANTED, mode="route").select("rel_path", "reason")


def _money(s: SparkSession, d: str) -> DataFrame:
    prices = s.createDataFrame([(t, 0.15 * k, 0.6) for k, t in enumerate(["click", "view", "purchase"], 1)], "task string, in_rate double, out_rate double")
    return ledger.costs(QUERIES["usage_by_task"](s, d), prices)


def _told(s: SparkSession, d: str) -> DataFrame:
    """Evidence of each file, numbered in it."""
    found = reading.hits(reading.extract(files(s, d), TOPIC, "strict"))
    number = F.row_number().over(Window.partitionBy("rel_path").orderBy("seq"))
    return found.select(F.col("rel_path").alias("answer_id"), number.alias("number"), "rel_path", "claim", "quote", F.concat(F.lit("["), "rel_path", F.lit("]")).alias("cite"))


def _answer_evidence(s: SparkSession, d: str) -> DataFrame:
    """The findings of each file as the evidence of an answer about it."""
    found = reading.hits(reading.extract(files(s, d), TOPIC, "balanced"))
    number = F.row_number().over(Window.partitionBy("rel_path").orderBy("seq"))
    none = F.lit(None)
    return found.select(
        F.col("rel_path").alias("answer_id"), number.alias("number"), "rel_path", none.cast("string").alias("heading"), none.cast("int").alias("page"), "claim", "quote",
        F.concat(F.lit("["), "rel_path", F.lit("]")).alias("cite"),
    )


def _careless(blocks: DataFrame, repair: bool) -> DataFrame:
    """A writer that forgets the marks of every third number of findings at first, and says nothing about every seventh."""
    n = F.size(writing.marks(F.col("block")))
    told = writing.lexical_writer(blocks.withColumn("n", n), repair).join(blocks.select("answer_id", n.alias("n")), "answer_id")
    bare = F.lit("This sentence makes a claim without a mark.")
    return told.select("answer_id", F.when(F.col("n") % 7 == 0, "").when((F.col("n") % 3 == 0) & F.lit(not repair), bare).otherwise(F.col("text")).alias("text"))


def _reduced(s: SparkSession, d: str) -> DataFrame:
    rows = writing.reduce_evidence(_answer_evidence(s, d), 150, writing.lexical_condenser)
    return rows.select("answer_id", (F.col("rounds") > 0).alias("reduced"), F.size(writing.marks(F.col("block"))).cast("long").alias("marks"))


def _told_answers(s: SparkSession, d: str) -> DataFrame:
    questions = files(s, d).select(F.col("rel_path").alias("answer_id"), F.lit("what?").alias("question"))
    return writing.write_answers(questions, _answer_evidence(s, d), _careless, writing.lexical_condenser, 150)


def _scored_answers(s: SparkSession, d: str) -> DataFrame:
    told = shared.written(_told_answers(s, d), "told-answers")
    must = told.select("answer_id", F.array(F.lit("docs/"), F.lit("speaks to")).alias("must_cite"))
    return writing.score_answers(told, must).withColumn("validity", F.round("validity", 9))


def _raw_replies(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Replies with a finding for each sentence that by the id are whole, cut off late, empty, prose, without a field, too sure, cut off early, or fenced;
    and what a second request gave for every third id."""
    found = F.transform(T.sentences(F.col("markdown")), lambda q: F.struct(F.lit("c").alias("claim"), q.alias("quote")))
    reply = lambda *fields: F.to_json(F.struct("file_hash", *fields, F.lit("r").alias("reasoning"), found.alias("findings")))
    sure = lambda c: F.lit(c).alias("confidence")
    yes, kind = F.lit(True).alias("relevant"), F.col("doc_id") % 8
    whole = reply(yes, sure(0.5))
    raw = (
        F.when(kind == 1, F.substring(whole, F.lit(1), F.char_length(whole) - 4)).when(kind == 2, "").when(kind == 3, "I think so.").when(kind == 4, reply(sure(0.5)))
        .when(kind == 5, reply(yes, sure(1.5))).when(kind == 6, F.substring(whole, 1, 20)).when(kind == 7, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).otherwise(whole)
    )
    f = files(s, d)
    first = f.select("rel_path", raw.alias("raw"), F.when(kind.isin(1, 6), "length").otherwise("stop").alias("finish_reason"))
    return first, f.where("doc_id % 3 = 0").select("rel_path", whole.alias("raw"), F.lit("stop").alias("finish_reason"))


def _checked(s: SparkSession, d: str) -> DataFrame:
    rows = answers.checked_replies(_raw_replies(s, d)[0])
    return rows.select("rel_path", "status", "reason", F.when(F.col("reply").isNotNull(), F.size("reply.findings")).cast("long").alias("findings"))


def _mended(s: SparkSession, d: str) -> DataFrame:
    rows = answers.repaired_replies(*_raw_replies(s, d), "rel_path")
    return rows.select("rel_path", "status", F.col("attempts").cast("long").alias("attempts"), F.when(F.col("reply").isNotNull(), F.size("reply.findings")).cast("long").alias("findings"))


def _searched(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every hundredth vector against all, in an index of 16 lists, of which a query reads 14 first: the test vectors lie so evenly that fewer find less than nine tenths.
    The hits of the first lists, and all."""
    every = embeddings(s, d)
    centres = vectors.fit(every, 16)
    queries = every.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.passes(vectors.index(every, centres), centres, queries, 10, 14)


def _recalled(s: SparkSession, d: str) -> DataFrame:
    """Whether reading the first lists alone has found nine tenths of the nearest vectors, over all queries."""
    first, truth = _searched(s, d)
    met = truth.join(first.select("query_id", "vec_id", F.lit(1).alias("met")), ["query_id", "vec_id"], "left")
    return met.agg(F.count_distinct("query_id").alias("queries"), F.count(F.lit(1)).alias("hits"), (F.count("met") >= 0.9 * F.count(F.lit(1))).alias("enough"))


def _reranked(s: SparkSession, d: str) -> DataFrame:
    """The five hits of each query that a reranker puts first which likes ids near the query's."""
    hits = _searched(s, d)[1]
    return vectors.reranked(hits, lambda h: h.withColumn("rerank", 1 / (1 + F.abs(F.col("vec_id") - F.col("query_id")))), 5).select("query_id", "vec_id", "score", F.round("rerank", 9).alias("rerank"))


ASKED = TOPIC + WANTED


def _asked(mode: str):
    """A whole query over the catalogue; of contents whose ids are divisible by 3, a verdict is stored, and those of even ids have cards."""

    def run(s: SparkSession, d: str) -> DataFrame:
        key = T.question_key(F.lit("what?"), F.lit(None).cast("string"), F.lit("balanced"))
        every = drift.final_files(files(s, d))
        none = F.array().cast("array<struct<claim:string,quote:string>>")
        stored = every.where("doc_id % 3 = 0").select(
            key.alias("question_hash"), "file_hash", F.lit("lexical").alias("model"), F.lit(True).alias("relevant"), F.lit(0.25).alias("confidence"),
            F.lit("stored").alias("reasoning"), none.alias("findings"),
        )
        cards = reading.lexical_cards(every.where("doc_id % 2 = 0"))
        return asking.ask(every, cards, stored, ASKED, key, asking.lexical_judge(ASKED, "balanced"), mode=mode, window=3100)

    return run


def _asked_rows(mode: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        quotes = F.md5(F.array_join(F.col("findings")["quote"], "|"))
        return _asked(mode)(s, d).select(
            "rel_path", "reason", "cached", "relevant", F.round("confidence", 6).alias("confidence"), "reasoning", F.size("findings").cast("long").alias("findings"), quotes.alias("quotes")
        )

    return run


def _estimated(s: SparkSession, d: str) -> DataFrame:
    every = drift.final_files(files(s, d))
    prices = s.createDataFrame([("catalog", 0.15, 0.6), ("route", 0.15, 0.6), ("extract", 3.0, 15.0)], "task string, in_rate double, out_rate double")
    return asking.estimate(every, reading.lexical_cards(every.where("doc_id % 2 = 0")), ASKED, prices)


def _arms(s: SparkSession, d: str) -> DataFrame:
    """Three pairs, each of which expects the good and forbids the toxic documents of a third of the ids."""
    names = ["first", "second", "third"]
    pairs = s.createDataFrame(list(zip(names, [TOPIC, WANTED, TOPIC[:2] + WANTED[:3]], strict=True)), "pair string, topic array<string>")
    f = files(s, d)
    pair = F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 3 + 1).cast("int"))
    marks = f.join(labels(s, d), "doc_id").select(pair.alias("pair"), "rel_path", (F.col("quality") == 1).alias("expected"), (F.col("toxic") == 1).alias("forbidden"))
    routed = asking.routed_pairs(pairs, reading.lexical_cards(f))
    swept = asking.swept_pairs(pairs, reading.plan_sections(f, 3100), "balanced")
    scored = asking.score_arms(pairs, marks, route=routed, sweep=swept)
    return scored.withColumns({"recall": F.round("recall", 9), "precision": F.round("precision", 9)})


QUERIES = {
    "corpus_scan": lambda s, d: files(s, d).select("rel_path", "file_hash", "size_bytes", "format"),
    "token_counts": lambda s, d: files(s, d).select("rel_path", T.tokens(F.col("markdown")).alias("tokens")),
    "drift_classify": _drift,
    "drift_report_counts": lambda s, d: _drift(s, d).groupBy("drift").agg(F.count(F.lit(1)).alias("files")),
    "final_state_after_index": lambda s, d: drift.final_files(files(s, d)).select("file_hash", "rel_path"),
    "parse_status": _statuses,
    "queryable_files": lambda s, d: catalogue.queryable(_outcomes(s, d)).select("conv_id", "parse_status"),
    "flagged_files": lambda s, d: catalogue.flagged(_outcomes(s, d)).select("conv_id", "parse_status", "parse_error"),
    "html_to_markdown": lambda s, d: corpus.from_pages(pages(s, d)).select("rel_path", "markdown"),
    "conversation_markdown": lambda s, d: corpus.from_conversations(turns(s, d)).select("rel_path", "file_hash", "markdown"),
    "page_marks": lambda s, d: corpus.from_conversations(turns(s, d)).select("rel_path", F.explode("page_marks").alias("m")).select("rel_path", F.col("m.offset").cast("long").alias("offset"), F.col("m.page").cast("long").alias("page")),
    "page_at": lambda s, d: _places(s, d).join(corpus.from_conversations(turns(s, d)).select("rel_path", "page_marks"), "rel_path").select("rel_path", F.col("offset").cast("long").alias("offset"), T.page_at(F.col("page_marks"), F.col("offset")).cast("long").alias("page")),
    "heading_path_at": lambda s, d: reading.heading_path_at(_places(s, d).select("rel_path", F.col("offset").cast("long").alias("offset")).distinct(), reading.headings(corpus.from_conversations(turns(s, d)))),
    "card_chunks": lambda s, d: reading.fixed_slices(files(s, d), 4000).select("rel_path", F.col("part").cast("long").alias("part"), F.md5("text").alias("digest")),
    "lexical_cards": lambda s, d: reading.lexical_cards(files(s, d)).select("rel_path", F.array_join("terms", " ").alias("terms")),
    "files_needing_cards": lambda s, d: reading.without_cards(files(s, d), _with_card(s, d)).select("rel_path"),
    "route_candidates": lambda s, d: reading.route(files(s, d), _decisions(s, d)).select("rel_path", "reason"),
    "extract_recall": _findings("recall"),
    "extract_balanced": _findings("balanced"),
    "extract_strict": _findings("strict"),
    "extract_with_definition": _findings("recall", DEFINED),
    "section_merge": lambda s, d: reading.merge_sections(_section_verdicts(s, d)),
    "quote_ground_exact": lambda s, d: reading.ground_exact(benchmark(s, d).select("item_id", F.col("text").alias("quote")), files(s, d)).select("item_id", "rel_path", F.col("offset").cast("long").alias("offset")),
    "question_key": lambda s, d: benchmark(s, d).select("item_id", T.question_key(F.col("text"), F.lit("a definition"), F.lit("recall")).alias("question_hash")),
    "eval_cache_probe": _cache,
    "hits": lambda s, d: reading.hits(reading.extract(files(s, d), TOPIC, "balanced")).select("rel_path", F.col("seq").cast("long").alias("seq"), "quote"),
    "hits_summary": lambda s, d: reading.hits(reading.extract(files(s, d), TOPIC, "balanced")).agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("rel_path").alias("files")),
    "files_without_findings": _silent,
    "evidence_numbered": _evidence,
    "cite_render": _cites,
    "claim_coverage": _uncited,
    "cost_estimate_query": lambda s, d: ledger.estimate_query(files(s, d).select(T.tokens(F.col("markdown")).alias("tokens"))),
    "cost_estimate_pass1": lambda s, d: ledger.estimate_pass1(reading.without_cards(files(s, d), _with_card(s, d)).select(T.tokens(F.col("markdown")).alias("tokens")), _with_card(s, d)),
    "usage_by_task": lambda s, d: ledger.usage_by_task(events(s, d).select(F.col("event_type").alias("task"), F.col("event_id").alias("tokens_in"), (F.col("event_id") % 100).alias("tokens_out"))),
    "prune_runs": lambda s, d: ledger.newest_runs(_evaluations(s, d)).select("run_id", "event_id"),
    "verdict_history": lambda s, d: ledger.newest_first(_evaluations(s, d), ["task", "run_id"], ["evaluated_at", "event_id"]).select("task", "run_id", "event_id", "evaluated_at", F.col("place").cast("long").alias("place")),
    "score_routing": lambda s, d: _scores(s, d).select("pair", F.round("recall", 9).alias("recall"), F.round("precision", 9).alias("precision"), "missing", "stray", "forbidden"),
    "score_mean": lambda s, d: _scores(s, d).agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("precision"), 6).alias("precision")),
    "section_split": lambda s, d: reading.split_sections(corpus.from_conversations(turns(s, d)), 400).select("rel_path", F.col("section").cast("long").alias("section"), F.md5("text").alias("digest")),
    "merge_cards": lambda s, d: reading.merge_cards(_part_cards(s, d), ["terms"]).select("rel_path", F.array_join("terms", " ").alias("terms")),
    "card_render": lambda s, d: _cards(s, d).select("rel_path", "card"),
    "route_shards": _route_shards,
    "reduce_batches": _reduce_batches,
    "quote_ground_full": _grounded,
    "cite_resolve": _resolved,
    "sources_block": _sources,
    "score_citations": _citation_scores,
    "json_salvage": _replies,
    "vector_topk": lambda s, d: ledger.nearest(embeddings(s, d), embeddings(s, d).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), 10),
    "vector_inverted_file": lambda s, d: _searched(s, d)[1],
    "vector_recall": _recalled,
    "vector_reranked": _reranked,
    "index_apply": _applied,
    "index_stored": _stored,
    "index_forced": _forced,
    "call_costs": _served,
    "index_cascade": lambda s, d: _cards_left(s, d).select("file_hash"),
    "index_status": _status,
    "evaluations_latest": _latest,
    "conversion_status": _outcomes,
    "page_changes": _turned,
    "page_map_anchored": _anchored,
    "token_chunks": _chunked,
    "chunks_replaced": _rechunked,
    "section_plan": lambda s, d: reading.plan_sections(files(s, d), 3100).select("rel_path", F.col("section").cast("long").alias("section"), F.md5("text").alias("digest")),
    "verdicts_with_findings": _verdicts,
    "quote_snap": _snapped,
    "hits_grouped": _grouped,
    "route_lexical": _routed,
    "cost_by_task": _money,
    "evidence_block": lambda s, d: answers.evidence_block(_told(s, d)).select("answer_id", F.md5("block").alias("digest")),
    "claims_digest": lambda s, d: answers.claims_digest(_told(s, d)),
    "fallback_digest": lambda s, d: answers.fallback_digest(_told(s, d)).select("answer_id", "text", "uncited"),
    "evidence_reduced": _reduced,
    "answers_written": lambda s, d: _told_answers(s, d).select("answer_id", "text", "sources", "resolved", "uncited", F.col("passes").cast("long").alias("passes")),
    "answers_scored": _scored_answers,
    "replies_checked": _checked,
    "replies_repaired": _mended,
    "ask_route": _asked_rows("route"),
    "ask_sweep": _asked_rows("sweep"),
    "ask_auto": _asked_rows("auto"),
    "ask_report": lambda s, d: asking.report(_asked("sweep")(s, d)),
    "ask_estimate": _estimated,
    "evaluation_arms": _arms,
}

_FILES = "files AS (SELECT doc_id, 'docs/' || doc_id || '.txt' AS rel_path, coalesce(text, '') AS markdown, sha256(coalesce(text, '')) AS file_hash FROM documents)"
_CONV = """turns AS (
    SELECT conv_id, turn, '## ' || role || ' ' || turn || chr(10) || text || chr(10) AS part FROM conversations
), convs AS (
    SELECT conv_id, 'conversations/' || conv_id || '.md' AS rel_path, '# Conversation ' || conv_id || chr(10) AS title,
           '# Conversation ' || conv_id || chr(10) || string_agg(part, '' ORDER BY turn, part) AS markdown, count(*) AS pages
    FROM turns GROUP BY conv_id
), marks AS (
    SELECT rel_path, turn, turn + 1 AS page, length(title) + coalesce(sum(length(part)) OVER (
        PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
    FROM turns JOIN convs USING (conv_id)
), places AS (SELECT rel_path, unnest([spot - 1, spot, spot + 5]) AS spot FROM marks)"""
_STATUS = f"""{_CONV}, statuses AS (
    SELECT rel_path, length(markdown) AS chars, pages, CASE WHEN length(markdown) < 200 THEN 'zero_text' ELSE 'ok' END AS parse_status FROM convs)"""
_SENTENCES = f"""{_FILES}, cut AS (
    SELECT rel_path, file_hash, list_filter(string_split(regexp_replace(markdown, '([.!?])[ \\t\\r\\n\\f]+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: s <> '') AS parts FROM files
), sentences AS (SELECT rel_path, file_hash, unnest(parts) AS quote, generate_subscripts(parts, 1) - 1 AS seq FROM cut)"""


def _found(least: int, topic: list[str] = TOPIC) -> str:
    want = "[" + ", ".join(f"'{w}'" for w in topic) + "]"
    return f"""{_SENTENCES}, found AS (
        SELECT rel_path, file_hash, seq, quote, list_sort(list_intersect({want}, list_distinct(regexp_extract_all(lower(quote), '[a-z]{{4,}}')))) AS shared FROM sentences
    ), findings AS (SELECT rel_path, file_hash, seq, quote, array_to_string(shared, ' ') AS claim, len(shared) AS overlap FROM found WHERE len(shared) >= {least})"""


# A quote in plain characters, as far as the test texts need it.
_FOLD = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(quote)), '-[ \\t\\r\\n]+([a-z])', '\\1', 'g'), '[*_`]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
_HITS = f"hits AS (SELECT rel_path, seq, quote FROM findings QUALIFY row_number() OVER (PARTITION BY rel_path, {_FOLD} ORDER BY seq) = 1)"
_DRIFT = f"""{_FILES}, known AS (
    SELECT CASE WHEN doc_id % 10 = 1 THEN 'old/' || rel_path ELSE rel_path END AS rel_path,
           CASE WHEN doc_id % 10 = 2 THEN sha256(markdown || '!') ELSE file_hash END AS file_hash FROM files WHERE doc_id % 10 <> 3
    UNION ALL SELECT 'gone/' || rel_path, sha256(markdown || '?') FROM files WHERE doc_id % 10 = 4
), paths AS (SELECT file_hash, min(rel_path) AS known_path FROM known GROUP BY 1
), joined AS (
    SELECT f.rel_path, f.file_hash, k.file_hash AS known_hash, p.known_path, NOT coalesce(k.file_hash = f.file_hash, false) AS changed
    FROM files f LEFT JOIN known k ON k.rel_path = f.rel_path LEFT JOIN paths p ON p.file_hash = f.file_hash
), owned AS (
    SELECT *, first_value(rel_path) OVER (PARTITION BY file_hash ORDER BY changed, string_split(rel_path, '/')) AS owner FROM joined
), classed AS (
    SELECT *, CASE WHEN NOT changed THEN 'unchanged' WHEN owner <> rel_path THEN 'duplicate' WHEN known_hash IS NOT NULL THEN 'modified'
                   WHEN known_path IS NOT NULL THEN 'moved' ELSE 'new' END AS drift FROM owned
), drifts AS (
    SELECT rel_path, file_hash, drift, CASE drift WHEN 'duplicate' THEN owner WHEN 'moved' THEN known_path END AS old_path FROM classed
    UNION ALL SELECT rel_path, file_hash, 'deleted', NULL FROM known
    WHERE file_hash NOT IN (SELECT file_hash FROM files) AND rel_path NOT IN (SELECT rel_path FROM classed WHERE drift = 'modified'))"""
_EVALS = "evals AS (SELECT 'run' || (user_id % 50) AS run_id, event_id, ts AS evaluated_at, event_type AS task FROM events)"
_PAIRS = f"""marks AS (
    SELECT source AS pair, coalesce(quality = 1, false) AS e, coalesce(toxic = 1, false) AS f,
           len(list_intersect(['{TOPIC[0]}', '{TOPIC[1]}'], regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{4,}}'))) > 0 AS c
    FROM documents LEFT JOIN labels USING (doc_id)
), counts AS (
    SELECT pair, count(*) FILTER (e) AS want, count(*) FILTER (c) AS got, count(*) FILTER (e AND c) AS hit, count(*) FILTER (f AND c) AS forbidden FROM marks GROUP BY 1
), scores AS (
    SELECT pair, CASE WHEN want = 0 THEN 1.0 ELSE hit / want END AS recall, CASE WHEN got = 0 THEN 1.0 ELSE hit / got END AS precision,
           want - hit AS missing, got - hit AS stray, forbidden FROM counts)"""
_INDEX = _DRIFT.replace("known AS (", "every AS (", 1).replace(
    "), paths AS (", "), known AS (SELECT min(rel_path) AS rel_path, file_hash FROM every GROUP BY file_hash), paths AS (", 1
) + """, gone AS (
    SELECT file_hash FROM drifts WHERE drift = 'deleted'
    UNION SELECT k.file_hash FROM known k JOIN drifts d ON d.rel_path = k.rel_path AND d.drift = 'modified' WHERE k.file_hash NOT IN (SELECT file_hash FROM files)
), taken AS (
    SELECT f.file_hash, f.rel_path, strlen(f.markdown) AS size_bytes FROM files f JOIN drifts d ON d.rel_path = f.rel_path AND d.drift IN ('new', 'modified')
), after AS (
    SELECT k.file_hash, coalesce(m.rel_path, k.rel_path) AS rel_path, 0::BIGINT AS size_bytes, true AS kept FROM known k LEFT JOIN drifts m ON m.file_hash = k.file_hash AND m.drift = 'moved'
    WHERE k.file_hash NOT IN (SELECT file_hash FROM gone) AND k.file_hash NOT IN (SELECT file_hash FROM taken)
    UNION ALL SELECT *, false FROM taken)"""
_MARKDOWN = r"regexp_replace(regexp_replace(coalesce(html, ''), '\s+', ' ', 'g'), '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>|<head>.*?</head>', '', 'g')"
for _level in range(1, 7):
    _MARKDOWN = rf"regexp_replace({_MARKDOWN}, '<h{_level}[^>]*>', concat(chr(10), '{'#' * _level} '), 'g')"
_MARKDOWN = rf"regexp_replace({_MARKDOWN}, '<li[^>]*>', concat(chr(10), '- '), 'g')"
_MARKDOWN = rf"regexp_replace({_MARKDOWN}, '</?(p|div|ul|ol|article|nav|footer|h[1-6]|br)[^>]*>', chr(10), 'g')"
_MARKDOWN = rf"regexp_replace(regexp_replace({_MARKDOWN}, '<[^>]*>', '', 'g'), '[ \t]*\n[ \t\n]*', chr(10), 'g')"
for _name, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _MARKDOWN = f"replace({_MARKDOWN}, '{_name}', '{_char}')"
_MARKDOWN = rf"regexp_replace({_MARKDOWN}, '^\n+|\n+$', '', 'g')"
_CUTS = "l0 AS (SELECT rel_path, [0] AS place, markdown AS text FROM convs)"
for _level in range(1, 7):
    _CUTS += rf""", l{_level} AS (SELECT rel_path, list_append(place, k) AS place, text FROM (
        SELECT rel_path, place, generate_subscripts(cut, 1) AS k, unnest(cut) AS text FROM (
            SELECT rel_path, place, CASE WHEN length(text) > 400 AND len(c) > 1 THEN c ELSE [text] END AS cut FROM (
                SELECT *, list_filter(string_split(regexp_replace(text, '(^|\n)(#{{{_level}}}\s)', concat('\1', chr(1), '\2'), 'g'), chr(1)), lambda p: regexp_matches(p, '\S')) AS c
                FROM l{_level - 1}))))"""
_CARDS = f"""{_FILES}, ones AS (SELECT file_hash, min(rel_path) AS rel_path, any_value(markdown) AS markdown FROM files GROUP BY 1
), carded AS (
    SELECT rel_path, file_hash, CASE WHEN len(t) = 0 THEN ['misc'] ELSE t END AS t
    FROM (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(markdown), '[a-z]{{4,}}')))[1:8] AS t FROM ones)
), cards AS (
    SELECT rel_path, file_hash, 'FILE ' || file_hash || chr(10) || 'path: ' || rel_path || ' | type: doc' || chr(10) || 'claims: ' || array_to_string(t, ' ') || chr(10)
        || 'terms: ' || array_to_string(list_transform(t, lambda w: w || ' = as used'), '; ') || chr(10) || 'implicit: ' || array_to_string(t[1:5], '; ') || chr(10)
        || 'answers: -' || chr(10) || 'absences: -' || chr(10) || 'entities: -' || chr(10) AS card FROM carded)"""


_OUTCOMES = """WITH f AS (SELECT conv_id, list('page ' || turn ORDER BY turn) AS errors, sum(length(text)) AS chars FROM conversations GROUP BY 1)
        SELECT conv_id, CASE conv_id % 3 WHEN 1 THEN 'partial_parse' WHEN 2 THEN 'parse_failed' ELSE CASE WHEN chars < 200 THEN 'zero_text' ELSE 'ok' END END AS parse_status,
            CASE conv_id % 3 WHEN 1 THEN array_to_string(errors[1:10], '; ') || CASE WHEN len(errors) > 10 THEN ' (+' || (len(errors) - 10) || ' more)' ELSE '' END
                WHEN 2 THEN array_to_string(errors[1:5], '; ') END AS parse_error FROM f"""
_REPEATED = """parts AS (
    SELECT conv_id, turn, again, text, '## ' || role || chr(10) || CASE WHEN turn % 3 = 1 THEN '### Turn' || chr(10) ELSE '' END || text || chr(10) AS part
    FROM (SELECT *, unnest(CASE WHEN turn % 2 = 0 THEN [0, 1] ELSE [0] END) AS again FROM conversations)
), repeated AS (
    SELECT conv_id, 'repeated/' || conv_id || '.md' AS rel_path, ['ok', 'partial_parse', 'parse_failed'][conv_id % 3 + 1] AS parse_status,
           '# Repeated ' || conv_id || chr(10) || string_agg(part, '' ORDER BY again, turn) AS markdown FROM parts GROUP BY conv_id
)"""
# Items sought one after the other, as a walk.
_MARKS = """items AS (
    SELECT conv_id, again * 1000 + turn AS seq, CASE WHEN turn % 5 = 4 THEN 'not in the file' ELSE text END AS text, turn // 2 % 3 AS page FROM parts
    UNION ALL SELECT conv_id, again * 1000 + turn + 2003, text, 9 FROM parts WHERE turn % 4 = 1
), listed AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq) AS n, substr(trim(text, ' ' || chr(9) || chr(10)), 1, 40) AS anchor, page FROM items WHERE trim(text) <> ''
), walk AS (
    SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS cursor, -1::BIGINT AS spot, NULL::BIGINT AS page FROM repeated
    UNION ALL
    SELECT conv_id, n, CASE WHEN spot < 0 THEN cursor ELSE spot + length(anchor) END, spot, page FROM (
        SELECT w.conv_id, l.n, w.cursor, l.anchor, l.page, CASE WHEN strpos(substr(r.markdown, w.cursor + 1), l.anchor) > 0
            THEN w.cursor + strpos(substr(r.markdown, w.cursor + 1), l.anchor) - 1 ELSE strpos(r.markdown, l.anchor) - 1 END AS spot
        FROM walk w JOIN listed l ON l.conv_id = w.conv_id AND l.n = w.n + 1 JOIN repeated r ON r.conv_id = w.conv_id)
), marked AS (
    SELECT 'repeated/' || conv_id || '.md' AS rel_path, spot, page FROM walk WHERE spot >= 0 QUALIFY page IS DISTINCT FROM lag(page) OVER (PARTITION BY conv_id ORDER BY n)
)"""


def _chunks_sql(name: str, tokens: int) -> str:
    """name_chunks (conv_id, rel_path, file_hash, heading_path, start, text) of repeated: lines packed by walking each section."""
    most = 4 * tokens + 3
    return rf"""{name}_raw AS (
        SELECT conv_id, rel_path, sha256(markdown) AS file_hash, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS k,
               len(string_split(markdown, chr(10))) AS many FROM repeated WHERE parse_status IN ('ok', 'partial_parse')
    ), {name}_ended AS (SELECT * REPLACE (line || CASE WHEN k < many THEN chr(10) ELSE '' END AS line) FROM {name}_raw
    ), {name}_lines AS (
        SELECT *, sum(length(line)) OVER w - length(line) AS start, count(*) FILTER (regexp_matches(line, '^ {{0,3}}#{{1,6}}[ \t]')) OVER w AS section,
            last_value(CASE WHEN line LIKE '# %' THEN line END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN line LIKE '## %' THEN line END IGNORE NULLS) OVER w AS h2,
            max(CASE WHEN line LIKE '## %' THEN k END) OVER w AS k2, max(CASE WHEN line LIKE '### %' THEN k END) OVER w AS k3
        FROM {name}_ended WHERE line <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    ), {name}_units AS (
        SELECT conv_id, rel_path, file_hash, section, (start + j * {most})::BIGINT AS start, substr(line, j * {most} + 1, {most}) AS text,
            trim(h1[3:], ' ' || chr(10)) || coalesce(' / ' || trim(h2[4:], ' ' || chr(10)), '') || CASE WHEN k3 > k2 THEN ' / Turn' ELSE '' END AS heading_path,
            row_number() OVER (PARTITION BY conv_id, section ORDER BY k, j) AS n
        FROM (SELECT *, unnest(range((length(line) + {most - 1}) // {most})) AS j FROM {name}_lines)
    ), {name}_walk AS (
        SELECT conv_id, section, n, length(text) AS used, 0::BIGINT AS batch FROM {name}_units WHERE n = 1
        UNION ALL
        SELECT u.conv_id, u.section, u.n, CASE WHEN w.used + length(u.text) > {most} THEN length(u.text) ELSE w.used + length(u.text) END, w.batch + (w.used + length(u.text) > {most})::BIGINT
        FROM {name}_walk w JOIN {name}_units u ON u.conv_id = w.conv_id AND u.section = w.section AND u.n = w.n + 1
    ), {name}_chunks AS (
        SELECT conv_id, any_value(rel_path) AS rel_path, any_value(file_hash) AS file_hash, any_value(heading_path) AS heading_path, min(start) AS start, string_agg(text, '' ORDER BY n) AS text
        FROM {name}_units JOIN {name}_walk USING (conv_id, section, n) GROUP BY conv_id, section, batch HAVING regexp_matches(string_agg(text, ''), '\S')
    )"""


_TOLD = f"{_found(3)}, told AS (SELECT rel_path, claim, quote, row_number() OVER (PARTITION BY rel_path ORDER BY seq) AS n FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY rel_path, {_FOLD} ORDER BY seq) = 1))"


_ABOUT = f"{_found(2)}, about AS (SELECT rel_path, claim, quote, row_number() OVER (PARTITION BY rel_path ORDER BY seq) AS n FROM (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY rel_path, {_FOLD} ORDER BY seq) = 1))"
_ANSWERS = f"""{_ABOUT}, told AS (
    SELECT f.rel_path, count(n) AS k, string_agg('One finding speaks to this [' || f.rel_path || '].', ' ') AS said, string_agg('- ' || claim || ' [' || f.rel_path || ']', chr(10) ORDER BY n) AS listed
    FROM files f LEFT JOIN about a ON a.rel_path = f.rel_path GROUP BY 1
), answers AS (
    SELECT rel_path AS answer_id, CASE WHEN k = 0 THEN '{writing.NOTHING}' WHEN k % 7 = 0 THEN 'No usable answer was written; these are the findings and their sources:' || chr(10) || chr(10) || listed ELSE said END AS text,
        CASE WHEN k = 0 THEN 'Sources: none' ELSE 'Sources:' || chr(10) || '  ' || rel_path || ' — (whole file)' END AS sources, k AS resolved, 0::BIGINT AS uncited,
        CASE WHEN k % 7 = 0 THEN 0 WHEN k % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS passes FROM told)"""
_CHECKED = f"""{_FILES}, cut AS (
    SELECT doc_id, rel_path, len(list_filter(string_split(regexp_replace(markdown, '([.!?])[ \\t\\r\\n\\f]+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')) AS n FROM files
), checked AS (
    SELECT *, CASE doc_id % 8 WHEN 1 THEN CASE WHEN n = 0 THEN 'truncated' ELSE 'salvaged' END WHEN 2 THEN 'empty' WHEN 3 THEN 'not json' WHEN 4 THEN 'missing field'
            WHEN 5 THEN 'out of range' WHEN 6 THEN 'truncated' ELSE 'ok' END AS status,
        CASE doc_id % 8 WHEN 4 THEN 'relevant' WHEN 5 THEN 'confidence 1.5' ELSE '' END AS reason,
        CASE WHEN doc_id % 8 IN (0, 7) THEN n WHEN doc_id % 8 = 1 AND n > 0 THEN n - 1 END AS findings FROM cut)"""


def _packed(units: str, key: str, order: str, budget: int, most: int) -> str:
    """units (key, order, tokens) packed greedily, by walking each group."""
    return f"""{units}, ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM units
    ), walk AS (
        SELECT {key}, {order}, n, tokens AS used, 1 AS held, 0::BIGINT AS batch FROM ranked WHERE n = 1
        UNION ALL
        SELECT r.{key}, r.{order}, r.n, CASE WHEN w.used + r.tokens > {budget} OR w.held = {most} THEN r.tokens ELSE w.used + r.tokens END,
               CASE WHEN w.used + r.tokens > {budget} OR w.held = {most} THEN 1 ELSE w.held + 1 END, w.batch + (w.used + r.tokens > {budget} OR w.held = {most})::BIGINT
        FROM walk w JOIN ranked r ON r.{key} = w.{key} AND r.n = w.n + 1
    ) SELECT {key}, {order}, batch FROM walk"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_WORDS = lambda text: f"list_distinct(regexp_extract_all(lower({text}), '[a-z]{{4,}}'))"
_PARTS = lambda rows, size: f"""slices AS (  -- sentences of slices of rows
    SELECT rel_path, part, list_filter(string_split(regexp_replace(substr(markdown, part * {size} + 1, {size}), '([.!?])[ \\t\\r\\n\\f]+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: s <> '') AS said
    FROM (SELECT rel_path, markdown, unnest(range(greatest(1, (length(markdown) + {size - 1}) // {size}))) AS part FROM {rows})
), cut AS (SELECT rel_path, part, unnest(said) AS quote, generate_subscripts(said, 1) AS seq FROM slices)"""  # noqa: E731
_ONES = f"""{_FILES}, ones AS (SELECT file_hash, min(rel_path) AS rel_path, arg_min(doc_id, rel_path) AS doc_id, any_value(markdown) AS markdown FROM files GROUP BY 1
), carded AS (SELECT *, len(list_intersect({_list(TOPIC + WANTED)}, list_sort({_WORDS('markdown')})[1:8])) AS met FROM ones)"""


def _asked_sql(chosen: str, reason: str) -> str:
    return f"""{_ONES}, chosen AS (SELECT *, {reason} AS reason FROM carded WHERE {chosen}), open AS (SELECT * FROM chosen WHERE doc_id % 3 <> 0), {_PARTS('open', 3000)
    }, met AS (SELECT *, len(list_intersect({_list(TOPIC + WANTED)}, {_WORDS('quote')})) AS shared FROM cut
    ), parts AS (SELECT s.rel_path, s.part, coalesce(max(shared), 0) AS best FROM slices s LEFT JOIN met m ON m.rel_path = s.rel_path AND m.part = s.part GROUP BY 1, 2
    ), reasons AS (SELECT rel_path, string_agg('overlap=' || best, ' | ' ORDER BY part) AS reasoning FROM (SELECT rel_path, best, min(part) AS part FROM parts GROUP BY 1, 2) GROUP BY 1
    ), told AS (SELECT rel_path, bool_or(best >= 2) AS relevant, coalesce(max(best) FILTER (best >= 2), min(best)) / {len(TOPIC + WANTED)}.0 AS confidence FROM parts GROUP BY 1
    ), found AS (SELECT rel_path, count(*) AS n, string_agg(quote, '|' ORDER BY part, seq) AS quotes FROM met WHERE shared >= 2 GROUP BY 1
    ), asked AS (
        SELECT rel_path, reason, true AS cached, true AS relevant, 0.25::DOUBLE AS confidence, 'stored' AS reasoning, 0::BIGINT AS findings, md5('') AS quotes FROM chosen WHERE doc_id % 3 = 0
        UNION ALL SELECT o.rel_path, o.reason, false, t.relevant, round(t.confidence::DOUBLE, 6), r.reasoning, coalesce(f.n, 0), md5(coalesce(f.quotes, ''))
        FROM open o JOIN told t USING (rel_path) JOIN reasons r USING (rel_path) LEFT JOIN found f USING (rel_path))"""


_SWEPT = _asked_sql("true", "'sweep'")

_KEY = "sha256('what?' || chr(0) || chr(0) || 'balanced')"

_TOPK = """SELECT query_id, vec_id, score FROM (
            SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
            FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10"""

ORACLE_SQL = {
    "corpus_scan": f"WITH {_FILES} SELECT rel_path, file_hash, strlen(markdown) AS size_bytes, 'txt' AS format FROM files",
    "token_counts": f"WITH {_FILES} SELECT rel_path, greatest(1, length(markdown) // 4) AS tokens FROM files",
    "drift_classify": f"WITH {_DRIFT} SELECT * FROM drifts",
    "drift_report_counts": f"WITH {_DRIFT} SELECT drift, count(*) AS files FROM drifts GROUP BY 1",
    "final_state_after_index": f"WITH {_FILES} SELECT file_hash, min(rel_path) AS rel_path FROM files GROUP BY 1",
    "parse_status": f"WITH {_STATUS} SELECT * FROM statuses",
    "queryable_files": f"SELECT conv_id, parse_status FROM ({_OUTCOMES}) WHERE parse_status IN ('ok', 'partial_parse')",
    "flagged_files": f"SELECT conv_id, parse_status, parse_error FROM ({_OUTCOMES}) WHERE parse_status <> 'ok'",
    "html_to_markdown": f"SELECT 'pages/' || page_id || '.html' AS rel_path, {_MARKDOWN} AS markdown FROM pages",
    "conversation_markdown": f"WITH {_CONV} SELECT rel_path, sha256(markdown) AS file_hash, markdown FROM convs",
    "page_marks": f"WITH {_CONV} SELECT rel_path, spot::BIGINT AS offset, page FROM marks",
    "page_at": f"WITH {_CONV} SELECT p.rel_path, p.spot::BIGINT AS offset, (SELECT max(page) FROM marks m WHERE m.rel_path = p.rel_path AND m.spot <= p.spot) AS page FROM places p",
    "heading_path_at": rf"""WITH {_CONV}, lines AS (
            SELECT rel_path, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM convs
        ), starts AS (
            SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY rel_path ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM lines
        ), heads AS (
            SELECT rel_path, start, length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.*)$', 1)) AS level, trim(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.*)$', 2)) AS title
            FROM starts WHERE regexp_matches(line, '^ {{0,3}}(#{{1,6}})[ \t]+(.*)$')
        ), spots AS (SELECT DISTINCT rel_path, spot FROM places), kept AS (
            SELECT p.rel_path, p.spot, h.level, h.title FROM spots p JOIN heads h ON h.rel_path = p.rel_path AND h.start < p.spot
            WHERE NOT EXISTS (SELECT 1 FROM heads g WHERE g.rel_path = h.rel_path AND g.start < p.spot AND g.start > h.start AND g.level <= h.level)
        )
        SELECT p.rel_path, p.spot::BIGINT AS offset, coalesce(string_agg(title, ' / ' ORDER BY level), '') AS heading_path
        FROM spots p LEFT JOIN kept k ON k.rel_path = p.rel_path AND k.spot = p.spot GROUP BY ALL""",
    "card_chunks": f"""WITH {_FILES} SELECT rel_path, part, md5(substr(markdown, part * 4000 + 1, 4000)) AS digest
        FROM (SELECT rel_path, markdown, unnest(range(greatest(1, (length(markdown) + 3999) // 4000))) AS part FROM files)""",
    "lexical_cards": f"""WITH {_FILES}, cards AS (SELECT rel_path, list_sort(list_distinct(regexp_extract_all(lower(markdown), '[a-z]{{4,}}')))[1:8] AS terms FROM files)
        SELECT rel_path, CASE WHEN len(terms) = 0 THEN 'misc' ELSE array_to_string(terms, ' ') END AS terms FROM cards""",
    "files_needing_cards": f"WITH {_FILES} SELECT rel_path FROM files WHERE file_hash NOT IN (SELECT file_hash FROM files WHERE doc_id % 2 = 0)",
    "route_candidates": f"""WITH {_FILES} SELECT rel_path, CASE WHEN ('0x' || file_hash[1:8])::BIGINT % 7 = 0 THEN 'no decision: included' ELSE 'first' END AS reason
        FROM files WHERE ('0x' || file_hash[1:8])::BIGINT % 7 <> 1""",
    **{f"extract_{n}": f"WITH {_found(k)} SELECT rel_path, seq, quote, claim, overlap FROM findings" for n, k in reading.RELEVANCE.items()},
    "extract_with_definition": f"WITH {_found(1, DEFINED)} SELECT rel_path, seq, quote, claim, overlap FROM findings",
    "section_merge": f"""WITH {_FILES}, parts AS (
            SELECT rel_path, part, len(list_intersect([{', '.join(f"'{w}'" for w in TOPIC)}], list_distinct(regexp_extract_all(lower(substr(markdown, part * 2000 + 1, 2000)), '[a-z]{{4,}}')))) AS shared
            FROM (SELECT rel_path, markdown, unnest(range(greatest(1, (length(markdown) + 1999) // 2000))) AS part FROM files)
        ), firsts AS (SELECT rel_path, shared, min(part) AS part FROM parts GROUP BY 1, 2)
        SELECT p.rel_path, bool_or(p.shared >= 3) AS relevant, coalesce(max(p.shared) FILTER (p.shared >= 3), min(p.shared)) / 8 AS confidence, any_value(r.reasoning) AS reasoning
        FROM parts p JOIN (SELECT rel_path, string_agg('overlap=' || shared, ' | ' ORDER BY part) AS reasoning FROM firsts GROUP BY 1) r USING (rel_path) GROUP BY 1""",
    "quote_ground_exact": f"WITH {_FILES} SELECT item_id, rel_path, strpos(lower(markdown), lower(b.text)) - 1 AS offset FROM files JOIN benchmark b ON strpos(lower(markdown), lower(b.text)) > 0",
    "question_key": "SELECT item_id, sha256(text || chr(0) || 'a definition' || chr(0) || 'recall') AS question_hash FROM benchmark",
    "eval_cache_probe": f"WITH {_FILES} SELECT rel_path, {_KEY} AS question_hash, file_hash IN (SELECT file_hash FROM files WHERE doc_id % 3 = 0) AS cached FROM files",
    "hits": f"WITH {_found(2)}, {_HITS} SELECT * FROM hits",
    "hits_summary": f"WITH {_found(2)}, {_HITS} SELECT count(*) AS hits, count(DISTINCT rel_path) AS files FROM hits",
    "files_without_findings": f"WITH {_found(3)} SELECT rel_path FROM files WHERE rel_path NOT IN (SELECT rel_path FROM findings)",
    "evidence_numbered": f"WITH {_found(3)}, {_HITS} SELECT rel_path, seq, row_number() OVER (ORDER BY rel_path, seq) AS number FROM hits",
    "cite_render": """SELECT conv_id, turn, '[conversations/' || conv_id || '.md' || CASE WHEN turn = 0 THEN '' ELSE ' § ' || role || ' ' || turn || ', p.' || turn END
        || CASE WHEN turn % 3 <> 0 THEN '' ELSE ' (unverified)' END || ']' AS cite FROM conversations""",
    "claim_coverage": rf"""WITH {_SENTENCES} SELECT f.rel_path, count(quote) AS sentences, count(*) FILTER (regexp_matches(quote, '\p{{L}}') AND
        len(list_filter(regexp_split_to_array(quote, '[ \t\r\n\f]+'), lambda w: w <> '')) >= 4) AS claims FROM files f LEFT JOIN sentences s ON s.rel_path = f.rel_path GROUP BY 1""",
    "cost_estimate_query": f"""WITH {_FILES} SELECT count(*) AS files, sum(greatest(1, length(markdown) // 4))::BIGINT AS extract_in, count(*) * 1024 AS extract_out,
        count(*) * 1024 AS synthesize_in, 1024::BIGINT AS synthesize_out FROM files""",
    "cost_estimate_pass1": f"""WITH {_FILES}, cards AS (SELECT * FROM files WHERE doc_id % 2 = 0), pending AS (SELECT * FROM files WHERE file_hash NOT IN (SELECT file_hash FROM cards))
        SELECT sum(greatest(1, length(markdown) // 4))::BIGINT AS catalog_in, count(*) * 1024 AS catalog_out, (SELECT count(*) FROM cards) * 1024 AS route_in,
        (SELECT greatest(ceil(count(*) * 1024 / 30768), ceil(count(*) / 13)) FROM cards)::BIGINT AS shards FROM pending""",
    "usage_by_task": "SELECT event_type AS task, count(*) AS calls, sum(event_id)::BIGINT AS tokens_in, sum(event_id % 100)::BIGINT AS tokens_out FROM events GROUP BY 1",
    "prune_runs": f"WITH {_EVALS} SELECT run_id, event_id FROM evals WHERE run_id IN (SELECT run_id FROM evals GROUP BY 1 ORDER BY max(evaluated_at) DESC, run_id DESC LIMIT 20)",
    "verdict_history": f"WITH {_EVALS} SELECT *, row_number() OVER (PARTITION BY task, run_id ORDER BY evaluated_at DESC, event_id DESC) AS place FROM evals",
    "score_routing": f"WITH {_PAIRS} SELECT pair, round(recall, 9) AS recall, round(precision, 9) AS precision, missing, stray, forbidden FROM scores",
    "score_mean": f"WITH {_PAIRS} SELECT round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision FROM scores",
    "section_split": f"""WITH {_CONV}, {_CUTS} SELECT rel_path, row_number() OVER (PARTITION BY rel_path ORDER BY place, j) - 1 AS section, md5(substr(text, j * 400 + 1, 400)) AS digest
        FROM (SELECT rel_path, place, text, unnest(range(greatest(1, (length(text) + 399) // 400))) AS j FROM l6)""",
    "merge_cards": f"""WITH {_FILES}, parts AS (
            SELECT rel_path, part, list_sort(list_distinct(regexp_extract_all(lower(substr(markdown, part * 4000 + 1, 4000)), '[a-z]{{4,}}')))[1:8] AS terms
            FROM (SELECT rel_path, markdown, unnest(range(greatest(1, (length(markdown) + 3999) // 4000))) AS part FROM files)
        ), items AS (SELECT rel_path, part, generate_subscripts(terms, 1) AS pos, unnest(terms) AS item FROM parts
        ), firsts AS (SELECT rel_path, item, min((part, pos)) AS spot FROM items GROUP BY 1, 2
        ), kept AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY spot) AS n FROM firsts)
        SELECT f.rel_path, coalesce(string_agg(item, ' ' ORDER BY n), '') AS terms FROM files f LEFT JOIN kept k ON k.rel_path = f.rel_path AND n <= 50 GROUP BY 1""",
    "card_render": f"WITH {_CARDS} SELECT rel_path, card FROM cards",
    "route_shards": "WITH RECURSIVE " + _packed(f"""{_CARDS}, units AS (SELECT 0 AS everything, rel_path, greatest(1, length(card) // 4) AS tokens FROM cards)""", "everything", "rel_path", 600, 13)
        .removesuffix("SELECT everything, rel_path, batch FROM walk") + "SELECT rel_path, batch AS shard FROM walk",
    "reduce_batches": "WITH RECURSIVE " + _packed(f"{_found(2)}, {_HITS}, units AS (SELECT rel_path, seq, greatest(1, length(quote) // 4) AS tokens FROM hits)", "rel_path", "seq", 60, -1),
    "quote_ground_full": f"WITH {_found(3)} SELECT rel_path, seq, true AS verified, md5(lower(trim(quote, chr(32) || chr(9) || chr(10) || chr(13)))) AS digest FROM findings",
    "cite_resolve": """WITH said AS (
            SELECT conv_id, turn, 'Turn ' || turn || ' says something about this ' || CASE WHEN turn % 2 = 0 THEN '[conversations/' || conv_id || '.md]' ELSE '[uncited]' END
                || ' [uncited]. Nothing more is said here. [uncited]' AS line FROM conversations)
        SELECT conv_id AS answer_id, string_agg(line, chr(10) ORDER BY turn) AS text, count(*) FILTER (turn % 2 = 0) AS resolved, 2 * count(*) + count(*) FILTER (turn % 2 <> 0) AS uncited,
            count(DISTINCT turn) FILTER (turn % 2 = 0) AS used, 2 * count(*) AS bad FROM said GROUP BY 1""",
    "sources_block": """SELECT 'conversations/' || conv_id || '.md' AS rel_path, array_to_string(list_sort(list(DISTINCT
            CASE WHEN turn % 4 <> 0 THEN role || ' ' || turn WHEN turn > 0 THEN 'p.' || turn ELSE '(whole file)' END)), ', ') AS sections FROM conversations GROUP BY conv_id""",
    "score_citations": """SELECT conv_id AS answer_id, CASE WHEN count(*) FILTER (turn % 5 = 4 OR turn <> 0) = 0 THEN 1.0 ELSE
            round(count(*) FILTER (turn % 5 <> 4 AND turn <> 0) / count(*) FILTER (turn <> 0), 9) END AS validity, coalesce(bool_or(turn % 5 <> 4 AND turn <> 0), false) AS must_cite_ok
        FROM conversations GROUP BY 1""",
    "json_salvage": f"""WITH {_FILES}, cut AS (
            SELECT doc_id, rel_path, len(list_filter(string_split(regexp_replace(markdown, '([.!?])[ \\t\\r\\n\\f]+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: s <> '')) AS n FROM files)
        SELECT rel_path, greatest(0, n - doc_id % 2) AS findings FROM cut""",
    "vector_topk": _TOPK,
    "vector_inverted_file": _TOPK,
    "vector_recall": f"SELECT count(DISTINCT query_id) AS queries, count(*) AS hits, true AS enough FROM ({_TOPK})",
    "vector_reranked": f"""SELECT query_id, vec_id, score, round(1.0::DOUBLE / (1 + abs(vec_id - query_id)), 9) AS rerank FROM ({_TOPK})
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY abs(vec_id - query_id), score DESC, vec_id) <= 5""",
    "index_apply": f"WITH {_INDEX} SELECT file_hash, rel_path, size_bytes FROM after",
    "index_stored": f"""WITH {_INDEX} SELECT a.file_hash, a.rel_path, any_value(strlen(f.markdown)) AS size_bytes, any_value(regexp_matches(f.markdown, '\\S')) AS chunked
        FROM after a JOIN files f ON f.file_hash = a.file_hash GROUP BY 1, 2""",
    "index_forced": f"WITH {_DRIFT} SELECT d.* REPLACE (CASE WHEN drift = 'unchanged' AND f.doc_id % 7 = 0 THEN 'forced' ELSE drift END AS drift) FROM drifts d LEFT JOIN files f USING (rel_path)",
    "call_costs": """WITH calls AS (SELECT event_id, event_type AS task, ['small', 'host/large', 'large', 'unknown'][event_id % 4 + 1] AS served, event_id % 5000 AS i, event_id % 77 AS o FROM events)
        SELECT event_id, task, served, round((CASE WHEN task = 'click' AND served IN ('large', 'host/large') THEN 2.0 * i WHEN task = 'purchase' AND served = 'large' THEN 0.5 * o
            WHEN served = 'small' THEN 0.25 * i + o WHEN served = 'large' THEN 3.0 * i + 15.0 * o WHEN served = 'host/large' THEN 4.0 * i + 16.0 * o ELSE 0 END)::DOUBLE, 3) AS microcost FROM calls""",
    "index_cascade": f"WITH {_INDEX} SELECT file_hash FROM after WHERE kept",
    "index_status": f"""WITH {_INDEX}, {_STATUS} SELECT rel_path, drift AS kind, coalesce(old_path, '') AS detail FROM drifts WHERE drift <> 'unchanged'
        UNION ALL SELECT rel_path, 'flagged', parse_status FROM statuses WHERE parse_status <> 'ok'""",
    "evaluations_latest": """SELECT user_id, event_type, ts, event_id, value FROM (
            SELECT user_id, event_type, ts, event_id, value, 0 AS n FROM events UNION ALL SELECT user_id, event_type, ts, event_id, -1.0, 1 FROM events WHERE event_type = 'click')
        QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC, n DESC) = 1""",
    "conversion_status": _OUTCOMES,
    "page_changes": """SELECT conv_id AS rel_path, turn * 10 AS "offset", turn // 2 % 3 AS page FROM conversations
        QUALIFY page IS DISTINCT FROM lag(page) OVER (PARTITION BY conv_id ORDER BY turn)""",
    "page_map_anchored": f"WITH RECURSIVE {_REPEATED}, {_MARKS} SELECT rel_path, spot AS offset, page FROM marked",
    "token_chunks": f"""WITH RECURSIVE {_REPEATED}, {_MARKS}, {_chunks_sql('fit', 60)}
        SELECT file_hash || ':' || (row_number() OVER (PARTITION BY rel_path ORDER BY start) - 1) AS chunk_id, rel_path, heading_path,
            (SELECT arg_max(page, (spot, page)) FROM marked m WHERE m.rel_path = c.rel_path AND m.spot <= c.start) AS page, start AS char_start, start + length(text) AS char_end, md5(text) AS digest
        FROM fit_chunks c""",
    "chunks_replaced": f"""WITH RECURSIVE {_REPEATED}, {_chunks_sql('fit', 60)}, {_chunks_sql('old', 200)}
        SELECT rel_path, count(*) AS chunks, max(length(text)) AS longest FROM (
            SELECT rel_path, text FROM fit_chunks WHERE conv_id % 2 = 0 UNION ALL SELECT rel_path, text FROM old_chunks WHERE conv_id % 2 <> 0) GROUP BY 1""",
    "section_plan": f"""WITH {_FILES} SELECT rel_path, part AS section, md5(substr(markdown, part * 3000 + 1, 3000)) AS digest
        FROM (SELECT rel_path, markdown, unnest(range(greatest(1, (length(markdown) + 2999) // 3000))) AS part FROM files)""",
    "verdicts_with_findings": f"""WITH {_FILES}, parts AS (
            SELECT rel_path, part, len(list_intersect([{', '.join(f"'{w}'" for w in TOPIC)}], list_distinct(regexp_extract_all(lower(substr(markdown, part * 2000 + 1, 2000)), '[a-z]{{4,}}')))) AS shared
            FROM (SELECT rel_path, markdown, unnest(range(greatest(1, (length(markdown) + 1999) // 2000))) AS part FROM files))
        SELECT rel_path, bool_or(shared >= 3) AS relevant, coalesce(string_agg('section ' || part, '; ' ORDER BY part) FILTER (shared >= 3), '') AS quotes,
            coalesce(string_agg('overlap=' || shared, '; ' ORDER BY part) FILTER (shared >= 3), '') AS claims FROM parts GROUP BY 1""",
    "hits_grouped": f"""WITH {_found(2)}, firsts AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY rel_path, {_FOLD} ORDER BY seq) = 1
        ), g AS (SELECT rel_path, claim AS heading, min(seq) AS f, count(*) AS hits, count(*) FILTER (overlap > 2) AS verified, count(*) FILTER (overlap <= 2) AS unverified FROM firsts GROUP BY 1, 2)
        SELECT rel_path, heading, row_number() OVER (PARTITION BY rel_path ORDER BY f) - 1 AS place, hits, verified, unverified FROM g""",
    "route_lexical": f"""WITH {_FILES}, cards AS (
            SELECT DISTINCT file_hash, len(list_intersect([{', '.join(f"'{w}'" for w in TOPIC + WANTED)}], list_sort(list_distinct(regexp_extract_all(lower(markdown), '[a-z]{{4,}}')))[1:8])) AS shared
            FROM files WHERE doc_id % 2 = 0)
        SELECT rel_path, CASE WHEN shared IS NULL THEN 'no card: included' ELSE 'overlap=' || shared END AS reason FROM files LEFT JOIN cards USING (file_hash) WHERE shared IS NULL OR shared >= 2""",
    "cost_by_task": """SELECT event_type AS task, round((sum(event_id) * CASE event_type WHEN 'click' THEN 0.15::DOUBLE WHEN 'view' THEN 0.3::DOUBLE WHEN 'purchase' THEN 0.45::DOUBLE ELSE 0 END
        + sum(event_id % 100) * CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 0.6::DOUBLE ELSE 0 END) / 1000000, 4) AS cost FROM events GROUP BY 1""",
    "evidence_block": f"""WITH {_TOLD} SELECT rel_path AS answer_id, md5(string_agg('[' || n || ']' || chr(10) || '    claim: ' || claim || chr(10) || '    quote: ' || quote, chr(10) ORDER BY n)) AS digest FROM told GROUP BY 1""",
    "claims_digest": f"WITH {_TOLD} SELECT rel_path AS answer_id, string_agg(claim || ' [' || n || ']', ' ' ORDER BY n) AS digest FROM told GROUP BY 1",
    "fallback_digest": f"""WITH {_TOLD} SELECT rel_path AS answer_id, 'No usable answer was written; these are the findings and their sources:' || chr(10) || chr(10)
        || string_agg('- ' || claim || ' [' || rel_path || ']', chr(10) ORDER BY n) AS text, 0::BIGINT AS uncited FROM told GROUP BY 1""",
    "quote_snap": rf"""WITH {_CONV}, asked AS (
            SELECT c.conv_id, c.turn, rel_path, c.role, c.text, length(trim(regexp_replace(c.text, '\s+', ' ', 'g'))) >= 40 AS verified
            FROM conversations c JOIN convs USING (conv_id))
        SELECT rel_path, turn AS seq, verified, CASE WHEN verified THEN 'Conversation ' || conv_id || ' / ' || role || ' ' || turn END AS heading_path,
            CASE WHEN verified THEN turn + 1 END AS page, CASE WHEN verified THEN md5(trim(text, chr(32) || chr(9) || chr(10) || chr(13))) END AS digest FROM asked""",
    "evidence_reduced": f"""WITH {_ABOUT} SELECT rel_path AS answer_id, length(string_agg('[' || n || ']' || chr(10) || '    claim: ' || claim || chr(10) || '    quote: ' || quote, chr(10))) // 4 > 150 AS reduced,
        count(*) AS marks FROM about GROUP BY 1""",
    "answers_written": f"WITH {_ANSWERS} SELECT answer_id, text, sources, resolved, uncited, passes FROM answers",
    "answers_scored": f"WITH {_ANSWERS} SELECT answer_id, 1.0::DOUBLE AS validity, contains(text || chr(10) || sources, 'docs/') AND contains(text || chr(10) || sources, 'speaks to') AS must_cite_ok FROM answers",
    "replies_checked": f"WITH {_CHECKED} SELECT rel_path, status, reason, findings FROM checked",
    "replies_repaired": f"""WITH {_CHECKED} SELECT rel_path, CASE WHEN again THEN 'ok' ELSE status END AS status, CASE WHEN again THEN 2 ELSE 1 END::BIGINT AS attempts, CASE WHEN again THEN n ELSE findings END AS findings
        FROM (SELECT *, findings IS NULL AND status <> 'empty' AND doc_id % 3 = 0 AS again FROM checked)""",
    "ask_route": "WITH " + _asked_sql("met >= 2", "'overlap=' || met") + " SELECT * FROM asked",
    "ask_sweep": f"WITH {_SWEPT} SELECT * FROM asked",
    "ask_auto": "WITH " + _asked_sql("met >= 2 OR (SELECT count(*) FROM ones) <= 150", "CASE WHEN (SELECT count(*) FROM ones) <= 150 THEN 'sweep' ELSE 'overlap=' || met END") + " SELECT * FROM asked",
    "ask_report": f"""WITH {_SWEPT} SELECT count(*) AS candidates, count(*) FILTER (cached) AS cached, count(*) FILTER (relevant) AS relevant, sum(findings)::BIGINT AS findings,
        count(*) FILTER (relevant AND findings = 0) AS silent FROM asked""",
    "ask_estimate": f"""WITH {_ONES}, sized AS (SELECT *, greatest(1, length(markdown) // 4) AS n FROM carded), sums AS (
            SELECT coalesce(sum(n) FILTER (doc_id % 2 <> 0), 0) AS ci, count(*) FILTER (doc_id % 2 <> 0) * 1024 AS co, count(*) * 1024 AS ri,
                   greatest(ceil(count(*) * 1024 / 30768), ceil(count(*) / 13)) * 1024 AS ro, coalesce(sum(n) FILTER (met >= 2), 0) AS ei, count(*) FILTER (met >= 2) * 1024 AS eo FROM sized
        ), tasks AS (
            SELECT 'catalog' AS task, ci AS i, co AS o, 0.15::DOUBLE AS a, 0.6::DOUBLE AS b FROM sums UNION ALL SELECT 'route', ri, ro, 0.15, 0.6 FROM sums
            UNION ALL SELECT 'extract', ei, eo, 3.0, 15.0 FROM sums UNION ALL SELECT 'synthesize', eo, 1024, 0, 0 FROM sums)
        SELECT task, i::BIGINT AS tokens_in, o::BIGINT AS tokens_out, round((i * a + o * b) / 1000000, 4) AS cost FROM tasks""",
    "evaluation_arms": f"""WITH {_FILES}, pairs AS (SELECT * FROM (VALUES ('first', {_list(TOPIC)}, 0), ('second', {_list(WANTED)}, 1), ('third', {_list(TOPIC[:2] + WANTED[:3])}, 2)) v(pair, topic, k)
        ), {_PARTS('files', 3000)}, said AS (SELECT rel_path, {_WORDS('quote')} AS w FROM cut
        ), cards AS (SELECT rel_path, list_sort({_WORDS('markdown')})[1:8] AS w FROM files
        ), chosen AS (SELECT DISTINCT 'sweep' AS arm, pair, rel_path FROM said, pairs WHERE len(list_intersect(w, topic)) >= 2
            UNION ALL SELECT 'route', pair, rel_path FROM cards, pairs WHERE len(list_intersect(w, topic)) >= 2
        ), marks AS (SELECT arm, pair, rel_path, coalesce(quality = 1, false) AS e, coalesce(toxic = 1, false) AS f
            FROM files JOIN labels USING (doc_id) JOIN pairs ON doc_id % 3 = k CROSS JOIN (VALUES ('route'), ('sweep')) a(arm)
        ), both_ AS (SELECT arm, pair, rel_path, coalesce(e, false) AS e, coalesce(f, false) AS f, coalesce(c.yes, false) AS c
            FROM marks m FULL JOIN (SELECT *, true AS yes FROM chosen) c USING (arm, pair, rel_path)
        ), counts AS (SELECT arm, pair, count(*) FILTER (e) AS want, count(*) FILTER (c) AS got, count(*) FILTER (e AND c) AS hit, count(*) FILTER (f AND c) AS forbidden FROM both_ GROUP BY 1, 2)
        SELECT arm, pair, round(CASE WHEN want = 0 THEN 1.0 ELSE hit / want END, 9) AS recall, round(CASE WHEN got = 0 THEN 1.0 ELSE hit / got END, 9) AS precision,
            want - hit AS missing, got - hit AS stray, forbidden FROM counts""",
}
