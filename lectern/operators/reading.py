"""Reading whole files: sections, cards, routing, lexical extraction, grounding, verdicts, hits, evidence, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions.grounding import folded, spans_of
from lectern.operators.ordering import running
from lectern.sources.shared import written

RELEVANCE = {"recall": 1, "balanced": 2, "strict": 3}


def fixed_slices(files: DataFrame, size: int) -> DataFrame:
    """rel_path, part, text: slices of size code points; an empty file is one empty slice."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length("markdown") / size)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col("markdown"), k * size + 1, F.lit(size)))
    return files.select("rel_path", F.posexplode(cut).alias("part", "text"))


def headings(files: DataFrame) -> DataFrame:
    """rel_path, start (code points), level, title of markdown headings with up to three spaces before them."""
    parts = files.select("rel_path", F.posexplode(F.split("markdown", r"(?md)^(?= {0,3}#{1,6}[ \t])")).alias("k", "part"))
    mark, line = r"^ {0,3}(#{1,6})[ \t]+(.*)$", F.substring_index("part", "\n", 1)
    titled = F.when(line.rlike(mark), F.struct(F.char_length(F.regexp_extract(line, mark, 1)).alias("level"), F.trim(F.regexp_extract(line, mark, 2)).alias("title")))
    slim = parts.select("rel_path", "k", F.char_length("part").alias("size"), titled.alias("h"))  # only lengths and titles are shuffled
    before = Window.partitionBy("rel_path").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    starts = slim.withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0))).where("h is not null")
    return starts.select("rel_path", "start", "h.level", "h.title")


def heading_path_at(places: DataFrame, heads: DataFrame) -> DataFrame:
    """places (rel_path, offset) with heading_path: the headings that start before offset and that no later one of the same or a higher rank follows."""
    seen = places.join(heads, "rel_path", "left").where(F.col("start").isNull() | (F.col("start") < F.col("offset")))
    later = Window.partitionBy("rel_path", "offset").orderBy("start").rowsBetween(1, Window.unboundedFollowing)
    kept = seen.withColumn("least", F.min("level").over(later)).where(F.col("level").isNotNull() & (F.col("least").isNull() | (F.col("least") > F.col("level"))))
    paths = kept.groupBy("rel_path", "offset").agg(F.array_join(F.sort_array(F.collect_list(F.struct("level", "title")))["title"], " / ").alias("heading_path"))
    return places.join(paths, ["rel_path", "offset"], "left").select("rel_path", "offset", F.coalesce("heading_path", F.lit("")).alias("heading_path"))


def lexical_cards(files: DataFrame) -> DataFrame:
    """rel_path, file_hash, terms: the first eight distinct words by the alphabet, or `misc`."""
    terms = F.slice(F.sort_array(T.words(F.col("markdown"))), 1, 8)
    return files.select("rel_path", "file_hash", F.when(F.size(terms) > 0, terms).otherwise(F.array(F.lit("misc"))).alias("terms"))


def without_cards(files: DataFrame, cards: DataFrame) -> DataFrame:
    return files.join(cards.select("file_hash"), "file_hash", "left_anti")


def route(cards: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates: cards that a decision includes, and cards that none decided; unknown hashes are dropped, the first decision on a file counts."""
    decided = decisions.groupBy("file_hash").agg(F.min(F.struct("shard", "pos", "include", "reason")).alias("d")).select("file_hash", "d.include", "d.reason")
    joined = cards.join(decided, "file_hash", "left")
    reason = F.coalesce("reason", F.lit("no decision: included"))
    return joined.where(F.coalesce("include", F.lit(True))).select("rel_path", "file_hash", reason.alias("reason"))


def lexical_decisions(cards: DataFrame, question: list[str], least: int = 2) -> DataFrame:
    """A router's decision on each card (file_hash, terms): included if it shares `least` words with the question; shard, pos, file_hash, include, reason."""
    shared = F.size(F.array_intersect("terms", F.array(*map(F.lit, question))))
    reason = F.concat(F.lit("overlap="), shared.cast("string"))
    return cards.select(F.lit(0).alias("shard"), F.lit(0).alias("pos"), "file_hash", (shared >= least).alias("include"), reason.alias("reason"))


def candidates(files: DataFrame, cards: DataFrame, question: list[str], mode: str = "auto", threshold: int = 150) -> DataFrame:
    """rel_path, file_hash, reason of the files to be read: all of them in a sweep, which `auto` takes up to `threshold` files, else those that
    the router lets in, and those without a card."""
    if mode == "sweep" or mode == "auto" and files.limit(threshold + 1).count() <= threshold:
        return files.select("rel_path", "file_hash", F.lit("sweep").alias("reason"))
    known = files.join(cards.select("file_hash").distinct(), "file_hash", "left_semi")
    routed = route(known, lexical_decisions(cards, question).dropDuplicates(["file_hash"]))
    return routed.unionByName(without_cards(files, cards).select("rel_path", "file_hash", F.lit("no card: included").alias("reason")))


def extract(files: DataFrame, topic: list[str], relevance: str = "balanced") -> DataFrame:
    """Findings of the lexical judge, one per sentence that shares enough words with the topic:
    rel_path, file_hash, seq, quote, claim (shared words), overlap, confidence."""
    least, want = RELEVANCE[relevance], F.array(*[F.lit(w) for w in topic])
    parts = files.select("rel_path", "file_hash", F.posexplode_outer(T.sentences(F.col("markdown"))).alias("seq", "quote"))
    found = parts.withColumn("shared", F.array_sort(F.array_intersect(want, T.words(F.col("quote"))))).where(F.size("shared") >= least)
    return found.select("rel_path", "file_hash", "seq", "quote", F.array_join("shared", " ").alias("claim"), F.size("shared").alias("overlap"), (F.size("shared") / F.lit(float(len(topic)))).alias("confidence"))


def _merged() -> list[Column]:
    seen = F.sort_array(F.collect_list(F.struct("section", F.trim("reasoning").alias("r"))))["r"]
    return [
        F.bool_or("relevant").alias("relevant"),
        F.coalesce(F.max(F.when(F.col("relevant"), F.col("confidence"))), F.min("confidence")).alias("confidence"),
        F.array_join(F.array_distinct(F.filter(seen, lambda r: r != "")), " | ").alias("reasoning"),
    ]


def merge_sections(verdicts: DataFrame) -> DataFrame:
    """File verdicts from sections (rel_path, section, relevant, confidence, reasoning): relevant if any is; the largest confidence of relevant sections, or
    the least of all; distinct reasons in order."""
    return verdicts.groupBy("rel_path").agg(*_merged())


def merge_verdicts(verdicts: DataFrame) -> DataFrame:
    """merge_sections() with findings (array<struct<claim, quote>>): those of relevant sections, in order of section; none of an irrelevant file."""
    taken = F.sort_array(F.collect_list(F.when(F.col("relevant"), F.struct("section", "findings"))))["findings"]
    return verdicts.groupBy("rel_path").agg(*_merged(), F.flatten(taken).alias("findings"))


def snap(grounded: DataFrame, files: DataFrame) -> DataFrame:
    """ground()'s rows with heading_path and page of the first span; page_marks are those of files (rel_path, markdown, page_marks). Unverified: no page."""
    at = grounded.where("verified").select("rel_path", (F.col("offset") + 1).cast("long").alias("offset")).distinct()
    paths = heading_path_at(at, headings(files)).select("rel_path", (F.col("offset") - 1).alias("offset"), "heading_path")
    rows = grounded.withColumn("offset", F.col("offset").cast("long")).join(paths, ["rel_path", "offset"], "left").join(files.select("rel_path", "page_marks"), "rel_path", "left")
    return rows.withColumn("page", F.when(F.col("verified"), T.page_at(F.col("page_marks"), F.col("offset")))).drop("page_marks")


def group_hits(found: DataFrame) -> DataFrame:
    """hits (rel_path, seq, heading_path, verified) by file and heading: rel_path, heading, place (headings of a file by their first
    hit, from 0), hits, verified, unverified."""
    one = found.groupBy("rel_path", F.coalesce("heading_path", F.lit("")).alias("heading")).agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("hits"), F.count_if("verified").alias("verified"), F.count_if(~F.col("verified")).alias("unverified")
    )
    place = F.row_number().over(Window.partitionBy("rel_path").orderBy("first")) - 1
    return one.withColumn("place", place).drop("first")


def plan_sections(files: DataFrame, window: int = 32768, max_tokens: int = 1024, overhead: int = 2000) -> DataFrame:
    """split_sections() for a judge's window: what the prompt and the reply leave, 1,000 tokens at least, at three characters a token."""
    return split_sections(files, 3 * max(window - overhead - max_tokens, 1000))


#: What stands between words, in lower case.
BETWEEN = r"[^\p{L}\p{N}]+"


def _run_keys(words: str) -> Column:
    """Hashes of an array's runs of three words."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda k: F.xxhash64(F.get(words, k), F.get(words, k + 1), F.get(words, k + 2)))
    return F.when(F.size(words) >= 3, runs).otherwise(F.array().cast("array<bigint>"))


def _word_keys(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def ground_exact(quotes: DataFrame, files: DataFrame, block: int = 200) -> DataFrame:
    """Where quotes (item_id, quote) stand word for word, ignoring case: item_id, rel_path, offset (code points of the first place).

    1. The words inside a quote, all but what touches its ends, stand in a text as they are. Its keys are the hashes of its runs of three such words, or of
       the words, if it has fewer. One pass over the texts keeps the postings of those keys that some quote has.
    2. Postings are counted, and a quote meets the files of its rarest key alone; a quote with a key that no file has is nowhere.
    3. Only these pairs of file and quote are compared.
    A quote of one or two pieces of words is first led to the words of the corpus that end, begin or go on with it, by its longer piece, in blocks of about
    `block` such quotes, a row each; these words are its keys, any of which will do. Quotes without words are tried on all files, in such
    blocks; empty ones stand at the start of every file. Null quotes stand nowhere. Passes and blocks for kinds of quotes that aren't there are left out.
    """
    low = files.select("rel_path", F.lower("markdown").alias("low"))
    said = low.select("rel_path", F.split("low", BETWEEN, -1).alias("w"))
    asked = quotes.select("item_id", F.lower("quote").alias("q")).where("q is not null").withColumn("w", F.split("q", BETWEEN, -1))
    asked = written(asked.select("item_id", "q", F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))).alias("inner"), "w"), "quotes")
    kinds = {r["kind"]: r["n"] for r in asked.groupBy(_quote_kind().alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def postings(wanted: DataFrame, *keys: Column) -> DataFrame:
        each = said.select("rel_path", F.explode(F.array_distinct(F.concat(*keys))).alias("key"))
        return written(each.join(wanted.select("key").distinct(), "key"), "postings")

    pairs = [asked.select("item_id", F.lit("").alias("rel_path")).limit(0)]
    if kinds.get("run") or kinds.get("word"):
        own = asked.where(_quote_kind().isin("run", "word"))
        own = own.select("item_id", "q", F.explode(F.when(_quote_kind() == "run", _run_keys("inner")).otherwise(_word_keys("inner"))).alias("key"))
        own = written(own, "quote-keys")
        found = postings(own, *[_run_keys("w")] * ("run" in kinds), *[_word_keys("w")] * ("word" in kinds))
        counts = found.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        rarest = own.join(counts, "key", "left").groupBy("item_id", "q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("r")).where("r.n > 0")
        pairs.append(rarest.select("item_id", F.col("r.key").alias("key")).join(found, "key").select("item_id", "rel_path"))
    if kinds.get("piece"):
        first, last = F.get("w", 0), F.get("w", F.size("w") - 1)
        ends = F.size("w") > 1
        piece = F.when(~ends, first).when(F.char_length(first) >= F.char_length(last), first).otherwise(last)
        how = F.when(~ends, "in").when(F.char_length(first) >= F.char_length(last), "end").otherwise("start")
        few = asked.where(_quote_kind() == "piece").select("item_id", piece.alias("p"), how.alias("how"))
        packed = few.groupBy(F.pmod(F.xxhash64("item_id", "p"), F.lit(-(-kinds["piece"] // block))).alias("block")).agg(F.collect_list(F.struct("item_id", "p", "how")).alias("qs")).drop("block")
        words = said.select(F.explode(F.array_distinct("w")).alias("word")).distinct()
        fits = lambda q: F.when(q["how"] == "in", F.contains("word", q["p"])).when(q["how"] == "end", F.endswith("word", q["p"])).otherwise(F.startswith("word", q["p"]))
        led = words.crossJoin(packed).select("word", F.explode(F.transform(F.filter("qs", fits), lambda q: q["item_id"])).alias("item_id"))
        led = written(led.select("item_id", F.xxhash64("word").alias("key")).distinct(), "led-words")
        pairs.append(led.join(postings(led, _word_keys("w")), "key").select("item_id", "rel_path"))
    met = pairs[0]
    for more in pairs[1:]:
        met = met.unionByName(more)
    met = written(met.distinct(), "met")
    at = lambda q: F.instr(F.col("low"), q) - 1
    found = low.join(met, "rel_path").join(asked.select("item_id", "q"), "item_id").select("item_id", "rel_path", at(F.col("q")).alias("offset"))
    if kinds.get("none"):
        bare = asked.where(_quote_kind() == "none")
        packed = bare.groupBy(F.pmod(F.xxhash64("item_id", "q"), F.lit(-(-kinds["none"] // block))).alias("block")).agg(F.collect_list(F.struct("item_id", "q")).alias("qs")).drop("block")
        tried = low.crossJoin(packed).select("rel_path", F.explode(F.transform("qs", lambda q: F.struct(q["item_id"].alias("item_id"), at(q["q"]).alias("offset")))).alias("f"))
        found = found.unionByName(tried.select("f.item_id", "rel_path", "f.offset"))
    return found.where("offset >= 0").distinct()


def _quote_kind() -> Column:
    """Whether a quote has three words inside, one or two, pieces of words at its ends only, or none."""
    return F.when(F.size("inner") >= 3, "run").when(F.size("inner") > 0, "word").when(F.exists("w", lambda w: w != ""), "piece").otherwise("none")


def hits(findings: DataFrame) -> DataFrame:
    """Findings without repeats: the first of each file and quote, or claim if the quote is empty. Quotes are the same if they are when folded, as in
    grounding: whatever their case, accents, typography, white space and broken words."""
    key = F.when(F.trim("quote") != "", folded("quote")).otherwise(F.concat(F.lit("claim:"), F.lower("claim")))
    w = Window.partitionBy("rel_path", key).orderBy("seq")
    return findings.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def number_evidence(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """hits with number: 1, 2, ... by (rel_path, seq), without a task that numbers all rows: only the files' counts are dealt to ranges of paths, and
    running() grows with their number."""
    counted = found.groupBy("rel_path").agg(F.count(F.lit(1)).alias("k"))
    starts = running(counted, ["rel_path"], {"start": "k"}, ranges).select("rel_path", "start")
    own = F.row_number().over(Window.partitionBy("rel_path").orderBy("seq"))
    return found.withColumn("own", own).join(starts, "rel_path").withColumn("number", F.col("start") + F.col("own")).drop("own", "start")


def _finer(level: int, most: int):
    """A text's parts at the headings of a level, where it is longer than most and there are several."""

    def parts(text: Column) -> Column:
        cut = F.filter(F.split(text, rf"(?md)^(?=#{{{level}}}\s)"), lambda p: p.rlike(r"\S"))
        several = F.flatten(F.transform(F.array(cut), lambda c: F.when(F.size(c) > 1, c).otherwise(F.array(text))))
        return F.when(F.char_length(text) > most, several).otherwise(F.array(text))

    return parts


def split_sections(files: DataFrame, most: int) -> DataFrame:
    """rel_path, section, text: files cut at their headings where they are longer than most code points, level by level. A
    level that gives one part only is passed over, blank parts are left out, and what is still too long is cut into slices."""
    texts = F.array("markdown")
    for level in range(1, 7):
        texts = F.flatten(F.transform(texts, _finer(level, most)))
    places = lambda t: F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.char_length(t) / most)).cast("int") - 1)
    slices = F.flatten(F.transform(texts, lambda t: F.transform(places(t), lambda k: F.substring(t, k * most + 1, F.lit(most)))))
    return files.select("rel_path", F.posexplode(slices).alias("section", "text"))


def merge_cards(parts: DataFrame, lists: list[str], most: int = 50) -> DataFrame:
    """The cards of a file's parts (rel_path, part, lists) as one: items in order of first use, ignoring case, `most` of each list."""
    each = F.array(*[F.struct(F.lit(name).alias("list"), F.col(name).alias("items")) for name in lists])
    items = parts.select("rel_path", "part", F.explode(each).alias("l")).select("rel_path", "part", "l.list", F.posexplode("l.items").alias("pos", "item"))
    items = items.withColumn("item", F.trim("item")).where("item != ''")
    first = items.groupBy("rel_path", "list", F.lower("item").alias("key")).agg(F.min(F.struct("part", "pos", "item")).alias("first"))
    of = lambda name: F.slice(F.sort_array(F.collect_list(F.when(F.col("list") == name, F.col("first")))), 1, most)["item"]
    merged = first.groupBy("rel_path").agg(*[of(name).alias(name) for name in lists])
    none = F.array().cast("array<string>")
    return parts.select("rel_path").distinct().join(merged, "rel_path", "left").select("rel_path", *[F.coalesce(name, none).alias(name) for name in lists])


def render_card(file_hash: Column, rel_path: Column, doc_type: Column, terms: Column, **lists: Column) -> Column:
    """A card as eight lines; terms are structs of term and sense. Lists: claims, implicit, answers, absences, entities."""
    shown = lambda items: F.when(F.size(items) > 0, F.array_join(items, "; ")).otherwise("-")
    line = lambda name: F.concat(F.lit(f"{name}: "), shown(lists[name]), F.lit("\n"))
    senses = F.transform(terms, lambda t: F.concat(t["term"], F.lit(" = "), t["sense"]))
    kind = F.coalesce(F.nullif(doc_type, F.lit("")), F.lit("-"))
    return F.concat(
        F.lit("FILE "), file_hash, F.lit("\npath: "), rel_path, F.lit(" | type: "), kind, F.lit("\n"), line("claims"),
        F.lit("terms: "), shown(senses), F.lit("\n"), line("implicit"), line("answers"), line("absences"), line("entities"),
    )


def batches(units: DataFrame, group: str | list[str], order: list[str], budget: int, most: int | None = None) -> DataFrame:
    """units with batch, numbered from 0 in each group (one column or several): a new batch begins where the tokens would exceed budget, or units
    exceed most; a unit over the budget is a batch of its own. A group, such as a file, is walked in one task, from its
    order and tokens alone; tasks walk many groups one after the other, and hold some thousand units at a time."""
    keys = [group] if isinstance(group, str) else group

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, batch, used, held = None, 0, 0, 0
        for rows in frames:
            numbers = []
            for *key, tokens in zip(*[rows[k] for k in keys], rows["tokens"], strict=True):
                key = [None if pd.isna(k) else k for k in key]
                if key != last:
                    last, batch, used, held = key, 0, 0, 0
                if held and (used + tokens > budget or held == most):
                    batch, used, held = batch + 1, 0, 0
                used, held = used + tokens, held + 1
                numbers.append(batch)
            yield rows.assign(batch=numbers)

    slim = units.select(*keys, *order, "tokens").repartition(*keys).sortWithinPartitions(*keys, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema) + ", batch long"
    return slim.mapInPandas(run, schema)


def ground(findings: DataFrame, files: DataFrame, at_a_time: int = 500) -> DataFrame:
    """findings (rel_path, seq, quote) with verified, offset (code points of the first span) and quote as it stands in its file,
    spans joined by an ellipsis; an unverified quote stays, without an offset. Null quotes are unverified; findings without a file are left out.

    A file meets its quotes in rows of at_a_time, so its text is folded once for each of them, and no row grows without bound.
    """
    number = F.row_number().over(Window.partitionBy("rel_path").orderBy("seq"))
    asked = findings.select("rel_path", "seq", "quote", F.floor((number - 1) / at_a_time).alias("part"))
    asked = asked.groupBy("rel_path", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "quote"))).alias("asked"))
    both = asked.join(files.select("rel_path", "markdown"), "rel_path").withColumn("spans", spans_of("markdown", F.col("asked")["quote"]))
    piece = lambda s: F.regexp_replace(F.substring(F.col("markdown"), s["start"] + 1, s["end"] - s["start"]), r"^\s+|\s+$", "")
    told = F.transform(
        F.arrays_zip("asked", "spans"),
        lambda z: F.struct(
            z["asked"]["seq"].alias("seq"), (F.size(z["spans"]) > 0).alias("verified"), F.get(z["spans"], 0)["start"].alias("offset"),
            F.when(F.size(z["spans"]) > 0, F.array_join(F.transform(z["spans"], piece), " … ")).otherwise(z["asked"]["quote"]).alias("quote"),
        ),
    )
    return both.select("rel_path", F.explode(told).alias("t")).select("rel_path", "t.*")
