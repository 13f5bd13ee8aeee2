"""A whole query over an index, what it would cost, and evaluation arms over pairs: chains of the other operators, with the judge as a seam."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import ledger, reading
from lectern.sources.shared import written

VERDICT = ["relevant", "confidence", "reasoning", "findings"]
#: Sections (rel_path, section, text) to verdicts (rel_path, section, relevant, confidence, reasoning, findings array<struct<claim, quote>>).
Judge = Callable[[DataFrame], DataFrame]


def lexical_judge(topic: list[str], relevance: str = "recall") -> Judge:
    """A judge that finds each sentence sharing enough words with the topic. The best sentence gives the confidence, a share of the topic."""
    least, want = reading.RELEVANCE[relevance], F.array(*map(F.lit, topic))

    def judge(sections: DataFrame) -> DataFrame:
        said = F.transform(T.sentences(F.col("text")), lambda q: F.struct(F.array_sort(F.array_intersect(want, T.words(q))).alias("words"), q.alias("quote")))
        rows = sections.select("rel_path", "section", said.alias("said"))
        best = F.coalesce(F.array_max(F.transform("said", lambda s: F.size(s["words"]))), F.lit(0))
        found = F.filter("said", lambda s: F.size(s["words"]) >= least)
        return rows.select("rel_path", "section", best.alias("best"), F.transform(found, lambda s: F.struct(F.array_join(s["words"], " ").alias("claim"), s["quote"].alias("quote"))).alias("findings")).select(
            "rel_path", "section", (F.col("best") >= least).alias("relevant"), (F.col("best") / F.lit(float(len(topic)))).alias("confidence"),
            F.concat(F.lit("overlap="), F.col("best").cast("string")).alias("reasoning"), "findings",
        )

    return judge


def ask(
    files: DataFrame, cards: DataFrame, stored: DataFrame, topic: list[str], question_hash: Column, judge: Judge, model: str = "lexical",
    mode: str = "auto", threshold: int = 150, window: int = 32768, use_cache: bool = True,
) -> DataFrame:
    """A verdict on each candidate file: rel_path, file_hash, reason, cached, relevant, confidence, reasoning, findings.

    files (rel_path, file_hash, markdown) hold a content once. A sweep reads all of them; routing makes the cards (rel_path, file_hash, terms)
    that are missing first. stored (question_hash, file_hash, model, and VERDICT) holds a row for each of its keys; files found there aren't
    judged again, unless use_cache is off. Null texts are read as empty, and a file without a verdict of any section is irrelevant.
    """
    files = files.withColumn("markdown", F.coalesce("markdown", F.lit("")))
    if mode != "sweep":
        cards = cards.unionByName(reading.lexical_cards(reading.without_cards(files, cards)).select(cards.columns))
    chosen = reading.candidates(files, cards, topic, mode, threshold)
    kept = stored.where((F.col("question_hash") == question_hash) & (F.col("model") == model) & F.lit(use_cache))
    probed = written(chosen.join(kept.select("file_hash", *VERDICT, F.lit(True).alias("cached")), "file_hash", "left"), "probed")
    missing = probed.where("cached is null").select("rel_path", "file_hash", "reason")
    texts = files.join(missing.select("file_hash"), "file_hash", "left_semi")
    told = missing.join(reading.merge_verdicts(judge(reading.plan_sections(texts, window))), "rel_path", "left")
    none = F.array().cast(stored.schema["findings"].dataType)
    told = told.select(
        "rel_path", "file_hash", "reason", F.lit(False).alias("cached"), F.coalesce("relevant", F.lit(False)).alias("relevant"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("findings", none).alias("findings"),
    )
    return probed.where("cached").select(told.columns).unionByName(told)


def to_store(verdicts: DataFrame, question_hash: Column, model: str = "lexical") -> DataFrame:
    """The rows that ask() adds to the stored verdicts: those that it judged."""
    return verdicts.where("not cached").select(question_hash.alias("question_hash"), "file_hash", F.lit(model).alias("model"), *VERDICT)


def report(verdicts: DataFrame) -> DataFrame:
    """One row of ask()'s verdicts: candidates, cached, relevant, findings, and silent (relevant files without a finding)."""
    n = lambda c: F.count_if(c)
    return verdicts.agg(
        F.count(F.lit(1)).alias("candidates"), n(F.col("cached")).alias("cached"), n(F.col("relevant")).alias("relevant"),
        F.coalesce(F.sum(F.size("findings")), F.lit(0)).cast("long").alias("findings"), n(F.col("relevant") & (F.size("findings") == 0)).alias("silent"),
    )


def estimate(files: DataFrame, cards: DataFrame, topic: list[str], prices: DataFrame, window: int = 32768, max_tokens: int = 1024) -> DataFrame:
    """What a routed query would cost before it is asked: task, tokens_in, tokens_out, cost, for catalog, route, extract, synthesize. All files
    count for routing, as those without a card get one first; candidates are those that the cards let in. prices are those of ledger.costs()."""
    size = T.tokens(F.col("markdown")).alias("tokens")
    pending = reading.without_cards(files, cards)
    every = cards.unionByName(reading.lexical_cards(pending).select(cards.columns))
    chosen = files.join(reading.candidates(files, every, topic, "route").select("file_hash").distinct(), "file_hash", "left_semi")
    first = ledger.estimate_pass1(pending.select(size), files, window, max_tokens)
    both = first.crossJoin(ledger.estimate_query(chosen.select(size), max_tokens))  # a row each
    row = lambda task, i, o: F.struct(F.lit(task).alias("task"), F.col(i).cast("long").alias("tokens_in"), F.col(o).cast("long").alias("tokens_out"))
    both = both.withColumn("route_out", F.col("shards") * max_tokens)
    tokens = both.select(F.inline(F.array(*[row(t, f"{t}_in", f"{t}_out") for t in ("catalog", "route", "extract", "synthesize")])))
    return tokens.join(ledger.costs(tokens, prices), "task")


def _blocks(pairs: DataFrame, block: int) -> DataFrame:
    """pairs (pair, topic), a stated set of questions, in rows of about `block`."""
    n = max(1, -(-pairs.count() // block))
    return pairs.groupBy(F.pmod(F.xxhash64("pair"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("pair", "topic")).alias("pairs")).drop("block")


def routed_pairs(pairs: DataFrame, cards: DataFrame, least: int = 2, block: int = 64) -> DataFrame:
    """pair, rel_path: the cards (rel_path, terms) that the lexical router lets in for each question of pairs (pair, topic)."""
    let_in = F.filter("pairs", lambda p: F.size(F.array_intersect("terms", p["topic"])) >= least)
    return cards.select("rel_path", "terms").crossJoin(_blocks(pairs, block)).select("rel_path", F.explode(F.transform(let_in, lambda p: p["pair"])).alias("pair"))


def swept_pairs(pairs: DataFrame, sections: DataFrame, relevance: str = "recall", block: int = 64) -> DataFrame:
    """pair, rel_path: the files of which the lexical judge calls a section (rel_path, text) relevant to each question of pairs (pair, topic)."""
    least = reading.RELEVANCE[relevance]
    said = sections.select("rel_path", F.transform(T.sentences(F.col("text")), T.words).alias("said"))
    met = F.filter("pairs", lambda p: F.exists("said", lambda w: F.size(F.array_intersect(w, p["topic"])) >= least))
    return said.crossJoin(_blocks(pairs, block)).select("rel_path", F.explode(F.transform(met, lambda p: p["pair"])).alias("pair")).distinct()


def score_arms(pairs: DataFrame, expectations: DataFrame, **arms: DataFrame) -> DataFrame:
    """Scores of each arm's selection (pair, rel_path) against expectations (pair, rel_path, expected, forbidden): arm and the columns of
    ledger.score_routing(), a row for each pair and arm."""
    names = F.explode(F.array(*map(F.lit, arms)))
    no = F.lit(False)
    wanted = expectations.select(names.alias("arm"), "pair", "rel_path", "expected", "forbidden", no.alias("candidate"))
    for name, chosen in arms.items():
        wanted = wanted.unionByName(chosen.select(F.lit(name).alias("arm"), "pair", "rel_path", no.alias("expected"), no.alias("forbidden"), F.lit(True).alias("candidate")))
    one = wanted.groupBy("arm", "pair", "rel_path").agg(*[F.coalesce(F.bool_or(c), no).alias(c) for c in ("expected", "forbidden", "candidate")])
    key = F.struct("arm", "pair").alias("pair")
    scored = ledger.score_routing(pairs.select(names.alias("arm"), "pair").select(key), one.select(key, "rel_path", "expected", "forbidden", "candidate"))
    return scored.select("pair.arm", "pair.pair", *[c for c in scored.columns if c != "pair"])
