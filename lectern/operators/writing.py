"""Answers written from evidence: condensed until it fits, written, its citations repaired once, or put together from the findings alone.

The writer and the condenser are seams, as the judge is: functions of DataFrames that a model can stand behind. What they give is written to
the shared folder before it is used, so that no call is made twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import answers, reading
from lectern.sources.shared import written

#: Parts (answer_id, batch, text) to (answer_id, batch, digest), which keeps every mark [n]; an empty digest counts as a failure.
Condenser = Callable[[DataFrame], DataFrame]
#: (answer_id, question, block), and whether this is the repair of citations, to (answer_id, text).
Writer = Callable[[DataFrame, bool], DataFrame]

#: What the prompt and the reply take of a window, the least that is left, and the rounds of condensing digests.
OVERHEAD, LEAST, ROUNDS = 3000, 2000, 3
#: The layout of an answer's sources.
SOURCES, SOURCE = "Sources:", "  %s — %s"
NOTHING = "Nothing in the files speaks to this question: no finding passed."
MARKS = r"\[(\d+)\]"


def budget(window: int = 32768, max_tokens: int = 1024) -> int:
    """Tokens of evidence that a writer's window holds."""
    return max(window - OVERHEAD - max_tokens, LEAST)


def _joined(order: str, text: str, between: str) -> Column:
    return F.array_join(F.sort_array(F.collect_list(F.when(F.col(text).rlike(r"\S"), F.struct(order, F.col(text).alias("v")))))["v"], between)


def reduce_evidence(evidence: DataFrame, most: int, condense: Condenser, rounds: int = ROUNDS) -> DataFrame:
    """answer_id, block, rounds: the evidence (answer_id, number, claim, quote) of each answer as one text, in at most `most` tokens if condensing gets there.

    Evidence that fits stays as it is, after 0 rounds. The rest is packed in its order into batches of at most `most` tokens, whatever files it comes
    from, and each batch is condensed; an empty digest is replaced by the batch's claims with their numbers. Digests that are still too long
    together are packed and condensed again, up to `rounds` times or until nothing changes; an empty one is then replaced by as much of its text as
    fits. A round is done for all answers that need it at once, and packs and joins the texts of an answer, no more.
    """
    size = T.tokens(F.col("block"))
    whole = answers.evidence_block(evidence)
    done = whole.where(size <= most).select("answer_id", "block", F.lit(0).alias("rounds"))
    large = evidence.join(whole.where(size > most).select("answer_id"), "answer_id", "left_semi")
    line = answers.evidence_line(F.col("number"), F.col("claim"), F.col("quote"))
    packed = reading.batches(large.select("answer_id", "number", T.tokens(line).alias("tokens")), "answer_id", ["number"], most).select("answer_id", "number", "batch")
    parts = large.join(packed, ["answer_id", "number"]).select(F.struct("answer_id", "batch").alias("answer_id"), "number", "claim", "quote")
    texts = answers.evidence_block(parts).join(answers.claims_digest(parts), "answer_id").select("answer_id.*", F.col("block").alias("text"), F.col("digest").alias("instead"))
    none: DataFrame | None = None
    for k in range(rounds + 1):
        texts = written(texts, "parts")
        told = condense(texts.select("answer_id", "batch", "text")).select("answer_id", "batch", F.regexp_replace("digest", r"^\s+|\s+$", "").alias("digest"))
        digests = texts.join(told, ["answer_id", "batch"], "left").select("answer_id", "batch", F.coalesce(F.nullif("digest", F.lit("")), "instead").alias("digest"))
        digests = written(digests, "digests")
        merged = digests.groupBy("answer_id").agg(_joined("batch", "digest", "\n\n").alias("block"))
        if none is not None:
            merged = merged.join(none, "answer_id").withColumn("stuck", F.col("block") == F.col("before")).drop("before")
        else:
            merged = merged.withColumn("stuck", F.lit(False))
        merged = written(merged, "merged")
        ends = (size <= most) | F.col("stuck") | F.lit(k == rounds)
        done = done.unionByName(merged.where(ends).select("answer_id", "block", F.lit(k + 1).alias("rounds")))
        none = merged.where(~ends).select("answer_id", F.col("block").alias("before"))
        if none.isEmpty():
            break
        digests = digests.join(none.select("answer_id"), "answer_id", "left_semi")
        packed = reading.batches(digests.select("answer_id", F.col("batch").alias("k"), T.tokens(F.col("digest")).alias("tokens")), "answer_id", ["k"], most)
        packed = packed.select("answer_id", F.col("k").alias("batch"), F.col("batch").alias("into"))
        texts = digests.join(packed, ["answer_id", "batch"]).groupBy("answer_id", "into").agg(_joined("batch", "digest", "\n\n").alias("text"))
        texts = texts.select("answer_id", F.col("into").alias("batch"), "text", F.substring("text", 1, 4 * most).alias("instead"))
    return done


def sources_block(used: DataFrame) -> DataFrame:
    """answer_id, sources: of used evidence (answer_id, rel_path, heading, page), a line for each file with its places."""
    keyed = used.select(F.struct("answer_id", "rel_path").alias("of"), "rel_path", "heading", "page")
    lines = answers.sources(keyed, ["of", "rel_path"]).select("of.answer_id", "rel_path", F.format_string(SOURCE, "rel_path", "sections").alias("line"))
    return lines.groupBy("answer_id").agg(F.concat(F.lit(SOURCES + "\n"), F.array_join(F.sort_array(F.collect_list(F.struct("rel_path", "line")))["line"], "\n")).alias("sources"))


def write_answers(questions: DataFrame, evidence: DataFrame, write: Writer, condense: Condenser, most: int | None = None) -> DataFrame:
    """One row for each of questions (answer_id, question): answer_id, text, sources, resolved, uncited, bad, passes, rounds.

    evidence (answer_id, number, rel_path, heading, page, claim, quote, cite) is numbered in each answer. It is condensed to `most` tokens,
    an answer is written, and its marks are resolved. Answers with a mark that can't be resolved, or a claim without one, are written once more, and that
    counts, whatever it is: only they meet the writer again. A blank answer is replaced by the findings themselves, with their sources
    (passes is 0 then); a question without evidence gets a sentence that says so, and no sources.
    """
    most = budget() if most is None else most
    evidence = written(evidence, "evidence")  # read in each step below, and found once
    cites = evidence.select("answer_id", "number", "cite")
    blocks = written(questions.join(reduce_evidence(evidence, most, condense), "answer_id"), "blocks")

    def told(rows: DataFrame, repair: bool) -> DataFrame:
        texts = written(write(rows.select("answer_id", "question", "block"), repair).select("answer_id", "text"), "answers")
        got = answers.resolve(texts, cites.join(texts.select("answer_id"), "answer_id", "left_semi"))
        return written(got.withColumn("passes", F.lit(2 if repair else 1)), "resolved")

    first = told(blocks, False)
    second = told(blocks.join(first.where("uncited > 0").select("answer_id"), "answer_id", "left_semi"), True)
    both = first.join(second.select("answer_id"), "answer_id", "left_anti").unionByName(second)
    blank = blocks.select("answer_id").join(both.where(F.col("text").rlike(r"\S")).select("answer_id"), "answer_id", "left_anti")
    instead = answers.fallback_digest(evidence.join(blank, "answer_id", "left_semi")).withColumn("resolved", F.size("used").cast("long"))
    instead = instead.withColumns({"uncited": F.lit(0).cast("long"), "bad": F.array().cast("array<string>"), "passes": F.lit(0)}).select(both.columns)
    every = written(both.join(blank, "answer_id", "left_anti").unionByName(instead), "told")
    numbers = every.select("answer_id", F.explode("used").alias("number")).distinct()
    listed = sources_block(evidence.join(numbers, ["answer_id", "number"], "left_semi"))
    rows = questions.select("answer_id").join(every, "answer_id", "left").join(listed, "answer_id", "left").join(blocks.select("answer_id", "rounds"), "answer_id", "left")
    return rows.select(
        "answer_id", F.coalesce("text", F.lit(NOTHING)).alias("text"), F.coalesce("sources", F.lit(f"{SOURCES} none")).alias("sources"),
        F.coalesce("resolved", F.lit(0)).cast("long").alias("resolved"), F.coalesce("uncited", F.lit(0)).cast("long").alias("uncited"),
        F.coalesce("bad", F.array().cast("array<string>")).alias("bad"), F.coalesce("passes", F.lit(0)).alias("passes"), F.coalesce("rounds", F.lit(0)).alias("rounds"),
    )


def score_answers(told: DataFrame, must_cite: DataFrame) -> DataFrame:
    """answer_id, validity, must_cite_ok of write_answers()'s rows: the share of resolved citations among all, as the resolver counted them, or as shown if it
    counted none; and whether every string of must_cite (answer_id, must_cite array) is in the text or its sources."""
    asked = written(told.join(must_cite, "answer_id", "left").withColumn("must_cite", F.coalesce("must_cite", F.array().cast("array<string>"))), "asked")
    shown = answers.score_citations(asked)
    counted = F.col("resolved") + F.col("uncited")
    return asked.select("answer_id", "resolved", "uncited").join(shown, "answer_id").select(
        "answer_id", F.when(counted > 0, F.col("resolved") / counted).otherwise(F.col("validity")).alias("validity"), "must_cite_ok"
    )


def marks(text: Column) -> Column:
    """The numbers of a text's marks, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(MARKS), F.lit(1)))


def lexical_condenser(parts: DataFrame) -> DataFrame:
    """A condenser that keeps the numbers alone."""
    return parts.select("answer_id", "batch", F.array_join(F.transform(marks(F.col("text")), lambda n: F.concat(F.lit("["), n, F.lit("]"))), " ").alias("digest"))


def lexical_writer(blocks: DataFrame, repair: bool) -> DataFrame:
    """A writer that says of each number of the evidence that it speaks to the question."""
    said = F.transform(marks(F.col("block")), lambda n: F.concat(F.lit("One finding speaks to this ["), n, F.lit("].")))
    return blocks.select("answer_id", F.array_join(said, " ").alias("text"))
