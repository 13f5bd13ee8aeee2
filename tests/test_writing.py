"""Answers: condensing in rounds, citations repaired once, fallbacks, and replies checked and asked for again, against plain walks."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import answers, writing

EVIDENCE = "answer_id string, number int, rel_path string, heading string, page int, claim string, quote string, cite string"


def evidence(counts):
    rows = []
    for answer, n in counts.items():
        for k in range(1, n + 1):
            path = f"f{k % 3}.md"
            rows.append((answer, k, path, f"H{k % 2}" if k % 4 else None, k % 5, f"claim number {k} of this" if k % 6 else " ", "quote " * (k % 7), f"[{path} § H{k % 2}]"))
    return rows


def line(e):
    return f"[{e[1]}]\n    claim: {e[5]}\n    quote: {e[6]}"


def tokens(text):
    return max(1, len(text) // 4)


def packed(units, most):
    out, used = [], 0
    for u in units:
        if not out or used + tokens(u[1]) > most:
            out.append([])
            used = 0
        out[-1].append(u)
        used += tokens(u[1])
    return out


def reduced(rows, most, condense, rounds=3):
    """The block and the rounds of one answer, walking."""
    block = "\n".join(map(line, rows))
    if tokens(block) <= most:
        return block, 0
    claims = lambda g: " ".join(f"{e[5].strip()} [{e[1]}]" for e, _ in g if e[5].strip())
    digests = [condense("\n".join(t for _, t in g)).strip() or claims(g) for g in packed([(e, line(e)) for e in rows], most)]
    merged, k = "\n\n".join(d for d in digests if d.strip()), 0
    while tokens(merged) > most and k < rounds:
        texts = ["\n\n".join(d for _, d in g if d.strip()) for g in packed(list(enumerate(digests)), most)]
        digests = [condense(t).strip() or t[: 4 * most] for t in texts]
        k, before, merged = k + 1, merged, "\n\n".join(d for d in digests if d.strip())
        if merged == before:
            break
    return merged, k + 1


def condenser(of):
    call = F.udf(of, "string")
    return lambda parts: parts.select("answer_id", "batch", call("text").alias("digest"))


halved = lambda text: " ".join(w for k, w in enumerate(text.split()) if k % 2 or re.match(r"\[\d+\]", w))  # noqa: E731  a lambda goes to Spark's workers by value


@pytest.mark.parametrize("of", [halved, lambda text: "", lambda text: text, lambda text: "" if "[3]" in text else f" {halved(text)} "], ids=["halves", "empty", "no progress", "some empty"])
@pytest.mark.parametrize("most", [40, 100])
def test_rounds_of_condensing_are_those_of_a_walk(spark, of, most):
    rows = evidence({"a": 1, "b": 5, "c": 40, "d": 90})
    got = writing.reduce_evidence(spark.createDataFrame(rows, EVIDENCE), most, condenser(of)).collect()
    assert {r.answer_id: (r.block, r.rounds) for r in got} == {a: reduced([e for e in rows if e[0] == a], most, of) for a in "abcd"}
    if of is halved:
        for r in got:
            assert set(re.findall(r"\[(\d+)\]", r.block)) == {str(e[1]) for e in rows if e[0] == r.answer_id}
        assert max(r.rounds for r in got) > 2 and all(tokens(r.block) <= most or r.rounds == 4 for r in got)


def test_no_evidence_needs_no_condensing(spark):
    assert writing.reduce_evidence(spark.createDataFrame([], EVIDENCE), 10, condenser(halved)).count() == 0


def test_answers_are_repaired_once_and_never_blank(spark):
    asked = {"good": 3, "mended": 4, "worse": 2, "blank": 5, "long": 60, "none": 0}
    rows, calls = evidence(asked), []

    def write(blocks, repair):
        calls.append((repair, {r.answer_id for r in blocks.collect()}))
        claim = F.lit("This sentence makes a claim without any mark.")
        first = F.when(F.col("answer_id") == "blank", F.lit(" \n")).when(F.col("answer_id") == "mended", claim).when(F.col("answer_id") == "worse", F.lit("It says a lot of things [7]."))
        again = F.when(F.col("answer_id") == "worse", F.lit("Even now it says things [1] and more of them [99]."))
        said = F.concat(F.lit("What the evidence says is here ["), F.array_join(writing.marks(F.col("block")), ", "), F.lit("]."))
        return blocks.select("answer_id", F.coalesce(again if repair else first, said).alias("text"))

    questions = spark.createDataFrame([(a, f"what of {a}?") for a in asked], "answer_id string, question string")
    table = spark.createDataFrame(rows, EVIDENCE)
    told = writing.write_answers(questions, table, write, writing.lexical_condenser, 120)
    got = {r.answer_id: r for r in told.collect()}
    assert calls == [(False, set(asked) - {"none"}), (True, {"mended", "worse"})]
    assert {a: (r.resolved, r.uncited, r.passes) for a, r in got.items()} == {"good": (3, 0, 1), "mended": (4, 0, 2), "worse": (1, 1, 2), "blank": (5, 0, 0), "long": (60, 0, 1), "none": (0, 0, 0)}
    assert got["worse"].text == "Even now it says things [f1.md § H1] and more of them [uncited]." and got["worse"].sources == "Sources:\n  f1.md — H1"
    assert got["none"].text == writing.NOTHING and got["none"].sources == "Sources: none" and got["long"].rounds > 0 and got["good"].rounds == 0
    assert got["blank"].text.count("\n- claim number") == 5 and got["good"].sources == "Sources:\n  f0.md — H1\n  f1.md — H1\n  f2.md — H0"
    must = spark.createDataFrame([("good", ["f1.md § H1", "f0.md"]), ("worse", ["f2.md"])], "answer_id string, must_cite array<string>")
    scores = {r.answer_id: (r.validity, r.must_cite_ok) for r in writing.score_answers(told, must).collect()}
    assert scores["good"] == (1.0, True) and scores["worse"] == (0.5, False) and scores["none"] == (1.0, True)


REPLY = {"file_hash": "h", "relevant": True, "confidence": 0.5, "reasoning": "r", "findings": [{"claim": "c", "quote": "q {[\"}"}, {"claim": "d", "quote": "p"}], "more": 1}
WHOLE = json.dumps(REPLY)
LESS = lambda *names, **to: json.dumps({k: v for k, v in (REPLY | to).items() if k not in names})
REPLIES = {
    "ok": (WHOLE, "stop", "ok", "", 2), "fenced": (f"```json\n{WHOLE}\n```", "stop", "ok", "", 2), "cut": (WHOLE[: WHOLE.index('"d"')], "length", "salvaged", "", 1),
    "early": (WHOLE[:20], "length", "truncated", "", None), "prose": ("I think so.", "stop", "not json", "", None), "empty": (" \n", "length", "empty", "", None), "null": (None, "stop", "empty", "", None),
    "no hash": (LESS("file_hash"), "stop", "missing field", "file_hash", None), "no relevant": (LESS("relevant", "confidence"), "stop", "missing field", "relevant", None),
    "no reasons": (LESS("reasoning", "findings"), "stop", "ok", "", 0), "sure": (LESS(confidence=1.5), "stop", "out of range", "confidence 1.5", None), "one": (LESS(confidence=1), "stop", "ok", "", 2),
    "no quote": (LESS(findings=[{"claim": "c"}]), "stop", "missing field", "findings.quote", None), "type": (LESS(confidence="high"), "stop", "not json", "", None), "list": ("[1]", "stop", "not json", "", None),
}


def test_each_failed_reply_has_a_status_and_a_reason(spark):
    rows = spark.createDataFrame([(k, *v[:2]) for k, v in REPLIES.items()], "id string, raw string, finish_reason string")
    got = {r.id: (r.status, r.reason, None if r.reply is None else len(r.reply.findings)) for r in answers.checked_replies(rows).collect()}
    assert got == {k: v[2:] for k, v in REPLIES.items()}


def test_failed_replies_are_asked_for_once_more(spark):
    first = spark.createDataFrame([(k, *v[:2]) for k, v in REPLIES.items()], "id string, raw string, finish_reason string")
    again = spark.createDataFrame([("early", WHOLE, "stop"), ("prose", "Still so.", "stop"), ("empty", WHOLE, "stop"), ("ok", "ignored", "stop"), ("sure", LESS(confidence=0.9), "stop")], first.schema)
    got = {r.id: (r.status, r.attempts, r.reply is not None) for r in answers.repaired_replies(first, again, "id").collect()}
    assert got["early"] == ("ok", 2, True) and got["prose"] == ("not json", 2, False) and got["sure"] == ("ok", 2, True)
    assert got["empty"] == ("empty", 1, False) and got["ok"] == ("ok", 1, True) and got["no hash"] == ("missing field", 1, False) and len(got) == len(REPLIES)


def test_evidence_is_found_once(spark):
    """Each step reads evidence as it was found the first time, however it is made."""
    met = spark.sparkContext.accumulator(0)

    def claim(n):
        met.add(1)
        return f"claim {n}"

    rows = spark.range(1, 41).select(
        F.lit("a").alias("answer_id"), F.col("id").cast("int").alias("number"), F.lit("f").alias("rel_path"), F.lit(None).cast("string").alias("heading"),
        F.lit(None).cast("int").alias("page"), F.udf(claim, "string")("id").alias("claim"), F.lit("q").alias("quote"), F.lit("[f]").alias("cite"),
    )
    questions = spark.createDataFrame([("a", "what?")], "answer_id string, question string")
    got = writing.write_answers(questions, rows, writing.lexical_writer, writing.lexical_condenser, 150).collect()
    assert [(r.answer_id, r.resolved) for r in got] == [("a", 40)] and met.value == 40
