"""Whole queries, estimates and arms on small tables, and the operators beneath them against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import asking, reading

TOPIC = ["alpha", "beta", "gamma"]
VERDICTS = "question_hash string, file_hash string, model string, relevant boolean, confidence double, reasoning string, findings array<struct<claim:string,quote:string>>"
TEXTS = {
    "a.md": "Alpha meets beta. Nothing here.", "b.md": "# One\nalpha only. ALPHA again!\n# Two\nbeta and gamma and alpha.",
    "c.md": "nothing at all", "d.md": None, "e.md": "", "f.md": "gamma, beta. " * 400,
}


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(p, f"hash-{p}", t) for p, t in TEXTS.items()], "rel_path string, file_hash string, markdown string")


@pytest.fixture
def cards(spark):
    rows = [("a.md", "hash-a.md", ["alpha", "beta"]), ("c.md", "hash-c.md", ["nothing"]), ("f.md", "hash-f.md", ["beta"])]
    return spark.createDataFrame(rows, "rel_path string, file_hash string, terms array<string>")


def asked(files, cards, stored, seen=None, **how):
    judge = asking.lexical_judge(TOPIC, how.pop("relevance", "balanced"))

    def watched(sections):
        if seen is not None:
            seen.append(sections)
        return judge(sections)

    return {r["rel_path"]: r for r in asking.ask(files, cards, stored, TOPIC, F.lit("q"), watched, **how).collect()}


def test_a_sweep_judges_every_file_and_routing_those_of_fitting_cards(spark, files, cards):
    none = spark.createDataFrame([], VERDICTS)
    got = asked(files, cards, none, mode="sweep")
    assert set(got) == set(TEXTS) and {r["reason"] for r in got.values()} == {"sweep"}
    assert {p for p, r in got.items() if r["relevant"]} == {"a.md", "b.md", "f.md"}
    assert [tuple(f) for f in got["a.md"]["findings"]] == [("alpha beta", "Alpha meets beta.")]
    assert len(got["f.md"]["findings"]) == 400 and got["a.md"]["confidence"] == pytest.approx(2 / 3)
    assert (got["d.md"]["relevant"], got["d.md"]["confidence"], got["d.md"]["findings"]) == (False, 0.0, [])
    # b has no card yet, so one is made: it holds alpha, beta and gamma
    assert set(asked(files, cards, none, mode="route")) == {"a.md", "b.md"}
    assert set(asked(files, cards, none, mode="auto", threshold=6)) == set(TEXTS)
    assert set(asked(files, cards, none, mode="auto", threshold=5)) == {"a.md", "b.md"}


def test_stored_verdicts_are_taken_and_not_judged_again(spark, files, cards):
    rows = [("q", "hash-a.md", "lexical", True, 0.5, "kept", []), ("other", "hash-b.md", "lexical", True, 0.5, "kept", []), ("q", "hash-c.md", "another", True, 0.5, "kept", [])]
    stored, seen = spark.createDataFrame(rows, VERDICTS), []
    got = asked(files, cards, stored, seen, mode="sweep")
    assert {p for p, r in got.items() if r["cached"]} == {"a.md"} and got["a.md"]["reasoning"] == "kept"
    assert {r["rel_path"] for r in seen[0].select("rel_path").distinct().collect()} == set(TEXTS) - {"a.md"}
    assert not any(r["cached"] for r in asked(files, cards, stored, mode="sweep", use_cache=False).values())


def test_what_was_judged_can_be_stored_and_asked_again(spark, files, cards):
    none = spark.createDataFrame([], VERDICTS)
    first = asking.ask(files, cards, none, TOPIC, F.lit("q"), asking.lexical_judge(TOPIC), mode="sweep")
    stored = none.unionByName(asking.to_store(first, F.lit("q")))
    again = asking.ask(files, cards, stored, TOPIC, F.lit("q"), asking.lexical_judge(TOPIC), mode="sweep")
    key = lambda df: sorted((r["rel_path"], r["relevant"], r["confidence"], len(r["findings"])) for r in df.collect())
    assert key(again) == key(first) and again.where("not cached").count() == 0 and asking.to_store(again, F.lit("q")).count() == 0
    assert tuple(asking.report(again).first()) == (6, 6, 3, 404, 0)


def test_no_files_no_verdicts(spark, files, cards):
    none = spark.createDataFrame([], VERDICTS)
    for mode in ("sweep", "route", "auto"):
        assert asked(files.limit(0), cards.limit(0), none, mode=mode) == {}
    assert tuple(asking.report(asking.ask(files.limit(0), cards, none, TOPIC, F.lit("q"), asking.lexical_judge(TOPIC))).first()) == (0, 0, 0, 0, 0)


def test_arms_score_what_they_select(spark, files):
    pairs = spark.createDataFrame([("x", ["alpha", "beta"]), ("y", ["zeta", "theta"])], "pair string, topic array<string>")
    wants = spark.createDataFrame([("x", "a.md", True, False), ("x", "c.md", True, False), ("x", "b.md", False, True)], "pair string, rel_path string, expected boolean, forbidden boolean")
    swept = asking.swept_pairs(pairs, reading.plan_sections(files.na.fill("")), "balanced")
    routed = asking.routed_pairs(pairs, reading.lexical_cards(files))
    rows = {(r["arm"], r["pair"]): r for r in asking.score_arms(pairs, wants, route=routed, sweep=swept).collect()}
    assert set(rows) == {(arm, pair) for arm in ("route", "sweep") for pair in "xy"}
    assert (rows["sweep", "x"]["recall"], rows["sweep", "x"]["precision"], rows["sweep", "x"]["forbidden"]) == (0.5, 0.5, 1)
    assert (rows["route", "y"]["recall"], rows["route", "y"]["precision"], rows["route", "y"]["stray"]) == (1.0, 1.0, 0)


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_evidence_is_numbered_without_gaps(spark, buckets):
    rows = [(f"f{random.Random(k).randrange(40)}.md", k) for k in range(300)]
    got = reading.number_evidence(spark.createDataFrame(rows, "rel_path string, seq int"), buckets).collect()
    assert [(r["rel_path"], r["seq"]) for r in sorted(got, key=lambda r: r["number"])] == sorted(rows)
    assert sorted(r["number"] for r in got) == list(range(1, 301))
    assert reading.number_evidence(spark.createDataFrame([], "rel_path string, seq int"), buckets).count() == 0


def _headings(text):
    at = 0
    for line in text.split("\n"):
        if m := re.match(r"^ {0,3}(#{1,6})[ \t]+(.*)$", line):
            yield at, len(m[1]), m[2].strip(" ")
        at += len(line) + 1


def _sections(text, most):
    parts = [text]
    for level in range(1, 7):
        finer = []
        for t in parts:
            cut = [p for p in re.split(rf"(?m)^(?=#{{{level}}}\s)", t) if p.strip()]
            finer += cut if len(t) > most and len(cut) > 1 else [t]
        parts = finer
    return [t[k : k + most] for t in parts for k in range(0, max(1, len(t)), most)]


def test_headings_and_sections_agree_with_a_walk_over_lines(spark):
    draw = random.Random(5)
    line = lambda: draw.choice(["", "# A", "## B b", "  ### C", "#tag", "    # code", "####### no", "words and words", "é — ü", "#\tTab"])
    texts = {f"{k}": "\n".join(line() for _ in range(draw.randrange(40))) for k in range(40)}
    files = spark.createDataFrame(list(texts.items()), "rel_path string, markdown string")
    heads = sorted((r["rel_path"], r["start"], r["level"], r["title"]) for r in reading.headings(files).collect())
    assert heads == sorted((p, *h) for p, t in texts.items() for h in _headings(t))
    parts = sorted((r["rel_path"], r["section"], r["text"]) for r in reading.split_sections(files, 30).collect())
    assert parts == sorted((p, k, s) for p, t in texts.items() for k, s in enumerate(_sections(t, 30)))
