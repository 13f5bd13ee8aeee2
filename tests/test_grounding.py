"""Quotes found in spite of typography, and given back as they stand in their file."""

import random

import pytest

from lectern.functions.grounding import _plain, fold, spans
from lectern.operators import reading

SOURCE = "The “Ｑuick” brown­ fox re-\n mains *calm* while the naïve dog, who had slept all day, finally wakes up to look at the moon."


@pytest.mark.parametrize(
    ("quote", "found"),
    [
        ('the "quick" BROWN fox', "The “Ｑuick” brown­ fox"),
        ("fox remains calm", "fox re-\n mains *calm"),
        ("naive dog", "naïve dog"),
        ("Well, naive dog, who had slept all day, finally wakes up", "naïve dog, who had slept all day, finally wakes up"),
        ("a lazy dog that slept for the whole of the day and woke", None),
        ("", None), ("...", None), ("q", "Ｑ"),
    ],
)
def test_one_span(quote, found):
    got = spans(*fold(SOURCE), quote)
    assert [SOURCE[a:b] for a, b in got] == ([] if found is None else [found])


def test_ellipses_need_order_and_length():
    pair = [SOURCE[a:b] for a, b in spans(*fold(SOURCE), "the naive dog ... wakes up to look")]
    assert pair == ["the naïve dog", "wakes up to look"]
    assert spans(*fold(SOURCE), "wakes up to look … the naive dog") == []
    assert [SOURCE[a:b] for a, b in spans(*fold(SOURCE), "ox ... who had slept")] == ["who had slept"]


def test_folding_keeps_places():
    draw = random.Random(5)
    for _ in range(200):
        text = "".join(draw.choice("aÉß ﬁ\n\t-*_“”­ 😀.z") for _ in range(draw.randrange(40)))
        folded, origin = fold(text)
        assert len(folded) == len(origin) and list(origin) == sorted(origin)
        assert folded == folded.strip() and "  " not in folded
        assert all(char in _plain(text[k]) for char, k in zip(folded, origin, strict=True))


def test_findings_are_snapped(spark):
    files = spark.createDataFrame([("a", SOURCE), ("b", "")], "rel_path string, markdown string")
    rows = [("a", 0, "THE NAIVE DOG"), ("a", 1, "nothing of this"), ("a", 2, None), ("b", 0, "x"), ("c", 0, "no file"), ("a", 3, "brown fox remains … finally wakes up")]
    got = {(r.rel_path, r.seq): (r.verified, r.offset, r.quote) for r in reading.ground(spark.createDataFrame(rows, "rel_path string, seq int, quote string"), files, 2).collect()}
    at = SOURCE.index("the naïve")
    assert got == {
        ("a", 0): (True, at, "the naïve dog"), ("a", 1): (False, None, "nothing of this"), ("a", 2): (False, None, None),
        ("b", 0): (False, None, "x"), ("a", 3): (True, SOURCE.index("brown"), "brown­ fox re-\n mains … finally wakes up"),
    }


@pytest.mark.parametrize(
    ("quote", "found"),
    [
        ("*CALM* WHILE THE NAÏVE DOG", "*calm* while the naïve dog"), ("calm while", "calm* while"), ("AND SO ON... AND THE END.***", "and so on... and the end.***"),
        ("so on", "so on"), ("zzq **Bold** words at the start of this run, to its end.***", "**Bold** words at the start of this run, to its end.***"),
    ],
)
def test_a_span_takes_in_what_the_quote_has_at_its_ends(quote, found):
    source = f"{SOURCE} **Bold** words at the start of this run, to its end.*** And so on... and the end.***"
    assert [source[a:b].lower() for a, b in spans(*fold(source), quote, source)] == [found.lower()]


@pytest.mark.parametrize(("text", "verified"), [("Chkeitsch einß, schiechbe der chstbege.", False), ("Chkeitsch einß, schiechbe der chstbegen.", True), ("Eins*** zwei, dreivier und fünfsechs sieb***", True)])
def test_a_trimmed_run_is_measured_as_it_stands_in_its_file(spark, text, verified):
    files = spark.createDataFrame([("a", f"# T\n{text}\n")], "rel_path string, markdown string")
    rows = spark.createDataFrame([("a", 0, f"Zzq {text.upper()}")], "rel_path string, seq int, quote string")
    assert [(r.verified, r.quote == text) for r in reading.ground(rows, files).collect()] == [(verified, verified)]
