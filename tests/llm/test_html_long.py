"""Pages of bad markup are read in time proportional to their length, and plain footers go."""

import time

import pytest

from lectern.llm import html_text

N = 5_000_000
PAGES = {
    "tags without an end": '<a "' * (N // 4),
    "declarations without an end": "<!x " * (N // 4),
    "open blocks and stray ends": "<div>" * (N // 10) + "</q>" * (N // 8),
    "raw ends without an end": "<script>" + "</script " * (N // 9),
    "open comments": "<!-- " * (N // 5),
    "quotes of both kinds": "<a \"'>" * (N // 6),
    "cells beneath an open table": "<table><tr><td><table>" + "<b>" * (N // 6) + "<td></td>" * (N // 18),
    "items beneath inline elements": "<b>" * (N // 6) + "<li></li>" * (N // 18),
    "open attributes": '<p id="' * (N // 7) + ">",
}


@pytest.mark.parametrize("kind", PAGES)
def test_long_bad_markup_takes_seconds(kind):
    trees = html_text.model()

    def took(page):
        start = time.process_time()
        html_text.main_texts([page], trees)
        return time.process_time() - start

    bad = took(PAGES[kind])
    assert bad < 10 or bad < 2 * took("<div><p>word</p></div>" * (N // 22))  # the latter on a slow machine


def test_tags_end_outside_of_quotes():
    text = lambda page: html_text.render(nodes := html_text.parse(page), [True] * len(nodes))
    assert text("<p class='a>b' id=\"c>d\">one</p>") == "one"
    assert text("<p class='a>one</p><p id=it's>two") == "two"  # the quote is closed in the second tag
    assert text("1 < 2 <a \"b and more") == "1 < 2 <a \"b and more"
    assert text("a</b \"c> d</e>f") == "a df"
    assert text("a<!-- b -- > c") == "a" and text("a<!-- b --> c <!x> d<?php e ?>f") == "a c df"


def test_plain_footers_without_hints_are_dropped():
    words = lambda n: " ".join(f"word{k}" for k in range(n))
    page = f"<html><body><div><a href=/>Home</a> <a href=/x>About</a></div><div><h1>A title</h1><p>{words(60)}</p><p>{words(90)}</p></div><div>Copyright 2020 Some Company. All rights reserved.</div></body></html>"
    assert html_text.main_texts([page], html_text.model()) == [f"A title\n{words(60)}\n{words(90)}"]


def test_slices_are_bounded_by_pages_and_characters(monkeypatch):
    monkeypatch.setattr(html_text, "CHARS_AT_A_TIME", 5)
    assert list(html_text._slices(["aa", None, "bb", "cc", "d" * 9])) == [(0, 3), (3, 4), (4, 5)]
    assert list(html_text._slices([])) == [(0, 0)] and list(html_text._slices(["a"] * 3)) == [(0, 3)]
