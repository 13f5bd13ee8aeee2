"""Column functions on text: words, sentences, tokens, headings, pages, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CUT = "\x01"


def words(text: Column) -> Column:
    """Distinct runs of four or more of a-z, in lower case, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0)))


def sentences(text: Column) -> Column:
    """Parts after `.`, `!` or `?` and white space; empty ones left out."""
    parts = F.split(F.regexp_replace(text, r"([.!?])[ \t\r\n\f]+", "$1" + CUT), CUT)
    return F.filter(parts, lambda s: s != "")


def tokens(text: Column) -> Column:
    """A fourth of the characters, 1 at least."""
    return F.greatest(F.lit(1).cast("long"), F.floor(F.char_length(text) / 4))


def page_at(marks: Column, offset: Column) -> Column:
    """The page of the last mark at or before offset; null if there is none."""
    return F.try_element_at(F.filter(marks, lambda m: m["offset"] <= offset), F.lit(-1))["page"]


def question_key(question: Column, definition: Column, relevance: Column) -> Column:
    zero = F.lit("\x00")
    return F.sha2(F.concat(question, zero, F.coalesce(definition, F.lit("")), zero, relevance).cast("binary"), 256)


def claim_like(sentence: Column) -> Column:
    """Has a letter and at least four words."""
    return sentence.rlike(r"\p{L}") & (F.size(F.filter(F.split(sentence, r"[ \t\r\n\f]+"), lambda w: w != "")) >= 4)


def cite(path: Column, heading: Column, page: Column, verified: Column) -> Column:
    """[path § heading, p.N (unverified)]; a heading that is the file's name or stem is left out, and page 0."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    shown = F.when(heading.isNotNull() & (heading != "") & (F.lower(heading) != name) & (F.lower(heading) != stem), F.concat(F.lit(" § "), heading))
    paged = F.when(page > 0, F.concat(F.lit(", p."), page.cast("string")))
    return F.concat(F.lit("["), path, F.coalesce(shown, F.lit("")), F.coalesce(paged, F.lit("")), F.when(verified, "").otherwise(" (unverified)"), F.lit("]"))
