"""Where quotes stand in a text, in spite of typography, line breaks, ellipses and a few wrong words at the ends."""

from __future__ import annotations

import re
import unicodedata
from functools import cache, cached_property

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# Characters folded together, characters left out, those stripped around a quote, ellipses, the least length of a fragment among several, the
# least length of a trimmed quote, and the most words trimmed from an end.
FOLDED = {
    "\u2018": "'", "\u2019": "'", "\u201a": "'", "\u201b": "'", "\u201c": '"', "\u201d": '"', "\u201e": '"', "\u201f": '"',
    "\u2013": "-", "\u2014": "-", "\u2015": "-", "\u2212": "-",
}
LEFT_OUT = "*_`\u00ad"
AROUND = "\"' "
ELLIPSIS = re.compile(r"\s*(?:\.\s*\.\s*\.+|…)\s*")
LEAST_FRAGMENT, LEAST_RUN, MOST_TRIMMED = 12, 40, 3

SPAN = StructType().add("start", IntegerType()).add("end", IntegerType())
#: A word broken at the end of a line.
BROKEN = re.compile(r"-\s+(?=[^\W\d_])")


@cache
def _plain(char: str) -> str:
    """A character without accents, case and typography; empty if it is left out."""
    parts = (FOLDED.get(c, c) for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
    return "".join(" " if c.isspace() else c.casefold() for c in parts if c not in LEFT_OUT)


class _Plain(dict):
    """Code points to plain characters, filled as they are met."""

    def __missing__(self, point: int) -> str:
        self[point] = _plain(chr(point))
        return self[point]


PLAIN = _Plain()


def fold(text: str) -> tuple[str, np.ndarray]:
    """The text in plain characters with single spaces, and the place in the text that each comes from."""
    gone = np.zeros(len(text), bool)
    for m in BROKEN.finditer(text):
        gone[m.start() : m.end()] = True
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = {p: len(PLAIN[p]) for p in np.unique(points).tolist()}
    kinds, where = np.unique(points, return_inverse=True)
    wide = np.where(gone, 0, np.array([sizes[p] for p in kinds.tolist()] or [0], np.int64)[where] if len(points) else 0)
    flat = "".join(c for c, g in zip(text, gone.tolist(), strict=True) if not g).translate(PLAIN) if gone.any() else text.translate(PLAIN)
    origin = np.repeat(np.arange(len(text)), wide)
    flat_points = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    solid = flat_points != 32
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    at = np.flatnonzero(keep)
    if len(at) and not solid[at[-1]]:
        at = at[:-1]
    return flat_points[at].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), origin[at]


class _Text:
    """A text that fold() made `flat` and `origin` of; without its source, only what is folded counts."""

    def __init__(self, flat: str, origin: np.ndarray, source: str | None = None) -> None:
        self.flat, self.origin, self.source = flat, origin, source

    @cached_property
    def before(self) -> np.ndarray:
        """How many characters stand before each place of the source, without repeated white space and breaks of words."""
        gone = np.array([c.isspace() for c in self.source], bool)
        gone[1:] &= gone[:-1].copy()
        gone[:1] = False
        for m in BROKEN.finditer(self.source):
            gone[m.start() : m.end()] = True
        return np.concatenate([[0], np.cumsum(~gone)])

    @cached_property
    def spare(self) -> int:
        """How many characters of the source are left out when folded, at most the difference that they make to a run."""
        return int(self.before[-1]) - len(np.unique(self.origin))

    def span(self, at: int, end: int, quote: str, first: int | None = None, last: int | None = None) -> tuple[int, int]:
        """Where flat[at:end] stands in the source. What folds to nothing at an end, or is stripped, such as marks of emphasis, belongs to it
        where the quote has the same: before its place `first`, and from its place `last` on."""
        a, b = int(self.origin[at]), int(self.origin[end - 1]) + 1
        while self.source is not None and first and a and _edge(quote[first - 1]) and quote[first - 1] == self.source[a - 1]:
            first, a = first - 1, a - 1
        while self.source is not None and last is not None and last < len(quote) and b < len(self.source) and _edge(quote[last]) and quote[last] == self.source[b]:
            last, b = last + 1, b + 1
        return a, b

    def long(self, at: int, end: int, span: tuple[int, int]) -> bool:
        """Whether a run has LEAST_RUN characters as it stands in the source, white space counting once and broken words as whole ones."""
        return (end - at if self.source is None else self.before[span[1]] - self.before[span[0]]) >= LEAST_RUN

    def places(self, run: str):
        """Where a run stands, if it can be long enough."""
        at = -1 if len(run) + (0 if self.source is None else self.spare) < LEAST_RUN else self.flat.find(run)
        while at >= 0:
            yield at
            at = self.flat.find(run, at + 1)


def _edge(char: str) -> bool:
    return not char.isalnum() and not char.isspace()


def _longest_run(text: _Text, words: list[str], quote: str, marks: np.ndarray) -> tuple[int, int] | None:
    """The first place of the longest run of words in text that leaves out at most MOST_TRIMMED at each end and has LEAST_RUN
    characters there; of equally long runs (in words) the one that starts earliest. marks: the places of the joined words' characters in the quote.

    Every such run holds the words in the middle, so text is searched for these alone, and a run is grown from each place.
    """
    n, trim, flat = len(words), MOST_TRIMMED, text.flat
    starts = np.cumsum([0, *[len(w) + 1 for w in words]])
    best: tuple[int, int, int] | None = None  # words left out, words left out before, place
    middle = " ".join(words[trim : n - trim])
    heads = [" ".join(words[k:trim]) for k in range(trim + 1)]
    tails = [" ".join(words[n - trim : n - k]) for k in range(trim + 1)]

    def found(at: int, i: int, j: int) -> tuple[int, int] | None:
        """The span of words[i:j] at a place, if it is long enough there."""
        end = at + int(starts[j] - 1 - starts[i])
        span = text.span(at, end, quote, int(marks[starts[i]]), int(marks[starts[j] - 2]) + 1)
        return span if text.long(at, end, span) else None

    if not middle:  # short quotes: few runs are long enough
        runs = {(n - (j - i), i, j) for i in range(min(n, trim + 1)) for j in range(max(i + 1, n - trim), n + 1)}
        for _, i, j in sorted(runs):
            for at in text.places(" ".join(words[i:j])):
                if span := found(at, i, j):
                    return span
        return None
    at, end = flat.find(middle), None
    while at >= 0:
        for i, head in enumerate(heads):
            before = f"{head} " if head else ""
            if not flat.startswith(before, at - len(before)) or at < len(before):
                continue
            for j, tail in enumerate(tails):
                after = f" {tail}" if tail else ""
                if flat.startswith(after, at + len(middle)) and (best is None or (i + j, i, at - len(before)) < best):
                    if span := found(at - len(before), i, n - j):
                        best, end = (i + j, i, at - len(before)), span
        at = flat.find(middle, at + 1)
    return end


def spans(text: str, origin: np.ndarray, quote: str, source: str | None = None) -> list[tuple[int, int]]:
    """Spans (start, end) of a quote in the source that fold() made text and origin of. Fragments between ellipses that are long enough
    must follow each other as they are, unless the quote stands there with its ellipses; if fewer than two are, the longest counts alone, and some words at its ends
    may be missing. With the source, spans take in what the quote has at its ends beyond the words, and runs of words are measured as they stand there."""
    return _spans(_Text(text, origin, source), quote)


def _core(quote: str, at: int, end: int) -> tuple[str, np.ndarray]:
    """A part of a quote, folded, without quotation marks around it, and the places of its characters in the quote."""
    flat, places = fold(quote[at:end])
    core = flat.lstrip(AROUND)
    lead = len(flat) - len(core)
    core = core.rstrip(AROUND)
    return core, places[lead : lead + len(core)] + at


def _spans(text: _Text, quote: str) -> list[tuple[int, int]]:
    cuts = [0, *[k for m in ELLIPSIS.finditer(quote) for k in m.span()], len(quote)]
    parts = [p for p in (_core(quote, a, b) for a, b in zip(cuts[::2], cuts[1::2], strict=True)) if p[0]]
    if parts and len(cuts) > 2 and (whole := _core(quote, 0, len(quote)))[0] in text.flat:
        parts = [whole]
    chain = [p for p in parts if len(p[0]) >= LEAST_FRAGMENT]
    if len(chain) < 2:
        chain = sorted(parts, key=lambda p: len(p[0]), reverse=True)[:1]
    found, at = [], 0
    for k, (f, marks) in enumerate(chain):
        at = text.flat.find(f, at)
        if at < 0:
            one = _longest_run(text, f.split(" "), quote, marks) if len(chain) == 1 and f.count(" ") >= 3 else None
            return [one] if one else []
        found.append(text.span(at, at + len(f), quote, None if k else int(marks[0]), int(marks[-1]) + 1 if k == len(chain) - 1 else None))
        at += len(f)
    return found


@F.pandas_udf(ArrayType(ArrayType(SPAN)))
def spans_of(texts: pd.Series, quotes: pd.Series) -> pd.Series:
    """For each text, the spans of each of its quotes; each text is folded once."""
    out = []
    for text, asked in zip(texts, quotes, strict=True):
        whole = _Text(*fold(text or ""), text or "")
        out.append([[{"start": a, "end": b} for a, b in _spans(whole, q or "")] for q in asked])
    return pd.Series(out)


@F.pandas_udf(StringType())
def folded(texts: pd.Series) -> pd.Series:
    """Texts in plain characters, as fold() gives them."""
    return texts.map(lambda t: None if t is None else fold(t)[0])
