"""Fill-in-the-middle: a table-driven byte automaton counts units and finds sentinels, and a second pass of it locates the cuts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sentinels of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of a lane, and of the texts that a task holds as lanes at a time; a longer text is taken by itself.
LANE, AT_A_TIME = 128, 4 << 20

# Classes of bytes: others of ASCII, letters, the letters of sentinels, <, >, first bytes of longer characters, continuations, and none.
OTHER, LETTER, NAME, OPEN, CLOSE, LEAD, MORE, NONE = range(8)
# States: after a non-letter, within letters, after <, and after < and the letter of a sentinel.
OUT, WORD, OPENED, NAMED = range(4)
#: What a transition emits, as counts in one number: a unit's start, a character's, a sentinel's end.
UNIT, CHAR, SENTINEL = 1, 1 << 20, 1 << 40


def _classes() -> np.ndarray:
    out = np.full(257, OTHER, np.uint8)
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz":
        out[c] = LETTER
    for mark in (PREFIX, SUFFIX, MIDDLE):
        out[ord(mark[1])] = NAME
    out[ord("<")], out[ord(">")], out[0x80:0xC0], out[0xC0:256], out[256] = OPEN, CLOSE, MORE, LEAD, NONE
    return out


def _table() -> tuple[np.ndarray, np.ndarray]:
    """The next state and what is emitted, by state x 8 + class."""
    after, emits = np.zeros((4, 8), np.uint8), np.full((4, 8), UNIT + CHAR, np.int64)
    for state in range(4):
        inside = state in (WORD, NAMED)
        after[state] = [OUT, WORD, NAMED if state == OPENED else WORD, OPENED, OUT, OUT, OUT, state]
        emits[state, [LETTER, NAME]] = CHAR if inside else UNIT + CHAR  # a letter begins a unit only outside a run of letters
        emits[state, [MORE, NONE]] = 0
    emits[NAMED, CLOSE] += SENTINEL
    return after.ravel(), emits.ravel()


CLASS_OF, (AFTER, EMITS) = _classes(), _table()


class Lanes:
    """Texts cut into lanes of LANE bytes, through which the automaton runs side by side.

    Its state depends on the last two bytes alone, so a lane that continues a text begins two bytes early, without counting.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.lanes = -(-sizes // LANE)
        self.first = np.cumsum(self.lanes) - self.lanes
        starts = np.cumsum(sizes) - sizes
        self.text = np.repeat(np.arange(len(texts)), self.lanes)
        self.within = (np.arange(len(self.text)) - self.first[self.text]) * LANE
        begin, end = starts[self.text] + self.within, (starts + sizes)[self.text]
        data = np.append(np.frombuffer(b"".join(texts), np.uint8).astype(np.uint16), 256)
        at = begin[:, None] + np.arange(-2, LANE)[None, :]
        at[(at >= end[:, None]) | (at < starts[self.text][:, None])] = len(data) - 1
        self.classes = CLASS_OF[data[at]].T.copy()
        state = np.zeros(len(self.text), np.uint8)
        for k in range(2):
            state = AFTER[state * 8 + self.classes[k]]
        self.entry, counts = state, np.zeros(len(self.text), np.int64)
        for row in self.classes[2:]:
            step = state * 8 + row
            state = AFTER[step]
            counts += EMITS[step]
        self.units, self.chars, sentinels = counts % CHAR, counts // CHAR % CHAR, counts // SENTINEL
        total = lambda x: np.bincount(self.text, x, len(texts)).astype(np.int64)
        self.n, self.n_chars, self.marked = total(self.units), total(self.chars), total(sentinels) > 0
        self.sizes, self.units_to, self.chars_to = sizes, np.cumsum(self.units), np.cumsum(self.chars)

    def cuts(self, texts: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes and characters of each of texts before its unit of that number, or in all if it has no more units."""
        place, chars = self.sizes[texts].copy(), self.n_chars[texts].copy()
        some = np.flatnonzero(units < self.n[texts])
        before = np.append(0, np.cumsum(self.n))[texts[some]]
        lane = np.searchsorted(self.units_to, before + units[some], side="right")
        rank = before + units[some] - (self.units_to - self.units)[lane]
        state, seen, met = self.entry[lane], np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        chars_before = (self.chars_to - self.chars)[lane] - np.append(0, np.cumsum(self.n_chars))[texts[some]]
        for k, row in enumerate(self.classes[2:, lane]):
            step = state * 8 + row
            state, emitted = AFTER[step], EMITS[step]
            here = (emitted % CHAR > 0) & (met == rank)
            place[some[here]] = self.within[lane[here]] + k
            chars[some[here]] = chars_before[here] + seen[here]
            met += emitted % CHAR
            seen += emitted // CHAR % CHAR
        return place, chars


def _slices(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, text in enumerate(texts):
        if k > start and held + len(text) > AT_A_TIME:
            yield start, k
            start, held = k, 0
        held += len(text)
    yield start, len(texts)


def _run(rate: int, suffix_first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            drawn = np.stack([batch.column(k).to_numpy() for k in range(2, 6)]) if batch.num_rows else np.zeros((4, 0), np.int64)
            for start, end in _slices(texts):
                yield _cut(batch.column(0).slice(start, end - start), texts[start:end], drawn[:, start:end], rate, suffix_first)

    return run


def _cut(ids: pa.Array, texts: list[bytes], h: np.ndarray, rate: int, suffix_first: int) -> pa.RecordBatch:
    lanes = Lanes(texts)
    plain = (lanes.n == 0) | lanes.marked | (h[2] % 100 >= rate)
    spm = h[3] % 100 < suffix_first
    one, two = h[0] % (lanes.n + 1), h[1] % (lanes.n + 1)
    which = np.flatnonzero(~plain)
    low, low_chars = lanes.cuts(which, np.minimum(one, two)[which])
    high, high_chars = lanes.cuts(which, np.maximum(one, two)[which])
    forms, outputs = np.where(plain, "plain", np.where(spm, "spm", "psm")), list(texts)
    prefix_chars, middle_chars = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    prefix_chars[which], middle_chars[which] = low_chars, high_chars - low_chars
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    for k, a, b in zip(which.tolist(), low.tolist(), high.tolist(), strict=True):
        t = texts[k]
        outputs[k] = b"".join((s, t[b:], p, t[:a], m, t[a:b]) if spm[k] else (p, t[:a], s, t[b:], m, t[a:b]))
    arrays = [
        ids, pa.array(lanes.n), pa.array(forms.tolist(), pa.string()), pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain),
        pa.array(outputs, pa.binary()).cast(pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame, seed: int = 1, rate: int = 90, suffix_first: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Units are runs of letters A-Z and a-z, and single other characters. The first four groups of eight hex digits of the SHA-256 of `seed:id` draw
    two cuts between units, whether the text is cut (rate of 100), and whether its suffix goes first (suffix_first of 100, form spm, else psm).
    A text that is empty, holds a sentinel, or isn't drawn stays as it is: form plain, and no prefix_chars or middle_chars.

    A byte automaton reads each text once, in lanes, and its transitions emit counts of units, characters and sentinels. The lanes in which a
    cut lies are read a second time to find its place.

    Null text: as empty. Null id: as one without digits. Very long texts are read whole, and held by one task. Repeated rows: a row each, all alike. No
    rows: no rows. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *drawn)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_run(rate, suffix_first), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that transform() made an output of, from the output and its form."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    order = F.when(form == "psm", F.array(*map(F.lit, (1, 3, 2)))).otherwise(F.array(*map(F.lit, (2, 3, 1))))
    return F.when(form == "plain", output).otherwise(F.array_join(F.transform(order, lambda k: F.get(parts, k)), ""))


def oracle_sql() -> str:
    """DuckDB SQL that makes a list of all units."""
    h = [f"('0x' || h[{8 * k + 1}:{8 * k + 8}])::BIGINT AS h{k + 1}" for k in range(4)]
    held = " OR ".join(f"contains(t, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
        ), drawn AS (SELECT doc_id, t, {', '.join(h)}, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u FROM docs
        ), cut AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
            CASE WHEN t = '' OR {held} OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
        ), parts AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END)
                AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""
