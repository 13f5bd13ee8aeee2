"""Secrets by a trigram inverted index: Boolean queries from each rule's pattern choose the texts that it is tried on. DataFrame operations only."""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parse
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import ROW, among, numbered, written

#: Strings that a part of a pattern may stand for and still be spelt out, and trigrams of a string that are asked for at most.
MOST_STRINGS, MOST_TRIGRAMS = 24, 6
#: Rows of a posting bitmap, a fixed value of Spark's bitmap functions.
BLOCK_BITS = 15


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern that Java, Python and RE2 read alike, and the least length of its group that makes a match count."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base rules, in the order of their kinds.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Public formats of keys and tokens.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("pgp_key", r"-----BEGIN PGP PRIVATE KEY BLOCK-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,255}"),
    Rule("github_pat", r"github_pat_[A-Za-z0-9_]{22,255}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,64}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,250}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,128}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"(?i)authorization: ?bearer [A-Za-z0-9._~+/-]{16,}"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[A-Za-z0-9._%-]{1,64}:[A-Za-z0-9._%!-]{3,64}@"),
)
RULES = BASE + MORE

Clauses = list[list[frozenset[str]]]


def _strings(item: tuple) -> set[str] | None:
    """What an element of a parsed pattern can stand for, in lower case; None if that is more than MOST_STRINGS strings."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= MOST_STRINGS else None
    if op is sre.SUBPATTERN:
        return _spelt(arg[3])
    if op is sre.BRANCH:
        each = [_spelt(way) for way in arg[1]]
        return None if None in each or len(set().union(*each)) > MOST_STRINGS else set().union(*each)
    if op is sre.MAX_REPEAT and arg[1] == 1:
        some = _spelt(arg[2])
        return some if some is None or arg[0] else some | {""}
    return None


def _spelt(items: Sequence[tuple]) -> set[str] | None:
    out = {""}
    for item in items:
        some = _strings(item)
        if some is None or len(out) * len(some) > MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, some)}
    return out


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(list(dict.fromkeys(text[k : k + 3] for k in range(len(text) - 2)))[:MOST_TRIGRAMS])


def _clause(strings: set[str]) -> list[frozenset[str]]:
    """The branches of which one holds if one of the strings is in a text; none, if a string is too short to say anything."""
    each = {_trigrams(s) for s in strings}
    return [] if frozenset() in each else sorted((b for b in each if not any(o < b for o in each)), key=sorted)


def _needed(items: Sequence[tuple]) -> Clauses:
    clauses, run = [], {""}
    for item in items:
        some, op, arg = _strings(item), *item
        if some is not None and len(run) * len(some) <= MOST_STRINGS:
            run = {a + b for a, b in product(run, some)}
            continue
        clauses, run = [*clauses, _clause(run)], some or {""}
        if some is not None:
            continue
        if op is sre.SUBPATTERN:
            clauses += _needed(arg[3])
        elif op is sre.MAX_REPEAT and arg[0] > 0:
            clauses += _needed(arg[2])
        elif op is sre.BRANCH:
            each = [_needed(way) for way in arg[1]]
            if all(each):  # a text holds one way, and so that way's first clause
                clauses.append([b for way in each for b in way[0]])
    return [c for c in [*clauses, _clause(run)] if c]


def trigram_query(pattern: str) -> Clauses:
    """What the lower-cased trigrams of each text that the pattern matches must satisfy: of every clause one branch, and of that branch all
    trigrams. No clauses: the pattern has no mandatory trigram, and all texts must be scanned."""
    return _needed(sre_parse.parse(pattern))


def postings(rows: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """The inverted index of rows (ROW, text) for these trigrams: trigram, block, map: a bitmap of the rows of a block of 32,768 whose
    lower-cased text has the trigram. So a posting list is split by blocks, however common its trigram is."""
    low = rows.select(ROW, F.lower("text").alias("low"))
    has = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    each = low.select(F.shiftright(ROW, BLOCK_BITS).alias("block"), (F.col(ROW) % (1 << BLOCK_BITS)).alias("bit"), F.explode(has).alias("trigram"))
    return each.groupBy("trigram", "block").agg(F.bitmap_construct_agg("bit").alias("map"))


def candidates(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """ROW, kind: the rows that satisfy each kind's query, by intersecting and uniting the bitmaps of postings()."""
    terms = [(kind, c, b, t, len(branch)) for kind, clauses in queries.items() for c, branches in enumerate(clauses) for b, branch in enumerate(branches) for t in sorted(branch)]
    terms = index.sparkSession.createDataFrame(terms, "kind string, clause int, branch int, trigram string, need int")
    wanted = index.sparkSession.createDataFrame([(k, len(c)) for k, c in queries.items()], "kind string, clauses int")
    n = F.count(F.lit(1)).alias("n")
    met = index.join(F.broadcast(terms), "trigram")  # the rules bound both sides that are broadcast
    branches = met.groupBy("kind", "clause", "branch", "block", "need").agg(F.bitmap_and_agg("map").alias("map"), n).where("n = need")
    clauses = branches.groupBy("kind", "clause", "block").agg(F.bitmap_or_agg("map").alias("map"))
    held = clauses.groupBy("kind", "block").agg(F.bitmap_and_agg("map").alias("map"), n).join(F.broadcast(wanted), "kind").where("n = clauses")
    byte = lambda k: F.substring(F.col("map"), k + 1, F.lit(1))
    full = held.select("kind", "block", "map", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4095)), lambda k: byte(k) != F.lit(bytes(1)))).alias("k"))
    bits = full.select("kind", "block", "k", F.conv(F.hex(byte(F.col("k"))), 16, 10).cast("int").alias("bits"))
    bits = bits.select("kind", "block", "k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.getbit(F.col("bits"), b) == 1)).alias("b"))
    return bits.select(F.shiftleft("block", BLOCK_BITS).__add__(F.col("k") * 8 + F.col("b")).alias(ROW), "kind")


def _matches(text: str, rule: Rule, number: int) -> Column:
    """Of each match, in order: its rule's number, its place among them, and the lengths of the text since the match before, of itself, and of its group."""
    found = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    return F.transform(
        F.arrays_zip(found(0).alias("whole"), found(rule.group).alias("own"), F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found(0))).alias("gap")),
        lambda m, k: F.struct(F.lit(number).alias("rule"), k.alias("k"), F.char_length(m["gap"]).alias("gap"), F.char_length(m["whole"]).alias("size"), F.char_length(m["own"]).alias("own")),
    )


def find(rows: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """ROW, spans of the rows (ROW, text, without nulls) in which any rule finds something: spans is an array of (start, rule, end), in order;
    rule is a place in rules, and offsets are code points.

    1. Each rule's pattern gives a Boolean query of trigrams. Bitmaps of the rows that hold the trigrams asked for are the index; it is
       written once, and queries intersect and unite its bitmaps.
    2. Only rows in a rule's result are tried with its pattern. Their texts alone are shuffled.
    3. A rule without mandatory trigrams is tried on all texts, where they lie.
    Of a rule's matches, leftmost and without overlap, those count whose group is long enough.
    """
    queries = {str(k): q for k, rule in enumerate(rules) if (q := trigram_query(rule.pattern))}
    chosen = [F.lit(None).cast("array<struct<rule:int,k:int,gap:int,size:int,own:int>>")]
    each = []
    if queries:
        index = written(postings(rows, sorted({t for clauses in queries.values() for branches in clauses for b in branches for t in b})), "trigrams")
        wanted = candidates(index, queries).groupBy(ROW).agg(F.collect_set("kind").alias("kinds"))
        wanted = written(wanted, "candidates")
        texts = among(rows.select(ROW, "text"), wanted, ROW).join(wanted, ROW)
        chosen = [F.when(F.array_contains("kinds", k), _matches("text", rules[int(k)], int(k))) for k in queries]
        each.append(texts.select(ROW, F.explode(F.flatten(F.array_compact(F.array(*chosen)))).alias("m")))
    for k, rule in enumerate(rules):
        if str(k) not in queries:
            each.append(rows.where(F.col("text").rlike(rule.pattern)).select(ROW, F.explode(_matches("text", rule, k)).alias("m")))
    found = each[0]
    for more in each[1:]:
        found = found.union(more)
    found = found.select(ROW, "m.*").repartition(ROW)  # by which the window and the groups below are dealt out, too
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy(ROW, "rule").orderBy("k"))
    least = F.element_at(F.array(*[F.lit(r.least) for r in rules]), F.col("rule") + 1)
    kept = found.withColumn("end", end).where(F.col("own") >= least)
    return kept.groupBy(ROW).agg(F.sort_array(F.collect_list(F.struct((F.col("end") - F.col("size")).alias("start"), "rule", "end"))).alias("spans"))


def scan(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, spans: an array of (start, rule, end), empty if no rule finds anything. See find().

    Null or empty text: no spans. Very long texts are read whole; all spans of a text are one array. Null ids stay; repeated rows: a row each.
    No rows: no rows. Other columns are not read.
    """
    rows = numbered(docs, F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = find(rows.select(ROW, "text"), rules)
    none = F.array().cast(found.schema["spans"].dataType)
    return rows.select(ROW, "doc_id").join(found, ROW, "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def shown(spans: Column, rules: Sequence[Rule] = RULES) -> Column:
    """spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def oracle_sql(rules: Sequence[Rule] = RULES) -> str:
    """DuckDB SQL that tries every pattern on every text, without an index."""
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def plain(rule: Rule) -> str:  # RE2 folds case beyond ASCII, so letters are spelt out
        if not rule.pattern.startswith("(?i)"):
            return rule.pattern
        out, inside = "", False
        for c in rule.pattern[4:].replace(r"\x20", " "):
            inside = (inside or c == "[") and c != "]"
            out += f"[{c.upper()}{c.lower()}]" if c.isalpha() and not inside else c
        return out

    parts = [
        f"""SELECT r, {k} AS rule, k, length(whole) AS size, length(own) AS own, {rule.least} AS least, length(gap) AS gap FROM (
            SELECT r, unnest(regexp_extract_all(t, {quoted(plain(rule))}, 0)) AS whole, unnest(regexp_extract_all(t, {quoted(plain(rule))}, {rule.group})) AS own,
                   unnest(string_split_regex(t, {quoted(plain(rule))})[:-2]) AS gap, generate_subscripts(regexp_extract_all(t, {quoted(plain(rule))}, 0), 1) AS k
            FROM docs WHERE regexp_matches(t, {quoted(plain(rule))}))"""
        for k, rule in enumerate(rules)
    ]
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    count = lambda k: f"count(rule) FILTER (rule = {k}) AS n_{rules[k].kind}"
    joined = lambda where: f"coalesce(string_agg({kinds}[rule + 1] || ':' || (stop - size) || ':' || stop, ',' ORDER BY stop - size, rule){where}, '')"
    return f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
        ), each AS ({' UNION ALL '.join(parts)}
        ), placed AS (SELECT *, (sum(gap + size) OVER (PARTITION BY r, rule ORDER BY k))::BIGINT AS stop FROM each
        ), found AS (SELECT * FROM placed WHERE own >= least)
        SELECT any_value(doc_id) AS doc_id, {count(0)}, {count(1)}, {count(2)}, sha256({joined(' FILTER (rule < 3)')}) AS base_sha256, {joined('')} AS spans
        FROM docs LEFT JOIN found USING (r) GROUP BY r"""
