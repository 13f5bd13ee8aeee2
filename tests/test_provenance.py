"""Page maps, token chunks, orders and packing against plain walks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import catalogue, drift, ledger, ordering, provenance, reading

FILES = "rel_path string, file_hash string, parse_status string, markdown string, page_marks array<struct<offset:int,page:int>>"


def marks_by_a_walk(items, text):
    cursor, last, out = 0, None, []
    for _, said, page in sorted(items, key=lambda i: i[0]):
        anchor = (said or "").strip()[:40]
        if page is None or not anchor:
            continue
        at = text.find(anchor, cursor)
        at = text.find(anchor) if at < 0 else at
        if at < 0:
            continue
        cursor = at + len(anchor)
        if page != last:
            out.append((at, page))
            last = page
    return sorted(out)


def test_marks_are_those_of_a_walk_over_the_items(spark):
    rng = random.Random(4)
    words = ["alpha", "beta ", "é😀 ", "a much longer passage of more than forty characters, twice", "\n", "x"]
    texts = {f"{k}.md": "".join(rng.choices(words, k=rng.randrange(1, 40))) for k in range(60)} | {"none.md": "text", "empty.md": ""}
    items = []
    for path in texts:
        if path != "none.md":
            for seq in range(rng.randrange(0, 12)):
                items.append((path, seq, rng.choice([*words, " \n", "", None, "missing", "  alpha"]), rng.choice([1, 1, 2, 3, None])))
    files = spark.createDataFrame(list(texts.items()), "rel_path string, markdown string")
    got = {}
    for r in provenance.anchored_marks(spark.createDataFrame(items, "rel_path string, seq int, text string, page int"), files).collect():
        got.setdefault(r.rel_path, []).append((r.offset, r.page))
    want = {p: marks_by_a_walk([i[1:] for i in items if i[0] == p], t) for p, t in texts.items()}
    assert {p: sorted(m) for p, m in got.items()} == {p: m for p, m in want.items() if m}
    marked = {r.rel_path: [tuple(m) for m in r.page_marks] for r in provenance.with_marks(files, provenance.anchored_marks(spark.createDataFrame(items, "rel_path string, seq int, text string, page int"), files)).collect()}
    assert marked == want


def test_repeated_items_get_places_of_their_own_and_marks_stand_at_page_changes_only(spark):
    text = "same words here\nsame words here\nother words\nsame words here\n"
    items = [("f", k, t, p) for k, (t, p) in enumerate([("same words here", 1), ("same words here", 1), ("other words", 2), (" same words here ", 2), ("other words", 3)])]
    rows = provenance.anchored_marks(spark.createDataFrame(items, "rel_path string, seq int, text string, page int"), spark.createDataFrame([("f", text)], "rel_path string, markdown string"))
    assert sorted((r.offset, r.page) for r in rows.collect()) == [(0, 1), (32, 2), (32, 3)]


def chunks_by_a_walk(text, target):
    most, at, heads, out, held = 4 * target + 3, 0, [], [], None
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        m = re.match(r"^ {0,3}(#{1,6})[ \t]+(.*)$", re.sub(r"\r?\n$", "", line))
        if m:
            heads = [h for h in heads if h[0] < len(m[1])] + [(len(m[1]), m[2].strip(" "))]
            held = None
        for k in range(0, len(line), most):
            part = line[k : k + most]
            if held is None or len(held[2]) + len(part) > most:
                held = [at + k, [h[1] for h in heads], ""]
                out.append(held)
            held[2] += part
        at += len(line)
    return [tuple(c) for c in out if c[2].strip()]


def test_chunks_are_those_of_a_walk_over_the_lines(spark):
    rng = random.Random(9)
    line = lambda: rng.choice(["", "# A", "## B b", "### C", "  # indented", "#tag", "words and words", "é — ü😀 " * 9, "\t ", "## B b", "x" * 100, "cr\r"])
    texts = {f"{k}.md": "\n".join(line() for _ in range(rng.randrange(60))) for k in range(60)}
    texts |= {"same.md": "# A\nsame words here\n# A\nsame words here\n# B\nsame words here\n", "empty.md": "", "blank.md": " \n\n", "null.md": None, "long.md": "word " * 20_000}
    statuses = dict.fromkeys(texts, "ok") | {"1.md": "partial_parse", "2.md": "parse_failed", "3.md": "zero_text", "4.md": "unsupported_format"}
    rows = [(p, f"hash {p}", statuses[p], t, [(0, 1), (19, 2)]) for p, t in texts.items()]
    got = {}
    for r in provenance.token_chunks(spark.createDataFrame(rows, FILES), 8).collect():
        got.setdefault(r.rel_path, []).append(r)
    want = {p: chunks_by_a_walk(t or "", 8) for p, t in texts.items() if statuses[p] in ("ok", "partial_parse")}
    assert set(got) == {p for p, c in want.items() if c} and "2.md" not in got and "null.md" not in got
    for path, found in got.items():
        found.sort(key=lambda r: r.chunk_index)
        assert [(r.char_start, r.heading_path, r.text) for r in found] == want[path]
        assert [r.chunk_id for r in found] == [f"hash {path}:{k}" for k in range(len(found))]
        assert all(texts[path][r.char_start : r.char_end] == r.text and len(r.text) // 4 <= 8 for r in found)
        assert all(r.page == (2 if r.char_start >= 19 else 1) for r in found)
    assert [(r.char_start, r.heading_path) for r in got["same.md"]] == [(0, ["A"]), (20, ["A"]), (40, ["B"])]
    assert provenance.token_chunks(spark.createDataFrame([], FILES)).count() == 0


def test_chunks_are_replaced_by_file(spark):
    rows = lambda *pairs: spark.createDataFrame([*pairs], "file_hash string, text string")
    stored, new, done = rows(("a", "1"), ("a", "2"), ("b", "1"), ("c", "1")), rows(("a", "new"), ("d", "new")), rows(("a", ""), ("b", ""), ("d", ""))
    assert sorted(map(tuple, provenance.replaced(stored, new, done).collect())) == [("a", "new"), ("c", "1"), ("d", "new")]


@pytest.mark.parametrize("ranges", [1, 5, None])
def test_running_sums_follow_one_order_of_all_rows(spark, ranges):
    rng = random.Random(2)
    rows = [(f"p{rng.randrange(99)}", k, rng.randrange(5)) for k in range(500)]
    got = ordering.running(spark.createDataFrame(rows, "path string, seq int, n int"), ["path", "seq"], {"before": "n"}, ranges).collect()
    total = 0
    for place, (path, seq, n) in enumerate(sorted(rows)):
        r = next(r for r in got if r.seq == seq)
        assert (r.path, r.place, r.before) == (path, place, total)
        total += n
    assert ordering.running(spark.createDataFrame([], "path string, seq int, n int"), ["path"]).count() == 0


@pytest.mark.parametrize("budget, most", [(30, 5), (30, 10_000), (3, 10_000), (10_000, 1), (10_000, 7), (1, 3)])
def test_runs_are_those_of_one_walk(spark, budget, most):
    rng = random.Random(budget + most)
    rows = [(f"{k:05}", rng.choice([1, 2, 3, 8, 29, 30, 31, 200])) for k in range(rng.choice([1, 2, 700]))]
    want, run, used, held = [], -1, 0, 0
    for path, tokens in rows:
        if run < 0 or used + tokens > budget or held == most:
            run, used, held = run + 1, 0, 0
        used, held = used + tokens, held + 1
        want.append((path, tokens, run))
    shuffled = rng.sample(rows, len(rows))
    got = ordering.greedy_runs(spark.createDataFrame(shuffled, "path string, tokens int"), ["path"], budget, most)
    assert sorted(map(tuple, got.collect())) == want
    assert ordering.greedy_runs(spark.createDataFrame([], "path string, tokens int"), ["path"], budget, most).count() == 0


def test_ten_thousand_cards_are_packed_without_a_task_that_holds_them_all(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(1, 90)) for k in range(10_000)]
    want, run, used, held = [], 0, 0, 0
    for k, tokens in rows:
        if held and (used + tokens > 600 or held == 13):
            run, used, held = run + 1, 0, 0
        used, held = used + tokens, held + 1
        want.append((k, tokens, run))
    got = ordering.greedy_runs(spark.createDataFrame(rows, "at long, tokens long"), ["at"], 600, 13)
    assert sorted(map(tuple, got.collect())) == want


def test_hits_are_the_same_if_their_quotes_are_when_folded(spark):
    rows = [("f", 3, "c", "“A café” broken-\n up"), ("f", 1, "c", "\"a café\"  brokenup"), ("f", 2, "c", "another"), ("g", 1, "c", "another"), ("g", 2, "Claim", " "), ("g", 3, "claim", ""), ("g", 4, "*another*", "*An_other*")]
    got = reading.hits(spark.createDataFrame(rows, "rel_path string, seq int, claim string, quote string")).collect()
    assert sorted((r.rel_path, r.seq) for r in got) == [("f", 1), ("f", 2), ("g", 1), ("g", 2)]


def test_calls_cost_what_the_serving_model_does(spark):
    calls = [("own", "big", 10, 1), ("own", "host/big", 10, 1), ("own", "small", 10, 1), ("own", "new", 10, 1), ("half", "big", 10, 1), ("none", "small", 10, 1), ("unknown task", "small", 10, 1), ("own", None, 10, 1)]
    tasks = spark.createDataFrame([("own", "host/big", 2.0, 3.0), ("half", "big", None, 7.0), ("none", "small", None, None)], "task string, primary string, in_rate double, out_rate double")
    listed = spark.createDataFrame([("small", 0.5, 1.0), ("big", 9.0, 9.0)], "model string, in_rate double, out_rate double")
    got = ledger.call_costs(spark.createDataFrame(calls, "task string, served string, tokens_in long, tokens_out long"), tasks, listed).collect()
    assert {(r.task, r.served): round(r.cost * 1e6, 6) for r in got} == {
        ("own", "big"): 23, ("own", "host/big"): 23, ("own", "small"): 6, ("own", "new"): 0, ("half", "big"): 7, ("none", "small"): 6, ("unknown task", "small"): 6, ("own", None): 0,
    }


def test_forced_paths_are_indexed_anew_only_if_unchanged(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "rel_path string, file_hash string")
    scan = spark.createDataFrame([("a", "1"), ("b", "new"), ("d", "3"), ("e", "1")], "rel_path string, file_hash string")
    wish = spark.createDataFrame([(p,) for p in "abdez"], "rel_path string")
    got = {r.rel_path: r.drift for r in catalogue.with_forced(drift.classify(scan, known), wish).collect()}
    assert got == {"a": "forced", "b": "modified", "d": "moved", "e": "duplicate"}
    cards = known.withColumn("card", F.lit("x"))
    change = catalogue.with_forced(drift.classify(scan, known), wish)
    after = catalogue.apply_drift(known.withColumn("size", F.lit(0)), scan.withColumn("size", F.lit(1)), change)
    assert {r.file_hash for r in catalogue.dependents(cards, known, after, change).collect()} == {"3"}


def test_verdicts_are_told_newest_first(spark):
    rows = [("f", 1, 10), ("f", 2, 30), ("f", 3, 30), ("g", 4, 5)]
    got = ledger.newest_first(spark.createDataFrame(rows, "file string, id int, at int"), ["file"], ["at", "id"]).collect()
    assert {(r.file, r.id): r.place for r in got} == {("f", 3): 1, ("f", 2): 2, ("f", 1): 3, ("g", 4): 1}


def test_one_path_stands_for_each_content_by_folders(spark):
    scan = spark.createDataFrame([("a.md", "1", "t"), ("a/b.md", "1", "t"), ("z.md", "2", None)], "rel_path string, file_hash string, markdown string")
    assert sorted(map(tuple, drift.final_files(scan).collect())) == [("a/b.md", "1", "t"), ("z.md", "2", None)]
