"""Operators on small tables: every case of drift, routing, merging, grounding and citing."""

import random

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import catalogue, drift, ledger, reading
from lectern.sources import corpus

KNOWN = "rel_path string, file_hash string"


def drifts(spark, scan, known):
    found = drift.classify(spark.createDataFrame(scan, KNOWN), spark.createDataFrame(known, KNOWN))
    return {(r.rel_path, r.drift, r.old_path) for r in found.collect()}


def test_drift_of_all_kinds(spark):
    known = [("a", "1"), ("b", "2"), ("old/c", "3"), ("d", "4")]
    scan = [("a", "1"), ("b", "2x"), ("new/c", "3"), ("e", "5"), ("copy/a", "1")]
    assert drifts(spark, scan, known) == {
        ("a", "unchanged", None), ("b", "modified", None), ("new/c", "moved", "old/c"), ("e", "new", None), ("copy/a", "duplicate", "a"), ("d", "deleted", None),
    }


def test_drift_of_two_identical_new_files_and_of_swapped_contents(spark):
    assert drifts(spark, [("x", "1"), ("y", "1")], []) == {("x", "new", None), ("y", "duplicate", "x")}
    assert {d for _, d, _ in drifts(spark, [("a", "2"), ("b", "1")], [("a", "1"), ("b", "2")])} == {"modified"}
    assert drifts(spark, [], []) == set()


def test_a_path_edited_into_a_duplicate_is_deleted_too(spark):
    got = drifts(spark, [("a", "1"), ("b", "1")], [("a", "1"), ("b", "2")])
    assert got == {("a", "unchanged", None), ("b", "duplicate", "a"), ("b", "deleted", None)}


def test_routing_never_drops_an_undecided_file(spark):
    cards = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], KNOWN)
    said = spark.createDataFrame([(0, 0, "1", True, "yes"), (1, 0, "1", False, "no"), (0, 1, "2", False, "no"), (0, 2, "9", True, "who")], "shard int, pos int, file_hash string, include boolean, reason string")
    assert {(r.rel_path, r.reason) for r in reading.route(cards, said).collect()} == {("a", "yes"), ("c", "no decision: included")}


def test_sections_merge(spark):
    rows = [("a", 0, False, 0.1, "x"), ("a", 1, True, 0.5, "y"), ("a", 2, True, 0.7, "y"), ("b", 0, False, 0.3, ""), ("b", 1, False, 0.2, "z")]
    got = reading.merge_sections(spark.createDataFrame(rows, "rel_path string, section int, relevant boolean, confidence double, reasoning string")).collect()
    assert {(r.rel_path, r.relevant, r.confidence, r.reasoning) for r in got} == {("a", True, 0.7, "x | y"), ("b", False, 0.2, "z")}


def test_pages_headings_and_citations(spark):
    row = spark.range(1).select(
        T.page_at(F.expr("array(named_struct('offset', 0, 'page', 1), named_struct('offset', 80, 'page', 2), named_struct('offset', 200, 'page', 5))"), F.lit(79)).alias("p79"),
        T.page_at(F.expr("array(named_struct('offset', 80, 'page', 2))"), F.lit(3)).alias("none"),
        T.cite(F.lit("d/a.md"), F.lit("A"), F.lit(0), F.lit(True)).alias("plain"),
        T.cite(F.lit("d/a.md"), F.lit("Part"), F.lit(3), F.lit(False)).alias("full"),
        T.claim_like(F.lit("Yes.")).alias("short"), T.claim_like(F.lit("This has four words.")).alias("long"),
    ).first()
    assert tuple(row) == (1, None, "[d/a.md]", "[d/a.md § Part, p.3 (unverified)]", False, True)


def test_headings_nest(spark):
    files = spark.createDataFrame([("a", "# One\ntext\n## Two\nmore\n## Three\nend\n# Four\n")], "rel_path string, markdown string")
    places = spark.createDataFrame([("a", 0), ("a", 13), ("a", 30), ("a", 44)], "rel_path string, offset int")
    got = {r.offset: r.heading_path for r in reading.heading_path_at(places, reading.headings(files)).collect()}
    assert got == {0: "", 13: "One / Two", 30: "One / Three", 44: "Four"}


def test_grounding_and_slices(spark):
    files = spark.createDataFrame([("a", "The Quick fox"), ("b", "")], "rel_path string, markdown string")
    quotes = spark.createDataFrame([(1, "quick FOX"), (2, "slow"), (3, None), (4, "")], "item_id long, quote string")
    assert sorted(tuple(r) for r in reading.ground_exact(quotes, files).collect()) == [(1, "a", 4), (4, "a", 0), (4, "b", 0)]
    assert [tuple(r) for r in reading.fixed_slices(files, 5).orderBy("rel_path", "part").collect()] == [("a", 0, "The Q"), ("a", 1, "uick "), ("a", 2, "fox"), ("b", 0, "")]


def test_scores_and_estimates(spark):
    pairs = spark.createDataFrame([("p",), ("q",)], "pair string")
    marks = [("p", 1, True, False, False), ("p", 2, True, False, True), ("p", 3, False, None, True), ("p", 9, None, True, True)]
    marks = spark.createDataFrame(marks, "pair string, file int, expected boolean, forbidden boolean, candidate boolean")
    got = {r.pair: tuple(r)[-5:] for r in ledger.score_routing(pairs, marks).collect()}
    assert got == {"p": (0.5, 1 / 3, 1, 2, 1), "q": (1.0, 1.0, 0, 0, 0)}
    tokens = spark.createDataFrame([(10_000,), (30_000,)], "tokens long")
    assert ledger.estimate_query(tokens).first()[:2] == (2, 40_000)


def test_directories_are_scanned(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / corpus.INDEX_DIR).mkdir()
    for name in ("a.md", "sub/b.txt", "ignore.xyz", f"{corpus.INDEX_DIR}/stray.md"):
        (tmp_path / name).write_text(name)
    got = {r.rel_path for r in corpus.scan_directory(spark, f"file://{tmp_path}").collect()}
    assert got == {"a.md", "sub/b.txt"}


def test_exact_quotes_match_brute_force(spark):
    rng = random.Random(3)
    files = [(str(k), "".join(rng.choice("ab é.\n  ") for _ in range(rng.randrange(0, 300)))) for k in range(40)]
    quotes = []
    for k in range(120):
        text = rng.choice(files)[1]
        at = rng.randrange(len(text) + 1)
        quotes.append((k, text[at : at + rng.randrange(0, 40)].upper()))
    want = {(i, p, t.lower().find(q.lower())) for i, q in quotes for p, t in files if q.lower() in t.lower()}
    got = reading.ground_exact(spark.createDataFrame(quotes, "item_id long, quote string"), spark.createDataFrame(files, "rel_path string, markdown string"), block=7)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_an_index_run_keeps_moves_and_drops(spark):
    known = spark.createDataFrame([("A", "a", 1), ("B", "b", 1), ("C", "c", 1), ("D", "d", 1), ("E", "e", 1)], "file_hash string, rel_path string, size_bytes long")
    scan = spark.createDataFrame([("A", "a", 2), ("B", "new/b", 2), ("X", "c", 2), ("C", "d", 2), ("A", "copy", 2)], "file_hash string, rel_path string, size_bytes long")
    change = drift.classify(scan, known)
    after = catalogue.apply_drift(known, scan, change)
    # C's content went to d, whose own content is gone; E was deleted.
    assert {tuple(r) for r in after.collect()} == {("A", "a", 1), ("B", "new/b", 1), ("X", "c", 2), ("C", "d", 2)}
    cards = known.select("file_hash")
    assert {r[0] for r in catalogue.dependents(cards, known, after, change).collect()} == {"A", "B"}
    forced = catalogue.with_forced(change, spark.createDataFrame([("a",), ("copy",)], "rel_path string"))
    after = catalogue.apply_drift(known, scan, forced)
    assert ("A", "a", 2) in {tuple(r) for r in after.collect()}
    assert {r[0] for r in catalogue.dependents(cards, known, after, forced).collect()} == {"B"}
    flagged = spark.createDataFrame([("z", "ok"), ("y", "zero_text")], "rel_path string, parse_status string")
    assert {tuple(r) for r in catalogue.status(change, flagged).collect()} == {("new/b", "moved", "b"), ("c", "modified", ""), ("d", "modified", ""), ("copy", "duplicate", "a"), ("e", "deleted", ""), ("y", "flagged", "zero_text")}


def test_the_last_verdict_counts_and_new_ones_win_ties(spark):
    columns = "k string, at int, v string"
    stored, new = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 5, "z")], columns), spark.createDataFrame([("a", 2, "new"), ("b", 1, "late"), ("c", 1, "c")], columns)
    assert {tuple(r) for r in catalogue.latest(stored, new, ["k"], ["at"]).collect()} == {("a", 2, "new"), ("b", 5, "z"), ("c", 1, "c")}


def test_outcomes_of_converters(spark):
    rows = [("success", [], 10, 3), ("success", [], 10, 0), ("partial_success", [f"e{k}" for k in range(18)], 9, 1), ("failure", [f"e{k}" for k in range(7)], 0, 0)]
    df = spark.createDataFrame(rows, "o string, e array<string>, chars int, pages int")
    got = [tuple(r.s) for r in df.select(catalogue.conversion_status(F.col("o"), F.col("e"), F.col("chars"), F.col("pages")).alias("s")).collect()]
    assert got == [("zero_text", None), ("ok", None), ("partial_parse", "; ".join(f"e{k}" for k in range(10)) + " (+8 more)"), ("parse_failed", "e0; e1; e2; e3; e4")]


def test_sections_merge_with_their_findings(spark):
    found = lambda *q: [("c", x) for x in q]
    rows = [("f", 0, True, 0.4, "r", found("b")), ("f", 1, False, 0.9, "s", found("no")), ("f", 2, True, 0.7, "r", found("a", "c")), ("g", 0, False, 0.6, "", found("no")), ("g", 1, False, 0.2, " t ", [])]
    df = spark.createDataFrame(rows, "rel_path string, section int, relevant boolean, confidence double, reasoning string, findings array<struct<claim:string,quote:string>>")
    got = {r.rel_path: (r.relevant, r.confidence, r.reasoning, [x.quote for x in r.findings]) for r in reading.merge_verdicts(df).collect()}
    assert got == {"f": (True, 0.7, "r | s", ["b", "a", "c"]), "g": (False, 0.2, "t", [])}


def test_candidates_of_a_sweep_and_of_the_router(spark):
    files = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "rel_path string, file_hash string")
    cards = spark.createDataFrame([("A", ["soil", "water"]), ("B", ["soil", "moon"])], "file_hash string, terms array<string>")
    words = ["water", "soil", "rain"]
    assert reading.candidates(files, cards, words).count() == 3
    assert {(r.rel_path, r.reason) for r in reading.candidates(files, cards, words, threshold=2).collect()} == {("a", "overlap=2"), ("c", "no card: included")}


def test_prices(spark):
    df = spark.createDataFrame([(None, None, 3.0), (1.0, None, 3.0), (None, 2.0, 3.0), (None, None, None)], "a double, b double, listed double")
    assert [r[0] for r in df.select(ledger.rate(F.col("a"), F.col("b"), F.col("listed"))).collect()] == [3.0, 1.0, 0.0, 0.0]
