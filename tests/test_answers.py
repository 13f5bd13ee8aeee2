"""Citations, sources, cut replies, sections and batches on small tables, and the index as a stream."""

from pyspark.sql import functions as F

from lectern.operators import answers, reading
from lectern.streaming import index


def test_citations_resolve(spark):
    text = "# A heading about many things\nThis holds for all of them [1, 2, 1]. Yes. This one has no mark at all.\n\nThe points are these here:\n* Ghosts are never seen [7]."
    said = spark.createDataFrame([("x", text), ("y", None), ("z", "")], "answer_id string, text string")
    known = spark.createDataFrame([("x", 1, "[a.md]"), ("x", 2, "[b.md]"), ("w", 1, "[c.md]")], "answer_id string, number int, cite string")
    got = {r.answer_id: r for r in answers.resolve(said, known).collect()}
    assert got["x"].text == (
        "A heading about many things\nThis holds for all of them [a.md] [b.md]. Yes. This one has no mark at all. [uncited]\n\nThe points are these here:\n- Ghosts are never seen [uncited]."
    )
    assert (got["x"].resolved, got["x"].uncited, got["x"].used) == (3, 2, [1, 2])
    assert got["x"].bad == ["This one has no mark at all. [uncited]", "* Ghosts are never seen [uncited]."]
    assert (got["y"].text, got["z"].text, got["z"].uncited) == ("", "", 0)


def test_sources_and_scores(spark):
    used = spark.createDataFrame([("d/a.md", "Two", 0), ("d/a.md", "One", 0), ("d/a.md", "One", 3), ("d/a.md", "A", 4), ("b.txt", None, 0)], "rel_path string, heading string, page int")
    assert dict(answers.sources(used).collect()) == {"d/a.md": "One, Two, p.4", "b.txt": "(whole file)"}
    rows = [("x", "So [a § b] and [uncited].", "", ["a §"]), ("y", "None.", "z", ["q"])]
    got = answers.score_citations(spark.createDataFrame(rows, "answer_id string, text string, sources string, must_cite array<string>")).collect()
    assert {tuple(r) for r in got} == {("x", 0.5, True), ("y", 1.0, False)}


def test_replies_are_salvaged(spark):
    head = '{"file_hash": "h", "relevant": true, "confidence": 0.5, "reasoning": "r", "findings": ['
    one = '{"claim": "a } b", "quote": "\\"q"}'
    rows = [("whole", head + one + "]}"), ("fenced", "```json\n" + head + "]}\n```"), ("cut", head + one + ', {"claim": "c", "quo'), ("cut early", '{"file_hash": "h", "rel'), ("empty", ""), ("null", None)]
    parsed = answers.parse_replies(spark.createDataFrame(rows, "k string, raw string"))
    got = dict(parsed.select("k", F.when(F.col("reply").isNotNull(), F.size("reply.findings"))).collect())
    assert got == {"whole": 1, "fenced": 0, "cut": 1, "cut early": None, "empty": None, "null": None}


def test_sections_split_at_the_shallowest_heading(spark):
    text = "intro\n# A\n" + "a" * 30 + "\n## A1\n" + "b" * 30 + "\n# B\nshort\n"
    files = spark.createDataFrame([("f", text), ("e", ""), ("plain", "x" * 95)], "rel_path string, markdown string")
    got = [tuple(r) for r in reading.split_sections(files, 40).orderBy("rel_path", "section").collect()]
    assert got == [
        ("e", 0, ""), ("f", 0, "intro\n"), ("f", 1, "# A\n" + "a" * 30 + "\n"), ("f", 2, "## A1\n" + "b" * 30 + "\n"), ("f", 3, "# B\nshort\n"),
        ("plain", 0, "x" * 40), ("plain", 1, "x" * 40), ("plain", 2, "x" * 15),
    ]


def test_batches_and_merged_cards(spark):
    units = spark.createDataFrame([("g", k, t) for k, t in enumerate([5, 5, 1, 50, 2, 2, 2])] + [("h", 0, 1)], "grp string, seq int, tokens long")
    got = {(r.grp, r.seq): r.batch for r in reading.batches(units, "grp", ["seq"], 10, 2).collect()}
    assert got == {("g", 0): 0, ("g", 1): 0, ("g", 2): 1, ("g", 3): 2, ("g", 4): 3, ("g", 5): 3, ("g", 6): 4, ("h", 0): 0}
    parts = spark.createDataFrame([("a", 0, [" One", "two", ""]), ("a", 1, ["ONE", "three"]), ("b", 0, [])], "rel_path string, part int, terms array<string>")
    assert dict(reading.merge_cards(parts, ["terms"], 2).collect()) == {"a": ["One", "two"], "b": []}


def test_a_stream_indexes_each_content_once(spark, tmp_path):
    root, table, checkpoint = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "checkpoint")
    root.mkdir()

    def indexed(**files):
        for name, text in files.items():
            (root / f"{name}.md").write_text(text)
        (root / "skipped.xyz").write_text("other")
        index.index(index.watch(spark, str(root), ("md",)), table, checkpoint).awaitTermination()
        return {r.rel_path.rsplit("/", 1)[1] for r in spark.read.parquet(table).collect()}

    assert indexed(a="one", b="one", c="two") == {"a.md", "c.md"}
    assert indexed(d="two", e="three") == {"a.md", "c.md", "e.md"}


def test_marks_with_spaces_and_tags_are_not_marks(spark):
    text = "It holds for all of them [ 1 ].\n# Title\n#tag stays here\n• stays\n* item of a list [1]"
    evidence = spark.createDataFrame([("x", 1, "[a.md]")], "answer_id string, number int, cite string")
    got = answers.resolve(spark.createDataFrame([("x", text)], "answer_id string, text string"), evidence).first().text.split("\n")
    assert got == ["It holds for all of them [ 1 ]. [uncited]", "Title", "#tag stays here", "• stays", "- item of a list [a.md]"]


def test_evidence_and_digests(spark):
    rows = [("x", 2, "b.md", "Two hold", "q2", "[b.md]"), ("x", 1, "a.md", " One holds ", "q1", "[a.md]"), ("x", 3, "a.md", " ", "q3", "[a.md]")]
    told = spark.createDataFrame(rows, "answer_id string, number int, rel_path string, claim string, quote string, cite string")
    assert answers.evidence_block(told).first().block.startswith("[1]\n    claim:  One holds \n    quote: q1\n[2]\n")
    assert answers.claims_digest(told).first().digest == "One holds [1] Two hold [2]"
    got = answers.fallback_digest(told, "Found:").first()
    assert got.text == "Found:\n\n- One holds [a.md]\n\n- Two hold [b.md]" and got.uncited == 0


def test_cut_replies_are_closed_by_place(spark):
    """Only places come from Python, unless findings stand otherwise than one comma apart; and a reply is read in one pass."""
    head, one = '{"file_hash": "h", "relevant": true, "confidence": 0.5, "findings": [', '{"claim": "ß😀", "quote": "q"}'
    raws = [head + one + ", " + one + ', {"cla', head + one + one + "{", head + "," + one + ",, ", head, "no json", None]
    rows = spark.createDataFrame(list(enumerate(raws)), "n int, raw string")
    got = {r.n: r for r in answers.with_whole_findings(rows, "raw", "closed").collect()}
    assert [got[n].closed for n in range(6)] == [head + one + ", " + one + "]}", head + one + "," + one + "]}", head + one + "]}", head + "]}", None, None]
    for told in (answers.parse_replies(rows), answers.checked_replies(rows.withColumn("finish_reason", F.lit("length")))):
        assert told._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
        assert {r.n: len(r.reply.findings) if r.reply else None for r in told.collect()} == {0: 2, 1: 2, 2: 1, 3: 0, 4: None, 5: None}
