"""Fill-in-the-middle against a plain list of units, at lanes of several lengths."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import fim
from lectern.llm.queries import op13_fill_in_middle

POOL = ["a", "Zz", "PSM", "<", ">", "<P", "<S", "<M", "P>", "é", "日本", "😀", " ", "\n", "\x00", "1", "_", "́", "x" * 9]


def by_units(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, digest = len(units), hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return doc_id, n, *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def rows():
    rng = random.Random(13)
    some = [(i, "".join(rng.choices(POOL, k=rng.randrange(60)))) for i in range(500)]
    return [*some, (None, "Some text."), (None, None), (7, "Some text."), (7, "Some text."), (-5, ""), (900, "word é<P " * 40_000), (901, "<" * 300 + "P>"), (902, "a" * 5000), (903, "é" * 5000)]


def test_outputs_are_those_of_a_list_of_units(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows()], "doc_id long, text string, output string, n long").repartition(4)
    made = fim.transform(docs)
    got = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    want = [by_units(i, t) for i, t in rows()]
    assert sorted(map(str, (tuple(r[:6]) for r in got))) == sorted(map(str, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert sorted((str(r.doc_id), r.again) for r in got) == sorted((str(i), t or "") for i, t in rows())
    assert fim.transform(docs.where("false")).count() == 0
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    got = [tuple(r) for r in op13_fill_in_middle(spark, str(tmp_path)).collect()]
    assert sorted(map(str, got)) == sorted(str((*w[:5], digest(w[5]), digest(t))) for w, (_, t) in zip(want, rows(), strict=True))


@pytest.mark.parametrize("lane", [2, 3, 7, 128])
def test_lanes_of_any_length_give_the_same_counts_and_cuts(monkeypatch, lane):
    monkeypatch.setattr(fim, "LANE", lane)
    texts = [(t or "") for _, t in rows() if len(t or "") < 2000]
    lanes = fim.Lanes([t.encode() for t in texts])
    units = [re.findall(r"[A-Za-z]+|[^A-Za-z]", t) for t in texts]
    assert lanes.n.tolist() == [len(u) for u in units]
    assert lanes.n_chars.tolist() == [len(t) for t in texts]
    assert lanes.marked.tolist() == [bool(re.search("<[PSM]>", t)) for t in texts]
    of, at = np.array([(i, k) for i, u in enumerate(units) for k in range(len(u) + 1)]).T
    place, chars = lanes.cuts(of, at)
    before = ["".join(units[i][:k]) for i, k in zip(of, at, strict=True)]
    assert place.tolist() == [len(b.encode()) for b in before] and chars.tolist() == [len(b) for b in before]


def test_the_automaton_without_texts():
    assert fim.Lanes([]).n.tolist() == [] and fim.Lanes([b"", b""]).n.tolist() == [0, 0]


def test_slices_hold_whole_texts(monkeypatch):
    monkeypatch.setattr(fim, "AT_A_TIME", 5)
    assert list(fim._slices([b"aa", b"bb", b"cc", b"d" * 9, b""])) == [(0, 2), (2, 3), (3, 4), (4, 5)]
