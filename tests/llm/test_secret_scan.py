"""Secret scans against a plain search with every pattern, and the trigram queries against the patterns."""

import hashlib
import random
import re

import pytest

from lectern.llm import secret_scan
from lectern.llm.queries import op12_secret_scan

SECRETS = [
    'password = "hunter22x"', "API_KEY: abcdefgh", "apikey='abc'", "secret=token:abcdefgh", "Token : 12345", "token==x=y=z_1", "passwd:\n abcdefg", "AKIA" + "A" * 16, "AKIAAKIA" + "B9" * 6,
    "AKIA" + "z" * 30, "0123456789abcdef01234567", "0123456789ABCDEF01234567", "f" * 23, "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a1" * 18,
    "github_pat_" + "x" * 30, "glpat-" + "y" * 20, "xoxb-1234567890", "AIza" + "k" * 35, "sk_live_" + "Q" * 20, "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefgh_-", "Authorization: Bearer abcdefghij0123456789",
    "postgres://user:pa55word@host", "http://a.b/c", "ſecret=abcdefgh", "toKen=abcdefgh", "deadbeef" * 3 + "é" + "feedface" * 4,
]


def brute_force(text):
    found = []
    for k, rule in enumerate(secret_scan.RULES):
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def texts():
    rng = random.Random(12)
    pool = [*SECRETS, " ", " ", "\n", "word ", "é😀 ", "İ", "key", "pass", "://", "x" * 40, "3f"]
    yield from SECRETS
    for _ in range(300):
        yield "".join(rng.choice(pool) for _ in range(rng.randrange(30)))


def test_spans_are_those_of_every_pattern_tried_on_every_text(spark, tmp_path):
    rows = [*enumerate(texts()), (7, "password=abcdef1"), (7, "password=abcdef1"), (None, "secret: abcdefgh"), (None, None), (900, ""), (901, "word " * 60_000 + "passwd=abcdefgh " * 5000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, spans string, _row long")
    for table in (docs, None):
        if table is None:  # read from files, where rows are known by their places
            docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
            table = spark.read.parquet(str(tmp_path / "documents.parquet"))
        got = sorted((str(r.doc_id), [tuple(s) for s in r.spans]) for r in secret_scan.scan(table).collect())
        assert got == sorted((str(i), brute_force(t or "")) for i, t in rows)
    shown = lambda spans: ",".join(f"{secret_scan.RULES[k].kind}:{a}:{b}" for a, k, b in spans)
    want = []
    for i, t in rows:
        spans = brute_force(t or "")
        want.append((str(i), *[sum(k == n for _, k, _ in spans) for n in range(3)], hashlib.sha256(shown([s for s in spans if s[1] < 3]).encode()).hexdigest(), shown(spans)))
    got = [(str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in op12_secret_scan(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert secret_scan.scan(docs.where("false")).count() == 0


@pytest.mark.parametrize("only", ["hex", "assign"])
def test_rules_with_and_without_trigrams_work_alone(spark, only):
    rules = [r for r in secret_scan.RULES if r.kind == only]
    docs = spark.createDataFrame([(1, "token=abcdefgh " + "ab12" * 7), (2, "nothing")], "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in secret_scan.scan(docs, rules).collect()}
    assert got == {1: [(0, 0, 14)] if only == "assign" else [(15, 0, 43)], 2: []}


def holds(query, text):
    low = text.lower()
    return all(any(all(t in low for t in branch) for branch in branches) for branches in query)


def test_a_text_that_a_pattern_matches_satisfies_its_query():
    queries = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.RULES}
    assert [k for k, q in queries.items() if not q] == ["hex"]
    for text in texts():
        for rule in secret_scan.RULES:
            if re.search(rule.pattern, text, re.ASCII):
                assert holds(queries[rule.kind], text)
    for pattern, said, unsaid in [("(abc|abd)+x?def", "abcdef", "abxdef"), ("(?:ab[0-9a-z]*c|de)f", "anything", None), ("abc.*def", "abc def", "abcde"), ("[a-c]bcd", "bbcd", "dbcd"), ("(abc|x+)(def)?", "q", None)]:
        query = secret_scan.trigram_query(pattern)
        assert holds(query, said) and (unsaid is None or not holds(query, unsaid))


def test_rows_without_a_rules_trigrams_are_no_candidates(spark):
    rows = spark.createDataFrame([(5, "password"), (40_000, "PassWord token"), (70_000, "pass word ord swo"), (1 << 40, "secret")], "_row long, text string")
    query = {"0": secret_scan.trigram_query(secret_scan.RULES[0].pattern), "1": [[frozenset({"tok", "pas"})], [frozenset({"wor"})]]}
    index = secret_scan.postings(rows, sorted({t for q in query.values() for c in q for b in c for t in b}))
    got = {(r["_row"], r.kind) for r in secret_scan.candidates(index, query).collect()}
    assert got == {(5, "0"), (40_000, "0"), (40_000, "1"), (1 << 40, "0")}
