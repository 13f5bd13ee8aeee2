"""Exact, near and line deduplication, decontamination: brute force and odd inputs."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest

from lectern.llm import decontamination, exact_dedup, line_dedup, near_dedup

DOCS = "doc_id long, text string, source string, digest string, norm string"
ODD = [(None, None), (None, "x y"), (1, None), (2, ""), (3, " \n "), (4, "A b"), (4, "A b"), (5, "a b"), (6, "a ß"), (7, "a SS"), (8, "word " * 30_000)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "s", "clash", "clash") for i, t in rows], DOCS)


def bag(text):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def similarity(x, y):
    same = sum((x & y).values())
    return same / max(1, sum(x.values()) + sum(y.values()) - same)


def varied(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=3):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(5, 260))]
        for k in range(rng.randrange(1, 9)):
            rows.append((n, varied(rng, base, k * len(base) // 100)))
            n += 1
    return rows + [(n + 1, "again and again " * 50), (n + 2, "again and again " * 44), (n + 3, "again and again " * 20)]


def classes(rows):
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [(i, bag(t)) for i, t in rows]
    for k, (i, x) in enumerate(bags):
        for j, y in bags[:k]:
            if x and y and similarity(x, y) >= 0.8:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(spark, rows)).collect()}
    assert got == classes(rows)
    assert len(set(got.values())) < len(got)


@pytest.mark.parametrize("small", [4096, 20, 2])
def test_a_crowded_hub_loses_no_link(spark, small):
    """Texts about one base: some share a passage that it lacks without being alike, others are copies of one another far from it."""
    rng = random.Random(8)
    base, line = [f"b{k}" for k in range(100)], [f"line{k}" for k in range(15)]
    rows = [(0, " ".join(base))]
    for k in range(60):
        rows.append((len(rows), varied(rng, base, 2) + " " + " ".join(line + [f"own{k}x{j}" for j in range(12)])))
    for k in range(12):
        far = varied(rng, base + line, 5).split()
        rows += [(len(rows) + j, varied(rng, far, 1)) for j in range(4)]
    passages = [[f"p{k}x{j}" for j in range(10)] for k in range(9)]
    for _ in range(60):  # which differ from their hub by passages that many share, some by the same ones in another order
        rows.append((len(rows), " ".join(base + [w for k in rng.sample(range(9), 3) for w in passages[k]])))
    tally = []
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(table(spark, rows), small=small, tally=tally).collect()}
    assert got == classes(rows)
    assert [t["crowded"] > 0 for t in tally] == [True] * (len(tally) - 1) + [False] and len(tally) <= len(rows)
    assert (len(tally) > 1) == (small < 4096) and sum(t["pairs"] for t in tally) < 3000, tally  # of 14,196 pairs of texts


def test_near_duplicates_of_odd_rows(spark):
    got = near_dedup.near_duplicates(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    of = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in got if r.doc_id is not None}
    assert of[4] == of[4] == (4, 3, True) and of[5] == (4, 3, False)
    assert of[1] == (1, 1, True) and of[2] == (2, 1, True) and of[8] == (8, 1, True)
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_bag_minhash_estimates_the_weighted_similarity():
    a, b = Counter({1: 8, 2: 3, 3: 1, 4: 20}), Counter({1: 5, 2: 3, 5: 2, 4: 25})
    docs = np.array([0] * len(a) + [1] * len(b))
    shingles, counts = np.array([*a, *b], np.int64), np.array([*a.values(), *b.values()])
    x, y = near_dedup.bag_minhash(docs, shingles, counts, 2, 4096)
    assert (x == y).mean() == pytest.approx(similarity(a, b), abs=0.04)


def test_links_near_the_threshold_share_a_band_and_agree_in_their_signatures():
    """The two approximations of near_duplicates(), on links of a similarity of 0.80 to 0.85; all else is exact."""
    rng, left, right = random.Random(21), [], []
    while len(left) < 1500:
        n = rng.randrange(60, 240)
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        a, b = bag(" ".join(base)), bag(varied(rng, base, max(1, n // 45)))
        if 0.8 <= similarity(a, b) < 0.85:
            left.append(a)
            right.append(b)
    kept = linked(left, right)
    assert kept >= 0.995 * len(left)


def linked(left, right):
    """How many of these pairs of bags share a band, and agree in as many components as near_duplicates() asks for."""
    number = {}
    bags = [{number.setdefault(s, hash(s) % 2**63): k for s, k in x.items()} for pair in zip(left, right, strict=True) for x in pair]
    docs = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    shingles, counts = np.array([s for x in bags for s in x], np.int64), np.array([k for x in bags for k in x.values()])
    signature = near_dedup.bag_minhash(docs, shingles, counts, len(bags), near_dedup.BANDS * near_dedup.ROWS)
    bands = near_dedup.band_hashes(signature, near_dedup.BANDS, near_dedup.ROWS).reshape(-1, 2, near_dedup.BANDS)
    shared = (bands[:, 0] == bands[:, 1]).any(axis=1)
    size = near_dedup.BANDS * near_dedup.ROWS
    prints = (near_dedup.mix(signature.view(np.uint64)) >> np.uint64(56)).reshape(-1, 2, size)
    least = (0.8 - near_dedup.DEVIATIONS * math.sqrt(0.8 * 0.2 / size)) * size
    return int((shared & ((prints[:, 0] == prints[:, 1]).sum(axis=1) >= least)).sum())


def test_exact_duplicates_of_odd_rows(spark):
    got = exact_dedup.exact_duplicates(table(spark, ODD)).collect()
    assert len(got) == len(ODD)
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (of[1].keep_id, of[1].group_size, of[1].kept) == (2, 3, False) and of[2].kept
    assert (of[4].keep_id, of[4].group_size) == (5, 3) and of[6].group_size == of[7].group_size == 1
    lone = next(r for r in got if r.doc_id is None and r.keep_id is None)
    assert lone.kept and lone.group_size == 1
    assert exact_dedup.exact_duplicates(table(spark, [])).count() == 0


def test_exact_duplicates_do_not_depend_on_partitions(spark):
    docs = table(spark, [(i, f"text {i % 7 and i}") for i in range(500)])
    one = sorted(exact_dedup.exact_duplicates(docs.repartition(13), salts=3).collect())
    assert one == sorted(exact_dedup.exact_duplicates(docs.coalesce(1)).collect())


def test_common_lines_go_and_others_stay(spark):
    rows = [(i, f"own line {i}\n  Subscribe now \nanother {i}\n\n", f"site{i % 12}") for i in range(24)]
    rows += [(100, None, "a"), (101, "Subscribe now", None), (102, "rare\nrare", "b"), (None, "Subscribe now\nx", "c"), (102, "rare\nrare", "b")]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, source string, line string")
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got[3].text == "own line 3\nanother 3\n\n" and (got[3].lines, got[3].lines_removed) == (5, 1)
    assert got[100].text is None and got[101].text == "" and got[102].text == "rare\nrare" and got[None].text == "x"
    few = docs.where("doc_id < 9")
    assert all(r.lines_removed == 0 for r in line_dedup.remove_boilerplate(few).collect())
    assert line_dedup.remove_boilerplate(docs.where("false")).count() == 0


@pytest.mark.parametrize("least", [2, 5, 40])
def test_lines_match_brute_force(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(f"line {int(rng.paretovariate(0.4))}" for _ in range(6)), f"s{rng.randrange(60)}") for i in range(300)]
    sites = {}
    for _, text, site in rows:
        for line in text.split("\n"):
            sites.setdefault(line, set()).add(site)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.remove_boilerplate(docs, least).collect()}
    assert got == {i: "\n".join(x for x in t.split("\n") if len(sites[x]) < least) for i, t, _ in rows}


def contaminated_by_brute_force(docs, items):
    found = set()
    for item, text in items:
        want = bag(text)
        m = sum(want.values())
        for i, body in docs:
            w = re.sub(r"[\W_]+", " ", (body or "").lower()).split()
            n = m + 4 if len(re.sub(r"[\W_]+", " ", (text or "").lower()).split()) >= 5 else len((text or "").split())
            spans = [" ".join(w[k : k + n]) for k in range(max(1, len(w) - n + 1))]
            if m and any(similarity(bag(s), want) >= 0.8 for s in spans):
                found.add((i, item))
    return found


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"q{rng.randrange(900)}" for _ in range(rng.randrange(12, 60)))) for k in range(12)] + [(50, "the the the the the the the the the"), (51, None), (52, "")]
    docs = []
    for i in range(60):
        body = [f"w{rng.randrange(900)}" for _ in range(rng.randrange(0, 200))]
        if i % 3:
            words = items[rng.randrange(12)][1].split()
            at = rng.randrange(len(body) + 1)
            body[at:at] = varied(rng, words, rng.randrange(0, 2 + len(words) // 25)).split()
        docs.append((i, " ".join(body)))
    docs += [(200, "The, the THE the the the the the the the"), (201, None), (202, "")]
    bench = spark.createDataFrame([(*x, "c") for x in items + items[:2]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(table(spark, docs + docs[:5]), bench).collect()}
    assert got == contaminated_by_brute_force(docs, items)
    assert decontamination.contaminated(table(spark, []), bench).count() == 0
    assert decontamination.contaminated(table(spark, docs), bench.where("false")).count() == 0


def best_window(body, item):
    """The greatest similarity of an item-sized window of body, by trying all."""
    w, want = body.lower().split(), bag(item)
    n = sum(want.values()) + 4
    return max(similarity(bag(" ".join(w[k : k + n])), want) for k in range(max(1, len(w) - n + 1)))


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_moved_and_repeated_passages_are_found_in_their_best_window(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", broadcast)
    w = lambda name, n: [f"{name}{k}" for k in range(n)]
    item, other = w("i", 60), w("o", 40)
    halves = w("x", 80) + item[30:] + item[:30] + w("y", 80)
    rows = [
        (1, halves), (2, w("x", 9) + item[6:] + item[:6] + w("z", 30)), (3, item[:30] + ["new"] + item[30:]), (4, item + w("y", 5) + item), (4, other),
        (None, item), (None, w("clean", 70)), (5, w("long", 25_000) + item + w("more", 25_000)), (6, item[:50]), (7, w("clean", 70)), (8, item[:40] + w("x", 20)),
    ]
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other))], "item_id long, text string")
    got = decontamination.contaminated(table(spark, [(i, " ".join(t)) for i, t in rows]), items).collect()
    want = {}
    for i, t in rows:
        for k, x in ((1, item), (2, other)):
            best = best_window(" ".join(t), " ".join(x)) if i != 5 or k == 1 else 0
            if best >= 0.8:
                want[i, k] = max(best, want.get((i, k), 0))
    assert {(r.doc_id, r.item_id) for r in got} == set(want) and len(got) == len(want)
    assert all(r.similarity == pytest.approx(want[r.doc_id, r.item_id]) for r in got)
    assert (1, 1) in want and (4, 1) in want and (4, 2) in want and (None, 1) in want


def test_decontamination_is_the_same_with_a_joined_benchmark(spark, monkeypatch):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = table(spark, [(1, "so one two three four five six seven eight nine ten end"), (None, "one two three four five six seven eight nine ten")])
    small = sorted(decontamination.contaminated(docs, items).collect(), key=str)
    monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    assert sorted(decontamination.contaminated(docs, items).collect(), key=str) == small and len(small) == 2


def test_texts_that_repeat_an_item_cost_no_more_than_their_length(spark):
    rng = random.Random(3)
    item = [f"i{k}" for k in range(60)]
    word = ["the"] * 70
    noise = [f"n{rng.randrange(5000)}" for _ in range(20_000)]
    rows = [(1, item * 333), (2, noise), (3, ["the"] * 20_000), (4, noise + item[:50] + ["x"] + noise + item + noise), (5, (item[:30] + ["y"] * 3) * 300)]
    docs = table(spark, [(i, " ".join(t)) for i, t in rows])
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(word))], "item_id long, text string")
    contaminated = lambda only: decontamination.contaminated(docs.where(only), items).collect()
    contaminated("doc_id = 2")
    start = time.perf_counter()
    assert contaminated("doc_id = 2") == []
    clean = time.perf_counter() - start
    start = time.perf_counter()
    got = {(r.doc_id, r.item_id): (r.similarity, r.hamming, r.start_word) for r in contaminated("doc_id != 2")}
    assert got == {(1, 1): (1.0, 0, 0), (3, 2): (1.0, 0, 0), (4, 1): (1.0, 0, 40_051)}
    assert time.perf_counter() - start < clean + 15  # some seconds on an idle machine


def test_the_sweep_counts_what_each_window_shares(spark):
    rng = random.Random(8)
    rows, copies, want = [], [], {}
    for key in range(40):
        bag = [rng.randrange(6) for _ in range(rng.randrange(3, 12))]
        text = [rng.randrange(8) for _ in range(rng.randrange(3, 40))]
        width, need = min(len(text), len(bag)), rng.randrange(1, 4)
        hits = [(x, i) for i, x in enumerate(text) if x in bag]
        rows.append((bytes([key]), key, len(text), width, need, hits))
        copies += [(key, x, bag.count(x)) for x in set(bag)]
        shared = [sum((Counter(text[s : s + width]) & Counter(bag)).values()) for s in range(len(text) - width + 1)]
        if max(shared) >= need:
            want[key] = [s for s, k in enumerate(shared) if k == max(shared) and (s == 0 or shared[s - 1] != k)]
    pairs = spark.createDataFrame(rows, "text_key binary, item_key long, n int, width int, need int, hits array<struct<shingle:long,at:int>>")
    got = decontamination.best_starts(pairs, spark.createDataFrame(copies, "item_key long, shingle long, copies long")).collect()
    assert {r.item_key: r.starts for r in got} == want
