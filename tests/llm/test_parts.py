"""Packing, sharding, archives, page texts, languages and licences: round trips, brute force and odd inputs."""

import gzip
import html
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from tokenizers import Tokenizer

from lectern.llm import html_text, language_id, licenses, packing, sharding, warc
from lectern.llm.queries import tokenizer_path

ODD = [(None, None), (1, None), (2, ""), (3, "A b ß"), (3, "A b ß"), (4, "word " * 9000), (5, "  two  spaces\n\nand lines "), (6, "x")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in rows], "doc_id long, text string, lang string, shard long")


PLAIN = Tokenizer.from_file(tokenizer_path())


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids + [1]


def test_pieces_hold_each_id_once_and_sequences_have_no_gap(spark):
    rows = ODD + [(100 + i, f"document {i} " * (i % 90)) for i in range(300)]
    got = packing.pack(table(spark, rows), tokenizer_path(), group_pieces=64).collect()
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        ids, at = ids_of(text), 0
        for r in sorted({(x.start, x.length, x.ids_crc32, x.doc_tokens) for x in of[doc_id]}):
            assert r[0] == at and r[3] == len(ids)
            assert r[2] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r[1]]))
            at += r[1]
        assert at == len(ids)
    assert len(of[3]) == 2
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(table(spark, []), tokenizer_path()).count() == 0


def test_first_fit_decreasing_matches_a_plain_search():
    rng = random.Random(2)
    for capacity in (10, 64, 100):
        lengths = [rng.randint(1, capacity) for _ in range(200)]
        room, want = [], [None] * len(lengths)
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(capacity)
            want[i] = (k, capacity - room[k])
            room[k] -= lengths[i]
        assert list(zip(*packing.first_fit_decreasing(lengths, capacity), strict=True)) == want


@pytest.mark.parametrize("text", ["a b", " a b", "a  b", "a\tb c", "don't stop", "a \n b", "b  c d", "é ü　x y", "a b ", "1 2 34", "<|endoftext|> a b"])
def test_words_are_encoded_as_in_the_whole_text(text):
    encode = packing.Encoder(tokenizer_path())
    ids = PLAIN.encode(text, add_special_tokens=False).ids
    assert encode(text) == b"".join(i.to_bytes(4, "little") for i in ids) == encode(text)


def test_ids_are_those_of_the_plain_tokenizer(spark):
    plain = Tokenizer.from_file(tokenizer_path())
    assert plain.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|> a", "a<|endoftext|>b c", "a b <|endoftext|>", "a <|endoftext|><|endoftext|> b", "a  <|endoftext|>  b", "<| endoftext |> a"]
    encode = packing.Encoder(tokenizer_path())
    got = {r.doc_id: r for r in packing.pack(table(spark, enumerate(texts)), tokenizer_path()).collect()}
    for i, text in enumerate(texts):
        ids = b"".join(k.to_bytes(4, "little") for k in plain.encode(text, add_special_tokens=False).ids)
        assert encode(text) == encode(text) == ids
        assert (got[i].ids_crc32, 4 * got[i].doc_tokens) == (zlib.crc32(ids + (1).to_bytes(4, "little")), len(ids) + 4)


def test_ids_of_random_texts_are_those_of_the_tokenizer():
    encode, rng, merged = packing.Encoder(tokenizer_path()), random.Random(1), 0
    pool = ["a", "b", " ", "  ", "\n", "\t", "'s", "'LL", "é", "ß", "ком", "日本", "1", "٣", "²", "😀", "\u200b", "\u00a0", "\x85", "\x1c", "<|endoftext|>", "<|end", "\u0301", "\ua7ca", "\x00"]
    for _ in range(4000):
        text = "".join(rng.choices(pool, k=rng.randrange(14)))
        merged += encode._plain(text)
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in PLAIN.encode(text, add_special_tokens=False).ids)
    assert 400 < merged < 3600
    for text in ["a" * 50_000, " " * 50_000, "ab " * 20_000]:
        assert encode(text) == b"".join(i.to_bytes(4, "little") for i in PLAIN.encode(text, add_special_tokens=False).ids)


def choice(doc_id, shards):
    seed = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
    scores = [-math.log(((xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed) >> 11) + 0.5) / 2**53) for k in range(shards)]
    return min(range(shards), key=lambda k: (scores[k], k))


def test_archives_are_bounded_by_bytes(spark, tmp_path):
    assert warc.size_classes(15_000, 1 << 30) == [(214748, 15_000), (3441480, 936), (56512727, 57), (1 << 30, 3)]
    sizes = [10, 400, 5000, 5001, 90_000, 1_000_000]
    pages = spark.createDataFrame([(k, f"u{k}", str(k) * size) for k, size in enumerate(sizes)] + [(50 + k, "v", "x" * 10) for k in range(40)], "page_id long, url string, html string")
    warc.write_archives(pages.repartition(1), str(tmp_path / "a"), per_file=48, most_bytes=80_000)
    files = [(f.parent.name, gzip.decompress(f.read_bytes())) for f in (tmp_path / "a").glob("size=*/*.gz")]
    assert {name for name, _ in files} == {"size=0", "size=1"}
    for name, data in files:
        pages_in = data.count(b"WARC-Type: metadata")
        assert pages_in <= (16 if name == "size=0" else 1) and (len(data) < 80_000 + 3000 * pages_in or pages_in == 1)
    got = {r.page_id: r.payload_bytes for r in warc.round_trip(pages).collect()}
    assert got == {k: size for k, size in enumerate(sizes)} | {50 + k: 10 for k in range(40)}


@pytest.mark.parametrize("run", [1, 7, 65_536])
def test_hot_ids_and_equal_rows_are_split_and_numbered_without_gaps(spark, run):
    rows = [(None, f"text {k % 200}") for k in range(600)] + [(5, f"t{k}") for k in range(300)] + [(6, "same")] * 50
    got = sharding.rendezvous_shards(table(spark, rows), run=run).collect()
    assert len(got) == len(rows) and {r.shard for r in got if r.doc_id is None} == {choice(None, 16)}
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    equal = sorted(r.slot for r in got if r.doc_id == 6)
    assert equal == list(range(equal[0], equal[0] + 50))


def test_shards_match_brute_force(spark):
    rows = ODD + [(i, f"t{i}") for i in range(100, 900)]
    got = sharding.rendezvous_shards(table(spark, rows), cells=8).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.shard, r.grown_shard) == (choice(r.doc_id, 16), choice(r.doc_id, 17)) and r.grown_shard in (r.shard, 16) and r.law == "key"
    texts = dict(rows)
    assert all((r.size, r.text_crc32) == (len((texts[r.doc_id] or "").encode()) + 1, zlib.crc32((texts[r.doc_id] or "").encode())) for r in got)
    for shard in range(16):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sharding.rendezvous_shards(table(spark, [])).count() == 0


PAGES = "page_id long, url string, html string, digest string, first string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "c", "c") for r in rows], PAGES)


def test_archives_round_trip(spark, tmp_path):
    long = "<p>" + "text ß " * 40
    rows = [(5, "http://a/\r\nx", long), (3, None, long), (9, "http://c", long), (1, "http://d", None), (2, "http://e", ""), (7, "http://f", "short"), (8, "http://g", "short"), (10, "u", "WARC/1.1\r\n\r\n\r\n" * 20)]
    rows += [(11, "u", long * 3000)]
    got = {r.page_id: r for r in warc.round_trip(pages(spark, rows), f"file://{tmp_path}/w").collect()}
    assert len(got) == len(rows) and all(r.digest_ok and r.request_id for r in got.values())
    assert all(got[i].payload_bytes == len((h or "").encode()) for i, _, h in rows)
    assert (got[3].record_type, got[5].record_type, got[5].refers_to, got[9].refers_to) == ("response", "revisit", 3, 3)
    assert got[7].record_type == got[8].record_type == "response" and got[7].refers_to is None
    assert got[5].target_uri == "http://a/%0D%0Ax" and got[3].target_uri is None
    assert warc.round_trip(pages(spark, []), f"file://{tmp_path}/none").count() == 0


PAGE = (
    "<html><head><title>t</title><style>p{}</style></head><body><nav class='menu'><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li></ul></nav>"
    "<article><h1>A  title &amp; more</h1><p>First paragraph with enough words in it,\n and a <a href='x'>link</a>.</p><script>var x;</script>"
    "<p>Second one &lt;here&gt; caf&eacute;, which is also quite long as texts go.</p></article>"
    "<div class='comments'><h3>Comments</h3><p>Nice article, thanks.</p></div><footer>&copy; 2024 Someone</footer></body></html>"
)
TEXT = "A title & more\nFirst paragraph with enough words in it, and a link.\nSecond one <here> café, which is also quite long as texts go."


def test_main_text_of_pages(spark):
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (None, "u", "<p"), (4, "u", deep), (4, "u", deep)]
    got = html_text.extract(pages(spark, rows)).collect()
    of = {r.page_id: r for r in got}
    assert len(got) == 6 and of[1].text == TEXT and of[2].text == of[3].text == ""
    assert all(r.n_chars == len(r.text) for r in got)
    assert html_text.extract(pages(spark, [])).count() == 0


def test_trees_tell_drawn_pages_they_have_not_seen():
    rng, right, n = random.Random(99), 0, 0
    for _ in range(60):
        nodes = html_text.parse(html_text.training_page(rng))
        keeps = html_text.decode(nodes, html_text.model().margin(html_text.describe(nodes)))
        assert all(keeps[nodes[i].parent] or not keeps[i] for i in range(1, len(nodes)))
        right += sum(k == x.marked for k, x in zip(keeps[1:], nodes[1:], strict=True))
        n += len(nodes) - 1
    assert right / n > 0.97


def test_decoding_is_the_likeliest_of_all_keep_sets():
    rng = random.Random(6)
    for _ in range(40):
        n = rng.randrange(2, 10)
        nodes = [html_text.Node("html", -1, 0)]
        for i in range(1, n):
            up = rng.randrange(i)
            nodes.append(html_text.Node(rng.choice(["div", "p", "svg"]), up, nodes[up].depth + 1))
            nodes[up].children.append(i)
        margins = np.array([rng.gauss(0, 2) for _ in nodes])
        best, likeliest = None, -math.inf
        for bits in itertools.product((False, True), repeat=n):
            if all(not keep or (nodes[i].tag not in html_text.UNSEEN and (i == 0 or bits[nodes[i].parent])) for i, keep in enumerate(bits)):
                value = sum(-math.log1p(math.exp(-m if keep else m)) for keep, m in zip(bits, margins, strict=True))
                if value > likeliest:
                    best, likeliest = list(bits), value
        assert html_text.decode(nodes, margins) == best


def test_trees_match_a_slow_walk():
    trees, rng = html_text.model(), np.random.default_rng(3)
    x = np.concatenate([html_text.describe(html_text.parse(html_text.training_page(random.Random(k)))) for k in range(3)])
    x = x[rng.permutation(len(x))[:60]]
    for row, got in zip(x, trees.margin(x), strict=True):
        total = trees.base
        for f, c, v in zip(trees.features, trees.cuts, trees.leaves, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - len(f)]
        assert got == pytest.approx(total)


def test_character_references_are_decoded_once():
    nodes = html_text.parse("<p>&amp;lt; a&nbsp;b</p>")
    assert html_text.render(nodes, [True] * len(nodes)) == html.unescape("&amp;lt; a b")


WORDS = {"aa": "bar bor bir bur", "bb": "zel zal zul zil", "cc": "ком кум кам ким"}


def test_languages_of_held_out_documents(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=rng.randint(1, 30))), lang, "c") for i in range(400) for lang in [rng.choice(list(WORDS))]]
    rows += [(900, None, "aa", "c"), (901, "", "aa", "c"), (902, "12 34 !", "bb", "c"), (None, "bar bor", None, "c"), (903, "zel " * 50_000, None, "c"), (903, "zel " * 50_000, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language_id.identify(docs, language_id.learn(docs, sample=50)).collect()
    assert len(got) == len(rows)
    of, lang = {r.doc_id: r for r in got}, {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in of.items() if i is not None)
    assert all(of[i].lang_pred == lang[i] for i in range(400)) and of[903].lang_pred == "bb" and of[None].lang_pred == "aa"
    assert {of[i].lang_pred for i in (900, 901, 902)} == {"und"} and all(0 <= r.score <= 1 for r in got)
    nothing = language_id.identify(docs, language_id.learn(docs.where("lang is null"))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert language_id.identify(docs.where("false"), None).count() == 0


def test_an_id_that_comes_often_is_one_document_of_the_sample(spark, monkeypatch):
    rng, drawn = random.Random(5), []
    least = min((i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2), key=lambda i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) - (xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) >> 63 << 64))
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=9)), lang, "c") for i in range(400) for lang in WORDS]
    rows += [(least, text, "aa", "c") for text in ["zel zal", "zul zil"] * 150]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, labels: drawn.append(labels) or fit(x, labels))
    model = language_id.learn(docs.repartition(7), sample=50)
    assert sorted(drawn[0]) == [lang for lang in WORDS for _ in range(50)]
    of = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame([(1, "bar bor"), (2, "zel zal"), (3, "ком кум")], "doc_id long, text string"), model).collect()}
    assert of == {1: "aa", 2: "bb", 3: "cc"}


def test_decoding_of_codewords_matches_plain_sums():
    rng = np.random.default_rng(4)
    for k in (2, 4, 7):
        code = language_id.codewords(k)
        bits = code.shape[1]
        model = language_id.Model([str(i) for i in range(k)], code, rng.normal(size=(6, bits)), rng.normal(size=bits), rng.uniform(0.1, 1, bits))
        x = rng.normal(size=(5, 6))
        for row, p in zip(x, model.decode(x), strict=True):
            margins = [sum(row[i] * model.weights[i, b] for i in range(6)) + model.bias[b] for b in range(bits)]
            e = [math.exp(-sum(model.trust[b] * math.log1p(math.exp(-margins[b] * code[lang, b])) for b in range(bits))) for lang in range(k)]
            assert list(p) == pytest.approx([v / sum(e) for v in e])


def test_letters_beyond_the_third_plane_count_and_the_sample_is_bounded(spark, monkeypatch):
    assert language_id.features("\U00030000") is not None and language_id.features("12 !") is None
    rng, drawn = random.Random(9), []
    rows = [(i, " ".join(rng.choices(WORDS[lang].split(), k=6)), lang) for i in range(3000) for lang in [list(WORDS)[i % 3]]] + [(8, "bar bor", "aa")] * 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fit = language_id.fit
    monkeypatch.setattr(language_id, "fit", lambda x, labels: drawn.append(len(labels)) or fit(x, labels))
    language_id.learn(docs, sample=50)
    language_id.learn(docs, sample=50, most=30)
    assert drawn == [150, 30]


def test_codewords_are_apart():
    for k in (2, 3, 5, 8, 20):
        code = language_id.codewords(k)
        assert len({tuple(c) for c in code}) == k


def test_licences_follow_their_rules(spark):
    known = licenses.SENTENCES
    mit = ".\n".join(known[x][0] for x in ("mit-grant", "mit-notice", "mit-warranty"))
    wrapped = mit.replace(" of ", "\nof ")
    broken = ".\n".join(known[x][0] for x in ("mit-grant", "mpl-ref", "mit-warranty"))
    rows = [(1, f"Intro.\n\n{mit}."), (2, wrapped), (3, broken), (4, None), (5, ""), (6, "plain text " * 9000), (7, "released under the mit license!"), (7, "released under the mit license!"), (None, mit)]
    got = {r.doc_id: r for r in licenses.scan(table(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 7, None}
    assert got[1].licenses == got[2].licenses == got[7].licenses == got[None].licenses == "MIT" and got[3].licenses == "MPL-2.0"
    assert got[1].evidence == "MIT text" and got[7].evidence == "MIT reference"
    assert licenses.scan(table(spark, [])).count() == 0


def test_tags_of_several_licences_are_tags_of_each_and_titles_are_references(spark):
    tag = "// SPDX-License-Identifier:"
    rows = {
        f"{tag} MIT OR Apache-2.0\nint x;": ("Apache-2.0, MIT", "Apache-2.0 tag, MIT tag"), f"/* {tag}  (MIT and (ISC OR Zlib)) */": ("ISC, MIT, Zlib", "ISC tag, MIT tag, Zlib tag"),
        f"{tag} GPL-2.0-only WITH Classpath-exception-2.0": ("GPL-2.0", "GPL-2.0 tag"), f"{tag} MIT\nmore\n{tag} BSD-3-Clause AND nothing": ("BSD-3-Clause, MIT", "BSD-3-Clause tag, MIT tag"),
        f"{tag} MIT": ("MIT", "MIT tag"), "The Artistic License 2.0": ("Artistic-2.0", "Artistic-2.0 reference"), "Eclipse Public License - v 2.0": ("EPL-2.0", "EPL-2.0 reference"),
        f"{tag} ORANGE": None, "MIT OR Apache-2.0": None,
    }
    got = {r.doc_id: (r.licenses, r.evidence) for r in licenses.scan(table(spark, list(enumerate(rows)))).collect()}
    assert got == {k: v for k, v in enumerate(rows.values()) if v}


def test_licences_of_many_kinds(spark):
    texts = {
        "GPL-2.0": "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.",
        "LGPL-2.1": "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999\n\nCopyright",
        "Apache-2.0": "// SPDX-License-Identifier: Apache-2.0\nint main;",
        "CC-BY-NC-4.0": "Text.\nThis work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Zlib": "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. x",
    }
    rows = [(7, text) for text in texts.values()] + [(8, "This program is free software: see the manual. Version 3, 29 June 2007")]
    got = licenses.scan(table(spark, rows)).collect()
    assert sorted(r.licenses for r in got) == sorted(texts) and {r.doc_id for r in got} == {7}
