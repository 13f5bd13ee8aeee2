"""Packing of tokenised documents into sequences: first-fit decreasing over a tournament tree."""

from __future__ import annotations

import json
import math
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import written

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ticket long"
#: Longest run without a change between space and other characters that is merged by rank.
LONGEST = 2000
#: Settings of a BPE model that must be unset for merging by rank.
ODD_MODEL = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
# How byte-level tokenizers of this make cut texts, and characters that are white space everywhere.
PIECES_OF_TEXT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACES = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u3000"


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each length: longest first, each into the first bin with room.

    A tournament tree holds the largest room of each range of bins, so the first bin that fits is found in
    one walk from the root. Equal lengths keep their order.
    """
    n = len(lengths)
    leaves = 1 << max(0, n - 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * n, [0] * n
    for i in sorted(range(n), key=lambda i: -lengths[i]):
        need, node = lengths[i], 1
        while node < leaves:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= need
        node >>= 1
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node >>= 1
    return bins, offsets


@cache
def kinds() -> np.ndarray:
    """By code point: 1 for a character that was in Unicode 3.2 and is of the same kind now, 2 for such a space, 0 for any other."""
    old, out = unicodedata.ucd_3_2_0.category, np.zeros(0x20000, np.uint8)
    for i in range(len(out)):
        c = chr(i)
        was, now = old(c), unicodedata.category(c)
        if now not in ("Cn", "Cs", "Co") and (was[0] if was[0] in "LN" else "") == (now[0] if now[0] in "LN" else "") and (was == "Cn") == (now == "Cn"):
            out[i] = 1 if was not in ("Zs", "Zl", "Zp") and not c.isspace() else 2 if c in SPACES else 0
    return out


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: visible Latin-1 characters stand for themselves, the others
    follow from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, equal to those that the tokenizer file gives for the whole text.

    The file is a byte-level BPE whose token numbers are the order of its merges, so tiktoken's merging by rank finds the
    same ids, in a seventh of the time. It gets the texts that both surely cut alike: those of characters that
    have been of one kind (letter, number, space or other) since Unicode 3.2, and without a run of over LONGEST characters
    between changes from space to not; between added tokens, which keep their own ids. Any other text, and all texts if the file is of
    another make, go through the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path, self.ranked, self.added = path, None, None
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, cut, added = made["model"], made.get("pre_tokenizer") or {}, made.get("added_tokens") or []
        ids = model.get("vocab")
        if model.get("type") != "BPE" or made.get("normalizer") or made.get("post_processor") or any(model.get(k) for k in ODD_MODEL):
            return
        if (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) != ("ByteLevel", False, True):
            return
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            return
        names = {t["content"] for t in added}
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
        ordered = sorted((w for w in ids if w not in names), key=ids.get)
        if ordered[256:] != merged or {len(w) for w in ordered[:256]} != {1} or [ids[w] for w in ordered] != list(range(len(ordered))):
            return
        import tiktoken

        byte = byte_letters()
        ranks = {bytes(byte[c] for c in w): ids[w] for w in ordered}
        self.ranked = tiktoken.Encoding("ranked", pat_str=PIECES_OF_TEXT, mergeable_ranks=ranks, special_tokens={})
        self.kinds = kinds()
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    @cached_property
    def tokenizer(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _plain(self, text: str) -> bool:
        if self.ranked is None:
            return False
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points) or points.max() >= len(self.kinds):
            return not len(points)
        kind = self.kinds[points]
        space = kind == 2
        turns = np.flatnonzero(space[1:] != space[:-1])
        return bool(kind.all()) and bool(np.diff(turns, prepend=-1, append=len(points) - 1).max() <= LONGEST)

    def __call__(self, text: str) -> bytes:
        if not self._plain(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(self.added.get(p) or self.ranked.encode_to_numpy(p).astype("<u4").tobytes() for p in parts if p)


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ids (null text: none) and end_id, cut into pieces of at most capacity.

    The ticket is a hash of the document and the piece's place in its task; it randomises the groups.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, end, seen = Encoder(tokenizer), struct.pack("<I", end_id), 0
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    ticket = zlib.crc32(f"{doc_id} {start} {seen}".encode())
                    out.append((doc_id, start, len(part) // 4, zlib.crc32(part), total, ticket))
                    seen += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ticket"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] or [pa.array([], pa.int64())] * 6, names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, group_pieces: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Pieces are dealt to groups at random, about group_pieces to a group whatever the
    input's size, and each group is packed by itself with first-fit decreasing. Sequence ids are unique over all
    groups. The pieces (numbers only) are written to the shared folder first, so that a lost
    executor can't change a ticket between the count and the packing.

    Null or empty text: the end id alone. Very long texts: as many pieces as they need. Null ids stay
    null; repeated rows are packed one by one. No rows: no rows. Other columns are not read.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity, id_col=id_col, text_col=text_col), "pieces")
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "ticket", "doc_id", "start"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].tolist(), capacity)
        ids = [b * groups + int(frame["ticket"].iloc[0]) % groups for b in bins]
        return frame.assign(sequence_id=ids, offset=offsets).drop(columns=["ticket", "pack_group"])

    return (
        pieces.withColumn("pack_group", F.pmod("ticket", F.lit(groups)))
        .groupBy("pack_group")
        .applyInPandas(fill, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    )
