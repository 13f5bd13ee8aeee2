"""Near-duplicate classes: BagMinHash signatures, bands, exact multiset overlap, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import among, written
from lectern.llm.shingles import with_shingles, words

BANDS, ROWS = 25, 5
#: Shingles that a task signs, or makes a set of, at a time; a longer document is taken by itself.
AT_A_TIME = 150_000
#: Deviations of a signature's estimate by which a pair may fall short of the threshold and still be verified.
DEVIATIONS = 3.6
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def counted(docs: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (document, shingle) pairs and how often each comes."""
    order = np.lexsort((shingles, docs))
    docs, shingles = docs[order], shingles[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (shingles[1:] != shingles[:-1])
    at = np.flatnonzero(new)
    return docs[at], shingles[at], np.diff(np.append(at, len(docs)))


def bag_minhash(docs: np.ndarray, shingles: np.ndarray, counts: np.ndarray, n_docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures, n_docs x size: two agree in a component with probability their weighted Jaccard.

    Weights are discretised by unit levels. The levels (0, 1], (1, 2], (2, 4], (4, 8], ... of a shingle each have a
    Poisson process of `size` times their width, whose points carry a component and a level; of a
    process that a weight cuts through, the points above the weight are thinned out, which is what halving its range down to
    the weight gives. A component's value is its first point. Points are drawn in order for all processes
    side by side; a process ends when it has passed the largest value of its document.
    """
    signature = np.full(n_docs * size, np.inf)
    parts, low, width = [], 0, 1
    while (above := counts > low).any():
        parts.append((docs[above], shingles[above], counts[above], np.full(above.sum(), low), np.full(above.sum(), width)))
        low, width = low + width, max(1, low + width)
    if not parts:
        return signature.reshape(n_docs, size)
    doc, shingle, count, low, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    seed, time, step = mix(shingle.view(np.uint64) ^ mix((low + 1).astype(np.uint64))), np.zeros(len(doc)), 0
    while len(doc):
        step += 1
        draw = mix(seed + np.uint64(int(GOLDEN) * step % 2**64))
        time = time - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (size * width)
        draw = mix(draw ^ GOLDEN)
        component = ((draw & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
        level = low + width * ((draw >> np.uint64(32)).astype(np.float64) / 2.0**32)
        fits = level < count
        np.minimum.at(signature, doc[fits] * size + component[fits], time[fits])
        on = time <= signature.reshape(n_docs, size).max(axis=1)[doc]
        doc, count, low, width, seed, time = (x[on] for x in (doc, count, low, width, seed, time))
    return signature.reshape(n_docs, size)


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = signature.view(np.uint64).reshape(-1, bands, rows)
    out = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), bits.shape[:2]))
    for k in range(rows):
        out = mix(out ^ bits[:, :, k])
    return out.view(np.int64)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + AT_A_TIME, side="right")) - 1)
        yield start, end
        start = end


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False), offsets


def _list_array(values: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def sign(bands: int, rows: int):
    """Batches of (row_id, key, shingles) to (row_id, key, bands, prints): band hashes, and a byte of each component. No
    shingles: empty lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _lists(batch.column(2))
            for start, end in _slices(offsets):
                span = offsets[start : end + 1]
                docs = np.repeat(np.arange(end - start), np.diff(span))
                signature = bag_minhash(*counted(docs, values[span[0] : span[-1]]), end - start, bands * rows)
                some = np.diff(span) > 0
                hashes = band_hashes(signature[some], bands, rows).ravel()
                lists = _list_array(hashes, np.append(0, np.cumsum(np.where(some, bands, 0))))
                part = batch.slice(start, end - start)
                prints = (mix(signature[some].view(np.uint64)) >> np.uint64(56)).astype(np.uint8).view(np.int8).ravel()
                ends = pa.array(np.append(0, np.cumsum(np.where(some, bands * rows, 0))), pa.int32())
                prints = pa.ListArray.from_arrays(ends, pa.array(prints, pa.int8()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, prints], ["row_id", "key", "bands", "prints"])

    return run


def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, shingles) to (key, units): the k-th copy of a shingle is a unit of its own, so bags become sets."""
    for batch in batches:
        values, offsets = _lists(batch.column(1))
        for start, end in _slices(offsets):
            span = offsets[start : end + 1]
            docs = np.repeat(np.arange(end - start), np.diff(span))
            doc, shingle, count = counted(docs, values[span[0] : span[-1]])
            copy = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            units = mix(np.repeat(shingle, count).view(np.uint64) + GOLDEN * copy.astype(np.uint64)).view(np.int64)
            lists = _list_array(units, np.append(0, np.cumsum(np.bincount(doc, weights=count, minlength=end - start).astype(np.int64))))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, end - start), lists], ["key", "units"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of the nodes of edges (a, b): least labels spread, and jump to their labels' labels."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        after = spread.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("far", "next")).alias("component"))
        after = written(after, "labels")
        labels = after.select("node", "component")
        if after.where("old != component").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text", small: int = 4096,
    tally: list[dict[str, int]] | None = None,
) -> DataFrame:
    """One row per row of docs: doc_id, class_id, class_size, kept.

    Classes are the connected components of links between texts whose multisets of five-word shingles have
    a Jaccard similarity of at least threshold; class_id is the least id of a class, and that document is kept.

    1. Texts with the same words are one text from here on, so copies cost nothing.
    2. Texts that share a band are candidates: at similarity 0.8 a pair shares none of 25 bands of 5 with probability
       1 in 20,000. No bucket is capped. The hub of a bucket is the text that meets most others in its buckets, such as
       the one that a group of near copies was made from. Each text is first verified against the
       greatest of its buckets' hubs.
    3. The links found join texts into components. Then each text is verified against the hubs of its buckets that
       lie in other components.
    4. Where a bucket still holds several components, its texts are told apart by the units (the k-th copies of shingles) in
       which they differ from the hub. A text isn't linked to the hub if it lies outside the hub's component, so it differs from it
       by more than a link allows, and the triangle inequality says how many of these units it must share with a text that it
       is linked to. Units are ordered by how few texts have them; only those that can be the first shared one are
       joined on, and only pairs for which enough units are left behind that one are verified. Units that no two components
       share come first and are never joined on.
    5. A unit that more than `small` texts would be joined on makes a group of its own, with one of its texts as
       hub, and steps 3 and 4 are done for it, until no unit is crowded. A group's own groups lack its hub at least, so that ends; no unit is
       joined on for more than `small` texts of a hub. So no link between classes is lost, and a bucket of n copies with changes of
       their own costs about n pairs, not n x n.
    6. Components are formed over all links.
    Before a candidate pair's texts are compared, its signatures must agree to within DEVIATIONS deviations of
    the threshold; a pair at 0.8 fails that with probability 1 in 6,000.

    Null, empty or wordless texts: a class each, by document id. Null ids: in their text's class, whose class_id
    ignores them; a class of null ids only has a null class_id. Repeated rows of an id count one by
    one in class_size. No rows: no rows. Other columns are not read. A tally gets the crowded units and the pairs made in each round.
    """
    base = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("text"))

    def keyed(df: DataFrame) -> DataFrame:
        key = F.unhex(F.md5(F.array_join(words(F.col("text")), " ")))
        return with_shingles(df, "text").withColumn("key", key).select("row_id", "key", "shingles")

    signed = written(keyed(base).mapInArrow(sign(bands, rows), "row_id long, key binary, bands array<long>, prints array<tinyint>"), "signatures")
    has = F.size("bands") > 0
    texts = signed.where(has).groupBy("key").agg(F.min(F.struct("row_id", "bands", "prints")).alias("t")).select("key", "t.*")
    texts = written(texts, "texts")
    banded = texts.select("key", F.explode("bands").alias("bucket"))  # a band's number is mixed into its hashes
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mates = written(banded.join(buckets, "bucket"), "buckets")
    met = mates.groupBy("key").agg(F.sum("n").alias("met"))
    ranked = written(mates.drop("n").join(met, "key"), "ranked-buckets")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("met", "key")).alias("h")).select("bucket", F.col("h.key").alias("hub"), F.col("h.met").alias("hub_met"))
    members = written(ranked.drop("met").join(hubs, "bucket"), "buckets")

    least_equal = (threshold - DEVIATIONS * math.sqrt(threshold * (1 - threshold) / (bands * rows))) * bands * rows
    wanted = written(members.select("key").distinct().join(texts.select("key", "row_id", "prints"), "key"), "wanted")
    prints = wanted.select("key", "prints")
    units = keyed(among(base, wanted, "row_id"))
    units = units.join(wanted.select("key"), "key", "left_semi").select("key", "shingles").dropDuplicates(["key"])
    units = written(units.mapInArrow(as_sets, "key binary, units array<long>"), "units")

    def alike(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: (a == b).cast("int")), F.lit(0), lambda n, e: n + e) >= least_equal

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), whose signatures agree, that are at the threshold."""
        left = units.select(F.col("key").alias("a"), F.col("units").alias("x"))
        right = units.select(F.col("key").alias("b"), F.col("units").alias("y"))
        both = pairs.join(left, "a").join(right, "b").select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), F.size(F.array_intersect("x", "y")).alias("same"))
        return both.where(F.col("same") >= F.lit(threshold) * (F.col("m") + F.col("n") - F.col("same"))).select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        pairs = pairs.join(prints.select(F.col("key").alias("a"), F.col("prints").alias("pa")), "a").join(prints.select(F.col("key").alias("b"), F.col("prints").alias("pb")), "b")
        return linked(pairs.where(alike("pa", "pb")).select("a", "b"))

    def place(groups: DataFrame, parts: DataFrame) -> DataFrame:
        """groups (group, key, hub) with each text's component, and its hub's (main)."""
        of = parts.select(F.col("node").alias("key"), "component")
        of_hub = parts.select(F.col("node").alias("hub"), F.col("component").alias("main"))
        placed = groups.join(of, "key", "left").join(of_hub, "hub", "left")
        return placed.select("group", "key", "hub", F.coalesce("component", "key").alias("component"), F.coalesce("main", "hub").alias("main"))

    def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
        return parts if links.isEmpty() else components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))

    def told_apart(spokes: DataFrame) -> DataFrame:
        """spokes (home, hub, key, component, main) to rows home, unit, key, component, main, size, d, pos: those of the d units in which a
        text and its hub differ that a link to a text of another component of its home could be the first to share."""
        both = spokes.join(units.select(F.col("key").alias("hub"), F.col("units").alias("h")), "hub").join(units, "key")
        both = both.select("home", "key", "component", "main", F.size("units").alias("size"), F.array_union(F.array_except("h", "units"), F.array_except("units", "h")).alias("apart"))
        both = written(both, "spokes")
        each = both.select("home", "key", "component", F.explode("apart").alias("unit"))
        shared = each.groupBy("home", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
        order = each.join(written(shared.select("home", "unit", "n"), "shared-units"), ["home", "unit"]).groupBy("home", "key").agg(F.sort_array(F.collect_list(F.struct("n", "unit"))).alias("order"))
        rows = both.select("home", "key", "component", "main", "size", F.size("apart").alias("d")).join(order, ["home", "key"])
        rows = rows.select("home", "key", "component", "main", "size", "d", (F.col("d") - F.size("order")).alias("before"), F.posexplode("order").alias("at", "o"))
        rows = rows.select("home", "o.unit", "key", "component", "main", "size", "d", (F.col("before") + F.col("at")).alias("pos"))
        return rows.where(F.col("pos") <= (1 - threshold) / threshold * F.col("size") + 1e-6)

    def paired(rows: DataFrame) -> DataFrame:
        """The pairs (a, b) of texts of other components, at least one outside its hub's, that can be links by what told_apart() says."""
        other = rows.where("component != main").select("home", "unit", *[F.col(c).alias(f"{c}_") for c in ("key", "component", "size", "d", "pos")])
        room = F.least(F.col("d") - F.col("pos"), F.col("d_") - F.col("pos_"))
        least_shared = (F.col("d") + F.col("d_") - (1 - threshold) / (1 + threshold) * (F.col("size") + F.col("size_"))) / 2
        could = (F.col("component_") != F.col("component")) & (least_shared <= room + 1e-6) & ((F.col("component") == F.col("main")) | (F.col("key_") < F.col("key")))
        pairs = other.join(rows, ["home", "unit"]).where(could)
        return pairs.select(F.least("key", "key_").alias("a"), F.greatest("key", "key_").alias("b")).distinct()

    others = members.where("key != hub")
    greatest = others.groupBy("key").agg(F.max(F.struct("hub_met", "hub"))["hub"].alias("hub"))
    parts = components(written(verified(greatest.select(F.col("hub").alias("a"), F.col("key").alias("b"))), "links"))
    groups = members.select(F.col("bucket").alias("group"), "key", "hub")
    home = F.col("hub")  # the buckets of a hub are told apart at once, later groups each by itself
    while True:
        apart = place(groups, parts).where("component != main").select(F.col("hub").alias("a"), F.col("key").alias("b")).distinct()
        parts = joined(parts, written(verified(apart), "links"))
        placed = written(place(groups, parts), "placed")
        mixed = placed.where("component != main").select("group").distinct()
        spokes = placed.join(mixed, "group", "left_semi").where("key != hub").select(home.alias("home"), "hub", "key", "component", "main").distinct()
        told = written(told_apart(spokes), "told-apart")
        crowded = written(told.groupBy("home", "unit").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small).select("home", "unit"), "crowded-units")
        again = not crowded.isEmpty()
        pairs = written(paired(told.join(crowded, ["home", "unit"], "left_anti") if again else told), "pairs")
        if tally is not None:
            tally.append({"crowded": crowded.count(), "pairs": pairs.count()})
        parts = joined(parts, written(verified(pairs), "links"))
        if not again:
            break
        large = told.join(crowded, ["home", "unit"], "left_semi").select(F.xxhash64("home", "unit").alias("group"), "key")
        first = large.groupBy("group").agg(F.max(F.struct(F.xxhash64("key").alias("h"), "key"))["key"].alias("hub"))
        groups, home = written(large.join(first, "group"), "groups"), F.col("group").cast("string").cast("binary")

    alone = F.when(has, F.col("key")).otherwise(F.concat(F.lit("no words "), F.coalesce(F.col("row_id").cast("string"), F.lit("null"))).cast("binary"))
    rows_ = signed.select("row_id", alone.alias("key"))
    rows_ = rows_.join(parts.select(F.col("node").alias("key"), "component"), "key", "left").select("row_id", F.coalesce("component", "key").alias("component"))
    rows_ = written(rows_, "classes")
    classes = rows_.groupBy("component").agg(F.min("row_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return rows_.join(written(classes, "class-sizes"), "component").select(
        F.col("row_id").alias("doc_id"), "class_id", "class_size", F.col("row_id").eqNullSafe(F.col("class_id")).alias("kept")
    )
