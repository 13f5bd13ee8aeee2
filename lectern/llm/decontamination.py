"""Benchmark decontamination by SimHash of item-sized windows. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.scratch import among, written
from lectern.llm.shingles import with_shingles

BITS = 64
#: Largest Hamming distance of a candidate. Of two bags at weighted similarity 0.8 the expected distance
#: is about 10 bits with a deviation of about 3, so this is five deviations away.
RADIUS = 24
#: Benchmarks of up to this many shingles are broadcast (24 bytes each); larger ones are joined by shuffle.
BROADCAST_SHINGLES = 200_000


def simhash(bag: str) -> Column:
    """The 64-bit SimHash of an array of hashes: a repeated shingle votes as often as it comes."""
    return F.expr(  # coalesce: else joins on it get a filter for nulls, which computes it once more for each row
        f"coalesce(aggregate(sequence(0, {BITS - 1}), 0L, (f, b) -> f | shiftleft(cast("
        f"aggregate({bag}, 0L, (v, x) -> v + 2 * (shiftright(x, b) & 1L) - 1L) > 0L AS bigint), b)), 0L)"
    )


def blocks(print_: Column, radius: int) -> list[Column]:
    """radius + 1 disjoint blocks of the bits: two prints within radius agree in one block at least."""
    n = radius + 1
    edges = [BITS * k // n for k in range(n + 1)]
    return [F.shiftrightunsigned(print_, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in zip(edges, edges[1:], strict=False)]


def multiset(bag: Column) -> Column:
    """A bag as a set: the k-th copy of a hash becomes a hash of its own."""
    ordered = F.array_sort(bag)
    # The k-th copy stands k places behind the first place of its value.
    return F.transform(ordered, lambda x, i: F.xxhash64(x, i - F.array_position(ordered, x)))


def similar(same: Column, a: Column, b: Column) -> Column:
    """Weighted Jaccard of bags of a and b hashes with `same` in common: the sum of the lesser counts over that of the greater ones."""
    return same / (a + b - same)


def best_starts(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """pairs (text_key, item_key, n, width, need, hits array<struct<shingle, at>>) to text_key, item_key, width, starts: where the windows of `width`
    shingles begin that share most with the item, counted with its copies (item_key, shingle, copies), if that is `need` at least: the first
    of each run of such windows.

    A hit counts in the windows that hold it, unless they hold as many earlier hits of its shingle as the item has copies. These windows are
    an interval of starts, and a running sum over the ends of all intervals gives the shared shingles of every window. So
    the cost follows the number of hits, however often a text repeats an item.
    """
    each = pairs.select("text_key", "item_key", "n", "width", "need", F.explode("hits").alias("h")).select("text_key", "item_key", "n", "width", "need", "h.shingle", "h.at")
    each = each.join(copies, ["item_key", "shingle"]).groupBy("text_key", "item_key", "n", "width", "need", "copies", "shingle").agg(F.array_sort(F.collect_list("at")).alias("ats"))
    low = lambda at, k: F.greatest(F.lit(0), at - F.col("width") + 1, F.when(k >= F.col("copies"), F.get("ats", (k - F.col("copies")).cast("int")) + 1).otherwise(0))
    spans = F.transform("ats", lambda at, k: F.struct(low(at, k).alias("low"), F.least(at, F.col("n") - F.col("width")).alias("high")))
    spans = F.filter(spans, lambda s: s["low"] <= s["high"])
    ends = F.explode(F.flatten(F.transform(spans, lambda s: F.array(F.struct(s["low"].alias("at"), F.lit(1).alias("by")), F.struct((s["high"] + 1).alias("at"), F.lit(-1).alias("by"))))))
    turns = each.select("text_key", "item_key", "n", "width", "need", ends.alias("e")).groupBy("text_key", "item_key", "n", "width", "need", "e.at").agg(F.sum("e.by").alias("by")).where("by != 0")
    text = Window.partitionBy("text_key", "item_key")
    shared = turns.withColumn("shared", F.sum("by").over(text.orderBy("at"))).withColumn("most", F.max("shared").over(text))
    best = shared.where((F.col("shared") == F.col("most")) & (F.col("shared") >= F.col("need")))
    return best.groupBy("text_key", "item_key", "width").agg(F.sort_array(F.collect_list("at")).alias("starts"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, similarity, hamming, start_word, n_shingles.

    An item of m shingles is sought in windows of m shingles of a document (the whole document, if that is shorter).

    1. A window at the threshold lacks so few of an item's shingles that it must hold one of the item's rarest, as many of these as
       exceed that number by one (repeats counted). Texts meet items there only.
    2. In a text that has met an item, the places of the item's shingles are found, and one sweep of them tells for every item-sized
       window how many shingles it shares with the item (see best_starts()). The windows that share most are laid, if that is enough for the
       threshold: of a run of such windows the first, as windows that share as much are as similar.
    3. Each window's SimHash meets the item's in one of radius + 1 blocks of bits, keyed by the item, which misses no print
       within the radius; a pair at the threshold lies beyond it about once in a million times.
    4. The exact weighted similarity of the two bags of shingles decides, worked out once for each window that has come so far. Of the windows
       laid for a pair the most similar is returned, then the nearest print, then the first.

    What a text holds depends on it alone, so texts are known by their MD5, and copies are sought through once.
    Benchmarks of up to BROADCAST_SHINGLES shingles are broadcast. For larger ones a bitmap of bounded size drops most places of
    texts before they are shuffled to the items; results are the same.

    Null, empty or wordless texts, on either side: no rows. Texts of one to four words match texts of the same
    words only. Very long texts are read whole. Null ids are kept as a value. Repeated rows, on either side: as one; rows of one id with
    different texts: one row for each item that any of them holds, with the best window. Empty tables: no rows. Other columns are not read.
    """
    items = with_shingles(benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")), "text", "bag")
    items = items.where(F.size("bag") > 0).select("item_id", "bag", F.xxhash64("item_id", F.array_join("bag", " ")).alias("item_key")).distinct()
    items = written(items.select("item_key", "item_id", "bag", F.size("bag").cast("int").alias("m"), simhash("bag").alias("item_print"), multiset(F.col("bag")).alias("item_set")), "benchmark")
    need = lambda n: F.ceil(F.lit(threshold) / (1 + threshold) * (F.col("m") + n) - 1e-9).cast("int")

    each = items.select("item_key", "m", F.explode("bag").alias("shingle")).groupBy("item_key", "m", "shingle").agg(F.count(F.lit(1)).alias("copies"))
    common = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    rarest = Window.partitionBy("item_key").orderBy("items", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(common, "shingle").withColumn("before", F.coalesce(F.sum("copies").over(rarest), F.lit(0)))
    # A text of fewer shingles needs at least as many shared ones of an item as its size times the threshold: so m * threshold bounds all.
    anchors = written(each.where(F.col("before") <= F.col("m") - F.ceil(F.col("m") * threshold - 1e-9)).select("shingle", "item_key"), "anchors")

    key = F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", key)
    # Outer explodes: for the others Catalyst adds a filter that would compute the shingles again, inside itself.
    places = with_shingles(texts.select("text_key", "text"), "text").select("text_key", F.explode_outer("shingles").alias("shingle"))
    if anchors.count() <= BROADCAST_SHINGLES:
        met = places.join(F.broadcast(anchors), "shingle")
    else:
        met = among(places, anchors, "shingle").join(anchors, "shingle")
    met = written(met.select("text_key", "item_key").distinct(), "met-items")

    # One text of each key, before the join that finds the wanted ones.
    wanted = among(texts.select("text_key", "text"), met, "text_key").groupBy("text_key").agg(F.min("text").alias("text"))
    some = written(with_shingles(wanted, "text").select("text_key", "shingles"), "met-texts")
    small = F.broadcast if items.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0] <= BROADCAST_SHINGLES else (lambda df: df)
    n = F.size("shingles")
    width = F.least(n, F.col("m"))
    pairs = met.join(some, "text_key").join(small(items.select("item_key", "m", "bag")), "item_key")
    hits = F.filter(F.transform("shingles", lambda x, i: F.struct(x.alias("shingle"), i.alias("at"))), lambda h: F.array_contains("bag", h["shingle"]))
    pairs = pairs.select("text_key", "item_key", n.alias("n"), width.alias("width"), need(width).alias("need"), hits.alias("hits"))
    pairs = written(pairs.where(F.size("hits") >= F.col("need")), "met-places")
    starts = written(best_starts(pairs, small(each.select("item_key", "shingle", "copies"))), "starts")

    windows = starts.join(some, "text_key").select("text_key", "item_key", "width", "shingles", F.explode("starts").alias("start"))
    window = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda k: F.get("shingles", F.col("start") + k))
    windows = windows.select("text_key", "item_key", "start", window.alias("window"))
    windows = written(windows.withColumn("print", simhash("window")), "windows")

    keyed = lambda name: F.posexplode(F.array(*blocks(F.col(name), radius))).alias("block", "value")
    index = items.select("item_key", "item_print", keyed("item_print"))
    apart = F.col("print").bitwiseXOR(F.col("item_print"))
    first = F.coalesce(*[F.when(b == 0, F.lit(k)) for k, b in enumerate(blocks(apart, radius))])
    near = windows.select("text_key", "item_key", "start", "print", keyed("print")).join(small(index), ["item_key", "block", "value"])
    near = near.where((F.col("block") == first) & (F.bit_count(apart) <= radius)).select("text_key", "item_key", "start", F.bit_count(apart).alias("hamming"))
    near = written(near, "near-windows")

    # The similarity is worked out once for each window that came through, by an inner join of narrow rows.
    both = near.join(windows.drop("print"), ["text_key", "item_key", "start"]).join(small(items.select("item_key", "item_id", "item_set", "m")), "item_key")
    same = F.size(F.array_intersect("item_set", multiset(F.col("window"))))
    near = both.select("text_key", "item_id", "start", "m", "hamming", similar(same, F.col("m"), F.size("window")).alias("similarity"))
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("near"), (-F.col("start")).alias("early"), F.col("m").alias("n_shingles")))
    found = written(near.where(F.col("similarity") >= threshold).groupBy("text_key", "item_id").agg(best.alias("best")), "held-items")
    rows = among(texts.select("doc_id", "text_key"), found, "text_key").distinct().join(found, "text_key")
    return (
        rows.groupBy("doc_id", "item_id")
        .agg(F.max("best").alias("best"))
        .select(
            "doc_id", "item_id", "best.similarity", (-F.col("best.near")).alias("hamming"),
            (-F.col("best.early")).cast("int").alias("start_word"), "best.n_shingles",
        )
    )
