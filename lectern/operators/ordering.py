"""Numbers, running sums and greedy packing along one order of all rows, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.shared import written

#: Budgets that a block of units spans, in greedy_runs().
SPAN = 64


def running(rows: DataFrame, order: list[str], sums: dict[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """rows with place (0, 1, ... by `order`, which tells all rows apart), and for each of sums (name: column) what the rows before add up to.

    Rows are dealt to ranges of the order (as many as there are shuffle partitions, if `ranges` doesn't say) and written, so that they stay where they are. A window runs
    within each range, and the ranges' own sums, a row each, give the offsets. So a range is all that a task holds.
    """
    sums = {"place": None, **(sums or {})}
    value = lambda c: F.lit(1).cast("long") if c is None else F.col(c).cast("long")
    ranged = written(rows.repartitionByRange(*([ranges] if ranges else []), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # of one row for each range
    totals = ranged.groupBy("_part").agg(*[F.sum(value(c)).alias(f"_{name}") for name, c in sums.items()])
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums])
    own = ranged.select("*", *[F.coalesce(F.sum(value(c)).over(inside), F.lit(0)).alias(name) for name, c in sums.items()])
    return own.join(F.broadcast(offsets), "_part").select(*rows.columns, *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in sums])


def greedy_runs(units: DataFrame, order: list[str], budget: int, most: int) -> DataFrame:
    """units (order, tokens of 1 at least) with run: 0, 1, ...; a new run begins where a unit's tokens would exceed budget, or units `most`; a unit over the
    budget is a run by itself. The runs are those of one walk over all units in their order, but no task makes that walk.

    1. Running sums tell for each unit where the run would end that began with it: an interval of the sum, looked up in blocks of
       SPAN budgets, each with a budget of the next one.
    2. From the first unit on, pointers to the next run's first unit are followed by doubling: a round takes the firsts found so far to as many
       new ones, and joins the pointers with themselves, so there are about as many rounds as the number of runs has binary digits.
    3. A running sum over the firsts numbers the runs.
    """
    own = [f"_{k}" for k in range(len(order))]  # names that clash with none of those below
    placed = units.select(*[F.col(c).alias(n) for c, n in zip(order, own, strict=True)], "tokens")
    placed = written(running(placed, own, {"before": "tokens"}), "placed")
    total = placed.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).first()
    end = placed.sparkSession.createDataFrame([(total.n, total.tokens)], "place long, before long")
    spots = placed.select("place", "before").unionByName(end)
    block, wide = F.floor(F.col("before") / (SPAN * budget)), SPAN * budget
    homes = F.when((block > 0) & (F.col("before") % wide <= budget), F.array(block, block - 1)).otherwise(F.array(block))
    ahead = Window.partitionBy("home").orderBy("before").rangeBetween(0, budget)
    spots = spots.select("place", "before", block.alias("own"), F.explode(homes).alias("home"))
    reach = spots.withColumn("last", F.max("place").over(ahead)).where((F.col("home") == F.col("own")) & (F.col("place") < total.n))
    jump = F.least(F.col("place") + most, F.greatest(F.col("place") + 1, F.col("last")))
    pointers = written(reach.select("place", jump.alias("next")).where(F.col("next") < total.n), "pointers")
    firsts = written(placed.where("place = 0").select("place"), "firsts")
    while not pointers.isEmpty():
        found = firsts.join(pointers, "place").select(F.col("next").alias("place"))
        firsts = written(firsts.union(found), "firsts")
        pointers = written(pointers.join(pointers.select(F.col("place").alias("next"), F.col("next").alias("far")), "next").select("place", F.col("far").alias("next")), "pointers")
    marked = placed.join(firsts.withColumn("first", F.lit(1)), "place", "left").withColumn("first", F.coalesce("first", F.lit(0)))
    numbered = running(marked.select(F.col("place").alias("at"), *own, "tokens", "first"), ["at"], {"run": "first"})
    return numbered.select(*[F.col(n).alias(c) for c, n in zip(order, own, strict=True)], "tokens", (F.col("run") + F.col("first") - 1).alias("run"))
