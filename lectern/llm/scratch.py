"""Tables written to the shared folder, rows found again by number, and those that others want."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.sources.shared import new_path, shared_dir, written

__all__ = ["ROW", "among", "new_path", "numbered", "shared_dir", "written"]

#: Bits of the filter of among() for each wanted value, and at most: 32 MB.
FILTER_BITS, MOST_BITS = 16, 1 << 28


def among(rows: DataFrame, wanted: DataFrame, col: str) -> DataFrame:
    """The rows whose col is in wanted, nulls included. A bitmap of hashed values, broadcast, drops most others before the
    shuffle: FILTER_BITS for each wanted value, and never more than MOST_BITS in all. The exact semi-join follows."""
    wanted = wanted.select(F.col(col).alias("_w")).distinct()
    bits = min(MOST_BITS, 1 << max(15, (FILTER_BITS * wanted.count()).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    maps = wanted.select(place("_w").alias("p")).groupBy(F.floor(F.col("p") / 32768).alias("_m")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("_map"))
    at = place(col) % 32768
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    some = rows.join(F.broadcast(maps), F.floor(place(col) / 32768) == F.col("_m")).where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_m", "_map")
    # An inner join, as Catalyst would push a semi-join beneath the filter, and shuffle all rows.
    return some.join(wanted, some[col].eqNullSafe(wanted["_w"])).drop("_w")


#: The number of a row, by which operators find it again; ids may be null or repeated.
ROW = "_row"
#: Files of which the numbers are broadcast at most, and rows of a file.
MOST_FILES, FILE_ROWS = 100_000, 1 << 35


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns of docs (all, if none are named) with a number for each row, ROW, that every reading gives alike: a row's place in its
    file, and its file's place by name.

    So no text is copied. Tables that aren't read from Parquet files, or from more than MOST_FILES, are written with numbers first.
    """
    columns = columns or ("*",)
    try:
        placed = docs.select(*columns, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place"))
    except AnalysisException:
        placed = None
    files = placed.select("_file").distinct().limit(MOST_FILES + 1).collect() if placed is not None else []
    if not 0 < len(files) <= MOST_FILES:
        return written(docs.select(*columns).withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    numbers = docs.sparkSession.createDataFrame([(name, k) for k, name in enumerate(sorted(r[0] for r in files))], "_file string, _number long")
    return placed.join(F.broadcast(numbers), "_file").withColumn(ROW, F.col("_number") * FILE_ROWS + F.col("_place")).drop("_file", "_place", "_number")
