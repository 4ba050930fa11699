"""Row numbers and running values of series that no task should hold: by ranges and chunks, whose summaries are combined.

A window over a whole series sorts it in one task. Here the rows of a series are sorted in ranges or chunks; what a chunk does to
the running value is a summary of one row, summaries combine associatively, and only they, one row for some thousand, are
put in order by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import written

#: Rows of a chunk.
CHUNK = 1 << 14


def numbered(df: DataFrame, key: str, order: list[str], partitions: int | None = None) -> DataFrame:
    """df with t, the number of each row within its key, from 0, by the order.

    One range sort over all keys, so that a key may fill many partitions. The sorted ranges are written once, since the borders
    of ranges are drawn anew by each run: a row's place in its range and the rows of earlier ranges make its number. Rows that
    tie in the order are numbered in some order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order]
    place = F.monotonically_increasing_id()  # the range above 33 bits, the place in it below
    ranged = written(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_place", place), "ranges")
    part = F.shiftright("_place", 33).alias("_part")
    sizes = ranged.groupBy(key, part).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_shift"))
    out = ranged.join(starts, F.col(key).eqNullSafe(F.col("_key")) & (F.shiftright("_place", 33) == F.col("_of")))
    return out.select(*df.columns, (F.col("_place") + F.col("_shift")).cast("long").alias("t"))


def _chunks(s: DataFrame, chunk: int) -> DataFrame:
    return s.withColumn("_k", F.floor(F.col("t") / chunk))


def _within():
    return W.partitionBy("series_id", "_k").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)


def _before():
    return W.partitionBy("series_id").orderBy("_k").rowsBetween(W.unboundedPreceding, -1)


def running_low(s: DataFrame, step: Column, chunk: int = CHUNK) -> DataFrame:
    """s with run, the running sum of step, and low, the least running sum so far.

    The summary of a chunk is its sum and the least of its own running sums: (a, l) and then (b, m) are (a + b, min(l, a + m)).
    """
    part = _chunks(s, chunk).withColumn("_run", F.sum(step).over(_within())).withColumn("_low", F.min("_run").over(_within()))
    chunks = part.groupBy("series_id", "_k").agg(F.min("_run").alias("_least"), F.max_by("_run", "t").alias("_sum"))
    chunks = chunks.withColumn("_base", F.coalesce(F.sum("_sum").over(_before()), F.lit(0)))
    chunks = chunks.withColumn("_floor", F.min(F.col("_base") + F.col("_least")).over(_before())).select("series_id", "_k", "_base", "_floor")
    run = F.col("_run") + F.col("_base")
    return part.join(chunks, ["series_id", "_k"]).select(*s.columns, run.alias("run"), F.least(F.col("_floor"), F.col("_low") + F.col("_base")).alias("low"))
