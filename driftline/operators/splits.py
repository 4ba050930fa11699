"""Split search as plans: best splits, level-wise binary segmentation, window scores and interval grids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import native
from ..functions.native import ORDERED, SERIES
from ..functions.storage import written


def candidate_splits(s: DataFrame, min_segment_len: int = 2, jump: int = 1) -> DataFrame:
    """Rows at which a series may be split: multiples of jump with room on both sides."""
    n = F.count(F.lit(1)).over(SERIES())
    return s.withColumn("n", n).where((F.col("t") % jump == 0) & (F.col("t") >= min_segment_len) & (F.col("n") - F.col("t") >= min_segment_len))


def split_gains(s: DataFrame, min_segment_len: int = 2, jump: int = 1, chunk: int | None = None) -> DataFrame:
    """series_id, n, split, ts and gain (in squared fixed-point units) for each candidate, by whole-number sums."""
    whole = native.running(s.select("series_id", "t", "ts", "x_fp"), {"a": F.col("x_fp"), "b": F.col("x_fp") * F.col("x_fp")}, chunk)
    total = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x_fp").alias("whole"))
    cut = whole.join(total, "series_id").withColumn("split", F.col("t"))
    left = F.col("a") - F.col("x_fp")  # the sum before the split
    right = F.col("whole") - left
    m, k = F.col("n"), F.col("split")
    ok = (k % jump == 0) & (k >= min_segment_len) & (m - k >= min_segment_len)
    gain = left.cast("double") * left / k + right.cast("double") * right / (m - k) - F.col("whole").cast("double") * F.col("whole") / m
    return cut.where(ok).select("series_id", "n", "split", "ts", gain.alias("gain"))


def best_split(s: DataFrame, min_segment_len: int = 2, jump: int = 1, scale: float = 100.0, digits: int = 6, chunk: int | None = None) -> DataFrame:
    """The split of greatest gain of each series; ties go to the smallest split. An aggregation, so it combines map-side."""
    gains = split_gains(s, min_segment_len, jump, chunk).withColumn("gain", F.round(F.col("gain") / (scale * scale), digits))
    best = gains.groupBy("series_id").agg(F.max(F.struct("gain", (-F.col("split")).alias("o"), "n", "split", "ts")).alias("b"))
    return best.select("series_id", "b.n", "b.split", "b.gain", F.col("b.ts").alias("ts_at_split"))


def _gain(left, right, whole, m, k):
    """What splitting m rows after k of them gains by L2, from the sums."""
    d = lambda c: c.cast("double")
    return d(left) * left / k + d(right) * right / (m - k) - d(whole) * whole / m


#: Levels of a segmentation after which what is left inside its segments is written.
EVERY = 3


def _split_on(inside: DataFrame, took: DataFrame) -> DataFrame:
    """Rows or intervals of segments (series_id, s, e) that were split, each with the half it lies in; others are gone.

    inside has _from and _to, the ends of a row or interval; one that crosses the split is gone too.
    """
    cut = took.select("series_id", "s", F.col("split").alias("_cut"), F.col("upto").alias("_at"))
    low, high = F.col("_to") <= F.col("_cut"), F.col("_from") >= F.col("_cut")
    halves = inside.join(cut, ["series_id", "s"]).where(low | high)
    new = {"s": F.when(low, F.col("s")).otherwise(F.col("_cut")), "e": F.when(low, F.col("_cut")).otherwise(F.col("e"))}
    if "base" in inside.columns:  # the sums before the segment and over it
        new["total"] = F.when(low, F.col("_at") - F.col("base")).otherwise(F.col("total") - (F.col("_at") - F.col("base")))
        new["base"] = F.when(low, F.col("base")).otherwise(F.col("_at"))
    return halves.select(*[new[c].alias(c) if c in new else F.col(c) for c in inside.columns])


def frontier(inside: DataFrame, best: Callable[[DataFrame], DataFrame], beta: float, levels: int | None = None) -> DataFrame:
    """series_id, change_point, depth and gain of a greedy segmentation, all segments of a depth at once.

    best gives the best split of each segment (series_id, s, e, split, upto, gain) among what lies inside it; it is taken where its
    gain exceeds beta. Without a limit on the change points the order of splits does not matter, so that this is what splitting
    the best segment first ends with. What lies inside carries its segment along: a level joins by (series, start of the
    segment) with the splits taken, of which there is one a segment, and reads no rows of segments that are done. The splits
    of a level are written, so that a level runs once, and every few levels so is what is left inside, so that plans stay
    short. levels: at most so many (none: until nothing is split).
    """
    found, depth = None, 0
    while levels is None or depth < levels:
        took = written(best(inside).where(F.col("gain") > beta), "splits")
        if depth and took.isEmpty():
            break
        level = took.select("series_id", F.col("split").alias("change_point"), F.lit(depth).alias("depth"), "gain")
        found = level if found is None else found.unionByName(level)
        inside, depth = _split_on(inside, took), depth + 1
        if depth % EVERY == 0:
            inside = written(inside, "inside")
    return found


def binseg_levels(s: DataFrame, beta: float, levels: int | None = None, min_segment_len: int = 2, scale: float = 100.0, digits: int = 6, chunk: int | None = None) -> DataFrame:
    """Binary segmentation by L2. Rows carry the start, end and sums of their segment, so that a gain needs no lookup; the best
    split of a segment is an aggregation that combines map-side."""
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("e"), F.sum("x_fp").alias("total"))
    run = native.running(s.select("series_id", "t", "x_fp"), {"a": F.col("x_fp")}, chunk)
    rows = written(run.select("series_id", F.col("t").alias("split"), (F.col("a") - F.col("x_fp")).alias("upto")).join(n, "series_id"), "prefixes")
    rows = rows.select("series_id", "split", "upto", F.lit(0).cast("long").alias("s"), "e", F.lit(0).cast("long").alias("base"), "total")

    def best(inside: DataFrame) -> DataFrame:
        left = F.col("upto") - F.col("base")
        gain = _gain(left, F.col("total") - left, F.col("total"), F.col("e") - F.col("s"), F.col("split") - F.col("s"))
        room = inside.where((F.col("split") >= F.col("s") + min_segment_len) & (F.col("split") <= F.col("e") - min_segment_len))
        by = room.withColumn("gain", F.round(gain / (scale * scale), digits)).groupBy("series_id", "s", "e").agg(F.max(F.struct("gain", (-F.col("split")).alias("o"), "split", "upto")).alias("b"))
        return by.select("series_id", "s", "e", "b.split", "b.upto", "b.gain")

    # A row is the place before it: it lies in the segment that starts there.
    return frontier(rows.withColumn("_from", F.col("split")).withColumn("_to", F.col("split") + 1), best, beta, levels)


def window_scores(s: DataFrame, width: int = 20, scale: float = 100.0, digits: int = 6) -> DataFrame:
    """series_id, split and the L2 score of splitting the centred window there, from prefix sums at the window's ends."""
    h = width // 2
    cols = {"a": F.col("x_fp"), "b": F.col("x_fp") * F.col("x_fp")}
    p = native.prefixes(s, cols)
    lo, hi = F.lag("a", h).over(ORDERED()), F.lead("a", h).over(ORDERED())
    p = p.select("series_id", F.col("t").alias("split"), (F.col("a") - lo).cast("double").alias("l"), (hi - F.col("a")).cast("double").alias("r")).where("l is not null and r is not null")
    score = F.col("l") * F.col("l") / h + F.col("r") * F.col("r") / h - (F.col("l") + F.col("r")) * (F.col("l") + F.col("r")) / (2 * h)
    return p.select("series_id", "split", F.round(score / (scale * scale), digits).alias("score"))


def local_peaks(scores: DataFrame) -> DataFrame:
    """Rows above their left neighbour and not below the right one; all rows of a series that has none."""
    order = SERIES().orderBy("split")
    left, right = F.lag("score").over(order), F.lead("score").over(order)
    peak = (left.isNull() | (F.col("score") > left)) & (right.isNull() | (F.col("score") >= right))
    marked = scores.withColumn("peak", peak)
    return marked.withColumn("any", F.max("peak").over(SERIES())).where("peak or not any").drop("peak", "any")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    """The k best splits of each series by score descending, then split."""
    place = F.row_number().over(SERIES().orderBy(F.desc("score"), "split"))
    return scores.withColumn("place", place).where(F.col("place") <= k)


def _dyadic_sizes(s: DataFrame, min_segment_len: int) -> DataFrame:
    """series_id, n, total, size, step, last (the start of the last interval), count: the interval lengths of each series."""
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x_fp").alias("whole") if "x_fp" in s.columns else F.lit(None).cast("long").alias("whole"))
    least = 2 * min_segment_len
    halves = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.floor(F.col("n") / F.pow(F.lit(2.0), k)).cast("long"))
    sizes = n.where(F.col("n") >= least).withColumn("size", F.explode(F.array_distinct(F.transform(halves, lambda v: F.greatest(v, F.lit(least).cast("long"))))))
    out = sizes.withColumn("step", F.greatest(F.expr("size div 2"), F.lit(1).cast("long"))).withColumn("last", F.col("n") - F.col("size"))
    return out.withColumn("count", F.expr("last div step + 1") + F.when(F.col("last") % F.col("step") > 0, 1).otherwise(0))


def _of_target(grid: DataFrame, target: bool) -> DataFrame:
    """The intervals that an even choice of max(100, ceil(5 sqrt(n))) of a series' intervals takes: with `_i`, an interval's number
    among its length's, those at which number * target / all, rounded down, rises. Shorter lengths come first."""
    if not target:
        return grid
    goal = F.greatest(F.lit(100).cast("long"), F.ceil(5 * F.sqrt(F.col("n").cast("double"))))
    share = lambda k: F.expr(f"cast({k} as decimal(19,0)) * cast(_goal as decimal(19,0)) div _all")
    numbered = grid.withColumn("_goal", goal).withColumn("_seen", F.col("_earlier") + F.col("_i"))
    return numbered.where((F.col("_all") <= F.col("_goal")) | (share("(_seen + 1)") > share("_seen")))


def _with_numbers(sizes: DataFrame) -> DataFrame:
    """sizes with _all, the number of a series' intervals, and _earlier, that of the shorter ones; a few rows a series."""
    by = W.partitionBy("series_id").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumn("_earlier", F.coalesce(F.sum("count").over(by), F.lit(0))).withColumn("_all", F.sum("count").over(SERIES()))


def dyadic_intervals(s: DataFrame, min_segment_len: int = 2, target: bool = False) -> DataFrame:
    """The dyadic interval grid of each series, at half steps and with the last interval where steps miss the end. target: an
    even choice among them, as _of_target says."""
    sizes = _with_numbers(_dyadic_sizes(s, min_segment_len))
    grid = sizes.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1))).withColumn("s", F.least(F.col("_i") * F.col("step"), F.col("last")))
    return _of_target(grid, target).select("series_id", "s", (F.col("s") + F.col("size")).alias("e"))


def dyadic_best_splits(s: DataFrame, min_segment_len: int = 2, scale: float = 100.0, digits: int = 6, target: bool = False, chunk: int | None = None) -> DataFrame:
    """series_id, s, e, split and gain of the best L2 split inside each interval of the dyadic grid.

    A row lies in at most three intervals of a length: the one that starts at the step before it, the one before that, and the
    last. Their numbers are arithmetic, so that no range join is needed; the rest is an aggregation by (series, length,
    interval) that combines map-side. An interval's own sums come from the same rows.
    """
    sizes = _with_numbers(_dyadic_sizes(s, min_segment_len)).groupBy("series_id").agg(F.collect_list(F.struct("n", "size", "step", "last", "count", "_earlier", "_all")).alias("_sizes"))
    run = native.running(s.select("series_id", "t", "x_fp"), {"a": F.col("x_fp")}, chunk).select("series_id", F.col("t").alias("split"), "x_fp", (F.col("a") - F.col("x_fp")).alias("upto"))
    each = run.join(sizes, "series_id").select("series_id", "split", "x_fp", "upto", F.explode("_sizes").alias("z")).select("series_id", "split", "x_fp", "upto", "z.*")
    steps = F.expr("last div step")  # the number of the last interval that is a whole number of steps away
    here = F.expr("split div step")
    near = F.array_distinct(F.array(here, here - 1, here - 2, F.when(F.col("count") > steps + 1, F.col("count") - 1).otherwise(here)))
    inside = each.withColumn("_i", F.explode(near)).where("_i >= 0 and _i < count").withColumn("s", F.least(F.col("_i") * F.col("step"), F.col("last")))
    inside = _of_target(inside.where((F.col("split") >= F.col("s")) & (F.col("split") < F.col("s") + F.col("size"))), target)
    # The sums before the interval and over it: of its first row, and of its last one with its own value.
    key = ["series_id", "size", "_i"]
    ends = inside.where((F.col("split") == F.col("s")) | (F.col("split") == F.col("s") + F.col("size") - 1))
    ends = ends.groupBy(*key).agg(F.max(F.when(F.col("split") == F.col("s"), F.col("upto"))).alias("base"), F.max(F.when(F.col("split") == F.col("s") + F.col("size") - 1, F.col("upto") + F.col("x_fp"))).alias("after"))
    room = inside.where((F.col("split") >= F.col("s") + min_segment_len) & (F.col("split") <= F.col("s") + F.col("size") - min_segment_len)).join(ends, key)
    left, total = F.col("upto") - F.col("base"), F.col("after") - F.col("base")
    gain = F.round(_gain(left, total - left, total, F.col("size"), F.col("split") - F.col("s")) / (scale * scale), digits)
    best = room.withColumn("gain", gain).groupBy("series_id", "s", "size").agg(F.max(F.struct("gain", (-F.col("split")).alias("o"), "split")).alias("b"))
    return best.select("series_id", "s", (F.col("s") + F.col("size")).alias("e"), "b.split", "b.gain")


def wbs(s: DataFrame, beta: float, levels: int | None = None, min_segment_len: int = 2, scale: float = 100.0, digits: int = 6, target: bool = True, chunk: int | None = None) -> DataFrame:
    """Wild binary segmentation by L2 on the dyadic grid: series_id, change_point, depth and gain.

    A segment takes the best split among the intervals that lie in it whole (gain descending, then split, then start), where its
    gain exceeds beta. Intervals carry their segment along, and drop out where a split crosses them.
    """
    best = written(dyadic_best_splits(s, min_segment_len, scale, digits, target, chunk), "intervals")
    n = s.groupBy("series_id").agg(F.count(F.lit(1)).alias("e"))
    inside = best.select("series_id", F.col("s").alias("_from"), F.col("e").alias("_to"), "split", "gain").join(n, "series_id").withColumn("s", F.lit(0).cast("long"))

    def taken(intervals: DataFrame) -> DataFrame:
        room = intervals.where(F.col("e") - F.col("s") >= 2 * min_segment_len)
        by = room.groupBy("series_id", "s", "e").agg(F.max(F.struct("gain", (-F.col("split")).alias("o"), "split")).alias("b"))
        return by.select("series_id", "s", "e", "b.split", F.lit(None).cast("long").alias("upto"), "b.gain")

    return frontier(inside, taken, beta, levels)


def frontier_argmax(best: DataFrame) -> DataFrame:
    """Of each series' interval splits the one to take: gain descending, then split, then start."""
    place = F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("gain"), "split", "s", "e"))
    return best.withColumn("place", place).where("place = 1").drop("place")
