"""Evaluation of change points against the truth, as plans over long tables (series_id, cp) and (series_id, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import InvalidInput


def _tolerance_match(t: str, d: str, tolerance: int):
    """Matches of two sorted arrays, each point at most once, by one sweep over both: an array fold with a constant state.

    Each step matches the next two points if they are near enough, and otherwise passes over the smaller of them.
    """
    start = F.struct(*[F.lit(0).cast("int").alias(k) for k in ("i", "j", "hits")])

    def step(acc, _):
        x, y = F.get(F.col(t), acc["i"]), F.get(F.col(d), acc["j"])  # null behind the end
        hit, one = F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)), F.lit(1)
        first, second = hit | (x < y), hit | (y < x)
        move = lambda k, go: (acc[k] + F.when(go, one).otherwise(0)).cast("int").alias(k)
        return F.struct(move("i", first), move("j", second), move("hits", hit))

    steps = F.when((F.size(t) > 0) & (F.size(d) > 0), F.sequence(F.lit(1), F.size(t) + F.size(d))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step)["hits"]


def tolerance_jaccard(a: str, b: str, tolerance: int):
    """Matched points of two sorted arrays over all their points; 1 where both are empty."""
    hits = _tolerance_match(a, b, tolerance)
    return F.coalesce(F.try_divide(hits, F.size(a) + F.size(b) - hits), F.lit(1.0))


def _arrays(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """lengths with the sorted true and found points of each series; empty where there are none."""
    a = truth.groupBy("series_id").agg(F.sort_array(F.collect_set("cp")).alias("truth"))
    b = found.groupBy("series_id").agg(F.sort_array(F.collect_set("cp")).alias("found"))
    none = F.array().cast("array<bigint>")
    return lengths.join(a, "series_id", "left").join(b, "series_id", "left").select("series_id", "n", F.coalesce("truth", none).alias("truth"), F.coalesce("found", none).alias("found"))


def f1(truth: DataFrame, found: DataFrame, lengths: DataFrame, tolerance: int = 5) -> DataFrame:
    """Precision, recall and F1 with a tolerance; all 1 where both sides are empty."""
    both = _arrays(truth, found, lengths).withColumn("matched", _tolerance_match("truth", "found", tolerance))
    nt, nf = F.size("truth"), F.size("found")
    empty = (nt == 0) & (nf == 0)
    p = F.when(empty, 1.0).when(nf == 0, 0.0).otherwise(F.try_divide(F.col("matched"), nf))
    r = F.when(empty, 1.0).when(nt == 0, 0.0).otherwise(F.try_divide(F.col("matched"), nt))
    out = both.withColumn("precision", p).withColumn("recall", r)
    score = F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(F.lit(0.0))
    return out.select("series_id", "matched", "precision", "recall", score.alias("f1"))


def nearest(a: DataFrame, b: DataFrame) -> DataFrame:
    """For each point of a the distance to the nearest point of b of its series: the last b at or before and the first b at
    or after it, by one sort instead of a join of all pairs."""
    both = a.select("series_id", "cp", F.lit(0).alias("_b")).unionByName(b.select("series_id", "cp", F.lit(1).alias("_b")))
    point = F.when(F.col("_b") == 1, F.col("cp"))
    order = W.partitionBy("series_id").orderBy("cp", F.desc("_b"))
    back = F.last(point, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    ahead = F.first(point, ignorenulls=True).over(W.partitionBy("series_id").orderBy("cp", "_b").rowsBetween(0, W.unboundedFollowing))
    got = both.withColumn("_p", back).withColumn("_q", ahead).where("_b = 0")
    return got.select("series_id", "cp", F.least(F.col("cp") - F.col("_p"), F.col("_q") - F.col("cp")).alias("distance"))


def hausdorff(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Greatest nearest distance in either direction; 0 where both sides are empty, null where exactly one is."""
    a = nearest(truth, found).groupBy("series_id").agg(F.max("distance").alias("d1"))
    b = nearest(found, truth).groupBy("series_id").agg(F.max("distance").alias("d2"))
    own = truth.select("series_id").distinct().withColumn("t", F.lit(True)).join(found.select("series_id").distinct().withColumn("f", F.lit(True)), "series_id", "full")
    both = lengths.select("series_id").join(own, "series_id", "left").join(a, "series_id", "left").join(b, "series_id", "left")
    value = F.when(F.col("t").isNull() & F.col("f").isNull(), F.lit(0).cast("long")).when(F.col("t") & F.col("f"), F.greatest("d1", "d2"))
    return both.select("series_id", value.alias("hausdorff"))


def annotation_error(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Mean distance of found points to the nearest true one; 0 where nothing was found, null where nothing is true but
    something was found."""
    by = nearest(found, truth).groupBy("series_id").agg(F.avg("distance").alias("_mean"), F.count(F.lit(1)).alias("_found"))
    return lengths.select("series_id").join(by, "series_id", "left").select("series_id", F.when(F.col("_found").isNull(), F.lit(0.0)).otherwise(F.col("_mean")).alias("annotation_error"))


def _as_segments(points: DataFrame, lengths: DataFrame) -> DataFrame:
    order = W.partitionBy("series_id").orderBy("e")
    ends = points.select("series_id", F.col("cp").alias("e")).unionByName(lengths.select("series_id", F.col("n").alias("e"))).distinct()
    return ends.withColumn("s", F.coalesce(F.lag("e").over(order), F.lit(0).cast("long")))


def rand_index(truth: DataFrame, found: DataFrame, lengths: DataFrame) -> DataFrame:
    """Share of row pairs that both segmentations treat alike, from the overlaps of segments.

    The overlaps are the segments of the union of both sets of ends, so their number is the sum of both, not the product.
    """
    pairs = lambda m: m * (m - 1) / 2
    sizes = lambda df, name: _as_segments(df, lengths).groupBy("series_id").agg(F.sum(pairs(F.col("e") - F.col("s"))).alias(name))
    both = truth.select("series_id", "cp").unionByName(found.select("series_id", "cp")).distinct()
    out = lengths.join(sizes(truth, "a"), "series_id").join(sizes(found, "b"), "series_id").join(sizes(both, "o"), "series_id")
    total = pairs(F.col("n"))
    return out.select("series_id", F.when(total > 0, (total + 2 * F.col("o") - F.col("a") - F.col("b")) / total).otherwise(F.lit(1.0)).alias("rand_index"))


def offline_metrics(truth: DataFrame, found: DataFrame, lengths: DataFrame, tolerance: int = 5) -> DataFrame:
    """f1, hausdorff, rand_index and annotation_error of each series."""
    out = f1(truth, found, lengths, tolerance)
    for more in (hausdorff(truth, found, lengths), rand_index(truth, found, lengths), annotation_error(truth, found, lengths)):
        out = out.join(more, "series_id", "left")
    return out


def _observed(steps: DataFrame, truth: DataFrame) -> DataFrame:
    """The steps (series_id, t, _at, ...) with the last true change at or before each (cp, null before the first); _at counts a
    series' steps from 0. Changes behind the last step are not looked at."""
    points = truth.select("series_id", F.col("cp").alias("t"), F.lit(0).alias("_o")).distinct()
    rows = steps.withColumn("_o", F.lit(1)).withColumn("_at", F.row_number().over(W.partitionBy("series_id").orderBy("t")) - 1)
    order = W.partitionBy("series_id").orderBy("t", "_o").rowsBetween(W.unboundedPreceding, 0)
    both = points.unionByName(rows, allowMissingColumns=True)
    return both.withColumn("cp", F.last(F.when(F.col("_o") == 0, F.col("t")), ignorenulls=True).over(order)).where("_o = 1").drop("_o")


def _changes(steps: DataFrame, truth: DataFrame) -> DataFrame:
    """series_id and the number of changes up to the last step, and how many of them are steps."""
    last = steps.groupBy("series_id").agg(F.max("t").alias("_last"))
    own = truth.select("series_id", "cp").distinct().join(last, "series_id").where("cp <= _last")
    on = steps.select("series_id", F.col("t").alias("cp"), F.lit(1).alias("_on"))
    return own.join(on, ["series_id", "cp"], "left").groupBy("series_id").agg(F.count(F.lit(1)).alias("changes"), F.count("_on").alias("change_steps"))


def online_metrics(steps: DataFrame, truth: DataFrame) -> DataFrame:
    """Per series of steps (series_id, t, alert): alerts, detected and missed changes, mean delay (also ARL1), false alarms, their share
    of the steps, and ARL0, the mean run between false alarms: the place of the last one over their number, infinite without.

    The first alert from a change up to the next one detects it; all other alerts are false. The change an alert belongs
    to is the last one at or before it; changes behind the last step count for nothing.
    """
    alerts = _observed(steps.select("series_id", "t", "alert"), truth).where("alert")
    place = F.row_number().over(W.partitionBy("series_id", "cp").orderBy("t"))
    marked = alerts.withColumn("hit", (place == 1) & F.col("cp").isNotNull())
    last = F.max(F.when(~F.col("hit"), F.col("_at"))).alias("last")
    by = marked.groupBy("series_id").agg(F.count_if("hit").alias("detected"), F.count_if(~F.col("hit")).alias("false_alarms"), F.avg(F.when(F.col("hit"), F.col("t") - F.col("cp"))).alias("mean_delay"), last)
    n = steps.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"))
    out = n.join(by, "series_id", "left").join(_changes(steps, truth), "series_id", "left").fillna(0, ["detected", "false_alarms", "changes"])
    arl0 = F.when(F.col("false_alarms") > 0, (F.col("last") + 1) / F.col("false_alarms")).otherwise(F.lit(float("inf")))
    alerts_ = (F.col("detected") + F.col("false_alarms")).alias("total_alerts")
    return out.select("series_id", alerts_, "detected", (F.col("changes") - F.col("detected")).alias("missed"), "mean_delay", "false_alarms", (F.col("false_alarms") / F.col("n")).alias("false_alarm_rate"), arl0.alias("arl0"), F.col("mean_delay").alias("arl1"))


def roc(steps: DataFrame, truth: DataFrame) -> DataFrame:
    """Per series of steps (series_id, t, p_change) and threshold: detected changes, false alerts, and their shares of all
    changes (1 without any) and of the steps that are no changes. Thresholds are all values of p_change and one beyond each end.

    A change is detected at thresholds up to the largest value between it and the next, and every other alert is false. So
    the counts at all thresholds are running sums over the steps' values and the changes' largest ones.
    """
    own = _observed(steps.select("series_id", "t", "p_change"), truth)
    alerts = own.select("series_id", F.col("p_change").alias("threshold"), F.lit(1).alias("a"), F.lit(0).alias("d"))
    hits = own.where("cp is not null").groupBy("series_id", "cp").agg(F.max("p_change").alias("threshold")).select("series_id", "threshold", F.lit(0).alias("a"), F.lit(1).alias("d"))
    ends = own.groupBy("series_id").agg(F.max("p_change").alias("hi"), F.min("p_change").alias("lo"), F.count(F.lit(1)).alias("n"))
    edge = ends.select("series_id", F.explode(F.array(F.col("hi") + 1, F.col("lo") - 1)).alias("threshold"), F.lit(0).alias("a"), F.lit(0).alias("d"))
    by = alerts.unionByName(hits).unionByName(edge).groupBy("series_id", "threshold").agg(F.sum("a").alias("a"), F.sum("d").alias("d"))
    down = W.partitionBy("series_id").orderBy(F.desc("threshold")).rowsBetween(W.unboundedPreceding, 0)
    run = by.select("series_id", "threshold", F.sum("d").over(down).alias("detected"), (F.sum("a").over(down) - F.sum("d").over(down)).alias("false_alerts"))
    all_ = ends.select("series_id", "n").join(_changes(steps, truth), "series_id", "left").fillna(0, ["changes", "change_steps"])
    tpr = F.when(F.col("changes") == 0, F.lit(1.0)).otherwise(F.try_divide("detected", "changes"))
    fpr = F.coalesce(F.try_divide(F.col("false_alerts"), F.col("n") - F.col("change_steps")), F.lit(0.0))
    return run.join(all_, "series_id").select("series_id", "threshold", "detected", "false_alerts", tpr.alias("tpr"), fpr.alias("fpr"))


def calibration(p: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score of (family, confidence, correct), by family and overall (family null), in bins
    of equal width. Confidences outside 0 to 1 and outcomes other than 0 and 1 are errors."""
    if not 1 <= bins <= 100:
        raise InvalidInput(f"bins must be from 1 to 100; got {bins}")
    fits = F.col("confidence").between(0.0, 1.0) & ~F.isnan("confidence") & F.col("correct").cast("double").isin(0.0, 1.0)
    checked = F.when(F.coalesce(fits, F.lit(False)), F.col("confidence")).otherwise(F.raise_error(F.lit("a confidence must be from 0 to 1 and an outcome 0 or 1")).cast("double"))
    own = p.withColumn("confidence", checked).withColumn("correct", F.col("correct").cast("double"))
    cut = own.withColumn("bin", F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)))
    sq = (F.col("confidence") - F.col("correct")) * (F.col("confidence") - F.col("correct"))
    by = cut.groupingSets([["family", "bin"], ["bin"]], "family", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("c"), F.avg("correct").alias("a"), F.sum(sq).alias("sq"), F.grouping("family").alias("g"))
    return by.groupBy("family", "g").agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"), (F.sum("sq") / F.sum("n")).alias("brier"), F.sum("n").alias("n")).drop("g")
