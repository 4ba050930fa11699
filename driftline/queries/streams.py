"""The online detectors as streams over event files, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import LatePolicy
from ..functions.storage import shared
from ..sources import tables as T
from ..streaming import processors as S
from .base import EVENTS, USERS
from .detectors import _CUSUM, _arrivals


#: Rows of one series that a batch should have at most, since a task sorts them by arrival.
SERIES_ROWS = 1 << 19


def in_order(spark, path: str) -> bool:
    """Gives the files of a folder times of change that follow their names, as a stream takes files by these times; false on a store
    that keeps its own."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = lambda: sorted(((f.getPath().getName(), f.getModificationTime(), f) for f in fs.listStatus(at) if f.getPath().getName().startswith("part-")), key=lambda f: f[0])
    found = files()
    last = max((time for _, time, _ in found), default=0)
    for i, (_, _, f) in enumerate(found):
        fs.setTimes(f.getPath(), last - 1000 * (len(found) - i), -1)
    times = [time for _, time, _ in files()]
    return all(a < b for a, b in zip(times, times[1:], strict=False))


def stream_of(spark, rows, out: str, files: int = 3):
    """rows as a stream: written as files in the order of arrival. Of short series a few files are read in one batch; if a series has
    more rows than a task should hold, there are as many files as that asks for, and a batch reads one."""
    longest = rows.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0
    batches = -(-longest // SERIES_ROWS)
    rows.repartitionByRange(max(files, batches), "arrival_seq").write.mode("overwrite").parquet(f"{out}/rows")
    one = batches > 1 and in_order(spark, f"{out}/rows")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1 if one else max(100, batches)).parquet(f"{out}/rows")


def _run(spark, rows, detector, **options):
    out = shared(spark, "stream")
    steps = S.detect_stream(stream_of(spark, rows, out), detector, **options)
    S.run_available(steps, f"{out}/checkpoint", f"{out}/steps")
    return spark.read.schema(S.OUTPUT).parquet(f"{out}/steps")


def stream_cusum(spark, d):
    rows = T.events(spark, d, "user_id").select("series_id", F.col("t").alias("arrival_seq"), "x")
    return _run(spark, rows, "cusum", drift=5.0, threshold=200.0, target=50.0).select("series_id", "t", F.round("p_change", 6).alias("p_change"))


def stream_page_hinkley(spark, d):
    """In hundredths, whose sums are exact; series grow with the table."""
    rows = T.events(spark, d, long=True).select("series_id", F.col("t").alias("arrival_seq"), F.col("x_fp").cast("double").alias("x"))
    return _run(spark, rows, "page_hinkley", delta=50.0, threshold=40000.0).select("series_id", "t", F.round("p_change", 4).alias("p_change"))


def stream_bocpd_late(spark, d):
    rows = _arrivals(spark, d).select("series_id", "arrival_seq", "t_ns", "x")
    return _run(spark, rows, "bocpd", late=LatePolicy("reorder", 10**18, 8, "drop_oldest"))


def _shuffled(spark, d):
    """Rows of a user in an arrival order in which two of six come behind the others, the later one first."""
    s = T.events(spark, d, "user_id").withColumn("t_ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    place = F.element_at(F.array(*map(F.lit, (0, 5, 4, 1, 2, 3))), (F.col("t") % 6 + 1).cast("int"))
    return s.select("series_id", (F.expr("t div 6") * 6 + place).alias("arrival_seq"), "t_ns", "x")


def stream_late_counters(spark, d):
    """What becomes of late rows, by user, summed over the stream's output."""
    rows = _shuffled(spark, d)
    out = shared(spark, "stream")
    steps = S.detect_stream(stream_of(spark, rows, out), "cusum", late=LatePolicy("reorder", 10**18, 8, "drop_oldest"))
    S.run_available(steps, f"{out}/checkpoint", f"{out}/steps")
    return spark.read.schema(S.OUTPUT).parquet(f"{out}/steps").groupBy("series_id").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(c).alias(c) for c in S.COUNTERS], F.count("processing_latency_us").alias("latencies"))


QUERIES = {
    "stream_cusum": (stream_cusum, f"WITH {USERS}{_CUSUM.format(k=5500)} SELECT series_id, t, round(least(score / 200, 1), 6) AS p_change FROM z"),
    "stream_page_hinkley": (stream_page_hinkley, f"WITH {EVENTS}, m AS (SELECT series_id, t, x_fp, (sum(x_fp) OVER (PARTITION BY series_id ORDER BY t))::DOUBLE / (t + 1) AS mu FROM s), c AS (SELECT series_id, t, sum(x_fp - mu - 50) OVER (PARTITION BY series_id ORDER BY t) AS c FROM m) SELECT series_id, t, round(least((c - least(0, min(c) OVER (PARTITION BY series_id ORDER BY t))) / 40000, 1), 4) AS p_change FROM c"),
    "stream_bocpd_late": (stream_bocpd_late, None),
    "stream_late_counters": (stream_late_counters, f"""WITH {USERS}, a AS (SELECT series_id, t_us, row_number() OVER (PARTITION BY series_id ORDER BY t // 6, list_extract([0, 5, 4, 1, 2, 3], t % 6 + 1)) AS seq FROM (SELECT *, epoch_us(ts) AS t_us FROM s)),
w AS (SELECT *, coalesce(t_us < max(t_us) OVER (PARTITION BY series_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS late FROM a),
g AS (SELECT *, count(*) FILTER (WHERE NOT late) OVER (PARTITION BY series_id ORDER BY seq) AS grp, max(CASE WHEN late THEN 0 ELSE seq END) OVER (PARTITION BY series_id) AS last_on_time FROM w),
r AS (SELECT series_id, grp, CASE WHEN count(*) = 2 AND arg_min(t_us, seq) > arg_max(t_us, seq) AND max(seq) < any_value(last_on_time) THEN 1 ELSE 0 END AS turned FROM g WHERE late GROUP BY 1, 2)
SELECT g.series_id, count(*) AS rows, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE late) AS buffered, coalesce((SELECT sum(turned) FROM r WHERE r.series_id = g.series_id), 0)::BIGINT AS reordered,
  0 AS dropped_oldest, 0 AS dropped_newest, 0 AS overflow_errors, 0 AS latencies FROM g GROUP BY 1"""),
}
