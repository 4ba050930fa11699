"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in a shuffled order, once for each pass the mix may make over them. A document's virtual
finish time is the number of its source's tokens up to and including it, divided by the source's target weight. All queues
are range-sorted by finish time and cut where the running total reaches the budget.

Running totals never put a source into one task: tokens are summed per (source, slice of the shuffled order), the few slice
totals get their offsets, and the rest is a window within a slice. The global cut works likewise over slices of finish time.

Defined results: null text has size 0; a null source is a source of its own, after all others; documents without words take
nothing; repeated rows are documents of their own; ties in the shuffled order are broken by doc_id, size and a hash of the text, so that
reruns agree; texts of any length are counted whole; an empty table gives an empty result. Columns besides doc_id, text and source are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, lookup, table, text_of, workdir, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
#: Documents per slice of a source's queue, about: what one window task sorts at a time.
SLICE_ROWS = 5_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_key(seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """source, source_size, weight, target, cap, largest (document) and m (documents) for each source: water-filling under the cap of `passes` times the source's size.

    Sources in the order of cap / weight reach their caps first; those before the first source that does not reach its cap
    get the cap, and the others share what is left by weight.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.max("size").alias("largest"), F.count(F.lit(1)).alias("m"))
    place = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int"))
    caps = by.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * float(passes))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = W.partitionBy()
    budget = F.sum("source_size").over(whole).cast("double") * float(share)
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    level = (budget - before) / rest  # words per unit of weight, if the sources before this one stop at their caps
    filled = caps.withColumn("level", level).withColumn("free", F.col("cap") > F.col("level") * F.col("weight"))
    first = F.min(F.when(F.col("free"), F.col("cap") / F.col("weight"))).over(whole)
    at = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(whole)
    out = filled.withColumn("first", first).withColumn("at", at.getField("level"))
    target = F.when(F.col("first").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("at") * F.col("weight")))
    return out.select("source", "source_size", "weight", target.alias("target"), "cap", "largest", "m")


def running(df: DataFrame, group: list[Column], slice_: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds the running total of value within group along order; slice_ must follow order and cut it into many pieces."""
    keys = [f"_g{i}" for i in range(len(group))]
    df = df.select("*", *[c.alias(k) for c, k in zip(group, keys, strict=True)], slice_.alias("_slice"))
    sums = df.groupBy(*keys, "_slice").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("_slice").alias("_slice_"), before.alias("_before"))
    inner = F.sum(value).over(W.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("_inner", inner)
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col("_slice") == F.col("_slice_")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    out = df.join(sums, on).withColumn(name, F.col("_inner") + F.col("_before"))
    return out.drop(*keys, *[f"{k}_" for k in keys], "_slice", "_slice_", "_before", "_inner")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: int = 0, per_slice: int = SLICE_ROWS) -> DataFrame:
    """doc_id, source, size, text_hash, source_size, target, taken and upto (the place in the source's queue, in words) for each row of docs."""
    spark = docs.sparkSession
    out = workdir(spark, "mixing")
    sizes = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), word_count(text_of()).alias("size"), shuffle_key(seed).alias("key"), F.xxhash64(text_of()).alias("text_hash"))
    sizes = written(sizes, f"{out}/sizes")
    goals = written(targets(sizes, weights, share, passes), f"{out}/targets")
    rows = sizes.count()
    slices = max(1, min(1 << 20, -(-rows // per_slice) * 4))
    width = len(f"{slices - 1:x}")
    in_slice = (F.conv(F.substring("key", 1, width + 4), 16, 10).cast("long") * F.lit(slices) / F.lit(16 ** (width + 4))).cast("long")
    queue = [F.col("key"), F.col("doc_id"), F.col("size"), F.col("text_hash")]
    run = running(sizes, [F.col("source")], in_slice, queue, "size", "upto")
    # A source may hold a great part of all rows, so its goal is looked up in parts; a null source has a name of its own.
    name = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("_name")
    goals = goals.select("*", name).drop("source")
    run = lookup(run.select("*", name), goals.select("_name", "source_size", "target"), ["_name"], goals.select("_name", "m"), rows, ["key"]).drop("_name")
    # One entry per pass: pass p finishes after p whole rounds of the source.
    entry = run.where((F.col("size") > 0) & (F.col("target") > 0)).select("*", F.explode(F.array(*[F.lit(i) for i in range(passes)])).alias("pass"))
    entry = entry.withColumn("finish", (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target"))
    # All targets together are the budget, so the cut lies near finish time 1. By `edge` every source has its target or, below its
    # cap, at least that: entries behind it are behind the cut, and slices up to it hold about as many words each.
    late = F.max(F.when((F.col("target") > 0) & (F.col("target") < F.col("cap")), F.col("largest") / F.col("target")))
    ends = goals.agg(F.sum("target").alias("budget"), F.coalesce(late, F.lit(0.0)).alias("late")).first()
    budget, edge = ends["budget"] or 0.0, (1.0 + ends["late"]) * (1 + 1e-9)
    entry = written(entry.where(F.col("finish") <= edge), f"{out}/queue")
    in_order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id"), F.col("pass")]
    total = running(entry, [F.lit(0)], F.floor(F.col("finish") / F.lit(edge) * F.lit(slices)), in_order, "size", "total")
    taken = total.where(F.col("total") <= F.lit(budget)).groupBy("key", "doc_id", "source", "size", "upto").agg(F.sum("size").alias("got"))
    on = ["key", "doc_id", "source", "size", "upto"]
    got = taken.select(*[F.col(c).alias(f"_{c}") for c in on], "got")
    match = F.col("key") == F.col("_key")
    for c in on[1:]:
        match = match & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return run.join(got, match, "left").select("doc_id", "source", "size", "text_hash", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), "upto")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(cast(doc_id AS VARCHAR), '') || ':0') AS key
  FROM documents
), per_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), caps AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         ([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM per_source
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps
), cutoff AS (
  SELECT level FROM levels WHERE cap > level * weight ORDER BY cap / weight, source NULLS LAST LIMIT 1
), goals AS (
  SELECT source, source_size, CASE WHEN (SELECT level FROM cutoff) IS NULL THEN cap ELSE least(cap, (SELECT level FROM cutoff) * weight) END AS target
  FROM levels
), queue AS (
  SELECT s.*, g.source_size, g.target,
         sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sizes s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), entries AS (
  SELECT q.*, pass, (upto + pass * source_size)::DOUBLE / target AS finish
  FROM queue q, (VALUES (0), (1)) p(pass) WHERE size > 0 AND target > 0
), totals AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, key, doc_id, pass ROWS UNBOUNDED PRECEDING) AS total FROM entries
), got AS (
  SELECT key, doc_id, sum(size)::BIGINT AS got FROM totals WHERE total <= (SELECT sum(target) FROM goals) GROUP BY key, doc_id
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(got, 0)::BIGINT AS taken
FROM queue q LEFT JOIN got g ON q.key = g.key AND q.doc_id IS NOT DISTINCT FROM g.doc_id
"""
