"""Exact deduplication as a stateful stream.

Each row becomes (digest of the normalised text, code points, stable identifier, content locator). A streaming aggregation
without watermark keeps one state entry per digest for good, in RocksDB on disk: how many rows carry the digest, and which
of them stays. When a digest is hit more than once the full bytes of the normalised texts are compared as well, so that a
digest collision cannot merge different texts. Only built-in expressions run on the executors.

Defined results: a null text counts as empty, so null, empty and all-white-space texts form one group; of equal texts the
row with the most code points stays, then the smallest doc_id (a null doc_id comes last), and of rows that agree in both
all name that doc_id while exactly one is kept; repeated rows are rows of their own; an empty table gives an empty result.
Texts of any length are read whole; the identifier is an integer. Columns besides the identifier and the text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, lookup, table, text_of, workdir, written

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores would reserve megabytes each
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
}

FILES_PER_BATCH = 4096


def normalised(text: Column) -> Column:
    """The text without its white space."""
    return F.regexp_replace(text, SPACE + "+", "")


def _entries(docs: DataFrame, digest_bits: int) -> DataFrame:
    """One small row per input row: digest, code points, identifier and locator (a row number that is unique in the table)."""
    sha = F.sha2(normalised(text_of()).cast("binary"), 256)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.monotonically_increasing_id().alias("locator"),
        F.length(text_of()).cast("long").alias("points"),
        sha.alias("text_sha256"),
        F.substring(sha, 1, digest_bits // 4).alias("digest"),
    )


def _best() -> Column:
    """Orders rows so that the largest is the one that stays; the locator decides between rows that agree in the rest."""
    return F.struct(F.col("points"), F.bitwise_not(F.col("doc_id")).alias("order"), F.col("doc_id").alias("keep_id"), F.col("locator").alias("keep_at"))


def stream_state(spark: SparkSession, entries_path: str, schema, keys: list[str], out: str) -> DataFrame:
    """Run the stateful aggregation over the table of entries until it is used up; returns the last state of each key."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(entries_path)
    state = stream.groupBy(*keys).agg(F.max(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/state/n={number}")

    try:  # the state store is the stream's own: the caller's session keeps its settings
        for name, value in STATE_STORE.items():
            spark.conf.set(name, value)
        state.writeStream.outputMode("update").option("checkpointLocation", f"{out}/stream").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    states = spark.read.schema(f"{', '.join(k + ' string' for k in keys)}, best struct<points:bigint,order:bigint,keep_id:bigint,keep_at:bigint>, group_size bigint, batch int").parquet(f"{out}/state/n=*")
    last = states.groupBy(*keys).agg(F.max(F.struct("batch", "best", "group_size")).alias("last"))
    return last.select(*keys, "last.best.keep_id", "last.best.keep_at", "last.group_size")


def exact_dedup(docs: DataFrame, digest_bits: int = 256) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    out = workdir(spark, "exact-dedup")
    entries = written(_entries(docs, digest_bits), f"{out}/entries")
    if entries.isEmpty():
        return entries.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    state = written(stream_state(spark, f"{out}/entries", entries.schema, ["digest"], out), f"{out}/groups")
    # A large group's rows are dealt to several tasks, here and where its state is looked up.
    total, sizes = entries.count(), state.select("digest", F.col("group_size").alias("m"))
    # Full bytes on hits: within a group the least and the greatest text must be the same bytes.
    texts = docs.select(normalised(text_of()).alias("body"), F.monotonically_increasing_id().alias("place")).withColumn("digest", F.substring(F.sha2(F.col("body").cast("binary"), 256), 1, digest_bits // 4))
    ends = lookup(texts, state.where("group_size > 1").select("digest"), ["digest"], sizes, total, ["place"], hint="shuffle_hash").groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    clashes = written(ends.where(F.col("low") != F.col("high")).select("digest"), f"{out}/clashes")
    rows = lookup(entries, state, ["digest"], sizes, total, ["locator"], hint="merge")
    if not clashes.isEmpty():
        # Different texts behind one digest: their groups are formed anew by the bytes themselves, with locators of their own.
        bodies = docs.select(F.monotonically_increasing_id().alias("locator"), F.col("doc_id").cast("long").alias("doc_id"), F.length(text_of()).cast("long").alias("points"), normalised(text_of()).alias("body"))
        bodies = bodies.withColumn("text_sha256", F.sha2(F.col("body").cast("binary"), 256)).withColumn("digest", F.substring("text_sha256", 1, digest_bits // 4)).join(clashes, "digest", "left_semi")
        bodies = written(bodies, f"{out}/bodies")
        groups = bodies.groupBy("body").agg(F.max(_best()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        again = bodies.join(groups, "body").select("digest", "doc_id", "locator", "points", "text_sha256", "best.keep_id", "best.keep_at", "group_size")
        rows = rows.join(clashes, "digest", "left_anti").select("digest", "doc_id", "locator", "points", "text_sha256", "keep_id", "keep_at", "group_size").unionByName(again)
    return rows.select("doc_id", "keep_id", "group_size", (F.col("locator") == F.col("keep_at")).alias("kept"), "text_sha256")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents
), g AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id ASC) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
