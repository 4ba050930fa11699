"""Helpers shared by the text operators: working folders, guarded columns, table reads."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage, as a character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of whole texts that go to Python at a time, at most.
BATCH_ROWS = 500


def workdir(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; a folder of this machine only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back with its own schema."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session sends at most so many rows to Python at a time. Of whole texts Spark's 10,000 are tens of megabytes,
    which the JVM holds beside its heap and each Python worker several times over, and which workers that are used again keep."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of what has been written: Spark deletes them once the driver has collected its handles,
    which it would otherwise do at some later time only, while the next stage fills the same disks. The driver holds on to the last
    execution until there is another one, which is a job of one row here."""
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a working table that nothing reads any more, on whatever store it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key has the remainder of the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def held_out(key: str, modulus: int, rest: int) -> Column:
    return remainder(key, modulus) == F.lit(rest)


#: A key is heavy if it holds more than one in HEAVY of a table's rows, so that there are fewer than HEAVY of them.
HEAVY, LIGHT = 1024, 100


def heavy_keys(sizes: DataFrame, key: str, total: int) -> DataFrame:
    """_key and _parts, into how many parts to deal it, of the heavy ones among sizes (key, m); total is the sum of m.

    At most HEAVY rows by the rule, or total / LIGHT of them if that is less: small enough to be sent to all tasks.
    """
    limit = max(LIGHT, total // HEAVY)
    return F.broadcast(sizes.where(F.col("m") > limit).select(F.col(key).alias("_key"), F.ceil(F.col("m") / limit).cast("int").alias("_parts")))


def lookup(left: DataFrame, right: DataFrame, on: list[str], sizes: DataFrame, total: int, by: list[str], how: str = "inner", hint: str = "") -> DataFrame:
    """left joined to right, which has few rows for each value of on[0]; on[0] is never null in left.

    sizes (on[0], m) holds at least the heavy keys of left with their rows, or more. The rows of a heavy key are dealt to several
    tasks by a hash of the columns `by`, and right's rows go to each of those, so that no key has to fit into one task. A hint
    keeps the plan one and the same at every size of right.
    """
    heavy = heavy_keys(sizes, on[0], total)
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")).cast("int"), F.lit(0))
    near = left.join(heavy, left[on[0]] == F.col("_key"), "left").select(*left.columns, salt.alias("_salt"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))
    far = right.join(heavy, right[on[0]] == F.col("_key"), "left").select(*right.columns, every.alias("_salt"))
    return near.join(far.hint(hint) if hint else far, [*on, "_salt"], how).drop("_salt")


def corpus_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of text, which size the partitions of what follows."""
    rows, size = docs.select(F.octet_length(F.col(column)).alias("b")).agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    return int(rows), int(size)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
