"""A training corpus in five stages: quality filter, exact and near deduplication, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. Extra columns are carried through.

Rows that share a doc_id (or have none) count as one document where a stage decides by id: they stay or go together, except
that of rows that agree in id and text one stays. Null and empty texts pass the quality filter or not by their score, form
one group of exact copies, are linked with nothing, and are taken by no mix, since they have no words.

What a stage decides is joined to the texts by id. The lists of ids grow with the input, so these joins are hinted to deal out
both sides at every size instead of sending a list that happens to be small to all tasks.

Stages that run Python lower spark.sql.execution.arrow.maxRecordsPerBatch of the session, since an executor runs all stages and its
JVM and Python workers keep the memory that the largest of them took.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import exact_dedup, mixing, ngram_join, pieces, quality
from driftline.llm.common import lookup, small_batches, table, text_of, workdir, written

#: Not in SQL: the classifier is fitted in numpy, and the last stage gives token ids.
ORACLE_SQL = None


def packed(docs: DataFrame) -> DataFrame:
    """id, and row: all columns of docs in one, so that no name of theirs clashes with a name that a stage adds."""
    return docs.select(F.col("doc_id").alias("id"), F.struct(*docs.columns).alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the discriminant does not reject."""
    small_batches(spark)
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    out = workdir(spark, "stage-exact")
    found = written(exact_dedup.exact_dedup(docs), f"{out}/found")
    by_id = written(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept")), f"{out}/ids")
    plain = by_id.where("rows = 1 and kept and doc_id is not null").select(F.col("doc_id").alias("id"))
    rows = packed(docs)
    stay = rows.join(plain.hint("shuffle_hash"), "id", "left_semi").select("row")
    again = by_id.where("rows > 1 or doc_id is null").select(F.col("doc_id").alias("again"))
    if not again.isEmpty():
        # Several rows with one id: the text decides, and of rows equal in both one stays.
        kept = found.where("kept").select(F.col("doc_id").alias("kept_id"), "text_sha256")
        again = again.join(kept, F.col("again").eqNullSafe(F.col("kept_id"))).select("again", "text_sha256").distinct()
        text = text_of("row.text")
        more = rows.withColumn("sha", F.sha2(exact_dedup.normalised(text).cast("binary"), 256)).withColumn("points", F.length(text))
        more = more.join(again, F.col("id").eqNullSafe(F.col("again")) & (F.col("sha") == F.col("text_sha256")))
        first = more.groupBy("again", "sha").agg(F.max(F.struct("points", "row")).alias("first"))
        stay = stay.unionByName(first.select("first.row"))
    return stay.select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of near copies."""
    small_batches(spark)
    out = workdir(spark, "stage-near")
    found = written(ngram_join.ngram_join(docs), f"{out}/found")
    # A row without id stays if it is linked with no row that has one.
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("stays")).distinct()
    return packed(docs).join(stay.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("stays")), "left_semi").select("row.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Rows alike in id, source and text share what the mix takes of them evenly, the first of them by their place in the input one more.
    """
    out = workdir(spark, "stage-mix")
    mixed = written(mixing.mix(docs).where("size > 0"), f"{out}/mixed")
    by = [F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("text_hash").alias("mix_hash")]
    times = mixed.groupBy(*by).agg(F.count(F.lit(1)).alias("alike"), F.sum(F.expr("taken div size")).alias("times")).where("times > 0")
    rows = packed(docs).withColumn("hash", F.xxhash64(text_of("row.text")))
    same = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("row.source").cast("string").eqNullSafe(F.col("mix_source")) & (F.col("hash") == F.col("mix_hash"))
    dealt = lambda n: F.explode(F.sequence(F.lit(1), n.cast("int")))
    stay = rows.join(times.where("alike = 1").hint("shuffle_hash"), same).select("row", dealt(F.col("times")).alias("copy")).select("row")
    again = times.where("alike > 1")
    if not again.isEmpty():
        # Their places are counted in slices, so that no group of copies has to fit into one task.
        again = again.withColumn("key", F.xxhash64("mix_id", "mix_source", "mix_hash"))
        more = rows.withColumn("place", F.monotonically_increasing_id()).withColumn("key", F.xxhash64("id", F.col("row.source").cast("string"), "hash"))
        total = again.agg(F.sum("alike")).first()[0]
        more = lookup(more, again, ["key"], again.select("key", F.col("alike").alias("m")), total, ["place"]).where(same)
        more = more.select("row", "place", "mix_id", "mix_source", "mix_hash", "alike", "times", F.lit(1).alias("one"), F.expr(f"place div {mixing.SLICE_ROWS}").alias("slice"))
        more = written(more, f"{out}/alike")
        more = mixing.running(more, [F.col("mix_id"), F.col("mix_source"), F.col("mix_hash")], F.col("slice"), [F.col("place")], "one", "nth")
        own = F.expr("times div alike + if(nth <= times % alike, 1, 0)")
        stay = stay.unionByName(more.withColumn("own", own).where("own > 0").select("row", dealt(F.col("own")).alias("copy")).select("row"))
    return stay.select("row.*")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, ids and round_trip of each row."""
    small_batches(spark)
    return pieces.encode(docs, carry=("doc_id", "source"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encode_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    out = workdir(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"{out}/{k}")
    return docs
