"""The stages of the pipeline that run Python send texts in small batches."""

import pyarrow as pa
import pytest

import corpus_pipeline
from driftline.llm.common import BATCH_ROWS, small_batches

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture
def plain(spark):
    before = spark.conf.get(KEY)
    yield spark
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("stage", [corpus_pipeline.quality_stage, corpus_pipeline.near_dedup_stage, corpus_pipeline.encode_stage])
def test_stages_send_few_rows_at_a_time(plain, stage):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    plain.conf.set(KEY, 10_000)
    stage(plain, plain.read.parquet(f"{SMOKE}/documents.parquet"), SMOKE)
    sent = [r["n"] for r in plain.range(0, 3 * BATCH_ROWS, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert sum(sent) == 3 * BATCH_ROWS and max(sent) == BATCH_ROWS


def test_smaller_batches_of_the_session_stay(plain):
    plain.conf.set(KEY, 7)
    small_batches(plain)
    assert plain.conf.get(KEY) == "7"
    plain.conf.set(KEY, 0)  # no limit
    small_batches(plain)
    assert plain.conf.get(KEY) == str(BATCH_ROWS)
