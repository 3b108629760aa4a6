"""The pipeline's stages send long texts to Python in small batches, and all of them."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankloom.llm import common

KEY, SF = "spark.sql.execution.arrow.maxBytesPerBatch", "/root/testdata/sf0.001"


def sizes(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])


@pytest.fixture
def session(spark):
    before = spark.conf.get(KEY)
    yield spark
    spark.conf.set(KEY, before)


@pytest.mark.parametrize("name", ["toxicity", "jaccard join", "packing"])
def test_stage_bounds_batches(session, name):
    corpus = pytest.importorskip("corpus_pipeline")
    wide = session.range(0, 1500, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 4000 + int(id))").alias("text"))
    most = lambda: wide.mapInArrow(sizes, "bytes long, rows long").agg(F.max("bytes"), F.sum("rows")).first()
    session.conf.unset(KEY)
    assert most()[0] > 16 * common.BATCH_BYTES / 2
    dict(corpus.STAGES)[name](session, session.read.parquet(f"{SF}/documents.parquet"), SF)
    found, rows = most()
    assert found < 1.1 * common.BATCH_BYTES and rows == 1500


def test_lower_bound_stays(session):
    session.conf.set(KEY, "1m")
    common.small_batches(session)
    assert session.conf.get(KEY) == "1m"
