"""The corpus pipeline: toxicity, quality rules, Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last
return the columns of docs. Rows of one doc_id share its verdict in the filtering stages. Stages with Python work
bound the session's batches by bytes: all stages share executors, whose memory the batches of long texts fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import common, jaccard, mixing, packing, rules, toxicity

#: Packing and the toxicity model are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is in kept (doc_id); a null doc_id counts as a value."""
    ids = kept.select("doc_id").distinct()
    return docs.alias("docs").join(ids.alias("kept"), F.col("docs.doc_id").eqNullSafe(F.col("kept.doc_id")), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on this stage's own documents, does not reject.

    Texts are scored in place: each batch leaves with the rows it keeps, so nothing is shuffled.
    """
    common.small_batches(spark)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.below(docs, model)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rules.kept_rows(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    common.small_batches(spark)
    found = jaccard.near_duplicates(docs)
    return _keep(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    import public_tokenizers

    common.small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_good),
    ("jaccard join", drop_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return packing.digest(STAGES[-1][1](spark, docs, sf_dir))
