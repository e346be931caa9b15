"""A corpus from documents: toxicity, near duplicates, benchmark leaks, private data, and the order of training.

Each stage but the last returns the columns of its documents, whatever their names; columns that only happen to be called like one that an
operator adds are set aside while it works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import curriculum, decontam, jaccard, pii, toxicity
from arbora.llm.common import set_aside, stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learnt from the labels scores under 0.5."""
    docs, back = set_aside(docs, ["doc_id", "text"])
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(docs, model).where("score < 0.5").select(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicated(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands."""
    docs, back = set_aside(docs, ["text"])
    return back(decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_leaks = 0").select(docs.columns))


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their private numbers, dates and addresses replaced; n_chars follows."""
    docs, back = set_aside(docs, ["text", "n_chars"])
    return back(pii.pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns))


def order_for_training(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in training order, with the words that the mix takes of each and the positions at which it does."""
    return curriculum.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", hide_private_data),
    ("mixing", order_for_training),
]

#: Models, shingle joins and embeddings are not SQL; tests/llm checks each stage's rows on a small corpus of planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
