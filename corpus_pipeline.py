"""From raw documents to shuffled shards of training text: five stages, each over all rows of the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from grainsift.llm import decontaminate, minhash, mixing, sharding, toxicity
from grainsift.llm.common import table
from grainsift.operators.materialize import materialize

#: SQL can't express the trained model, the signatures or the permutation; tests hold the stages against plain code
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the toxicity model, fitted on the labelled rows, does not call toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_sample(docs, labels))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked at a similarity of 0.8 over five-word shingles."""
    return minhash.drop_near_duplicates(docs, percent=80, width=5)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item, up to a fifth of its words edited."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the mix of sources at target weights; a row drawn several times comes several times."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and slot."""
    return sharding.shard_rows(docs, 16)


STAGES = [("toxicity", drop_toxic), ("minhash_dedup", drop_near_duplicates), ("decontamination", decontaminated),
          ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
