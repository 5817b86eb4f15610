"""A corpus pipeline: each stage applies one operator of billweave.llm to what the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from billweave.llm.bpe import encode_documents
from billweave.llm.common import saved, table
from billweave.llm.decontamination import without_contaminated
from billweave.llm.ngram_join import keep_one
from billweave.llm.pii import redacted
from billweave.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the machine trained on the labels calls toxic go."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity of 0.8 or more."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is words of benchmark items go."""
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked by the name of its kind."""
    return redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: the columns of documents with ids, offsets and decoded."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=docs.columns)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("privacy", privacy), ("tokens", tokens)]
#: Training and iterative stages are not expressible in SQL. The stages' operators are tested against plain versions (toxicity by its
#: kernel and held-out accuracy), run() only against the same stages called one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
