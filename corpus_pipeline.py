"""A corpus pipeline: each stage works on all that the one before it kept, its rows written and read again.

toxicity            documents that the model rejects go (trained on the labelled rows of the documents it gets)
jaccard_join        of each group of documents linked at a similarity of 0.8 of their five-word shingles, the one
                    with the smallest doc_id stays
substring_dedup     passages that stand in a document before are taken out of the text
decontamination     documents that hold a benchmark item go
byte_bpe            ids of the text, and the text decoded from them

All but the last return the columns of documents, whatever their names; the last adds n_tokens, ids and decoded.

Defined results: null and empty texts are kept by every stage (toxicity scores them as clean, they are linked with nothing, hold
no passage and no item, and have no ids); so are rows with a null doc_id, whose texts are still scored, searched and
encoded, but which no other document's copy or passage is measured against. Rows of one doc_id are one document: the
join keeps or drops them together, and passages that they share stay. Rows that repeat in all columns stay as many as they
are where their document stays. Very long texts are read whole. Empty documents give no rows at every stage; without labels nothing
is toxic, without a benchmark nothing is contaminated. A stage's table is deleted once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terravia.llm import bpe, common, decontamination, jaccard, substrings, toxicity


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.filtered(docs, toxicity.model_of(docs, common.table(spark, sf_dir, "labels")), 0.5)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return jaccard.one_of_each(docs, 5, 80)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return substrings.cleaned(docs)


def reject_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.filtered(docs, decontamination.index_of(common.table(spark, sf_dir, "benchmark")))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return bpe.encode(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("jaccard_join", keep_one_of_each),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", reject_benchmark),
    ("byte_bpe", tokenise),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
