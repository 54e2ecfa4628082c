"""A corpus pipeline of five stages over documents; each stage's rows are written and read again.

1. toxicity: documents that score 0.7 or more go (models of the labelled rows that aren't held out);
2. near duplicates: of each class the document with the smallest doc_id stays;
3. long matches: passages of 50 words that another document has too, however they are spaced, are cut out of the texts;
4. decontamination: documents in which an eight-word window of a benchmark item occurs go;
5. mixing: how many words of each document the mix takes.

All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.llm import decontaminate, mixing, neardup, runindex, toxicity
from driftwell.llm.common import broadcast_if, saved, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~toxicity.held_out()).select("doc_id", "toxic")
    return toxicity.reject(docs, toxicity.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_first(docs)


def long_matches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return runindex.cut_documents(docs)


def benchmark_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken."""
    rows, sources, _ = mixing.plan(docs)
    rows = rows.withColumn("source", F.col("pattern")[0])
    named = broadcast_if(sources.withColumnRenamed("source", "name"), sources.count(), mixing.MAX_PATTERNS)
    return rows.join(named, F.col("source").eqNullSafe(F.col("name"))).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("long_matches", long_matches),
    ("decontamination", benchmark_windows),
    ("mixing", mix),
]

#: No SQL expresses the models and signatures of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
