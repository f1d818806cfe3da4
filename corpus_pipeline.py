"""From raw documents to packed training sequences: five stages over the operators of folioworks.llm.

Each stage works on all that its predecessor kept; its output is written as Parquet and
reread. All but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import decontaminate, language, neardup, packing, quality
from folioworks.llm.common import column, free_names, table, written


# Each stage takes a null text as an empty one, a very long text whole, and any further columns,
# whatever their names; equal rows meet the same fate (but for the near-duplicates', of which one
# stays), and an empty table gives an empty one.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the rule ensemble, fitted on the labelled documents, scores 0.5 or more.

    Empty and null texts are scored as any other. A doc_id that occurs several times teaches
    once; without labels every row scores 0.5 and stays."""
    model = quality.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    (score,) = free_names(docs.columns, "score")
    return quality.score(docs, model, docs.columns, score).where(column(score) >= 0.5).select(*map(column, docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with letters whose language the model, fitted on the documents with a language, doesn't reject.

    Null and empty texts and those without a letter go; where no document has a language, so do all."""
    model = language.learn(docs, F.lit(True))
    names = tuple(free_names(docs.columns, *language.PREDICTED))
    return language.predict(docs, model, docs.columns, names).where(~column(names[2])).select(*map(column, docs.columns))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: that with the least (doc_id, hash of the text), a null id first.

    Null and empty texts are copies of each other; of equal rows one stays."""
    return neardup.deduplicated(docs).select(*map(column, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; null, empty and wordless texts stay."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark")).select(*map(column, docs.columns))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in near-equal sequences; a null or empty text is its end token alone, other columns go."""
    return packing.packed_digest(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("neardup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Classes of near-duplicates and token packing are beyond DuckDB's SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
