"""From documents to token ids: five stages, each written as Parquet before the next reads it.

All stages but the last return rows of ``docs`` with all their columns, whatever these are
called, and give an empty table for an empty one.  Null and empty texts, repeated rows and
rows without an id go through every stage; what becomes of them is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from impactlake.llm.common import read_table, stage
from impactlake.llm.decontaminate import decontaminated
from impactlake.llm.jaccard_join import near_duplicate_filter
from impactlake.llm.mixing import mixture
from impactlake.llm.quality import good_documents
from impactlake.llm.token_ids import tokenized_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier does not reject.

    Null and empty texts are scored as empty ones; each row is judged by its own text, whatever
    its id, so repeated rows stay or go together.  A score at the threshold stays.
    """
    return good_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, that of the smallest id.

    Rows without an id come after all others; rows that repeat an id and a text are one.
    Texts without words are duplicates of nothing, and all of them stay.
    """
    return near_duplicate_filter(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of any benchmark item occurs.

    Each row is looked at by itself, whatever its id; null and empty texts have no windows and stay.
    """
    return decontaminated(docs, read_table(spark, sf_dir, "benchmark"), min_items=1)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix: a row for each epoch that takes a document.

    Null languages and sources are leaves of their own.  Texts without words take no budget
    and are in no mix; rows with the same id stand at the same place of an epoch's order.
    """
    return mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, written in the file format; the digest of what is read back.

    Rows go by ascending id (none first), those of the same id by their tokens.
    """
    return tokenized_digest(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("token_ids", token_ids)]
#: The classifier and the components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
