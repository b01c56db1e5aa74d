"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of `documents`; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leakdrift.llm.common import sized_semi_join, table, written
from leakdrift.llm.lines import dedup_lines
from leakdrift.llm.mixing import mix_documents
from leakdrift.llm.neardup import near_duplicates
from leakdrift.llm.packing import pack, pieces
from leakdrift.llm.toxicity import with_scores


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject as toxic.

    Null and empty texts are not toxic, repeated rows are judged alike, a null id is one like others; the columns stay
    as they are, also those that are named as the chain's own. Without labels nothing is rejected.
    """
    more = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")] or [F.lit(0)]).alias("_more")
    scored = with_scores(docs.select("doc_id", "text", more), table(spark, sf_dir, "labels")).where("not rejected")
    return scored.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"_more.`{c}`") for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat a kept one; n_chars is the new text's."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies by two-word shingles, as the query of the operator has them.

    Rows that share a doc_id are one document, a null id stays.
    """
    kept = written(near_duplicates(docs, width=2).where("kept and doc_id is not null").select("doc_id").distinct())
    return sized_semi_join(docs, kept, "doc_id").unionByName(docs.where("doc_id is null"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document once for each epoch that takes it, cut where its source's budget ends.

    Null texts have no words and come with their source's whole epochs; a null source is a source; repeated rows are
    documents of their own; an empty table gives an empty one.
    """
    return mix_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in their sequences.

    Null and empty texts are a piece of one id, long ones several; repeated rows and null ids have pieces of their own;
    an empty table has none; other columns are not looked at.
    """
    return pack(pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Trained models, similarity search and packing have no SQL; tests/llm/ holds the operators against brute force and the
#: stages' effects on what the one before kept.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table `documents`; every stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
