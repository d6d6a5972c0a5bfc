"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return
the columns of documents, with any further columns that docs have, unchanged.

Null and empty texts pass all filtering stages (all of them count as copies of
each other in near-dedup) and are the end id alone in packing.  Texts of any
length are taken whole.  Repeated rows are judged each and count as copies.
Empty tables of labels or benchmark items take nothing out; empty documents
give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.llm import decontamination, near_dedup, packing, quality, toxicity
from telemill.llm.queries import table, tokenizer_path
from telemill.llm.store import written


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, in any case of letters."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below their language's threshold (a null or rare language's: that over all rows; without labels of both classes: 0.3)."""
    net = toxicity.train(docs, table(spark, sf_dir, "labels"))
    own = _free(docs, "__toxicity")
    return toxicity.score(docs, net, into=own).where(~toxicity.rejected(net, scores=own)).drop(own)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text stays at or below the threshold of their language and length."""
    own = _free(docs, "__verdict")
    return quality.verdicts(docs, table(spark, sf_dir, "labels"), own).where(F.col(f"{own}.keep")).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one of the least doc_id."""
    return near_dedup.deduplicate(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans that they share with benchmark items; those that are mostly such spans go.  n_chars counts the new text."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_low_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("packing", pack),
]

#: SQL cannot express the trained stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; between stages the documents are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline-docs")
    return docs
