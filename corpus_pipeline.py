"""From raw documents to packed training sequences: reject, deduplicate, remove repeats, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopewatch.llm.common import Workspace
from slopewatch.llm.near_duplicates import without_near_duplicates
from slopewatch.llm.packing import pack_documents
from slopewatch.llm.quality import classify
from slopewatch.llm.suffix_array_dedup import suffix_array_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects as of low quality or toxic go.

    Each row is decided on by itself, so repeated rows share their fate.  Null and empty texts, languages and sources are
    scored like any other; a document as likely bad as not goes.  Without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c in ("low_quality", "toxicity", "kept")}  # named like results
    return classify(docs.withColumnsRenamed(own), labels).filter("kept").select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays: the one with the smallest doc_id.

    Decided by row, not by id: rows of one id with different texts are documents of their own, copies without an id
    are found too.  Rows without words stay, unless they repeat an id and text.
    """
    return without_near_duplicates(docs, percent=80)


#: Words of a passage that is cut out where it occurs in several places.
PASSAGE = 35


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 35 words that occur elsewhere too are cut out of the texts; n_chars follows.

    White space around a passage stays.  A null text becomes an empty one; a text that is nothing but such passages
    keeps its row.  Rows that repeat an id are documents of their own.
    """
    other = {c: f"carried_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    cut = suffix_array_dedup(docs, length=PASSAGE, unit="words", carry=other)
    text = F.coalesce("kept", F.lit(""))
    named = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return cut.select(*[named[c].alias(c) if c in named else F.col(other[c]).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 tokens."""
    return pack_documents(docs)


STAGES = [("quality classifier", quality), ("near-duplicate removal", near_dedup), ("repeat removal", repeats), ("packing", packing)]

#: SQL can't express trained classifiers, suffix indexes or tokenizers; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents, each on the written result of the one before."""
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = ws.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))  # the stage before is no longer needed
    return docs
