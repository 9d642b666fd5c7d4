"""From raw documents to packed training sequences.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it kept;
its result is written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of ``documents``; extra columns stay as they are, whatever their
names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import linequality, minhash, packing, rlz, toxicity
from tidemark.llm.common import nested, stage


def _apart(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in the struct ``row``, where no operator's names can clash with theirs."""
    return docs.select("doc_id", "text", nested([c for c in docs.columns if c.lower() not in ("doc_id", "text")]))


def _columns_of(docs: DataFrame, apart: DataFrame, cleaned: str | None = None) -> DataFrame:
    """The columns of ``docs`` again; with ``cleaned`` that text (null where it was null) and its length."""
    text = F.when(F.col("text").isNotNull(), F.col(cleaned)) if cleaned else F.col("text")
    given = {"doc_id": F.col("doc_id"), "text": text}
    if cleaned:
        given["n_chars"] = F.coalesce(F.length(text), F.lit(0))
    return apart.select(*(given.get(f.name.lower(), F.col("row")[f.name]).cast(f.dataType).alias(f.name) for f in docs.schema))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns_of(docs, toxicity.score(_apart(docs), model).filter("not rejected"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep enough of their lines, without the lines that fail."""
    return _columns_of(docs, linequality.clean_lines(_apart(docs)).filter("kept"), "clean_text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id.

    A document is an id with a text, so different texts under one id are judged each on its
    own; of those in one group the text with the smallest hash stays.  Of rows with the same
    id and text one stays, the smallest by the other columns in their order.
    """
    known = _apart(docs.filter("doc_id is not null")).withColumn("key", F.xxhash64("text"))
    clashes = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high")
    if clashes.isEmpty():
        kept = minhash.near_duplicates(docs, words=5, share=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    else:  # nodes numbered in the order of ids: the sort's partitions are in order, and so are the numbers
        nodes = known.select("doc_id", "key").distinct().orderBy("doc_id", "key").withColumn("node", F.monotonically_increasing_id())
        nodes = stage(nodes, "pipeline-nodes")
        numbered = known.join(nodes, ["doc_id", "key"]).select(F.col("node").alias("doc_id"), "text")
        groups = minhash.near_duplicates(numbered, words=5, share=80).filter("kept").select(F.col("doc_id").alias("node"))
        kept = nodes.join(groups, "node", "left_semi").select("doc_id", "key")
    one_each = known.join(kept, kept.columns, "left_semi").groupBy("doc_id", "key").agg(F.min(F.struct("row", "text")).alias("first"))
    return _columns_of(docs, one_each.select("doc_id", "first.*")).union(docs.filter("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere too; those of which nothing is left go."""
    cut = rlz.remove_repeats(_apart(docs)).filter("n_removed = 0 or n_removed < n_words")
    return _columns_of(docs, cut, "kept_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, each window with the corpus's mixture of sources."""
    out = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=2048, end_id=1)
    return out.select("doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", clean_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: Regression, signatures and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
