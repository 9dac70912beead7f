"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes what the one before kept and returns rows with the columns of documents; the
last returns pieces of packed sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlens.llm import exact_dedup, packing, secret_scan, simhash, toxicity
from tremorlens.llm.common import table
from tremorlens.llm.queries import tokenizer
from tremorlens.session import shared_dir

#: No SQL: a trained classifier, 64-bit text hashes and BPE ids are outside of it; tests hold each stage against a plain version.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not take for toxic; it is fitted on the labelled ones among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_rows(docs, model).filter(toxicity.predicted() == 0).select("row.*")


def staying(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose key is in ``kept`` (column k), one for each key."""
    rows = docs.select(F.struct("*").alias("row"), key.alias("k"))
    return rows.join(kept.distinct(), "k", "left_semi").dropDuplicates(["k"]).select("row.*")


def named(row_id: Column) -> Column:
    return F.coalesce(row_id.cast("string"), F.lit("null"))


def text_digest() -> Column:
    return F.sha2(F.coalesce("text", F.lit("")), 256)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest id (one of its rows, if rows repeat)."""
    kept = exact_dedup.classes(docs).filter("kept").select(F.concat_ws(" ", named(F.col("doc_id")), "text_sha256").alias("k"))
    return staying(docs, F.concat_ws(" ", named(F.col("doc_id")), text_digest()), kept)


#: Words of a shingle in this stage, and likeness of texts that one fingerprint cannot tell; op5's contract of four words binds its query.
NEAR_SHINGLE, NEAR_LIKENESS = 5, 0.8


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: the one with the smallest id (a null id comes last), then the smallest text digest.

    Rows are told apart by id and text, so texts that share an id, or have none, stand for themselves; of rows that repeat both, one stays.
    """
    # The smallest key of a component names it: it is held by this component alone, which an id is not.
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("named"), text_digest().alias("digest"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key", shingle=NEAR_SHINGLE, likeness=NEAR_LIKENESS)
    kept = found.filter(F.col("key") == F.col("component_id")).select(F.concat_ws(" ", named(F.col("key.named")), "key.digest").alias("k"))
    return staying(docs, F.concat_ws(" ", named(F.col("doc_id")), text_digest()), kept)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced by a mark; n_chars follows where a text changes."""
    clean = secret_scan.secrets(docs).select("row", "spans", secret_scan.redacted(F.col("row.text"), F.col("spans")).alias("clean"))
    length = F.when(F.size("spans") > 0, F.length("clean")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    changed = {"text": F.col("clean"), "n_chars": length}
    return clean.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; ``ids`` holds a piece's tokens."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what each returns is written and read again as the next one's input."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        done, path = stage(spark, docs, sf_dir), f"{folder}/{k}-{name}"
        done.write.parquet(path)
        docs = spark.read.schema(done.schema).parquet(path)
    return docs
