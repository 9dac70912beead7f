"""Exact duplicates by a tree of merges of sorted digest runs, in DataFrame operations only.

Input partitions are dealt to ``RUNS`` runs by number.  A run is the distinct digests of its rows, each
with the identifier that stays and how many texts it stands for, written in buckets of the digest and
sorted within.  Runs are exchanged in binomial rounds: in round k, run r meets run r + 2^k.  Two runs are
merged bucket by bucket by a full outer merge join, which reads both in order; nothing is dealt anew, since all runs
are bucketed alike.  After the last round one run is left.

"Equal" is verified at every level: rows merge only where digest, length in bytes and a second,
independent hash agree.  The most common text of all is one row in each run, so no merge has a hot key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlens.llm.common import landed
from tremorlens.session import shared_dir

#: Runs at the leaves, neighbours that are merged into one before the next round, and distinct rows of a bucket.
RUNS, FAN_IN, BUCKET_ROWS = 8, 2, 1_000_000
SAME = ["digest", "n_bytes", "check"]


def _sorted_run(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` (one row for each digest) as a table in the shared folder, bucketed by digest and sorted within buckets."""
    spark, name = df.sparkSession, f"digest_run_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.format("parquet").option("path", path).bucketBy(buckets, *SAME).sortBy(*SAME).saveAsTable(name)
    return spark.table(name)


def merged(left: DataFrame, right: DataFrame, best) -> DataFrame:
    """One run of two: digests of both, the identifier that stays and how many texts there are."""
    other = right.toDF(*(f"of_{c}" for c in right.columns))
    same = [left[c] == other[f"of_{c}"] for c in SAME]
    met = left.hint("merge").join(other, same[0] & same[1] & same[2], "full")
    return met.select(
        *(F.coalesce(c, f"of_{c}").alias(c) for c in SAME), best("keep_id", "of_keep_id").alias("keep_id"),
        (F.coalesce("group_size", F.lit(0)) + F.coalesce("of_group_size", F.lit(0))).alias("group_size"),
    )


def classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", keep: str = "max", runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null counts as empty.  ``keep`` is ``max`` or ``min``: which identifier of a group stays.  Rows that
    repeat an id and a text all count in group_size and are all marked kept if that id stays.  A null id never stays unless no other
    row has the text (then keep_id is null and the row is kept).  Other columns are not read; an empty table gives no rows.
    """
    spark, (within, best) = docs.sparkSession, ((F.max, F.greatest) if keep == "max" else (F.min, F.least))
    content = F.coalesce(F.col(text), F.lit(""))
    marked = landed(
        docs.select(
            F.col(id_column).alias("id"), F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).alias("n_bytes"), F.xxhash64(content).alias("check"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        ),
        "digests",
    )
    buckets = spark.sparkContext.defaultParallelism + marked.count() // BUCKET_ROWS
    level = []
    for r in range(runs):
        own = marked.filter(F.col("run") == r).groupBy(*SAME).agg(within("id").alias("keep_id"), F.count("*").alias("group_size"))
        level.append(_sorted_run(own.repartition(buckets, *SAME), buckets))
    while len(level) > 1:  # a round
        upper = []
        for k in range(0, len(level), fan_in):
            run = level[k]
            for other in level[k + 1 : k + fan_in]:
                run = _sorted_run(merged(run, other, best), buckets)
            upper.append(run)
        level = upper
    found = level[0].select(*(F.col(c).alias(f"of_{c}") for c in SAME), "keep_id", "group_size")
    equal = [marked[c] == found[f"of_{c}"] for c in SAME]
    return marked.join(found.hint("merge"), equal[0] & equal[1] & equal[2]).select(
        F.col("id").alias(id_column), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
