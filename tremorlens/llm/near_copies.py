"""Near copies by shared runs of words: what the near-duplicate stage takes beyond fingerprints.

One fingerprint of 64 bits tells likenesses of 0.95 and up (see README): at 0.8 about ten of its bits
differ, and lists of bytes that such pairs are sure to share do not exist.  The stage therefore indexes a
longer signature by position.  A signature holds the smallest hash of the text's distinct runs of five words under
each of ``BANDS * ROWS`` hash functions; a band of ``ROWS`` neighbours agrees with probability
likeness ** ROWS, whatever the size of the table, so that posting lists (band, its value) hold near copies and hardly
anything else.

A list gives out no pairs: its members, ordered by the size of their sets, are linked each to the next, across
the borders of partitions too, so a list of any length is a chain over many tasks.  The order is the same in all lists, so that lists
of one group of copies give the same few links.  Every link is verified by the exact likeness of the two sets of runs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.llm.common import landed

#: Likeness from which on texts are near copies, bands of a signature and hash functions of a band.
LIKENESS, BANDS, ROWS = 0.8, 20, 8
#: Runs that are hashed by all functions at a time.
TOGETHER = 1 << 10


def word_runs(hashes: list[int]) -> np.ndarray:
    """Set of the runs of a text (uint32, sorted) from the hashes of them all."""
    return np.unique(np.array(hashes, dtype=np.uint64).astype(np.uint32))


@lru_cache(maxsize=4)
def functions_of(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of the hash functions, by a fixed seed."""
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, count, dtype=np.uint32)


def bands_of(runs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> list[int]:
    """Value of each band: a hash of the smallest values of its functions, with the number of the band."""
    a, b = functions_of(bands * rows)
    least = np.full(bands * rows, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(runs), TOGETHER):
        x = np.multiply.outer(runs[i : i + TOGETHER], a)
        x += b
        np.minimum(least, x.min(axis=0), out=least)
    raw = least.tobytes()
    return [xxhash.xxh64_intdigest(raw[4 * rows * k : 4 * rows * (k + 1)], k) - (1 << 63) for k in range(bands)]


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Shared part of two sorted sets of distinct hashes; two empty ones are alike."""
    shared = len(np.intersect1d(left, right, assume_unique=True))
    every = len(left) + len(right) - shared
    return shared / every if every else 1.0


def chained(postings: DataFrame) -> DataFrame:
    """Links (a, b) between neighbours of every list (list, size, node), however many tasks it lies in."""
    keys = ["list", "size", "node"]

    def link(batches):
        """Links inside the partition; its first and last row are left for the links between partitions."""
        from pyspark import TaskContext

        task, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            lists, members = batch.column(0).to_numpy(), batch.column(2)
            same = np.flatnonzero(lists[1:] == lists[:-1])
            a, b = members.take(pa.array(same)), members.take(pa.array(same + 1))
            if last is None:
                first = (int(lists[0]), members[0])
            elif last[0] == lists[0]:
                a, b = pa.concat_arrays([pa.array([last[1].as_py()], members.type), a]), pa.concat_arrays([members.slice(0, 1), b])
            last = (int(lists[-1]), members[-1])
            n, none = len(a), pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([a, b, none, none.cast(pa.int32()), pa.nulls(n, pa.int32())], names=["a", "b", "list", "task", "rim"])
        if last is not None:
            ends = pa.array([first[1].as_py(), last[1].as_py()], first[1].type)
            yield pa.RecordBatch.from_arrays(
                [ends, pa.nulls(2, ends.type), pa.array([first[0], last[0]], pa.int64()), pa.array([task] * 2, pa.int32()), pa.array([0, 1], pa.int32())], names=["a", "b", "list", "task", "rim"]
            )

    found = landed(postings.select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(link, "a long, b long, list long, task int, rim int"), "chains")
    order = Window.orderBy("task", "rim")  # two rows for each partition
    rims = found.filter("rim is not null").select("rim", "list", "a", F.lead("list").over(order).alias("next_list"), F.lead("a").over(order).alias("next_a"))
    between = rims.filter("rim = 1 AND list = next_list").select("a", F.col("next_a").alias("b"))
    return found.filter("rim is null").select("a", "b").union(between).filter("a <> b").distinct()


def verified(links: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) whose sets of runs (node, runs) are alike enough."""

    def check(batches):
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                good[k] = likeness(np.frombuffer(x.as_buffer(), "<u4"), np.frombuffer(y.as_buffer(), "<u4")) >= least
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(good)) for k in (0, 1)], names=["a", "b"])

    left, right = sets.toDF("a", "left"), sets.toDF("b", "right")
    return links.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def alike(signed: DataFrame, least: float = LIKENESS) -> DataFrame:
    """Links (a, b) between nodes whose texts are alike, from rows of texts (node, runs, lists).

    Rows of one node are taken for alike already: its lists are those of all its rows, its set is that of one.
    """
    postings = signed.select(F.explode("lists").alias("list"), (F.length("runs") / 4).cast("int").alias("size"), "node")
    links = landed(chained(postings.groupBy("list", "node").agg(F.min("size").alias("size")).select("list", "size", "node")), "candidates")
    sought = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    sets = landed(signed.join(sought, "node", "left_semi").groupBy("node").agg(F.min("runs").alias("runs")), "sets")
    return verified(links, sets, least)
