"""Exact top-k by inner product over an impact-ordered index, score at a time.

Candidates are cut into blocks.  The impact of a candidate in a dimension is its integer value,
quantised by binary digits: the posting segment (dimension, digit, sign) holds the candidates whose
value has that digit, and all of it adds the same amount to a query's scores.  Segments are
processed digit by digit, largest impact first, for all dimensions together (a segment is
a column of a matrix of -1, 0 and 1, since about half of the candidates are in each).

What lower digits can still add to a candidate is bounded by the norm of what is left of it times
the query's norm.  Processing stops only on proof: the k-th best lower bound is a threshold, and when few
candidates' upper bounds reach it, these possible members, and nobody else, are scored exactly.

Queries and candidates meet block by block through a join on block numbers, each task holding one
block of either; the best k of each block are merged by query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.llm.common import landed

#: Candidates of a block, queries of a block, and queries processed together.
CANDIDATES, QUERIES, TOGETHER = 1 << 13, 1 << 14, 64


class Block:
    """Posting segments of one block of integer vectors (one row each), by digit of their impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.size = np.abs(vectors)
        self.digits = max(1, int(self.size.max(initial=0)).bit_length())
        self.slices: dict = {}

    def segments(self, digit: int, kind) -> tuple[np.ndarray, np.ndarray]:
        """Columns of -1, 0 and 1 for one digit, and the norm of what lower digits hold of each candidate."""
        if (digit, kind) not in self.slices:
            sign = np.sign(self.vectors)
            left = (self.size & ((1 << digit) - 1)).astype(np.float64)
            self.slices[digit, kind] = ((sign * (self.size >> digit & 1)).astype(kind).T.copy(), np.sqrt((left * left).sum(axis=1)))
        return self.slices[digit, kind]

    def best(self, queries: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the positions and exact scores of its k best candidates, ties to smaller ids; those with id ``own`` take no part."""
        n = len(self.ids)
        largest = float(np.abs(queries).sum(axis=1).max(initial=0)) * float(self.size.max(initial=0))
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64  # sums are exact in it
        norms = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        score, open_ = np.zeros((len(queries), n), dtype=kind), np.arange(len(queries))
        mine = self.ids[None, :] == own[:, None]
        out: list = [None] * len(queries)
        for digit in range(self.digits - 1, -1, -1):
            columns, left = self.segments(digit, kind)
            score[open_] += (queries[open_].astype(kind) @ columns) * kind(1 << digit)
            going = []
            for i in open_.tolist():
                wanted = min(k, n - int(mine[i].sum()))
                slack = left * (norms[i] * (1 + 1e-9)) + (1e-6 if digit else 0)
                low = np.where(mine[i], -np.inf, score[i] - slack) if kind is not np.int64 or digit else np.where(mine[i], np.iinfo(np.int64).min, score[i])
                least = np.partition(low, n - wanted)[n - wanted] if wanted else None
                members = np.flatnonzero(score[i] + slack >= least) if digit and wanted else np.flatnonzero(score[i] >= least) if wanted else np.zeros(0, dtype=np.int64)
                members = members[~mine[i][members]]
                if digit and len(members) > max(4 * wanted, n // 16):
                    going.append(i)
                    continue
                exact = self.vectors[members] @ queries[i]
                order = np.lexsort((self.ids[members], -exact))[:wanted]
                out[i] = (members[order], exact[order])
            open_ = np.array(going, dtype=np.int64)
            if not len(open_):
                return out
        raise AssertionError("the last digit leaves nothing open")


def top_k(
    vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
    candidates: int = CANDIDATES, queries: int = QUERIES,
) -> DataFrame:
    """The k best candidates of each query by integer inner product of floor(scale * component): query_id, rank, id, score.

    ``is_query`` is a column over ``vectors``; every row but the query's own is a candidate.  Vectors that are null, empty, or hold null
    or non-finite components, and rows without an id, take no part.  Shorter vectors count as ended by zeros.  Rows that repeat an id are
    one candidate each and one query together (of the smallest vector).  Ties go to the smaller id.  Scores must fit 64 bits.  Fewer
    than k candidates give all; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    whole = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))
    sound = ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    usable = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(sound, F.lit(False))
    ready = landed(vectors.filter(usable).select(F.col(id_column).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")), "vectors")
    n, asking, width = ready.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks, asks = max(1, -(-n // candidates)), max(1, -(-asking // queries))
    query_rows = ready.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    left = query_rows.select(F.pmod(F.xxhash64("id"), F.lit(asks)).cast("int").alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("asks"), "id", "v")
    lines = F.explode(F.sequence(F.lit(0), F.lit(asks - 1)))
    right = ready.select(lines.alias("ask"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(False).alias("asks"), "id", "v")

    def answer(key, batches):
        ids, rows, mine, sought = [], [], [], []
        for batch in batches:
            flat, size = batch.column(4).flatten().to_numpy(zero_copy_only=False), batch.column(4).value_lengths().to_numpy(zero_copy_only=False)
            matrix = np.zeros((batch.num_rows, width), dtype=np.int64)
            matrix[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            asks_here, numbers = batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(3).to_numpy(zero_copy_only=False)
            ids.append(numbers[~asks_here])
            rows.append(matrix[~asks_here])
            mine.append(numbers[asks_here])
            sought.append(matrix[asks_here])
        ids, rows, mine, sought = (np.concatenate(x) for x in (ids, rows, mine, sought))
        out: list = [[], [], []]
        if len(ids) and len(mine):
            block = Block(ids, rows)
            for a in range(0, len(mine), TOGETHER):
                for i, (at, score) in zip(mine[a : a + TOGETHER].tolist(), block.best(sought[a : a + TOGETHER], mine[a : a + TOGETHER], k), strict=True):
                    out[0] += [i] * len(at)
                    out[1] += ids[at].tolist()
                    out[2] += score.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "id", "score"])

    def by_pair(batches):
        """Rows of one pair of blocks after another."""
        key, held = None, []
        for batch in batches:
            pair = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) * blocks + batch.column(1).to_numpy(zero_copy_only=False)
            cut = [0, *(np.flatnonzero(pair[1:] != pair[:-1]) + 1).tolist(), len(pair)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if key is not None and pair[a] != key:
                    yield from answer(key, held)
                    held = []
                key = int(pair[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from answer(key, held)

    met = left.unionByName(right).repartition("ask", "block").sortWithinPartitions("ask", "block")
    found = met.mapInArrow(by_pair, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_column), "score")
