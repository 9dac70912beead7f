"""Mixture-controlled packing of documents into training sequences.

Every source is a queue of tokens.  Deficit round-robin serves queues in quanta: a queue earns
credit in proportion to its target share, is served one quantum when it has earned it, and
carries what it is short of into the next window.  A queue starts with a part of a quantum as credit (by
its name, so that queues of one quantum each do not all wait for the end); the quantum from a queue's token
a is then due at time (a + part * size) / share, so the order of service is the order of these times, ties by source: every
window of the stream holds each source in its share, give or take a quantum.  A queue that runs
dry leaves its credit to the others, whose times, and so whose order, stay as they are.  The
shares of the input are the default: with them all queues run dry together and nothing is left over.

No task and no driver sees a list of sources.  A task cuts what it holds of a queue into quanta of its own; a
running sum over tasks places them in the queue.  Quanta are then sorted by their times over
all partitions, and a running sum over partitions gives each its place in the stream: deficits
carry across windows and partitions without a serial pass, for any number of sources.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.llm.bpe import json_encoder, runs
from tremorlens.llm.common import SLICE_BYTES, landed, slices, texts_of

SEQUENCE = 2048
#: Tokens of one service.
QUANTUM = 512
#: Id that ends every document.
END_ID = 1


def cut(start: np.ndarray, count: np.ndarray, quantum: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Parts of documents that hold tokens [start, start + count) of a queue, one for each quantum: document, quantum, first token in the document, length."""
    n = (start + count - 1) // quantum - start // quantum + 1
    doc, block = np.repeat(np.arange(len(start)), n), runs(start // quantum, n)
    low, high = np.maximum(block * quantum, start[doc]), np.minimum((block + 1) * quantum, (start + count)[doc])
    return doc, block, low - start[doc], high - low


def coded_parts(docs: DataFrame, path: str, id_column: str, text: str, source: str, quantum: int) -> DataFrame:
    """Parts of all documents: id, queue, part (task), slot (of the queue in the task), k (quantum), at (place in it), start, length, doc_tokens, ids."""
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches):
        from pyspark import TaskContext

        encoder, task, slots, sent = json_encoder(path), TaskContext.get().partitionId(), {}, []
        last = END_ID.to_bytes(4, "little")
        for part in slices(batches, 1, SLICE_BYTES // 2):
            ids, begin = encoder.encode(texts_of(part.column(1)))
            n = np.diff(begin) + 1
            slot = np.zeros(len(n), dtype=np.int64)
            before = np.zeros(len(n), dtype=np.int64)
            for i, (q, k) in enumerate(zip(part.column(2).to_pylist(), n.tolist(), strict=True)):
                s = slots.setdefault(q, len(slots))
                if s == len(sent):
                    sent.append(0)
                slot[i], before[i] = s, sent[s]
                sent[s] += k
            doc, block, start, length = cut(before, n, quantum)
            ends = start + length
            raw = ids.astype("<u4")
            pieces = [
                raw[a + x : a + min(y, m - 1)].tobytes() + (last if y == m else b"")
                for a, x, y, m in zip(begin[:-1][doc].tolist(), start.tolist(), ends.tolist(), n[doc].tolist(), strict=True)
            ]
            which = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(which), part.column(2).take(which), pa.array(np.full(len(doc), task, dtype=np.int32)), pa.array(slot[doc].astype(np.int32)), pa.array(block),
                    pa.array(before[doc] + start - block * quantum), pa.array(start), pa.array(length), pa.array(n[doc]), pa.array(pieces, pa.binary()),
                ],
                names=["id", "queue", "part", "slot", "k", "at", "start", "length", "doc_tokens", "ids"],
            )

    schema = f"id {kind}, queue string, part int, slot int, k long, at long, start long, length long, doc_tokens long, ids binary"
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"), F.col(source).cast("string").alias("s")).mapInArrow(encode, schema)


def phase(queue: Column) -> Column:
    """What part of a quantum is still to be earned when a queue starts: above 0, below 1, by its name."""
    return (F.pmod(F.xxhash64(queue), F.lit(1 << 20)) + 0.5) / float(1 << 20)


def stream_places(lines: DataFrame, quantum: int = QUANTUM, targets: DataFrame | None = None) -> DataFrame:
    """Place in the stream of every quantum (part, slot, k, place), from the tokens that each task holds of each queue (part, slot, queue, n).

    ``targets`` (source, share) gives shares of the stream; a source without one, or with none above zero, has its share of the input.
    """
    queue = Window.partitionBy("queue")
    earlier = queue.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    held = lines.select("*", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"), F.sum("n").over(queue).cast("double").alias("weight"))
    if targets is not None:
        every = lines.agg(F.sum("n")).first()[0] or 0
        wanted = targets.filter("share > 0").groupBy(F.col("source").cast("string").alias("of")).agg(F.max("share").cast("double").alias("share"))
        held = held.join(wanted, F.col("queue").eqNullSafe(F.col("of")), "left").withColumn("weight", F.coalesce(F.col("share") * F.lit(float(every)), F.col("weight")))
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {quantum}"))).alias("k")  # as many as one task holds
    quanta = held.select("part", "slot", "queue", "base", "weight", "n", k).withColumn("size", F.least(F.lit(quantum), F.col("n") - F.col("k") * quantum))
    timed = quanta.select("part", "slot", "queue", "k", "size", ((F.col("base") + F.col("k") * quantum + F.col("size") * phase(F.col("queue"))) / F.col("weight")).alias("time"))
    keys = ["time", "queue", "part", "k"]
    ordered = timed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    served = landed(ordered.select("part", "slot", "k", "size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("number")), "services")
    past = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = served.groupBy("range").agg(F.sum("size").alias("size")).select("range", F.coalesce(F.sum("size").over(past), F.lit(0)).alias("behind"))
    sent = Window.partitionBy("range").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    within = served.select("part", "slot", "k", "range", F.coalesce(F.sum("size").over(sent), F.lit(0)).alias("sent"))
    return within.join(bases, "range").select("part", "slot", "k", (F.col("behind") + F.col("sent")).alias("place"))


def pack(
    docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", source: str = "source", sequence: int = SEQUENCE, quantum: int = QUANTUM,
    targets: DataFrame | None = None,
) -> DataFrame:
    """Pack the ids of all whole texts, each ended by id 1, into sequences of ``sequence`` tokens.

    Returns one row for each piece: id, start (ids of the document before it), length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, source, sequence_id and offset.  All sequences but the last are full, so only that one needs padding.  ``targets`` (source,
    share) sets what part of every window a source fills while it lasts; by default that is its share of the input, and a source may be one of any number.
    A null or empty text is its end id alone; a null source is a queue of its own; repeated rows are packed as often as they come; a null id is kept;
    an empty table gives no rows.  Ids of every document lie in exactly one piece; a piece ends where a quantum or a sequence does.

    Texts are encoded once, and ids landed in the shared folder in parts of a quantum at most, which move once to their places.
    """
    coded = landed(coded_parts(docs, path, id_column, text, source, quantum), "tokens")
    lines = landed(coded.groupBy("part", "slot").agg(F.min("queue").alias("queue"), F.sum("length").alias("n")), "queue-parts")
    placed = coded.join(stream_places(lines, quantum, targets).hint("merge"), ["part", "slot", "k"]).withColumn("from", F.col("place") + F.col("at"))
    last = F.col("from") + F.col("length") - 1
    windows = F.sequence(F.expr(f"`from` div {sequence}"), F.expr(f"(`from` + length - 1) div {sequence}"))
    cuts = placed.select("*", F.explode(windows).alias("sequence_id"))
    low, high = F.greatest("from", F.col("sequence_id") * sequence), F.least(last + 1, (F.col("sequence_id") + 1) * sequence)
    skipped, length = low - F.col("from"), high - low
    return cuts.select(
        F.col("id").alias(id_column), (F.col("start") + skipped).alias("start"), length.alias("length"),
        F.substring("ids", (skipped * 4 + 1).cast("int"), (length * 4).cast("int")).alias("ids"), "doc_tokens", F.col("queue").alias("source"),
        "sequence_id", (low % sequence).alias("offset"),
    )
