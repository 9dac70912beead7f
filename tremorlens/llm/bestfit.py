"""Best-fit packing with certified bounds: as few sequences as can be, and a proof of how few.

Documents longer than a sequence are cut into full pieces, which are sequences of their own, and a
shorter first piece.  Short pieces are dealt to shards of bounded size by a hash of their row.  Each
shard packs them by best fit, largest first, and certifies the number of its bins: a dual feasible
function f maps sizes so that no feasible bin holds more than 1 of it, hence no packing has fewer
bins than the sum of f over the pieces.  The largest sum over a family of such functions is the bound.

A shard whose bins exceed its bound has a gap.  Shards with gaps give up all bins that are not full;
certified shards give up the least full one (a bound is rounded up in each shard).  The pieces given up
are exchanged, that is dealt anew to as few shards as their number needs, and packed again, until
the bound over all pieces is met or an exchange saves nothing.  Full bins stay where they are, so a round
moves less than the one before.

Bounds need the number of pieces of each size alone: a table of at most ``sequence`` rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlens.llm.bpe import json_encoder
from tremorlens.llm.common import landed, slices, texts_of

SEQUENCE = 1024
#: Id that ends every document.
END_ID = 2
#: Pieces of a shard (they are packed in one task's memory, a few numbers each), and exchanges at most.
SHARD_PIECES, EXCHANGES = 200_000, 8
#: A row is numbered by its task and its place there; a sequence by round, shard and bin.
PLACE_BITS, SHARD_BITS, BIN_BITS = 40, 32, 20


@lru_cache(maxsize=4)
def dual_feasible(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Dual feasible functions on sizes 0..capacity: numerators (one row for each function) and denominators.

    ``keep(e)``: sizes over capacity - e count as a bin, those under e as nothing, others as they are.
    ``steps(k)``: x = size / capacity stays if (k + 1) x is whole, else it becomes floor((k + 1) x) / k.
    ``shares(e)``: a size from e to half a bin is one share of floor(capacity / e); a larger one is a bin less the shares that still fit beside it.
    """
    s = np.arange(capacity + 1, dtype=np.int64)
    tops, downs = [], []
    for e in range(capacity // 2 + 1):
        tops.append(np.where(s > capacity - e, capacity, np.where(s >= e, s, 0)))
        downs.append(capacity)
    for k in range(1, 65):
        product = (k + 1) * s
        tops.append(np.where(product % capacity == 0, k * s, product // capacity * capacity))
        downs.append(k * capacity)
    for e in range(1, capacity // 2 + 1):
        n = capacity // e
        tops.append(np.where(2 * s > capacity, n - (capacity - s) // e, np.where(s >= e, 1, 0)))
        downs.append(n)
    return np.array(tops), np.array(downs, dtype=np.int64)


def least_bins(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing of ``sizes[s]`` pieces of size s needs at least, by the best of the functions."""
    tops, downs = dual_feasible(capacity)
    if int(sizes.sum()) < 1 << 40:
        sums = (tops @ sizes).tolist()
    else:
        sums = [sum(a * b for a, b in zip(t, sizes.tolist(), strict=True)) for t in tops.tolist()]
    return max(-(-a // b) for a, b in zip(sums, downs.tolist(), strict=True))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin of each piece by best fit with the largest pieces first, and its place in the bin.

    Pieces of one size are taken together.  The bins that fit it best are those with the least room for it, and a bin that
    has taken one piece has less room still, so each takes as many as it holds before the next one does.
    """
    order = np.argsort(-sizes, kind="stable")
    ordered = -sizes[order]
    bins, places = np.zeros(len(sizes), dtype=np.int64), np.zeros(len(sizes), dtype=np.int64)
    room: dict[int, list[np.ndarray]] = {}  # bins by what is left in them
    some, made, at = 0, 0, 0  # ``some``: bit r is set if bins with room r are there
    while at < len(order):
        s = -int(ordered[at])
        end = int(np.searchsorted(ordered, -s, "right"))
        while at < end:
            fits = some >> s
            r = s + (fits & -fits).bit_length() - 1 if fits else capacity
            each = r // s
            n = -(-(end - at) // each)
            if fits:
                group = room[r].pop()
                taken, rest = group[:n], group[n:]
                if len(rest):
                    room[r].append(rest)
                elif not room[r]:
                    some &= ~(1 << r)
            else:
                taken = np.arange(made, made + n)
                made += n
            count = min(end - at, len(taken) * each)
            mine, j = order[at : at + count], np.arange(count)
            bins[mine], places[mine] = taken[j // each], capacity - r + j % each * s
            at += count
            for part, left in ((taken[: count // each], r - each * s), (taken[count // each :], r - count % each * s)):
                if len(part) and left:
                    room.setdefault(left, []).append(part)
                    some |= 1 << left
    return bins, places


def coded_pieces(docs: DataFrame, path: str, id_column: str, text: str, sequence: int) -> DataFrame:
    """Pieces of every document: id, row (a number of its own for each row of ``docs``), piece, start, length, number (of full pieces in the task), ids."""
    kind = docs.schema[id_column].dataType.simpleString()

    def encode(batches):
        from pyspark import TaskContext

        encoder, base, full = json_encoder(path), TaskContext.get().partitionId() << PLACE_BITS, 0
        row, last = base, END_ID.to_bytes(4, "little")
        for part in slices(batches):
            ids, at = encoder.encode(texts_of(part.column(1)))
            which, piece, start, length, number, raw = [], [], [], [], [], []
            for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                n = b - a + 1
                whole, first = ids[a:b].astype("<u4").tobytes() + last, n % sequence
                ends = [*([first] if first else []), *range(first + sequence, n + 1, sequence)]
                for p, (x, y) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
                    which.append(k)
                    piece.append(p)
                    start.append(x)
                    length.append(y - x)
                    number.append(base + full if y - x == sequence else None)
                    full += y - x == sequence
                    raw.append(whole[4 * x : 4 * y])
            rows = np.array(which, dtype=np.int64) + row
            row += part.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(pa.array(which, pa.int64())), pa.array(rows), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(number, pa.int64()), pa.array(raw, pa.binary()),
                ],
                names=["id", "row", "piece", "start", "length", "number", "ids"],
            )

    schema = f"id {kind}, row long, piece int, start long, length long, number long, ids binary"
    return docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(encode, schema)


def packed(pieces: DataFrame, sequence: int, turn: int, shards: int) -> DataFrame:
    """Pieces (row, length) packed in ``shards`` shards: row, length, bin (unique over turns), place, used (tokens of the bin), gap (of its shard), least (least full bin of its shard)."""

    def pack(rows, lengths, shard):
        sizes = np.concatenate(lengths)
        bins, places = best_fit(sizes, sequence)
        used = np.bincount(bins, weights=sizes).astype(np.int64)
        gap = len(used) - least_bins(np.bincount(sizes, minlength=sequence + 1), sequence)
        name = (turn << (SHARD_BITS + BIN_BITS)) + (shard << BIN_BITS)
        n = len(sizes)
        return pa.RecordBatch.from_arrays(
            [np.concatenate(rows), sizes, name + bins, places, used[bins], np.full(n, gap), bins == used.argmin()],
            names=["row", "length", "bin", "place", "used", "gap", "least"],
        )

    def by_shard(batches):
        shard, rows, lengths = None, [], []
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                if a == b:
                    continue
                if shard is not None and numbers[a] != shard:
                    yield pack(rows, lengths, shard)
                    rows, lengths = [], []
                shard = int(numbers[a])
                rows.append(batch.column(1).to_numpy()[a:b].copy())
                lengths.append(batch.column(2).to_numpy()[a:b].copy())
        if rows:
            yield pack(rows, lengths, shard)

    dealt = pieces.select(F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(shards)).alias("shard"), "row", "length")
    # rows of a shard in the order of their numbers: a repeated task packs them alike
    met = dealt.repartition(shards, "shard").sortWithinPartitions("shard", "row")
    return met.mapInArrow(by_shard, "row long, length long, bin long, place long, used long, gap long, least boolean")


def placed(short: DataFrame, sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES, exchanges: int = EXCHANGES) -> tuple[DataFrame, int, int]:
    """Bin and place of every short piece (row, length), the number of bins, and the least that any packing needs."""
    counts = short.groupBy("length").agg(F.count("*").alias("n")).collect()  # one row for each size
    sizes = np.zeros(sequence + 1, dtype=np.int64)
    for r in counts:
        sizes[r["length"]] = r["n"]
    least = least_bins(sizes, sequence)
    pool, left, shards, settled, spare = short, int(sizes.sum()), 0, [], None
    done = given_up = 0  # bins that are settled, and bins that the pieces of this turn lay in before
    for turn in range(exchanges + 1):
        shards = max(1, -(-left // shard_pieces))
        found = landed(packed(pool, sequence, turn, shards), "bins")
        given = (F.col("used") < sequence) & ((F.col("gap") > 0) | F.col("least"))
        first = F.col("place") == 0  # one piece stands for its bin
        total, opened, moving = found.agg(F.count_if(first), F.count_if(first & given), F.count_if(given)).first()
        if spare is not None and total >= given_up:  # the exchange saved nothing: what was there stands
            settled.append(spare)
            done += given_up
            break
        if done + total == least or shards == 1 or opened < 2 or turn == exchanges:
            settled.append(found)
            done += total
            break
        spare = found.filter(given)
        settled.append(found.filter(~given))
        pool, left, done, given_up = spare.select("row", "length"), moving, done + total - opened, opened
    result = settled[0]
    for other in settled[1:]:
        result = result.union(other)
    return result.select("row", "bin", "place"), done, least


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Pack the ids of all whole texts, each ended by id 2, into as few sequences of at most ``sequence`` tokens as best fit finds.

    Returns one row for each piece: id, piece, start (ids of the document before it), length, ids (binary, little-endian unsigned 32-bit),
    sequence_id and offset.  Only documents longer than a sequence are cut: into full pieces, the first one shorter where the length asks for it.
    A null or empty text is its end id alone; repeated rows are packed as often as they come; a null id is kept; other columns are not
    read; an empty table gives no rows.  A text of any length is encoded whole and leaves its task in pieces.  Equal lengths are packed in the order of their rows.

    Texts are encoded once, and pieces landed in the shared folder.  What is packed are numbers of rows with lengths; ids of short pieces
    move once, to their places, and full pieces do not move at all.
    """
    coded = landed(coded_pieces(docs, path, id_column, text, sequence), "pieces")
    short = coded.filter(F.col("length") < sequence)
    bins, _, _ = placed(short.select("row", "length"), sequence, shard_pieces)
    columns = [F.col("id").alias(id_column), "piece", "start", "length", "ids"]
    full = coded.filter(F.col("length") == sequence).select(*columns, (-1 - F.col("number")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # the same join at every size: ids move once to where their pieces lie
    found = short.join(bins.withColumnRenamed("row", "of").hint("merge"), F.col("row") == F.col("of"))
    return full.union(found.select(*columns, F.col("bin").alias("sequence_id"), F.col("place").alias("offset")))
