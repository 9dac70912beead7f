"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Two fingerprints of eight bytes that differ in at most ``bits`` bits share at least 8 - bits
positional bytes: that is the guaranteed minimum of matches.  Posting lists of single bytes are
useless at scale (256 values), so lists are intersected in advance: one posting for each choice
of minimum-many positions.  Inside a list the shared bytes of each pair are tallied; pairs that reach the
minimum, and no others, are verified by counting differing bits.

A list never gives out its pairs.  Its members are searched from a growing set of reached ones,
so that a list of m members yields at most m - 1 links that join the same members.  Lists that
outgrow a block are cut into blocks, and every pair of blocks is searched in a task of its own.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlens.llm import near_copies
from tremorlens.llm.common import landed, slices, split_join, texts_of
from tremorlens.llm.components import components

#: Words of a shingle, differing bits that still link, and members of a posting list searched at once.
SHINGLE, BITS, BLOCK = 4, 4, 4096
LOWER = bytes(range(256)).lower()


def shingle_hashes(text: str, shingle: int = SHINGLE) -> list[int]:
    """XXH64 (seed 42) of each run of ``shingle`` words, repeats included; A-Z lower-cased, words split at ASCII white space."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(joined, 42)]
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    begins = np.append(0, ends[:-1])
    hashed = xxhash.xxh64_intdigest
    return [hashed(joined[a:b], 42) for a, b in zip(begins[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def fingerprint_of(hashes: list[int]) -> int:
    """64-bit fingerprint: a bit is set if it is set in over half of the hashes; no hashes give zero."""
    bits = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[i : i + (1 << 14)], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0]) if hashes else 0


def fingerprints_of(texts: list[str], shingle: int = SHINGLE) -> np.ndarray:
    return np.array([fingerprint_of(shingle_hashes(t, shingle)) for t in texts], dtype=np.uint64)


def near(left: np.ndarray, right: np.ndarray, bits: int) -> np.ndarray:
    """Pairs that are linked: those whose tally of shared positional bytes reaches the minimum, verified by their differing bits."""
    differ = left[:, None] ^ right[None, :]
    tally = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(axis=2, dtype=np.uint8)
    kept = tally >= 8 - bits
    kept[kept] = np.bitwise_count(differ[kept]) <= bits
    return kept


def accompanied(members: np.ndarray, bits: int) -> np.ndarray:
    """Which of distinct fingerprints are near another one: most lists of a large table hold none, and need no search."""
    return np.concatenate([near(members[i : i + 256], members, bits).sum(axis=1) > 1 for i in range(0, len(members), 256)])


def spanning(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links among distinct fingerprints that join all that are joined by near pairs: at most one less than members."""
    links, rest = [], accompanied(members, bits)
    for seed in np.flatnonzero(rest).tolist():
        if not rest[seed]:
            continue
        rest[seed] = False
        front = np.array([seed])
        while len(front):
            reached = []
            for i in range(0, len(front), 256):
                left = np.flatnonzero(rest)
                if not len(left):
                    break
                hit = near(members[front[i : i + 256]], members[left], bits)
                some = np.flatnonzero(hit.any(axis=0))
                if len(some):
                    by = front[i : i + 256][hit[:, some].argmax(axis=0)]
                    links += zip(members[by].tolist(), members[left[some]].tolist(), strict=True)
                    rest[left[some]] = False
                    reached.append(left[some])
            front = np.concatenate(reached) if reached else front[:0]
    return links


def links_between(fingerprints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fingerprint, long) that join exactly what near pairs join."""
    if not 1 <= bits <= 7:
        raise ValueError("one to seven differing bits: at least one byte must be left to match")
    choices = list(combinations(range(8), 8 - bits))

    def postings(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, positions in enumerate(choices):
                key = np.full(len(fp), number, dtype=np.uint64)
                for p in positions:
                    key = (key << np.uint64(8)) | ((fp >> np.uint64(8 * p)) & np.uint64(0xFF))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["list", "fingerprint"])

    def search(batches):
        """Lists arrive one after another, members in order; a list that fills a block is put off in blocks."""
        key, held, number = None, [], 0
        out: list[tuple] = []

        def close(last: bool):
            nonlocal held, number
            members = np.array(held, dtype=np.int64)
            held = []
            if len(members) > 1:
                out.extend((a, b, None, None, None) for a, b in spanning(members.view(np.uint64), bits))
            if not last or number:  # one block of several
                out.append((None, None, key, number, members.astype("<i8").tobytes()))
                number += 1
            if last:
                number = 0

        def ready():
            rows, out[:] = list(out), []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["a", "b", "list", "number", "members"])

        def signed_links():
            for k, row in enumerate(out):
                if row[0] is not None:
                    out[k] = (*(x - (1 << 64) if x >= 1 << 63 else x for x in row[:2]), None, None, None)

        for batch in batches:
            keys, members = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            bounds = np.concatenate([[0], cut, [len(keys)]]) if len(keys) else np.zeros(1, dtype=np.int64)
            shared = np.diff(bounds) > 1  # the others meet nobody, but for the first and last, whose lists may go on
            shared[:1] = shared[-1:] = True
            for i in np.flatnonzero(shared).tolist():
                a, b = int(bounds[i]), int(bounds[i + 1])
                if key is None or keys[a] != key:
                    if key is not None:
                        close(True)
                    key = int(keys[a])
                for j in range(a, b, block):
                    if len(held) + min(block, b - j) > block:
                        close(False)
                    held.extend(members[j : min(b, j + block)].tolist())
            signed_links()
            if out:
                yield ready()
        if key is not None:
            close(True)
            signed_links()
            if out:
                yield ready()

    def search_blocks(batches):
        for batch in batches:
            rows = []
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows += spanning(np.frombuffer(a + b, dtype="<u8"), bits)
            flat = np.array(rows, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["a", "b"])

    listed = fingerprints.select("fingerprint").mapInArrow(postings, "list long, fingerprint long")
    found = landed(
        listed.repartition("list").sortWithinPartitions("list", "fingerprint").mapInArrow(search, "a long, b long, list long, number int, members binary"), "postings"
    )
    blocks = found.filter("members is not null").select("list", "number", "members")
    other = blocks.toDF("list", "number2", "members2")
    pairs = blocks.join(other, "list").filter("number < number2").select("members", "members2").repartition(F.xxhash64("members", "members2"))
    return found.filter("a is not null").select("a", "b").union(pairs.mapInArrow(search_blocks, "a long, b long"))


def near_duplicates(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = BITS, block: int = BLOCK, likeness: float | None = None
) -> DataFrame:
    """Fingerprint and component of every document: id, fingerprint (long), component_id.

    Documents are linked when their fingerprints differ in at most ``bits`` bits, and, if ``likeness`` is given, when their sets of shingles
    are that much alike (see ``near_copies``); component_id is the smallest id reachable, the document's own included.  A null text is
    empty; texts without words have fingerprint zero and are linked like any other; repeated rows come back as often as they are there; a
    null id takes part but names no component unless it is alone (then null); an empty table gives no rows.  Copies meet as one fingerprint
    before anything is indexed.
    """
    kind = docs.schema[id_column].dataType.simpleString()

    def work(batches):
        for part in slices(batches):
            prints, sets, lists = np.zeros(part.num_rows, dtype=np.uint64), [], []
            for k, t in enumerate(texts_of(part.column(1))):
                hashes = shingle_hashes(t, shingle)  # of one text at a time
                prints[k] = fingerprint_of(hashes)
                if likeness is not None:
                    runs = near_copies.word_runs(hashes)
                    sets.append(runs.astype("<u4").tobytes())
                    lists.append(near_copies.bands_of(runs) if len(runs) else [])
            columns = [part.column(0), pa.array(prints.view(np.int64))]
            if likeness is not None:
                columns += [pa.array(sets, pa.binary()), pa.array(lists, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "fingerprint", "runs", "lists"][: len(columns)])

    schema = f"id {kind}, fingerprint long" + (", runs binary, lists array<long>" if likeness is not None else "")
    signed = landed(docs.select(F.col(id_column).alias("id"), F.col(text).alias("t")).mapInArrow(work, schema), "fingerprints")
    marked = signed.select("id", "fingerprint")
    distinct = landed(marked.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")), "distinct-fingerprints")
    links = links_between(distinct, bits, block)
    if likeness is not None:
        links = links.union(near_copies.alike(signed.select(F.col("fingerprint").alias("node"), "runs", "lists"), likeness))
    linked = landed(components(links), "roots")
    rooted = distinct.join(linked, distinct["fingerprint"] == linked["node"], "left").select("fingerprint", "least", "n", F.coalesce("root", "fingerprint").alias("root"))
    rooted = landed(rooted, "rooted")
    # a component of very many fingerprints, or a fingerprint of very many rows, goes to every task; there are at most ten thousand of either
    hot = max(1, marked.count() // 10_000)
    named = landed(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "names")
    of = split_join(rooted, named, ["root"], F.col("members") > hot).select("fingerprint", "component_id", "n")
    found = split_join(marked, of, ["fingerprint"], F.col("n") > hot)
    return found.select(F.col("id").alias(id_column), "fingerprint", "component_id")
