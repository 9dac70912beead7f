"""Prefix trie of conversations, its subtrees measured on balanced parentheses.

Every step of a conversation gets a digest of its depth, role and text.  The digests of a prefix, joined
by exclusive or, name its node (120 bits): a running sum, so that a conversation of any length is named part
by part, whichever task holds a part.  Equal names are one node, whose members are counted by one aggregation.

Members only leave on the way down, so nodes of one smallest member and one number of members are a
chain without branches: a run.  Runs are the nodes of a compressed trie, in which a conversation, however
long, has one node for each place where members leave it.

Paths of runs to the nodes where conversations end are sorted and cut into shards by range.  A shard writes the trie
of its paths as balanced parentheses: ``find_close`` delimits a subtree, the number of pairs "()" in it is
that of its leaves, and differences of cumulative savings give what it saves.  Neighbouring shards share
the spine that leads to both: a shard knows the path before it, whose runs it does not count again, and the
one after it, which tells whether its last run is a leaf.  Sums over shards merge the spines.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlens.llm.common import landed, split_join
from tremorlens.llm.parens import Parentheses

#: Conversations whose numbers differ below this share the beginning of the first of them; the hash takes so many values.
FAMILY, LENGTHS = 20, 4
#: Paths of a shard, and rows of one key from which on the key's other side is sent to all tasks: a share of all rows, so such keys are few.
SHARD_PATHS, HOT_SHARE = 100_000, 10_000
#: Characters of a block of joined identifiers.
BLOCK_CHARS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()


def content(role: Column, text: Column) -> Column:
    """Digest of a turn: no other role and text have it."""
    return F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)


def tags(depth: Column, digest: Column) -> list[Column]:
    """Two numbers of 60 bits for a turn at a depth."""
    mark = F.sha2(F.concat(depth.cast("string"), F.lit(":"), digest), 256)
    return [F.conv(F.substring(mark, a, 15), 16, 10).cast("long") for a in (1, 16)]


def turns_of(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Turns in order: conv, part, at (a number that grows), digest, words; and segments: conv, part, first, n, base (turns in earlier parts)."""
    said, of = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role).cast("string"), F.lit(""))
    rows = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), content(of, said).alias("digest"), F.regexp_count(said, F.lit(WORD)).cast("long").alias("words")
    )
    keys = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    turns = landed(ordered.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "digest", "words"), "turns")
    parts = turns.groupBy("conv", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return turns, landed(parts.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "segments")


def rebuilt(turns: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps of rebuilt conversations: conv, part, depth, words, t1, t2; and the conversations: conv, depth (of the last turn)."""
    placed = turns.join(segments, ["conv", "part"]).withColumn("p", F.col("at") - F.col("first") + F.col("base") + 1)
    lead = F.array_sort(F.collect_list(F.struct("p", "digest", "words"))).alias("lead")  # three turns at most
    leads = placed.filter((F.col("conv") % FAMILY == 0) & (F.col("p") < LENGTHS)).groupBy("conv").agg(lead).withColumnRenamed("conv", "family")
    h = (F.crc32(F.col("conv").cast("string")) % LENGTHS).cast("int")
    convs = segments.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", h).withColumn("family", F.col("conv") - F.col("conv") % FAMILY)
    convs = convs.join(leads, "family", "left").withColumn("lead", F.slice(F.coalesce("lead", F.array().cast(leads.schema["lead"].dataType)), F.lit(1), F.col("h")))
    convs = landed(convs.select("conv", "h", "lead", F.size("lead").alias("k"), (F.size("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depth")), "rebuilt")
    begun = convs.select("conv", F.lit(-1).alias("part"), F.posexplode("lead")).select("conv", "part", (F.col("pos") + 1).cast("long").alias("depth"), "col.digest", "col.words")
    places = segments.join(convs.select("conv", "h", "k"), "conv").select("conv", "part", (F.col("base") - F.col("first") + 1 - F.col("h")).alias("shift"), "k")
    own = turns.join(places, ["conv", "part"]).withColumn("after", F.col("at") + F.col("shift")).filter("after > 0")
    own = own.select("conv", "part", (F.col("after") + F.col("k")).alias("depth"), "digest", "words")
    t1, t2 = tags(F.col("depth"), F.col("digest"))
    steps = begun.union(own).select("conv", "part", "depth", "words", t1.alias("t1"), t2.alias("t2"))
    return landed(steps, "steps"), convs.select("conv", "depth")


def named(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of all conversations (conv, depth, d1, d2, parent's p1, p2, words, total: words down to here), and the name of each whole one (conv, d1, d2)."""
    sums = landed(steps.groupBy("conv", "part").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"), F.sum("words").alias("w")), "step-sums")
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        "conv", "part", *(F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")), F.coalesce(F.sum("w").over(earlier), F.lit(0)).alias("w")
    )
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = steps.join(before, ["conv", "part"]).select(
        "conv", "depth", "words", "t1", "t2", *(F.col(f"x{k}").bitwiseXOR(F.bit_xor(f"t{k}").over(so_far)).alias(f"d{k}") for k in (1, 2)),
        (F.col("w") + F.sum("words").over(so_far)).alias("total"),
    )
    parents = [F.col(f"d{k}").bitwiseXOR(F.col(f"t{k}")).alias(f"p{k}") for k in (1, 2)]
    return landed(run.select("conv", "depth", "d1", "d2", *parents, "words", "total"), "prefixes"), sums.groupBy("conv").agg(F.bit_xor("x1").alias("d1"), F.bit_xor("x2").alias("d2"))


def ends_of(ended: DataFrame) -> DataFrame:
    """Per node (depth, d1, d2) where conversations end: least (the smallest), ends_sha256 over their numbers in order, comma-joined.

    A node where a third of all conversations end is written in blocks by many tasks; the digest itself, which has
    to be taken from the first byte to the last, then reads a few blocks as they stream by, whatever their number.
    """

    def groups(batches, width):
        """Rows of one key after another: key, rows (lists)."""
        key, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != key:
                    if held:
                        yield key, held
                    key, held = row[:3], []
                held.append(row[3:])
                if len(held) == width:
                    yield key, held
                    held = []
        if held:
            yield key, held

    def block(batches):
        for key, rows in groups(batches, BLOCK_CHARS // 16):
            text = ",".join(str(c) for (c,) in rows)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, rows[0][0])] + [pa.array([text])], names=["depth", "d1", "d2", "least", "text"])

    def digest(batches):
        done, key, state, least = [], None, None, None
        for k, rows in groups(batches, 1):
            if k != key:
                if key is not None:
                    done.append((*key, least, state.hexdigest()))
                key, state, least = k, hashlib.sha256(rows[0][1].encode()), rows[0][0]
            else:
                state.update(b"," + rows[0][1].encode())
            if len(done) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "d1", "d2", "least", "ends_sha256"])
                done = []
        if key is not None:
            done.append((*key, least, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["depth", "d1", "d2", "least", "ends_sha256"])

    keys = ["d1", "d2", "depth"]
    spread = ended.select("depth", "d1", "d2", "conv").repartitionByRange(*keys, "conv").sortWithinPartitions(*keys, "conv")
    blocks = spread.mapInArrow(block, "depth long, d1 long, d2 long, least long, text string")
    met = blocks.repartition(*keys).sortWithinPartitions(*keys, "least")
    return landed(met.mapInArrow(digest, "depth long, d1 long, d2 long, least long, ends_sha256 string"), "ends")


def shard_rows(paths: list[list[int]], before: list[int] | None, after: list[int] | None, root: tuple[int, int, int]) -> list[np.ndarray]:
    """Runs of a shard's sorted paths with what the shard holds below each: conv, n, parent, leaves, saved, children.

    A path is a row of runs, each as its smallest member, members and saved words.  ``before`` and ``after`` are the neighbouring paths
    of other shards; ``root`` is the run that all paths start from.  Runs on the way to ``before`` save and count as children there.
    """

    def shared(a, b):
        n = min(len(a), len(b)) // 3
        for k in range(n):
            if a[3 * k] != b[3 * k] or a[3 * k + 1] != b[3 * k + 1]:
                return k
        return n

    known = shared(before, paths[0]) if before is not None else 0
    bits, runs, parents, own, counted = [1], [(root[0], root[1])], [-1], [0 if before is not None else root[2]], [0]
    stack, last = [0], []
    for path in paths:
        common = shared(last, path)
        bits += [0] * (len(stack) - 1 - common)
        del stack[common + 1 :]
        for k in range(common, len(path) // 3):
            old = not last and k < known  # opened by an earlier shard
            parents.append(stack[-1])
            counted.append(0 if old else 1)
            own.append(0 if old else path[3 * k + 2])
            stack.append(len(runs))
            runs.append((path[3 * k], path[3 * k + 1]))
            bits.append(1)
        last = path
    bits += [0] * len(stack)
    tree = Parentheses(np.array(bits, dtype=np.uint8))
    opens = np.flatnonzero(np.array(bits, dtype=np.uint8))
    closes = tree.find_close(opens)
    leaves = tree.pairs_before(closes) - tree.pairs_before(opens)
    if after is not None and shared(last, after) == len(last) // 3:  # the last run goes on in the next shard
        leaves[stack] -= 1
    sums = np.append(0, np.cumsum(np.array(own, dtype=np.int64)))
    saved = sums[tree.opens_before(closes)] - sums[tree.opens_before(opens)]
    children = np.zeros(len(runs), dtype=np.int64)
    np.add.at(children, np.array(parents[1:], dtype=np.int64), np.array(counted[1:], dtype=np.int64))
    convs, n = (np.array(c, dtype=np.int64) for c in zip(*runs, strict=True))
    return [convs, n, np.where(np.array(parents) < 0, -1, convs[np.array(parents)]), leaves, saved, children]


def measured(paths: DataFrame, root: tuple[int, int, int], shard_paths: int) -> DataFrame:
    """Per run of the sorted ``paths`` (column path): conv_id, n_convs, parent, leaves, saved, children."""
    shards = max(1, -(-paths.count() // shard_paths))
    ordered = paths.repartitionByRange(shards, "path").sortWithinPartitions("path")
    dealt = landed(ordered.select(F.spark_partition_id().alias("shard"), "path"), "paths")
    line = Window.orderBy("shard")  # one row for each shard
    rims = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    rims = rims.select("shard", F.lag("last").over(line).alias("before"), F.lead("first").over(line).alias("after"))
    seeds = rims.select("shard", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("before").alias("path")), F.struct(F.lit(1).alias("kind"), F.col("after").alias("path")))).alias("s"))
    met = seeds.select("shard", "s.kind", "s.path").union(dealt.select("shard", F.lit(2), "path")).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "path")
    names = ["conv_id", "n_convs", "parent", "leaves", "saved", "children"]

    def by_shard(batches):
        shard, rims_here, held = None, [], []

        def close():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in shard_rows(held, *rims_here, root)], names=names)

        for batch in batches:
            for s, kind, path in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if held:
                        yield close()
                    shard, rims_here, held = s, [], []
                (rims_here if kind < 2 else held).append(path)
        if held:
            yield close()

    parts = met.mapInArrow(by_shard, ", ".join(f"{c} long" for c in names))
    return parts.groupBy("conv_id", "n_convs").agg(F.max("parent").alias("parent"), *(F.sum(c).alias(c) for c in names[3:]))


def trie(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard_paths: int = SHARD_PATHS, hot_share: int = HOT_SHARE
) -> DataFrame:
    """Nodes of the prefix trie of all rebuilt conversations: one row for each distinct beginning.

    A conversation is rebuilt from the first h turns of the first conversation of its family and its own turns after its first h; h is a hash of its number.
    Returns, all long but the digest: conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves,
    saved_tokens ((members - 1) times words of the last text, over the subtree) and ends_sha256.

    Turns are ordered by turn, null first; equal turns by the digest of role and text, so that repeated rows are turns one after another.
    Null roles and texts are empty; rows without a conversation take no part; other columns are not read; an empty table gives no rows.
    A conversation may have any number of turns and texts any length: turns are cut over tasks by range, and texts are digested
    where they lie.  Work on paths follows the places where members leave them; a beginning that most share is met once.
    """
    turns, segments = turns_of(conversations, conv, turn, role, text)
    steps, convs = rebuilt(turns, segments)
    prefixes, whole = named(steps)
    smallest, n_all = convs.agg(F.min("conv"), F.count("*")).first()
    names = ["depth", "d1", "d2"]
    nodes = prefixes.groupBy(*names).agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), *(F.min(c).alias(c) for c in ("p1", "p2", "words", "total")))
    zero = F.lit(0).cast("long")
    top = convs.groupBy().agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.select(*(zero.alias(c) for c in names), "conv_id", "n_convs", *(zero.alias(c) for c in ("p1", "p2", "words", "total")))
    nodes = landed(nodes.union(top), "nodes")
    spent = F.col("total") - F.col("words")
    runs = nodes.groupBy("conv_id", "n_convs").agg(
        F.min("depth").alias("head"), F.max("depth").alias("tail"), F.count("*").alias("n"), F.min(spent).alias("spent"), (F.col("n_convs") - 1).alias("others"), F.max("total").alias("total"),
        F.min_by(F.struct("d1", "d2"), "depth").alias("name"), F.max_by(F.struct("d1", "d2"), "depth").alias("foot"),
    )
    runs = landed(runs.withColumn("own", F.col("others") * (F.col("total") - F.col("spent"))), "runs")
    ends = ends_of(convs.join(whole, "conv", "left").select("conv", F.col("depth").cast("long").alias("depth"), *(F.coalesce(d, zero).alias(d) for d in ("d1", "d2"))))
    n_rows = prefixes.count()
    hot = max(1, n_rows // hot_share)
    heads = runs.filter("head > 0").select(F.col("head").alias("depth"), "name.d1", "name.d2", "conv_id", "n_convs", "own")
    on_way = split_join(prefixes.select("depth", "d1", "d2", "conv"), heads, names, F.col("n_convs") > hot)
    reached = on_way.join(ends.select(F.col("least").alias("conv")), "conv").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("depth", "conv_id", "n_convs", "own"))).alias("way"))
    paths = landed(reached.select(F.flatten(F.transform("way", lambda x: F.array(x["conv_id"], x["n_convs"], x["own"]))).alias("path")), "ways")
    first = runs.filter("head = 0").select("own").first()
    root = (smallest or 0, n_all, first["own"] if first else 0)
    found = measured(paths, root, shard_paths)
    feet = ends.select(F.col("depth").alias("tail"), F.struct("d1", "d2").alias("foot"), "ends_sha256")
    known = runs.join(found, ["conv_id", "n_convs"], "left").join(feet, ["tail", "foot"], "left").select(
        "conv_id", "n_convs", "head", "tail", "n", "spent", F.when(F.col("head") > 0, F.col("parent")).alias("parent"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("leaves"), F.coalesce("saved", "own").alias("saved"), F.coalesce("children", zero).alias("children"), "ends_sha256",
    )
    known = landed(known, "known-runs")
    each = split_join(nodes.select("conv_id", "n_convs", "depth", "words", "total"), known, ["conv_id", "n_convs"], F.col("n") > hot)
    last = F.col("depth") == F.col("tail")
    return each.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("head"), F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"), "n_convs",
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n_convs") - 1) * (F.col("total") - F.col("words") - F.col("spent"))).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(EMPTY))).otherwise(F.lit(EMPTY)).alias("ends_sha256"),
    )
