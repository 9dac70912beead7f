"""Prefix trie against plain dictionaries, and balanced parentheses against a stack."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tremorlens.llm import parens, prefix_trie


@pytest.mark.parametrize("pairs", [1, 2, 300, 5000])
def test_closing_parentheses(pairs, monkeypatch):
    monkeypatch.setattr(parens, "TOGETHER", 700)
    rng = random.Random(pairs)
    for shape in ("random", "deep", "flat"):
        bits, depth, left = [1], 1, pairs - 1
        while left or depth > 1:
            grow = left and (depth == 1 or {"random": rng.random() < 0.5, "deep": True, "flat": depth < 2}[shape])
            bits.append(1 if grow else 0)
            depth, left = depth + (1 if grow else -1), left - (1 if grow else 0)
        bits.append(0)
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = parens.Parentheses(np.array(bits, dtype=np.uint8))
        places = np.array(sorted(close))
        assert tree.find_close(places).tolist() == [close[i] for i in places.tolist()]
        assert tree.opens_before(np.arange(len(bits) + 1)).tolist() == [sum(bits[:i]) for i in range(len(bits) + 1)] if pairs < 500 else True
        assert int(tree.pairs_before(np.array([len(bits)]))[0]) == sum(a == 1 and b == 0 for a, b in zip(bits, bits[1:], strict=False))


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain(rows):
    """Nodes by their paths, from lists of turns."""
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((t is not None, t or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        if p:
            saved[p] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1]))
            children[p[:-1]] += 1
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p]))))) for p, m in members.items()), key=str
    )


def table_of(spark, rows):
    names = "conv depth d1 part at digest words path shard tail n lead".split()
    df = spark.createDataFrame([(*r, *["x"] * len(names)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{n} string" for n in names))
    return df.repartition(5)


def conversations(seed, n=60):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(n * 2), n):
        for t in range(rng.choice([1, 2, 3, 4, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "a b  c", "", None])))
    return rows


@pytest.mark.parametrize("shard_paths,hot_share", [(100_000, 10_000), (3, 5), (1, 1)])
def test_nodes_equal_plain_ones(spark, shard_paths, hot_share):
    rows = conversations(shard_paths)
    rows += [(None, 1, "user", "x"), (500, None, None, None), (500, None, None, None), (500, 3, "user", "yes"), (501, 1, "", ""), (-7, 0, "user", "yes"), (-40, 0, "user", "yes"), (-40, 1, "user", "no")]
    rows += rows[:7]  # repeated rows
    rows += [(1000 + c, t, "user", f"turn {t}") for c in range(0, 40, 2) for t in range(c + 1)]  # each the beginning of the next
    rows += [(2000 + c, t, "user", f"turn {t} of all") for c in range(25) for t in range(12)]  # copies
    rows += [(3000, t, "user", f"long {t % 7}") for t in range(700)]
    got = prefix_trie.trie(table_of(spark, rows), shard_paths=shard_paths, hot_share=hot_share)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert all(t == "bigint" for _, t in got.dtypes[:-1])
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_tries_of_little(spark):
    assert prefix_trie.trie(table_of(spark, [])).count() == 0
    for rows in ([(4, 0, "user", "a")], [(1, 0, "user", "a")], [(c, t, "u", "a b") for c in range(20, 30) for t in range(6)]):
        assert sorted(map(tuple, prefix_trie.trie(table_of(spark, rows)).collect()), key=str) == plain(rows)


def test_one_beginning_of_all_is_a_run(spark):
    """The root's run is longer than the root; its end is where members leave."""
    rows = [(c, t, "u", "same" if t < 5 else f"own {c}") for c in range(20, 40, 1) for t in range(7)]
    assert sorted(map(tuple, prefix_trie.trie(table_of(spark, rows), shard_paths=4).collect()), key=str) == plain(rows)


def test_blocks_of_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_CHARS", 64)
    ended = spark.range(0, 999).selectExpr("CAST(1 + id % 2 AS BIGINT) AS depth", "CAST(5 AS BIGINT) AS d1", "-id % 2 AS d2", "id - 300 AS conv").repartition(6)
    got = {(r["depth"], r["least"]): r["ends_sha256"] for r in prefix_trie.ends_of(ended).collect()}
    assert got == {(1 + k, k - 300): sha(",".join(str(i - 300) for i in range(999) if i % 2 == k)) for k in (0, 1)}
