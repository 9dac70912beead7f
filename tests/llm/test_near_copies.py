"""Near copies against plain sets of word runs."""

import random

import numpy as np

from tremorlens.llm import near_copies
from tremorlens.llm.simhash import shingle_hashes


def runs(text):
    return near_copies.word_runs(shingle_hashes(text, 5))


def test_runs_of_words():
    assert len(runs("")) == len(runs(" \n\t")) == 0
    assert runs("A b  C").tolist() == runs("a B c").tolist() and len(runs("a b c")) == 1
    assert len(runs("a b c d e f")) == 2 and len(runs("a " * 500)) == 1
    assert len(near_copies.bands_of(runs("word " * 9))) == near_copies.BANDS


def test_likeness():
    a, b = np.array([1, 2, 3], dtype="<u4"), np.array([2, 3, 4], dtype="<u4")
    assert near_copies.likeness(a, b) == 0.5 and near_copies.likeness(a, a) == 1.0 and near_copies.likeness(a[:0], a[:0]) == 1.0 and near_copies.likeness(a, a[:0]) == 0.0


def test_bands_agree_as_often_as_likeness_says():
    rng, agreed = np.random.default_rng(1), 0
    for _ in range(60):
        both = rng.integers(0, 1 << 32, 1000, dtype=np.uint32)
        left, right = np.unique(both[:900]), np.unique(both[100:])  # 0.8
        agreed += sum(x == y for x, y in zip(near_copies.bands_of(left), near_copies.bands_of(right), strict=True))
    assert abs(agreed / (60 * near_copies.BANDS) - 0.8**near_copies.ROWS) < 0.03


def test_chains_cross_partitions(spark):
    """Every list is one chain, whatever tasks it lies in, and links nothing else."""
    rng = random.Random(3)
    rows = [(k, rng.randrange(5), rng.randrange(1 << 40)) for k in (7, -2, 9) for _ in range({7: 500, -2: 3, 9: 1}[k])]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["a"], r["b"]) for r in near_copies.chained(spark.createDataFrame(rows, "list long, size int, node long")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    chain = sorted(rows)
    assert got == {(x[2], y[2]) for x, y in zip(chain, chain[1:], strict=False) if x[0] == y[0]}
    assert near_copies.chained(spark.createDataFrame([], "list long, size int, node long")).count() == 0


def test_alike_texts_are_linked(spark):
    words = [f"w{i}" for i in range(200)]
    texts = {1: words, 2: [*words[:-3], "x", "y", "z"], 3: [*words[:100], *(f"o{i}" for i in range(100))], 4: [], 5: ["short"]}
    sets = {k: runs(" ".join(t)) for k, t in texts.items()}
    rows = [(k, bytearray(s.astype("<u4").tobytes()), near_copies.bands_of(s) if len(s) else []) for k, s in sets.items()]
    got = near_copies.alike(spark.createDataFrame(rows + rows[:2], "node long, runs binary, lists array<long>"), 0.8).collect()
    assert {frozenset((r["a"], r["b"])) for r in got} == {frozenset((1, 2))}
