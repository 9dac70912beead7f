"""Best-fit packing: bounds against the best packing there is, best fit against the plain rule, whole tables against the library."""

import random
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tremorlens.llm import bestfit


def fewest(sizes, capacity):
    """Bins of the best packing, by trying all."""
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        for i in {b: i for i, b in enumerate(bins)}.values():
            if bins[i] + sizes[k] <= capacity:
                go(k + 1, [*bins[:i], bins[i] + sizes[k], *bins[i + 1 :]])
        go(k + 1, [*bins, sizes[k]])

    go(0, [])
    return best[0]


def plain_best_fit(sizes, capacity):
    """Used tokens of each bin by the textbook rule, piece by piece."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, b in enumerate(bins) if b + s <= capacity]
        if fits:
            i = max(fits, key=lambda i: bins[i])
            bins[i] += s
        else:
            bins.append(s)
    return sorted(bins)


@pytest.mark.parametrize("capacity", [10, 24, 97])
def test_bound_never_exceeds_the_best_packing(capacity):
    rng, met = random.Random(capacity), 0
    for _ in range(150):
        sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        best, bound = fewest(sizes, capacity), bestfit.least_bins(np.bincount(sizes, minlength=capacity + 1), capacity)
        assert bound <= best
        met += bound == best
    assert met > 130  # the bound is worth having


def test_bound_sees_more_than_the_sum():
    sizes = np.zeros(1025, dtype=np.int64)
    sizes[520] = 10  # no two fit together
    assert bestfit.least_bins(sizes, 1024) == 10
    sizes[:] = 0
    sizes[342] = 9  # two fit together, three do not
    assert bestfit.least_bins(sizes, 1024) == 5
    assert bestfit.least_bins(sizes * 0, 1024) == 0
    assert bestfit.least_bins(np.eye(1025, dtype=np.int64)[1024] << 50, 1024) == 1 << 50


def test_functions_are_dual_feasible():
    """No set of sizes that fits a bin has more than 1 of any function: checked for all multisets by a knapsack."""
    capacity = 30
    tops, downs = bestfit.dual_feasible(capacity)
    for top, down in zip(tops.tolist(), downs.tolist(), strict=True):
        best = [0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max(best[c - s] + top[s] for s in range(1, c + 1))
        assert best[capacity] <= down


@pytest.mark.parametrize("capacity", [7, 64, 1024])
def test_best_fit_is_the_plain_rule(capacity):
    rng = np.random.default_rng(capacity)
    for n in (0, 1, 5, 60, 400):
        sizes = rng.integers(1, capacity + 1, n)
        if n == 400:
            sizes = rng.choice([1, capacity // 3, capacity // 2], n)
        bins, places = bestfit.best_fit(sizes, capacity)
        held = defaultdict(list)
        for b, p, s in zip(bins.tolist(), places.tolist(), sizes.tolist(), strict=True):
            held[b].append((p, s))
        for rows in held.values():
            at = 0
            for p, s in sorted(rows):
                assert p == at
                at += s
            assert at <= capacity
        assert sorted(sum(s for _, s in rows) for rows in held.values()) == plain_best_fit(sizes.tolist(), capacity)


def check(rows, lengths, sequence):
    """Every piece once, gapless sequences; returns how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r["bin"]].append((r["place"], lengths[r["row"]]))
    assert sorted(r["row"] for r in rows) == sorted(lengths)
    for pieces in held.values():
        at = 0
        for p, s in sorted(pieces):
            assert p == at
            at += s
        assert at <= sequence
    return len(held)


@pytest.mark.parametrize("shard_pieces", [40, 700, 10**6])
@pytest.mark.parametrize("kind", ["even", "large", "thirds"])
def test_exchanges_lose_nothing_and_save_bins(spark, shard_pieces, kind):
    rng = np.random.default_rng(shard_pieces)
    sizes = {"even": rng.integers(1, 1024, 2000), "large": rng.integers(330, 700, 2000), "thirds": rng.choice([1, 2, 341, 342, 511, 513], 2000)}[kind].tolist()
    lengths = dict(enumerate(sizes))
    short = spark.createDataFrame(list(lengths.items()), "row long, length long").repartition(7)
    alone = check(bestfit.placed(short, shard_pieces=shard_pieces, exchanges=0)[0].collect(), lengths, 1024)
    bins, total, least = bestfit.placed(short, shard_pieces=shard_pieces)
    assert check(bins.collect(), lengths, 1024) == total and least <= total <= alone
    if shard_pieces == 40:
        assert total < alone
    assert total <= len(plain_best_fit(sizes, 1024)) * (1.08 if shard_pieces == 40 else 1.02) + 1


def test_pack_table(make, clashing, texts, json_path):
    library = Tokenizer.from_file(json_path)
    docs = clashing(make([*texts, *(f"word{i} " * (7 * i) for i in range(60))]))
    rows = docs.collect()
    got, by, sequences = bestfit.pack(docs, json_path, sequence=128, shard_pieces=50).collect(), defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert sum(r["piece"] == 0 for r in by[None]) == 1
    for key, pieces in by.items():
        if key is None:  # a copy of some row
            continue
        ids = [library.encode(r["text"] or "", add_special_tokens=False).ids + [2] for r in rows if r["doc_id"] == key]
        copies = defaultdict(list)
        for r in pieces:
            copies[r["piece"]].append(r)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids[0][r["start"] : r["start"] + r["length"]]
            assert r["length"] == 128 or r["piece"] == 0
        assert all(len(x) == len(ids) for x in copies.values())
        assert sum(x[0]["length"] for x in copies.values()) == len(ids[0]) and sorted(copies) == list(range(-(-len(ids[0]) // 128)))
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    assert len(sequences) <= -(-sum(r["length"] for r in got) // 128) + 2
    assert bestfit.pack(make([]), json_path).count() == 0
