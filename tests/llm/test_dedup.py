"""Exact and near duplicates against plain versions."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F
from tremorlens.llm import exact_dedup, simhash
from tremorlens.llm.components import components


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]).encode(), 42) for k in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, bits):
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, i in enumerate(ids):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, i in enumerate(ids)}


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_classes(make, clashing, texts, keep):
    many = texts + ["same"] * 40 + ["", None, "Same", "same "]
    got = exact_dedup.classes(make(many, partitions=9), keep=keep).collect()
    groups = {}
    for i, t in enumerate(many):
        groups.setdefault(t or "", []).append(i)
    assert len(got) == len(many)
    for r in got:
        t = many[r["doc_id"]] or ""
        stays = (max if keep == "max" else min)(groups[t])
        assert (r["keep_id"], r["group_size"], r["kept"]) == (stays, len(groups[t]), r["doc_id"] == stays)
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_exact_classes_of_repeated_rows_and_null_ids(make, clashing, texts):
    got = exact_dedup.classes(clashing(make(texts))).collect()
    assert len(got) == 2 * len(texts) + 1
    assert sum(r["kept"] for r in got) == 2 * len({t or "" for t in texts})
    assert not any(r["kept"] for r in got if r["doc_id"] is None)
    assert exact_dedup.classes(make([])).count() == 0


def test_exact_classes_with_one_run_and_many_levels(make):
    many = ["x", "y"] * 30
    for runs, fan in ((1, 8), (2, 2), (27, 3), (5, 2)):
        got = exact_dedup.classes(make(many, partitions=7), runs=runs, fan_in=fan).collect()
        assert {(r["keep_id"], r["group_size"]) for r in got} == {(58, 30), (59, 30)}


def test_exact_dedup_is_native(make, texts):
    plan = exact_dedup.classes(make(texts))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_runs_are_merged_in_order_without_dealing_them_anew(spark, make, texts):
    """Two runs meet in a merge join right above their bucketed scans: no exchange."""
    runs = []
    for part in (texts, [*texts, "more"]):
        content = F.coalesce("text", F.lit(""))
        rows = make(part).select(F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(content).alias("n_bytes"), F.xxhash64(content).alias("check"), F.col("doc_id"))
        runs.append(exact_dedup._sorted_run(rows.groupBy(*exact_dedup.SAME).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).repartition(4, *exact_dedup.SAME), 4))
    both = exact_dedup.merged(*runs, F.greatest)
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "FullOuter" in plan and "Exchange" not in plan
    assert {r["keep_id"]: r["group_size"] for r in both.collect()}[len(texts)] == 1
    assert sum(r["group_size"] for r in both.collect()) == 2 * len(texts) + 1


def test_fingerprints(texts):
    assert simhash.fingerprints_of([t or "" for t in texts]).tolist() == [plain_fingerprint(t) for t in texts]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_against_all_pairs(make, texts):
    rng = random.Random(4)
    bases = [[f"v{rng.randrange(10**6)}" for _ in range(rng.choice((60, 300)))] for _ in range(12)]
    many = texts + [edited(rng, b, rng.randrange(3)) for b in bases for _ in range(8)]
    prints = [plain_fingerprint(t) for t in many]
    expected = plain_components(list(range(len(many))), prints, 4)
    assert len(set(expected.values())) < len(many) - 20
    for block in (4096, 5):
        got = simhash.near_duplicates(make(many), block=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == expected
        assert all(r["fingerprint"] % 2**64 == prints[r["doc_id"]] for r in got)


@pytest.mark.parametrize("block", [4096, 16])
def test_links_keep_what_all_pairs_join(spark, block):
    """A dense cloud around one fingerprint (long posting lists), chains, and far ones."""
    rng = random.Random(6)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        x = centre
        for b in rng.sample(range(64), rng.randrange(1, 5)):
            x ^= 1 << b
        prints.add(x)
    x = rng.getrandbits(64)
    for _ in range(30):
        prints.add(x)
        for b in rng.sample(range(64), 4):
            x ^= 1 << b
    prints |= {rng.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    rows = [(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints]
    links = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.links_between(spark.createDataFrame(rows, "fingerprint long"), block=block).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    expected = plain_components(prints, prints, 4)
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert {p: find(p) for p in prints} == expected


def test_near_duplicates_of_repeats_null_ids_and_nothing(make, clashing, texts):
    got = simhash.near_duplicates(clashing(make(texts))).collect()
    assert len(got) == 2 * len(texts) + 1
    assert simhash.near_duplicates(make([])).count() == 0
    lone = simhash.near_duplicates(make(["alone here with some words"]).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text")).collect()
    assert [(r["doc_id"], r["component_id"]) for r in lone] == [(None, None)]


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(400)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 401)} | {1000 + i: 1000 for i in range(1, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
