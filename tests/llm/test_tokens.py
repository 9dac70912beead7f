"""Encoding, counting and packing against the public tokenizer libraries."""

import base64
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tremorlens.llm import bpe, packing, pretokens, token_counts
from tremorlens.llm.queries import tokenizer


@pytest.fixture(scope="module")
def rank_library(rank_path):
    import public_tokenizers
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def json_library(json_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(json_path)


def noise(n, seed=1):
    rng, letters = random.Random(seed), "ab'strevlmd 's 'll \n\t 　éß12٣!.,-<|>漢\U0001f600\x1c\x85 "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def split(flat, at):
    return [flat[a:b].tolist() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def test_scan_equals_stepping():
    rng = np.random.default_rng(3)
    for n in (1, 2, 255, 256, 257, 5000):
        kinds = np.append(rng.integers(0, pretokens.N_CLASSES, n), pretokens.END).astype(np.uint8)
        state, plain = pretokens.FRESH, []
        for c in kinds.tolist():
            state, start = pretokens._step(state, c)
            plain.append(start)
        assert pretokens.token_starts(kinds).tolist() == plain


def test_ids_equal_libraries(rank_path, json_path, rank_library, json_library, texts):
    many = [t or "" for t in texts] + noise(3000)
    assert split(*bpe.rank_encoder(rank_path).encode(many)) == [rank_library.encode_ordinary(t) for t in many]
    assert split(*bpe.json_encoder(json_path).encode(many)) == [json_library.encode(t, add_special_tokens=False).ids for t in many]


def test_every_code_point_splits_as_the_libraries_do(rank_path, json_path, rank_library, json_library):
    some = [f"a{chr(c)}1 {chr(c)}{chr(c)}b{chr(c)}" for c in [*range(0x3100), *range(0xA000, 0xA100), *range(0xFE00, 0x10400)] if not 0xD800 <= c < 0xE000]
    assert split(*bpe.rank_encoder(rank_path).encode(some)) == [rank_library.encode_ordinary(t) for t in some]
    assert split(*bpe.json_encoder(json_path).encode(some)) == [json_library.encode(t, add_special_tokens=False).ids for t in some]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_round_trip(texts):
    encoder = bpe.rank_encoder(tokenizer("byte_bpe_50k.tiktoken"))
    ids, at = encoder.encode(texts)
    raw, to = encoder.decode(ids)
    for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert raw[to[a] : to[b]].tobytes().decode() == t


def test_small_cache_gives_the_same(monkeypatch, rank_path, rank_library):
    monkeypatch.setattr(bpe, "CACHE_IDS", 10)
    encoder, many = bpe.rank_encoder(rank_path), noise(300, 2)
    for _ in range(2):
        assert split(*encoder.encode(many)) == [rank_library.encode_ordinary(t) for t in many]


def test_encode_and_decode_table(make, clashing, texts, rank_path, rank_library):
    docs = clashing(make(texts))
    got = bpe.encode_and_decode(docs, rank_path).collect()
    assert len(got) == 2 * len(texts) + 1
    for r in got:
        if r["doc_id"] is not None:
            t = texts[r["doc_id"]] or ""
            assert np.frombuffer(r["ids"], "<u4").tolist() == rank_library.encode_ordinary(t) and r["decoded"] == t.encode()
            assert r["n_tokens"] == len(r["ids"]) // 4 and r["n_bytes"] == len(t.encode())
            assert all(0 <= x < max(1, r["n_bytes"]) for x in np.frombuffer(r["offsets"], "<u4"))
    assert bpe.encode_and_decode(make([]), rank_path).count() == 0


@pytest.mark.parametrize("buckets", [None, 1, 7])
def test_counts_equal_the_library(make, clashing, texts, json_path, json_library, buckets):
    many = texts + noise(400, 5)
    got = token_counts.count_tokens(clashing(make(many)), json_path, buckets=buckets).collect()
    assert len(got) == 2 * len(many) + 1
    for r in got:
        if r["doc_id"] is not None:
            t = many[r["doc_id"]] or ""
            assert (r["n_bytes"], r["n_tokens"]) == (len(t.encode()), len(json_library.encode(t, add_special_tokens=False).ids))


def test_counts_of_nothing(make, json_path):
    assert token_counts.count_tokens(make([]), json_path).count() == 0
    assert [tuple(r) for r in token_counts.count_tokens(make(["", None]), json_path).orderBy("doc_id").collect()] == [(0, 0, 0), (1, 0, 0)]


@pytest.mark.parametrize("quantum", [64, 512])
@pytest.mark.parametrize("shares", [None, {"q0": 0.7, None: 0.1, "q3": -1.0, "q9": 0.4}])
def test_stream_is_the_order_of_service_times(spark, quantum, shares):
    """Places follow from sorting all quanta by the time at which they are due, ties by source; none overlap, none are missing."""
    rng = np.random.default_rng(quantum)
    lines = [(part, slot, None if q == 2 else f"q{q}", int(rng.integers(1, 3000))) for part in range(6) for slot, q in enumerate(rng.permutation(5)[: rng.integers(1, 6)].tolist())]
    total, every = defaultdict(int), sum(x[3] for x in lines)
    for *_, q, n in lines:
        total[q] += n
    named = spark.createDataFrame([(f"q{q}" if q != 2 else None,) for q in range(5)], "queue string")
    part_of = {r[0]: r[1] for r in named.select("queue", packing.phase(F.col("queue"))).collect()}
    served, base = [], defaultdict(int)
    for part, slot, q, n in lines:
        share = (shares or {}).get(q, 0)
        weight = share * every if share > 0 else total[q]
        for k in range(-(-n // quantum)):
            end = min((k + 1) * quantum, n)
            served.append(((base[q] + k * quantum + (end - k * quantum) * part_of[q]) / weight, q is not None, q or "", part, k, slot, end - k * quantum))
        base[q] += n
    expected, at = {}, 0
    for *_, part, k, slot, size in sorted(served):
        expected[part, slot, k] = at
        at += size
    targets = spark.createDataFrame(list(shares.items()), "source string, share double") if shares else None
    table = spark.createDataFrame(lines, "part int, slot int, queue string, n long").repartition(3)
    assert {(r["part"], r["slot"], r["k"]): r["place"] for r in packing.stream_places(table, quantum, targets).collect()} == expected


def test_pieces_hold_every_id_once(make, texts, json_path, json_library):
    many = texts + noise(300, 7) + ["some words in a row " * 400] * 3
    source = [("a", "b", None, "c")[0 if i % 3 else i % 4] for i in range(len(many))]
    got = packing.pack(make(many, source), json_path, sequence=256, quantum=64).collect()
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, t in enumerate(many):
        ids, at = json_library.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and np.frombuffer(r["ids"], "<u4").tolist() == ids[at : at + r["length"]] and r["doc_tokens"] == len(ids)
            at += r["length"]
        assert at == len(ids)
    for k, rows in sequences.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 256 or k == max(sequences)
    assert sorted(sequences) == list(range(len(sequences)))


def test_windows_hold_sources_in_their_share(make, json_path):
    many = [f"word{i} " * 60 for i in range(300)]
    source = ["big" if i % 3 else "small" for i in range(300)]
    got = packing.pack(make(many, source), json_path, sequence=512, quantum=64).collect()
    total, share = sum(r["length"] for r in got), sum(r["length"] for r in got if r["source"] == "small")
    windows = defaultdict(int)
    for r in got:
        windows[r["sequence_id"]] += r["length"] * (r["source"] == "small")
    for k in range(max(windows)):
        assert abs(windows[k] - 512 * share / total) <= 2 * 64


def test_repeats_clashes_and_nothing(make, clashing, texts, json_path):
    got = packing.pack(clashing(make(texts)), json_path).collect()
    assert sum(1 for r in got if r["start"] == 0) == 2 * len(texts) + 1
    assert packing.pack(make([]), json_path).count() == 0


def test_five_thousand_sources_hold_their_shares(make, json_path):
    """Half of all documents are of one source, the others of a source each: every window holds half of either."""
    many = [f"text {i} with some more words in it" for i in range(10_000)]
    got = packing.pack(make(many, ["big" if i % 2 else f"s{i}" for i in range(10_000)], partitions=5), json_path, sequence=512, quantum=64).collect()
    covered, at = sorted((r["sequence_id"] * 512 + r["offset"], r["length"]) for r in got), 0
    for a, n in covered:
        assert a == at
        at += n
    total, share = at, sum(r["length"] for r in got if r["source"] == "big") / at
    windows = defaultdict(int)
    for r in got:
        windows[r["sequence_id"]] += r["length"] * (r["source"] == "big")
    assert len({r["source"] for r in got}) == 5001
    assert max(abs(windows[k] / 512 - share) for k in range(max(windows))) < 0.3
    tens = [sum(windows[k + i] for i in range(10)) / 5120 for k in range(0, max(windows) - 10, 10)]
    assert max(abs(x - share) for x in tens) < 0.1


def test_targets_fill_windows_while_their_source_lasts(spark, make, json_path):
    many = [f"word{i} " * 60 for i in range(400)]
    source = [("a", "b", "c", None)[i % 4] for i in range(400)]
    targets = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", 0.25), (None, 0.125), ("absent", 0.9)], "source string, share double")
    got = packing.pack(make(many, source), json_path, sequence=1024, quantum=64, targets=targets).collect()
    total, held = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for r in got:
        total[r["source"]] += r["length"]
        held[r["sequence_id"]][r["source"]] += r["length"]
    assert sum(total.values()) == sum(n for w in held.values() for n in w.values())
    dry = int(total["a"] / (0.5 / 1.125) // 1024)  # windows until the queue of the largest share runs dry
    for k in range(dry - 1):
        for q, share in (("a", 0.5), ("b", 0.25), ("c", 0.25), (None, 0.125)):
            assert abs(held[k][q] - 1024 * share / 1.125) <= 2 * 64
    last = max(held)
    assert all(sum(held[k].values()) == 1024 for k in range(last)) and not any(held[k]["a"] for k in range(dry + 2, last))
