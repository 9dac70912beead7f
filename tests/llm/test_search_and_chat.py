"""Exact top-k and chat formatting against plain versions."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F
from tremorlens.llm import chat, topk


def plain_top(vectors, k):
    good = {i: np.floor(64 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)}
    out = {}
    for i, q in good.items():
        if i % 3 == 0:
            ranked = sorted((-int(q @ v), j) for j, v in good.items() if j != i)[:k]
            out[i] = [(j, -s) for s, j in ranked]
    return out


def answers(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("blocks", [(1 << 16, 64), (37, 5)])
@pytest.mark.parametrize("k", [1, 20, 10_000])
def test_top_k(spark, blocks, k):
    rng = np.random.default_rng(k)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(260)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2001, None), (2004, []), (2007, [None] * 16), (2010, [float("nan")] * 16), (2013, [float("inf")] * 16), (2016, [0.0] * 16), (2019, [3.0] * 16)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(4)
    assert answers(topk.top_k(df, F.col("vec_id") % 3 == 0, k, candidates=blocks[0], queries=blocks[1])) == plain_top(rows, k)


def test_top_k_of_little(spark):
    schema = "vec_id long, embedding array<float>, label int, id long, v int, asks string, ask int, block int"
    empty = spark.createDataFrame([], schema)
    assert topk.top_k(empty, F.col("vec_id") % 3 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0, 2.0], 1, 5, 5, "x", 1, 1), (None, [1.0], 1, 5, 5, "x", 1, 1)], schema)
    assert topk.top_k(lone, F.col("vec_id") % 3 == 0).count() == 0
    ragged = spark.createDataFrame([(0, [1.0, 2.0], 1, 5, 5, "x", 1, 1), (1, [1.0], 1, 5, 5, "x", 1, 1), (1, [1.0], 1, 5, 5, "x", 1, 1)], schema)
    assert answers(topk.top_k(ragged, F.col("vec_id") % 3 == 0)) == {0: [(1, 4096), (1, 4096)]}


@pytest.mark.parametrize("top", [30, 3, 10**5, 10**8, 3 * 10**8])
def test_block_search_is_exact(top):
    """Whatever the width of sums: narrow and wide floats, and integers beyond them."""
    rng = np.random.default_rng(top)
    vectors = rng.integers(-top, top, (3000, 32))
    vectors[-40:] = vectors[:40]
    block = topk.Block(np.arange(3000), vectors)
    queries = np.concatenate([rng.integers(-top, top, (20, 32)), np.zeros((1, 32), dtype=np.int64), vectors[:3]])
    own = np.array([-1] * 21 + [0, 1, 2])
    for q, i, (at, score) in zip(queries, own.tolist(), block.best(queries, own, 20), strict=True):
        exact = vectors @ q
        order = [j for j in np.lexsort((np.arange(3000), -exact)).tolist() if j != i][:20]
        assert at.tolist() == order and score.tolist() == exact[order].tolist()


def test_proof_leaves_few_to_score():
    rng = np.random.default_rng(0)
    vectors = np.floor(rng.normal(0, 8, (20000, 64))).astype(np.int64)
    block = topk.Block(np.arange(20000), vectors)
    block.best(vectors[:10], np.arange(10), 20)
    assert min(digit for digit, _ in block.slices) > 0


# ---- chat ----------------------------------------------------------------------------------
SCHEMA = "conversation long, turn long, copy int, seq int, event string, role string, text string"


def plain_fold(events):
    """Messages of one turn's events, in order."""
    text, role = "", ""
    for e in events:
        role = e[1] if e[1] is not None else role
        text = {"message": e[2] or "", "edit": e[2] or "", "regenerate": ""}.get(e[0], text + (e[2] or ""))
    return role, text


def test_fold_render_and_read_back(spark):
    rng = random.Random(11)
    said = ["", None, "plain", r"\### Assistant: </turn> ok", "&amp;&lt;#:", "### user: x</turn>\n", "é\U0001f600 end\\", "</turn", "a: b", "long " * 3000]
    roles = ["user", "assistant", "system", None, "odd: role </turn>\n#&", "tool"]
    rows, turns = [], {}
    for c in range(60):
        for t in range(rng.randrange(1, 6)):
            events = [("message", rng.choice(roles), rng.choice(said))] * (rng.random() < 0.8)
            events += [(rng.choice(["delta", "delta", "edit", "regenerate"]), rng.choice([None, "assistant"]), rng.choice(said)) for _ in range(rng.randrange(1, 6))]
            rows += [(c, t, 1, k, *e) for k, e in enumerate(events)]
            turns.setdefault(c, []).append(plain_fold(events))
    rng.shuffle(rows)
    shown = chat.format_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    got = shown.select("conversation", "formatted", "loss", chat.read_back(F.col("formatted")).alias("turns"), chat.under_mask(F.col("formatted"), F.col("loss")).alias("said")).collect()
    assert len(got) == 60
    for r in got:
        expected = turns[r["conversation"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == expected
        assert r["said"] == "".join(t for role, t in expected if role == "assistant")
        assert len(r["loss"]) == sum(role == "assistant" for role, _ in expected)
        assert r["formatted"].count("</turn>") == len(expected) and r["formatted"].count("###") == len(expected)


def test_ties_nulls_and_nothing(spark):
    rows = [(None, None, 1, None, "message", None, None), (1, None, 1, 0, "delta", "assistant", "x"), (1, 0, 1, 0, "message", "assistant", "b"), (1, 0, 2, 0, "message", "assistant", "a"), (1, 0, 2, 0, "message", "assistant", "a")]
    got = {r["conversation"]: r["said"] for r in chat.format_conversations(spark.createDataFrame(rows, SCHEMA)).select("conversation", chat.under_mask(F.col("formatted"), F.col("loss")).alias("said")).collect()}
    assert got == {None: "", 1: "xba"}
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chat_is_native(spark):
    plan = chat.format_conversations(spark.createDataFrame([(1, 1, 1, 1, "message", "user", "x")], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan and "MapIn" not in plan
