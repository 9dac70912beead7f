"""Queries against their SQL on the small tables, and the pipeline against its parts."""

import os
import random
import re

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tremorlens.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in sorted(QUERIES, key=lambda n: int(re.match(r"op(\d+)_", n)[1]))] == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    result = con.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(str, df.select(names).collect())) == sorted("Row(" + ", ".join(f"{n}={v!r}" for n, v in zip(names, row, strict=True)) + ")" for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_covers_its_table(spark, name):
    df = QUERIES[name](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()


def stage(spark, docs, name):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, FOLDER)


def test_stages_hold_to_their_contract(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    for name, f in corpus_pipeline.STAGES[:-1]:
        out = f(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
    final = corpus_pipeline.run(spark, FOLDER)
    assert final.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(final.columns)


def test_copies_go_and_one_stays(spark, make):
    docs = make(["same text here"] * 5 + ["other", None, ""])
    kept = {r["doc_id"] for r in stage(spark, docs, "exact_dedup").collect()}
    assert kept == {4, 5, 7}
    repeated = docs.union(docs)
    assert sorted(r["doc_id"] for r in stage(spark, repeated, "exact_dedup").collect()) == [4, 5, 7]


def test_near_copies_go_and_one_stays(spark, make):
    words = [f"word{i}" for i in range(400)]
    near = [" ".join(words), " ".join(["changed", *words[1:]]), " ".join([*words[:-1], "end"])]
    docs = make(near + ["something else altogether here", "and a further text of no likeness"])
    assert sorted(r["doc_id"] for r in stage(spark, docs, "near_dedup").collect()) == [0, 3, 4]


def test_near_stage_tells_null_and_shared_ids_apart(spark):
    """Unlike texts without ids all stay; of an id with a near copy and a text of its own, the text of its own stays in every run."""
    unlike = [" ".join(f"t{k}w{i}" for i in range(60)) for k in range(12)]
    words = [f"word{i}" for i in range(400)]
    original, copy = " ".join(words), " ".join([*words[:-1], "end"])
    rows = [(None, t) for t in unlike] + [(1, original), (7, copy), (7, "a text of its own that nobody else has"), (None, copy)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in stage(spark, docs, "near_dedup").collect())
    assert got == sorted([(True, 0, t) for t in unlike] + [(False, 1, original), (False, 7, "a text of its own that nobody else has")])


def changed(rng, words, share):
    """A copy in which words at random places are others, and its exact likeness in runs of five words."""
    other = [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in words]
    runs = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (words, other)]
    return other, len(runs[0] & runs[1]) / len(runs[0] | runs[1])


def test_near_stage_finds_nine_of_ten_copies_at_the_threshold(spark, make):
    """Pairs just above a likeness of 0.8 are found; pairs below it, and texts of their own, stay."""
    rng, texts, pairs = random.Random(12), [], []
    while len(pairs) < 120:
        words = [f"v{rng.randrange(10**6)}" for _ in range(400)]
        other, alike = changed(rng, words, 0.022 if len(pairs) < 100 else 0.05)
        if 0.8 <= alike < 0.83 or (alike < 0.75 and len(pairs) >= 100):
            pairs.append(alike)
            texts += [" ".join(words), " ".join(other)]
    kept = {r["doc_id"] for r in stage(spark, make(texts), "near_dedup").collect()}
    assert kept >= set(range(0, 240, 2))  # originals
    assert sum(2 * k + 1 not in kept for k in range(100)) >= 90
    assert all(2 * k + 1 in kept for k in range(100, 120))


def test_secrets_are_hidden_and_documents_stay(spark, make):
    docs = make(["token = abcdefgh1 rest", "clean text", None])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in stage(spark, docs, "secrets").collect()}
    assert got == {0: ("[secret] rest", 13), 1: ("clean text", 10), 2: (None, 0)}


def test_stages_take_empty_tables_and_extra_columns(spark, make, clashing):
    empty, wide = make([]), clashing(make(["a b c d e", "x y z", None, "token = abcdefgh1"]))
    for name, f in corpus_pipeline.STAGES:
        assert f(spark, empty, FOLDER).count() == 0
        out = f(spark, wide, FOLDER)
        assert out.count() > 0
        if name != "packing":
            assert out.columns == wide.columns


def test_nothing_else_imports_the_operators():
    top = os.path.dirname(os.path.abspath(entry.__file__))
    for folder, _, names in os.walk(top):
        if any(x in folder for x in (".git", f"tremorlens{os.sep}llm", f"tests{os.sep}llm")):
            continue
        for n in names:
            if n.endswith(".py") and n not in ("corpus_pipeline.py", "__spark_entry__.py"):
                with open(os.path.join(folder, n), encoding="utf-8") as f:
                    assert "tremorlens.llm" not in f.read()
