"""Secrets, personal data and toxicity against plain versions and held-out labels."""

import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F
from tremorlens.llm import pii, secret_scan, toxicity

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def drawn(rng, letters, n):
    return "".join(rng.choice(letters) for _ in range(n))


@pytest.fixture(scope="module")
def secret_texts(texts):
    rng = random.Random(2)
    base62 = secret_scan.ENCODINGS["base62"][0]
    more = [f"see {drawn(rng, base62, 40)} there" for _ in range(20)] + [f"see {drawn(rng, base62, 64)}== there" for _ in range(20)]
    more += [f"Some words AKIA{drawn(rng, 'ABCXYZ0189', 16)} and {drawn(rng, '0123456789abcdef', 40)}", "AKIAABC", 'api_key\'  = "abc.def/+="', "toKen=12345", "ſecret: abcdefgh Key"]
    more += ["internationalisation2counterrevolutionaries thethethethethethethethe1the aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"] * 30
    more += ["é" * 7 + " password=abcdefg, token : 'qwertyuiop'", "0" * 60000, "x=" * 30000, "token=" * 9000]
    return texts + more


def test_rules_and_added_spans(make, secret_texts):
    got = secret_scan.secrets(make(secret_texts), ["doc_id"]).select("row.doc_id", "spans").collect()
    added = 0
    for r in got:
        t = secret_texts[r["doc_id"]] or ""
        spans = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"]]
        assert [s for s in spans if s[2] != "random"] == plain_secrets(t) and spans == sorted(spans)
        for s in spans:
            if s[2] == "random":
                added += 1
                assert t.startswith("see ") and t[s[0] : s[1 + 2]].isalnum()
    assert len(got) == len(secret_texts) and added >= 38


def test_secrets_in_assignments_and_addresses_are_found(make):
    """A key after '=', with padding, in a path, behind a prefix; a text of names and values without keys has none."""
    rng = random.Random(5)
    base62, base64, url = (secret_scan.ENCODINGS[k][0] for k in ("base62", "base64", "url"))
    forms = [
        ("AWS_SECRET_ACCESS_KEY=%s", base64), ("private_key=%s==", base64), ("credential=%s&next=1", base62), ("https://host.org/a?sig=%s", url),
        ("https://host.org/v1/Ab-c_/%s/end", url), ("prefix_%s rest", base64), ("a/b-c_%s", base62),
    ]
    keys = [(form, drawn(rng, letters, 64)) for form, letters in forms for _ in range(12)]
    plain = ["name=value&other=some/long-path_of/words-only AWS_DEFAULT_REGION_NAME=eu-central-1"] * 20
    got = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(make([form % key for form, key in keys] + plain), ["doc_id"]).select("row.doc_id", "spans").collect()}
    found = dict.fromkeys((form for form, _ in forms), 0)
    for k, (form, key) in enumerate(keys):
        at = form.index("%s")
        # a wider span is right too: letters before the key fit its alphabet
        found[form] += any(s["kind"] == "random" and s["start"] <= at and s["end"] >= at + len(key) for s in got[k])
    assert min(found.values()) >= 10, found
    assert not any(got[k] for k in range(len(keys), len(keys) + len(plain)))


def test_battery_accepts_uniform_draws_and_rejects_patterns():
    rng = random.Random(9)
    for name in ("hex", "base62", "base64"):
        letters = secret_scan.ENCODINGS[name][0]
        kept = [secret_scan.fisher(secret_scan.battery(drawn(rng, letters, 64), name)) >= secret_scan.REJECT for _ in range(300)]
        assert np.mean(kept) > 0.97
    assert secret_scan.fisher(secret_scan.battery("0123456789abcdef" * 4, "hex")) < secret_scan.REJECT
    assert secret_scan.fisher(secret_scan.battery("a1" * 30, "alnum")) < secret_scan.REJECT


def test_false_discoveries_are_controlled_by_stratum(spark):
    """Uniform p-values pass about never; a few small ones among them do, by the plain procedure."""
    rng = random.Random(3)
    values = [("long", 10 ** -rng.uniform(12, 20)) for _ in range(30)] + [("long", rng.random()) for _ in range(500)] + [("short", rng.random()) for _ in range(800)]
    rows = [(s, secret_scan.bin_of(p)) for s, p in values]
    got = {r["stratum"]: r["least"] for r in secret_scan.thresholds(spark.createDataFrame(rows, "stratum string, bin int")).collect()}
    assert set(got) <= {"long", "short"} and "long" in got
    passed = [p for s, p in values if s == "long" and secret_scan.bin_of(p) >= got["long"]]
    ranked = sorted(p for s, p in values if s == "long")
    limit = max(p for k, p in enumerate(ranked, 1) if p <= secret_scan.RATE * k / len(ranked))
    assert len(passed) == sum(p <= limit for p in ranked) == 30


def test_secrets_of_clashes_and_nothing(make, clashing, secret_texts):
    docs = clashing(make(secret_texts))
    got = secret_scan.secrets(docs)
    assert got.select("row.*").columns == docs.columns and got.count() == docs.count()
    assert secret_scan.secrets(make([])).count() == 0


def test_redaction(spark):
    rows = [("abcdef", [(1, 3)], "a[secret]def"), ("abcdef", [(0, 2), (1, 4)], "[secret]ef"), ("abcdef", [(0, 4), (1, 2)], "[secret]ef"), ("éb", [], "éb"), (None, [], None), ("abcdef", [(0, 2), (2, 3), (5, 6)], "[secret]de[secret]")]
    df = spark.createDataFrame([(t, s, w) for t, s, w in rows], "t string, s array<struct<start:long,end:long>>, want string")
    assert [r["got"] for r in df.select(secret_scan.redacted(F.col("t"), F.col("s")).alias("got")).collect()] == [w for _, _, w in rows]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def digits(m):
    return re.sub("[^0-9]", "", m)


def plain_luhn(d):
    return sum((v - 9 if (v := int(c) * (1 + i % 2)) > 9 else v) for i, c in enumerate(reversed(d))) % 10 == 0


CHECKS = {
    "email": lambda m: True,
    "ip": lambda m: all(int(x) <= 255 for x in m.split(".")),
    "card": lambda m: 12 <= len(digits(m)) <= 19 and plain_luhn(digits(m)),
    "phone": lambda m: 9 <= len(digits(m)) <= 15,
}


def plain_pii(t):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, t) if CHECKS[kind](m.group()))


@pytest.fixture(scope="module")
def personal_texts(texts):
    rng = random.Random(8)
    bits = ["a.b@c.de", "@", "x@y", "a@b.c+d@e.f", "1.2.3.4", "256.1.1.1", "01.002.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "1234 5678 9012", "+1 (555) 010-9999", "+49 30 1234567", "+1", "é", "\U0001f600", " ", "-", ".", "%", "word", "00000000000000", "5500005555555559", "++1 22 333 4444 5"]
    noise = ["".join(rng.choice(bits) + rng.choice(["", " ", "-", "."]) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    return texts + noise + ["IBAN DE89370400440532013000.", "DE89 3704 0044 0532 0130 00 end", "DE89370400440532013001", "7 " * 30000, "9" * 50000, "a@" + "b." * 20000 + "c", "+1" + " (" * 20000, "1." * 20000, "mail me: a@b.org", "x" * 50000]


def test_personal_data(make, personal_texts):
    got = pii.personal_data(make(personal_texts)).collect()
    ibans = 0
    for r in got:
        spans = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["spans"]]
        t = personal_texts[r["doc_id"]] or ""
        assert [s for s in spans if s[2] != "iban"] == plain_pii(t) and spans == sorted(spans)
        ibans += sum(s[2] == "iban" for s in spans)
        assert all(0 < s["score"] <= 1 for s in r["spans"])
    assert len(got) == len(personal_texts) and ibans == 2


def test_context_raises_the_score(make):
    got = pii.personal_data(make(["contact a@b.org", "zzz a@b.org"])).orderBy("doc_id").collect()
    assert got[0]["spans"][0]["score"] > got[1]["spans"][0]["score"]


def test_personal_data_is_native_and_takes_anything(make, clashing, personal_texts):
    df = pii.personal_data(clashing(make(personal_texts)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan.split("Scan")[0][:40]
    assert df.count() == 2 * len(personal_texts) + 1
    assert pii.personal_data(make([])).count() == 0


# ---- toxicity ------------------------------------------------------------------------------
def plain_features(t):
    low = " " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) + " "
    out, mask = set(), (1 << 64) - 1
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            key = n
            for c in low[i : i + n]:
                key = (key * int(toxicity.MIX) & mask) ^ ord(c)
            out.add((key * int(toxicity.MIX) & mask) >> (64 - toxicity.BITS))
    return sorted(out)


def test_features(texts):
    some = [t or "" for t in texts if len(t or "") < 2000]
    row, bucket = toxicity.features(some)
    for k, t in enumerate(some):
        assert bucket[row == k].tolist() == plain_features(t)


def labelled(make, spark, n=900):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghinorstu") for _ in range(rng.randrange(2, 9))) for _ in range(500)]
    bad = ["idiotic", "loathsome", "vermin", "worthless"]
    texts, toxic = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.choice((5, 40, 400)))]
        toxic.append(int(rng.random() < 0.15))
        if toxic[-1]:
            for _ in range(2):
                t.insert(rng.randrange(len(t)), rng.choice(bad))
        texts.append(" ".join(t))
    return make(texts), spark.createDataFrame([(i, 0, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int"), toxic


def test_held_out_accuracy_and_no_leak(spark, make):
    docs, labels, toxic = labelled(make, spark)
    model = toxicity.train(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_rows(docs, model).select("row.doc_id", "score").collect()}
    held = [i for i in scores if zlib.crc32(str(i).encode()) % 3 == 1]
    hit = [(scores[i] >= toxicity.THRESHOLD) == bool(toxic[i]) for i in held]
    assert len(held) > 200 and np.mean(hit) > 0.97
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.train(docs, flipped)
    assert (again[0] == model[0]).all() and again[1] == model[1]


def test_scores_of_anything(spark, make, clashing, texts):
    docs, labels, _ = labelled(make, spark, 200)
    model = toxicity.train(docs, labels)
    wide = clashing(make(texts))
    got = toxicity.score_rows(wide, model)
    assert got.select("row.*").columns == wide.columns
    rows = got.select("row.doc_id", "score").collect()
    assert len(rows) == 2 * len(texts) + 1 and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.score_rows(make([]), model).count() == 0


def test_training_without_labels(spark, make):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one_sided = spark.createDataFrame([(i, 0, 0) for i in range(9)] + [(None, None, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (nothing, one_sided):
        weights, bias = toxicity.train(make(["a b c"] * 9), labels)
        assert not weights.any() and np.isfinite(bias)
    assert not toxicity.train(make([]), one_sided)[0].any()


def test_sample_is_bounded(spark, make):
    docs, labels, toxic = labelled(make, spark, 300)
    picked = toxicity.sample_of(docs, labels, "doc_id", "text", 10).groupBy("toxic").count().collect()
    assert {r["toxic"]: r["count"] for r in picked} == {0: 10, 1: 10}


@pytest.mark.parametrize("scan", ["pii", "secrets"])
def test_cost_follows_the_matches_of_a_text(spark, scan):
    """Twice as many matches in one text cost about twice as much, not four times."""
    import time

    keys, seconds = random.Random(8), []
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (500, 8000, 16000):  # the first one warms up
        words = (f"write to user{i}@example.com now" if scan == "pii" else "".join(keys.choice(letters) for _ in range(32)) for i in range(n))
        df = spark.createDataFrame([(1, " and ".join(words))], "doc_id long, text string")
        began = time.perf_counter()
        if scan == "pii":
            assert pii.personal_data(df).select(F.size("spans")).first()[0] == n
        else:
            found = secret_scan.secrets(df).select(F.size("spans"), F.length(secret_scan.redacted(F.col("row.text"), F.col("spans")))).first()
            assert found[0] > 0.9 * n and found[1] < 20 * n
        seconds.append(time.perf_counter() - began)
    assert seconds[2] <= 2.5 * seconds[1] + 1
