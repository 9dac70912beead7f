"""Secrets: fixed rules, and a battery of randomness tests with length-aware control of false discoveries.

Rules find assignments, access keys and long hexadecimal runs.  Beyond them, every run of key
characters is a candidate, and so is every long part of it between separators.  Its encoding is inferred from the characters it uses, and three tests ask whether it
looks drawn uniformly from that alphabet: chi-squared uniformity of symbols, the number of runs
above and below the middle of the alphabet, and the serial correlation of neighbours.  Their p-values are combined (Fisher); a
candidate that the battery rejects is not random and is dropped.

Not being rejected proves little for a short string, so what is left must also be unlike words:
its p-value is the chance that a word of its length, with the repeats of letters of natural words, would look as
uniform (a non-central chi-squared).  All candidates of the corpus are tested together, by
Benjamini-Hochberg within strata of encoding and length, so that the many short candidates do not
pay for, or hide behind, the few long ones.  Ranks come from counts by binned p-value over the whole
corpus; only that table, bounded by strata times bins, is sent to the tasks.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import accumulate
from math import erfc, exp, log, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tremorlens.llm.common import landed, slices, texts_of

#: Least length of a candidate, level below which the battery rejects, and false discoveries allowed.
LEAST, REJECT, RATE = 20, 0.001, 0.01
#: Bins of p-values in each factor of ten, and the smallest p-value told apart.
BINS, SMALLEST = 8, 1e-30

# Rules, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Runs end at '=', which is padding or stands between a name and its value; parts of a run lie between separators that its
#: own encoding does not use: a path around a url-safe key, a prefix before a base64 one, or either around letters and digits.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}" % LEAST)
PARTS = [re.compile("[A-Za-z0-9%s]{%d,}" % (inner, LEAST)) for inner in ("_-", "+/", "")]

# Alphabets in their own order, and by how much natural words repeat symbols of each beyond chance
# (index of coincidence times symbols, less one: 0.065 for single letters).
ENCODINGS = {
    "hex": ("0123456789abcdef", 0.5),
    "HEX": ("0123456789ABCDEF", 0.5),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.0),
    "alnum": ("0123456789abcdefghijklmnopqrstuvwxyz", 1.3),
    "base62": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 2.5),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 2.6),
    "url": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 2.6),
}
PLACES = {name: {c: i for i, c in enumerate(letters)} for name, (letters, _) in ENCODINGS.items()}


def encoding_of(token: str) -> str | None:
    """Smallest alphabet that holds the token and that it draws on with letters and digits; none for words and numbers."""
    letters = set(token)
    if not any(c.isdigit() for c in letters) or not any(c.isalpha() for c in letters):
        return None
    return next((name for name in ENCODINGS if letters <= PLACES[name].keys()), None)


def normal_tail(z: float) -> float:
    """Two-sided tail of the normal distribution."""
    return erfc(abs(z) / sqrt(2))


def chi_squared(token: str, name: str) -> float:
    """Chi-squared statistic against uniform symbols."""
    n, k = len(token), len(ENCODINGS[name][0])
    return sum(c * c for c in Counter(token).values()) * k / n - n


def battery(token: str, name: str) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation under uniform draws from the alphabet."""
    n, k, at = len(token), len(ENCODINGS[name][0]), [PLACES[name][c] for c in token]
    # The statistic has mean k - 1 and variance 2 (k - 1)(1 - 1 / n) when draws are uniform.
    uniform = normal_tail((chi_squared(token, name) - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / n)))
    high = [2 * x >= k for x in at]
    a = sum(high)
    b = n - a
    if not a or not b:
        runs = 2.0**-n * 2
    else:
        mean = 2 * a * b / n + 1
        spread = (mean - 1) * (mean - 2) / (n - 1)
        runs = normal_tail((1 + sum(x != y for x, y in zip(high, high[1:])) - mean) / sqrt(spread)) if spread > 0 else 1.0
    middle = (k - 1) / 2
    variance = (k * k - 1) / 12
    serial = sum((x - middle) * (y - middle) for x, y in zip(at, at[1:])) / (variance * sqrt(n - 1))
    return uniform, runs, normal_tail(serial)


def fisher(values: tuple[float, ...]) -> float:
    """Combined p-value: the tail of a chi-squared with two degrees of freedom for each value."""
    half = -sum(log(max(v, 1e-300)) for v in values)
    term, total = 1.0, 1.0
    for i in range(1, len(values)):
        term *= half / i
        total += term
    return min(1.0, exp(-half) * total)


def like_words(token: str, name: str) -> float:
    """Chance that a word of this length would look as uniform as the token."""
    n, k = len(token), len(ENCODINGS[name][0])
    excess = n * ENCODINGS[name][1]
    z = (chi_squared(token, name) - (k - 1) - excess) / sqrt(2 * (k - 1) + 4 * excess)
    return 0.5 * erfc(-z / sqrt(2))


def stratum(name: str, length: int) -> str:
    """Encoding, and length to the power of two."""
    return f"{name}:{length.bit_length()}"


def bin_of(p: float) -> int:
    """Bins are ordered as p-values are."""
    return round(-log(max(p, SMALLEST)) / log(10) * BINS)


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the rules: start, place of the kind, end; leftmost and apart within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, list[dict]]]:
    """Runs, and their parts, that the battery does not reject and no rule covers: start, end, stratum, bin of the p-value against words, and stratum and bin of what is wider.

    Parts are tested beside their run, as words around a key may pass or fail with it; what lies in an accepted span is left out later.
    """
    out = []
    starts = [a for a, _, _ in taken]
    reach = list(accumulate((b for _, _, b in taken), max))  # how far the rules' spans reach that start by then
    for m in CANDIDATE.finditer(text):
        places = {m.span(): None}
        if not m.group().isalnum():
            places |= {part.span(): None for cut in PARTS for part in cut.finditer(text, *m.span())}
        mine = []
        for start, end in places:
            token = text[start:end]
            name, before = encoding_of(token), bisect_right(starts, start)
            if name and not (before and reach[before - 1] >= end) and fisher(battery(token, name)) >= REJECT:
                mine.append((start, end, stratum(name, len(token)), bin_of(like_words(token, name))))
        # runs lie apart, so what is wider than a part is among the few places of its run
        out += [(*c, [{"stratum": o[2], "bin": o[3]} for o in mine if o[0] <= c[0] and o[1] >= c[1] and o[1] - o[0] > c[1] - c[0]]) for c in mine]
    return out


def thresholds(tested: DataFrame, rate: float = RATE) -> DataFrame:
    """Benjamini-Hochberg by stratum: the lowest bin that is accepted, for columns stratum and bin of all candidates."""
    counted = tested.groupBy("stratum", "bin").agg(F.count("*").alias("n"))
    down = Window.partitionBy("stratum").orderBy(F.desc("bin"))
    ranked = counted.select("stratum", "bin", F.sum("n").over(down).alias("rank"), F.sum("n").over(Window.partitionBy("stratum")).alias("all"))
    # the largest p-value of a bin stands for all in it
    p = F.pow(F.lit(10.0), -(F.col("bin") - 0.5) / BINS)
    return ranked.filter(p <= F.col("rank") / F.col("all") * rate).groupBy("stratum").agg(F.min("bin").alias("least"))


FOUND = "rules array<struct<start:bigint,rank:int,end:bigint>>, tested array<struct<start:bigint,end:bigint,stratum:string,bin:int,wider:array<struct<stratum:string,bin:int>>>>"


def secrets(docs: DataFrame, columns: list[str] | None = None, text: str = "text", rate: float = RATE) -> DataFrame:
    """Spans of secrets in every whole text: row (a struct of ``columns`` of ``docs``, all if not given) and spans (start, rank, kind, end).

    Spans are ordered by start, then kind; places count code points, ends are exclusive.  Rules' spans are always there; tested ones
    are added where no rule's span and no wider tested one covers them.  A null or empty text has none; repeated rows and null ids come back as they are, and
    every copy counts as a candidate; an empty table gives no rows.  Texts are read once; rows are landed with what was found in them,
    so name only the columns that are wanted back.
    """
    carried = docs.select(*(quoted(c) for c in columns or docs.columns))
    span, mark = pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]), [("stratum", pa.string()), ("bin", pa.int32())]
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), *mark, ("wider", pa.list_(pa.struct(mark)))])

    def work(batches):
        for part in slices(batches, 0):
            ruled, tested = [], []
            for t in texts_of(part.column(0)):
                found = rule_spans(t)
                ruled.append([{"start": a, "rank": r, "end": b} for a, r, b in found])
                tested.append([dict(zip(("start", "end", "stratum", "bin", "wider"), c, strict=True)) for c in candidates(t, found)])
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(ruled, pa.list_(span)), pa.array(tested, pa.list_(run))], names=["row", "rules", "tested"])

    schema = T.StructType([T.StructField("row", carried.schema), *T.StructType.fromDDL(FOUND).fields])
    scanned = landed(docs.select(F.col(text).alias("t"), F.struct(*(quoted(c) for c in carried.columns)).alias("row")).mapInArrow(work, schema), "secrets")
    tested = scanned.select(F.explode("tested").alias("c")).select("c.stratum", "c.bin")
    accepted = {r["stratum"]: r["least"] for r in thresholds(tested, rate).collect()}  # at most encodings times bit lengths
    least = F.create_map(*[F.lit(x) for pair in accepted.items() for x in pair]) if accepted else F.lit(None).cast("map<string,int>")
    names = F.array(*[F.lit(k) for k in KINDS])

    def shaped(start: Column, rank: Column, end: Column) -> Column:
        return F.struct(start.alias("start"), rank.alias("rank"), F.element_at(names, rank + 1).alias("kind"), end.alias("end"))

    ruled = F.transform("rules", lambda s: shaped(s["start"], s["rank"], s["end"]))
    passes = lambda c: F.coalesce(c["bin"] >= F.try_element_at(least, c["stratum"]), F.lit(False))
    # of spans that lie in each other, the outermost
    outer = F.filter("tested", lambda c: passes(c) & ~F.exists(c["wider"], passes))
    random = F.transform(outer, lambda c: shaped(c["start"], F.lit(len(KINDS) - 1), c["end"]))
    return scanned.select("row", F.array_sort(F.concat(ruled, random)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@F.arrow_udf(T.StringType())
def _cut_out(texts: pa.Array, spans: pa.Array) -> pa.Array:
    def clean(text, found):
        parts, at = [], -1
        for s in found:
            if s["end"] <= at:
                continue
            if s["start"] > at:
                parts += [text[max(at, 0) : s["start"]], "[secret]"]
            at = s["end"]
        return "".join([*parts, text[at:]])

    return pa.array((None if t is None else clean(t, f) for t, f in zip(texts.to_pylist(), spans.to_pylist(), strict=True)), pa.string())


def redacted(text: Column, spans: Column) -> Column:
    """The text with ``[secret]`` in place of its spans; spans that touch or overlap become one.  Only texts with spans go to Python."""
    some = F.size(spans) > 0
    return F.when(some, _cut_out(F.when(some, text), F.when(some, spans))).otherwise(text)
