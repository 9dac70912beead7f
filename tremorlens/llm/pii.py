"""Personal data: patterns propose spans, checksums confirm them, context words adjust their scores.  Column expressions only.

A pattern's matches and the text between them come from two expressions over the same pattern, so
that the place of each match is a running sum of lengths in code points.  Patterns start only
where a match can start and give nothing back once taken (possessive), which keeps very long runs
of digits or letters linear and off the call stack; they match what the plain forms match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,rank:int,kind:string,end:bigint,score:double>>"
#: Code points before a span in which context words count.
CONTEXT = 48
#: Matches of a kind that are gathered before they join the others of a text.
BLOCK = 128
#: Score of a span without context, and what context words add.
CHECKED, UNCHECKED, NEARBY = 0.8, 0.6, 0.2

LOCAL = "[A-Za-z0-9._%+-]"
# Kind, pattern, context words.
PATTERNS = {
    "email": (rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "mail|contact|write|address|kontakt|correo|courriel"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"\bip\b|host|server|address|login|addr"),
    "card": (r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){11,18}+(?![ -]?[0-9])", "card|visa|credit|payment|karte|tarjeta|carte"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "phone|call|tel|mobile|fax|anruf"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "iban|account|bank|konto|cuenta|compte"),
}
BASE = ("email", "ip", "card", "phone")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn checksum."""

    def weighed(x, i):
        doubled = x * (1 + i % 2)
        return F.when(doubled > 9, doubled - 9).otherwise(doubled)

    each = F.transform(F.sequence(F.length(digits), F.lit(1), F.lit(-1)), lambda p: F.substring(digits, p, F.lit(1)).cast("int"))
    return F.aggregate(F.transform(each, weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.length(plain) - 4), F.substring(plain, F.lit(1), F.lit(4)))

    def step(a, p):
        c = F.ascii(F.substring(moved, p, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(moved)), F.lit(0), step) == 1


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})(?:\.|$)){4}$"),
    "card": lambda m: luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
    "iban": mod97,
}
CHECKSUM = ("card", "iban")


def _spans(kind: str, rank: int, gaps: Column, matches: Column) -> Column:
    """Confirmed spans of one kind, from the matches and what lies between them: each step reads its gap and match, never the text again."""
    words = PATTERNS[kind][1]

    def step(state, x):
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        before = F.lower(F.right(F.concat(state["tail"], x["gap"]), F.lit(CONTEXT)))
        score = F.lit(CHECKED if kind in CHECKSUM else UNCHECKED) + F.when(before.rlike(words), NEARBY).otherwise(0.0)
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), score.alias("score"))
        tail = F.right(F.concat(state["tail"], x["gap"], x["match"]), F.lit(CONTEXT))
        return F.struct(end.alias("at"), tail.alias("tail"), F.when(VALID[kind](x["match"]), F.array_append(state["found"], span)).otherwise(state["found"]).alias("found"))

    def block(state, i):
        """One block of matches: its spans are gathered apart, so that no list grows with the text."""
        mine = [F.slice(x, i * BLOCK + 1, F.lit(BLOCK)) for x in (gaps, matches)]
        pairs = F.arrays_zip(mine[0].alias("gap"), mine[1].alias("match"))
        within = F.struct(state["at"].alias("at"), state["tail"].alias("tail"), none.alias("found"))
        # of the last block's gaps one is left over, behind the last match
        done = F.aggregate(F.filter(pairs, lambda x: x["match"].isNotNull()), within, step)
        return F.aggregate(F.array(done), state, lambda s, d: F.struct(d["at"].alias("at"), d["tail"].alias("tail"), F.array_append(s["found"], d["found"]).alias("found")))

    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<{SPAN}>").alias("found"))
    numbers = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
    return F.when(F.size(matches) > 0, F.aggregate(numbers, start, block, lambda s: F.flatten(s["found"]))).otherwise(none)


def personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data in every whole text: id and spans (start, rank, kind, end, score), by start, then kind.

    Places count code points, ends are exclusive.  A null or empty text has no spans; repeated rows and null ids come back as they are;
    other columns are not read.  No shuffle.
    """
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    none = F.array().cast("array<string>")
    # A kind's pattern runs only on texts that hold what every match holds.
    needed = {"email": F.contains("t", F.lit("@")), "phone": F.contains("t", F.lit("+"))}
    df = df.select("*", *(F.when(needed.get(k, F.lit(True)), F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, (p, _) in PATTERNS.items()))
    df = df.select("*", *(F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).otherwise(none).alias(f"g_{k}") for k, (p, _) in PATTERNS.items()))
    found = [_spans(k, r, F.col(f"g_{k}"), F.col(f"m_{k}")) for r, k in enumerate(PATTERNS)]
    return df.select(F.col("id").alias(id_column), F.array_sort(F.concat(*found)).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number(spans: Column, kind: str) -> Column:
    """How many spans are of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
