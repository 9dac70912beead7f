"""Dictionary matching on word boundaries as an equi-join.

A term is found in a text only if its anchor (its longest word) is one of the
text's words, so the anchor is the join key and only multi-word or punctuated
terms need a second look.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.text import fold
from tremorlens.plans.joins import derived_join
from tremorlens.plans.rows import unnest

def words_of(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(r"(?U)\w+"), F.lit(0))


def _quoted(term: Column) -> Column:
    escaped = F.regexp_replace(term, r"([^\p{L}\p{N}_ ])", r"\\$1")
    return F.concat(F.lit(r"(?U)\b"), escaped, F.lit(r"\b"))


def prepare_terms(terms: DataFrame, term: str = "term") -> DataFrame:
    """Adds the anchor, the pattern and whether the term is one plain word."""
    words = words_of(F.col(term))
    longest = F.array_max(
        F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    )["w"]
    return (
        terms.withColumn("_anchor", longest)
        .withColumn("_plain", F.col(term) == F.col("_anchor"))
        .withColumn("_pattern", _quoted(F.col(term)))
        .filter(F.col("_anchor").isNotNull())
    )


# Bits of the mask of anchor hashes: fixed, whatever the dictionary holds.
MASK_BITS = 1 << 16


def _may_be_anchor(prepared: DataFrame) -> Callable[[Column], Column]:
    """A test that every anchor passes and few other words do while the dictionary is small.

    The hashes of the anchors set bits of a mask of fixed size, which travels in the plan; a very large dictionary fills it,
    and then all words pass.
    """
    place = F.pmod(F.xxhash64("_anchor"), F.lit(MASK_BITS)).cast("int")
    mask = [0] * (MASK_BITS // 32)
    for (bit,) in prepared.select(place).distinct().collect():  # at most MASK_BITS rows
        mask[bit // 32] |= 1 << bit % 32
    held = F.expr(f"array({', '.join(f'{m}L' for m in mask)})")

    def test(word: Column) -> Column:
        bit = F.pmod(F.xxhash64(word), F.lit(MASK_BITS)).cast("int")
        return F.getbit(F.get(held, F.shiftright(bit, 5)), bit.bitwiseAND(31)) == 1

    return test


def match_terms(
    texts: DataFrame, key: str, text: str, terms: DataFrame, term: str = "term"
) -> DataFrame:
    """``(key, <columns of terms>)`` for each term that occurs in the text, once for each line that holds it.

    ``terms`` holds folded terms of one line each.  Texts are cut into lines and those into distinct
    words; those that a mask of fixed size cannot rule out meet the anchors in one equi-join; how that runs (broadcast or shuffle, a hot word
    split) is left to adaptive execution, and no text comes back for a second join.  Terms of several
    words are looked up in the line that travels with the word.  A NULL or repeated key is just a value.
    """
    prepared = prepare_terms(terms, term)
    lines = unnest(texts, [key], F.split(fold(F.col(text)), "\n"), "_line")
    probes = unnest(lines, [key, "_line"], F.array_distinct(F.filter(words_of(F.col("_line")), _may_be_anchor(prepared))), "_anchor")
    pairs = derived_join(probes, prepared, ["_anchor"])
    spelled = F.contains(F.col("_line"), F.col(term)) & F.regexp_like("_line", F.col("_pattern"))
    return pairs.filter(F.col("_plain") | spelled).drop("_line", "_anchor", "_plain", "_pattern")


def literal_terms(spark, rows: list[tuple], schema: str) -> DataFrame:
    """A small dictionary given in code, folded on the way in."""
    return spark.createDataFrame(rows, schema).withColumn("term", fold(F.col("term")))
