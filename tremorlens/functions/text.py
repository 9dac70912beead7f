"""Text normalisation and word-boundary matching."""

from __future__ import annotations

import functools
import operator
import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spanish particles kept in lower case inside a name.
LOWER_PARTICLES = ["de", "del", "la", "el", "los", "las", "y"]

# Phrases that mark rolling live coverage.
LIVEBLOG_PHRASES = (
    r"\b(en vivo|directo|live[-_\s]?news|última hora|ultima hora|minuto a minuto|liveblog)\b"
)


@functools.cache
def _accent_map() -> tuple[str, str]:
    """Precomposed letter -> base letter, and every combining mark -> nothing.

    Derived from Unicode decompositions; marks stand last, where ``translate`` deletes.
    """
    source, target, marks = [], [], []
    for point in range(0x00C0, 0x10000):
        char = chr(point)
        if unicodedata.category(char) == "Mn":
            marks.append(char)
            continue
        base = "".join(
            c for c in unicodedata.normalize("NFD", char) if unicodedata.category(c) != "Mn"
        )
        if len(base) == 1 and base != char:
            source.append(char)
            target.append(base)
    return "".join(source + marks), "".join(target)


def strip_accents(text: Column) -> Column:
    """Drop diacritics.  Pure-ASCII values skip the character map altogether."""
    mapped = F.translate(text, *_accent_map())
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(mapped)


def fold(text: Column) -> Column:
    """Accent-free lower case; NULL becomes the empty string."""
    return F.lower(strip_accents(F.coalesce(text, F.lit(""))))


def admin_name(text: Column) -> Column:
    """Comparable administrative name: folded, everything else a single space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def slug(text: Column) -> Column:
    """Folded name with runs of other characters turned into one hyphen."""
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def page_slug(text: Column) -> Column:
    """Slug for page addresses: letters without an ASCII base vanish."""
    ascii_only = F.regexp_replace(fold(text), r"[^\x00-\x7f]", "")
    return F.regexp_replace(F.regexp_replace(ascii_only, "[^a-z0-9]+", "-"), "^-|-$", "")


def title_es(text: Column) -> Column:
    """Spanish title case: particles stay lower unless they open the name."""
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def word_case(word: Column, position: Column) -> Column:
        low = F.lower(word)
        capital = F.concat(F.upper(F.substring(low, 1, 1)), low.substr(F.lit(2), F.length(low)))
        return F.when((position > 0) & low.isin(LOWER_PARTICLES), low).otherwise(capital)

    return F.array_join(F.transform(words, word_case), " ")


def word_pattern(terms: list[str]) -> str:
    """One alternation of quoted terms between Unicode word boundaries."""
    body = "|".join(re.escape(t) for t in terms)
    return rf"(?U)\b(?:{body})\b"


def mentions_word(folded: Column, terms: list[str]) -> Column:
    """True when any term occurs as whole words in already folded text."""
    return folded.rlike(word_pattern(terms))


def contains_any(text: Column, terms: list[str]) -> Column:
    """True when any term occurs anywhere; plain containment needs no pattern engine."""
    return functools.reduce(operator.or_, [text.contains(t) for t in terms])


def is_relevant(title: Column, summary: Column, keywords: list[str]) -> Column:
    """A keyword anywhere in title plus summary; no keywords keeps all."""
    if not keywords:
        return F.lit(True)
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    return contains_any(text, [k.lower() for k in keywords])


def is_liveblog(title: Column, url: Column, flag: Column | None = None) -> Column:
    """Declared flag, else live-coverage phrase on word boundaries."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(url, F.lit(""))))
    found = text.rlike(LIVEBLOG_PHRASES)
    return found if flag is None else F.coalesce(flag, F.lit(False)) | found


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


# Unicode blanks other than the ordinary one.
_BLANKS = "".join(map(chr, [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def plain_spaces(text: Column) -> Column:
    """Unicode spaces become an ordinary blank, so that ``\\s`` sees them."""
    mapped = F.translate(text, _BLANKS, " " * len(_BLANKS))
    return F.when(F.octet_length(text) == F.length(text), text).otherwise(mapped)


def strip_html(html: Column) -> Column:
    """Markup to text; scripts and styles go with their content."""
    text = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    text = F.regexp_replace(text, r"(?is)<style.*?</style>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip_links(text: Column) -> Column:
    """Drop images, addresses and media paths; keep the linked wording.

    Each pattern runs only on texts that hold the mark it needs.
    """

    def where(mark: str, value: Column, *replacements: tuple[str, str]) -> Column:
        out = value
        for pattern, replacement in replacements:
            out = F.regexp_replace(out, pattern, replacement)
        return F.when(value.contains(mark), out).otherwise(value)

    def markdown(value: Column) -> Column:
        return where("](", value, (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"))

    def address(value: Column) -> Column:
        return where("://", value, (r"https?://\S+", " "))

    def path(value: Column) -> Column:
        return where("/", value, (r"(?i)/\S*\.(?:jpe?g|png|webp|gif|svg|pdf|mp4|avif)\b", " "))

    return let(let(let(F.coalesce(text, F.lit("")), markdown), address), path)
