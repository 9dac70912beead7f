"""Addresses, pages and media references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.text import strip_html
from tremorlens.plans.rows import unnest_at

# Fixed values.
AGGREGATOR_HOST = "news.google.com"
IMAGE_SUFFIXES = r"\.(jpg|jpeg|png|webp)$"
AV_SUFFIXES = r"\.(mp4|mov|webm|opus|ogg|m4a)$"
ABSENT_NAMES = ["", "None", "none", "null"]


def url_host(url: Column) -> Column:
    """Host without ``www.``, NULL when there is none."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def via_aggregator(url: Column, host: str = AGGREGATOR_HOST) -> Column:
    """The link leads to the aggregator, not to an outlet."""
    full = F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))
    return (full == host) | full.endswith("." + host)


def outlet(declared: Column, feed: Column, origin: Column, url: Column) -> Column:
    """Declared outlet; nothing is invented behind an aggregator link."""
    empty = F.lit("")
    return F.when(F.nullif(declared, empty).isNotNull(), declared).when(
        ~via_aggregator(url), F.coalesce(F.nullif(feed, empty), F.nullif(origin, empty))
    )


def title_suffix_outlet(title: Column) -> Column:
    """Outlet written after the last `` - `` of an aggregated headline."""
    return F.when(
        F.instr(title, " - ") > 0,
        F.substring(F.trim(F.element_at(F.split(title, " - "), -1)), 1, 40),
    )


def present(value: Column) -> Column:
    """NULL for an empty text or a literal that declares absence."""
    clean = F.trim(value)
    return F.when(~clean.isin(ABSENT_NAMES), clean)


def first_present(*values: Column) -> Column:
    """First of several aliases that is not empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def vendor_link(path: Column, base: str) -> Column:
    """Absolute link; a path that ends in an absence literal is no link."""
    clean = F.trim(path)
    tail = F.element_at(F.split(clean, "/"), -1)
    return F.when(
        (clean != "") & present(tail).isNotNull(),
        F.when(clean.startswith("/"), F.concat(F.lit(base), clean)).otherwise(clean),
    )


def percent_encoded(url: Column) -> Column:
    """Non-ASCII characters and blanks of an address in percent form."""
    encoded = F.array_join(
        F.transform(
            F.split(url, ""),
            lambda c: F.when(c == " ", "%20").when(c.rlike(r"[^\x00-\x7f]"), F.url_encode(c)).otherwise(c),
        ),
        "",
    )
    return F.when(url.rlike(r"[^\x21-\x7e]"), encoded).otherwise(url)


def absolute_url(href: Column, base: Column) -> Column:
    """Resolve a link against its page."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    path = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(path) > F.length(origin), F.regexp_replace(path, r"[^/]*$", "")).otherwise(
        F.concat(origin, F.lit("/"))
    )
    resolved = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(path, href))
        .otherwise(F.concat(folder, F.regexp_replace(href, r"^(\./)+", "")))
    )
    return percent_encoded(resolved)


def page_links(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    """``(key, url, link_url, link_title)``, first title per absolute address."""
    anchor = r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
    found = unnest_at(pages, [key, F.col(url).alias("_base")], F.regexp_extract_all(html, F.lit(anchor), F.lit(0)), "_pos", "_a")
    href = F.regexp_extract("_a", anchor, 1)
    text = F.trim(strip_html(F.regexp_extract("_a", anchor, 2)))
    rows = found.withColumn("_href", href).filter(~F.col("_href").rlike(r"^(#|mailto:|tel:)"))
    return (
        rows.select(
            key, "_pos", absolute_url(F.col("_href"), F.col("_base")).alias("link_url"),
            F.when(text == "", F.col("_href")).otherwise(text).alias("link_title"),
        )
        .groupBy(key, "link_url")
        .agg(F.min_by("link_title", "_pos").alias("link_title"))
    )


def feed_items(bodies: DataFrame, key: str, base: str, xml: str) -> DataFrame:
    """Items of loosely written feeds, read without an XML parser."""
    items = F.regexp_extract_all(xml, F.lit(r"(?is)<item\b.*?</item>"), F.lit(0))
    raw = unnest_at(bodies, [key, F.col(base).alias("_base")], items, "_pos", "_item")

    def between(tag: str) -> Column:
        inner = F.regexp_extract("_item", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.regexp_replace(F.regexp_replace(inner, r"^<!\[CDATA\[", ""), r"\]\]>$", "")

    def decoded(text: Column) -> Column:
        for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
            text = F.replace(text, F.lit(entity), F.lit(char))
        return text

    rows = raw.withColumn("_link", between("link")).filter(F.col("_link") != "")
    return (
        rows.select(
            key, "_pos", absolute_url(decoded(F.trim("_link")), F.col("_base")).alias("link_url"),
            F.struct(
                F.trim(decoded(strip_html(between("title")))).alias("title"),
                F.trim(F.regexp_replace(decoded(strip_html(between("description"))), r"\s+", " ")).alias("summary"),
            ).alias("_body"),
        )
        .groupBy(key, "link_url")
        .agg(F.min_by("_body", "_pos").alias("_body"))
        .select(key, "link_url", "_body.*")
    )


def is_visual_document(url: Column, content_type: Column | None = None) -> Column:
    """Image or PDF, by declared type or by suffix."""
    by_name = url.rlike(r"(?i)\.(pdf|png|jpe?g|webp)(\?|$)")
    if content_type is None:
        return by_name
    return by_name | F.coalesce(content_type.rlike(r"(?i)application/pdf|image/"), F.lit(False))


def same_host(url: Column, base: Column) -> Column:
    """Both addresses on one host, ``www.`` aside."""
    return F.coalesce(url_host(url) == url_host(base), F.lit(False))


def item_key(source: Column, search_day: Column, url: Column, dated_source: str) -> Column:
    """Dated search hits repeat by day, everything else is its address."""
    return F.when(
        source == dated_source,
        F.concat_ws(":", F.coalesce(F.nullif(search_day, F.lit("")), F.lit("sin-fecha")), url),
    ).otherwise(url)


def media_reference(local: Column, remote: Column, archive_base: str) -> Column:
    """Local copy for images, permanent archive for audio and video, else remote."""
    return (
        F.when(F.lower(local).rlike(IMAGE_SUFFIXES), F.concat(F.lit("../"), local))
        .when(
            F.lower(remote).rlike(AV_SUFFIXES),
            F.concat(F.lit(archive_base), F.element_at(F.split(remote, "/"), -1)),
        )
        .otherwise(remote)
    )


def page_audit(pages: DataFrame, key: str, html: str, limits: dict[str, int]) -> DataFrame:
    """What a reader without scripts gets, and which expectations break.

    ``limits``: ``words`` and ``rows`` are minima, ``kb`` a maximum.
    """
    body = F.col(html)
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)<(script|style).*?</\1>", " "), r"<[^>]+>", " ")
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    empty_box = r'(?s)<(tbody|ul|span|section)[^>]*\bdata-gen="[^"]+"[^>]*>\s*</\1>'
    measured = pages.select(
        key,
        words.alias("words"),
        (F.regexp_count(body, F.lit(r"<tr[ >]")) + F.regexp_count(body, F.lit("<li>"))).alias("rows"),
        (F.octet_length(body) / 1024).alias("kb"),
        F.regexp_count(body, F.lit(empty_box)).alias("empty_boxes"),
        F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(r"\{\{\w+\}\}"), F.lit(0)))).alias("markers"),
        (~body.contains('<link rel="canonical"')).alias("no_canonical"),
        body.rlike(r'<td class="num">\s*0,00\s*%?</td>').alias("false_zero"),
    )
    checks = [
        F.when(F.col("words") < limits["words"], "words"),
        F.when(F.col("rows") < limits["rows"], "rows"),
        F.when(F.col("kb") > limits["kb"], "size"),
        F.when(F.col("empty_boxes") > 0, "empty_box"),
        F.when(F.col("markers") > 0, "marker"),
        F.when(F.col("no_canonical"), "canonical"),
        F.when(F.col("false_zero"), "false_zero"),
    ]
    return measured.withColumn("findings", F.filter(F.array(*checks), lambda c: c.isNotNull()))
