"""News feeds and their registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremorlens.functions.dates import feed_stamp
from tremorlens.functions.text import fold, slug
from tremorlens.functions.web import url_host
from tremorlens.plans.rows import unnest

_SOURCE = "source:struct<_VALUE:string,_url:string>"
_ITEM = f"array<struct<title:string,link:string,pubDate:string,description:string,{_SOURCE}>>"
_RSS = f"struct<channel:struct<item:{_ITEM}>,item:{_ITEM}>"
_LINK = "array<struct<_href:string>>"
_ATOM = f"struct<entry:array<struct<title:string,link:{_LINK},updated:string,summary:string,source:struct<title:string,link:{_LINK}>>>>"
# Generated searches per place.
SEARCH_BASE = "https://news.google.com/rss/search"
SEARCH_TERMS = '("terremoto" OR "sismo" OR "temblor")'
SEARCH_OPTIONS = "&hl=es-CO&gl=CO&ceid=CO:es"
SEARCH_ID, SEARCH_NAME = "googlenews-municipio-", "Google News — "


def _text(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def _first_href(links: Column) -> Column:
    return F.try_element_at(links, F.lit(1))["_href"]


def feed_entries(bodies: DataFrame) -> DataFrame:
    """RSS 2.0 items and Atom entries; a malformed feed yields no rows.

    The outlet is the one the feed declares; a feed without it leaves NULL.
    """
    rest = [c for c in bodies.columns if c != "body"]
    rss = bodies.select(*rest, F.from_xml("body", _RSS, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("d"))
    items = unnest(rss, rest, F.coalesce("d.channel.item", "d.item"), "i").select(
        *rest, _text(F.col("i.title")).alias("title"), _text(F.col("i.link")).alias("url"), feed_stamp(F.col("i.pubDate")).alias("published"),
        _text(F.col("i.description")).alias("summary"), F.nullif(_text(F.col("i.source._VALUE")), F.lit("")).alias("outlet"),
        url_host(F.col("i.source._url")).alias("outlet_domain"),
    )
    atom = bodies.select(*rest, F.from_xml("body", _ATOM, {"mode": "PERMISSIVE", "ignoreNamespace": "true"}).alias("d"))
    entries = unnest(atom, rest, F.col("d.entry"), "e").select(
        *rest, _text(F.col("e.title")).alias("title"), _text(_first_href(F.col("e.link"))).alias("url"),
        F.substring(F.coalesce("e.updated", F.lit("")), 1, 19).alias("published"), _text(F.col("e.summary")).alias("summary"),
        F.nullif(_text(F.col("e.source.title")), F.lit("")).alias("outlet"), url_host(_first_href(F.col("e.source.link"))).alias("outlet_domain"),
    )
    return items.unionByName(entries).filter((F.col("url") != "") & (F.col("title") != ""))


def registered_feeds(bodies: DataFrame) -> DataFrame:
    """The community registry as rows."""
    feed = "id:string,nombre:string,tipo:string,url:string,activo:boolean,departamentos:array<string>,municipios:array<string>"
    rows = unnest(bodies, [], F.from_json("body", f"struct<feeds:array<struct<{feed}>>>")["feeds"], "f")
    return rows.select("f.*")


def place_feeds(gazetteer: DataFrame) -> DataFrame:
    """One search feed per place, except places named like a department.

    ``gazetteer``: municipality, department, term, homonym.
    """
    query = F.concat(F.lit(SEARCH_TERMS + ' "'), "term", F.lit('" "'), fold(F.col("department")), F.lit('"'))
    return gazetteer.filter(~F.col("homonym")).select(
        F.concat(F.lit(SEARCH_ID), slug(F.col("municipality"))).alias("id"), F.concat(F.lit(SEARCH_NAME), "municipality").alias("nombre"), F.lit("rss").alias("tipo"),
        F.concat(F.lit(SEARCH_BASE + "?q="), F.url_encode(query), F.lit(SEARCH_OPTIONS)).alias("url"), F.lit(True).alias("activo"),
        F.array("department").alias("departamentos"), F.array("municipality").alias("municipios"),
    )


def active_feeds(registry: DataFrame, generated: DataFrame) -> DataFrame:
    """Everything that is read by the feed job."""
    return registry.unionByName(generated).filter(F.col("activo") & (F.col("tipo") == "rss"))
