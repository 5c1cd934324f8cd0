"""Feed lists and the items of landed feed documents."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import is_blank

_ITEM = "array<struct<title:string,guid:string,link:string>>"
# Items sit inside the channel in RSS 2.0 and beside it in RSS 1.0.
_FEED = f"channel struct<item:{_ITEM}>, item {_ITEM}"


def active_feeds(feeds: DataFrame) -> DataFrame:
    """The feed list without blank entries."""
    return feeds.where(~is_blank(F.col("feed_url")))


def feed_items(feeds: DataFrame) -> DataFrame:
    """One row per usable item of each ``(feed_url, xml)`` document, in document order. The link
    is the item's guid when the tag is there, even empty, otherwise its link; items whose link
    does not start with ``http`` are dropped, as are unreadable documents."""
    doc = F.from_xml("xml", _FEED, {"ignoreSurroundingSpaces": "false"})
    none = F.array().cast(_ITEM)
    # The outer form keeps Spark from parsing each document once more as a filter.
    items = feeds.select("feed_url", doc.alias("doc")).select(
        "feed_url",
        F.posexplode_outer(
            F.concat(F.coalesce("doc.channel.item", none), F.coalesce("doc.item", none))
        ).alias("pos", "item"),
    )
    return items.select(
        "feed_url", "pos", "item.title", "item.guid", "item.link",
        F.coalesce("item.guid", "item.link").alias("url"),
    ).where(F.col("url").startswith("http"))
