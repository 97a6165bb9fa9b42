"""Presentation columns: labels, colours, page addresses; parameter parsing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.responses import languages

# Page addresses and colours.
PAGES = "https://en.wiktionary.org/wiki/"
RECONSTRUCTION = "https://en.wiktionary.org/wiki/Reconstruction:"
ROOT_COLOUR, COLLECT_COLOUR, OTHER_COLOUR = "red", "lightgreen", "lightblue"


def label(word: Column, lang: Column) -> Column:
    return F.format_string("%s (%s)", word, lang)


def colour(root: Column, lang: Column) -> Column:
    """The root's rule is the later one and wins; the language's is fixed to English."""
    return F.when(root, ROOT_COLOUR).when(lang == "en", COLLECT_COLOUR).otherwise(OTHER_COLOUR)


def page_url(word: Column, name: Column) -> Column:
    """Reconstructed words have pages of their own; others an anchor for their language. Null for an unknown language."""
    proto = F.concat(F.lit(RECONSTRUCTION), name, F.lit("/"), word)
    return F.when(F.contains(name, F.lit("Proto")), proto).otherwise(F.concat(F.lit(PAGES), word, F.lit("#"), name))


def with_urls(nodes: DataFrame) -> DataFrame:
    """``nodes`` with name and url; the language dimension has a fixed 23 rows."""
    names = F.broadcast(languages(nodes.sparkSession))
    return nodes.join(names, nodes["lang"] == names["code"], "left").drop("code").withColumn("url", page_url(F.col("word"), F.col("name")))


def url_changes(clicks: DataFrame, order: str, user: str, url: str = "url") -> DataFrame:
    """Clicks whose url differs from the one before, for each user."""
    before = F.lag(url).over(Window.partitionBy(user).orderBy(order))
    return clicks.where(F.col(url).isNotNull()).withColumn("before", before).where(~F.col(url).eqNullSafe(F.col("before"))).drop("before")


def elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges in one table, told apart by ``kind``."""
    n = nodes.select(F.lit("node").alias("kind"), "id", "label", "word", "lang", "root", "depth")
    e = edges.select(F.lit("edge").alias("kind"), "source", "target")
    return n.unionByName(e, allowMissingColumns=True)


def parse_number(text: Column) -> Column:
    """A number field as a double: null and blank are 0, decimals and exponents count, hexadecimal whole numbers too; all else is NaN."""
    raw = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    hexadecimal = F.conv(F.substring(raw, 3, 16), 16, 10).cast("double")
    decimal = F.rlike(raw, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"))
    value = F.when(raw == "", F.lit(0.0)).when(decimal, raw.try_cast("double")).when(F.rlike(raw, F.lit("^0[xX][0-9a-fA-F]{1,16}$")), hexadecimal)
    return value.otherwise(F.lit(float("nan")))


def refetch_needed(requested: Column, fetched: Column) -> Column:
    return F.coalesce(fetched.isNotNull() & (requested > fetched), F.lit(False))


def search_enabled(word: Column, loading: Column) -> Column:
    return ~loading & (F.coalesce(word, F.lit("")) != "")


def proxy_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^/api", "")
