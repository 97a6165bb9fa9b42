"""Types, query parameters and fixed dimensions of word graphs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERTEX = T.StructType([T.StructField("pos", T.LongType()), T.StructField("v_id", T.LongType()), T.StructField("word", T.StringType()), T.StructField("lang", T.StringType())])
EDGE_TUPLE = T.StructType([T.StructField("pos", T.LongType()), T.StructField("e_id", T.LongType()), T.StructField("n_id", T.LongType()), T.StructField("is_p", T.BooleanType())])
RESPONSE_JSON = "vertices array<array<string>>, edges array<array<string>>"

# Language codes and their names.
LANGUAGES = {
    "es": "Spanish",
    "pt": "Portuguese",
    "fr": "French",
    "it": "Italian",
    "en": "English",
    "la": "Latin",
    "osp": "Old Spanish",
    "fro": "Old French",
    "grc": "Ancient Greek",
    "ine-pro": "Proto-Indo-European",
    "itc-pro": "Proto-Italic",
    "de": "German",
    "gmw-hgm": "High German",
    "gmw-lgm": "Low German",
    "goh": "Old High German",
    "gml": "Middle Low German",
    "gmh": "German Low German",
    "gem": "Germanic",
    "gmq": "North Germanic",
    "osx": "Old Saxon",
    "gmw-pro": "Proto-West Germanic",
    "gem-pro": "Proto-Germanic",
    "nl": "Dutch",
}
# Languages a search may start from, and may collect.
SOURCE_LANGUAGES = ("es", "pt", "fr", "it", "de", "nl")
COLLECT_LANGUAGES = ("en",)


class GraphInputError(ValueError):
    """The vertices and edges are no graph, or the parameters no query."""


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, word, lang, root, depth) and edges(source, target, pos)."""

    nodes: DataFrame
    edges: DataFrame


@dataclass(frozen=True)
class GraphQuery:
    word: str = ""
    lang: str = "es"
    collect_lang: str = "en"
    branching: int = 2
    pruning: int = 1
    do_tr: bool = True

    def checked(self) -> "GraphQuery":
        """A search as the form allows it: a word, one of the source languages, one of the languages to collect."""
        if not self.word:
            raise GraphInputError("a search needs a word")
        if self.lang not in SOURCE_LANGUAGES or self.collect_lang not in COLLECT_LANGUAGES:
            raise GraphInputError("the language isn't one to start from, or to collect")
        return self.bounded()

    def bounded(self) -> "GraphQuery":
        if not 1 <= self.branching <= 4 or not 0 <= self.pruning <= 5:
            raise GraphInputError("branching is 1 to 4 and pruning 0 to 5")
        return self
