"""Clicks as a stream: stateless page addresses over a streaming DataFrame of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.present import with_urls


def page_stream(clicks: DataFrame) -> DataFrame:
    """``clicks`` (word, lang, ...) with name and url; works on batch and streaming frames alike."""
    return with_urls(clicks)
