"""Imports every module that registers queries."""

from newsweave.plans import (  # noqa: F401
    graph_queries,
    hot_queries,
    model_queries,
    source_queries,
    stat_queries,
    stream_queries,
    text_queries,
)
