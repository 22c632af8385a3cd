"""Positions of keys in a stream: the function is the static side of a stream-static join."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.build import MphModel


def stream_lookup(stream: DataFrame, model: MphModel, key_cols: list[str] | None = None, out: str = "pos") -> DataFrame:
    """The stream with positions; stateless, so any output mode and any lateness will do. New keys need a new build."""
    if not stream.isStreaming:
        raise ValueError("not a stream")
    return model.lookup(stream, key_cols, out)
