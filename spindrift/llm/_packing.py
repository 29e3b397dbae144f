"""Texts compressed before a shuffle: about half of what a shuffle's own compression leaves of prose."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import _words as W
from ._common import map_arrow


def squeezed(texts: pa.Array) -> pa.Array:
    """A string column as compressed binary; nulls stay."""
    press = zstandard.ZstdCompressor(level=3)
    return pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in texts.cast(pa.large_string())], pa.binary())


def packed(docs: DataFrame, *keys: str) -> DataFrame:
    """keys and the text of docs, compressed."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), squeezed(batch.column("text"))], names=[*keys, "text"])

    kinds = "".join(f"`{k}` {docs.schema[k].dataType.simpleString()}, " for k in keys)
    return map_arrow(docs.select(*keys, "text"), of, f"{kinds}text binary")


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, or of a compressed one; nulls as empty texts."""
    if pa.types.is_binary(column.type):
        grow = zstandard.ZstdDecompressor()
        column = pa.array([grow.decompress(t.as_buffer()) if t.is_valid else b"" for t in column], pa.large_binary())
    return W.text_bytes(column)
