"""Documents in chunks of bounded size, each with a dictionary of the keys that occur in it.

Some results need a corpus-wide figure for every token of a text. Sending tokens through a shuffle, or all figures to every task, does
not hold at scale. Here a chunk of documents keeps its tokens as places in its own dictionary; only dictionary entries, one per
distinct key and chunk, meet the corpus-wide figures in a shuffle join and come back to their chunk. A key that stands everywhere
has one row per chunk, not one per token. A chunk holds ``CHUNK`` bytes of text and the document that goes beyond.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.session import shared_folder

CHUNK = 16_000_000

_CODEC = pa.Codec("zstd", compression_level=3)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the folder that all executors share, and read it back: lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def chunk_ids() -> Iterator[int]:
    """Ids that no other task of the stage gives. They hold once the chunks are written."""
    context = TaskContext.get()
    start = (context.partitionId() if context else 0) << 32
    while True:
        yield start
        start += 1


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Whole numbers of ``width`` bytes as compressed planes of bytes: the high ones are mostly zero."""
    planes = np.ascontiguousarray(values, dtype=f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    return len(planes).to_bytes(8, "little") + _CODEC.compress(planes, asbytes=True)


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    """The numbers again, signed."""
    raw = _CODEC.decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(f"i{width}")


def with_figures(chunks: DataFrame, figures: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Give each chunk the rows of ``figures`` (a ``chunk`` column among them) that came back to it."""
    own = figures.withColumnRenamed("chunk", "_chunk").groupBy("_chunk")
    return chunks.groupBy("chunk").cogroup(own).applyInArrow(run, schema)


def joined(entries: DataFrame, figures: DataFrame, key: str | list[str], how: str = "inner") -> DataFrame:
    """Dictionary entries meet one row of figures per key, by shuffle; a key's entries may be split between tasks."""
    return entries.join(figures.hint("merge"), key, how)


def total(df: DataFrame, *columns: str) -> list[int]:
    """Sums of columns, 0 for an empty table, and the number of rows."""
    row = df.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in columns), F.count("*")).first()
    return [int(x) for x in row]
