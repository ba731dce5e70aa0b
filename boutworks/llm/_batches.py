"""Helpers for the Arrow stages: pass-through columns and byte-bounded chunks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Text bytes handled at once inside a task; a longer document is a chunk alone.
CHUNK_BYTES = 2 << 20
#: Size of the Arrow batches that the session hands to Python.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Let the session's Arrow batches end at a size, so that long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def give_back() -> None:
    """Return freed memory to the system at the end of a task; a worker lives on through many stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def text_array(column: pa.Array) -> pa.Array:
    """The column as large_binary; null becomes the empty string."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column.cast(pa.large_binary()), b"")


def chunks(batch: pa.RecordBatch, text_col: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with at most ``limit`` bytes of text, one row at least."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col).cast(pa.large_binary())), 0)
    ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    compute: Callable[[pa.RecordBatch], list[pa.Array]],
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``df`` with the columns that ``compute`` makes from each chunk.

    Input columns whose name clashes with a new column, in any letter case, are
    replaced by the new column.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new]
    schema = T.StructType(keep + fields)
    names = [f.name for f in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, text_col, limit):
                made = compute(part)
                arrays = [part.column(n) for n in names] + made
                yield pa.RecordBatch.from_arrays(arrays, names + [f.name for f in fields])
        give_back()

    return df.mapInArrow(run, schema)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows in one array, and the offsets of the rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def binary_from(flat: np.ndarray, offsets: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A large_binary array (or large_string) over ``flat``, without copying."""
    kind = kind or pa.large_binary()
    return pa.Array.from_buffers(
        kind, len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(flat))]
    )


#: Bytes of the white space that separates words: U+0020 and U+0009 to U+000D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and the row of each."""
    word = ~IS_SPACE[flat]
    edge = np.zeros(len(flat) + 1, dtype=bool)
    if len(flat):
        edge[0] = word[0]
        edge[1:-1] = word[1:] & ~word[:-1]
        at = offsets[(offsets > 0) & (offsets < len(flat))]
        edge[at] = word[at]
    starts = np.flatnonzero(edge)
    stop = np.zeros(len(flat) + 1, dtype=bool)
    if len(flat):
        stop[-1] = word[-1]
        stop[1:-1] = word[:-1] & ~word[1:]
        stop[at] = word[at - 1]
    ends = np.flatnonzero(stop)
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spans_array(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte strings flat[start:end]; spans ascend and don't overlap."""
    keep = np.zeros(len(flat) + 1, dtype=np.int8)
    keep[starts] = 1
    np.subtract.at(keep, ends, 1)
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    return binary_from(flat[inside], np.concatenate([[0], np.cumsum(ends - starts)]))


def codes_of(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words, and the distinct words."""
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    heads = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.arange(total, dtype=np.int64) + np.repeat(starts - heads, lengths)
