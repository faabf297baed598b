"""Helpers shared by the operators: column names, reliable checkpoints, row-wise Arrow steps."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python step handles at once.
SLICE_BYTES = 1 << 20


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder of the session's ``spark.checkpoint.dir``, shared by all executors.

    Where it is unset, a local session, whose executors are the driver, gets a temporary folder; any other is refused.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if folder is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def reliable(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared checkpoint folder, so that a lost executor costs nothing."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def binary(texts: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Texts as UTF-8 bytes with 64-bit offsets; null becomes the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    return pc.fill_null(texts, b"") if texts.null_count else texts


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``binary(texts)`` and the offsets of each text in them."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(first, stop) of runs of texts with about ``most`` bytes each, one text at least."""
    offsets = buffers(texts)[1]
    first = 0
    while first < len(texts):
        stop = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, stop
        first = stop


def add_columns(
    docs: DataFrame, text: str, keep: Iterable[str], fields: list[T.StructField], make: Callable[[pa.Array], list[pa.Array]]
) -> DataFrame:
    """``keep`` columns of ``docs`` and ``fields``, which ``make`` computes from whole texts, a slice at a time.

    A row stays a row: no shuffle, and no more than a slice of texts in a Python worker's structures.
    """
    keep = list(keep)
    frame = kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    if text in keep and kept.schema[text].dataType == T.StringType():
        place = keep.index(text)  # it goes to Python once
    else:
        place, own = len(keep), unused(kept, "text_to_read")
        frame = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias(own))
    names = [f.name for f in fields]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(place))
            for first, stop in slices(texts):
                made = make(texts.slice(first, stop - first))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).slice(first, stop - first) for i in range(len(keep))] + made, names=keep + names
                )

    return frame.mapInArrow(step, T.StructType([*kept.schema.fields, *fields]))
