"""Helpers shared by the text operators: bounded batches for Python tasks, text keys, flat-array gathering."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from ctypes import CDLL

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import checkpoint_folder

#: Characters of text that a Python task works on at a time; a longer text is worked on alone.
BATCH_CHARS = 3_000_000
#: Rows and bytes in an Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python tasks; texts are long, so rows alone are no bound."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts exceed ``limit`` bytes. Every row comes once. At the end the memory that the task has freed
    goes back to the system, as the worker may wait long for its next task."""
    yield from _pieces(batches, text, limit)
    release()


def release() -> None:
    """Memory that this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def _pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0))
        start, load = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if load and load + n > limit:
                yield batch.slice(start, i - start)
                start, load = i, 0
            load += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, text: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(text)).to_pylist()]


def spans_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total, dtype=np.int64)


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from its flat values and the length of every row."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=kind))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


class Scratch:
    """Intermediate tables of one operator, written to the shared folder; ``drop`` removes them all."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written out and read again."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
