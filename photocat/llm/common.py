"""Small helpers the operators share: reading tables, batches of texts, size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photocat.session import cut_lineage

#: A side of a join is broadcast by hint only when it was counted and has at most so many rows of a few hundred bytes.
SMALL_ROWS = 20_000

#: Texts are handled in slices of about so many bytes, so that a batch of long texts needs no more memory than one of short ones.
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixed(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared checkpoint folder; later steps read them from there."""
    return cut_lineage(df)


def small_or_plain(df: DataFrame) -> DataFrame:
    """A broadcast hint for a table that is already computed and counted as small; else Spark decides."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows whose texts have about ``max_bytes`` bytes (one row at least). A worker lives on
    after its task, so what Arrow keeps of earlier batches is given back after each."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
            yield batch.slice(start, end - start)
            start = end
        del batch
        pa.default_memory_pool().release_unused()


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **columns) -> pa.RecordBatch:
    """The batch without ``drop`` and with further columns."""
    keep = [(n, batch.column(n)) for n in batch.schema.names if n not in drop and n not in columns]
    return pa.RecordBatch.from_arrays([c for _, c in keep] + list(columns.values()), names=[n for n, _ in keep] + list(columns))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, in whatever store it lies."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text of ASCII characters, bit by bit (for oracles)."""
    bit = "list_reduce([{}, 0, 0, 0, 0, 0, 0, 0, 0], lambda r, unused: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384 ELSE 0 END))"
    byte = bit.format("xor(c, x)")
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda t: ord(t)::BIGINT)), lambda c, x: {byte}))"
