"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldscope.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text column (null stays null), so that no Python string is built."""
    return text.cast("binary")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(raw: bytes | None, lower: bool = False) -> list[bytes]:
    """Maximal runs of bytes outside space and 0x09-0x0D; ``lower`` maps A-Z only."""
    if raw is None:
        return []
    return (raw.lower() if lower else raw).split()


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and outlives executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows from an iterator of tuples."""
    buffer: list[tuple] = []
    for row in rows:
        buffer.append(row)
        if len(buffer) >= size:
            yield _batch(buffer, schema)
            buffer = []
    if buffer:
        yield _batch(buffer, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
