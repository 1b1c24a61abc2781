"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut, release, shared_dir

__all__ = ["arrow_ddl", "cut", "documents", "filter_rows", "fold", "held_out", "map_rows", "release", "shared_dir"]

#: Rows with this remainder of crc32(doc_id) mod 4 are never learned from.
HELD_OUT_FOLD = 2
#: Rows that a worker turns to Python values at once.
PORTION = 256


def fold(doc_id: str = "doc_id"):
    """crc32 of the id's decimal text, mod 4."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(fold(doc_id) == HELD_OUT_FOLD, F.lit(False))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_rows(df: DataFrame, columns: list[str], schema: pa.Schema, make: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """Row-wise Arrow map over the named columns only (the scan is pruned to them).

    ``make`` runs once a task and returns a function from the columns' values to
    one output tuple; whatever is costly to build lives in its closure.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for at in range(0, batch.num_rows, PORTION):
                part = batch.slice(at, PORTION)
                rows = [one(*x) for x in zip(*(part.column(i).to_pylist() for i in range(part.num_columns)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return df.select(*columns).mapInArrow(run, arrow_ddl(schema))


def arrow_ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "bigint", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {names[f.type]}" for f in schema)


def filter_rows(df: DataFrame, column: str, make: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows, all columns as they are, for which the function of the column holds. No shuffle; only that column goes to Python, in portions."""

    @F.arrow_udf("boolean")
    def holds(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = make()
        for array in arrays:
            yield pa.array([one(x) for at in range(0, len(array), PORTION) for x in array.slice(at, PORTION).to_pylist()], pa.bool_())

    return df.where(holds(F.col(column)))
