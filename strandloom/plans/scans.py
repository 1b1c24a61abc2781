"""Running totals over a whole ordered table, or within the rows of each key, without a window that holds a key's rows in one task.

Rows are range-partitioned and sorted by the order; each part sums up for itself as a stream, and what the
parts before it add is worked out from one summary row a part. So a key with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def parts_of(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sorted_parts(df: DataFrame, order: list[Column | str]) -> DataFrame:
    return df.repartitionByRange(parts_of(df), *order).sortWithinPartitions(*order)


def running(df: DataFrame, order: list[Column | str], keep: list[str], adds: tuple[str, ...] = (), xors: tuple[str, ...] = (), key: str | None = None) -> DataFrame:
    """The columns of ``keep``, and for each column c of adds and xors c_to: the sum (xor) over the rows up to and with this one.

    All of them are bigint without nulls. With a key (a bigint without nulls, one of keep, and the first of the order) totals begin anew at each key.
    The result is a written table.
    """
    own = [*adds, *xors]
    sent = sorted_parts(df, order).select(*keep, *(c for c in own if c not in keep))
    names = [*keep, *(f"{c}_to" for c in own)]
    kinds = {f.name: f.dataType.simpleString() for f in sent.schema}
    ddl = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"`{c}_to` bigint" for c in own), "_part int", "_at bigint", "_head boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, last, head, totals = TaskContext.get().partitionId(), 0, None, True, [0] * len(own)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            k = batch.column(key).to_numpy() if key else np.zeros(n, np.int64)
            new = np.concatenate(([last is None or k[0] != last], k[1:] != k[:-1]))
            starts = np.flatnonzero(new)
            heads = np.zeros(n, bool)
            if head:
                later = starts[starts > 0] if not seen else starts
                heads[: later[0] if len(later) else n] = True
                head = not len(later)
            outs = []
            for i, c in enumerate(own):
                x = batch.column(c).to_numpy()
                before = np.int64(totals[i])
                with np.errstate(over="ignore"):
                    if c in adds:
                        sums = np.cumsum(x)
                        base = _since(new, sums - x, -before)
                        outs.append(sums - base)
                    else:
                        sums = np.bitwise_xor.accumulate(x)
                        base = _since(new, sums ^ x, before)
                        outs.append(sums ^ base)
                totals[i] = int(outs[-1][-1])
            last = k[-1]
            columns = [batch.column(c) for c in keep] + [pa.array(o, pa.int64()) for o in outs]
            columns += [pa.array(np.full(n, part, np.int32)), pa.array(np.arange(seen, seen + n)), pa.array(heads)]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_part", "_at", "_head"])

    local = cut(sent.mapInArrow(run, ddl))
    group = F.col(key) if key else F.lit(0).cast("bigint")
    seen = F.struct(group.alias("k"), *(F.col(f"{c}_to").alias(c) for c in own))
    # one row a part: the totals of its last key, and of its first
    found = local.groupBy("_part").agg(F.max_by(seen, "_at").alias("last"), F.max_by(seen, F.when(F.col("_head"), F.col("_at"))).alias("first")).collect()
    carried, carry, before = [], [0] * len(own), None
    for r in sorted(found, key=lambda r: r["_part"]):
        carry = carry if before == r["first"]["k"] else [0] * len(own)
        carried.append((r["_part"], *carry))
        whole = [_wrap(a + b) if c in adds else a ^ b for c, a, b in zip(own, carry, r["first"][1:], strict=True)]
        before, carry = r["last"]["k"], whole if r["first"]["k"] == r["last"]["k"] else list(r["last"][1:])
    starts = df.sparkSession.createDataFrame(carried, ", ".join(["_part int", *(f"`_before_{c}` bigint" for c in own)]))
    mine = lambda c: F.when(F.col("_head"), F.col(f"_before_{c}")).otherwise(F.lit(0))
    total = lambda c: F.col(f"{c}_to") + mine(c) if c in adds else F.col(f"{c}_to").bitwiseXOR(mine(c))
    return local.join(F.broadcast(starts), "_part").select(*keep, *(total(c).alias(f"{c}_to") for c in own))


def _wrap(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _since(new: np.ndarray, before: np.ndarray, first: np.int64) -> np.ndarray:
    """For each row what the total was before its key's first row; ``first`` for rows of the key that goes on from earlier batches."""
    at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
    return np.where(at < 0, first, before[np.maximum(at, 0)])

