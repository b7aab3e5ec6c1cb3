"""Running numbers and running sums over an order of all rows, without a task that sees them all.

Rows are dealt to ranges of the order and written down, each with its place in its range.
What stands before a range is then the sum of the few counts of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from weftline.runtime import materialize

_PART_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below
_TIE, _AT, _PART, _FIRST = "__rk_tie", "__rk_at", "__rk_part", "__rk_first"


def _with_running(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sums over the rows so far of each partition, own row included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far = dict.fromkeys(names, 0)
        for batch in batches:
            for name in names:
                sums = np.cumsum(batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) + so_far[name]
                if len(sums):
                    so_far[name] = int(sums[-1])
                batch = batch.append_column(f"__rk_sum_{name}", pa.array(sums))
            yield batch

    fields = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`__rk_sum_{n}` long" for n in names])
    return df.mapInArrow(run, fields)


def running(df: DataFrame, order: Sequence[Column], group: Sequence[str] = (), sums: Sequence[str] = (), rank: str = "rank", partitions: int | None = None) -> DataFrame:
    """df with `rank` (from 1, in the given order within each group) and, for each whole-number
    column of `sums`, `before_<name>`: its sum over the rows of the group that come before.

    One shuffle by range and one by group and range of counts; no window over the rows. A range holds a share of all rows
    even where one group or one value of the order has most of them: ties go by a number
    that each row gets first, so equal rows are parted too. Null groups are a group; null
    values of `sums` count 0; order says where its nulls go. An empty table gives an empty result.
    Names that begin with `__rk_` are kept for this function.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = [F.col(c).asc_nulls_first() for c in group]
    dealt = df.withColumn(_TIE, F.monotonically_increasing_id()).repartitionByRange(n, *keys, *order, F.col(_TIE)).sortWithinPartitions(*keys, *order, F.col(_TIE))
    if sums:
        dealt = _with_running(dealt, sums)
    at = F.monotonically_increasing_id()
    rows = materialize(dealt.drop(_TIE).withColumn(_AT, at), "ranges").withColumn(_PART, F.shiftright(_AT, _PART_BITS))
    first = {f"__rk_from_{c}": F.min(F.col(f"__rk_sum_{c}") - F.coalesce(F.col(c), F.lit(0))) for c in sums}
    ranges = rows.groupBy(*group, _PART).agg(F.min(_AT).alias(_FIRST), F.count("*").alias("__rk_n"), *[x.alias(k) for k, x in first.items()], *[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"__rk_all_{c}") for c in sums])
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)  # a row per range, not per row
    offset = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    ranges = ranges.select(*group, _PART, (offset("__rk_n") - F.col(_FIRST)).alias("__rk_n"), *[(offset(f"__rk_all_{c}") - F.col(f"__rk_from_{c}")).alias(f"__rk_off_{c}") for c in sums])
    other = {c: f"__rk_g{i}" for i, c in enumerate([*group, _PART])}
    ranges = ranges.withColumnsRenamed(other)
    joined = rows.join(ranges if group else F.broadcast(ranges), [F.col(c).eqNullSafe(F.col(o)) for c, o in other.items()])  # without groups: a row per range
    before = [(F.col(f"__rk_sum_{c}") - F.coalesce(F.col(c), F.lit(0)) + F.col(f"__rk_off_{c}")).cast("long").alias(f"before_{c}") for c in sums]
    return joined.select(*df.columns, (F.col(_AT) + F.col("__rk_n") + 1).cast("long").alias(rank), *before)
