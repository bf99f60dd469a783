"""Row positions and ranks that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shiftlens.plans.scratch import written
from shiftlens.plans.sizing import broadcast_if_small

# monotonically_increasing_id() keeps the partition number above 33 bits of row number.
ROW_BITS = 33


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType)


def row_hash(df: DataFrame) -> Column:
    """A hash of the whole row, whatever the names and types of its columns; maps are hashed as JSON."""
    columns = [(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields]
    return F.xxhash64(*[F.to_json(F.struct(c.alias("v"))) if _holds_map(kind) else c for c, kind in columns])


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    name: str = "row_index",
    partitions: int | None = None,
    save: Sequence[str | Column] = ("*",),
    spread_copies: bool = False,
) -> DataFrame:
    """Add the 0-based position of every row in the total order given by ``order_by``.

    Rows are range partitioned on *all* order keys, so a hot leading key is cut by the later ones,
    sorted inside each partition and saved with their place in it. The partition sizes, one row per
    partition, are summed up and added to the place. Rows equal in every order key are told apart
    by a hash of the whole row. Nulls come first in an ascending key, as in any Spark sort.

    Select the columns you need before the call: all of them travel through the one shuffle, and the
    range bounds are sampled from them. ``save`` is what is kept of each row; it is worked out after
    the sort, so texts made from a row are neither sampled, shuffled nor sorted. ``partitions``
    defaults to the session's shuffle partitions, merged by adaptive execution.

    ``spread_copies`` also orders fully equal rows, by where they were read, so that a large group of
    copies is cut like any other. It is for scans and saved tables: a task that is run again must see
    its rows in the same order.
    """
    keys = [F.col(f"`{k}`") if isinstance(k, str) else k for k in order_by] + [row_hash(df)]
    if spread_copies:
        df = df.withColumn("__read_at", F.monotonically_increasing_id())
        keys.append(F.col("__read_at"))
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *keys)
    ordered = ranged.sortWithinPartitions(*keys)
    placed = written(ordered.select(*save, F.monotonically_increasing_id().alias("__place")), "row-index")
    part = F.shiftright("__place", ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))
    # One row per partition of the sort, so this unpartitioned window and the broadcast are bounded
    # by the partition count, not by the data.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    in_part = F.col("__place").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return (
        placed.withColumn("__part", part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, F.col("__start") + in_part)
        .drop("__place", "__part", "__start", "__read_at")
    )


def with_rank_in_group(
    df: DataFrame, groups: Sequence[str], order_by: Sequence[str | Column], name: str = "rank"
) -> DataFrame:
    """Add the 1-based position of each row inside its group.

    Equal to ``row_number() over (partition by groups order by order_by)``, but a group that holds
    a third of all rows is still spread over many tasks: the rank is the row's global position less
    the first position of its group. End ``order_by`` in a unique column.
    """
    indexed = with_row_index(df, [*groups, *order_by], "__index")
    firsts = written(indexed.groupBy(*groups).agg(F.min("__index").alias("__first")), "group-start")
    renamed = firsts.select(*[F.col(g).alias(f"__{g}") for g in groups], "__first")
    same_group = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in groups]
    return (
        indexed.join(broadcast_if_small(renamed), same_group)
        .withColumn(name, F.col("__index") - F.col("__first") + 1)
        .drop("__index", "__first", *[f"__{g}" for g in groups])
    )
