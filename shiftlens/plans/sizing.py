"""Size checks that stand in front of every broadcast and every size-dependent choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def is_longer_than(df: DataFrame, n: int) -> bool:
    """True when ``df`` has more than ``n`` rows; reads no more than ``n + 1`` of them."""
    return df.limit(n + 1).count() > n


def broadcast_if_small(keys: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a narrow key table for broadcast when its rows and bytes are counted to be few.

    Beyond either bound the frame is returned unmarked, so the join shuffles both sides and adaptive
    execution splits hot partitions. No more than ``max_rows + 1`` rows are read; numbers count as 8 bytes.
    """
    wide = [f.name for f in keys.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    lists = [f.name for f in keys.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    size = F.lit(8 * len(keys.columns)).cast("bigint")
    for name in wide:
        size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    for name in lists:
        size = size + F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0))
    row = keys.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
    return F.broadcast(keys) if row["n"] <= max_rows and (row["bytes"] or 0) <= max_bytes else keys


def spread_small_scan(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal a scan with fewer splits than cores out by key, before costly per-row work.

    Only meant for a plain scan, whose split count is known without running anything. A table with
    enough splits is returned as it is, so large data is not shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, *keys) if scan.rdd.getNumPartitions() < cores else scan
