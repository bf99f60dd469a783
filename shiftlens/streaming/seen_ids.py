"""The ids that a stream has saved, kept so that a batch reads only where its own ids can be.

Every batch saves its new ids as a set, cut into buckets by the ids' hash: so many that a bucket holds about
``BUCKET_IDS``. When ``FAN`` sets of a size class have come together they are merged into one of the
next, with more buckets. A batch of n ids therefore opens at most n buckets of limited size in each of a few
sets (``FAN`` times the logarithm of the log), whatever the log has grown to; Bloom filters and
sorted ids inside a file cut that further. Each id is rewritten once per size class.

A set counts only when it is whole, and not once a larger one covers its batches, so a step that stops
anywhere is done again without harm. Only batches before the present one are merged: they are committed.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shiftlens.sources.snapshots import folder_at

#: Ids of a bucket; sets that are merged into one; bits of a bucket's number at most; ids that are looked up one by one.
BUCKET_IDS = 50_000
FAN = 8
MAX_BITS = 16
FEW = 10

_NAME = re.compile(r"tier(\d+)-(\d+)-(\d+)-bits(\d+)")


@dataclass(frozen=True, order=True)
class IdSet:
    """The ids of the batches ``first .. last``."""

    tier: int
    first: int
    last: int
    bits: int

    @property
    def name(self) -> str:
        return f"tier{self.tier}-{self.first}-{self.last}-bits{self.bits}"


def live_sets(spark: SparkSession, root: str) -> list[IdSet]:
    """The whole sets that no larger one covers, oldest first."""
    files, where = folder_at(spark, root)
    if not files.exists(where):
        return []
    found = []
    for status in files.listStatus(where):
        named = _NAME.fullmatch(status.getPath().getName())
        done, marker = folder_at(spark, f"{root}/{status.getPath().getName()}/_SUCCESS")
        if named and done.exists(marker):
            found.append(IdSet(*map(int, named.groups())))
    return sorted((s for s in found if not any(o.tier > s.tier and o.first <= s.first and s.last <= o.last for o in found)), key=lambda s: s.first)


def _bucket(key: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << bits)).cast("int")


def _save(ids: DataFrame, root: str, tier: int, first: int, last: int, bucket_ids: int) -> IdSet:
    key = ids.columns[0]
    bits = min(MAX_BITS, max(0, math.ceil(math.log2(max(1, ids.count()) / bucket_ids))))
    kept = IdSet(tier, first, last, bits)
    (
        ids.withColumn("bucket", _bucket(key, bits)).repartition("bucket").sortWithinPartitions("bucket", key)
        .write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(bucket_ids))
        .partitionBy("bucket").parquet(f"{root}/{kept.name}")
    )
    return kept


def _drop(spark: SparkSession, root: str, dropped: IdSet) -> None:
    files, where = folder_at(spark, f"{root}/{dropped.name}")
    files.delete(where, True)


def _read(spark: SparkSession, root: str, kept: IdSet, key: str) -> DataFrame:
    return spark.read.schema(f"{key} string, bucket int").parquet(f"{root}/{kept.name}")


def save_ids(ids: DataFrame, root: str, batch: int, bucket_ids: int = BUCKET_IDS) -> None:
    """Keep the ids (one string column) that a batch has saved; a batch that runs again replaces what it kept."""
    for kept in live_sets(ids.sparkSession, root):
        if kept.tier == 0 and kept.first == batch:
            _drop(ids.sparkSession, root, kept)
    _save(ids, root, 0, batch, batch, bucket_ids)


def merge_sets(spark: SparkSession, root: str, batch: int, key: str, fan: int = FAN, bucket_ids: int = BUCKET_IDS) -> None:
    """Merge the sets of each size class that has ``fan`` of them, of batches before ``batch``."""
    tier = 0
    while True:
        kept = [s for s in live_sets(spark, root) if s.last < batch]
        same = [s for s in kept if s.tier == tier][:fan]
        if len(same) == fan:
            ids = _read(spark, root, same[0], key).select(key)
            for other in same[1:]:
                ids = ids.unionByName(_read(spark, root, other, key).select(key))
            _save(ids, root, tier + 1, same[0].first, same[-1].last, bucket_ids)
            for merged in same:
                _drop(spark, root, merged)
        elif not any(s.tier > tier for s in kept):
            return
        else:
            tier += 1


def held_ids(ids: DataFrame, root: str, batch: int) -> DataFrame:
    """Of the ids in the buckets of ``ids`` (a saved frame with one string column) those that other batches have kept.

    Only the folders of these buckets are opened; what is in them beside the asked ids may be among the result.
    """
    spark, key = ids.sparkSession, ids.columns[0]
    found = spark.createDataFrame([], f"{key} string")
    few = [r[0] for r in ids.limit(FEW + 1).collect()]
    buckets: dict[int, list[int]] = {0: [0]}
    for kept in live_sets(spark, root):
        if kept.first == kept.last == batch:
            continue
        if kept.bits not in buckets:  # 2 ** MAX_BITS numbers at most
            buckets[kept.bits] = [r[0] for r in ids.select(_bucket(key, kept.bits).alias("b")).distinct().collect()]
        here = _read(spark, root, kept, key).where(F.col("bucket").isin(buckets[kept.bits]))
        if len(few) <= FEW:
            here = here.where(F.col(key).isin([x for x in few if x is not None]))
        found = found.unionByName(here.select(key))
    return found
