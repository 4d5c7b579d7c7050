"""Keep or drop rows by a verdict about their group, whatever the group sizes are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgate.functions.columns import named
from flowgate.functions.keys import vector_key
from flowgate.operators.duplicates import LABELS, N, vector_groups
from flowgate.staging import stage

# A broadcast table of at most this many keys (a few dozen bytes each) fits every executor.
MAX_BROADCAST_KEYS = 1_000_000
# Groups that are looked up map-side instead of being shuffled; every other one is smaller than N / HOT_GROUPS.
HOT_GROUPS = 512
# A bitmap has 4 kB; so many of them are broadcast at most (64 MB).
BITMAP_BITS = 32_768
BITMAPS = 16_384
BITS_PER_KEY = 16


def keep_rows(
    rows: DataFrame,
    groups: DataFrame,
    on: str,
    keep: str,
    size: str,
    max_broadcast: int = MAX_BROADCAST_KEYS,
    hot_groups: int = HOT_GROUPS,
) -> DataFrame:
    """The rows whose group has a true verdict.

    ``rows`` and ``groups`` share the key column ``on``; ``groups`` has one row per key with a boolean
    ``keep`` and the group's row count ``size``, and covers every key of ``rows``. The smaller of the two
    verdict lists is counted first. Up to ``max_broadcast`` keys it is broadcast and the rows do not move.
    Beyond that the rows are joined on the key, except those of the largest groups: their verdicts, a fixed
    number of them, are broadcast, and their rows are spread by a salt, so no task receives a hot group.
    """
    groups = stage(groups.select(on, keep, size))
    counts = groups.agg(F.count_if(keep).alias("kept"), F.count_if(~F.col(keep)).alias("dropped")).first()
    if min(counts.kept, counts.dropped) <= max_broadcast:
        if counts.dropped <= counts.kept:
            return rows.join(F.broadcast(groups.where(~F.col(keep)).select(on)), on, "left_anti").select(*[named(c) for c in rows.columns])
        return rows.join(F.broadcast(groups.where(keep).select(on)), on, "left_semi").select(*[named(c) for c in rows.columns])

    hot = groups.orderBy(F.col(size).desc(), F.col(on)).limit(hot_groups)
    known = hot.select(on, F.col(keep).alias("_known"))
    marked = rows.join(F.broadcast(known), on, "left").where(F.col("_known").isNull() | F.col("_known"))
    spread = F.lit(1) + F.pmod(F.monotonically_increasing_id(), F.lit(4096))
    marked = marked.withColumn("_salt", F.when(F.col("_known").isNull(), F.lit(0).cast("bigint")).otherwise(spread))
    # Always 0, but not a literal: the optimizer would take a literal out of the join keys, and the salt with it.
    unsalted = F.least(F.col(size).cast("bigint"), F.lit(0).cast("bigint"))
    dropped = groups.where(~F.col(keep)).select(on, unsalted.alias("_salt"))
    return marked.join(dropped, [on, "_salt"], "left_anti").select(*[named(c) for c in rows.columns])


def drop_conflicts(df: DataFrame, features: list[str], label: str, **limits: int) -> DataFrame:
    """All rows, copies included, of the vectors that occur with one label only."""
    groups = vector_groups(df, features, label).withColumn("_keep", F.col(LABELS) == 1)
    keyed = df.withColumn("_key", vector_key(features))
    return keep_rows(keyed, groups.withColumnRenamed("key", "_key"), "_key", "_keep", N, **limits).drop("_key")


def maybe_listed(rows: DataFrame, keys: DataFrame, n: int, on: str = "_key") -> DataFrame:
    """``rows`` without those whose key's hash is not among the hashes of ``keys`` (n keys): all listed ones stay, and few others.

    Bits are some sixteen times as many as keys, so about one other row in seventeen stays, up to the size that is broadcast; beyond 130 million
    keys more of them do.
    """
    bitmaps = min(BITMAPS, max(1, -(-BITS_PER_KEY * n // BITMAP_BITS)))
    place = F.pmod(F.xxhash64(F.lit(11), F.col(on)), F.lit(bitmaps * BITMAP_BITS)) + 1
    bucket, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    made = keys.groupBy(bucket.alias("_bitmap")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    placed = rows.withColumns({"_bitmap": bucket, "_place": bit})
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = placed.join(F.broadcast(made), "_bitmap").where(F.getbit(byte, (F.col("_place") % 8).cast("int")) == 1)
    return found.select(*[named(c) for c in rows.columns])


def keep_listed(rows: DataFrame, listed: DataFrame, on: list[str], max_broadcast: int = MAX_BROADCAST_KEYS) -> DataFrame:
    """Rows whose key occurs in a stored key list; a missing value matches a missing one.

    A short list is broadcast after it has been counted. Past that bound most rows of other keys are dropped where they are by a bitmap of the
    list's hashes, at most ``BITMAPS`` bitmaps of 4 kB. Then both sides are grouped first, so that a hot key is judged once, and the verdicts go through
    ``keep_rows``.
    """
    # Equal values hash alike only in equal types.
    typed = listed.select(*[named(c).cast(rows.schema[c].dataType).alias(c) for c in on])
    keys = stage(typed.select(vector_key(on).alias("_key")).distinct())
    tagged = rows.withColumn("_key", vector_key(on))
    if keys.count() <= max_broadcast:
        return tagged.join(F.broadcast(keys), "_key", "left_semi").select(*[named(c) for c in rows.columns])
    tagged = maybe_listed(tagged, keys, keys.count())
    sizes = tagged.groupBy("_key").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.join(keys.withColumn("_listed", F.lit(True)), "_key", "left").withColumn("_keep", F.col("_listed").isNotNull())
    return keep_rows(tagged, groups, "_key", "_keep", "n", max_broadcast).drop("_key")
