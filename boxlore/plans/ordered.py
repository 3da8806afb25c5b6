"""Order-dependent steps that stay spread out when one key holds most rows.

A window over a whole receiver would put all its rows into one task.  Here a key
is cut into segments (a time slice, a file block); each segment is handled on
its own, and one summary row per segment carries the running state across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

SEGMENT = "_segment"
#: where it is known, the number of segments of a key: a key of one segment needs no summary
SEGMENTS = "_segments"
#: Ten minutes: a receiver that writes 10,000 rows a second fills a segment with
#: six million rows, which one task sorts (and spills) without trouble.
SLICE_SECONDS = 600


def time_slice(stamp: Column, seconds: int = SLICE_SECONDS) -> Column:
    micros = F.unix_micros(stamp.cast("timestamp"))
    return F.floor(micros / F.lit(seconds * 1_000_000)).cast("bigint")


def _before(keys: list[str]):
    return W.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)


def running_count(df: DataFrame, keys: list[str], order: list[str], flag: Column, name: str) -> DataFrame:
    """Running number of flagged rows per key.  ``df`` has the column ``_segment``."""
    counted = df.withColumn("_flag", flag.cast("bigint"))
    totals = counted.groupBy(*keys, SEGMENT).agg(F.sum("_flag").alias("_n"))
    offsets = totals.select(*keys, SEGMENT, F.coalesce(F.sum("_n").over(_before(keys)), F.lit(0)).alias("_offset"))
    local = W.partitionBy(*keys, SEGMENT).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    rows = counted.withColumn(name, F.sum("_flag").over(local)).drop("_flag")
    return rows.join(offsets, [*keys, SEGMENT]).withColumn(name, F.col(name) + F.col("_offset")).drop("_offset")


def ranked_blocks(df: DataFrame, keys: list[str], order: list[str], overlap: int, size: int = 100_000) -> DataFrame:
    """Number the rows of each key (``_rank``, from 1) and deal them into blocks of
    ``size`` rows (``_block``).  Each block also gets copies (``_copy``) of the
    ``overlap`` rows before it, so frames up to that length never leave a block."""
    ranked = running_count(df, keys, order, F.lit(1), "_rank").drop(SEGMENT)
    own = F.floor((F.col("_rank") - 1) / size).cast("bigint")
    at_end = F.pmod(F.col("_rank") - 1, F.lit(size)) >= size - overlap
    homes = F.when(at_end, F.array(own, own + 1)).otherwise(F.array(own))
    return ranked.withColumn("_block", F.explode(homes)).withColumn("_copy", F.col("_block") != own)


def sum_around(df: DataFrame, keys: list[str], stamp: str, amount: Column, seconds: int, name: str,
               slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Sum of ``amount`` over the rows of the key within +-``seconds`` (inclusive).

    Rows live in time slices; amounts are summed per instant and copied into the
    neighbour slices their window reaches, so no row pairs are built.  Rows
    without a stamp get 0.
    """
    width = max(slice_seconds, seconds)
    at = F.col(stamp).cast("timestamp")
    rows = df.withColumn("_amount", amount).withColumn(SEGMENT, time_slice(F.col(stamp), width))
    timed, untimed = rows.where(F.col(stamp).isNotNull()), rows.where(F.col(stamp).isNull())
    reach = F.expr(f"INTERVAL '{seconds}' SECOND")
    spans = F.sequence(time_slice(at - reach, width), time_slice(at + reach, width))
    copies = (
        timed.where(F.col("_amount") != 0)
        .groupBy(*keys, stamp, SEGMENT).agg(F.sum("_amount").alias("_amount"))
        .withColumn("_home", F.explode(spans))
        .where(F.col("_home") != F.col(SEGMENT))
        .withColumn(SEGMENT, F.col("_home")).drop("_home")
        .withColumn("_copy", F.lit(True))
    )
    both = timed.withColumn("_copy", F.lit(False)).unionByName(copies, allowMissingColumns=True)
    by = ", ".join([*keys, SEGMENT])
    frame = f"RANGE BETWEEN INTERVAL '{seconds}' SECOND PRECEDING AND INTERVAL '{seconds}' SECOND FOLLOWING"
    summed = both.withColumn(name, F.expr(f"sum(_amount) OVER (PARTITION BY {by} ORDER BY {stamp} {frame})"))
    out = summed.where(~F.col("_copy")).drop("_copy").unionByName(
        untimed.withColumn(name, F.lit(None)), allowMissingColumns=True
    )
    return out.withColumn(name, F.coalesce(name, F.lit(0))).drop("_amount", SEGMENT)
