"""Which messages a table holds, without reading the table.

Beside a log table lies an index of its de-duplication keys.  ``entries`` has one row per
stored key and the batch that stored it, in folders of a bucket; a bucket belongs to a
group of receivers and a part of the hashes, so a batch of one receiver touches few
buckets and a receiver that writes a third of all rows still spreads over many.
``sketches`` has Bloom bitmaps per bucket: the keys of a batch whose two bits are not both
set are new without any look at the entries, and of the entries only the folders of the
buckets that the others fall into are read.

A batch has a name.  Entries of its own name don't count as stored, so a batch that is
repeated after a crash, even after its keys were learned, finds the same rows new again.
``learned`` lists the batches whose keys are all there; ``recover`` learns what a crash
kept from being learned.  Every batch adds a file to the buckets it touches; ``compact``
makes one sorted file of each such bucket, with its copies folded, and ``grow`` deals
everything into more buckets.  One writer at a time is assumed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from boxlore.sources import folders

#: groups of receivers, and parts of the hashes, of a new index
GROUPS, PARTS = 64, 4
#: bits of one bitmap (fixed by the bitmap functions), and bitmaps of a bucket's sketch
BITS, SLOTS = 32768, 64


@dataclass(frozen=True)
class HashIndex:
    """``keys`` are the de-duplication keys, the first of them the receiver; ``parts`` is a power of two."""

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    groups: int
    parts: int

    def _folder(self, name: str) -> str:
        return f"{self.root}/buckets={self.groups}x{self.parts}/{name}"

    def _read(self, name: str, schema: str) -> DataFrame:
        path = self._folder(name)
        return self.spark.read.schema(schema).parquet(path) if folders.filled(self.spark, path) else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """(keys, batch, bucket)"""
        fields = {"timestamp": "timestamp"}
        return self._read("entries", ", ".join(f"{k} {fields.get(k, 'string')}" for k in self.keys) + ", batch string, bucket int")

    def sketches(self) -> DataFrame:
        """(slot, bits, bucket); a slot may have several bitmaps, from several batches"""
        return self._read("sketches", "slot int, bits binary, bucket int")

    def learned(self) -> set[str]:
        """Names of the batches whose keys the index holds; one per ingest, so few next to their rows."""
        return {name.removeprefix("batch=") for name in folders.names(self.spark, f"{self.root}/learned")}

    # --- places of a key -------------------------------------------------------------

    def _bucket(self) -> Column:
        group = F.pmod(F.xxhash64(self.keys[0]), F.lit(self.groups))
        return (group * self.parts + F.pmod(F.xxhash64(*self.keys), F.lit(self.parts))).cast("int")

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Adds bucket, slot and the two bits of each key."""
        place = lambda salt, size: F.pmod(F.xxhash64(*self.keys, F.lit(salt)), F.lit(size)).cast("int")
        return rows.withColumns({"bucket": self._bucket(), "slot": place(1, SLOTS), "_bit": place(2, BITS), "_bit_2": place(3, BITS)})

    @staticmethod
    def _is_set(bits: Column, bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
        return F.getbit(byte, bit % 8) == 1

    # --- asking and learning -----------------------------------------------------------

    def maybe_stored(self, keys: DataFrame) -> DataFrame:
        """The keys that the sketches cannot rule out, with their bucket."""
        placed = self._placed(keys)
        sketch = self.sketches().select(F.col("bucket").alias("_bucket"), F.col("slot").alias("_slot"), "bits")
        set_bits = self._is_set(F.col("bits"), F.col("_bit")) & self._is_set(F.col("bits"), F.col("_bit_2"))
        here = (F.col("bucket") == F.col("_bucket")) & (F.col("slot") == F.col("_slot")) & set_bits
        return placed.join(sketch, here, "left_semi").select(*self.keys, "bucket")

    def stored(self, keys: DataFrame, batch: str) -> DataFrame:
        """Those of the distinct ``keys`` that another batch has stored."""
        maybe = self.maybe_stored(keys)
        # at most groups * parts numbers, with which the scan prunes its folders
        touched = [row.bucket for row in maybe.select("bucket").distinct().collect()]
        held = self.entries().where(F.col("bucket").isin(touched) & (F.col("batch") != batch))
        held = held.select(*[F.col(k).alias(f"_{k}") for k in self.keys], F.col("bucket").alias("_bucket"))
        same = F.col("bucket") == F.col("_bucket")
        for key in self.keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
        return maybe.join(held, same, "left_semi").select(*self.keys)

    def unseen(self, rows: DataFrame, batch: str) -> DataFrame:
        """The rows of a batch (one per key) whose key no other batch has stored."""
        known = self.stored(rows.select(*self.keys), batch).select(*[F.col(k).alias(f"_{k}") for k in self.keys])
        same = F.lit(True)
        for key in self.keys:
            same = same & F.col(key).eqNullSafe(F.col(f"_{key}"))
        return rows.join(known, same, "left_anti")

    def learn(self, rows: DataFrame, batch: str) -> None:
        """Add the keys of the rows a batch has stored, then list the batch as learned."""
        keys = rows.select(*self.keys)
        self._append(keys.withColumn("batch", F.lit(batch)), "append")
        folders.touch(self.spark, f"{self.root}/learned/batch={batch}")

    def _append(self, entries: DataFrame, mode: str) -> None:
        placed = self._placed(entries)
        writer = placed.select(*self.keys, "batch", "bucket").repartition("bucket").sortWithinPartitions("bucket", *self.keys)
        writer.write.mode(mode).partitionBy("bucket").parquet(self._folder("entries"))
        self._write_sketches(placed, mode)

    def _write_sketches(self, placed: DataFrame, mode: str) -> None:
        bits = placed.select("bucket", "slot", F.explode(F.array("_bit", "_bit_2")).alias("bit"))
        bitmaps = bits.groupBy("bucket", "slot").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits"))
        bitmaps.write.mode(mode).partitionBy("bucket").parquet(self._folder("sketches"))

    def recover(self, table: str) -> None:
        """Learn batches whose rows are in ``table`` (folders ``batch=<name>``) but whose keys are not, and remove half-written ones."""
        for name in sorted(folders.names(self.spark, table)):
            batch = name.removeprefix("batch=")
            if not name.startswith("batch=") or batch in self.learned():
                continue
            if folders.complete(self.spark, f"{table}/{name}"):
                if folders.filled(self.spark, f"{table}/{name}"):
                    self.learn(self.spark.read.parquet(f"{table}/{name}"), batch)
                else:
                    folders.touch(self.spark, f"{self.root}/learned/{name}")
            else:
                folders.remove(self.spark, f"{table}/{name}")

    # --- upkeep ------------------------------------------------------------------------

    def compact(self, files: int = 8) -> int:
        """Rewrite the buckets of ``files`` or more files as one sorted file each; returns their number.

        The new files are first written beside the index, so a crash while the old ones
        are being replaced is mended by the next call."""
        aside = self._folder("compacted")
        if not folders.complete(self.spark, aside):
            counts = folders.files_below(self.spark, self._folder("entries"))
            many = [int(name.removeprefix("bucket=")) for name, n in counts.items() if n >= files]
            if not many:
                return 0
            once = self.entries().where(F.col("bucket").isin(many)).groupBy(*self.keys, "bucket").agg(F.min("batch").alias("batch"))
            once.select(*self.keys, "batch", "bucket").write.mode("overwrite").parquet(aside)
        rows = self.spark.read.parquet(aside)
        touched = rows.select("bucket").distinct().count()
        whole = rows.repartition("bucket").sortWithinPartitions("bucket", *self.keys)
        whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._folder("entries"))
        placed = self._placed(rows.drop("bucket"))
        bits = placed.select("bucket", "slot", F.explode(F.array("_bit", "_bit_2")).alias("bit"))
        bitmaps = bits.groupBy("bucket", "slot").agg(F.bitmap_construct_agg(F.col("bit").cast("bigint")).alias("bits")).repartition("bucket")
        bitmaps.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self._folder("sketches"))
        folders.remove(self.spark, aside)
        return touched

    def grow(self) -> HashIndex:
        """The same index with twice the buckets; the old one goes once the new one is complete."""
        larger = HashIndex(self.spark, self.root, self.keys, self.groups, 2 * self.parts)
        larger._append(self.entries().groupBy(*self.keys).agg(F.min("batch").alias("batch")), "overwrite")
        folders.touch(self.spark, f"{self.root}/ready/buckets={larger.groups}x{larger.parts}")
        folders.remove(self.spark, self._folder(""))
        return larger


def open_index(spark: SparkSession, root: str, keys: list[str], groups: int = GROUPS, parts: int = PARTS) -> HashIndex:
    """The index under ``root``; ``groups`` and ``parts`` count only where there is none yet."""
    ready = [tuple(map(int, name.removeprefix("buckets=").split("x"))) for name in folders.names(spark, f"{root}/ready")]
    if not ready:
        folders.touch(spark, f"{root}/ready/buckets={groups}x{parts}")
    return HashIndex(spark, root, tuple(keys), *max(ready, default=(groups, parts)))
