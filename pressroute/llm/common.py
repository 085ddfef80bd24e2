"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from pressroute.session import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage (a lost executor repeats only what follows), gives the planner measured
    sizes, and makes every later join start from a plain shuffle, which adaptive execution
    can split when a key is hot.
    """
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


class RecentCache(dict):
    """What a worker has worked out lately, by key, in about ``most`` bytes.

    Entries come in two halves; when the younger is full it becomes the older, which is dropped. What is asked
    for again moves to the younger half, so frequent keys stay.
    """

    #: What an entry takes beside its key and value.
    ENTRY = 100

    def __init__(self, work: Callable, most: int):
        super().__init__()
        self.work, self.half, self.held, self.older = work, most // 2, 0, {}

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.work(key)
        size = self.ENTRY + sys.getsizeof(key) + sys.getsizeof(found)
        if size * 64 > self.half:  # a few large entries must not push out all others
            return found
        if self.held + size > self.half:
            self.older = dict(self)
            self.clear()
            self.held = 0
        self[key] = found
        self.held += size
        return found

    def forget(self) -> None:
        self.clear()
        self.older, self.held = {}, 0


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else unchanged. Texts of ASCII alone take the faster ``lower``, which does the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def alnum_words(text: Column) -> Column:
    """Words of digits, letters and anything beyond ASCII, A-Z in lower case; empty for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def count_alnum_words(text: Column) -> Column:
    """How many words ``alnum_words`` gives, without changing their case."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), "")).cast("long")


def once(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once a row, even where ``use`` has it inside a loop."""
    return F.transform(F.array(value), use)[0]


def train_bucket(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5: the contract's fold. A null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


#: Bits of a key map: 256 rows of 4 KB, so its broadcast is 1 MB at any input size.
MAP_BITS = 1 << 23


def _bit_number(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS)) + 1


def key_map(df: DataFrame, keys: list[str], purpose: str) -> DataFrame:
    """Bitmap of the hashes of a table's keys, written out: ``bucket, bits``, at most MAP_BITS / 32768 rows."""
    number = _bit_number(keys)
    return stage(df.groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")), purpose)


def with_key_flag(df: DataFrame, mapped: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """The rows with ``flag``: false only if the row's keys are not in the map. A full map flags more rows than need be."""
    number = _bit_number(keys)
    probed = df.withColumns({"__bucket": F.bitmap_bucket_number(number), "__bit": F.bitmap_bit_position(number)}).join(
        F.broadcast(mapped.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))), "__bucket", "left")
    byte = F.conv(F.hex(F.substring("__bits", (F.col("__bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("__bit") % 8).cast("int"))) != 0
    return probed.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop("__bucket", "__bit", "__bits")


def dense_index(df: DataFrame, rows: int, within: list[str], order: list[str], name: str, bucket_rows: int = 100_000) -> DataFrame:
    """The rows numbered from 0 without gaps inside ``within``, in buckets of a hash of ``order``.

    A window numbers the rows of a bucket; the buckets' sizes, added up, give where each begins. The
    number of buckets follows ``rows``, so no task holds more than a bucket (and copies of one row).
    The hash takes in ``name``, so that rows dealt out by one numbering are dealt anew by the next.
    Read the input from a table: it is used twice, and its rows must be the same both times.
    """
    buckets = max(16, -(-rows // bucket_rows))
    dealt = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(name), *order), F.lit(buckets)))
    before = Window.partitionBy(*within).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*within, "__bucket").agg(F.count(F.lit(1)).alias("__n")).select(
        *within, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy(*within, "__bucket").orderBy(F.xxhash64(*order), *order))
    return dealt.withColumn("__place", place).join(starts, [*within, "__bucket"]).withColumn(
        name, F.col("__from") + F.col("__place") - 1).drop("__bucket", "__from", "__place")
