"""Rows of documents picked by a table of keys (doc_id, text_hash), without moving the other texts.

A join of documents with keys that are too many to broadcast shuffles every text, though few of them
have a key. So the keys' hashes become bits of a filter of bounded size, which each task looks its
rows up in: rows whose bit isn't set have no key for sure and stay where they are, the others (those
with a key, and one in ``BITS`` or fewer of the rest) go through an exact join. More keys than the
filter is made for set more of its bits: then more rows take that join, and none is lost.

Defined cases: a null doc_id is a value like any other; rows that repeat a key share its fate; without
keys no row has one; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.session import stored

#: Bits of the filter for each key.
BITS = 16
#: Bits of one bitmap of ``bitmap_construct_agg``.
POSITIONS = 32768
#: Bitmaps that a filter has at most, of 4 KB each.
MAX_BITMAPS = 4096


def _matches(docs: DataFrame, keys: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_hash"])


def parted(docs: DataFrame, keys: DataFrame, max_bitmaps: int = MAX_BITMAPS) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows that may have a key, among them all that do, and rows that have none.
    ``keys`` (doc_id, text_hash) must be stored: it is read twice."""
    bitmaps = min(max_bitmaps, max(1, -(-keys.count() * BITS // POSITIONS)))

    def bitmap(h: Column) -> Column:
        return F.pmod(F.shiftright(h, 15), F.lit(bitmaps))

    def position(h: Column) -> Column:
        return F.pmod(h, F.lit(POSITIONS))

    key = F.xxhash64("doc_id", "text_hash")
    places = keys.select(bitmap(key).alias("bitmap"), position(key).alias("position")).repartition("bitmap")
    bits = stored(places.groupBy("bitmap").agg(F.bitmap_construct_agg("position").alias("bits")), "key-bits")
    own = F.xxhash64(docs["doc_id"], F.xxhash64(docs["text"]))
    joined = docs.join(F.broadcast(bits), bitmap(own) == bits["bitmap"], "left")
    byte = F.substring(bits["bits"], (F.shiftright(position(own), 3) + 1).cast("int"), F.lit(1))
    hit = F.coalesce(F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (position(own) % 8).cast("int")) == 1, F.lit(False))
    columns = [docs[c] for c in docs.columns]
    return joined.where(hit).select(*columns), joined.where(~hit).select(*columns)


def without(docs: DataFrame, keys: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs`` that have no key among the stored ``keys``."""
    maybe, others = parted(docs, keys, **options)
    return others.union(maybe.join(keys, _matches(maybe, keys), "left_anti"))


def with_values(docs: DataFrame, keys: DataFrame, value: str, **options: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` that may have a key, with the column ``value`` of the stored ``keys`` as
    last column (null: no key), and the rows that have none."""
    maybe, others = parted(docs, keys, **options)
    return maybe.join(keys, _matches(maybe, keys), "left").select(*(maybe[c] for c in docs.columns), keys[value]), others
