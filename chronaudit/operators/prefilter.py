"""A Bloom filter of keys, made and asked by DataFrame functions.

The keys set three bits of one of ``words`` 64-bit words. Words are gathered by ``bit_or``, so
tasks hand on one row for each word at most and filters of parts merge. The whole filter is
one array, read as a scalar subquery, and its size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of a filter (512 KB); with more keys than words it lets more rows pass.
WORDS = 1 << 16
#: Tables that Spark takes to be smaller need no filters or digests: a join costs less than these.
SMALL_BYTES = 256 << 20


def is_small(df: DataFrame) -> bool:
    """Whether Spark's own estimate puts the rows below ``SMALL_BYTES``; results never depend on it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL_BYTES


def _place(cols: Sequence[Column], words: int) -> tuple[Column, Column]:
    """The word that keys fall into and their bits in it. Null is a value."""
    h = F.xxhash64(*cols)
    mask = F.lit(0).cast("long")
    for shift in (32, 40, 48):
        bit = F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(h, F.lit(words)).cast("int"), mask


def key_words(keys: DataFrame, words: int = WORDS) -> DataFrame:
    """The filter's words that are not empty: word, bits. Filters of parts merge by ``bit_or``."""
    word, mask = _place([F.col(f"`{c}`") for c in keys.columns], words)
    return keys.select(word.alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def may_be_in(keys: DataFrame, cols: Sequence[Column], words: int = WORDS) -> Column:
    """Whether the columns may be among the keys: true for all that are, and for few others.

    The columns need the types of ``keys``, in this order.
    """
    every = keys.sparkSession.range(words).select(F.col("id").cast("int").alias("word"))
    filled = every.join(key_words(keys, words), "word", "left").select("word", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    whole = filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("bits"))
    word, mask = _place(cols, words)
    return F.get(whole.scalar(), word).bitwiseAND(mask) == mask
