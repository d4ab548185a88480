"""Token counts through a digest cache.

Counts are stored under the digest of the normalised text and the digest of the tokenizer.
A run joins its texts' digests to the stored counts, encodes one text for each digest that
is not there, and appends those counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.llm.common import byte_slices, in_files, read_if_there, text_or_empty
from chronaudit.llm.encoding import piece_encoder, tokenizer_digest
from chronaudit.operators.prefilter import may_be_in

CACHE_SCHEMA = "digest binary, n_tokens bigint"
SLICE_BYTES = 2 << 20
#: Digests (of 32 bytes) of missing texts that are broadcast at most.
BROADCAST_MISSES = 20_000
#: More of them make a filter of so many 64-bit words (8 MB), if they are this share of all digests at most.
FILTER_WORDS, FILTER_SHARE = 1 << 20, 0.25


def _counter(tokenizer_path: str):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_path, "counts")
        for rows in byte_slices(batches, "content", SLICE_BYTES):
            counts = encoder.counts(rows.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("digest"), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return count


def count_tokens(
    docs: DataFrame,
    cache_path: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_tokens: int = 2048,
    collapse_spaces: bool = False,
) -> DataFrame:
    """One row per input row: the id, n_bytes (UTF-8), n_tokens and over_limit.

    ``collapse_spaces`` treats texts that differ only in runs of ASCII white space, or in
    such at their ends, as one content; it is right for tokenizers that drop white space,
    and shares more of the cache. A null text counts as empty, an empty text has the
    tokens the library gives it (none, for most). Repeated ids and texts give a row each
    time; null ids are kept. Other columns are not read. Counts cover whole texts: there is
    no truncation, and special tokens are counted only where their strings stand in a text.

    Only texts that the cache lacks are encoded, one for each digest: a task hands on one
    text of a digest at most, so many copies cost no more than one. Where few are lacking,
    the others are left out before the shuffle, by a broadcast or by a Bloom filter of the
    lacking digests. An empty table gives an empty table. The cache lies in
    ``cache_path``, one folder for each tokenizer.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    content = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")) if collapse_spaces else text
    keyed = docs.select(
        F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), content.alias("content")
    ).withColumn("digest", F.unhex(F.sha2("content", 256)))
    spaces = "collapsed" if collapse_spaces else "exact"
    folder = f"{cache_path.rstrip('/')}/tokenizer={tokenizer_digest(tokenizer_path)[:32]}-{spaces}"

    keys = in_files(keyed.select("id", "n_bytes", "digest"), "text-digests")
    distinct = in_files(keys.select("digest").distinct(), "distinct-digests")
    misses = in_files(distinct.join(read_if_there(spark, folder, CACHE_SCHEMA), "digest", "left_anti"), "misses")
    texts = keyed.select("digest", "content")
    n_misses = misses.count()
    if n_misses <= BROADCAST_MISSES:  # most texts then need not be shuffled
        new = texts.join(F.broadcast(misses), "digest", "left_semi").dropDuplicates(["digest"])
    else:
        if n_misses <= FILTER_SHARE * distinct.count():  # nor here
            texts = texts.where(may_be_in(misses, [F.col("digest")], FILTER_WORDS))
        new = texts.dropDuplicates(["digest"]).join(misses, "digest", "left_semi")
    new.mapInArrow(_counter(tokenizer_path), CACHE_SCHEMA).write.mode("append").parquet(folder)

    # two runs at once may both have stored a count
    stored = spark.read.schema(CACHE_SCHEMA).parquet(folder).join(distinct, "digest", "left_semi")
    counts = in_files(stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "digest-counts")
    return (
        keys.join(counts, "digest", "left")
        .select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > max_tokens).alias("over_limit"))
    )
