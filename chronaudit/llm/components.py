"""Connected components of a graph given by its links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronaudit.llm.common import in_files


def _least_neighbours(links: DataFrame) -> DataFrame:
    """For each node u the least of itself and its neighbours v, in files.

    Being read from files it is dealt out anew for the join with the links, whose other side
    may then be split where one node has very many links.
    """
    return in_files(links.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least")), "least")


def components(links: DataFrame) -> DataFrame:
    """One row for each node that has a link: ``node`` and ``root``, the least node it reaches.

    ``links`` has two columns of one orderable type; nulls and links of a node to itself are
    left out, and direction and repeats do not matter. No links give no rows. Each round
    joins links to minima of two columns and writes the links that remain; rounds grow with
    the logarithm of the longest path. Only a count and a checksum reach the driver.
    """
    a, b = links.columns
    one_way = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).dropna().filter("u > v").distinct()
    links, seen = in_files(one_way, "links"), None
    while True:
        state = links.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        # every node hands its larger neighbours to the least of its neighbourhood
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least_neighbours(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        links = in_files(large.filter("u > v").distinct(), "links")
        # every node hands itself and its smaller neighbours to the least of them
        least = _least_neighbours(links)
        small = links.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = small.unionByName(least.select("u", F.col("least").alias("v")))
        links = in_files(small.filter("u > v").distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
