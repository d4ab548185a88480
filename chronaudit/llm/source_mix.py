"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Every source's target is its weight times a common level, but no more than ``max_epochs``
times its size. The level is found by clamping: sources above their cap are set to it, and
what they leave is dealt to the others by weight, until none is above. A source then takes
all its documents a whole number of times, and a seeded part of them once more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronaudit.llm.common import in_files

#: Bins of the seeded order in which a source's documents are taken once more; the hexadecimal
#: digits of a digest that they are named by.
BIN_DIGITS = 3


def count_words(text: F.Column) -> F.Column:
    """Words between ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """The sources with a column ``weight``: the weights in turn, by code point, null last.

    Sources are dealt out by ranges and numbered within each; a range's offset is the
    number of sources in those before it, of which there is one row for each range.
    """
    order = F.col("source").asc_nulls_last()
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = in_files(sources.repartitionByRange(parts, order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    values = F.array(*[F.lit(float(x)) for x in weights])
    return (
        dealt.withColumn("place", place).join(offsets, "part")
        .withColumn("weight", F.element_at(values, ((F.col("offset") + F.col("place")) % len(weights) + 1).cast("int")))
        .drop("part", "place", "offset")
    )


def water_fill(sources: DataFrame, max_epochs: float, total: float | None = None) -> DataFrame:
    """The sources (source, source_size, weight) with their targets.

    Weights must not be negative; sources of weight or size zero have the target zero. The
    targets sum up to ``total`` (all sizes, if not given), or less where every source is at
    its cap. Each round clamps a source or ends; what passes through the driver is sums.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    if total is None:
        total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    clamped, n_clamped, level = F.lit(False), -1, 0.0
    while True:
        sums = sources.agg(
            F.coalesce(F.sum(F.when(clamped, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0.0)).alias("weight"),
            F.count_if(clamped).alias("n"),
        ).first()
        if sums["n"] == n_clamped:
            break
        n_clamped = sums["n"]
        if sums["weight"] <= 0:  # every source that has a weight is at its cap
            break
        level = (total - sums["held"]) / sums["weight"]
        clamped = F.col("weight") * F.lit(level) > cap
    return sources.withColumn("target", F.when(clamped, cap).otherwise(F.col("weight") * F.lit(level)))


def _same() -> F.Column:
    return F.col("a.source").eqNullSafe(F.col("b.source"))


def _seeded(id_col: F.Column, text: F.Column, seed: int) -> F.Column:
    """A row's place in the seeded order: only rows of one id and text share it."""
    known = F.coalesce(id_col.cast("string"), F.lit(""))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), known, F.md5(F.coalesce(text, F.lit("")))))


def _plan(sized: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """For each source its size and target, how often it takes all, and up to which draw once more."""
    bins = in_files(
        sized.groupBy("source", F.substring("draw", 1, BIN_DIGITS).alias("bin")).agg(F.sum("size").alias("words")),
        "mix-bins",
    )
    totals = in_files(bins.groupBy("source").agg(F.sum("words").alias("source_size")), "mix-sources")
    filled = in_files(
        water_fill(cycled_weights(totals, weights), max_epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-targets",
    )
    # the bin in which a source reaches its quota
    running = Window.partitionBy("source").orderBy("bin")
    reached = in_files(
        bins.withColumn("before", F.sum("words").over(running) - F.col("words"))
        .alias("a").join(filled.alias("b"), _same())
        .filter((F.col("before") < F.col("quota")) & (F.col("before") + F.col("words") >= F.col("quota")))
        .select("a.source", "bin", "before", "quota"),
        "mix-reached",
    )
    # the last draw in it that is taken; rows with one draw are alike, and counted before the shuffle
    ordered = Window.partitionBy("source", "bin").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    alike = (
        sized.alias("a").join(reached.alias("b"), _same() & (F.substring("a.draw", 1, BIN_DIGITS) == F.col("b.bin")))
        .groupBy("a.source", "bin", "draw", "size", "before", "quota").agg(F.count("*").alias("n"))
    )
    room = F.col("quota") - F.col("ahead")
    fits = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).when(room >= 0, F.col("n")).otherwise(0)
    within = (
        alike.repartition("source", "bin")  # else the join would have to keep a source's rows together
        .withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(ordered), F.lit(0)))
        .withColumn("times", F.least("n", F.greatest(F.lit(0), fits)))
        .filter("times > 0")
    )
    last = within.groupBy("source").agg(F.max(F.struct("draw", "n", "times")).alias("last"))
    cut = reached.alias("a").join(last.alias("b"), _same(), "left").select(
        "a.source", "bin", F.col("last.draw").alias("last"), F.when(F.col("last.times") < F.col("last.n"), F.col("last.times")).alias("some"))
    return in_files(
        filled.alias("a").join(cut.alias("b"), _same(), "left")
        .select("a.source", "source_size", "target", "whole", "bin", "last", "some"),
        "mix-plan",
    )


def _once_more() -> F.Column:
    """Whether the mix takes a row that has draw and its source's plan once more."""
    own = F.substring("draw", 1, BIN_DIGITS)
    return F.coalesce((own < F.col("bin")) | ((own == F.col("bin")) & (F.col("draw") <= F.col("last"))), F.lit(False))


def _taken(planned: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows with ``epochs``, how often the mix takes each.

    Of alike rows at a source's cutoff just so many count as fit. They are written with the
    task they came from and numbered within it, with those of the tasks before as offset, so
    a large group of repeats is not put into one task.
    """
    epochs = F.col("whole") + _once_more().cast("int")
    if plan.filter("some is not null").isEmpty():
        return planned.withColumn("epochs", epochs)
    shared = F.col("some").isNotNull() & (F.col("draw") == F.col("last"))
    plain = planned.filter(~F.coalesce(shared, F.lit(False))).withColumn("epochs", epochs)
    alike = in_files(planned.filter(shared).withColumn("part", F.spark_partition_id()), "mix-alike")
    sources = ["source", "part"]
    ahead = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = alike.groupBy(*sources).agg(F.count("*").alias("n")).select(
        *sources, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("offset"))
    numbered = alike.withColumn("place", F.row_number().over(Window.partitionBy(*sources).orderBy("draw")))
    met = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.part") == F.col("b.part"))
    chosen = numbered.alias("a").join(offsets.alias("b"), met).select("a.*", "offset").withColumn(
        "epochs", F.col("whole") + (F.col("offset") + F.col("place") <= F.col("some")).cast("int"))
    return plain.unionByName(chosen.select(plain.columns))


def _sized(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), count_words(text).alias("size"),
        _seeded(F.col(id_col), text, seed).alias("draw"),
    )


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per input row: the id, source, size, source_size, target, epochs and taken.

    ``size`` is the number of words, ``epochs`` how often the mix takes the document whole,
    ``taken`` their product. A source takes each document ``floor(target / size)`` times,
    and documents in a seeded order once more until the next would go further beyond the
    target than it stays below: the words taken differ from the target by half a document
    at most. Null texts have size zero, a null source is a source, repeated rows and ids
    are rows of their own; of rows with one id and text some may be taken once more and others
    not. Texts count whole, however long. An empty table gives no rows. Other columns are not
    read.

    The seeded order is cut into bins by a digest. Sizes are summed by source and bin in
    partial aggregates, so a source with a third of all rows needs no sort of its rows; only
    the one bin in which it reaches its target is put in order.
    """
    sized = in_files(_sized(docs, seed, id_col, text_col, source_col), "mix-sizes")
    plan = _plan(sized, weights, max_epochs)
    planned = sized.alias("a").join(plan.alias("b"), _same()).select("a.*", "source_size", "target", "whole", "bin", "last", "some")
    return _taken(planned, plan).select(
        F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", F.col("epochs").cast("bigint").alias("epochs"),
        (F.col("size") * F.col("epochs")).cast("bigint").alias("taken"),
    )


def repeat_rows(
    docs: DataFrame,
    weights: tuple[float, ...] = (1.0, 2.0, 3.0),
    max_epochs: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The mix itself: every row as often as ``mix_sources`` says, with all its columns.

    Rows of epochs zero go, among them all of sources without words. Odd rows count as there;
    columns may have any names. Whole rows are not
    shuffled where the plan, one row per source, is small enough for Spark to broadcast.
    """
    sized = _sized(docs, seed, id_col, text_col, source_col)
    plan = _plan(in_files(sized, "mix-sizes"), weights, max_epochs)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"),
        _seeded(F.col(id_col), F.col(text_col).cast("string"), seed).alias("draw"),
    )
    planned = rows.alias("a").join(plan.alias("b"), _same()).select("a.*", "whole", "bin", "last", "some")
    taken = _taken(planned, plan).select("row", F.explode(F.array_repeat(F.lit(1), F.col("epochs").cast("int"))).alias("turn"))
    return taken.select("row.*")
