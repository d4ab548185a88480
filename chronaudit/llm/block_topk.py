"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers. In order of their id they are cut into ranges, the blocks; a block
holds its vectors as a forward index and, for each dimension, the largest and the smallest
value. A query's bound on a block is the sum, over dimensions, of the larger product of its
value with those two. For each query blocks are taken by descending bound, and scored
through their forward indexes until a bound falls below the k-th score so far.

Blocks lie in chunks and queries in tiles, and a tile and a chunk that meet are a cell, which
is dealt out by a shuffle. First every tile meets one chunk, which gives each query a score
that k vectors are known to reach. Then the bounds of pieces of all chunks, a few rows for each
chunk, meet the tiles; only queries whose bound on a chunk reaches their score are sent to
it, and only chunks that some query of a tile needs are sent to that tile.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronaudit.llm.common import in_files

#: Vectors in a block, in a chunk of blocks, and queries in a tile.
BLOCK, CHUNK, TILE = 64, 8192, 2048
#: Vectors of a chunk that have bounds of their own before anything is sent; chunks whose bounds one task tests.
PIECE, CHUNKS_AT_ONCE = 512, 64
#: Beyond this, sums of products in double precision might not be exact; Python's integers are.
EXACT = 2**53
LONGEST = 2**63 - 1


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Lists of integers as rows, shorter ones filled up with zeros."""
    lengths = np.asarray(pc.list_value_length(lists))
    width = int(lengths.max(initial=0))
    values = np.asarray(lists.flatten())
    if (lengths == width).all():
        return values.reshape(len(lists), width)
    full = np.zeros((len(lists), width), dtype=np.int64)
    full[np.arange(width) < lengths[:, None]] = values
    return full


def _same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    largest = [max((abs(int(x.max())), abs(int(x.min()))), default=0) if x.size else 0 for x in (a, b)]
    kind = np.float64 if largest[0] * largest[1] * max(1, width) < EXACT else object
    return a.astype(kind), b.astype(kind)


def _in_range(scores: np.ndarray) -> np.ndarray:
    """Exact integers, those beyond the range of a long at its end."""
    return scores if scores.dtype == np.float64 else np.maximum(np.minimum(scores, LONGEST), -LONGEST - 1)


class Best:
    """The k best (score, id) of each query so far, ties to the smaller id."""

    def __init__(self, queries: int, k: int, floor: np.ndarray, kind):
        self.k = k
        self.scores = np.full((queries, k), -np.inf if kind is np.float64 else -(2**200), dtype=kind)
        self.ids = np.full((queries, k), LONGEST, dtype=np.int64)
        self.floor = floor

    def bar(self) -> np.ndarray:
        """What a block's bound must reach: the k-th score, or one that k vectors are known to reach."""
        return np.maximum(self.scores[:, -1], self.floor)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """Merge scores (rows x candidates) of these queries."""
        scores = np.concatenate((self.scores[rows], scores), axis=1)
        ids = np.concatenate((self.ids[rows], ids), axis=1)
        by_id = np.argsort(ids, axis=1, kind="stable")
        scores, ids = np.take_along_axis(scores, by_id, 1), np.take_along_axis(ids, by_id, 1)
        best = np.argsort(-scores, axis=1, kind="stable")[:, : self.k]
        self.scores[rows] = np.take_along_axis(scores, best, 1)
        self.ids[rows] = np.take_along_axis(ids, best, 1)


def search(
    queries: np.ndarray, own: np.ndarray, floor: np.ndarray, docs: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK
) -> tuple[Best, int]:
    """The k best of a chunk for each query, and how many (query, block) pairs were scored.

    ``own`` has the queries' own numbers, whose rows are no candidates for them; ``floor`` a score
    that k candidates of the whole table are known to reach (or minus infinity). Candidates
    below the floor may be left out.
    """
    queries, docs = _same_width(queries, docs)
    kind = queries.dtype.type if queries.dtype != object else object
    best = Best(len(queries), k, floor.astype(queries.dtype), kind)
    starts = range(0, len(docs), block)
    high = np.stack([docs[s : s + block].max(axis=0) for s in starts])
    low = np.stack([docs[s : s + block].min(axis=0) for s in starts])
    zero = queries * 0
    bounds = _in_range(np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T)
    order = np.argsort(-bounds, axis=1, kind="stable")
    open_rows, scored = np.arange(len(queries)), 0
    for turn in range(len(starts)):
        turn_of = order[open_rows, turn]
        # a bound that equals the bar may hide a tie with a smaller id
        alive = bounds[open_rows, turn_of] >= best.bar()[open_rows]
        open_rows, turn_of = open_rows[alive], turn_of[alive]
        if not len(open_rows):
            break
        for b in np.unique(turn_of):
            rows = open_rows[turn_of == b]
            part = slice(b * block, (b + 1) * block)
            scores = _in_range(queries[rows] @ docs[part].T)
            names = np.broadcast_to(ids[part], scores.shape).copy()
            self_rows = names == own[rows][:, None]
            scores[self_rows] = -np.inf if kind is np.float64 else -(2**200)
            names[self_rows] = LONGEST
            best.add(rows, scores, names)
            scored += len(rows)
    return best, scored


def _below(x: int) -> float:
    """The score as a double, not rounded up."""
    return float(x) if abs(x) < EXACT else float(np.nextafter(float(x), -np.inf))


def _cells(k: int):
    """Search the cells of the grid: the chunk's vectors come first in each, then the tile's queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_cell(batches):
            is_query = np.asarray(rows["query"])
            if not is_query.any() or is_query.all():
                continue
            vectors, names, ids = _matrix(rows["vector"]), np.asarray(rows["row"]), np.asarray(rows["id"])
            numbers, own = names[~is_query], ids[~is_query]  # numbers ascend, as cells are sorted
            floor = np.array([-np.inf if x is None else _below(x) for x in rows["floor"].to_pylist()])[is_query]
            best, _ = search(vectors[is_query], names[is_query], floor, vectors[~is_query], names[~is_query], k)
            r, c = np.nonzero(best.ids != LONGEST)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[is_query][r]), pa.array(ids[is_query][r]), pa.array(best.ids[r, c]),
                    pa.array(own[np.searchsorted(numbers, best.ids[r, c])]),
                    pa.array([int(x) for x in best.scores[r, c]], pa.int64()),
                ],
                ["row", "query_id", "other", "vec_id", "score"])

    return run


def _by_cell(batches: Iterable[pa.RecordBatch], keys: tuple[str, str] = ("chunk", "tile")) -> Iterator[dict[str, pa.Array]]:
    """The rows of each cell; batches are in order of the cells."""

    def whole(parts: list[pa.RecordBatch]) -> dict[str, pa.Array]:
        return {c: pa.concat_arrays([x.column(c) for x in parts]) for c in parts[0].schema.names}

    last, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        places = np.array([np.asarray(batch.column(c)) for c in keys])
        cuts = np.flatnonzero((places[:, 1:] != places[:, :-1]).any(axis=0)) + 1
        for begin, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(places[:, begin])
            if key != last and held:
                yield whole(held)
                held = []
            last = key
            held.append(batch.slice(int(begin), int(end - begin)))
    if held:
        yield whole(held)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The largest and smallest value in each dimension of pieces of chunks."""
    for batch in batches:
        chunks = np.asarray(batch.column("chunk"))
        cuts = set((np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist()) | set(range(0, len(chunks), PIECE))
        bounds = sorted(cuts | {len(chunks)})
        rows = [(int(chunks[i]), _matrix(batch.column("vector").slice(i, j - i))) for i, j in zip(bounds, bounds[1:])]  # noqa: B905
        kinds = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        columns = [[c for c, _ in rows], [x.max(axis=0).tolist() for _, x in rows], [x.min(axis=0).tolist() for _, x in rows]]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["chunk", "high", "low"])


def _needed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tile and chunk the queries whose bound on a piece of the chunk reaches their score."""
    for rows in _by_cell(batches, ("part", "tile")):
        is_query = np.asarray(rows["query"])
        if not is_query.any() or is_query.all():
            continue
        keep = pa.array(is_query)
        queries, high = _same_width(_matrix(rows["vector"].filter(keep)), _matrix(rows["high"].filter(pc.invert(keep))))
        low = _same_width(queries.astype(np.int64), _matrix(rows["low"].filter(pc.invert(keep))))[1]
        if object in (queries.dtype, high.dtype, low.dtype):
            queries, high, low = (x.astype(np.int64).astype(object) for x in (queries, high, low))
        numbers, chunks = np.asarray(rows["row"].filter(keep)), np.asarray(rows["chunk"].filter(pc.invert(keep)))
        floor = np.array([-np.inf if x is None else _below(x) for x in rows["floor"].filter(keep).to_pylist()])
        zero = queries * 0
        bounds = _in_range(np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T)
        reached = bounds >= floor[:, None]
        tile, found = rows["tile"][0].as_py(), [(c, numbers[reached[:, chunks == c].any(axis=1)]) for c in np.unique(chunks)]
        found = [(int(c), x.tolist()) for c, x in found if len(x)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([tile] * len(found), pa.int32()), pa.array([c for c, _ in found], pa.int32()), pa.array([x for _, x in found], pa.list_(pa.int64()))],
            ["tile", "chunk", "rows"])


def _numbered(rows: DataFrame, per: int, name: str, order: list[str]) -> DataFrame:
    """The rows with the number of their range of about ``per`` rows, in order of these columns.

    Spark's range partitioning deals them out, in more partitions than ranges where there
    are few, so that no task sees more than its share.
    """
    n = max(1, -(-rows.count() // per))
    dealt_to = max(n, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(dealt_to, *order).sortWithinPartitions(*order)
    return dealt.withColumn(name, F.floor(F.spark_partition_id() * F.lit(n) / F.lit(dealt_to)).cast("int"))


def needed_cells(docs: DataFrame, queries: DataFrame, n_chunks: int, n_tiles: int) -> DataFrame:
    """Cells (tile, chunk) that are left to search, with the numbers of the queries that need them.

    Of a chunk only the bounds of its pieces are sent to the tiles. The first cell of each
    tile has been searched already.
    """
    tiles = F.sequence(F.lit(0), F.lit(n_tiles - 1))
    none, part = F.lit(None), F.floor(F.col("chunk") / CHUNKS_AT_ONCE).cast("int").alias("part")
    bounds = docs.mapInArrow(_pieces, "chunk int, high array<bigint>, low array<bigint>").withColumn(
        "tile", F.explode(F.filter(tiles, lambda t: t % n_chunks != F.col("chunk"))))
    left = bounds.select(
        part, "tile", F.lit(False).alias("query"), "chunk", "high", "low", none.cast("bigint").alias("row"),
        none.cast("array<bigint>").alias("vector"), none.cast("bigint").alias("floor"))
    parts = F.sequence(F.lit(0), F.lit((n_chunks - 1) // CHUNKS_AT_ONCE))
    right = queries.select(
        F.explode(parts).alias("part"), "tile", F.lit(True).alias("query"), none.cast("int").alias("chunk"),
        none.cast("array<bigint>").alias("high"), none.cast("array<bigint>").alias("low"), "row", "vector", "floor")
    cells = left.unionByName(right).repartition("part", "tile").sortWithinPartitions("part", "tile", "query")
    return cells.mapInArrow(_needed, "tile int, chunk int, rows array<bigint>")


def top_k(
    vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024,
    id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best others of each query.

    Queries are the rows whose id is divisible by ``every``; components become
    ``floor(scale * x)`` and the score is the integer inner product (beyond the range of a
    long, its end). Ties go to the smaller id. Null and empty vectors, those with null or
    not finite components, and rows without an id take no part. A vector that is shorter
    counts as filled up with zeros. Every row counts, however often it is repeated, and is a
    candidate for all queries but its own: a query's other copies are found too, and each copy
    of a query has a result of its own. An empty table gives an empty table. Other columns
    are not read. Queries are a share of the table, so the number of cells of
    the grid, not the size of one, grows with the square of it; a cell that no query needs
    costs the bounds of its pieces only.
    """
    v = F.col(vector_col)
    usable = F.size(v) > 0
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = in_files(
        vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & usable & whole)
        .select(
            F.col(id_col).cast("bigint").alias("id"),
            F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("vector")),
        "search-vectors")
    # every row has a number; in order of ids, so ties go to the smaller number
    docs = in_files(_numbered(rows, CHUNK, "chunk", ["id", "vector"]).withColumn("row", F.monotonically_increasing_id()), "search-chunks")
    asked = in_files(_numbered(docs.drop("chunk").filter(F.col("id") % every == 0), TILE, "tile", ["row"]), "search-tiles")
    n_chunks = docs.agg(F.coalesce(F.max("chunk"), F.lit(0))).first()[0] + 1
    n_tiles = asked.agg(F.coalesce(F.max("tile"), F.lit(0))).first()[0] + 1

    def meet(chunks: DataFrame, queries: DataFrame) -> DataFrame:
        """Search the cells (chunk, tile) that rows are sent to."""
        left = chunks.select("chunk", "tile", F.lit(False).alias("query"), "row", "id", "vector", F.lit(None).cast("bigint").alias("floor"))
        right = queries.select("chunk", "tile", F.lit(True).alias("query"), "row", "id", "vector", "floor")
        cells = left.unionByName(right).repartition("chunk", "tile").sortWithinPartitions("chunk", "tile", "query", "row")
        return cells.mapInArrow(_cells(k), "row bigint, query_id bigint, other bigint, vec_id bigint, score bigint")

    # a first cell for each tile gives scores that k vectors are known to reach
    own_chunk = (F.col("tile") % n_chunks).cast("int")
    tiles = F.sequence(F.lit(0), F.lit(n_tiles - 1))
    served = docs.withColumn("tile", F.explode(F.filter(tiles, lambda t: t % n_chunks == F.col("chunk"))))
    start = asked.withColumns({"chunk": own_chunk, "floor": F.lit(None).cast("bigint")})
    first = in_files(meet(served, start), "search-first")
    floors = first.groupBy("row").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    floors = floors.select("row", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    warm = in_files(asked.join(floors, "row", "left"), "search-warm")
    cells = in_files(needed_cells(docs, warm, n_chunks, n_tiles), "search-cells")
    sent = cells.select("tile", "chunk", F.explode("rows").alias("row")).join(warm.drop("tile"), "row")
    found = first.unionByName(in_files(meet(docs.join(cells.select("chunk", "tile"), "chunk"), sent), "search-rest"))
    place = Window.partitionBy("row").orderBy(F.desc("score"), "other")
    return (
        found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
