"""Exact top-k search against all scores."""

import math

import duckdb
import numpy as np
import pytest
from compare import compare
from odd_rows import clashing

from chronaudit.llm import block_topk, queries


def brute(rows, k, every, scale=1024):
    usable = [
        (i, tuple(math.floor(scale * x) for x in v))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for at, (q, a) in enumerate(usable):
        if q % every:
            continue
        exact = ((sum(x * y for x, y in zip(a, b)), i) for j, (i, b) in enumerate(usable) if j != at)  # noqa: B905
        scores = sorted((-max(-(2**63), min(2**63 - 1, s)), i) for s, i in exact)
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def rows_of(seed, n, dim):
    draw = np.random.default_rng(seed)
    rows = [(int(i), np.float32(draw.normal(size=dim) * draw.choice([0.1, 1, 3])).tolist()) for i in range(n)]
    rows += [(n + i, rows[i % 7][1]) for i in range(40)]  # ties
    rows += [(10, rows[10][1])] * 12 + [(10, rows[11][1]), (20, rows[20][1])]  # copies, and another vector under an id
    rows += [(3, rows[3][1]), (None, rows[0][1]), (5000, None), (5100, []), (5200, [None] * dim), (5300, [math.nan] * dim),
             (5400, [-math.inf] + [0.0] * (dim - 1)), (5500, [1.5, -2.5]), (5600, [0.0] * dim), (-10, rows[5][1])]
    return rows


@pytest.mark.parametrize("block,chunk,tile", [(64, 8192, 2048), (4, 40, 7), (8, 100, 1000)])
def test_top_k(spark, monkeypatch, block, chunk, tile):
    monkeypatch.setattr(block_topk, "CHUNK", chunk)
    monkeypatch.setattr(block_topk, "TILE", tile)
    monkeypatch.setattr(block_topk.search, "__defaults__", (block,))
    rows = rows_of(1, 300, 12)
    table = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"))
    found = block_topk.top_k(table, k=10, every=10)
    assert found.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, found.collect())) == brute(rows, 10, 10)


def test_repeated_rows_are_candidates(spark):
    """Every row but the query's own."""
    rows = [(100, [1.0]), (100, [1.0]), (1, [1.0]), (1, [1.0]), (2, [0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = sorted(map(tuple, block_topk.top_k(table).collect()))
    assert found == brute(rows, 10, 100) and len(found) == 8
    assert [r[2] for r in found[::2]] == [1, 1, 100, 2]
    db = duckdb.connect()
    db.register("embeddings", table.toArrow())
    assert compare(block_topk.top_k(table), db, queries.SQL_TOP_K) == []


def test_few_and_no_rows(spark):
    rows = [(100, [1.0, 2.0]), (1, [0.5, 0.5])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert sorted(map(tuple, block_topk.top_k(table).collect())) == brute(rows, 10, 100)
    assert block_topk.top_k(table.limit(0)).collect() == []
    assert block_topk.top_k(table.filter("vec_id = 1")).collect() == []


def test_sums_too_long_for_doubles(spark):
    rows = [(0, [3e5, 1.0, -7e5]), (1, [2e6, 0.001, 5e5]), (2, [2e6, 0.002, 5e5]), (3, [-1e9, 1e9, 4e8])]
    table = spark.createDataFrame([(i, [x * 100 for x in v]) for i, v in rows], "vec_id bigint, embedding array<double>")
    wanted = brute([(i, [x * 100 for x in v]) for i, v in rows], 10, 100)
    assert sorted(map(tuple, block_topk.top_k(table).collect())) == wanted


def test_blocks_are_passed_over():
    """Where blocks differ, few are scored, and the result is that of scoring all."""
    draw = np.random.default_rng(3)
    centres = np.abs(draw.normal(size=(40, 16))) * 1000 * (np.arange(40)[:, None] % 7)
    docs = (np.repeat(centres, 64, axis=0) + draw.normal(size=(2560, 16))).astype(np.int64)
    queries = np.abs(draw.normal(size=(5, 16)) * 100).astype(np.int64)
    floor = np.full(5, -np.inf)
    best, scored = block_topk.search(queries, np.full(5, -1), floor, docs, np.arange(2560), 10)
    assert scored < 5 * 40 / 2
    scores = queries @ docs.T
    for q in range(5):
        order = np.lexsort((np.arange(2560), -scores[q]))[:10]
        assert best.ids[q].tolist() == order.tolist()


def clustered(n, dim):
    """Vectors of about unit length, whose neighbours by id are near each other, a few hundred of each cluster."""
    draw = np.random.default_rng(9)
    centres = draw.normal(size=(n // 200, dim))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return (np.repeat(centres, 200, axis=0) + 0.01 * draw.normal(size=(n // 200 * 200, dim))).astype(np.float32)


def test_chunks_that_no_query_needs_are_not_sent(spark, monkeypatch, capsys):
    """On clustered data few of the cells of 20 tiles are sent, and the result is that of all scores."""
    monkeypatch.setattr(block_topk, "CHUNK", 400)
    monkeypatch.setattr(block_topk, "TILE", 20)
    monkeypatch.setattr(block_topk, "PIECE", 100)
    monkeypatch.setattr(block_topk, "CHUNKS_AT_ONCE", 3)
    seen, plain = [], block_topk.needed_cells

    def kept(docs, queries, n_chunks, n_tiles):
        cells = plain(docs, queries, n_chunks, n_tiles)
        seen.append((cells.selectExpr("tile", "chunk", "size(rows) as n").collect(), n_chunks, n_tiles))
        return cells

    monkeypatch.setattr(block_topk, "needed_cells", kept)
    x = clustered(8000, 32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    found = sorted(map(tuple, block_topk.top_k(table, k=5, every=20).collect()))
    cells, n_chunks, n_tiles = seen[0]
    assert n_tiles >= 20 and n_chunks >= 20
    assert all(r["chunk"] != r["tile"] % n_chunks for r in cells)
    # a cell holds a chunk: the vectors sent are fewer than four tables, of the twenty and more that all cells would be
    assert len(cells) + n_tiles < 4 * n_chunks
    scores = np.floor(1024 * x.astype(np.float64))
    wanted = []
    for q in range(0, 8000, 20):
        own = scores @ scores[q]
        own[q] = -np.inf
        order = np.lexsort((np.arange(8000), -own))[:5]
        wanted += [(q, rank, int(i), int(own[i])) for rank, i in enumerate(order, 1)]
    assert found == sorted(wanted)
