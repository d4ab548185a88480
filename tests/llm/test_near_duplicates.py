"""Components, SimHash and cross-polytope near-duplicates against brute force."""

import math
import random

import numpy as np
import pytest
import xxhash
from odd_rows import clashing

from chronaudit.llm import cross_polytope, simhash
from chronaudit.llm.components import components


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    draw = random.Random(5)
    links = {
        "chain": [(i, i + 1) for i in range(60)],
        "star": [(50, i) for i in range(100) if i != 50],
        "random": [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(1, 1), (None, 4)],
        "none": [],
    }[shape]
    known = [(a, b) for a, b in links if a is not None and a != b]
    wanted = brute_components({n for x in known for n in x}, known)
    found = components(spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r["node"]: r["root"] for r in found.collect()} == wanted


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def simhash_wanted(rows, max_bits=2):
    prints = [brute_fingerprint(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if bin(prints[a] ^ prints[b]).count("1") <= max_bits]
    roots = brute_components(range(len(rows)), links)
    least = {}
    for place, (i, _) in enumerate(rows):
        if i is not None:
            least[roots[place]] = min(i, least.get(roots[place], i))
    return [(i, f"{prints[p]:016x}", least.get(roots[p])) for p, (i, _) in enumerate(rows)], [least.get(r) for r in set(roots.values())]


def test_simhash_on_documents(odd_docs, sample):
    for docs in (sample, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        found = simhash.near_duplicates(docs)
        assert found.columns == ["doc_id", "fingerprint", "component_id"]
        assert sorted(map(tuple, found.collect()), key=str) == sorted(simhash_wanted(rows)[0], key=str)


def test_simhash_of_spark_agrees(spark):
    """The hash of a shingle is that of Spark's xxhash64."""
    from pyspark.sql import functions as F

    row = spark.sql("select 'the cat sat' as s").select(F.xxhash64("s").alias("h")).first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"the cat sat", 42)


@pytest.mark.parametrize("max_bits", [1, 2, 3])
@pytest.mark.parametrize("paired", [1, 64])
def test_links_connect_what_is_near(spark, monkeypatch, max_bits, paired):
    """Buckets resolved pair by pair and by common neighbours connect the same fingerprints."""
    monkeypatch.setattr(simhash, "PAIRED_BUCKET", paired)
    draw = random.Random(max_bits)
    prints = set()
    for _ in range(12):
        centre = draw.getrandbits(64)
        prints.add(centre)
        for _ in range(25):
            prints.add(centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))))
    prints = sorted(simhash._signed(x) for x in prints)
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) % (1 << 64)).count("1") <= max_bits]
    found = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(x,) for x in prints], "fp bigint"), max_bits).collect()]
    assert set(found) <= {(min(x), max(x)) for x in near}
    assert brute_components(prints, found) == brute_components(prints, near)
    if paired == 64:
        assert set(found) == {(min(x), max(x)) for x in near}


def test_the_ring_covers_its_principle():
    """Any difference within the distance passes the chain tests of some key."""
    draw = random.Random(9)
    for max_bits in (1, 2, 3):
        ring = simhash.Ring(max_bits)
        for _ in range(3000):
            apart = sum(1 << b for b in draw.sample(range(64), draw.randint(1, max_bits)))
            assert any(
                not apart & key and all(bin(apart & masks[k]).count("1") <= ring.allowed[n] for n, masks in ring.chains.items())
                for k, key in enumerate(ring.keys)
            )


def test_one_of_each_group_stays(spark, odd_docs, sample):
    for docs in (sample, odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        heads = simhash_wanted(rows)[1]
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        ids = [r["doc_id"] for r in kept.collect()]
        assert sorted(ids, key=str) == sorted(heads, key=str)


def test_no_rows(spark, no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert cross_polytope.near_vectors(empty).collect() == []


def vector_rows():
    draw = np.random.default_rng(4)
    rows = []
    for label in range(3):
        for _ in range(30):
            centre = draw.normal(size=48)
            for _ in range(draw.integers(1, 6)):
                noisy = centre + draw.normal(size=48) * draw.uniform(0, 0.15)
                rows.append((len(rows), noisy.astype(np.float32).tolist(), label))
    dense = draw.normal(size=48)
    for _ in range(150):  # one group of many near copies
        rows.append((len(rows), (dense + draw.normal(size=48) * 0.12).astype(np.float32).tolist(), 1))
    same = rows[0][1]
    odd = [
        same, same, [2 * x for x in same], [0.0] * 48, None, [], [None] * 48, [math.nan] * 48, [math.inf] + [1.0] * 47, same[:8],
    ]
    rows += [(1000 + i, v, 0) for i, v in enumerate(odd)]
    rows += [(2000, same, None), (None, same, 0), (3000, same, 2), (3000, same, 0)]
    return rows


def vectors_wanted(rows, least):
    usable = [
        v is not None and len(v) > 0 and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for _, v, lab in rows
    ]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if u else None for (_, v, _), u in zip(rows, usable, strict=True)]
    links = [
        (a, b) for a in range(len(rows)) if usable[a] for b in range(a)
        if usable[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= least
    ]
    roots = brute_components(range(len(rows)), links)
    head = {}
    for p, (i, _, _) in enumerate(rows):
        if i is not None:
            head[roots[p]] = min(i, head.get(roots[p], i))
    degree = [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    return sorted(((i, degree[p], head.get(roots[p]), i == head.get(roots[p])) for p, (i, _, _) in enumerate(rows)), key=str), links


@pytest.mark.parametrize("block", [2048, 20])
def test_near_vectors(spark, monkeypatch, block):
    """All pairs of these rows are found; small blocks give what whole buckets give."""
    monkeypatch.setattr(cross_polytope, "BLOCK", block)
    rows = vector_rows()
    table = clashing(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    found = cross_polytope.near_vectors(table, 0.95)
    wanted, links = vectors_wanted(rows, 0.95)
    assert len(links) > 500
    assert sorted(map(tuple, found.collect()), key=str) == wanted


def test_share_of_pairs_found(spark):
    """Of the pairs at the production cosine nearly all are found, and none below it.

    Every vector of the sample table gets two copies with noise, just above and just below.
    """
    draw = np.random.default_rng(2)
    rows = []
    for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect():
        x = np.array(r["embedding"], dtype=np.float64)
        x /= np.linalg.norm(x)
        rows.append((len(rows), x.tolist(), r["label"]))
        for cosine in (draw.uniform(0.98, 0.985), draw.uniform(0.97, 0.98)):
            other = draw.normal(size=len(x))
            other -= (other @ x) * x
            other /= np.linalg.norm(other)
            rows.append((len(rows), (cosine * x + math.sqrt(1 - cosine**2) * other).tolist(), r["label"]))
    wanted, links = vectors_wanted(rows, 0.98)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    found = sorted(map(tuple, cross_polytope.near_vectors(table, 0.98).collect()), key=str)
    assert len(links) >= 400
    assert sum(r[1] for r in found) >= 0.99 * 2 * len(links)
    assert all(f[1] <= w[1] for f, w in zip(found, wanted, strict=True))


def test_hadamard_is_orthogonal():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(cross_polytope.hadamard(cross_polytope.hadamard(x)) / 16, x)


@pytest.mark.parametrize("dim", [1, 3, 16, 64, 200])
@pytest.mark.parametrize("least", [0.5, 0.95, 0.98, 1.0])
def test_sketches_keep_all_pairs_above_the_cosine(dim, least):
    draw = np.random.default_rng(dim)
    x = draw.normal(size=(300, dim))
    x = np.concatenate((x, x + draw.normal(size=x.shape) * draw.uniform(0, 0.4, size=(300, 1)), x))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    short = cross_polytope.sketches(x).astype(int)
    apart = ((short[:, None, :] - short[None, :, :]) ** 2).sum(axis=2)
    close = x @ x.T >= least
    assert (apart[close] <= cross_polytope.sketch_reach(least)).all()
    if dim == 64 and least == 0.98:
        assert (apart[~close] > cross_polytope.sketch_reach(least)).mean() > 0.999


def test_vectors_of_several_lengths_and_integers(spark):
    rows = [(i, [1, i % 3, 5, i % 2][: 2 + i % 3], i % 2) for i in range(60)]
    wanted, _ = vectors_wanted(rows, 0.9)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<int>, label int")
    assert sorted(map(tuple, cross_polytope.near_vectors(table, 0.9).collect()), key=str) == wanted
