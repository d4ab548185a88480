"""Quality, mixing and URL rules."""

import math

import duckdb
import numpy as np
import pytest
from compare import compare
from odd_rows import clashing
from pyspark.sql import functions as F

import corpus_pipeline
from chronaudit.llm import queries, site_quality, source_mix, url_rules


def test_held_out_quality(spark):
    """Trained on the labels of one half of the ids, judged on the other."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = site_quality.judge_quality(docs, labels.filter(F.xxhash64("doc_id") % 2 == 0))
    rows = found.join(labels.filter(F.xxhash64("doc_id") % 2 != 0), "doc_id").select("kept", "quality").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert len(good) > 1000 and len(bad) > 100
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.05 * len(bad)
    assert found.count() == docs.count()


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def strength(groups, centre, n):
    chance = sum(centre(g) * (1 - centre(g)) for g in groups) / len(groups)
    apart = sum(m * (g_good / m - centre(k)) ** 2 for k, (m, g_good) in groups.items())
    spread = n - sum(m * m for m, _ in groups.values()) / n
    between = (apart - (len(groups) - 1) * chance) / spread if spread > 0 else 0
    return 1e6 if between <= 0 else min(1e6, max(1.0, chance / between - 1))


def test_posteriors_are_those_of_the_hierarchy(spark):
    """Site posteriors against the same sums by hand, the own part left out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model, evidence = site_quality.fit_sites(docs, labels, "doc_id", "text", "source", "lang", "quality")
    rows = evidence.collect()
    prior = math.log(model.classifier.share / (1 - model.classifier.share))
    paths, hosts = {}, {}
    for r in rows:
        p = sigmoid(r["evidence"] + prior)
        for groups, key in ((paths, (r["host"], r["path"])), (hosts, r["host"])):
            n, good = groups.get(key, (0, 0.0))
            groups[key] = (n + 1, good + p)
    share = sum(g for _, g in hosts.values()) / len(rows)
    assert model.share == pytest.approx(share)
    k_host = strength(hosts, lambda _: share, len(rows))

    def without(key):
        """The host's shrunken share, without this path."""
        n, g = (a - b for a, b in zip(hosts[key[0]], paths[key], strict=True))
        return (k_host * share + (g if n else 0)) / (k_host + n)

    k_path = strength(paths, without, len(rows))
    assert model.host_strength == pytest.approx(k_host) and model.path_strength == pytest.approx(k_path)
    found = {r["id"]: r for r in model.posterior(evidence, "host", "path", "evidence").collect()}
    for r in rows:
        p = sigmoid(r["evidence"] + math.log(share / (1 - share)))
        np_, gp = paths[r["host"], r["path"]]
        of_host = without((r["host"], r["path"]))
        of_path = min(0.999, max(0.001, (k_path * of_host + gp - p) / (k_path + np_ - 1)))
        assert found[r["id"]]["site_posterior"] == pytest.approx(of_path)
        assert found[r["id"]]["posterior"] == pytest.approx(sigmoid(r["evidence"] + math.log(of_path / (1 - of_path))))


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = clashing(spark.createDataFrame(
        [(1, 1, 0), (9, 0, 0), (9, 1, 0), (4, 1, 0), (None, 1, 0), (8, None, 0), (77, 1, 0)], "doc_id bigint, quality int, toxic int"))
    found = site_quality.judge_quality(odd_docs, labels)
    assert found.count() == odd_docs.count()
    assert found.filter("posterior is null or site_posterior is null").count() == 0
    kept = site_quality.keep_good(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in found.filter("kept").collect())
    none = labels.limit(0)
    assert site_quality.judge_quality(odd_docs, none).filter("not kept").count() == 0
    assert site_quality.judge_quality(no_docs, labels).collect() == []
    assert site_quality.keep_good(no_docs, none).collect() == []


@pytest.mark.parametrize("labelled", [[(1, 1), (4, 1), (9, 1)], [(1, 0), (4, 0), (9, 0)], [(9, 1)], [(9, 0)], [(None, 1), (1, None)], []])
def test_labels_of_one_class_say_nothing(spark, odd_docs, tmp_path, labelled):
    """Only good, only bad, unusable and no labels: evidence is zero, and every row is kept, in the stage as well."""
    labels = spark.createDataFrame([(i, q, 0) for i, q in labelled], "doc_id bigint, quality int, toxic int")
    found = site_quality.judge_quality(odd_docs, labels).collect()
    assert len(found) == odd_docs.count()
    assert all(r["kept"] and r["evidence"] == 0 and r["posterior"] == 0.5 for r in found)
    wanted = sorted(map(tuple, odd_docs.collect()), key=str)
    assert sorted(map(tuple, site_quality.keep_good(odd_docs, labels).collect()), key=str) == wanted
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert sorted(map(tuple, corpus_pipeline.quality(spark, odd_docs, str(tmp_path)).collect()), key=str) == wanted


def filled(sizes, weights, epochs, total):
    """Water-filling by bisection on the level."""
    low, high = 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        if sum(min(epochs * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total:
            low = level
        else:
            high = level
    return [min(epochs * s, level * w) for s, w in zip(sizes, weights, strict=True)]


@pytest.mark.parametrize("sizes,weights", [
    ([100, 100, 100], [1, 2, 3]), ([1, 1, 1000], [1, 2, 3]), ([5, 0, 50, 500], [3, 1, 2, 0.5]), ([10, 10], [0, 1]),
])
def test_water_filling(spark, sizes, weights):
    table = spark.createDataFrame(
        [(f"s{i}", s, float(w)) for i, (s, w) in enumerate(zip(sizes, weights, strict=True))],
        "source string, source_size bigint, weight double")
    found = {r["source"]: r["target"] for r in source_mix.water_fill(table, 3).collect()}
    for i, wanted in enumerate(filled(sizes, weights, 3, sum(sizes))):
        assert found[f"s{i}"] == pytest.approx(wanted, rel=1e-6, abs=1e-6)


def test_mix_meets_its_targets(sample, odd_docs):
    for docs in (sample, odd_docs):
        rows = source_mix.mix_sources(docs).collect()
        assert len(rows) == docs.count()
        sources = {}
        for r in rows:
            assert r["taken"] == r["epochs"] * r["size"] and 0 <= r["epochs"] <= 3
            key = (r["source"], r["source_size"], r["target"])
            taken, largest = sources.get(key, (0, 0))
            sources[key] = (taken + r["taken"], max(largest, r["size"]))
        for (_, size, target), (taken, largest) in sources.items():
            assert target <= 3 * size + 1e-6
            assert abs(taken - target) <= largest / 2 + 1e-6
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, source_mix.mix_sources(docs).collect()), key=str)


@pytest.mark.parametrize("ids,texts", [
    ([None], ["one two three"]), ([1, 1, 2], [None]), ([1, 1, 2], ["a b", "c d e", "a b", "f"]), ([5], ["a b c d e f g h"] * 7 + [""]),
])
def test_targets_with_null_and_repeated_ids(spark, ids, texts):
    """Taken words stay within half a document of every target; SQL decides row by row and agrees."""
    rows = [(ids[i % len(ids)], texts[i % len(texts)], "abc"[i % 3] if i % 6 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(9)
    found = source_mix.mix_sources(docs)
    sums = found.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"))
    for r in sums.collect():
        assert abs(r["taken"] - r["target"]) <= r["size"] / 2 + 1e-6
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    assert compare(found.drop("epochs", "source"), db, queries.SQL_MIX) == []
    assert source_mix.repeat_rows(docs).count() == found.agg(F.sum("epochs")).first()[0]


def test_many_sources_are_weighed_in_turn(spark):
    names = [f"s{i:04d}" for i in range(1000)] + [None]
    table = spark.createDataFrame([(x, 5) for x in reversed(names)], "source string, source_size bigint").repartition(7)
    found = {r["source"]: r["weight"] for r in source_mix.cycled_weights(table, (1.0, 2.0, 3.0)).collect()}
    assert found == {x: float(i % 3 + 1) for i, x in enumerate(names)}
    plan = source_mix.cycled_weights(table, (1.0, 2.0, 3.0))._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_the_mix_itself(sample, odd_docs, no_docs):
    for docs in (sample, odd_docs):
        mixed = source_mix.repeat_rows(docs)
        assert mixed.columns == docs.columns
        wanted = sum(r["epochs"] for r in source_mix.mix_sources(docs).collect())
        assert mixed.count() == wanted
    assert source_mix.mix_sources(no_docs).collect() == []
    assert source_mix.repeat_rows(no_docs).collect() == []


def test_mix_uses_no_python(sample):
    plan = source_mix.repeat_rows(sample)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("COM", "/fr/", "allow"),
    ("com", "/de/", "block"), ("same.net", "/x", "allow"), ("same.net", "/x", "block"), ("net", "", "block"),
    ("tie.io", "/a", "allow"), ("io", "/a/bcd", "block"), (None, "/", "block"), ("x", None, "block"),
]
URLS = [
    "https://example.org/es/", "http://EXAMPLE.org/es/1", "https://a.b.example.org/en/12#x", "https://example.org/en/2",
    "https://notexample.org/es/", "http://x.com/de/?q=/fr/", "http://x.com/fr/", "ftp://com/de/1", "http://x.com/DE/1", "nothing",
    "", None, "http://same.net/xy", "http://same.net", "http://tie.io/a/bcd", "http://org", "http://org?a/b", "://org/", "a://b://org/",
    "http://x.org:80/", "http://" + "a." * 3000 + "org/" + "p" * 20000, "http://x.com/de/1", "http://x.com/de/1", "http://é.com/fr/ü",
]


def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?", 1)[0].split("#", 1)[0]
    best = None
    for h, p, v in rules:
        if h is None or p is None:
            continue
        h = h.lower()
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0,), (len(h + p), len(h), h + p, v))
    return (host, path, best[2] if best else None, best[3] if best else default)


def test_url_rules(spark):
    pages = clashing(spark.createDataFrame([(i % 20, u) for i, u in enumerate(URLS)], "page_id bigint, url string"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    wanted = sorted(((i % 20, *judged(u, RULES)) for i, u in enumerate(URLS)), key=str)
    assert sorted(map(tuple, url_rules.judge_urls(pages, rules).collect()), key=str) == wanted
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []
    none = url_rules.judge_urls(pages, rules.limit(0), default="block").collect()
    assert len(none) == len(URLS) and {r["verdict"] for r in none} == {"block"}


def test_many_rules_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "BROADCAST_RULES", 3)
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    wanted = sorted(((i, *judged(u, RULES)) for i, u in enumerate(URLS)), key=str)
    assert sorted(map(tuple, url_rules.judge_urls(pages, rules).collect()), key=str) == wanted


def test_verdicts_are_not_broadcast(spark):
    """However few they seem, verdicts of URLs are joined by a shuffle; only the rules are broadcast."""
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    plan = url_rules.judge_urls(pages, rules)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_features_of_a_text():
    assert len(site_quality.features("")) == len(site_quality.features("a b c"))
    assert np.isfinite(site_quality.features("x " * 50_000)).all()


def test_training_is_bounded(spark, monkeypatch):
    """About as many labelled rows as asked for are collected, the same ones every time."""
    rows = spark.range(3000).select("id", F.array(*[F.lit(0.5).cast("float")] * 44).alias("x"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("cast(id % 3 = 0 as int)").alias("quality"))
    seen = []
    monkeypatch.setattr(site_quality.Classifier, "fit", classmethod(lambda cls, x, good: seen.append(good.tolist())))
    for _ in range(2):
        site_quality.train(rows, labels, "doc_id", "quality", most=200)
    assert 120 <= len(seen[0]) <= 200 and seen[0] == seen[1]
    site_quality.train(rows, labels, "doc_id", "quality", most=5000)
    assert len(seen[2]) == 3000


def test_training_sample_is_of_labelled_rows(spark, monkeypatch):
    """Labels of other documents do not thin the sample, and rows under one id are drawn one by one."""
    seen = []
    monkeypatch.setattr(site_quality.Classifier, "fit", classmethod(lambda cls, x, good: seen.append(x.tolist())))
    width = len(site_quality.PUNCTUATION) + 12
    labels = spark.range(200_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    x = f"transform(sequence(1, {width}), i -> cast(i + n as float)) as x"
    unique = spark.range(0, 1000).selectExpr("id", "id as n").selectExpr("id", x)
    site_quality.train(unique, labels, "doc_id", "quality", most=2000)
    assert len(seen[-1]) == 1000
    repeated = spark.range(0, 4000, numPartitions=7).selectExpr("id % 2 as id", "id as n").selectExpr("id", x)
    for rows in (repeated, repeated.repartition(3)):
        site_quality.train(rows, labels, "doc_id", "quality", most=1000)
    assert 850 <= len(seen[-1]) <= 1000 and sorted(seen[-1]) == sorted(seen[-2])
