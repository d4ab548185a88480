"""Quality of documents from their own evidence and from that of their site.

A classifier gives every document a log-odds of being good. The probabilities that follow
are summed by path and by host; a host's share of good documents is shrunk toward that of
the corpus, a path's toward its host's, by as much as hosts and paths are found to differ
(empirical Bayes). A document's posterior combines its own evidence with what the others of
its path, its host and the corpus say, so a site with few documents counts for little.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronaudit.llm.common import byte_slices, in_files

#: Labelled documents that the classifier is fitted on at most, drawn by a digest of id and features.
TRAINING_ROWS = 20_000
#: Of that number the share that is aimed at, and the draws that a row may have.
DRAWN, DRAWS = 0.95, 1 << 30
SLICE_BYTES = 4 << 20
PUNCTUATION = string.punctuation
RIDGE, NEWTON_STEPS = 1.0, 25
#: A document is kept from this posterior on.
KEEP_FROM = 0.5
#: Bounds of the prior's strength, in documents.
STRENGTHS = (1.0, 1e6)


def features(text: str) -> list[float]:
    """Shares and ratios of a text that tell prose from junk; all zero for a text without words."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * (len(PUNCTUATION) + 12)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, size = len(words), len(raw)
    upper, lower, digits = int(counts[65:91].sum()), int(counts[97:123].sum()), int(counts[48:58].sum())
    kinds = Counter(words)
    lines = raw.split(b"\n")
    repeats = 1 - len(set(lines)) / len(lines)
    spelled = math.log1p(n)
    return [
        *(counts[[ord(c) for c in PUNCTUATION]] / n).clip(max=1.0).tolist(),
        spelled, spelled**2 / 10, upper / (upper + lower + 1), digits / size, (size - n) / n / 10,
        len(kinds) / n, len(kinds) / n * spelled, max(kinds.values()) / n, repeats,
        min(1.0, len(lines) / n), int(counts[128:].sum()) / size,
        sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905
    ]


@dataclass(frozen=True)
class Classifier:
    """Logistic regression on standardised features; its log-odds are freed of the training share."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    share: float

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray) -> Classifier:
        """Newton steps with a ridge. With one class only, or no rows, the evidence is zero everywhere."""
        width = x.shape[1]
        if not len(x) or good.min() == good.max():
            return cls(np.zeros(width), np.ones(width), np.zeros(width + 1), 0.5)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        w = np.zeros(width + 1)
        ridge = np.diag([RIDGE] * width + [1e-6])
        for _ in range(NEWTON_STEPS):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (good - p) - ridge @ w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w, float(good.mean()))

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log of how much likelier the features are in a good document."""
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return np.clip(z - math.log(self.share / (1 - self.share)), -30, 30)


def _feature_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in byte_slices(batches, "text", SLICE_BYTES):
        found = pa.array([features(x or "") for x in rows.column("text").to_pylist()], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("id", "host", "path")), found], ["id", "host", "path", "x"])


def train(feature_rows: DataFrame, labels: DataFrame, id_col: str, label_col: str, most: int = TRAINING_ROWS) -> Classifier:
    """Fit on labelled rows, ``most`` at most; null labels and ids are left out, of repeated ids one label counts.

    Where more rows have a label, a share of them is drawn by a digest before anything is
    collected, so the driver's part does not grow with the labels, and labels of other
    documents do not count.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("good")).dropna()
    known = known.groupBy("id").agg(F.min("good").alias("good"))
    labelled = in_files(feature_rows.select("id", "x").join(known, "id"), "labelled")
    n = labelled.count()
    draw = F.xxhash64("id", "x")
    if n > most:
        labelled = labelled.filter(F.pmod(draw, F.lit(DRAWS)) < int(DRAWS * DRAWN * most / n))
    rows = labelled.orderBy(draw, "id", "x").limit(most).collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))  # sums in the same order every time
    width = len(PUNCTUATION) + 12
    x = np.array([r["x"] for r in rows], dtype=float).reshape(-1, width)
    return Classifier.fit(x, np.array([r["good"] for r in rows], dtype=float))


def _strength(groups: DataFrame, centre: F.Column) -> float:
    """How many documents the prior of these groups weighs, by the method of moments."""
    share = F.col("good") / F.col("n")
    sums = groups.select("n", (F.col("n") * (share - centre) ** 2).alias("apart"), (centre * (1 - centre)).alias("chance")).agg(
        F.sum("apart").alias("apart"), F.avg("chance").alias("chance"), F.count("*").alias("groups"),
        F.sum("n").alias("n"), F.sum(F.col("n").cast("double") ** 2).alias("squares"),
    ).first()
    if not sums["groups"] or sums["groups"] < 2:
        return STRENGTHS[1]
    spread = sums["n"] - sums["squares"] / sums["n"]
    between = (sums["apart"] - (sums["groups"] - 1) * sums["chance"]) / spread if spread > 0 else 0.0
    if between <= 0:
        return STRENGTHS[1]
    return min(STRENGTHS[1], max(STRENGTHS[0], sums["chance"] / between - 1))


@dataclass(frozen=True)
class SiteModel:
    """The classifier, the sums of each site (host, path and their sums) and the priors."""

    classifier: Classifier
    sites: DataFrame
    share: float
    host_strength: float
    path_strength: float

    def posterior(
        self, scored: DataFrame, host: str, path: str, evidence: str, names: tuple[str, str] = ("site_posterior", "posterior")
    ) -> DataFrame:
        """The rows with their site's and their own posterior, under these names.

        A document's own part in the sums is taken out, and its path's part in those of its
        host, so that nothing counts twice.
        """
        left, right = scored.alias("d"), self.sites.alias("s")
        same = F.col(f"d.`{host}`").eqNullSafe(F.col("s.site_host")) & F.col(f"d.`{path}`").eqNullSafe(F.col("s.site_path"))
        own = F.col(f"d.`{evidence}`")
        prior = math.log(self.share / (1 - self.share))
        p = 1 / (1 + F.exp(-(own + F.lit(prior))))
        others = F.col("s.host_n") - F.col("s.path_n")
        of_host = (F.lit(self.host_strength * self.share) + F.when(others > 0, F.col("s.host_good") - F.col("s.path_good")).otherwise(0.0)) / (
            F.lit(self.host_strength) + others)
        of_path = (F.lit(self.path_strength) * of_host + F.col("s.path_good") - p) / (
            F.lit(self.path_strength) + F.col("s.path_n") - 1)
        bounded = F.least(F.lit(0.999), F.greatest(F.lit(0.001), of_path))
        return left.join(right, same).select(
            "d.*", bounded.alias(names[0]),
            (1 / (1 + F.exp(-(own + F.ln(bounded / (1 - bounded)))))).alias(names[1]),
        )


def fit_sites(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host_col: str, path_col: str, label_col: str
) -> tuple[SiteModel, DataFrame]:
    """The model of a corpus, and the evidence of its rows (id, host, path, evidence) in files."""
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(host_col).cast("string").alias("host"),
        F.col(path_col).cast("string").alias("path"), F.col(text_col).cast("string").alias("text"),
    )
    kept = in_files(rows.mapInArrow(_feature_rows, "id bigint, host string, path string, x array<float>"), "features")
    classifier = train(kept, labels, id_col, label_col)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("x").to_pylist(), dtype=float).reshape(batch.num_rows, -1)
            found = classifier.evidence(x) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "host", "path")), pa.array(found)], ["id", "host", "path", "evidence"])

    evidence = in_files(kept.mapInArrow(score, "id bigint, host string, path string, evidence double"), "evidence")
    share = min(0.99, max(0.01, classifier.share))
    good = 1 / (1 + F.exp(-(F.col("evidence") + F.lit(math.log(share / (1 - share))))))
    paths = in_files(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(good).alias("good")), "paths")
    hosts = in_files(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    if whole["n"]:
        share = min(0.99, max(0.01, whole["good"] / whole["n"]))
    host_strength = _strength(hosts, F.lit(share))
    named = hosts.select(
        F.col("host").alias("site_host"), F.col("n").alias("host_n"), F.col("good").alias("host_good"),
    )
    others = F.col("host_n") - F.col("n")
    host_share = (F.lit(host_strength * share) + F.when(others > 0, F.col("host_good") - F.col("good")).otherwise(0.0)) / (
        F.lit(host_strength) + others)
    nested = in_files(
        paths.join(named, F.col("host").eqNullSafe(F.col("site_host")))
        .select("site_host", F.col("path").alias("site_path"), "n", "good", "host_n", "host_good", host_share.alias("host_share")),
        "sites",
    )
    path_strength = _strength(nested, F.col("host_share"))
    sites = nested.select("site_host", "site_path", F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good")
    return SiteModel(classifier, sites, share, host_strength, path_strength), evidence


def judge_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_col: str = "quality", keep_from: float = KEEP_FROM,
) -> DataFrame:
    """One row per input row: the id, evidence, site_posterior, posterior and kept.

    ``labels`` has ids and labels (1 is good); a bounded sample trains the classifier, all
    else covers every row. Null texts count as empty and have the evidence of an empty text;
    null hosts and paths are sites of their own; repeated rows and null ids are kept; texts count
    whole, however long; of equal posteriors all are kept or none. Without labels of both
    classes the evidence is zero and every document is kept. An empty table gives an empty
    table. Other columns are not read.
    """
    model, evidence = fit_sites(docs, labels, id_col, text_col, host_col, path_col, label_col)
    return model.posterior(evidence, "host", "path", "evidence").select(
        F.col("id").alias(id_col), "evidence", "site_posterior", "posterior", (F.col("posterior") >= keep_from).alias("kept")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang", label_col: str = "quality", keep_from: float = KEEP_FROM,
) -> DataFrame:
    """The rows that ``judge_quality`` keeps, with all their columns.

    Evidence is computed again beside the rows, so whole texts are not shuffled by id, and
    rows that share an id are judged each by its own text. Columns may have any names. Odd
    rows are judged as ``judge_quality`` says.
    """
    model, _ = fit_sites(docs, labels, id_col, text_col, host_col, path_col, label_col)
    classifier, columns = model.classifier, docs.columns
    taken = {c.lower() for c in columns}
    names = [next(n for n in (f"{x}{i}" for i in range(len(taken) + 1)) if n not in taken) for x in ("evidence_", "host_", "path_", "site_", "posterior_")]

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in byte_slices(batches, text_col, SLICE_BYTES):
            x = np.array([features(t or "") for t in rows.column(text_col).to_pylist()], dtype=np.float32).astype(float)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(classifier.evidence(x))], [*rows.schema.names, names[0]])

    scored = docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType())]))
    scored = scored.withColumns({names[1]: F.col(host_col).cast("string"), names[2]: F.col(path_col).cast("string")})
    judged = model.posterior(scored, names[1], names[2], names[0], (names[3], names[4]))
    return judged.filter(judged[names[4]] >= keep_from).select([judged[f"`{c}`"] for c in columns])
