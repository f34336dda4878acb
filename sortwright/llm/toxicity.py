"""Toxicity by cumulative-link ordinal regression.

A document's features are the hashed words it contains and their prefixes of
four to six characters; each distinct word adds log2(1 + its count) to its own. The model is
P(grade > k) = sigmoid(x.w - theta_k): one weight vector shared by all ordered
thresholds. The result is the expected severity, sum over k of P(grade > k).

Fitting takes a bounded sample of labelled rows (``max_train``, chosen by a hash
of the id, so the sample doesn't depend on partitions), less the near copies
among them (equal min-hash of five-word shingles), whose private words would
look tied to the label. Of the features that the sample ties to the label (a
two-proportion z score of ``min_z`` or more, in ``min_share`` of the toxic
documents at least) the ``max_features`` strongest are fitted by gradient steps
with an L2 penalty. A document is toxic from the severity on that has the best F1
on the sample. Grades come from the binary label and the amount of toxic material: 0 for clean, 1 or 2 for toxic
documents with fewer than, or at least, the median count of tied features.

Scoring is one pass over whole texts with a word-to-weight table per worker,
bounded in size; there is no shuffle.

Defined cases: null or word-less text has no features and severity
``sum sigmoid(-theta)``; without labels of both kinds every severity is 0;
labels that are null or not 0/1 are ignored, of several labels of one id the
larger counts; repeated rows are scored alike; of several texts of one id the one
with the smallest hash is fitted; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from sortwright.llm.common import discard, materialize, slices, spare
from sortwright.llm.near_dup import shingle_sets

WORD = re.compile(r"\w+").findall
FEATURES = "doc_id long, toxic int, th long, sketch long, features array<int>, amounts array<double>"


@dataclass(frozen=True)
class ToxicityConfig:
    max_train: int = 6000
    buckets: int = 1 << 22
    min_z: float = 5.0
    min_share: float = 0.02
    max_features: int = 256
    l2: float = 0.02
    steps: int = 400
    rate: float = 0.3
    cache_words: int = 500_000


def word_features(word: str, buckets: int) -> list[int]:
    """Buckets of the word itself and of its longer prefixes."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % buckets for x in {f"={word}", *(f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) >= n)}]


@dataclass
class OrdinalModel:
    """``thresholds`` ascend; ``weights`` maps a bucket to its weight."""

    weights: dict[int, float]
    thresholds: list[float]
    buckets: int
    cut: float = 0.5

    def severity(self, margin: np.ndarray) -> np.ndarray:
        z = np.asarray(margin, float)
        return sum((1 / (1 + np.exp(np.clip(t - z, -60, 60))) for t in self.thresholds), np.zeros_like(z))

    def margins(self, texts: list[str | None], cache: dict[str, float], limit: int) -> np.ndarray:
        weights, out = self.weights, np.zeros(len(texts))
        for i, t in enumerate(texts):
            if not t or not weights:
                continue
            words = WORD(t.lower())
            distinct = set(words)
            new = [w for w in distinct if w not in cache]
            if new:
                if len(cache) + len(new) > limit:
                    cache.clear()
                    new = list(distinct)
                for w in new:
                    cache[w] = sum(weights.get(f, 0.0) for f in word_features(w, self.buckets))
            out[i] = sum(cache[w] * math.log2(1 + words.count(w)) for w in sorted(w for w in distinct if cache[w]))
        return out


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, cfg: ToxicityConfig) -> OrdinalModel:
    """Proportional odds: w and the gaps between thresholds by Adagrad steps on
    the mean negative log likelihood, all rows each step."""
    levels = int(grades.max()) if len(grades) else 0
    if not levels or not (grades == 0).any():
        return OrdinalModel({}, [], cfg.buckets)
    ids = np.concatenate([r[0] for r in rows])
    names, col = np.unique(ids, return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    val = np.concatenate([r[1] for r in rows])
    lift = np.minimum(len(grades) / (2 * max(1, (grades > 0).sum())), 10.0)
    cost = np.where(grades > 0, lift, 1.0)
    w, gaps = np.zeros(len(names)), np.concatenate(([0.5], np.zeros(levels - 1)))
    gw, gg = np.full(len(names), 1e-8), np.full(levels, 1e-8)
    for _ in range(cfg.steps):
        theta = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
        z = np.bincount(row, val * w[col], len(rows))
        cum = np.concatenate((np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(theta - z[:, None], -60, 60))), np.zeros((len(rows), 1))), axis=1)
        pick = np.arange(len(rows))
        p = np.maximum(cum[pick, grades] - cum[pick, grades + 1], 1e-12)
        slope = cum * (1 - cum)
        dz = -cost * (slope[pick, grades] - slope[pick, grades + 1]) / p / len(rows)
        dtheta = np.zeros(levels)
        for k in range(levels):
            dtheta[k] = (cost * slope[:, k + 1] * ((grades == k + 1) / p - (grades == k) / p)).sum() / len(rows)
        dg = np.concatenate(([dtheta.sum()], [np.exp(gaps[k]) * dtheta[k:].sum() for k in range(1, levels)]))
        dw = np.bincount(col, val * dz[row], len(names)) + cfg.l2 * w / len(names)
        gw += dw * dw
        gg += dg * dg
        w -= cfg.rate * dw / np.sqrt(gw)
        gaps -= cfg.rate * dg / np.sqrt(gg)
    theta = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
    model = OrdinalModel(dict(zip(names.tolist(), w.tolist())), theta.tolist(), cfg.buckets)
    model.cut = _best_cut(model.severity(np.bincount(row, val * w[col], len(rows))), grades > 0)
    return model


def _best_cut(severity: np.ndarray, toxic: np.ndarray) -> float:
    """Halfway between the two severities that the best F1 lies between."""
    at = np.unique(severity)
    order = np.argsort(-severity, kind="stable")
    hits = np.cumsum(toxic[order])
    last = np.searchsorted(-severity[order], -at, "right") - 1
    f1 = 2 * hits[last] / (last + 1 + toxic.sum())
    k = int(np.argmax(f1))
    return float((at[k] + at[k - 1]) / 2) if k else float(at[0])


def training_rows(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig) -> list:
    """Features of at most about ``max_train`` labelled documents."""
    use = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = use.count()
    if not n:
        return []
    keep = use.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(min(1.0, cfg.max_train / n) * (1 << 20)))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = docs.join(F.broadcast(keep), docs["doc_id"] == keep["id"]).select("doc_id", "toxic", F.xxhash64("text").alias("th"), "text")  # bounded by max_train rows
    buckets = cfg.buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3):
            feats = []
            for t in b.column(3).to_pylist():
                seen: dict[int, float] = {}
                for w, c in Counter(WORD((t or "").lower())).items():
                    for f in word_features(w, buckets):
                        seen[f] = seen.get(f, 0.0) + math.log2(1 + c)
                feats.append(seen)
            least = [int(x[0].astype(np.int64)) if len(x) else 0 for x in shingle_sets(b.column(3).to_pylist(), 5)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(least, pa.int64()), pa.array([[*f] for f in feats], pa.list_(pa.int32())), pa.array([[*f.values()] for f in feats], pa.list_(pa.float64()))], names=["doc_id", "toxic", "th", "sketch", "features", "amounts"])

    # one document of each sketch, the one of the smallest id; of an id the text of the smallest hash
    first = F.row_number().over(Window.partitionBy("sketch", "toxic").orderBy("doc_id", "th"))
    only = F.row_number().over(Window.partitionBy("doc_id").orderBy("th", "sketch"))
    sampled = materialize(found.mapInArrow(run, FEATURES).withColumn("rank", first).filter("rank = 1").withColumn("rank", only).filter("rank = 1").drop("rank", "th"), "toxic-train")
    ones, total = sampled.agg(F.sum("toxic"), F.count("*")).first()
    if not ones or ones == total:
        discard(sampled)
        return []
    # keep what is tied to the label: a pooled two-proportion z score over documents
    stats = sampled.select("toxic", F.explode("features").alias("f")).groupBy("f").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    p1, p0 = F.col("t") / ones, (F.col("n") - F.col("t")) / (total - ones)
    pool = (F.col("n") + 1) / (total + 2)
    z = (p1 - p0) / F.sqrt(pool * (1 - pool) * (1 / ones + 1 / (total - ones)))
    tied = stats.withColumn("z", F.abs(z)).filter((F.col("z") >= cfg.min_z) & (F.greatest("t", F.lit(0)) >= max(4, cfg.min_share * ones))).orderBy(F.desc("z"), "f").limit(cfg.max_features).select("f")
    pairs = sampled.select("doc_id", "toxic", F.explode(F.arrays_zip("features", "amounts")).alias("x")).select("doc_id", "toxic", F.col("x.features").alias("f"), F.col("x.amounts").alias("c"))
    rows = sampled.select("doc_id", "toxic").join(pairs.join(F.broadcast(tied), "f").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("f", "c"))).alias("x")), "doc_id", "left").orderBy("doc_id").collect()
    discard(sampled)
    return rows


def fit(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> OrdinalModel:
    rows = training_rows(docs, labels, cfg)
    x = [(np.array([v["f"] for v in r["x"] or ()], np.int64), np.array([v["c"] for v in r["x"] or ()], float)) for r in rows]
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    amount = np.array([v[1].sum() for v in x])
    grades = toxic.copy()
    if (toxic == 1).any():
        grades[(toxic == 1) & (amount >= np.median(amount[toxic == 1])) & (amount > amount[toxic == 1].min())] = 2
    return fit_ordinal(x, grades, cfg)


def score(docs: DataFrame, model: OrdinalModel, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs`` with a column ``severity`` (underscores are appended where
    ``docs`` has one of that name)."""
    at, name, schema = docs.columns.index("text"), spare("severity", docs.columns), docs.schema
    limit = cfg.cache_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for b in slices(batches, at):
            texts = [None if t is None else str(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.severity(model.margins(texts, cache, limit)))], names=[*b.schema.names, name])

    return docs.mapInArrow(run, StructType([*schema.fields]).add(name, DoubleType()))


def grade(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``doc_id, severity, grade, toxic`` for each document; ``toxic`` is a
    severity of the model's cut or more."""
    model = fit(docs, labels, cfg)
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model, cfg)
    return scored.select("doc_id", F.round("severity", 9).alias("severity"), F.round("severity").cast("int").alias("grade"), (F.col("severity") >= model.cut).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, cfg: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """``docs`` without the toxic rows; all columns and types are kept."""
    name, model = spare("severity", docs.columns), fit(docs, labels, cfg)
    return score(docs, model, cfg).filter(F.col(f"`{name}`") < model.cut).drop(name)
