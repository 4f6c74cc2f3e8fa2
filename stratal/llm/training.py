"""Bounded labelled samples for the trained operators, and small numpy learners: boosted trees and isotonic calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, parts: int, held_out: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """(doc_id, text, y) of at most per_class labelled documents of each class, and the classes' weights.

    Only ids whose crc bucket is not held_out are used; ids are taken in the order of a hash. An id with several labels
    counts with the highest; null ids and labels are not used. A weight says how many labelled rows a sampled one stands for.
    """
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).cast("long").alias("s_id")).agg(F.max(label).cast("int").alias("y"))
    ids = cut(ids.where(crc_bucket(F.col("s_id"), parts) != held_out))
    count = {r["y"]: r["n"] for r in ids.where("y IN (0, 1)").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = [ids.where(F.col("y") == y).orderBy(F.xxhash64("s_id"), "s_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(cut(picked[0].unionByName(picked[1])))  # at most 2 * per_class rows
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return cut(d.join(picked, F.col("doc_id") == F.col("s_id")).select("doc_id", "text", "y").dropDuplicates(["doc_id"])), {y: max(1.0, count.get(y, 0) / per_class) for y in (0, 1)}


class BoostedTrees:
    """Gradient boosting of depth-limited trees on binned features, for the weighted log loss."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, leaf: float = 4.0, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf, self.l2 = rounds, depth, rate, bins, leaf, l2

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> BoostedTrees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)])
        mean = np.clip(np.average(y, weights=w), 1e-4, 1 - 1e-4)
        self.base, self.trees = float(np.log(mean / (1 - mean))), []
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, value = self._grow(binned, w * (y - p), w * p * (1 - p))
            self.trees.append(tree)
            score += value
        return self

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree: features, thresholds (rows with a bin at or below go left) and the leaves' values."""
        node = np.zeros(g.size, dtype=np.int64)
        feats, thresholds = [], []
        for level in range(self.depth):
            n = 1 << level
            best = np.full(n, 0.0)
            feat, thr = np.zeros(n, dtype=np.int64), np.full(n, 1 << 30, dtype=np.int64)
            gt, ht = np.bincount(node, g, n), np.bincount(node, h, n)
            for f, col in enumerate(binned):
                width = len(self.cuts[f]) + 1
                at = node * width + col
                gl = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)[:, :-1]
                hl = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)[:, :-1]
                if gl.shape[1] == 0:
                    continue
                gr, hr = gt[:, None] - gl, ht[:, None] - hl
                gain = gl**2 / (hl + self.l2) + gr**2 / (hr + self.l2) - (gt**2 / (ht + self.l2))[:, None]
                gain[(hl < self.leaf / 4) | (hr < self.leaf / 4)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(n), k]
                better = top > best + 1e-9
                best[better], feat[better], thr[better] = top[better], f, k[better]
            feats.append(feat)
            thresholds.append(thr)
            node = 2 * node + (binned[feat[node], np.arange(g.size)] > thr[node])
        n = 1 << self.depth
        leaves = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.l2)
        return (feats, thresholds, leaves), leaves[node]

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(self.cuts, x.T, strict=True)])
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for feats, thresholds, leaves in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for feat, thr in zip(feats, thresholds, strict=True):
                node = 2 * node + (binned[feat[node], rows] > thr[node])
            out += leaves[node]
        return out


def isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (score, probability) of a non-decreasing calibration."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, first score, last score
    for s, t, v in zip(score[order], y[order], w[order], strict=True):
        blocks.append([v, float(t), s, s])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks.pop()
            blocks.append([a[0] + b[0], (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0]), a[2], b[3]])
    # one pseudo row of the overall mean keeps the ends off 0 and 1
    mean = float(np.average(y, weights=w))
    xs = [x for b in blocks for x in (b[2], b[3])]
    ps = [(b[0] * b[1] + mean) / (b[0] + 1) for b in blocks for _ in (0, 1)]
    return np.array(xs), np.maximum.accumulate(np.array(ps))
