"""Quality classifier: gated-attention multiple-instance learning over passages.

A text is a bag of passages of PASSAGE words. Each passage is encoded by dense features and a learned layer; gated
attention weighs the passages, and a logistic layer scores the weighted mean. Every passage of a text is scored. Everything is
learned from document labels on a bounded sample: PER_CLASS documents of each label, and of texts beyond BAG passages the means
of neighbours, BAG rows a document, for the driver holds them. All rows and whole texts are scored. Labels, lang, source and
doc_id are never inputs of a score.

Defined cases: null text counts as empty, which is one empty passage, and gets a score; a null doc_id is carried and not
held out; without labels of both kinds every score is that of the known kind (1 without labels at all, so that nothing is
rejected unseen); rows repeated whole are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, small_batches
from .training import labelled_sample

PARTS, HELD_OUT = 3, 1
THRESHOLD = 0.5
PER_CLASS = 3000  # labelled documents of each class that training uses at most
PASSAGE = 120
BAG = 64
HIDDEN, GATE = 16, 8
EPOCHS, RATE, L2 = 300, 0.02, 1e-4
_UPPER, _DIGITS, _PUNCT, _SYMBOLS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:!?", "#*$%&<>@~^_=+"))


def passage_features(words: list[str]) -> list[float]:
    """Dense features of one passage."""
    n = max(1, len(words))
    raw = " ".join(words).encode("utf-8", "surrogatepass")
    size = max(1, len(raw))
    count = lambda chars: (size - len(raw.translate(None, chars))) / size
    kinds = Counter(words)
    lengths = list(map(len, words))
    mean = sum(lengths) / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    top = max(kinds.values(), default=0)
    return [
        float(np.log1p(len(words))), mean, (sum((x - mean) ** 2 for x in lengths) / n) ** 0.5, max(lengths, default=0) / 10,
        len(kinds) / n, same / n, pairs / n, top / n,
        count(_UPPER), count(_DIGITS), count(_PUNCT), count(_SYMBOLS), count(b"|"), count(b"!"),
        sum(x <= 3 for x in lengths) / n, sum(w[-1:] in ".?!" for w in words) / n, sum(not w[-1:].isalnum() for w in words) / n,
        sum(w.isupper() for w in words) / n, size / n / 10,
    ]


def every_passage(text: str) -> list[list[float]]:
    """The bag of a text that is scored: a row for every passage."""
    words = text.split()
    return [passage_features(words[i : i + PASSAGE]) for i in range(0, max(1, len(words)), PASSAGE)]


def passages(text: str) -> list[list[float]]:
    """A bag of the training sample: beyond BAG passages, rows of neighbours are averaged in BAG equal parts."""
    rows = every_passage(text)
    return rows if len(rows) <= BAG else [list(map(float, part.mean(0))) for part in np.array_split(np.array(rows), BAG)]


class AttentionModel:
    """h = tanh(xE + e); a = softmax over the bag of w.(tanh(hV) * sigmoid(hU)); score = sigmoid(sum(a h).c + d)."""

    def __init__(self, features: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"E": init(features, HIDDEN), "e": np.zeros(HIDDEN), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE) * 0.1, "c": init(HIDDEN), "d": np.zeros(1)}
        self.mean, self.std = np.zeros(features), np.ones(features)

    def _forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["E"] + p["e"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        z = (t * s) @ p["w"]
        z = np.exp(z - np.maximum.reduceat(z, starts)[bag])
        a = z / np.add.reduceat(z, starts)[bag]
        m = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "t": t, "s": s, "a": a, "m": m, "out": 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"], -30, 30)))}

    def _gradient(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, w: np.ndarray) -> dict:
        """Of the weighted log loss, by parameter."""
        f, p = self._forward(x, starts, bag), self.p
        delta = (f["out"] - y) * w  # of the bags' logits
        dm = delta[:, None] * p["c"]
        da = (f["h"] * dm[bag]).sum(1)
        dz = f["a"] * (da - np.add.reduceat(f["a"] * da, starts)[bag])
        dh = f["a"][:, None] * dm[bag]
        dg = dz[:, None] * p["w"]
        dt, ds = dg * f["s"] * (1 - f["t"] ** 2), dg * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ p["V"].T + ds @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {"E": x.T @ dx, "e": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ dz, "c": f["m"].T @ delta, "d": np.array([delta.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> AttentionModel:
        x = np.concatenate(bags)
        self.mean, self.std = x.mean(0), x.std(0) + 1e-6
        x = np.clip((x - self.mean) / self.std, -6, 6)
        sizes = np.array(list(map(len, bags)))
        starts, bag = np.concatenate([[0], sizes.cumsum()[:-1]]), np.repeat(np.arange(len(bags)), sizes)
        w = w / w.sum()
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, EPOCHS + 1):
            p = self.p
            for k, g in self._gradient(x, starts, bag, y, w).items():
                g = g + L2 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        sizes = np.array(list(map(len, bags)))
        starts, bag = np.concatenate([[0], sizes.cumsum()[:-1]]), np.repeat(np.arange(len(bags)), sizes)
        return self._forward(np.clip((np.concatenate(bags) - self.mean) / self.std, -6, 6), starts, bag)["out"]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS, parts: int = PARTS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text"):
    """A model, or a constant score where labels of one kind or none are there. The driver gets features, never texts."""
    sample, weights = labelled_sample(docs, labels, label, parts, held_out, per_class, id_col, text_col)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "x": [passages(t) for t in pdf["text"]]})

    rows = sorted(sample.select("doc_id", "y", "text").mapInPandas(run, "doc_id long, y int, x array<array<double>>").toLocalIterator(), key=lambda r: r["doc_id"])
    y = np.array([r["y"] for r in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 1.0
    return AttentionModel(len(rows[0]["x"][0])).fit([np.array(r["x"]) for r in rows], y, np.where(y > 0, weights[1], weights[0]))


def scored(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """docs' columns in keep, and score."""

    def run(batches):
        for pdf in batches:
            texts = [t or "" for t in pdf["__text"]]
            s = np.full(len(texts), model) if isinstance(model, float) else model.score([np.array(every_passage(t)) for t in texts]) if texts else np.zeros(0)
            out = pdf.drop(columns="__text")
            if "doc_id" in out:
                out["doc_id"] = out["doc_id"].astype("Int64")
            yield out.assign(score=s)

    d = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema if f.name != "__text")
    return d.mapInPandas(run, f"{fields}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, label, id_col=id_col, text_col=text_col)
    doc_id = F.col(id_col).cast("long").alias("doc_id")
    held = F.coalesce(crc_bucket(F.col(id_col).cast("long"), PARTS) == HELD_OUT, F.lit(False)).alias("held_out")
    out = scored(docs, model, id_col, text_col, keep=(doc_id, held))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """docs without the rows scored below the threshold; all columns stay as they are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    small_batches(docs.sparkSession)
    model = train(docs, labels, label, id_col=id_col, text_col=text_col)
    if isinstance(model, float):
        return docs if model >= THRESHOLD else docs.where(F.lit(False))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.score([np.array(every_passage(t or "")) for t in batch.column(at).to_pylist()])
                batch = batch.filter(pc.fill_null(pa.array(s >= THRESHOLD), True))
            yield batch

    return docs.mapInArrow(run, docs.schema)
