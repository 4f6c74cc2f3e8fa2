"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is a short list of words plus words and word beginnings that the labelled sample shows to go with the label
(smoothed log-odds of document frequencies). Features of a text: densities and peaks of lexicon weights, how near the
hits stand to a second-person word, capitals, punctuation, digits, symbols, obfuscated and stretched words. Lexicons for
training are mined out of fold, so a rare word of a training text does not vouch for itself.

The sample is bounded (PER_CLASS documents of each label); all else covers every row and whole texts. Defined cases: null
text counts as empty and gets a score too; a null doc_id is carried and not held out; without labels of both kinds the
score is the share of toxic labels (0.5 without any); rows repeated whole are scored each; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut, small_batches
from .training import BoostedTrees, isotonic, labelled_sample

PARTS, HELD_OUT = 4, 2
THRESHOLD = 0.3
PER_CLASS = 4000  # labelled documents of each class that training uses at most
LEXICON_SIZE = 4000  # size of the model, like the number of trees
MIN_TOXIC_DOCS = 3
MIN_LOG_ODDS = 1.2
NEAR = 4
FOLDS = 3
CACHE_ENTRIES = 400_000
# fixed values
INSULTS = """idiot stupid moron trash pathetic loser worthless disgusting scum clown dumb fool imbecile vermin filth garbage
retard bastard bitch asshole shit fuck fucking cunt whore slut hate kill die ugly crap jerk dipshit
idiota estupido estúpido imbécil basura asqueroso inútil puta mierda cabrón
idiotin dumm dummkopf arschloch scheisse scheiße abschaum wertlos widerlich drecksau
idiote stupide imbécile ordure connard salope merde putain nul dégoûtant""".split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes vosotros tú ti".split()

_PARTS = re.compile(r"[^\W_]+")
_STRIP = re.compile(r"^[\W_]+|[\W_]+$")
_OBFUSCATED = re.compile(r"[A-Za-z][@$*0-9!][A-Za-z@$*]")
_STRETCHED = re.compile(r"([A-Za-z!?])\1\1")
_UPPER, _PUNCT, _DIGITS, _SYMBOLS = (bytes(x, "ascii") for x in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", ".,;:!?", "0123456789", "#*$%&|<>@~^"))


def beginnings(word: str) -> list[str]:
    """What of a word may be in the lexicon: itself and its first 3 to 7 letters (marked ^)."""
    return [word, *("^" + word[:n] for n in range(3, min(7, len(word)) + 1))]


def entries(chunk: str) -> set[str]:
    """What of a run without white space may be in the lexicon: the run without its edges, and the words inside it."""
    word = _STRIP.sub("", chunk.lower())
    if not word:
        return set()
    if word.isalnum():
        return set(beginnings(word))
    return {f for part in (word, *_PARTS.findall(word)) for f in beginnings(part)}


def select_entries(counts: list[tuple], without: int | None) -> dict[str, float]:
    """Log-odds of the entries that go with the label; counts are (entry, toxic by fold, clean by fold), one fold left out.

    The first row has the numbers of documents."""
    part = lambda xs: sum(x for k, x in enumerate(xs) if k != without)
    n1, n0 = max(1, part(counts[0][1])), max(1, part(counts[0][2]))
    rated = []
    for entry, toxic, clean in counts[1:]:
        t, c = part(toxic), part(clean)
        odds = float(np.log((t + 0.3) / (n1 + 1)) - np.log((c + 0.3) / (n0 + 1)))
        if t >= MIN_TOXIC_DOCS and odds >= MIN_LOG_ODDS:
            # a support discount: an entry seen in few toxic texts gets less
            rated.append((odds * (1 - 1 / (t**0.5 + 1)), t, entry))
    rated.sort(key=lambda x: (-x[0] * np.log1p(x[1]), x[2]))
    return {entry: odds for odds, _, entry in rated[:LEXICON_SIZE]}


def entry_counts(sample: DataFrame) -> list[tuple]:
    """Document frequencies of the candidate entries of the sample, by fold and label; at most 3 * LEXICON_SIZE rows."""

    def run(batches):
        for pdf in batches:
            found = Counter()
            for text, cell in zip(pdf["text"], 2 * pdf["fold"] + pdf["y"], strict=True):
                own = {f for c in set(text.split()) for f in entries(c)}
                own.add("")  # counts the documents
                found.update((f, int(cell)) for f in own)
            yield pd.DataFrame([(f, cell, n) for (f, cell), n in found.items()], columns=["entry", "cell", "n"])

    cells = sample.select("text", "fold", "y").mapInPandas(run, "entry string, cell int, n long")
    of = lambda y, k: F.coalesce(F.sum(F.when(F.col("cell") == 2 * k + y, F.col("n"))), F.lit(0)).alias(f"c{y}{k}")
    wide = cut(cells.groupBy("entry").agg(*(of(y, k) for y in (0, 1) for k in range(FOLDS))))
    both = [sum((F.col(f"c{y}{k}") for k in range(FOLDS)), F.lit(0)) for y in (0, 1)]
    docs = wide.where("entry = ''").select(*(b.alias(f"n{y}") for y, b in enumerate(both))).first() or (1, 1)
    odds = F.log((both[1] + 0.3) / float(docs[1] + 1)) - F.log((both[0] + 0.3) / float(docs[0] + 1))
    top = wide.where(both[1] >= MIN_TOXIC_DOCS).withColumn("o", odds).where(F.col("o") > MIN_LOG_ODDS / 2).orderBy(F.desc(F.col("o") * F.log1p(both[1])), "entry").limit(3 * LEXICON_SIZE)
    row = lambda r: (r["entry"], [r[f"c1{k}"] for k in range(FOLDS)], [r[f"c0{k}"] for k in range(FOLDS)])
    return [row(r) for r in wide.where("entry = ''").collect()] + [row(r) for r in top.where("entry != ''").collect()]


class Features:
    """Dense features of a text under a lexicon."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = {w: 3.0 for w in INSULTS} | lexicon
        self.fixed, self.you = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self.cache: dict[str, float] = {}

    def _weight(self, chunk: str) -> float:
        get = self.lexicon.get
        out = max((get(f, 0.0) for f in entries(chunk)), default=0.0)
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        self.cache[chunk] = out
        return out

    def __call__(self, text: str) -> list[float]:
        chunks = text.split()
        weights = list(map(self.cache.get, chunks))
        if None in weights:
            weights = [self._weight(c) if x is None else x for c, x in zip(chunks, weights, strict=True)]
        raw = text.encode("utf-8", "surrogatepass")
        n, size = max(1, len(chunks)), max(1, len(raw))
        at = [i for i, x in enumerate(weights) if x]
        near = insult = 0
        kinds: dict[str, float] = {}
        for i in at:
            word = _STRIP.sub("", chunks[i].lower())
            kinds[word] = weights[i]
            insult += word in self.fixed
            near += any(_STRIP.sub("", c.lower()) in self.you for c in chunks[max(0, i - NEAR) : i + NEAR + 1])
        top = sorted(kinds.values(), reverse=True)[:5] + [0.0] * 5
        strong = sum(x > 1.5 for x in kinds.values())
        total = sum(weights[i] for i in at)
        count = lambda chars: (size - len(raw.translate(None, chars))) / size
        return [
            total / n, float(np.log1p(total)), float(len(kinds)), strong, strong / n, top[0], top[1], top[2], sum(top[:5]),
            float(insult), insult / n, near / max(1, len(at)), float(near),
            count(_UPPER), count(_PUNCT), count(b"!"), count(_DIGITS), count(_SYMBOLS),
            len(_OBFUSCATED.findall(text)) / n, len(_STRETCHED.findall(text)) / n, float(np.log1p(len(chunks))), size / n,
        ]


class Model:
    """Trees and calibration; score() gives probabilities."""

    def __init__(self, lexicon: dict, trees: BoostedTrees | None, knots: tuple, constant: float):
        self.lexicon, self.trees, self.knots, self.constant = lexicon, trees, knots, constant

    def score(self, texts: list[str], features: Features) -> np.ndarray:
        if self.trees is None or not texts:
            return np.full(len(texts), self.constant)
        return np.interp(self.trees.margin(np.array([features(t) for t in texts])), *self.knots)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS, parts: int = PARTS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on a bounded sample; the driver gets lexicon counts and feature rows, never texts."""
    sample, weights = labelled_sample(docs, labels, label, parts, held_out, per_class, id_col, text_col)
    sample = sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    counts = entry_counts(sample)
    if not counts:
        return Model({}, None, (), 0.5)
    lexicons = [select_entries(counts, k) for k in range(FOLDS)]  # out of fold

    def run(batches):
        features = [Features(x) for x in lexicons]
        for pdf in batches:
            x = [features[k](t) for t, k in zip(pdf["text"], pdf["fold"], strict=True)]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "fold": pdf["fold"], "y": pdf["y"], "x": x})

    rows = sorted(sample.mapInPandas(run, "doc_id long, fold int, y int, x array<double>").collect(), key=lambda r: r["doc_id"])
    y, fold, x = (np.array([r[c] for r in rows], dtype=float) for c in ("y", "fold", "x"))
    w = np.where(y > 0, weights[1], weights[0])
    if y.min() == y.max():
        return Model({}, None, (), float(y[0]))
    margins = np.zeros(len(y))
    for k in range(FOLDS):  # out-of-fold margins for the calibration
        out = fold == k
        if out.any() and not out.all():
            margins[out] = BoostedTrees().fit(x[~out], y[~out], w[~out]).margin(x[out])
    return Model(select_entries(counts, None), BoostedTrees().fit(x, y, w), isotonic(margins, y, w), 0.5)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, label, id_col=id_col, text_col=text_col)

    def run(batches):
        features = Features(model.lexicon)
        for pdf in batches:
            s = model.score([t or "" for t in pdf["text"]], features)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": s})

    held = F.coalesce(crc_bucket(F.col(id_col).cast("long"), PARTS) == HELD_OUT, F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = d.mapInPandas(_nullable(run), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _nullable(run):
    """Keep integers with nulls as integers through pandas."""

    def wrapped(batches):
        for pdf in run(batches):
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf

    return wrapped
