"""Language identification by word-first backoff.

A word that training has seen scores by its log frequency in each language. A word it has not seen scores by the mean log
frequency of its longest character n-grams that training knows, tried from MAX_N letters (with a blank on either side of the
word) down to one. A text's score of a language is the mean over its words; the highest wins.

A word is a run of letters with the marks that follow them, lower-cased. Training takes a sample of about PER_LANGUAGE
documents of each language, chosen by a hash of the id, whole texts; their words and n-grams are counted by Spark. A word
counts as known from MIN_DOCS documents on, an n-gram from MIN_TIMES occurrences on, so that junk that stands once is no
feature; longer runs of letters than MAX_WORD are known by their n-grams only. The driver and every worker hold the
counts of that sample, which does not grow with the corpus.

Defined cases: null texts and texts without a letter are "und" with score 0, and so is everything if no row has a language to
learn; null languages and null ids teach nothing; a null doc_id is carried and not held out; a text of letters that training
never saw gets the most frequent language, with that language's share as its score; equal scores go to the more frequent language,
then to the lower code; rows that repeat are scored each; other columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_bucket, cut, small, small_batches

PARTS, HELD_OUT = 3, 1
PER_LANGUAGE = 2000  # documents of a language that training expects to take at most
MAX_N = 5
MAX_WORD = 40
MIN_DOCS = 2
MIN_TIMES = 3
WORD_PARTS = 24  # tasks that count n-grams over the words of the sample
SMOOTHING = 0.1
EVIDENCE = 20.0  # words beyond which the score of a text does not get surer by its length
UNDETERMINED = "und"
CACHE_ENTRIES = 100_000
WORD = r"\p{L}[\p{L}\p{M}]*"
FEATURES = "lang string, n int, gram string, times long"


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with a blank on either side."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def training_rows(docs: DataFrame, per_language: int, parts: int, held_out: int) -> DataFrame:
    """(text, lang) of the sample; docs has doc_id, text, lang."""
    d = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), parts) != held_out))
    share = small(cut(d.groupBy("lang").agg((F.lit(float(per_language)) / F.count(F.lit(1))).alias("share"))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return d.join(share, "lang").where(place < F.col("share")).select("text", "lang")


def word_counts(sample: DataFrame) -> DataFrame:
    """(lang, word, times, docs): how often and in how many documents of the sample each word occurs, by language."""
    import pyarrow as pa

    def run(batches):
        import regex

        find = regex.compile(WORD).findall
        for batch in batches:
            times, docs = Counter(), Counter()
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = Counter(find(text.as_py().lower()))
                for word, k in own.items():
                    times[lang, word] += k
                    docs[lang, word] += 1
            columns = zip(*((*key, k, docs[key]) for key, k in times.items()), strict=True) if times else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "word", "times", "docs"])

    counted = sample.mapInArrow(run, "lang string, word string, times long, docs long").repartition(WORD_PARTS, "word")
    return counted.groupBy("lang", "word").agg(F.sum("times").alias("times"), F.sum("docs").alias("docs"))


def feature_counts(words: DataFrame, max_n: int = MAX_N, max_word: int = MAX_WORD, min_docs: int = MIN_DOCS, min_times: int = MIN_TIMES) -> DataFrame:
    """(lang, n, gram, times) of the known words (n = 0) and n-grams; n-grams are counted over the table of words."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64()]

    def batch_of(found: dict):
        rows = ((*key, g, k) for key, own in found.items() for g, k in own.items())
        columns = zip(*rows, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=["lang", "n", "gram", "times"])

    def run(batches):
        found: dict[tuple[str, int], Counter] = {}
        for batch in batches:
            for lang, word, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for n in range(1, max_n + 1):
                    own = found.setdefault((lang, n), Counter())
                    for g in grams(word, n):
                        own[g] += k
            if sum(map(len, found.values())) > CACHE_ENTRIES:
                yield batch_of(found)
                found = {}
        yield batch_of(found)

    parts = words.select("lang", "word", "times").mapInArrow(run, FEATURES).groupBy("lang", "n", "gram").agg(F.sum("times").alias("times"))
    total = parts.groupBy("n", "gram").agg(F.sum("times").alias("t")).where(F.col("t") >= min_times)
    parts = parts.join(total.select("n", "gram"), ["n", "gram"], "left_semi")
    docs = words.where(F.char_length("word") <= max_word).groupBy("word").agg(F.sum("docs").alias("d")).where(F.col("d") >= min_docs)
    whole = words.join(docs.select("word"), "word", "left_semi").select("lang", F.lit(0).alias("n"), F.col("word").alias("gram"), "times")
    return whole.unionByName(parts.select("lang", "n", "gram", "times"))


class Model:
    """Languages by falling number of training documents, and the log frequencies of words and n-grams."""

    def __init__(self, languages: list[str], shares: np.ndarray, rows: list[tuple], max_n: int = MAX_N, max_word: int = MAX_WORD, smoothing: float = SMOOTHING):
        self.languages, self.shares, self.max_n, self.max_word = languages, shares, max_n, max_word
        self.index: list[dict[str, int]] = [{} for _ in range(max_n + 1)]
        self.logs: list[np.ndarray] = []
        column = {x: i for i, x in enumerate(languages)}
        for n in range(max_n + 1):
            own = [r for r in rows if r[1] == n]
            index = self.index[n]
            for r in own:
                index.setdefault(r[2], len(index))
            counts = np.zeros((len(index), len(languages)))
            for lang, _, gram, times in own:
                counts[index[gram], column[lang]] += times
            total = counts.sum(0, keepdims=True)
            self.logs.append(np.log((counts + smoothing) / (total + smoothing * max(1, len(index)))).astype(np.float32))

    def state(self) -> dict:
        """Plain values, for a broadcast that workers without this package can read."""
        return dict(vars(self))

    @classmethod
    def of(cls, state: dict) -> Model:
        out = cls.__new__(cls)
        vars(out).update(state)
        return out

    def unseen(self, word: str) -> np.ndarray | None:
        """Mean log frequencies of the longest known n-grams of a word; None if it has none."""
        for n in range(min(self.max_n, len(word) + 2), 0, -1):
            at = [i for i in map(self.index[n].get, grams(word, n)) if i is not None]
            if at:
                return self.logs[n][at].mean(0)
        return None


class Scorer:
    """The model in a worker, with a cache of unseen words."""

    def __init__(self, model: Model):
        import regex

        self.model, self.find = model, regex.compile(WORD).findall
        self.cache: dict[str, np.ndarray | None] = {}

    def unseen(self, word: str):
        if word in self.cache:
            return self.cache[word]
        found = self.model.unseen(word)
        if len(word) <= self.model.max_word:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        m = self.model
        counts = Counter(self.find(text.lower())) if text and m.languages else {}
        if not counts:
            return UNDETERMINED, 0.0
        known, rows, times = m.index[0], [], []
        total, score = 0, np.zeros(len(m.languages))
        for word, k in counts.items():
            at = known.get(word)
            if at is not None:
                rows.append(at)
                times.append(k)
                continue
            found = self.unseen(word)
            if found is not None:
                score += k * found
                total += k
        if rows:
            score += np.asarray(times, dtype=np.float64) @ m.logs[0][rows]
            total += sum(times)
        if not total:
            return m.languages[0], float(m.shares[0])
        mean = score / total
        best = int(mean.argmax())
        odds = np.exp((mean - mean[best]) * min(total, EVIDENCE))
        return m.languages[best], float(1 / odds.sum())


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, parts: int = PARTS, held_out: int = HELD_OUT, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sample = cut(training_rows(d, per_language, parts, held_out))
    found = {r["lang"]: r["n"] for r in sample.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = d.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_bucket(F.col("doc_id"), parts) != held_out))
    shares = {r["lang"]: r["n"] for r in seen.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect() if r["lang"] in found}
    languages = sorted(shares, key=lambda x: (-shares[x], x))
    rows = list(feature_counts(cut(word_counts(sample))).toPandas().itertuples(index=False, name=None))
    return Model(languages, np.array([shares[x] for x in languages], dtype=float) / max(1, sum(shares.values())), rows)


def identify_languages(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Without a model, one is trained on docs."""
    spark = docs.sparkSession
    small_batches(spark)
    if model is None:
        model = train(docs, per_language, id_col=id_col, text_col=text_col, lang_col=lang_col)
    sent = spark.sparkContext.broadcast(model.state())  # counts of a bounded sample

    import pyarrow as pa

    def run(batches):
        score = Scorer(Model.of(sent.value))
        for batch in batches:
            found = [score(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(crc_bucket(F.col(id_col).cast("long"), PARTS) == HELD_OUT, F.lit(False))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
