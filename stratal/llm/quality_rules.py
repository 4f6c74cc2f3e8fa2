"""Quality rules with risk-controlled thresholds. DataFrame operations only.

Per text: counts of words, symbols, repeated lines and words in repeated 3-word windows. Five rates come from them, each
with a fixed grid of cutoffs from lax to strict. The labelled rows are the hold-out (the grids are fixed beforehand, so
nothing else is fitted): in each stratum (language and length band) a cutoff is certified when the exact binomial tail
P(X <= rejected good rows), X ~ Bin(good rows, RISK), is at most LEVEL / (rules x strata). Cutoffs are tested in order and
testing stops at the first failure, so the correction (Bonferroni over rules and strata, fixed sequence within) bounds the
chance that any chosen cutoff rejects more than RISK of a stratum's good documents by LEVEL. The strictest certified cutoff
is used; without enough labels a rule stays off.

Defined cases: null or blank text has no words and fails the base rule; null language is a stratum of its own; several
labels of a document count as good if any is; labels without a document are not used; a null doc_id has no label; rows
repeated whole are judged each; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_WS, cut, small, unspaced, words

RISK = 0.02
LEVEL = 0.05
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
LENGTH_BANDS = (100, 400)
MAX_TERMS = 5000  # of a binomial tail; what lies beyond is bounded by a geometric series
GRID_STEPS = 24

# rate, laxest and strictest cutoff: a text is rejected when its rate is above
RULES = {
    "symbol_rate": (4.0, 0.02),
    "dup_line_share": (0.95, 0.05),
    "repeat_share": (0.95, 0.05),
    "mean_word_chars": (40.0, 8.0),
    "short_words": (0.9, 0.3),
}


def grid(rule: str) -> list[float]:
    lax, strict = RULES[rule]
    return [lax * (strict / lax) ** (i / (GRID_STEPS - 1)) for i in range(GRID_STEPS)]


def metrics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", keep: tuple = ()) -> DataFrame:
    """Narrow rows: doc_id, stratum, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lang = F.coalesce(F.concat(F.lit("="), F.col(lang_col).cast("string")), F.lit("")) if lang_col else F.lit("")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang.alias("lang_key"), text.alias("text"), words(F.col(text_col)).alias("w"), *keep)
    d = d.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(NOT_WS)))
    d = d.withColumn("n", F.size("w")).withColumn("nb", F.ceil(F.log2(F.size("w") + 2)).cast("int"))
    # windows as longs (hash above, position below), so that equal hashes meet in a primitive sort
    packed = "CASE WHEN n >= 3 THEN sort_array(transform(sequence(0, n - 3), i -> shiftleft(xxhash64(w[i], w[i + 1], w[i + 2]), nb) | CAST(i AS BIGINT))) ELSE CAST(array() AS ARRAY<BIGINT>) END"
    d = d.withColumn("packed", F.expr(packed))
    twice = "filter(packed, (x, i) -> shiftright(x, nb) = shiftright(get(packed, i - 1), nb) OR shiftright(x, nb) = shiftright(get(packed, i + 1), nb))"
    d = d.withColumn("maybe", F.expr(f"transform({twice}, x -> CAST(x & (shiftleft(1L, nb) - 1) AS INT))"))
    # the words themselves decide
    d = d.withColumn("exact", F.expr("sort_array(transform(maybe, p -> named_struct('t', concat_ws(' ', w[p], w[p + 1], w[p + 2]), 'p', p)))"))
    d = d.withColumn("at", F.expr("sort_array(transform(filter(exact, (x, i) -> x.t = get(exact, i - 1).t OR x.t = get(exact, i + 1).t), x -> x.p))"))
    covered = "aggregate(at, named_struct('c', 0L, 'e', 0L), (a, p) -> named_struct('c', a.c + p + 3 - greatest(a.e, CAST(p AS BIGINT)), 'e', p + 3L), a -> a.c)"
    return d.select(
        "doc_id",
        F.concat("lang_key", F.lit("/"), sum((F.when(F.size("w") >= b, 1).otherwise(0) for b in LENGTH_BANDS), F.lit(0)).cast("string")).alias("stratum"),
        F.col("n").cast("long").alias("n_words"),
        F.length(unspaced(F.col("text"))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        *keep,
    )


def rates() -> dict:
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "symbol_rate": F.col("n_symbols") / n,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
        "repeat_share": F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "short_words": n / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
    }


def _log_factorial(x):
    x = x.cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(F.lit(6.283185307179586) * x) + F.lit(1.0) / (12 * x) - F.lit(1.0) / (360 * x * x * x) + F.lit(1.0) / (1260 * x * x * x * x * x)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(n, k, p: float):
    """P(X <= k) for X ~ Bin(n, p), exact to rounding where k < n p, 1 elsewhere. n and k are long columns."""
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1.0 - p))
    ratio = lambda j: j * F.lit(1.0 - p) / ((n - j + 1) * F.lit(p))  # noqa: E731  of the term at j - 1 to that at j
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    step = lambda a, i: F.struct((a["term"] * ratio(k - i)).alias("term"), (a["total"] + a["term"] * ratio(k - i)).alias("total"))
    steps = F.when(k > 0, F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(MAX_TERMS)) - 1)).otherwise(F.array().cast("array<bigint>"))
    rest = F.when(k > MAX_TERMS, F.lit(1.0) / (1 - ratio(k))).otherwise(F.lit(0.0))
    total = F.aggregate(steps, zero, step, lambda a: a["total"] + a["term"] * rest)
    return F.when(k.cast("double") < n * F.lit(p), F.least(F.lit(1.0), F.exp(top) * total)).otherwise(F.lit(1.0))


def thresholds(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """A row per stratum with labels: the certified cutoff of each rule, null where none is."""
    good = labels.groupBy(F.col(id_col).cast("long").alias("g_id")).agg(F.max(label_col).alias("good")).where("good = 1").select("g_id")
    held = measured.join(good, F.col("doc_id") == F.col("g_id"), "left_semi")
    # how many cutoffs of the grid, from the lax end, the row passes
    passes = [F.struct(F.lit(name).alias("rule"), sum((F.when(rate <= c, 1).otherwise(0) for c in grid(name)), F.lit(0)).alias("passed")) for name, rate in rates().items()]
    counts = held.select("stratum", F.explode(F.array(*passes)).alias("x")).groupBy("stratum", "x.rule", "x.passed").agg(F.count(F.lit(1)).alias("c"))
    profile = counts.groupBy("stratum", "rule").agg(F.sum("c").alias("n"), F.map_from_entries(F.collect_list(F.struct("passed", "c"))).alias("by"))  # <= GRID_STEPS + 1 entries
    profile = cut(profile)
    strata = max(1, profile.select("stratum").distinct().count())
    tested = profile.withColumn("alpha", F.lit(level / (len(RULES) * strata))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(GRID_STEPS))))
    below = F.aggregate(F.filter(F.map_entries("by"), lambda e: e["key"] < F.col("step")), F.lit(0).cast("long"), lambda a, e: a + e["value"])
    tested = tested.withColumn("k", below).withColumn("p_value", binomial_tail(F.col("n"), F.col("k"), risk))
    firsts = tested.groupBy("stratum", "rule").agg(F.coalesce(F.min(F.when(F.col("p_value") > F.col("alpha"), F.col("step"))), F.lit(GRID_STEPS + 1)).alias("failed"))
    cutoff = {name: F.max(F.when((F.col("rule") == name) & (F.col("failed") > 1), F.element_at(F.array(*map(F.lit, grid(name))), F.greatest(F.col("failed") - 1, F.lit(1))))) for name in RULES}
    return firsts.groupBy("stratum").agg(*(c.alias(f"cut_{name}") for name, c in cutoff.items()))


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per row of docs: the counts, base_failed, kept and the stratum."""
    measured = cut(metrics(docs, id_col, text_col, lang_col))
    cuts = cut(thresholds(measured, labels, id_col, label_col, risk, level).withColumnRenamed("stratum", "cut_stratum"))
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rejected = reduce(lambda a, b: a | b, (F.coalesce(rate > F.col(f"cut_{name}"), F.lit(False)) for name, rate in rates().items()))
    joined = measured.join(small(cuts), F.col("stratum") == F.col("cut_stratum"), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejected).alias("kept"), "stratum")
