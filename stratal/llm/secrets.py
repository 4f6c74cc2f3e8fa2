"""Secret scans: fixed patterns and a battery of randomness tests. DataFrame operations only.

Base patterns (assign, access, hex) give spans; the battery adds spans of kind ``random``. Candidates are the runs of 20 or
more characters of ``[A-Za-z0-9+/_=-]``. The encoding is inferred from the characters (hex, base32, base36, base62,
base64; all-decimal runs and plain words are no candidates for a finding). Against uniform symbols of that encoding three
tests are made: chi-squared uniformity (Wilson-Hilferty), runs of character classes, and lag-1 serial correlation; a
candidate that any of them rejects (Bonferroni over the three) is not random. Against natural text three more bounds are
made (coincidences of letters, the chance of the narrow alphabet, changes of character class); their Bonferroni minimum is
the p-value of a finding. A weighted Benjamini-Hochberg step-up over all candidates of the corpus, with weights in
proportion to length, controls the share of false findings; it works on a histogram of fixed size.

Defined cases: null text counts as empty; a text without finds has zero counts, the hash of the empty string and empty
spans; a null doc_id is carried; rows repeated whole are scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 12
KINDS = ("assign", "access", "hex", "random")
RANDOM_LEVEL = 0.001  # below it a candidate is not taken for random
FALSE_DISCOVERY = 0.01
COINCIDENCE = 0.066  # chance that two letters of natural text agree
CLASS_CHANGE = 0.12  # chance that neighbours in an identifier differ in class
HEX_LETTERS = 0.32  # share of a to f and digits in natural text
BINS_PER_E, BINS = 4, 2000
CHUNK = 256

ALPHABETS = {  # fixed values
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


def running_ends(lens: str) -> str:
    """SQL for the running sums of the bigint array column lens, in blocks so that long arrays stay near-linear."""
    n = f"CAST(ceil(size({lens}) / {CHUNK}.0) AS INT)"
    sums = f"transform(sequence(0, {n} - 1), c -> aggregate(slice({lens}, c * {CHUNK} + 1, {CHUNK}), 0L, (a, x) -> a + x))"
    bases = f"aggregate({sums}, array(0L), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    block = f"slice(aggregate(slice({lens}, c * {CHUNK} + 1, {CHUNK}), array(b), (a, x) -> concat(a, array(element_at(a, -1) + x))), 2, {CHUNK})"
    return f"CASE WHEN size({lens}) = 0 THEN CAST(array() AS ARRAY<BIGINT>) ELSE flatten(transform(slice({bases}, 1, {n}), (b, c) -> {block})) END"


def located(df: DataFrame, text: str, pattern: str, name: str) -> DataFrame:
    """df with the column name: array of (s, e, v) for the leftmost non-overlapping matches, code points, end exclusive."""
    m, lens, gaps, ends = (f"{name}_{x}" for x in ("m", "lens", "gaps", "ends"))
    df = df.withColumn(m, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    df = df.withColumn(gaps, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    df = df.withColumn(lens, F.expr(f"transform({m}, (x, i) -> CAST(length({gaps}[i]) + length(x) AS BIGINT))"))
    df = df.withColumn(ends, F.expr(running_ends(lens)))
    df = df.withColumn(name, F.expr(f"transform({m}, (x, i) -> named_struct('s', {ends}[i] - length(x), 'e', {ends}[i], 'v', x))"))
    return df.drop(m, lens, gaps, ends)


def _upper_tail(z: Column) -> Column:
    """P(N > z), absolute error below 1e-7 (rational approximation of the error function)."""
    x = F.abs(z) / F.lit(2**0.5)
    t = F.lit(1.0) / (1 + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    tail = F.lit(0.5) * poly * F.exp(-x * x)
    return F.when(z >= 0, tail).otherwise(1 - tail)


def encoding(core: Column) -> Column:
    """Name of the narrowest alphabet that holds the characters."""
    return (
        F.when(core.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(core.rlike("^[A-Z2-7]+$"), "base32")
        .when(core.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36")
        .when(core.rlike("^[0-9A-Za-z]+$"), "base62")
        .otherwise("base64")
    )


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (column v) with p_random (against uniform symbols) and p_natural (against natural text)."""
    core = F.regexp_replace("v", "=+$", "")  # may leave nothing of a ruled line
    t = tokens.withColumn("core", F.translate(core, "-_", "+/")).withColumn("enc", encoding(F.col("core")))
    folded = F.when(F.col("enc").isin("hex", "base36"), F.lower("core")).otherwise(F.col("core"))
    t = t.withColumn("sym", folded).withColumn("n", F.greatest(F.length("core"), F.lit(2)).cast("double"))
    t = t.withColumn("alphabet", F.element_at(F.create_map(*(F.lit(x) for kv in ALPHABETS.items() for x in kv)), F.col("enc")))
    t = t.withColumn("size", F.length("alphabet").cast("double"))
    t = t.withColumn("chars", F.expr("filter(split(sym, ''), c -> c != '')"))
    squares = "aggregate(array_distinct(chars), 0D, (a, c) -> a + pow(length(sym) - length(replace(sym, c, '')), 2))"
    t = t.withColumn("squares", F.expr(squares))
    classes = F.translate("core", ALPHABETS["base64"], "u" * 26 + "l" * 26 + "d" * 10 + "ss")
    t = t.withColumn("classes", F.split(classes, ""))
    t = t.withColumn("changes", F.expr("CAST(size(filter(classes, (c, i) -> i > 0 AND c != '' AND classes[i - 1] != '' AND c != classes[i - 1])) AS DOUBLE)"))
    t = t.withColumn("idx", F.expr("transform(chars, c -> CAST(instr(alphabet, c) AS DOUBLE))"))
    t = t.withColumn("mean", F.expr("aggregate(idx, 0D, (a, x) -> a + x) / n"))
    t = t.withColumn("ss", F.expr("aggregate(idx, 0D, (a, x) -> a + (x - mean) * (x - mean))"))
    t = t.withColumn("lag", F.expr("aggregate(idx, named_struct('p', CAST(NULL AS DOUBLE), 't', 0D), (a, x) -> named_struct('p', x - mean, 't', a.t + coalesce(a.p, 0D) * (x - mean)), a -> a.t)"))
    n, size = F.col("n"), F.col("size")
    chi, df = F.col("squares") * size / n - n, size - 1
    z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df))
    # share of unlike neighbours if symbols are uniform, by the classes of each alphabet
    change = F.element_at(F.create_map(*(F.lit(x) for k, c in {"hex": (10, 6), "base32": (26, 6), "base36": (10, 26), "base62": (10, 26, 26), "base64": (10, 26, 26, 2)}.items() for x in (k, 1 - sum((i / sum(c)) ** 2 for i in c)))), F.col("enc"))
    z_runs = (F.col("changes") - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
    z_serial = F.when(F.col("ss") > 0, F.col("lag") / F.col("ss") * F.sqrt(n)).otherwise(F.sqrt(n))
    both = lambda z: 2 * _upper_tail(F.abs(z))
    p_random = F.least(F.lit(1.0), 3 * F.least(_upper_tail(z_chi), both(z_runs), both(z_serial)))
    pairs = n * (n - 1)
    p_letters = 1 - _upper_tail((F.col("squares") - n - pairs * COINCIDENCE) / F.sqrt(2 * pairs * COINCIDENCE * (1 - COINCIDENCE)))
    p_alphabet = F.when(F.col("enc") == "hex", F.pow(F.lit(HEX_LETTERS), n)).otherwise(F.lit(1.0))
    q = F.least(F.greatest(F.col("changes") / (n - 1), F.lit(CLASS_CHANGE)), F.lit(1 - 1e-9))
    p_classes = F.exp(-(n - 1) * (q * F.log(q / CLASS_CHANGE) + (1 - q) * F.log((1 - q) / (1 - CLASS_CHANGE))))
    plain = F.col("core").rlike("^([0-9]+|[A-Za-z]?[a-z]+|[A-Z]+)$") | (n < 16)
    p_natural = F.when(plain, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 3 * F.least(p_letters, p_alphabet, p_classes)))
    return t.select(*tokens.columns, "n", p_random.alias("p_random"), F.greatest(p_natural, F.lit(1e-200)).alias("p_natural"))


def step_up(tested: DataFrame) -> tuple[float, float]:
    """Mean length of the candidates, and the largest p / weight that the weighted step-up accepts (-1 if none)."""
    about = tested.agg(F.count(F.lit(1)).alias("m"), F.avg("n").alias("mean")).first()
    if not about["m"]:
        return 1.0, -1.0
    score = -F.log(F.col("p_natural") * F.lit(about["mean"]) / F.greatest(F.col("n"), F.lit(1.0)))
    bins = F.least(F.greatest(F.floor(score * BINS_PER_E), F.lit(0)), F.lit(BINS))
    from math import exp

    seen, best = 0, -1.0
    for r in sorted(tested.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("c")).collect(), key=lambda r: -r["b"]):  # <= BINS + 1 rows
        seen += r["c"]
        edge = exp(-r["b"] / BINS_PER_E)  # every p / weight in the bin is at most this (1 for the lowest bin)
        if r["b"] and edge <= FALSE_DISCOVERY * seen / about["m"]:
            best = edge
    return about["mean"], best


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("cand", CANDIDATE)):
        d = located(d, "text", pattern, name)
    long_value = lambda x: F.length(F.regexp_extract(x["v"], ASSIGN, 2)) >= MIN_VALUE
    d = d.withColumn("assign", F.filter("assign", long_value))
    span = lambda k: (lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    base = F.sort_array(F.concat(*(F.transform(name, span(k)) for k, name in enumerate(KINDS[:3]))))
    found = cut(d.select("rid", "doc_id", *(F.size(x).cast("long").alias(f"n_{x}") for x in KINDS[:3]), base.alias("base"), "cand"))
    tested = cut(battery(found.select("rid", F.explode("cand").alias("c")).select("rid", "c.s", "c.e", "c.v")).drop("v"))
    mean, accept = step_up(tested)
    hits = tested.where((F.col("p_random") >= RANDOM_LEVEL) & (F.col("p_natural") * F.lit(mean) / F.col("n") <= F.lit(accept)))
    # the findings of one text, never of several: their number is bounded by its length
    per = hits.groupBy(F.col("rid").alias("h_rid")).agg(F.collect_list(F.struct("s", F.lit(3).alias("k"), "e")).alias("more"))
    joined = found.join(per, F.col("rid") == F.col("h_rid"), "left")
    none = F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")
    named = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))
    return joined.select(
        "doc_id",
        *(f"n_{x}" for x in KINDS[:3]),
        F.size(F.coalesce("more", none)).cast("long").alias("n_random"),
        F.sha2(F.array_join(F.transform("base", named), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(F.sort_array(F.concat("base", F.coalesce("more", none))), named), ",").alias("spans"),
    )
