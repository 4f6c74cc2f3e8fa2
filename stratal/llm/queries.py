"""The queries opN_<name> over the whole tables, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import mark_exact_duplicates
from .fill_middle import fill_in_middle, restored
from .jaccard_join import jaccard_components
from .language_id import identify_languages
from .licenses import scan_licenses
from .mixing import mix_plan
from .packing import pack
from .quality_mil import score_quality
from .quality_rules import GRID_STEPS, LENGTH_BANDS, LEVEL, MAX_REPEAT_PERCENT, MIN_WORDS, RISK, RULES, SYMBOLS, grid, judge
from .secrets import find_secrets
from .substring_dedup import repeated_passages
from .token_alignment import align_tokens
from .toxicity import score_toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_exact_duplicates(documents(spark, sf_dir)).drop("n_points")


OP1_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
r AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
             first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), labels(spark, sf_dir))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, source, len(w)::BIGINT AS size, len(list_distinct(w))::BIGINT AS kinds,
             ((('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT)::DOUBLE + 0.5) / 281474976710656.0::DOUBLE AS u FROM w),
k AS (SELECT *, -ln(u) / (CASE WHEN size > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * (kinds::DOUBLE / size::DOUBLE) ELSE 0.1::DOUBLE END) AS key FROM s),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
q AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1] AS share, 2 * source_size AS cap FROM p),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / share, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
              / (sum(share) OVER (ORDER BY cap::DOUBLE / share, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM q),
f AS (SELECT *, min(CASE WHEN level * share <= cap THEN cap::DOUBLE / share END) OVER () AS first_open FROM l),
t AS (SELECT source, source_size, CASE WHEN cap::DOUBLE / share >= first_open
             THEN least((SELECT min(level) FROM f AS g WHERE g.cap::DOUBLE / g.share = g.first_open AND g.level * g.share <= g.cap) * share, cap::DOUBLE) ELSE cap::DOUBLE END AS target FROM f),
j AS (SELECT k.doc_id, k.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
             coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + least(size, greatest(0, floor(target - epochs * source_size + 0.5)::BIGINT - before)))::BIGINT AS taken FROM j"""


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir)).drop("class_id", "text_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), labels(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(documents(spark, sf_dir), labels(spark, sf_dir))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(documents(spark, sf_dir))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(documents(spark, sf_dir))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = align_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    shown = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", shown.alias("groups_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(documents(spark, sf_dir))
    text = restored(F.col("output"), F.col("form"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(text, 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[ 	-]*[^ 	-]+|[ 	-]+') AS w,
                  sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT doc_id, text, w, len(w)::BIGINT AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
                  WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:a], '') AS prefix, array_to_string(w[a + 1:b], '') AS middle, array_to_string(w[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_source_mix": op4_source_mix,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_toxicity": op8_toxicity,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_language_id": op11_language_id,
    "op12_token_alignment": op12_token_alignment,
    "op13_fill_in_middle": op13_fill_in_middle,
}

OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id != b.doc_id
      JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 90 * (na.n + nb.n - count(*))),
c AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM c WHERE c.a = d.doc_id) AS component_id
FROM documents AS d LEFT JOIN n ON n.doc_id = d.doc_id"""

OP6_SQL = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS tri FROM w),
t AS (SELECT rid, unnest(tri) AS g, generate_subscripts(tri, 1) AS i FROM l),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM t),
r AS (SELECT rid, count(DISTINCT i + d) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY rid),
m AS (SELECT l.doc_id, coalesce('=' || lang, '') || '/' || (CASE WHEN len(w) >= {LENGTH_BANDS[0]} THEN 1 ELSE 0 END + CASE WHEN len(w) >= {LENGTH_BANDS[1]} THEN 1 ELSE 0 END) AS stratum,
             len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '{SYMBOLS}'))::BIGINT AS n_symbols,
             len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM l LEFT JOIN r ON r.rid = l.rid),
v AS (SELECT *, [n_symbols / greatest(n_words, 1)::DOUBLE, n_dup_lines / greatest(n_lines, 1)::DOUBLE, n_repeat_words / greatest(n_words, 1)::DOUBLE,
                 word_chars / greatest(n_words, 1)::DOUBLE, greatest(n_words, 1)::DOUBLE / greatest(word_chars, 1)::DOUBLE] AS rates FROM m),
g AS (SELECT unnest(range(1, 6)) AS rule, unnest([{", ".join(str([f"{x!r}" for x in grid(name)]).replace("'", "") + "::DOUBLE[]" for name in RULES)}]) AS cuts),
good AS (SELECT stratum, rates FROM v WHERE doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING max(quality) = 1)),
k AS (SELECT stratum, rule, step, any_value(cuts) AS cuts, count(*) AS n, count(*) FILTER (rates[rule] > cuts[step]) AS k FROM good, g, (SELECT unnest(range(1, {GRID_STEPS} + 1)) AS step) GROUP BY ALL),
p AS (SELECT *, CASE WHEN k < n * {RISK} THEN least(1.0, list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({RISK}) + (n - j) * ln(1.0 - {RISK}))))) ELSE 1.0 END AS p_value FROM k),
f AS (SELECT stratum, rule, any_value(cuts) AS cuts, coalesce(min(step) FILTER (p_value > {LEVEL} / (5 * (SELECT count(DISTINCT stratum) FROM good))), {GRID_STEPS} + 1) AS failed FROM p GROUP BY stratum, rule),
c AS (SELECT stratum, rule, cuts[failed - 1] AS cutoff FROM f WHERE failed > 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND NOT EXISTS (SELECT 1 FROM c WHERE c.stratum = v.stratum AND v.rates[c.rule] > c.cutoff) AS kept, stratum
FROM v"""

ORACLES: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op4_source_mix": OP4_SQL, "op5_jaccard_join": OP5_SQL, "op6_quality_rules": OP6_SQL, "op13_fill_in_middle": OP13_SQL}
