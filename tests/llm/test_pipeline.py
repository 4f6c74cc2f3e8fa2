import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as cp
from stratal.llm.queries import QUERIES, documents, labels

from .fixtures import SCHEMA, awkward
from .test_dedup_mix_pack import WS, water_fill
from .test_jaccard_join import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = documents(spark, SF).cache()
    columns = docs.columns
    good = cp.quality(spark, docs, SF).cache()
    assert good.columns == columns
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    lab = {r.doc_id: r.quality for r in labels(spark, SF).collect()}
    assert sum(i in kept for i, v in lab.items() if v) >= 0.97 * sum(lab.values())

    exact = cp.exact(spark, good, SF).cache()
    groups = defaultdict(list)
    for r in good.collect():
        groups[WS.sub("", r.text or "")].append((len(r.text or ""), -r.doc_id))
    assert exact.columns == columns and {r.doc_id for r in exact.collect()} == {-max(g)[1] for g in groups.values()}

    near = cp.near(spark, exact, SF).cache()
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in exact.collect()], 5, 80)}
    assert near.columns == columns and Counter(r.doc_id for r in near.collect()) == Counter(want)

    mixed = cp.mix(spark, near, SF).cache()
    assert mixed.columns == columns
    size, source, by = {}, {}, defaultdict(int)
    for r in near.collect():
        size[r.doc_id], source[r.doc_id] = len([w for w in WS.split(r.text or "") if w]), r.source
        by[r.source] += size[r.doc_id]
    taken, copies = defaultdict(int), Counter(r.doc_id for r in mixed.collect())
    for i, n in copies.items():
        assert n <= 2
        taken[source[i]] += n * size[i]
    for s, t in water_fill(dict(by)).items():
        assert abs(taken[s] - t) <= max(size[i] for i in size if source[i] == s) / 2 + 1

    packed = cp.packed(spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies
    bins = defaultdict(int)
    for r in packed:
        bins[r.sequence_id] += r.length
    assert max(bins.values()) <= 2048


def test_run_is_the_stages_in_order(spark):
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "exact_dedup", "ngram_jaccard_join", "source_mix", "best_fit_packing"]
    rows = cp.run(spark, SF).collect()
    docs = documents(spark, SF)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, rows)) == Counter(map(key, docs.collect()))


def test_stages_on_awkward_and_empty_tables(spark):
    extra = awkward(spark).withColumn("score", F.lit(1)).withColumn("kept", F.lit("x"))
    for docs in (extra, spark.createDataFrame([], SCHEMA)):
        for _, stage in cp.STAGES[:-1]:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert docs.columns == columns
        cp.STAGES[-1][1](spark, docs, SF).collect()


def test_every_operator_is_registered():
    random.seed(0)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
