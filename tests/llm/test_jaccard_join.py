import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratal.llm import jaccard_join as jj
from stratal.llm.jaccard_join import drop_near_duplicates, jaccard_components

from .fixtures import SCHEMA, awkward, table


def sets(text, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows, k, percent):
    s = [sets(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            inter = len(s[i] & s[j])
            if inter and 100 * inter >= percent * (len(s[i]) + len(s[j]) - inter):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return Counter((d, len(s[i]), low.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows))


def family_rows(seed):
    """Families of near copies around the threshold, of many sizes, with copies and chains."""
    rng = random.Random(seed)
    rows, n = [], 1000
    for size in (3, 5, 9, 12, 20, 40, 90, 200, 420, 1900):
        for _ in range(2):
            base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(12):
                own = list(base)
                for _ in range(rng.choice((0, 0, 1, 1, 2, 3, max(1, size // 40), max(1, size // 20)))):
                    at = rng.randrange(len(own))
                    rng.choice((lambda: own.__setitem__(at, f"x{rng.randrange(10**6)}"), lambda: own.insert(at, "ins"), lambda: own.append("tail%d" % rng.randrange(9))))()
                rows.append((n, " ".join(own), "s"))
                n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_components_against_brute_force(spark, k, percent, monkeypatch):
    monkeypatch.setattr(jj, "BLOCK", 5)  # buckets in several blocks
    docs = awkward(spark).unionByName(table(spark, family_rows(k))).withColumn("node", F.lit(1)).withColumn("Keys", F.lit("k"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs, k, percent).collect())
    assert got == want


def test_one_of_each_group_stays(spark):
    docs = table(spark, family_rows(9))
    want = {c for _, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == sorted(want)


def test_rows_that_share_an_id_are_judged_each(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = table(spark, [(1, a, "s"), (5, a, "s"), (5, b, "s"), (7, b, "s")])
    assert sorted((r.doc_id, r.text[0]) for r in drop_near_duplicates(docs).collect()) == [(1, "a"), (5, "b")]


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(1)
    for percent in (90, 80):
        starts, cut_into = jj.band_table(percent)
        for size in (1, 2, 5, 9, 10, 11, 19, 33, 64, 150, 151, 400, 1200):
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
                r = 2 * len(a) * (100 - percent) // (100 + percent)
                drop = rng.integers(0, r + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 2**63, rng.integers(0, r - drop + 1), dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if len(b) == 0 or 100 * inter < percent * (len(a) + len(b) - inter) or np.array_equal(a, b):
                    continue
                lo, hi = sorted((a, b), key=len)
                band = int(np.searchsorted(starts, len(lo), side="right")) - 1
                top = int(np.searchsorted(starts, len(hi), side="right")) - 1
                assert top in (band, band + 1)
                assert np.intersect1d(jj.sketch_keys(a, band, *cut_into[band]), jj.sketch_keys(b, band, *cut_into[band])).size


def test_whole_sets_and_buckets_are_removed_when_they_were_read(spark, monkeypatch):
    import os

    written, plain = [], jj.cut
    monkeypatch.setattr(jj, "cut", lambda df, *a: written.append((made := plain(df, *a), made.inputFiles())) or made)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(words[:58] + [f"x{i}", f"y{i}"])) for i in range(6)], "doc_id long, text string")
    found = jaccard_components(docs, 3, 80)
    assert {r["component_id"] for r in found.collect()} == {0}
    kept = [set(df.columns) for df, files in written if any(os.path.exists(f.removeprefix("file://")) for f in files)]
    assert kept and not [c for c in kept if "items" in c or "bits" in c or c == {"key", "node"}]
