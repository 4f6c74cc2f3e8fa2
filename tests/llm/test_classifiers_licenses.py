import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratal.llm.licenses import PHRASES, PRIORITY, Scanner, rules, scan_licenses
from stratal.llm.quality_mil import keep_good, score_quality
from stratal.llm.toxicity import score_toxicity
from stratal.llm.training import BoostedTrees, isotonic

from .fixtures import SCHEMA, awkward, table

DATA = "/root/testdata/sf0.01"


def brute_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in low + " ":
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    places, labels = [], set()
    for label, phrase in PHRASES:
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_docs(spark):
    rows = [
        (1, "Released under the MIT License.", "a"),
        (2, "mit, LICENSE and the éMIT License; mit licenses. The mit-license! 'Apache\nLicense'", "a"),
        (3, "GNU Lesser General Public License v2.1 and General  Public -- License", "a"),
        (4, "SPDX-License-Identifier: Apache-2.0 // Licensed under the Apache License, Version 2.0 (the License)", "a"),
        (5, "https://creativecommons.org/licenses/by-nc/4.0/ Creative Commons Attribution NonCommercial 4.0", "b"),
        (6, "Mit license mit License " * 300, "b"),
    ]
    return awkward(spark).unionByName(table(spark, rows)).withColumn("labels", F.lit(1)).withColumn("score", F.lit("x"))


def test_license_base_against_brute_force(spark):
    docs = license_docs(spark)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in scan_licenses(docs).collect())
    assert got == Counter((r.doc_id, *brute_base(r.text)) for r in docs.collect())
    for r in scan_licenses(docs).collect():
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []


def test_license_rules():
    assert len(rules()) >= 200
    scan = Scanner()
    labels = lambda t: scan(t)[5]
    assert labels("Licensed under the Apache License, Version 2.0.") == "apache,apache-2.0"
    assert labels("Licensed under CC BY-NC 4.0.") == "cc-by-nc-4.0"
    assert labels("This work is licensed under the GNU General Public License, version 3.") == "gpl,gpl-3.0"
    assert labels("the mitten licence of omit") == ""
    # a grant contains its mention and address; what a detection of its priority or above contains is not reported
    for text in ("Licensed under the MIT License", "GNU Lesser General Public License v2.1", "SPDX-License-Identifier: MIT"):
        found = scan.detections(text.lower())
        for a in found:
            assert not any(b is not a and b[0] <= a[0] and b[1] >= a[1] and PRIORITY[b[3]] >= PRIORITY[a[3]] for b in found)


def sample(parsed, rng):
    """A random string of a parsed pattern; lookarounds count as empty."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = rng.choice(arg)
            out += {"LITERAL": lambda: chr(value), "RANGE": lambda: chr(value[0]), "CATEGORY": lambda: "1" if "DIGIT" in str(value) else " "}[str(kind)]()
        elif name == "ANY":
            out += "x"
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, body = arg
            out += "".join(sample(body, rng) for _ in range(rng.randint(low, min(high, low + 1))))
        elif name == "SUBPATTERN":
            out += sample(arg[3], rng)
        elif name == "BRANCH":
            out += sample(rng.choice(arg[1]), rng)
        else:
            assert name in ("ASSERT", "ASSERT_NOT"), name
    return out


def test_every_alternative_of_a_license_rule_has_a_keyword():
    rng = random.Random(0)
    missing = set()
    for label, kind, keys, pattern in rules():
        for _ in range(150):
            text = " ".join(sample(re._parser.parse(pattern.pattern), rng).split()).lower()
            if not any(key in text for key in keys.split("|")):
                missing.add((label, kind, text))
    assert not missing, sorted(missing)[:9]
    scan = Scanner()
    for text in ("licensed under the Expat license", "the MIT open source license"):
        assert scan(text)[5] == "mit" and scan(text)[6] >= 0.75


def test_wrapped_names_and_spdx_expressions():
    scan = Scanner()
    labels = lambda t: set(scan(t)[5].split(","))
    assert "gpl-2.0" in labels("GNU General Public\nLicense, version 2")
    assert "mpl-2.0" in labels("under the Mozilla  Public\r\n   License 2.0")
    assert labels("SPDX-License-Identifier: GPL-3.0-only") == {"gpl-3.0"}
    assert labels("SPDX-License-Identifier: LGPL-2.1-or-later\n") == {"lgpl-2.1-or-later"}
    assert labels("SPDX-License-Identifier: AGPL-3.0-only") == {"agpl-3.0"}
    assert labels("SPDX-License-Identifier: MIT OR Apache-2.0") == {"mit", "apache-2.0"}
    assert labels("SPDX-License-Identifier: (GPL-2.0+ WITH mit) AND (ISC OR x-1)") == {"gpl-2.0-or-later", "isc"}
    text = "a  b\n\n c  Mozilla  Public\n  License   2.0  and  the\tISC  License ."
    places = {label: text[s:e] for s, e, label, _ in scan.detections(text.lower())}
    assert places == {"mpl-2.0": "Mozilla  Public\n  License   2.0", "isc": "ISC  License"}


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def held_out(spark, out, label, parts, value):
    rows = out.toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert len(rows) == docs.count()
    want = rows["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % parts == value)
    assert (rows["held_out"] == want).all() and rows["score"].between(0, 1).all()
    lab = spark.read.parquet(f"{DATA}/labels.parquet").toPandas()
    return rows[rows.held_out].merge(lab, on="doc_id"), rows


def test_quality_held_out_accuracy(spark):
    docs, lab = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    m, rows = held_out(spark, score_quality(docs, lab), "quality", 3, 1)
    assert ((rows.score >= 0.5).astype(int) == rows.predicted).all()
    assert auc(m.score.to_numpy(), m.quality.to_numpy()) > 0.97 and (m.predicted == m.quality).mean() > 0.95


def test_toxicity_held_out_accuracy(spark):
    docs, lab = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    m, rows = held_out(spark, score_toxicity(docs, lab), "toxic", 4, 2)
    assert ((rows.score >= 0.3).astype(int) == rows.predicted).all()
    assert auc(m.score.to_numpy(), m.toxic.to_numpy()) > 0.85


def test_held_out_labels_are_not_used(spark):
    docs, lab = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    bucket = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    flipped = lab.withColumn("quality", F.when(bucket == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id, r.score) for r in score_quality(docs, x).collect()) for x in (lab, flipped))
    assert [i for i, _ in a] == [i for i, _ in b] and np.allclose([s for _, s in a], [s for _, s in b])


@pytest.mark.parametrize("op", [score_quality, score_toxicity])
def test_scores_on_awkward_tables(spark, op):
    docs = awkward(spark).withColumn("score", F.lit("x")).withColumn("y", F.lit(1))
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (7, 0, 1), (8, 1, 0), (9, None, None), (None, 1, 1), (1, 0, 0), (12, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (some, some.limit(0), some.where("doc_id = 3")):
        rows = op(docs, lab).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert op(spark.createDataFrame([], SCHEMA), some).collect() == []


def test_keep_good_keeps_columns_and_good_rows(spark):
    docs, lab = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit(1)), spark.read.parquet(f"{DATA}/labels.parquet")
    out = keep_good(docs, lab)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    want = {r.doc_id for r in score_quality(docs.drop("score"), lab).collect() if r.predicted}
    assert kept == want


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    m = BoostedTrees().fit(x, y, np.ones(len(y)))
    assert auc(m.margin(x), y) > 0.98
    knots = isotonic(m.margin(x), y, np.ones(len(y)))
    assert (np.diff(knots[0]) >= 0).all() and (np.diff(knots[1]) >= 0).all() and 0 < knots[1].min() and knots[1].max() < 1


def test_attention_against_loops_and_numeric_gradient():
    from stratal.llm.quality_mil import AttentionModel

    rng = np.random.default_rng(4)
    model = AttentionModel(5)
    sizes = [1, 4, 2, 7]
    bags = [rng.normal(size=(n, 5)) for n in sizes]
    y, w = np.array([1.0, 0.0, 0.0, 1.0]), np.array([0.1, 0.4, 0.2, 0.3])

    def naive(bag):
        p = model.p
        h = [np.tanh(x @ p["E"] + p["e"]) for x in bag]
        z = [sum(np.tanh(v @ p["V"]) * (1 / (1 + np.exp(-(v @ p["U"])))) * p["w"]) for v in h]
        a = np.exp(z) / np.exp(z).sum()
        return 1 / (1 + np.exp(-(sum(k * v for k, v in zip(a, h, strict=True)) @ p["c"] + p["d"][0])))

    assert np.allclose(model.score(bags), [naive(b) for b in bags])
    loss = lambda: -sum(v * (t * np.log(naive(b)) + (1 - t) * np.log(1 - naive(b))) for v, t, b in zip(w, y, bags, strict=True))
    starts, bag = np.cumsum([0, *sizes[:-1]]), np.repeat(np.arange(4), sizes)
    for k, g in model._gradient(np.concatenate(bags), starts, bag, y, w).items():
        for _ in range(6):
            at = tuple(int(rng.integers(n)) for n in model.p[k].shape)
            kept = model.p[k][at]
            model.p[k][at] = kept + 1e-5
            up = loss()
            model.p[k][at] = kept - 1e-5
            down = loss()
            model.p[k][at] = kept
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6, k


def test_bags_cover_every_passage():
    from stratal.llm.quality_mil import BAG, PASSAGE, passage_features, passages

    words = [f"w{i % 97}" for i in range(PASSAGE * (3 * BAG + 5) + 7)]
    every = np.array([passage_features(words[i : i + PASSAGE]) for i in range(0, len(words), PASSAGE)])
    bag = np.array(passages(" ".join(words)))
    assert len(bag) == BAG and len(passages(" ".join(words[: PASSAGE * BAG]))) == BAG
    sizes = [len(x) for x in np.array_split(every, BAG)]
    assert np.allclose(np.average(bag, axis=0, weights=sizes), every.mean(0))


def test_toxicity_features_against_loops():
    from stratal.llm.toxicity import INSULTS, NEAR, Features, entries

    features = Features({"^zzt": 2.0, "qux": 1.0})
    assert features("you idiot")[0] == 1.5 and features("a" * 60 + "qux")[0] == 0
    for chunk in ("x/idiot.y", "IDIOT!!", "it-is-zztop", "(zztop)", "a" * 50 + "-qux"):
        assert features(chunk)[2] == 1.0, chunk
    assert "a" * 50 in entries("a" * 50)
    rng = random.Random(3)
    for _ in range(50):
        chunks = [rng.choice(["you", "idiot", "fine", "QUX", "zzta", "ok!", "st@r", "soooo"]) for _ in range(rng.randrange(1, 30))]
        x = features(" ".join(chunks))
        weight = {"idiot": 3.0, "QUX": 1.0, "zzta": 2.0}
        at = [i for i, c in enumerate(chunks) if c in weight]
        near = sum("you" in chunks[max(0, i - NEAR) : i + NEAR + 1] for i in at)
        assert x[0] == sum(weight[chunks[i]] for i in at) / len(chunks)
        assert x[9] == sum(chunks[i] in INSULTS for i in at) and x[12] == near and x[2] == len({chunks[i] for i in at})
        assert x[18] == sum(c == "st@r" for c in chunks) / len(chunks) and x[19] == sum(c == "soooo" for c in chunks) / len(chunks)


def test_every_passage_of_a_long_text_is_a_row_of_its_bag():
    from stratal.llm.quality_mil import BAG, PASSAGE, every_passage, passage_features

    words = [f"w{i}" for i in range(PASSAGE * (BAG + 40))]
    words[PASSAGE * 70 : PASSAGE * 71] = ["!!!"] * PASSAGE
    bag = every_passage(" ".join(words))
    assert len(bag) == BAG + 40 and bag[70] == passage_features(["!!!"] * PASSAGE)
