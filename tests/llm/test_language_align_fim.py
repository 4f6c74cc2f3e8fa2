"""Language identification, tokenizer alignment and fill-in-the-middle against versions written out plainly."""

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratal.llm.fill_middle import MARKERS, Runs, fill_in_middle, restored
from stratal.llm.language_id import MAX_N, Model, Scorer, identify_languages, train
from stratal.llm.queries import QUERIES, tokenizer_path
from stratal.llm.token_alignment import ByteSide, PieceSide, align_tokens, link, linked_ids, pair_bound

from .fixtures import LONG, SCHEMA, awkward, table

DATA = "/root/testdata/sf0.01"
TOKENS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def clashing(docs):
    """The columns the operators return, as columns of the input."""
    for name in ("n", "form", "output", "score", "held_out", "lang_pred", "groups", "link_a", "n_links", "batch"):
        docs = docs.withColumn(name, F.lit("x"))
    return docs


# ---- fill-in-the-middle ----------------------------------------------------------------------------------------------


def brute_fim(doc_id, text, seed=42):
    text = text or ""
    tokens = TOKENS.findall(text)
    digest_ = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest_[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    if text == "" or any(x in text for x in MARKERS) or h[2] % 100 >= 50:
        return doc_id, n, "plain", None, None, text
    low, high = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = "".join(tokens[:low]), "".join(tokens[low:high]), "".join(tokens[high:])
    if h[3] % 100 < 80:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_docs(spark):
    texts = ["<P", "a <S> b", "<<P>>", " lead and trail \n", "\x1c\x85  no separators", "𝒜𝒷 𝒸\t\v\f\r\nx", "<M", "P>S>M> <", "a", " ", "x  " * 5000]
    rows = [(100 + 20 * k + i, t, "s") for k in range(12) for i, t in enumerate(texts)]
    return clashing(awkward(spark).unionByName(table(spark, rows)))


def test_fill_in_middle_against_brute_force(spark):
    docs = fim_docs(spark)
    found = fill_in_middle(docs).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:6] for r in found) == Counter(brute_fim(r.doc_id, r.text) for r in docs.collect())
    assert Counter(r.back for r in found) == Counter(r.text or "" for r in docs.collect())
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert Counter(map(tuple, fill_in_middle(docs.repartition(7)).collect())) == Counter(tuple(r)[:6] for r in found)
    assert fill_in_middle(spark.createDataFrame([], SCHEMA)).collect() == []


def test_fill_in_middle_other_settings(spark):
    docs = fim_docs(spark)
    assert {r.form for r in fill_in_middle(docs, rate=0).collect()} == {"plain"}
    marks = ("<|p|>", "<|s|>", "<|m|>")
    found = fill_in_middle(docs, seed=7, markers=marks, rate=100, spm=0, block=3).withColumn("back", restored(F.col("output"), F.col("form"), marks)).collect()
    assert Counter(r.back for r in found) == Counter(r.text or "" for r in docs.collect())
    assert {r.form for r in found} == {"plain", "psm"} and all((r.form == "plain") == (r.output == "") for r in found)
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "ac", "ad"), ("<P>", "[S]", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, markers=bad)


@pytest.mark.parametrize("block", [0, 1, 3])
def test_runs_against_lists_of_units(block):
    for text in ("", " ", "a", "ab cd  e", "  ab\t", "abcdefg  \n\n\n hij", LONG[:5000]):
        units = TOKENS.findall(text)
        if block:
            units = [r[i : i + block] for r in re.findall(r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", text) for i in range(0, len(r), block)]
        runs = Runs(text, block)
        assert runs.n == len(units)
        assert [runs.offset(k) for k in range(len(units) + 1)] == [len("".join(units[:k])) for k in range(len(units) + 1)]


# ---- languages -------------------------------------------------------------------------------------------------------


def plain_words(text):
    out, word = [], ""
    for c in text.lower() + " ":
        kind = unicodedata.category(c)[0]
        if kind == "L" or (kind == "M" and word):
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out


def brute_model(rows):
    """Counts by language of words and n-grams of (text, lang)."""
    words, docs, grams = Counter(), Counter(), Counter()
    for text, lang in rows:
        own = Counter(plain_words(text))
        words.update({(lang, w): k for w, k in own.items()})
        docs.update(own.keys())
        for w, k in own.items():
            for n in range(1, MAX_N + 1):
                for i in range(len(w) + 3 - n):
                    grams[lang, n, f" {w} "[i : i + n]] += k
    total = Counter()
    for (_, n, g), k in grams.items():
        total[n, g] += k
    known = {("", 0, ""): 0}
    known = {(lang, 0, w): k for (lang, w), k in words.items() if docs[w] >= 2 and len(w) <= 40}
    return known | {(lang, n, g): k for (lang, n, g), k in grams.items() if total[n, g] >= 3}


def brute_language(text, counts, languages):
    vocabulary = {n: {g for _, m, g in counts if m == n} for n in range(MAX_N + 1)}
    sums = {(lang, n): sum(k for (x, m, _), k in counts.items() if x == lang and m == n) for lang in languages for n in range(MAX_N + 1)}
    log = lambda lang, n, g: math.log((counts.get((lang, n, g), 0) + 0.1) / (sums[lang, n] + 0.1 * max(1, len(vocabulary[n]))))
    words, total, score = plain_words(text or ""), 0, dict.fromkeys(languages, 0.0)
    if not words:
        return "und", None
    for w in words:
        found = [(0, w)] if w in vocabulary[0] else []
        for n in range(MAX_N, 0, -1):
            if not found:
                found = [(n, f" {w} "[i : i + n]) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] in vocabulary[n]]
        if found:
            total += 1
            for lang in languages:
                score[lang] += sum(log(lang, n, g) for n, g in found) / len(found)
    return (max(languages, key=lambda x: score[x]) if total else languages[0]), {x: score[x] / total for x in languages} if total else None


SAMPLE = [("the cat and the dog and the house", "en"), ("the house of the cat", "en"), ("the bird and a tree", "en"), ("der Hund und die Katze", "de"), ("die Katze und das Haus", "de"), ("el perro y la casa", "es"), ("la casa y el gato", "es")]


def test_language_scores_against_brute_force(spark):
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in zip(ids, SAMPLE, strict=False)]
    more = ["the dogs", "Katzen", "casas y perros", "ÜBER den Häusern", "中文字符", "123 !!", "½²", "", None, "x" * 5000, "été casa", "zzz qqq", LONG]
    rows += [(1000 + i, t, None, "s", 1) for i, t in enumerate(more)] + [(None, "the cat", "fr", "s", 1), (None, None, None, None, None)]
    docs = clashing(spark.createDataFrame(rows, SCHEMA))
    counts = brute_model(SAMPLE)
    languages = sorted({x for _, x in SAMPLE}, key=lambda x: (-sum(y == x for _, y in SAMPLE), x))
    found = identify_languages(docs).collect()
    assert len(found) == len(rows)
    want = Counter((r[0], brute_language(r[1], counts, languages)[0]) for r in rows)
    assert Counter((r.doc_id, r.lang_pred) for r in found) == want
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in found)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    model = train(docs)
    score = Scorer(Model.of(model.state()))
    for text in more:
        best, mean = brute_language(text, counts, languages)
        if mean:
            words = [w for w in plain_words(text) if w in model.index[0] or model.unseen(w) is not None]
            odds = sum(math.exp((mean[x] - mean[best]) * min(len(words), 20)) for x in languages)
            assert score(text)[1] == pytest.approx(1 / odds, rel=1e-4)


def test_language_without_training_rows(spark):
    docs = awkward(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in identify_languages(docs).collect()} == {("und", 0.0)}
    assert identify_languages(spark.createDataFrame([], SCHEMA)).collect() == []
    assert {r.lang_pred for r in identify_languages(clashing(awkward(spark))).collect()} == {"en", "und"}


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = identify_languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.99 * len(found) > 300
    # languages of rows that are held out teach nothing
    other = docs.withColumn("lang", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"), "xx").otherwise(F.col("lang")))
    again = {r.doc_id: tuple(r) for r in identify_languages(other).collect()}
    assert all(tuple(r)[:4] == again[r.doc_id] for r in found)


# ---- two tokenizers --------------------------------------------------------------------------------------------------


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    out, counts = [], Counter()
    for doc_id, text in rows:
        a = one.encode(" " + (text or ""), add_special_tokens=False).ids
        b = two.encode(text or "")
        of_a, of_b = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a], [piece(i) for i in b]
        if not text or b"".join(of_a) != (" " + text).encode() or b"".join(of_b) != (" " + text).encode():
            out.append((doc_id, 0, 0, 0, [], ""))
            continue
        ends = lambda xs: [sum(map(len, xs[: i + 1])) for i in range(len(xs))]
        ends_a, ends_b = ends(of_a), ends(of_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(x, y) for x, e in zip(a, ends_a, strict=True) for y, f in zip(b, ends_b, strict=True) if e == f]
        inside = lambda ids, at, lo, hi: ",".join(str(x) for x, e in zip(ids, at, strict=True) if lo < e <= hi)
        shown = ";".join(f"{inside(a, ends_a, lo, hi)}|{inside(b, ends_b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts, strict=False))
        out.append((doc_id, len(a), len(b), len(cuts), links, shown))
        counts.update(links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return [(d, na, nb, g, len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), shown) for d, na, nb, g, x, shown in out]


def token_docs(spark):
    texts = ["<|endoftext|> <s></s><unk><0x0A>", "a▁b", "ﬁ ½ ㎏", "日本語 テスト 🙂🙃 𝒜", "\x00\x01\x7f", "tabs\t\tand\r\n\r\nlines  ", " lead", "  　x", "é", "don't we're 1234567 a1b2", "zzzzzzzzzzzzzzzzzzzzqqqq" * 20]
    return clashing(awkward(spark).where("doc_id != 7 AND doc_id != 8 OR doc_id IS NULL").unionByName(table(spark, [(50 + i, t, "s") for i, t in enumerate(texts * 2)])))


def test_alignment_against_brute_force(spark):
    docs = token_docs(spark)
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 1500 AND doc_id < 60").select("doc_id", "text")
    docs = docs.select("doc_id", "text").unionByName(real)
    want = Counter(brute_alignment([(r.doc_id, r.text) for r in docs.collect()]))
    run = lambda d: Counter(map(tuple, align_tokens(d, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).collect()))
    assert run(docs) == want
    assert run(docs.repartition(5)) == want
    assert any(x[0] == 51 and x[1:7] == (0, 0, 0, 0, 0, 0) for x in want)


def test_alignment_edges(spark):
    a, b = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    assert align_tokens(spark.createDataFrame([], SCHEMA), a, b).collect() == []
    found = align_tokens(clashing(awkward(spark)), a, b).collect()
    assert len(found) == 12 and all(r.n_a and r.n_b and r.n_links == r.n_groups for r in found if r.doc_id not in (4, 5))
    assert [tuple(r)[1:] for r in found if r.doc_id in (4, 5)] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_links_with_tokens_of_no_bytes():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = (np.cumsum(rng.integers(0, 4, rng.integers(1, 12))) for _ in range(2))
        at, to = link(a, b, np.intersect1d(a, b))
        assert sorted(zip(at.tolist(), to.tolist(), strict=True)) == [(i, j) for i in range(len(a)) for j in range(len(b)) if a[i] == b[j]]


def test_links_of_groups_with_tokens_of_no_bytes():
    a, b = np.array([1, 0, 2, 1]), np.array([3, 0, 0, 1])  # id 0 has no bytes; ends 1, 1, 3, 4 and 3, 3, 3, 4
    lengths = np.array([0, 1, 2, 3]), np.array([0, 1, 2, 3])
    at, to, group = linked_ids(a, b, np.array([3, 1]), np.array([3, 1]), lengths)
    assert sorted(zip(group.tolist(), at.tolist(), to.tolist(), strict=True)) == [(0, 2, 0), (0, 2, 0), (0, 2, 3), (1, 1, 1)]


def test_encoder_by_rank_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        side = ByteSide(f.read())
    assert side.fast is not None
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rng = np.random.default_rng(3)
    texts = ["".join(chr(c) for c in rng.choice([*range(0xD800), *range(0xE000, 0x20000), *[32] * 40000, *range(97, 123)], 60)) for _ in range(500)]
    assert [side.encode(t).tolist() for t in texts] == [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_pair_bound():
    assert pair_bound([b"a", b"ba", b"c"], [b"a", b"cba"]) == 4  # a-a, ba-a, a-cba, ba-cba
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f, open(tokenizer_path("piece_bpe_32k.model"), "rb") as g:
        assert pair_bound(ByteSide(f.read()).bytes, PieceSide(g.read()).bytes) < 500_000


def test_alignment_query_carries_digests(spark):
    found = QUERIES["op12_token_alignment"](spark, "/root/testdata/sf0.001")
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found.where("n_a > 0 AND length(groups_sha256) != 64 OR n_a = 0 AND groups_sha256 != ''").count() == 0
