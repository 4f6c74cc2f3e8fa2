"""N-gram Jaccard join by parity sketches.

A document's set are its distinct k-word shingles. Documents with one set form a class; classes are joined. In each size
band the tokens of a set are dealt over segments, and each token toggles the bits of its 64-bit hash in its segment, so the
number of unlike segments is at most the symmetric difference. Linked sets differ in at most r tokens, so of r + 1 + e
segments at least e + 1 agree: classes that share a segment of a band are candidates. (Empty segments say little; a class
with at most e of them leaves them out, by which no pair is lost.) Band widths are such that the larger partner of a link
lies in the same band or the next, so a set is sketched for its own band and the one below.

Of a bucket only what connects is asked for, never all its pairs: first every class is checked against its best bucket
leader, then classes of different components against their nearest neighbours, then every pair of a bucket that still
spans components and that sizes and a plain bit sketch (Hamming distance, again a lower bound) allow. Buckets are compared in
blocks, every surviving pair is verified on the whole sets, and a link between any two classes joins their components.

Sets are compared by 64-bit shingle hashes. Defined cases: null or blank text has no set and no links (component_id is its
doc_id); fewer words than k: the whole sequence is one shingle; only A-Z are lower-cased; null doc_ids are carried and
ignored in the smallest id; rows repeated whole fall into one class; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil, exp, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, fresh, small, small_batches
from .components import components, joined_components

SHINGLE, PERCENT = 3, 90
BLOCK = 512  # members of a bucket that are compared with as many others at once
SEEN = 200_000  # sets a worker remembers so as not to emit the sketches of copies
WIDE_FROM = 1500  # sets of this size on have the wide bit sketch
BITS, WIDE_BITS = 512, 4096
NEAREST_ROUNDS = 2
FILTER_BITS = 1 << 26  # of the filter of documents that are read again: 8 MB, whatever the input
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    h = np.zeros(len(w) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = _mix(h * _M1 + w[i : len(w) - k + 1 + i] + np.uint64(i + 1))
    return np.unique(h)


def bands(percent: int) -> list[int]:
    """First size of each band, up to 2**40."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * 100 // percent + 1)
    return out


def segments(percent: int, low: int, high: int) -> tuple[int, int]:
    """Segments of the band of sizes low to high, and how many of them beyond r + 1 (so many empty ones may be left out)."""
    r = (100 - percent) * (high + high * 100 // percent) // (100 + percent)
    if r == 0:
        return 0, 0  # only equal sets are linked
    e = 1
    for _ in range(4):
        empty = (r + 1 + e) * exp(-low / (r + 1 + e))
        e = 1 + ceil(empty + 2 * sqrt(empty))
    return r + 1 + e, e


def band_table(percent: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """First sizes of the bands, and the segments() of each."""
    starts = bands(percent)
    return np.array(starts), [segments(percent, low, after - 1) for low, after in zip(starts, starts[1:], strict=False)]


def sketch_keys(h: np.ndarray, band: int, parts: int, spare: int) -> np.ndarray:
    """Keys of the band's segments."""
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    at = ((h >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    seg = np.zeros(parts, dtype=np.uint64)
    np.bitwise_xor.at(seg, at, _mix(h + _M1))
    full = np.bincount(at, minlength=parts) > 0
    keys = _mix(seg ^ _mix(np.arange(parts, dtype=np.uint64) + np.full(1, band, dtype=np.uint64) * _M1))
    return keys[full] if (~full).sum() <= spare else keys


def bit_sketch(h: np.ndarray) -> bytes:
    """One bit toggled by each token."""
    bits = WIDE_BITS if len(h) >= WIDE_FROM else BITS
    at = ((h >> np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1).tobytes()


def _sketcher(k: int, percent: int):
    names = ["doc_id", "n", "node", "sketch", "own", "keys", "text_id"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.int64()]

    starts, cut_into = band_table(percent)

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            cols: list[list] = [[] for _ in names[:-1]]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingles(text, k)
                row: tuple = (doc_id, len(h), None, None, 0, None)
                if len(h):
                    node = int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)))
                    row = (doc_id, len(h), node, None, 0, None)
                    if node not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        band = int(np.searchsorted(starts, len(h), side="right")) - 1
                        own = sketch_keys(h, band, *cut_into[band])
                        below = sketch_keys(h, band - 1, *cut_into[band - 1]) if band else own[:0]
                        row = (doc_id, len(h), node, bit_sketch(h), len(own), np.concatenate([own, below]).view(np.int64))
                for c, x in zip(cols, row, strict=True):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, type=t) for c, t in zip(cols, kinds[:-1], strict=True)), batch.column(2)], names=names)

    return run


def text_id(text: Column) -> Column:
    return F.xxhash64(text.cast("string"))


def sketched(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, node, sketch, own, keys, text_id); keys are null where the worker had the set before."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), text_id(F.col(text_col)).alias("text_id"))
    return narrow.mapInArrow(_sketcher(k, percent), "doc_id long, n long, node long, sketch binary, own int, keys array<bigint>, text_id long")


def bucket_rows(table: DataFrame) -> DataFrame:
    """(key, node, leader) of the buckets with two or more classes, one of them of the bucket's own band. Leaders come from
    partial aggregation, so no task sorts a bucket."""
    rows = table.where("keys IS NOT NULL").select("node", "own", F.posexplode("keys").alias("pos", "key")).select("key", "node", (F.col("pos") >= F.col("own")).alias("above"))
    ends = rows.groupBy("key").agg(F.min(F.when(~F.col("above"), F.col("node"))).alias("leader"), F.min("node").alias("lo"), F.max("node").alias("hi"))
    wanted = cut(ends.where("leader IS NOT NULL AND lo != hi").select("key", "leader"))
    members = cut(rows.select("key", "node").join(wanted, "key").distinct())
    drop_cut(wanted)
    return members


def _checked(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """_verified(), written; the sets and the filter that it reads are removed then."""
    sets, bitmap, links = _verified(docs, reps, pairs, k, percent, id_col, text_col)
    out = cut(links)
    drop_cut(sets)
    drop_cut(bitmap)
    return out


def _verified(docs: DataFrame, reps: DataFrame, pairs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The written sets and filter, and of them those pairs (a, b) whose whole sets are similar enough. Only documents that stand for a class in pairs are read again."""
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(reps, "node").select("rep")
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bitmap = cut(wanted.select(spot("rep").alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bit = F.bitmap_bit_position(spot("doc_id"))
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    d = d.join(F.broadcast(bitmap), F.bitmap_bucket_number(spot("doc_id")) == F.col("bucket")).where(F.call_function("shiftright", byte, F.pmod(bit, F.lit(8)).cast("int")).bitwiseAND(1) == 1)

    def run(batches):
        for batch in batches:
            ids, nodes, sets = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = shingles(text, k)
                if len(h):
                    ids.append(doc_id)
                    nodes.append(int(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes())).view(np.int64)))
                    sets.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "node", "items"])

    # written, so that both sides of the joins come from an exchange and a class of many pairs can be split
    sets = cut(d.select("doc_id", "text").mapInArrow(run, "doc_id long, node long, items array<bigint>").groupBy("node").agg(F.first("items").alias("items")))
    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    links = joined.select("a", "b", both.alias("i"), (F.size("x") + F.size("y") - both).alias("u")).where(100 * F.col("i") >= percent * F.col("u")).select("a", "b")
    return sets, bitmap, links


def _across(percent: int, nearest: bool):
    """Pairs of a bucket's block that lie in different components and may be linked; with nearest, one per member."""

    def compare(g: dict) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.flatnonzero(g["side"] != 1), np.flatnonzero(g["side"] != 0)
        out_a, out_b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        if not len(left) or not len(right):
            return out_a[0], out_b[0]
        wide = np.array([len(s) for s in g["sketch"]])
        for width in np.unique(wide):
            rows, cols = left[wide[left] == width], right
            sk_cols = np.frombuffer(b"".join(s if len(s) == width else bytes(width) for s in g["sketch"][cols]), dtype=np.uint64).reshape(len(cols), -1)
            same_width = wide[cols] == width
            step = max(1, (1 << 22) // max(1, len(cols) * (width // 8)))
            for at in range(0, len(rows), step):
                r = rows[at : at + step]
                sk = np.frombuffer(b"".join(g["sketch"][r]), dtype=np.uint64).reshape(len(r), -1)
                far = np.bitwise_count(sk[:, None, :] ^ sk_cols[None, :, :]).sum(axis=2, dtype=np.int64)
                far[:, ~same_width] = 0
                total = g["n"][r][:, None] + g["n"][cols][None, :]
                gap = np.abs(g["n"][r][:, None] - g["n"][cols][None, :])
                ok = (np.maximum(far, gap) * (100 + percent) <= (100 - percent) * total) & (g["comp"][r][:, None] != g["comp"][cols][None, :])
                if nearest:
                    far = np.where(ok, far, 1 << 40)
                    best = far.argmin(axis=1)
                    hit = ok[np.arange(len(r)), best]
                    out_a.append(g["node"][r[hit]])
                    out_b.append(g["node"][cols[best[hit]]])
                else:
                    i, j = np.nonzero(ok)
                    out_a.append(g["node"][r[i]])
                    out_b.append(g["node"][cols[j]])
        return np.concatenate(out_a), np.concatenate(out_b)

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        cols = {c: pdf[c].to_numpy() for c in pdf.columns}
        edges = np.flatnonzero(np.diff(cols["grp"])) + 1
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for lo, hi in zip([0, *edges], [*edges, len(pdf)], strict=True):
            if hi - lo > 1:
                x, y = compare({c: v[lo:hi] for c, v in cols.items()})
                a.append(x)
                b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        return pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y)}).drop_duplicates()

    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            last = pdf["grp"].to_numpy() == pdf["grp"].iloc[-1]
            rest = pdf[last].reset_index(drop=True)
            yield groups(pdf[~last])
        if rest is not None:
            yield groups(rest)

    return run


def _spanning(members: DataFrame, comps: DataFrame, about: DataFrame, tested: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Candidate pairs (a, b), not tested yet, of the buckets that span components, written. Members of a bucket's largest component are compared with
    the others only: rows grow with the members times the blocks of those others."""
    placed = members.select("key", "node").join(comps, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    open_ = cut(placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key"))
    placed = cut(placed.join(open_, "key"))
    drop_cut(open_)
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    per_key = sizes.groupBy("key").agg(F.sum("n_comp").alias("m"), F.max(F.struct("n_comp", "comp")).alias("x"))
    per_key = cut(per_key.select("key", F.col("x.comp").alias("most"), F.ceil(F.col("x.n_comp") / BLOCK).cast("int").alias("nb_most"), F.ceil((F.col("m") - F.col("x.n_comp")) / BLOCK).cast("int").alias("nb_rest")))
    rows = placed.join(per_key, "key").join(about, "node").withColumn("is_most", F.col("comp") == F.col("most"))
    h = F.xxhash64("node")
    rows = rows.withColumn("blk", F.when(F.col("is_most"), F.pmod(h, F.col("nb_most"))).otherwise(F.pmod(h, F.col("nb_rest"))).cast("int"))
    block = lambda kind, i, j, side: F.struct(F.xxhash64("key", F.lit(kind), i, j).alias("grp"), side.cast("int").alias("side"))
    own = lambda o: block(0, F.least("blk", o), F.greatest("blk", o), F.when(F.col("blk") == o, 2).when(F.col("blk") < o, 0).otherwise(1))
    to_rest, to_most = F.sequence(F.lit(0), F.col("nb_rest") - 1), F.sequence(F.lit(0), F.col("nb_most") - 1)
    dealt = F.when(F.col("is_most"), F.transform(to_rest, lambda o: block(1, o, F.col("blk"), F.lit(1)))).otherwise(
        F.concat(F.transform(to_rest, own), F.transform(to_most, lambda o: block(1, F.col("blk"), o, F.lit(0))))
    )
    rows = rows.select("node", "comp", "n", "sketch", F.explode(dealt).alias("x")).select("x.grp", "node", "comp", "n", "sketch", "x.side")
    found = rows.repartition("grp").sortWithinPartitions("grp").mapInPandas(_across(percent, nearest), "a long, b long").distinct()
    out = cut(found.join(tested, ["a", "b"], "left_anti"))
    drop_cut(placed)
    drop_cut(per_key)
    return out


def jaccard_components(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id, text_id."""
    small_batches(docs.sparkSession)
    table = cut(sketched(docs, k, percent, id_col, text_col))
    members = bucket_rows(table)
    reps = cut(table.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")))
    about = table.where("keys IS NOT NULL").select("node", "n", "sketch").dropDuplicates(["node"])
    votes = members.where("node != leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    best = votes.groupBy("node").agg(F.max(F.struct("c", (-F.col("leader")).alias("l"))).alias("x")).select("node", (-F.col("x.l")).alias("leader"))
    pairs = cut(best.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct())
    tested, comps = pairs, cut(components(_checked(docs, reps, pairs, k, percent, id_col, text_col)))
    for step in range(NEAREST_ROUNDS + 1):
        pairs = _spanning(members, comps, about, tested, percent, nearest=step < NEAREST_ROUNDS)
        if pairs.isEmpty():
            if step == NEAREST_ROUNDS:
                break
            continue
        tested, comps = tested.unionByName(pairs), cut(joined_components(comps, _checked(docs, reps, pairs, k, percent, id_col, text_col)))
    drop_cut(members)
    owned = reps.join(comps, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "rep")
    lowest = owned.groupBy("comp").agg(F.min("rep").alias("component"))
    named = cut(owned.join(lowest, "comp").select("node", "component"))
    out = table.select("doc_id", F.col("n").alias("n_shingles"), "node", "text_id").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.col("node").alias("class_id"), "text_id")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose doc_id is not the smallest of their component. Texts without words are linked with
    nothing and stay; so do rows with a null doc_id, and every row that repeats the doc_id and text that stay. Of rows that
    share a doc_id but not the text each is judged for itself. Columns are those of docs."""
    found = jaccard_components(docs, k, percent, id_col, text_col)
    name, text = fresh(docs, "__gone"), fresh(docs, "__text")
    gone = cut(found.where("doc_id != component_id").select(F.col("doc_id").alias(name), F.col("text_id").alias(text)).distinct())
    return docs.join(small(gone), (F.col(f"`{id_col}`").cast("long") == F.col(name)) & (text_id(F.col(f"`{text_col}`")) == F.col(text)), "left_anti")
