"""Exact dedup: two-pass Bloom filtering in front of a hash group-by. DataFrame operations only.

Texts are equal when identical after deleting every character of ``[\\x20\\x09-\\x0D]``. Pass one counts, per filter position,
how many rows hash there (two positions a row, both in one block of the filter), and keeps the positions hit twice or more as
bitmaps. Pass two probes every row against the broadcast filter; rows that miss in either position are unique and pass
straight through, the others are grouped by SHA-256 with partial aggregation, so a large group meets as one row per task.

What moves between executors: positions (8 bytes, two a row) in pass one, and the possible repeats in pass two; neither texts
nor bitmaps do in the passes. The filter has 16 bits a row, up to FILTER_BITS in all, which bounds the broadcast. Nothing changes beyond that
size but the share of unique rows that are taken for possible repeats: about 2 % at 16 bits a row, 15 % at 4, 63 % at 1.

Defined cases: null text counts as empty (all empty or blank texts are one group); of equal texts the row with the most
code points, then the smallest doc_id, stays; a null doc_id loses every tie; of rows repeated whole, one stays; an empty
table gives an empty result; other columns, whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, unspaced

BITS_PER_ROW = 16
BLOCK_BITS = 32768  # of one bitmap_construct_agg row
FILTER_BITS = 1 << 30  # at most: 128 MB, whatever the input


def filter_blocks(rows: int, most: int = FILTER_BITS) -> int:
    bits = min(most, 1 << max(1, (BITS_PER_ROW * max(1, rows) - 1).bit_length()))
    return max(1, bits // BLOCK_BITS)


def _block(digest: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(blocks))


def _places(digest: Column) -> list[Column]:
    """Two bits of the row's block, one in each half."""
    half = BLOCK_BITS // 2
    return [(F.pmod(F.xxhash64(digest, F.lit(seg)), F.lit(half)) + F.lit(seg * half)).cast("int") for seg in (0, 1)]


def repeat_filter(digests: DataFrame, digest: str, blocks: int) -> DataFrame:
    """(block, bits): the positions that two or more rows hit."""
    key = F.col(digest)
    both = F.explode(F.array(*(_block(key, blocks) * BLOCK_BITS + p for p in _places(key)))).alias("pos")
    twice = digests.select(both).groupBy("pos").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    block, place = F.floor(F.col("pos") / BLOCK_BITS), F.pmod("pos", F.lit(BLOCK_BITS))
    return twice.groupBy(block.cast("long").alias("block")).agg(F.bitmap_construct_agg(place).alias("bits"))


def probe(df: DataFrame, digest: str, bitmaps: DataFrame, blocks: int, flag: str) -> DataFrame:
    """df with the boolean column flag: may the row's hash repeat?"""
    key = F.col(digest)
    block, bits = fresh(df, "__block"), fresh(df, "__bits")
    side = F.broadcast(bitmaps.select(F.col("block").alias(block), F.col("bits").alias(bits)))
    joined = df.join(side, _block(key, blocks) == F.col(block), "left")
    hit = F.lit(True)
    for at in _places(key):
        byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        hit = hit & F.coalesce(F.call_function("shiftright", byte, F.pmod(at, F.lit(8)).cast("int")).bitwiseAND(1) == 1, F.lit(False))
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), hit.alias(flag))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow table of all rows: rid (row number, fixed by the write), doc_id, n_points, text_sha256."""
    return cut(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_points"),
            F.sha2(unspaced(F.col(text_col)).cast("binary"), 256).alias("text_sha256"),
        )
    )


def mark_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_points."""
    d = digests(docs, id_col, text_col)
    blocks = filter_blocks(d.count(), filter_bits)
    d = probe(d, "text_sha256", cut(repeat_filter(d, "text_sha256", blocks)), blocks, "maybe")
    # bitwise not turns the order round and, unlike a minus, is defined for every id
    best = F.max(F.struct("n_points", F.bitwise_not("doc_id").alias("neg"), F.bitwise_not("rid").alias("nrid")))
    # written out, so that both sides of the join below come from an exchange and a hot hash can be split
    groups = cut(d.where("maybe").groupBy(F.col("text_sha256").alias("g_sha")).agg(F.count(F.lit(1)).alias("g_n"), best.alias("b")))
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "n_points"]
    repeated = (
        d.where("maybe")
        .join(groups, F.col("text_sha256") == F.col("g_sha"))
        .select("doc_id", F.bitwise_not("b.neg").alias("keep_id"), F.col("g_n").alias("group_size"), (F.col("rid") == F.bitwise_not("b.nrid")).alias("kept"), "text_sha256", "n_points")
    )
    alone = d.where("not maybe").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_points")
    return alone.select(out).unionByName(repeated.select(out))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int = FILTER_BITS) -> DataFrame:
    """docs with one row of each group of equal texts; only rows that may repeat are shuffled. Of equal length and id, the row
    with the greatest digest of its JSON stays, whatever the order of the input."""
    sha, flag, row = fresh(docs, "__sha"), fresh(docs, "__maybe"), fresh(docs, "__row")
    hashed = F.sha2(unspaced(F.col(text_col)).cast("binary"), 256)
    keys = cut(docs.select(hashed.alias(sha)))
    blocks = filter_blocks(keys.count(), filter_bits)
    bitmaps = cut(repeat_filter(keys, sha, blocks))
    probed = probe(docs.withColumn(sha, hashed), sha, bitmaps, blocks, flag)
    every = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.sha2(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(every)))), 256)
    order = F.struct(F.length(F.coalesce(F.col(text_col), F.lit(""))), F.bitwise_not(F.col(id_col).cast("long")), whole)
    winners = (
        probed.where(flag)
        .groupBy(sha)
        .agg(F.max_by(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(every))), order).alias(row))
        .select(*(F.col(f"{row}.c{i}").alias(c) for i, c in enumerate(docs.columns)))
    )
    return probed.where(~F.col(flag)).select(*every).union(winners)
