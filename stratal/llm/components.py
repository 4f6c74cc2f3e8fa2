"""Connected components of a link table by alternating large-star and small-star steps (no links on the driver)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, drop_cut


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges (u, v) written, and a stamp of them that the same write takes: their number and a sum of hashes. A task that
    runs again can spoil a stamp, which costs one more round."""
    seen = Observation()
    stamp = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    out = cut(edges.observe(seen, *stamp))
    return out, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) for every node with a link to another; comp is the smallest node of its component."""
    cur, stamp = _kept(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while stamp[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        last = stamp
        nxt, stamp = _kept(small.distinct())
        drop_cut(large)
        drop_cut(cur)
        cur = nxt
        if stamp == last:
            break
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()


def joined_components(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) after further links (a, b): only the links between components are gone through."""
    of = lambda end: comps.select(F.col("node").alias(end), F.col("comp").alias(f"c_{end}"))
    between = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    between = between.select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a != b").distinct()
    moved = cut(components(between)).select(F.col("node").alias("from"), F.col("comp").alias("to"))
    stay = comps.join(moved, F.col("comp") == F.col("from"), "left").select("node", F.coalesce("to", "comp").alias("comp"))
    new = moved.join(comps.select(F.col("node").alias("from")), "from", "left_anti").select(F.col("from").alias("node"), F.col("to").alias("comp"))
    return stay.unionByName(new)
