"""Mixing sources to target weights by Efraimidis-Spirakis sampling. DataFrame operations only.

Each source gets a target number of words: weights 5, 2, 1 repeat over the sources in code point order (null last) and
share 150 % of all words; no target exceeds twice its source, what is above goes to the others by weight. Whole epochs
come first; the rest of a target is filled in the order of keys -ln(u)/w, where u is a uniform hash of the id and w the
document's quality weight, by a prefix sum of sizes. The prefix sum runs over buckets of the key first (about the square
root of a source's rows), then inside each bucket, so that no source meets in one task.

Defined cases: null text counts as empty (size 0, nothing taken); a null source is a source of its own; ties of the key
go by doc_id, null ids first; rows repeated whole count each; an empty table gives an empty result; the result depends
only on the rows, not on their partitions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh, words

WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """Narrow rows (doc_id, source, size, weight, key)."""
    w = words(F.col(text_col))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), w.alias("w"), *keep)
    counted = base.select("doc_id", "source", F.size("w").cast("long").alias("size"), F.size(F.array_distinct("w")).cast("long").alias("kinds"), *keep)
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10)
    return counted.select(
        "doc_id",
        "source",
        "size",
        F.when(F.col("size") > 0, F.lit(0.1) + F.lit(0.9) * (F.col("kinds") / F.col("size"))).otherwise(F.lit(0.1)).alias("weight"),
        ((unit.cast("double") + 0.5) / float(2**48)).alias("u"),
        *keep,
    ).withColumn("key", -F.log("u") / F.col("weight"))


def placed(df: DataFrame, *order) -> DataFrame:
    """df in that order: mid rises with it, pid is the range that a row lies in. Sorted by ranges, not in one task."""
    rows = cut(df.orderBy(*order).withColumn("mid", F.monotonically_increasing_id()))
    return rows.withColumn("pid", F.shiftright("mid", 33))


def running(rows: DataFrame, *columns: str) -> DataFrame:
    """placed() rows with before_<column>, the sum over the rows before: inside a range, and over whole ranges."""
    sums = rows.groupBy("pid").agg(*(F.sum(c).alias(c) for c in columns))  # a row a range
    ranges = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("pid").alias("b_pid"), *(F.coalesce(F.sum(c).over(ranges), F.lit(0)).alias(f"base_{c}") for c in columns))
    inside = Window.partitionBy("pid").orderBy("mid").rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.join(F.broadcast(bases), F.col("pid") == F.col("b_pid"))
    return joined.select(*rows.columns, *((F.col(f"base_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"before_{c}") for c in columns))


def targets(sized: DataFrame) -> DataFrame:
    """A row per source: its size, rows, mean weight and target. Water-filling in closed form over the sorted ratios."""
    by_name = (F.col("source").isNull(), F.col("source"))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"), F.avg("weight").alias("mean_weight"))
    ranked = running(placed(per.withColumn("one", F.lit(1)), *by_name), "one").drop("mid", "pid", "one")
    share = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("before_one", F.lit(len(WEIGHTS))) + 1).cast("int"))
    rated = ranked.withColumn("share", share).withColumn("cap", F.col("source_size") * MAX_EPOCHS)
    rated = running(placed(rated, F.col("cap") / F.col("share"), *by_name), "cap", "share")
    words_, shares = (x or 0 for x in rated.agg(F.sum("source_size"), F.sum("share")).first())
    level = (F.lit(TOTAL_SHARE) * F.lit(words_) - F.col("before_cap")) / (F.lit(shares) - F.col("before_share"))
    # the first source, by ratio, that stays below its cap fixes the level for itself and all after it
    rated = cut(rated.withColumn("level", level))
    first = rated.where(F.col("level") * F.col("share") <= F.col("cap")).agg(F.min(F.struct("mid", "level")).alias("x")).first()["x"]
    cap = F.col("cap").cast("double")
    target = F.when(F.col("mid") >= first["mid"], F.least(F.lit(first["level"]) * F.col("share"), cap)).otherwise(cap) if first else cap
    return rated.select("source", "source_size", "rows", "mean_weight", target.alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, key, epochs, quota, before, taken.

    epochs: whole copies; quota: words that remain for the fractional part of the source; before: words of the source
    with smaller keys; taken: epochs * size plus the part of the document that lies below the quota.
    """
    sized = cut(sizes(docs, id_col, text_col, source_col, keep))
    per = cut(targets(sized))
    few = per.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = sized.join(F.broadcast(per) if few else per, sized["source"].eqNullSafe(per["source"])).drop(per["source"])
    n = F.ceil(F.sqrt("rows"))
    bucket = F.least(n - 1, F.floor(n * (1 - F.exp(-F.col("key") * F.col("mean_weight"))))).alias("bucket")
    placed = joined.select("*", bucket, F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source_key"))
    sums = placed.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"))
    over_buckets = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(over_buckets), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source_key", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(offsets, ["source_key", "bucket"]).withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    quota = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), F.col("quota") - F.col("before")))
    return ranked.withColumn("epochs", epochs).withColumn("quota", quota).withColumn("taken", F.col("epochs") * F.col("size") + part).drop("source_key", "bucket", "start", "mean_weight", "rows", "u")


def row_parts(docs: DataFrame) -> list:
    """What a hash of the whole row takes in. A hash function skips nulls, so the places of nulls are a part of their own, and
    nested values, maps too, stand as JSON."""
    plain = lambda f: F.col(f"`{f.name}`")
    nested = lambda f: f.dataType.typeName() in ("map", "array", "struct", "variant")
    nulls = F.concat(F.lit(""), *(F.when(plain(f).isNull(), "0").otherwise("1") for f in docs.schema))
    return [nulls, *(F.to_json(F.struct(plain(f).alias("v"))) if nested(f) else plain(f) for f in docs.schema)]


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row repeated as often as the mix takes it, whole: a document across a quota's end is taken when
    at least half of it lies below. Columns are those of docs."""
    rid, copies = fresh(docs, "__rid"), fresh(docs, "__copies")
    # a 128-bit hash of the whole row names it: the same however often the input is read
    every = row_parts(docs)
    keyed = docs.withColumn(rid, F.concat(F.hex(F.xxhash64(*every)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *every))))
    plan = mix_plan(keyed, id_col, text_col, source_col, keep=(rid,))
    half = F.col("before") + F.floor((F.col("size") + 1) / 2) <= F.col("quota")
    copy = F.col("epochs") + F.when(half & (F.col("size") > 0), 1).otherwise(0)
    # rows repeated whole share rid: their copies are added up and dealt to one row of them
    wanted = plan.groupBy(rid).agg(F.sum(copy).alias(copies)).where(F.col(copies) > 0)
    one = keyed.dropDuplicates([rid])
    out = one.join(wanted, rid)
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*(f"`{c}`" for c in docs.columns))
