"""Column expressions of the data model: CURIE parts, hashes, prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEPARATOR = "\x1e"


def prefix_of(iri) -> Column:
    """Text before the first colon."""
    return F.substring_index(iri, ":", 1)


def local_name_of(iri) -> Column:
    iri = F.col(iri) if isinstance(iri, str) else iri
    return iri.substr(F.instr(iri, ":") + 1, F.length(iri))


def content_hash(canonical) -> Column:
    return F.sha2(canonical, 256)


def short_hash(h) -> Column:
    return F.substring(h, 1, 12)


def literal_text(value, datatype=None, lang=None) -> Column:
    """"v"^^datatype or "v"@lang."""
    return F.concat(F.lit('"'), value, F.lit('"@'), lang) if lang is not None else F.concat(F.lit('"'), value, F.lit('"^^'), datatype)


def json_text(text) -> Column:
    """Text as a JSON string, as in stored axioms: non-ASCII characters as they are."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.to_json(F.struct(text.alias("v")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def json_string(text) -> Column:
    """Text as a JSON string with non-ASCII escaped, as in the canonical form (characters beyond the BMP as two units)."""
    plain = json_text(text)
    escape = lambda c: F.when(c <= "~", c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", "\\\\u$1"))
    return F.when(plain.rlike("^[\\x00-\\x7e]*$"), plain).otherwise(F.array_join(F.transform(F.split(plain, ""), escape), ""))


def selection_content_hash(items: DataFrame) -> DataFrame:
    """One row: the order-independent 16-digit hash of the items, and how many there are. The hash is over the sorted items
    in turn, so one task streams through them; it never holds them all."""

    def run(batches):
        import hashlib

        import pandas as pd

        h, size = hashlib.sha256(), 0
        for pdf in batches:
            for x in pdf["item"]:
                h.update((SEPARATOR * bool(size) + x).encode())
                size += 1
        yield pd.DataFrame({"hash": [h.hexdigest()[:16]], "size": [size]})

    hashed = items.select("item").distinct().repartition(1).sortWithinPartitions("item").mapInPandas(run, "hash string, size long")
    none = F.substring(F.sha2(F.lit(""), 256), 1, 16)
    return hashed.agg(F.coalesce(F.max("hash"), none).alias("hash"), F.coalesce(F.max("size"), F.lit(0)).alias("size"))


GROUP_DIGITS = 4


def _common(a: str, b: str) -> Column:
    """Digits that two hex columns share from the start; 0 where one is null."""
    return F.coalesce(F.expr(f"aggregate(sequence(1, length({a})), 0, (n, i) -> CASE WHEN n = i - 1 AND substr({a}, i, 1) = substr({b}, i, 1) THEN i ELSE n END)"), F.lit(0))


def disambiguating_prefixes(hashes: DataFrame) -> DataFrame:
    """(hash, prefix): the shortest prefix of each distinct hash that no other has; the whole hash if it is alone.

    Neighbours in hash order decide. Hashes that share their first GROUP_DIGITS digits are ordered together, so the order is
    made by many tasks; what a hash shares with other groups is at most their first digits, and there are at most 65536 groups.
    Hashes travel as bytes, once: repeats and neighbours are found where the groups are dealt to. Other texts stay as they are.
    """
    raw = F.when(F.col("hash").rlike("^([0-9a-f]{2})*$"), F.unhex("hash"))
    packed = hashes.select(F.substring("hash", 1, GROUP_DIGITS).alias("g"), raw.alias("raw"), F.when(raw.isNull(), F.col("hash")).alias("rest"))
    h = packed.repartition("g").dropDuplicates(["g", "raw", "rest"]).select(F.coalesce(F.lower(F.hex("raw")), F.col("rest")).alias("hash"), "g")
    w = Window.partitionBy("g").orderBy("hash")
    near = h.withColumn("prev", F.lag("hash").over(w)).withColumn("next", F.lead("hash").over(w))
    near = near.withColumn("inside", F.greatest(_common("hash", "prev"), _common("hash", "next")))
    order = Window.orderBy("o_g")
    groups = packed.select(F.col("g").alias("o_g")).distinct().withColumn("before", F.lag("o_g").over(order)).withColumn("after", F.lead("o_g").over(order))
    groups = groups.select("o_g", F.greatest(_common("o_g", "before"), _common("o_g", "after")).alias("outside"), (F.col("before").isNull() & F.col("after").isNull()).alias("only"))
    near = near.join(F.broadcast(groups), F.col("g") == F.col("o_g"))  # a closed number of rows
    alone = F.col("only") & F.col("prev").isNull() & F.col("next").isNull()
    lcp = F.when(F.col("prev").isNotNull() | F.col("next").isNotNull(), F.greatest("inside", "outside")).otherwise(F.col("outside"))
    return near.select("hash", F.when(alone, F.col("hash")).otherwise(F.substring("hash", F.lit(1), lcp + 1)).alias("prefix"))
