"""Small document tables with the awkward cases."""

from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType())])

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(6000))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t) if t is not None else None) for i, t, s in rows], SCHEMA)


def awkward(spark):
    return table(
        spark,
        [
            (1, "the quick brown fox jumps over the lazy dog", "a"),
            (2, "the quick  brown fox jumps over the lazy dog", "a"),
            (3, "the quick brown fox\tjumps over the lazy dog\n", "b"),
            (4, "", "b"),
            (5, None, None),
            (6, " \n\t ", "c"),
            (7, LONG, "a"),
            (8, LONG, None),
            (8, LONG, None),
            (None, "the quick brown fox jumps over the lazy dog", "c"),
            (9, "Ünïcode ßtraße — naïve", "d"),
            (10, "one", "d"),
        ],
    )
