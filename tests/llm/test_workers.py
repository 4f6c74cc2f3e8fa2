"""Executors need no copy of the package: every query runs where workers cannot import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()

def known(batches):
    import importlib.util
    import pandas as pd
    for pdf in batches:
        yield pd.DataFrame({"found": [importlib.util.find_spec(x) is not None for x in ("stratal", "corpus_pipeline")]})

assert {r["found"] for r in spark.range(1).mapInPandas(known, "found boolean").collect()} == {False}
import __spark_entry__ as entry

for name, query in entry.queries().items():
    if name.startswith("op") or name in ("pipeline", "content_hashes", "selection_hash", "rename_iri_merge"):
        print("RAN", name, query(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_every_query_runs_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1500)
    assert done.returncode == 0, done.stderr[-3000:]
    assert sum(line.startswith("RAN ") for line in done.stdout.splitlines()) == 17


def test_a_cut_leaves_no_shuffle_files(spark):
    import glob

    from stratal.llm.common import cut
    from stratal.shuffles import CLEANUP

    before = spark.conf.get(CLEANUP, None)
    held = lambda: {f for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for f in glob.glob(f"{d}/*/shuffle_*.data")}
    there = held()
    found = cut(spark.range(1000).selectExpr("id % 7 AS k").repartition(5, "k").groupBy("k").count())
    assert not held() - there
    assert found.count() == 7 and spark.conf.get(CLEANUP, None) == before
