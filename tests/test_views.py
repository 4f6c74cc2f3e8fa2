"""Relations of the fixture as views: what is written, and what the joins read, stays small beside the tables."""

from pyspark.sql import functions as F

from stratal import registry
from stratal.operators import mutations as mu
from stratal.operators import queries as q
from stratal.plans import constraints as c
from stratal.plans import model as m
from stratal.sources.fixture import ontology
from stratal.sources.ontology import from_axioms, from_nodes

SF = "/root/testdata/sf0.001"


def test_relations_are_views_of_the_tables(spark):
    o = ontology(spark, SF)
    for relation in (o.axioms, o.mentions, o.entity_text, o.axiom_text, o.nodes):
        assert all(f.startswith(f"file://{SF}/") or "fixture-pairs" in f for f in relation.inputFiles())


def test_constant_leaves_drop_branches_when_planned(spark):
    o = ontology(spark, SF)
    plan = o.entity_text.where("property = 'rdfs:label'")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_custkey" not in plan and "p_name" in plan


def test_hash_queries_leave_the_axioms_unread(spark):
    o = ontology(spark, SF)
    found = q.find_axioms(o, c.HasAnyAnnotation(("rdfs:comment",)))
    assert not any("/part.parquet" in f or "fixture-pairs" in f for f in found.inputFiles())
    assert found.count() == o.axiom_text.where("property = 'rdfs:comment'").select("hash").distinct().count()


def test_top_entities_count_axioms_once(spark):
    """IRIs without a local name have no name row, and one axiom may mention an entity twice."""
    prefixes = spark.createDataFrame([("ex", "http://ex.org/")], "name string, namespace_iri string")
    pairs = (("ex:A", "ex:A"), ("ex:A", "ex:"), ("ex:", "ex:"))
    axioms = spark.createDataFrame([(f"{i}" * 64, "SubClassOf", f'{{"sub_class":"{a}","super_class":"{b}"}}') for i, (a, b) in enumerate(pairs)], "hash string, type string, data string")
    o = from_axioms(axioms, prefixes)
    brute = o.mentions.groupBy("entity_iri").agg(F.count_distinct("hash").alias("n"))
    assert [tuple(r) for r in q.top_entities(o).collect()] == sorted(((r["entity_iri"], r["n"]) for r in brute.collect()), key=lambda x: (-x[1], x[0]))


def test_a_rename_looks_places_up_without_all_axioms(spark):
    prefixes = spark.createDataFrame([("ex", "http://ex.org/")], "name string, namespace_iri string")
    axioms = [m.make("SubClassOf", sub_class=a, super_class="ex:C") for a in ("ex:A", "ex:B", "ex:D")]
    done, plan = mu.rename_iri(from_nodes(spark, axioms, prefixes), "ex:A", "ex:B")
    assert [r["outcome"] for r in plan.collect()] == ["merged"]
    assert done.axioms.count() == 2 and done.mentions.where("entity_iri = 'ex:A'").isEmpty()


def test_settled_tables_are_broadcast_whatever_the_threshold(spark):
    """What an IRI's axioms are looked up by may be larger than the planner's threshold, and the other side is every axiom."""
    prefixes = spark.createDataFrame([("ex", "http://ex.org/")], "name string, namespace_iri string")
    o = from_nodes(spark, [m.make("SubClassOf", sub_class=a, super_class="ex:C") for a in ("ex:A", "ex:B", "ex:D")], prefixes)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        planned = mu.rename_plan(o, "ex:A", "ex:B")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    semi = [x for x in planned.splitlines() if "LeftSemi" in x]
    assert semi and all("BroadcastHashJoin" in x for x in semi)


def test_all_axioms_are_taken_apart_without_being_written(spark):
    """The stored form of every axiom takes more room than the tables; the long expression is planned once all the same."""
    o = ontology(spark, SF)
    for made in (registry.content_hashes(o), registry.exploded_axioms(o)):
        assert all(f.startswith(f"file://{SF}/") or "fixture-pairs" in f for f in made.inputFiles())
        assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1


def test_hashes_with_an_annotation_are_moved_once(spark):
    prefixes = spark.createDataFrame([("ex", "http://ex.org/")], "name string, namespace_iri string")
    notes = (("rdfs:comment", m.Literal("a", None, "en")), ("rdfs:comment", m.Literal("b", None, "en")))
    axioms = [m.make("SubClassOf", notes[: i % 3], sub_class=f"ex:A{i}", super_class="ex:C") for i in range(9)]
    found = q.find_axioms(from_nodes(spark, axioms, prefixes), c.HasAnyAnnotation(("rdfs:comment",)))
    assert [r["hash"] for r in found.collect()] == sorted(m.content_hash(a) for a in axioms if a.annotations)
    planned = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert planned.count("Exchange ") == 1
