"""Axioms taken apart in columns, against the walk over axioms on the driver."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stratal.plans import model as m
from stratal.plans.spec import AXIOMS, DATATYPES, ENTITY_TYPES, EXPRESSIONS, FIELDS, RANGES
from stratal.sources import columnar
from stratal.sources.fixture import constants, ontology
from stratal.sources.ontology import DERIVED, apart, derived, from_nodes, stored_json

TEXTS = ["plain", "", 'quote " and \\ slash', "braces {{[}", "Ünïcode 日本 𝒜🙂", "tab\tline\nend\r\x01\x7f", "\\\" { \\\\", "a" * 3000]


def some_node(rng, tag, depth):
    values = {}
    for name, kind, _, _, flags in FIELDS[tag]:
        if kind == "true":
            continue
        n = rng.randint(2, 4) if flags else 1
        made = [some_value(rng, kind, depth) for _ in range(n)]
        values[name] = made if flags else made[0]
    notes = ()
    if tag in AXIOMS and rng.random() < 0.3:
        notes = tuple((rng.choice(["rdfs:comment", "ex:B"]), some_value(rng, "value", 0)) for _ in range(rng.randint(1, 3)))
    return m.make(tag, notes, **values)


def some_value(rng, kind, depth):
    literal = m.Literal(rng.choice(TEXTS), rng.choice(DATATYPES)) if rng.random() < 0.5 else m.Literal(rng.choice(TEXTS), None, rng.choice(["en", "de-AT"]))
    iri = rng.choice(["ex:A", "ex:B", "Ex:A", 'ex:q"u\\o', "ex:Ångström", ":x", "ex::y"])
    if kind == "ce" and depth and rng.random() < 0.7:
        return some_node(rng, rng.choice(list(EXPRESSIONS)), depth - 1)
    if kind == "range":
        return some_node(rng, rng.choice(list(RANGES)) if depth else "DataTypeRef", depth - 1)
    return {"literal": literal, "value": literal if rng.random() < 0.6 else iri, "entity_type": rng.choice(ENTITY_TYPES), "datatype": rng.choice(DATATYPES)}.get(kind, iri)


def some_axioms(seed, n):
    rng = random.Random(seed)
    return list({m.content_hash(a): a for a in (some_node(rng, rng.choice(list(AXIOMS)), rng.randint(0, 3)) for _ in range(n))}.values())


def shuffled(x, rng):
    """JSON of a value with its fields in any order."""
    if isinstance(x, dict):
        return {k: shuffled(v, rng) for k, v in rng.sample(list(x.items()), len(x))}
    return [shuffled(y, rng) for y in x] if isinstance(x, list) else x


def test_relations_hash_and_form_of_any_axiom(spark):
    axioms = some_axioms(4, 250) + constants()
    rng = random.Random(2)
    rows = [(m.content_hash(a), json.dumps(shuffled(m.to_json(a), rng), ensure_ascii=bool(i % 2))) for i, a in enumerate(axioms)]
    parts = apart(spark.createDataFrame([*rows, ("null", None)], "hash string, data string"))
    found = columnar.axiom_rows(parts).collect()
    assert all(r.hash == r.new_hash for r in found)
    assert {(r.hash, r.type, r.data) for r in found} == {(m.content_hash(a), a.tag, stored_json(a)) for a in axioms}
    want = derived((m.content_hash(a), a) for a in {m.content_hash(a): a for a in axioms}.values())
    for name, df in columnar.relations(parts).items():
        assert df.columns == [c.strip().split(" ")[0] for c in DERIVED[name].split(",")]
        assert Counter(map(tuple, df.collect())) == Counter(map(tuple, want[name])), name


def test_renames_follow_the_structure(spark):
    axioms = some_axioms(9, 150)
    rows = spark.createDataFrame([(m.content_hash(a), stored_json(a)) for a in axioms], "hash string, data string")
    found = {r.hash: (r.new_hash, r.data) for r in columnar.axiom_rows(apart(rows, "ex:A", "ex:B")).collect()}
    want = {m.content_hash(a): m.rename(a, "ex:A", "ex:B") for a in axioms}
    assert found == {h: (m.content_hash(a), stored_json(a)) for h, a in want.items()}


def test_no_python_in_the_plan_and_errors(spark):
    rows = spark.createDataFrame([("h", '{"sub_class":"ex:A","super_class":{"operands":["ex:B","ex:C"]}}')], "hash string, data string")
    parts = columnar.taken_apart(rows)
    for df in (columnar.axiom_rows(parts), *columnar.relations(parts).values()):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "MapIn" not in plan and "Exchange" not in plan
    for bad in ('{"sub_class":', '{"sub_class":"ex:A","other":"ex:B"}'):
        with pytest.raises(Exception, match="MALFORMED_RECORD|no type has the fields"):
            columnar.axiom_rows(columnar.taken_apart(spark.createDataFrame([("h", bad)], "hash string, data string"), depth=2)).collect()
    assert columnar.axiom_rows(columnar.taken_apart(rows.where("hash = 'none'"))).collect() == []


def test_depth_of_data(spark):
    cases = {'{"a":"b"}': 1, '{"a":{"b":[{"c":"}{{"}]}}': 3, '{"a":"\\"{{{\\\\","b":{"c":"\\\\"}}': 2, "[]": 0}
    rows = spark.createDataFrame([(k,) for k in cases], "data string")
    assert {r.data: r.d for r in rows.select("data", columnar.data_depth(F.col("data")).alias("d")).collect()} == cases


def test_fixture_from_its_json_equals_the_templates(spark):
    o = ontology(spark, "/root/testdata/sf0.001")
    parts = apart(o.axioms)
    assert columnar.axiom_rows(parts).select("new_hash", "type", "data").exceptAll(o.axioms).isEmpty()
    for name, df in columnar.relations(parts).items():
        other = getattr(o, name)
        assert df.exceptAll(other).isEmpty() and other.exceptAll(df).isEmpty(), name


def test_lists_of_axioms_need_no_json(spark):
    o = from_nodes(spark, constants() * 2, spark.createDataFrame([], "name string, namespace_iri string"))
    assert o.axioms.count() == len(constants()) and "Python" not in o.mentions._jdf.queryExecution().executedPlan().toString()


def test_usual_shapes_are_written_from_their_members(spark):
    """The short way gives what the structs give, whatever the shape, the order of fields and the escapes."""
    rng = random.Random(7)
    some = [json.dumps(shuffled(m.to_json(a), rng), ensure_ascii=bool(i % 2)) for i, a in enumerate(some_axioms(5, 200) + constants())]
    note = '{"property":"ex:p","value":%s}'
    notes = ["", note % '"ex:A"', note % '{"value":"{x}"}', note % '{"lang":"en","value":"b"}', note % '{"value":"","datatype":"xsd:token"}']
    notes += [f"{notes[3]},{notes[3]}", f"{notes[1]},{notes[3]}", note % '{"value":"\\u00e5\\n"}', note % '{"value":"v","lang":"en","datatype":"xsd:string"}']
    odd = ['{"super_class":{"operands":["ex:b","ex:B","ex:a"]},"sub_class":"ex:A","annotations":[%s]}' % n for n in notes]
    odd += ['{"annotations":[%s],"property":"ex:p","source":"ex:b","target":"ex:a"}' % n for n in notes]
    odd += ['{"same_individuals":["ex:b",null,"ex:a"]}', '{"same_individuals":["ex:null","ex:a"]}', '{"chain":["ex:b","ex:a","ex:b"],"super_property":"ex:a"}', '{"iri":7,"entity_type":"Class"}']
    odd += ['{"negated":true,"value":{"value":"a\\\\b"},"property":"ex:p","individual":"ex:i"}', '{"class_expression":{"operands":["ex:b",{"individual":"ex:a"}]},"individual":"ex:A"}']
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate([*some, *odd, None])], "hash string, data string")
    want = columnar.axiom_rows(columnar.taken_apart(rows)).collect()
    assert Counter(map(tuple, columnar.canonical_rows(rows).collect())) == Counter(map(tuple, want)) and len(want) == len(some) + len(odd)
    for bad in ('{"sub_class":', '{"sub_class":"ex:A","other":"ex:B"}'):
        with pytest.raises(Exception, match="MALFORMED_RECORD|no type has the fields"):
            columnar.canonical_rows(spark.createDataFrame([("h", bad)], "hash string, data string"), depth=2).collect()


def test_axioms_of_large_tables_have_usual_shapes(spark):
    """Of the fixture only texts that need escapes and a closed number of axioms take the long way."""
    usual = [x.shape for tag in AXIOMS for x in columnar._forms("axiom", tag, "$")]
    bare = ontology(spark, "/root/testdata/sf0.001").axioms.where(F.col("data").rlike(columnar.BARE))
    shape = F.regexp_replace(F.schema_of_variant(F.parse_json("data")), "annotations: ARRAY<OBJECT<property: STRING, value: OBJECT<lang: STRING, value: STRING>>>, ", "")
    assert bare.where(~shape.isin(usual)).count() <= len(constants()) + 25


def test_entity_texts_are_cut_from_usual_shapes(spark):
    """In one pass, what the structs give, whatever the shape, the order of fields and the escapes."""
    rng = random.Random(7)
    axioms = some_axioms(5, 200) + constants()
    some = [json.dumps(shuffled(m.to_json(a), rng), ensure_ascii=bool(i % 2)) for i, a in enumerate(axioms)] + [stored_json(a) for a in axioms]
    note = '{"property":"ex:p","value":%s}'
    notes = ["", note % '"ex:b"', note % '{"value":"x: {y}","lang":"en"}', note % '{"value":"","datatype":"xsd:token"}', note % '{"value":"\\u00e5\\n","lang":"en"}']
    notes += [f"{notes[1]},{notes[2]}", f"{notes[2]},{notes[2]}"]
    odd = ['{"property":"ex:p","source":"ex:b","target":"ex:b","annotations":[%s]}' % n for n in notes]
    odd += ['{"property":"ex:p","subject":":","value":{"value":"Ü:","lang":"en"}}', '{"property":"ex:p","subject":"ex:a","value":{"value":"","lang":"en"}}', '{"property":"ex:p","subject":"ex:a","value":"ex:a"}']
    odd += ['{"sub_class":"ex:A","super_class":"ex:A"}', ' {"sub_class":"ex:A", "super_class":"ex:B"}', '{"same_individuals":["ex:b",null,"ex:a"]}', '{"iri":7,"entity_type":"Class"}']
    rows = spark.createDataFrame([(str(i), x) for i, x in enumerate([*some, *odd, None])], "hash string, data string")
    found = columnar.entity_text_rows(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, columnar.relations(columnar.taken_apart(rows))["entity_text"].collect()))
    for bad in ('{"sub_class":', '{"sub_class":"ex:A","other":"ex:B"}', '{"sub_class":"ex:A","super_class":"a\nb"}'):
        with pytest.raises(Exception, match="MALFORMED_RECORD|no type has the fields"):
            columnar.entity_text_rows(spark.createDataFrame([("h", bad)], "hash string, data string"), depth=1).collect()


def test_axioms_of_large_tables_are_cut_at_their_quotes(spark):
    known = columnar.usual_shapes()
    data = ontology(spark, "/root/testdata/sf0.001").axioms.where(F.col("data").rlike(columnar.AS_IT_IS))
    shape = columnar.skeleton(F.col("data"), F.split("data", '"'), 40)
    assert data.where(~shape.isin([x[0] for x in known])).count() <= len(constants()) + 25


def test_deepest_data(spark):
    cases = [('{"a":"b"}', 1), ('{"a":{"b":[{"c":"}{{"}]}}', 3), ('{"a":"\\"{{{\\\\","b":{"c":"\\\\"}}', 2), ('{"a":"{{{{"}', 1)]
    for data, depth in cases:
        assert columnar.deepest(spark.createDataFrame([("h", data)], "hash string, data string")) == depth
