import json
import warnings

import pytest
from pyspark.sql import functions as F

from stratal import facade as f
from stratal.functions.columns import disambiguating_prefixes, json_string, selection_content_hash
from stratal.operators import mutations as mu
from stratal.operators import queries as q
from stratal.operators import selections as se
from stratal.plans import constraints as c
from stratal.plans import model as m
from stratal.plans.patterns import match_axioms, match_bindings, parse_pattern
from stratal.plans.spec import AXIOMS, EXPRESSION_HOLDERS, EXPRESSIONS, RANGES
from stratal.sources import store
from stratal.sources.fixture import constants, ontology
from stratal.sources.export import export_lines
from stratal.sources.ontology import empty, from_axioms, from_nodes

SF = "/root/testdata/sf0.001"


def sub(a, b):
    return m.make("SubClassOf", sub_class=a, super_class=b)


def some(p, x):
    return m.make("ObjectSomeValuesFrom", property=p, filler=x)


def label(iri, text, prop="rdfs:label"):
    return m.make("AnnotationAssertion", property=prop, subject=iri, value=m.Literal(text, "xsd:string"))


def build(spark, axioms, prefixes=("", "ex")):
    p = spark.createDataFrame([(x, f"http://{x}.org/") for x in prefixes], "name string, namespace_iri string")
    return from_nodes(spark, axioms, p)


def ids(df, col=0):
    return [r[col] for r in df.collect()]


def test_spec_counts():
    assert (len(AXIOMS), len(EXPRESSIONS), len(RANGES)) == (29, 7, 3)
    assert sum(x[4] == "u" for fields in AXIOMS.values() for x in fields) == 8
    assert set(EXPRESSION_HOLDERS) == {"SubClassOf", "EquivalentClasses", "DisjointClasses", "ObjectPropertyDomain", "ObjectPropertyRange", "DataPropertyDomain", "HasKey", "ClassAssertion"}


@pytest.mark.parametrize(
    ("axiom", "prefix"),
    [
        (sub("sol:Star", "sol:CelestialBody"), "bb5496d24bd1"),
        (sub("sol:Planet", "sol:CelestialBody"), "f3b454b634a3"),
        (sub("sol:Moon", "sol:CelestialBody"), "e4e965a69712"),
        (sub("sol:TerrestrialPlanet", "sol:Planet"), "3f335b35490c"),
        (sub("sol:Planet", some("sol:orbits", "sol:Star")), "7bc195f4d6a6"),
        (sub("sol:Moon", some("sol:orbits", "sol:Planet")), "f3de1afbfd6c"),
    ],
)
def test_known_hashes(axiom, prefix):
    assert m.content_hash(axiom).startswith(prefix)


def test_canonical_form_ignores_order_and_annotations():
    a = m.make("EquivalentClasses", equivalent_classes=["ex:B", some("ex:p", "ex:C"), "ex:A"])
    b = m.make("EquivalentClasses", (("rdfs:comment", m.Literal("x", None, "en")),), equivalent_classes=[some("ex:p", "ex:C"), "ex:A", "ex:B"])
    assert m.content_hash(a) == m.content_hash(b)
    twice = m.make("EquivalentClasses", equivalent_classes=["ex:A", "ex:A", "ex:B"])
    assert m.content_hash(twice) != m.content_hash(m.make("EquivalentClasses", equivalent_classes=["ex:A", "ex:B"]))
    chain = lambda *xs: m.content_hash(m.make("SubObjectPropertyOfChain", chain=xs, super_property="ex:s"))
    assert chain("ex:a", "ex:b") != chain("ex:b", "ex:a")
    assert m.canonical(sub("ex:Ångström", "ex:B")) == '{"sub_class":"ex:\\u00c5ngstr\\u00f6m","super_class":"ex:B"}'


def test_dispatch_and_validation():
    for a in constants():
        assert m.parse(json.loads(json.dumps(m.to_json(a)))) == a
    assert m.parse({"property": "ex:p", "source": "ex:a", "target": "ex:b"}).tag == "ObjectPropertyAssertion"
    assert m.parse({"property": "ex:p", "source": "ex:a", "target": "ex:b", "negated": True}).tag == "NegativeObjectPropertyAssertion"
    for bad in ({"sub_class": "ex:A"}, {"sub_class": "noprefix", "super_class": "ex:B"}, {"class_expression": "ex:A", "has_key_object_properties": [], "has_key_data_properties": []}, {"equivalent_classes": ["ex:A"]}, {"sub_class": "ex:A\n", "super_class": "ex:B"}):
        with pytest.raises(m.ModelError):
            m.parse(bad)


def test_walk_roles_and_positions():
    a = m.make("ClassAssertion", (("ex:note", "ex:N"),), class_expression=m.make("ObjectIntersectionOf", operands=["ex:A", some("ex:p", "ex:B")]), individual="ex:i")
    assert list(m.mentions(a)) == [
        ("ex:note", "AnnotationProperty", "property"), ("ex:N", None, "value"), ("ex:A", "Class", "class"),
        ("ex:p", "ObjectProperty", "restriction_property"), ("ex:B", "Class", "filler"), ("ex:i", "NamedIndividual", "individual"),
    ]
    assert m.render(a) == "ClassAssertion(ObjectIntersectionOf(ex:A, ObjectSomeValuesFrom(ex:p, ex:B)), ex:i)"
    assert list(m.mentions(m.make("Declaration", entity_type="Datatype", iri="ex:D")))[0] == ("ex:D", "Datatype", "entity")


def test_templates_equal_the_general_path(spark):
    o = ontology(spark, SF)
    named = o.axioms.where("data != ''")
    again = from_axioms(named, o.prefixes)
    hashes = named.select("hash")
    for name in ("mentions", "entity_text", "axiom_text", "nodes"):
        own = getattr(o, name).join(hashes, "hash", "left_semi").select(getattr(again, name).columns)
        assert own.exceptAll(getattr(again, name)).isEmpty() and getattr(again, name).exceptAll(own).isEmpty(), name
    data = {r["hash"]: r["data"] for r in named.collect()}
    for h, d in data.items():
        assert m.content_hash(m.parse(json.loads(d))) == h


def test_rank_ladder(spark):
    o = build(spark, [label(":target", "x"), label(":aaa", "target"), label(":target_extra", "y"), label(":zzz", "has_target_in_label"), label(":target_cross", "target")])
    got = {r["entity_iri"]: r["rank0"] for r in q.find_entities(o, c.EntityTextMatches("TARGET")).collect()}
    assert got == {":target": 0, ":aaa": 1, ":target_extra": 2, ":target_cross": 2, ":zzz": 3}
    assert ids(q.find_entities(o, c.EntityTextMatches("target")))[0] == ":target"
    scoped = {r["entity_iri"]: r["rank0"] for r in q.find_entities(o, c.EntityTextMatches("target", ("rdfs:label",))).collect()}
    assert scoped == {":aaa": 0, ":target_cross": 0, ":zzz": 1}


def test_row_and_entity_constraints(spark):
    o = build(spark, [sub("ex:A", "ex:B"), m.make("Declaration", entity_type="Class", iri="ex:A"), label("ex:B", "true", "owl:deprecated"), label("EX:C", "z"), sub("a_b:X", "aXb:X")])
    assert ids(q.find_entities(o, c.WithRoles(("Class",)), c.InPositions(("super_class",)))) == ["aXb:X", "ex:B"]
    assert ids(q.find_entities(o, c.InNamespaces(("ex",)))) == ["EX:C", "ex:A", "ex:B"]
    assert ids(q.find_entities(o, c.InNamespaces(("a_b",)))) == ["a_b:X"]
    assert ids(q.find_entities(o, c.HasRole(), c.Declared(False), c.Deprecated(False), c.InNamespaces(("ex",)))) == []
    assert ids(q.find_entities(o, c.Declared(True))) == ["ex:A"]
    with pytest.raises(c.QueryError):
        c.Deprecated(True)
    with pytest.raises(c.QueryError):
        c.MentionsAll(tuple(f"ex:{i}" for i in range(9)))
    with pytest.raises(c.QueryError):
        c.InIRIs(())
    with pytest.raises(c.QueryError):
        q.find_entities(o, c.WithTypes(("SubClassOf",)))
    with pytest.raises(c.SelectionNotFound):
        q.find_axioms(o, c.InAxiomSelection("none"))
    with pytest.raises(c.QueryError):
        q.find_entities(o, offset=1)
    assert ids(q.find_entities(o, c.InIRIs(tuple(f"ex:{x}" for x in "ABCDEFGH") + tuple(f"q:{i}" for i in range(80))))) == ["ex:A", "ex:B"]


def test_patterns(spark):
    eq = m.make("EquivalentClasses", equivalent_classes=["ex:A", "ex:B", "ex:C"])
    o = build(spark, [sub("ex:A", "ex:A"), sub("ex:A", some("ex:p", some("ex:p", "ex:A"))), eq, *constants()])
    count = lambda p: match_axioms(o, p).count()
    assert count({"type": "SubClassOf", "sub_class": "?x", "super_class": "?x"}) == 2
    assert count({"type": "SubClassOf", "sub_class": "?x", "super_class": {"type": "ObjectSomeValuesFrom", "property": "?p", "filler": {"type": "ObjectSomeValuesFrom", "property": "?p", "filler": "?x"}}}) == 1
    assert count({"type": "EquivalentClasses", "equivalent_classes": ["ex:B", "*"]}) == 0
    assert count({"type": "EquivalentClasses", "equivalent_classes": ["ex:B", "*"], "equivalent_classes_match": "partial"}) == 1
    assert count({"type": "EquivalentClasses", "equivalent_classes": ["ex:B", "ex:B", "*"]}) == 0
    assert count({"type": "EquivalentClasses", "equivalent_classes": ["?a", "?b", "?c"]}) == 1
    assert match_bindings(o, {"type": "EquivalentClasses", "equivalent_classes": ["?a", "?b", "?c"]}).count() == 6
    assert count({"type": "SubObjectPropertyOfChain", "chain": ["tpch:hasBrand", "*"], "super_property": "*"}) == 0
    assert count({"type": "HasKey", "class_expression": "*", "has_key_object_properties": ["*"], "has_key_data_properties": []}) == 1
    assert count({"type": "HasKey", "class_expression": "*", "has_key_object_properties": [], "has_key_data_properties": []}) == 0
    assert count({"type": "DataPropertyRange", "data_property": "*", "range": "?r"}) == 1
    assert count({"type": "Declaration", "entity_type": "NamedIndividual", "iri": "*"}) == 1
    for bad in ({"type": "SubClassOf", "sub_class": "*"}, {"type": "Nope"}, {"type": "SubClassOf", "sub_class": "?1", "super_class": "*"}):
        with pytest.raises(m.ModelError):
            parse_pattern(bad)


def test_selections_and_laws(spark):
    o = ontology(spark, SF)
    a, b = set(ids(se.evaluate(o, "ents_a"), 1)), set(ids(se.evaluate(o, "ents_b"), 1))
    ev = lambda *e: set(ids(se.evaluate(o, e), 1))
    assert ev("union", "ents_a", "ents_b") == a | b and ev("intersect", "ents_a", "ents_b") == a & b and ev("diff", "ents_a", "ents_b") == a - b
    assert ev("union", ("intersect", "ents_a", "ents_b"), ("diff", "ents_a", "ents_b")) == a
    first = [r["item"] for r in se.evaluate(o, ("union", "ents_b", "ents_a")).orderBy("ord").collect()]
    assert first[: len(b)] == sorted(b)
    for bad in (("union", "ents_a", "axs_a"), ("diff", "ents_a"), ("axioms_for", "axs_a"), ("entities_in", "axs_a", "nowhere")):
        with pytest.raises(c.QueryError):
            se.evaluate(o, bad)
    with pytest.raises(c.QueryError):
        se.create_selection(o, "ents_a", "ents_b")
    with pytest.raises(m.ModelError):
        se.create_selection(o, "1bad", "ents_b")
    o2 = se.create_selection(o, "ents_a", "ents_b", "replace")
    assert o2.selections["ents_a"].items.count() == len(b)
    assert ids(se.read_selection(o, "drifted", "missing"), 1) == ["0" * 64, "f" * 64]
    import hashlib

    items = ids(o.selections["drifted"].items, 1)
    assert selection_content_hash(o.selections["drifted"].items).first()["hash"] == hashlib.sha256("\x1e".join(sorted(items)).encode()).hexdigest()[:16]


def test_disambiguating_prefixes(spark):
    def brute(hs):
        return {h: next((h[:i] for i in range(1, len(h) + 1) if sum(x.startswith(h[:i]) for x in hs) == 1), h) if len(hs) > 1 else h for h in hs}

    for hs in (["abcd"], ["abcd", "abce", "b000"], ["aa00", "ab00"], ["aa00", "ba00", "ba11", "ff00", "ff01"]):
        df = spark.createDataFrame([(h,) for h in hs], "hash string")
        assert {r["hash"]: r["prefix"] for r in disambiguating_prefixes(df).collect()} == brute(hs)


def test_json_string_escapes_as_the_canonical_form(spark):
    texts = ["plain", 'q"uo\\te', "tab\tnl\n", "Ångström", "smile 😀", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", json_string("t").alias("j"))
    assert {r["t"]: r["j"] for r in df.collect()} == {t: json.dumps(t) for t in texts}


def test_mutations(spark):
    o = build(spark, [sub("ex:A", "ex:B"), sub("ex:B", "ex:C")])
    o2, new = mu.add_axioms(o, [sub("ex:A", "ex:B"), sub("ex:X", "ex:Y"), sub("ex:X", "ex:Y")])
    assert new.count() == 1 and o2.axioms.count() == 3
    back = mu.remove_by_hash(o2, [m.content_hash(sub("ex:X", "ex:Y"))])
    assert sorted(ids(back.mentions, 1)) == sorted(ids(o.mentions, 1))
    with pytest.raises(mu.NotFound):
        mu.remove_by_hash(o, [m.content_hash(sub("ex:A", "ex:B")), "0" * 64])
    with pytest.raises(c.QueryError):
        mu.add_axioms(o, [sub("nope:A", "ex:B")])
    h = m.content_hash(sub("ex:A", "ex:B"))
    o3, done = mu.annotate_axiom(o, h, add=(("rdfs:comment", m.Literal("hi", None, "en")),))
    assert done["added"] and o3.axiom_text.first()["text"] == "hi" and not o3.axioms.where(F.col("hash") == h).isEmpty()
    assert mu.replace_axiom(o3, h, sub("ex:A", "ex:B"))[1] == "noop"
    assert mu.replace_axiom(o3, h, sub("ex:B", "ex:C"))[1] == "merged"
    o4, out = mu.replace_axiom(o3, h, sub("ex:A", "ex:Z"))
    assert out == "replaced" and o4.axiom_text.first()["text"] == "hi"
    o5, plan = mu.rename_iri(build(spark, [sub("ex:A", "ex:C"), sub("ex:B", "ex:C"), sub("ex:D", "ex:A"), label("ex:Q", "ex:A")]), "ex:A", "ex:B")
    assert sorted(r["outcome"] for r in plan.collect()) == ["merged", "replaced"]
    assert sorted(r["data"] for r in o5.axioms.where("type = 'SubClassOf'").collect()) == ['{"sub_class":"ex:B","super_class":"ex:C"}', '{"sub_class":"ex:D","super_class":"ex:B"}']
    with pytest.raises(c.QueryError):
        mu.remove_prefix(o, "ex")
    with pytest.raises(mu.NotFound):
        mu.remove_prefix(o, "zzz")


def test_store_sessions_and_conflicts(spark, tmp_path):
    path = str(tmp_path / "store")
    f.create_ontology(spark, path)
    with pytest.raises(store.StoreError):
        f.create_ontology(spark, path)
    f.set_prefix(spark, path, "ex", "http://ex.org/")
    assert f.add_axioms(spark, path, [{"sub_class": "ex:A", "super_class": "ex:B"}, sub("ex:A", "ex:B"), label("ex:A", "Alpha"), label("ex:B", "Alpha")]) == {"added": 3, "skipped": 1}
    with store.session(spark, path) as one, store.session(spark, path) as two:
        one.ontology, _ = mu.add_axioms(one.ontology, [sub("ex:C", "ex:D")])
        two.ontology, _ = mu.add_axioms(two.ontology, [sub("ex:E", "ex:F")])
        one.commit()
        with pytest.raises(store.Conflict):
            two.commit()
        two.rollback()
    with pytest.warns(UserWarning):
        with store.session(spark, path) as s:
            s.ontology, _ = mu.add_axioms(s.ontology, [sub("ex:G", "ex:H")])
    assert store.load(spark, path)[0].axioms.count() == 4
    assert store.load(spark, path, 0)[0].axioms.count() == 0


def test_commits_write_what_is_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    f.create_ontology(spark, path)
    f.set_prefix(spark, path, "ex", "http://ex.org/")
    f.add_axioms(spark, path, [sub(f"ex:A{i}", "ex:B") for i in range(2000)])
    size = lambda: sum(p.stat().st_size for p in (tmp_path / "store").rglob("*") if p.is_file())
    whole = size()
    before = store.load(spark, path)[0]
    assert f.add_axioms(spark, path, [sub("ex:New", "ex:B"), sub("ex:A3", "ex:B")]) == {"added": 1, "skipped": 1}
    assert size() - whole < 40_000
    h = m.content_hash(sub("ex:New", "ex:B"))
    f.annotate_axiom(spark, path, h[:20], add=(("rdfs:comment", m.Literal("hi", None, "en")),))
    f.remove_axioms(spark, path, [m.content_hash(sub("ex:A5", "ex:B"))])
    assert size() - whole < 200_000
    o, manifest = store.load(spark, path)
    assert [next(iter(x)) for x in manifest["steps"]] == ["add", "add", "add", "remove", "add", "remove"]
    assert o.axioms.count() == 2000 and o.mentions.where("entity_iri = 'ex:A5'").isEmpty()
    assert o.axiom_text.collect() == [(h, "rdfs:comment", "hi")] and before.axioms.count() == 2000
    for name in ("mentions", "nodes", "entity_text"):  # as if derived from what is left
        again = getattr(from_axioms(o.axioms, o.prefixes), name)
        assert sorted(map(str, again.collect())) == sorted(map(str, getattr(o, name).collect()))
    monkeypatch.setattr(store, "COMPACT_STEPS", 3)
    f.add_axioms(spark, path, [sub("ex:Last", "ex:B")])
    o, manifest = store.load(spark, path)
    assert len(manifest["steps"]) == 1 and o.axioms.count() == 2001
    assert not list((tmp_path / "store").glob("draft-*"))


def test_selections_of_the_other_kind_are_told_from_absent_ones(spark):
    o = build(spark, [sub("ex:A", "ex:B")])
    o = se.upsert_selection(o, "e", "entity", spark.createDataFrame([(0, "ex:A")], "ord bigint, item string"))
    for asked in (lambda: q.find_axioms(o, c.InAxiomSelection("e")), lambda: q.find_axioms(o, c.InAxiomSelection("none")), lambda: export_lines(o, "none")):
        with pytest.raises(c.SelectionNotFound):  # to a constraint the other kind is as good as none
            asked()
    for asked in (lambda: mu.remove_by_selection(o, "e"), lambda: export_lines(o, "e")):
        with pytest.raises(c.SelectionKindMismatch):
            asked()


def test_order_of_nested_and_stored_unions(spark):
    o = build(spark, [sub("ex:A", "ex:B")])
    rows = lambda *xs: spark.createDataFrame([(k, x) for k, x in xs], "ord bigint, item string")
    for name, items in {"a": rows((1, "x:1"), (2, "x:2"), (3, "x:3"), (9, "x:2")), "b": rows((1, "y:1"), (1 << 60, "y:2"), ((1 << 60) + 1, "x:1")), "c": rows((0, "z:1"), (1, "y:2"))}.items():
        o = se.upsert_selection(o, name, "entity", items)
    assert se.size_of(o, "a") == o.selections["a"].items.count() == 3
    listed = lambda df: [r["item"] for r in df.orderBy("ord").collect()]
    want = ["x:1", "x:2", "x:3", "y:1", "y:2", "z:1"]
    o = se.create_selection(o, "ab", ("union", "a", "b"))
    assert listed(o.selections["ab"].items) == want[:5]
    assert listed(se.evaluate(o, ("union", ("union", "a", "b"), "c"))) == listed(se.evaluate(o, ("union", "ab", "c"))) == want
    assert listed(se.evaluate(o, ("union", "c", ("diff", ("union", "b", "a"), "c")))) == ["z:1", "y:2", "y:1", "x:1", "x:2", "x:3"]
    assert listed(se.evaluate(o, ("intersect", ("union", ("union", "b", "a"), "c"), "a"))) == ["x:1", "x:2", "x:3"]


def test_concrete_terms_prune_a_pattern():
    from stratal.plans.patterns import concrete_terms, parse_pattern

    p = parse_pattern({"type": "SubClassOf", "sub_class": "?x", "super_class": {"type": "ObjectSomeValuesFrom", "property": "ex:p", "filler": {"type": "ObjectIntersectionOf", "operands": ["ex:A", "*", "ex:p"]}}})
    assert concrete_terms(p) == ["ex:p", "ex:A"]
    assert concrete_terms(parse_pattern({"type": "AnnotationAssertion", "property": "rdfs:label", "subject": "*", "value": '"ex:v"@en'})) == ["rdfs:label"]
    assert concrete_terms(parse_pattern({"type": "Declaration", "entity_type": "Class", "iri": "*"})) == []


def test_facade(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    f.create_ontology(spark, path)
    f.set_prefix(spark, path, "ex", "http://ex.org/")
    f.add_axioms(spark, path, [sub("ex:A", "ex:B"), sub("ex:B", "ex:C"), label("ex:A", "Alpha"), label("ex:B", "Alpha"), m.make("Declaration", entity_type="Class", iri="ex:A")])
    assert f.find_entities(spark, path, "found", query="alpha") == 2
    assert f.find_duplicate_entities(spark, path, "dups") == 2
    assert f.match_axioms(spark, path, {"type": "SubClassOf", "sub_class": "*", "super_class": "*"}, "subs", limit=2) == {"size": 2, "truncated": True}
    assert f.create_selection(spark, path, "about", ("axioms_for", "found")) == {"size": 5, "previous_size": None}
    assert f.create_selection(spark, path, "about", ("diff", "about", "subs"), mode="replace") == {"size": 3, "previous_size": 5}
    page = f.read_selection(spark, path, "subs", limit=1)
    assert [x["type"] for x in page["items"].collect()] == ["SubClassOf"] and page["totals"].first().asDict() == {"kind": "axiom", "source": "match_axioms(SubClassOf, None)", "size": 2, "present": 2, "missing": 0, "total_filtered": 2}
    assert [(x["item"], x["roles"], x["label"]) for x in f.read_selection(spark, path, "found")["items"].collect()] == [("ex:A", ["Class"], "Alpha"), ("ex:B", ["Class"], "Alpha")]
    assert f.list_selections(spark, path).count() == 4
    got = f.get_entity(spark, path, "ex:A")
    assert {r["role"] for r in got["roles"].collect()} == {"Class"}
    with pytest.raises(mu.NotFound, match="ex:A"):
        f.get_entity(spark, path, "other:A")
    with pytest.raises(f.ConfirmationNeeded) as need:
        f.remove_axioms(spark, path, selection="subs")
    assert f.remove_axioms(spark, path, selection="subs", confirm=need.value.token) == {"removed": 2, "absent": 0}
    gone = f.read_selection(spark, path, "subs", show="missing")
    assert [(x["present"], x["data"]) for x in gone["items"].collect()] == [(False, None)] * 2 and gone["totals"].first()["total_filtered"] == 2
    with pytest.raises(f.ConfirmationNeeded) as need:
        f.rename_iri(spark, path, "ex:A", "ex:B")
    assert f.rename_iri(spark, path, "ex:A", "ex:B", confirm=need.value.token) == {"replaced": 1, "merged": 1, "noop": 0}
    assert {k: v.count() > 0 for k, v in f.describe_ontology(spark, path).items()}["axioms"]
    out = str(tmp_path / "out")
    assert f.export_jsonl(spark, path, out) == f.export.ExportResult(2, 0)
    lines = ids(spark.read.text(out))
    assert len(lines) == 3 and json.loads(lines[0])["format_version"] == 4
    assert sorted(m.content_hash(m.parse(json.loads(x))) for x in lines[1:]) == sorted(ids(store.load(spark, path)[0].axioms))
    assert f.remove_selections(spark, path, ("dups", "nope")) == ["nope"]
    monkeypatch.setenv(store.WORKSPACE_ENV, str(tmp_path))
    with pytest.raises(store.StoreError):
        f.describe_ontology(spark, "/elsewhere/store")


def test_streaming_ingest(spark, tmp_path):
    from stratal.streaming.ingest import ingest_axioms

    path = str(tmp_path / "store")
    f.create_ontology(spark, path)
    src = str(tmp_path / "in")
    for i in range(2):
        from_nodes(spark, [sub("ex:A", "ex:B"), sub(f"ex:N{i}", "ex:B")], empty(spark).prefixes).axioms.write.mode("append").parquet(src)
    stream = spark.readStream.schema("hash string, type string, data string").option("maxFilesPerTrigger", 1).parquet(src)
    ingest_axioms(stream, path, str(tmp_path / "cp")).awaitTermination()
    assert store.load(spark, path)[0].axioms.count() == 3


def test_empty_ontology(spark):
    o = empty(spark)
    assert q.count_entities(o).first()["n"] == 0 and q.find_axioms(o).isEmpty()
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert q.top_entities(o).isEmpty()
