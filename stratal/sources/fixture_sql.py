"""The table axioms once more, for the oracle alone: canonical JSON and mentions written out by hand, apart from the templates.

In a text ``<column>`` stands for a column of the source; a mention is "iri role position", with - for no role.
"""

from __future__ import annotations

import re

from .fixture import DUCK_CANONICAL

NATIONS, SUPPLIERS, CUSTOMERS = "nation:n<n_nationkey>", "supp:s<s_suppkey>", "cust:c<c_custkey>"
REGIONS, PARTS, ORDERS, DOCS = "region:r<r_regionkey>", "part:p<p_partkey>", "order:o<o_orderkey>", "doc:d<doc_id>"
TYPED, ENGLISH = '{"datatype":"xsd:string","value":"%s"}', '{"lang":"en","value":"%s"}'


def _declared(table: str, kind: str, iri: str):
    return table, '{"entity_type":"' + kind + '","iri":"' + iri + '"}', [f"{iri} {kind} entity"], None


def _member(table: str, cls: str, iri: str):
    return table, '{"class_expression":"' + cls + '","individual":"' + iri + '"}', [f"{cls} Class class", f"{iri} NamedIndividual individual"], None


def _noted(table: str, prop: str, iri: str, value: str, text: str):
    return table, '{"property":"' + prop + '","subject":"' + iri + '","value":' + value + "}", [f"{prop} AnnotationProperty property", f"{iri} - subject"], (iri, prop, text)


def _related(table: str, prop: str, source: str, target: str, more: tuple = ()):
    return table, '{"property":"' + prop + '","source":"' + source + '","target":"' + target + '"}', [*more, f"{prop} ObjectProperty property", f"{source} NamedIndividual source", f"{target} NamedIndividual target"], None


# source, canonical JSON, mentions, annotation (subject, property, column of the text)
AXIOMS = [
    _declared("region", "NamedIndividual", REGIONS),
    _declared("nation", "NamedIndividual", NATIONS),
    _declared("part", "Class", PARTS),
    _member("region", "tpch:Region", REGIONS),
    _member("nation", "tpch:Nation", NATIONS),
    _member("supplier", "tpch:Supplier", SUPPLIERS),
    (
        "customer",
        '{"class_expression":{"operands":["seg:<c_mktsegment>","tpch:Customer"]},"individual":"cust:c<c_custkey>"}',
        ["tpch:Customer Class class", "seg:<c_mktsegment> Class class", f"{CUSTOMERS} NamedIndividual individual"],
        None,
    ),
    _noted("region", "rdfs:label", REGIONS, TYPED % "<r_name>", "r_name"),
    _noted("nation", "rdfs:label", NATIONS, TYPED % "<n_name>", "n_name"),
    _noted("supplier", "rdfs:label", SUPPLIERS, TYPED % "<s_name>", "s_name"),
    _noted("part", "rdfs:label", PARTS, ENGLISH % "<p_name>", "p_name"),
    _noted("documents", "rdfs:label", DOCS, TYPED % "<source>", "source"),
    _noted(f"(SELECT *, {DUCK_CANONICAL} AS escaped FROM documents)", "rdfs:comment", DOCS, '{"lang":"<lang>","value":<escaped>}', "text"),
    _noted("(SELECT *, 'true' AS yes FROM labels WHERE toxic = 1)", "owl:deprecated", DOCS, TYPED % "true", "yes"),
    _related("nation", "tpch:inRegion", NATIONS, "region:r<n_regionkey>"),
    _related("supplier", "tpch:inNation", SUPPLIERS, "nation:n<s_nationkey>"),
    _related("customer", "tpch:inNation", CUSTOMERS, "nation:n<c_nationkey>"),
    _related("orders", "tpch:placedBy", ORDERS, "cust:c<o_custkey>", ("rdfs:comment AnnotationProperty property",)),
    _related("(SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)", "tpch:contains", "order:o<l_orderkey>", "part:p<l_partkey>"),
    (
        "customer",
        '{"individual":"cust:c<c_custkey>","property":"tpch:segment","value":{"datatype":"xsd:string","value":"<c_mktsegment>"}}',
        ["tpch:segment DataProperty property", f"{CUSTOMERS} NamedIndividual individual"],
        None,
    ),
    (
        "(SELECT * FROM orders WHERE o_orderstatus <> 'F')",
        '{"individual":"order:o<o_orderkey>","negated":true,"property":"tpch:status","value":{"datatype":"xsd:string","value":"F"}}',
        ["tpch:status DataProperty property", f"{ORDERS} NamedIndividual individual"],
        None,
    ),
    ("part", '{"sub_class":"part:p<p_partkey>","super_class":"ptype:<p_type>"}', [f"{PARTS} Class sub_class", "ptype:<p_type> Class super_class"], None),
    (
        "part",
        '{"sub_class":"part:p<p_partkey>","super_class":{"filler":"brand:<p_brand>","property":"tpch:hasBrand"}}',
        [f"{PARTS} Class sub_class", "tpch:hasBrand ObjectProperty restriction_property", "brand:<p_brand> Class filler"],
        None,
    ),
    (
        "(SELECT DISTINCT p_brand FROM part)",
        '{"equivalent_classes":["bpart:<p_brand>",{"filler":"brand:<p_brand>","property":"tpch:hasBrand"}]}',
        ["bpart:<p_brand> Class member", "tpch:hasBrand ObjectProperty restriction_property", "brand:<p_brand> Class filler"],
        None,
    ),
    (
        "(SELECT DISTINCT x.p_type AS a, y.p_type AS b FROM part AS x JOIN part AS y ON x.p_type < y.p_type)",
        '{"disjoint_classes":["ptype:<a>","ptype:<b>"]}',
        ["ptype:<a> Class member", "ptype:<b> Class member"],
        None,
    ),
]


def _sql(text: str) -> str:
    pieces = re.split(r"<([a-z_]+)>", text)
    return "(" + " || ".join(x if i % 2 else "'" + x + "'" for i, x in enumerate(pieces) if x) + ")"


def mention_sql() -> str:
    """SELECT of (hash, entity_iri, role, position)."""
    out = []
    for source, canonical, mentions, _ in AXIOMS:
        for iri, role, position in (x.rsplit(" ", 2) for x in mentions):
            shown = "CAST(NULL AS VARCHAR)" if role == "-" else f"'{role}'"
            out.append(f"SELECT sha256({_sql(canonical)}) AS hash, {_sql(iri)} AS entity_iri, {shown} AS role, '{position}' AS position FROM {source} AS src")
    return " UNION ALL ".join(out)


def entity_text_sql() -> str:
    """SELECT of (hash, entity_iri, property, text): a local name for every IRI of an axiom, and what annotations say."""
    names = f"SELECT DISTINCT hash, entity_iri, 'local_name' AS property, substr(entity_iri, instr(entity_iri, ':') + 1) AS text FROM ({mention_sql()}) WHERE substr(entity_iri, instr(entity_iri, ':') + 1) <> ''"
    said = [f"SELECT sha256({_sql(canonical)}), {_sql(note[0])}, '{note[1]}', {note[2]} FROM {source} AS src" for source, canonical, _, note in AXIOMS if note]
    return " UNION ALL ".join([names, *said])


def axiom_text_sql() -> str:
    """SELECT of (hash, property, text): orders carry their priority."""
    canonical = next(x[1] for x in AXIOMS if x[0] == "orders")
    return f"SELECT sha256({_sql(canonical)}) AS hash, 'rdfs:comment' AS property, o_orderpriority AS text FROM orders"
