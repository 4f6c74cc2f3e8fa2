"""The 29 axiom types, class expressions and data ranges as one table of fields.

A field is (name, kind, role, position, flags). Kinds: iri, ce (class expression or IRI), range, literal, value (IRI or
literal), entity_type, datatype, true. Flags: "u" unordered list, "l" ordered list. Fixed values: names, roles and
positions are those of the data model.
"""

from __future__ import annotations

OP, DP, AP, CL, NI, DT = "ObjectProperty", "DataProperty", "AnnotationProperty", "Class", "NamedIndividual", "Datatype"
ENTITY_TYPES = (CL, OP, DP, AP, NI, DT)
POSITIONS = (
    "sub_class", "super_class", "restriction_property", "filler", "sub_property", "super_property", "chain_member", "subject", "property",
    "value", "domain", "range", "source", "target", "individual", "class", "member", "entity",
)
DATATYPES = (
    "rdf:PlainLiteral", "rdf:XMLLiteral", "rdfs:Literal", "owl:real", "owl:rational", "xsd:decimal", "xsd:integer", "xsd:nonNegativeInteger",
    "xsd:string", "xsd:normalizedString", "xsd:token", "xsd:Name", "xsd:NCName", "xsd:NMTOKEN", "xsd:hexBinary", "xsd:base64Binary",
    "xsd:anyURI", "xsd:dateTime", "xsd:dateTimeStamp",
)

AXIOMS: dict[str, list[tuple]] = {
    "AnnotationAssertion": [("property", "iri", AP, "property", ""), ("subject", "iri", None, "subject", ""), ("value", "value", None, "value", "")],
    "SubClassOf": [("sub_class", "ce", CL, "sub_class", ""), ("super_class", "ce", CL, "super_class", "")],
    "EquivalentClasses": [("equivalent_classes", "ce", CL, "member", "u")],
    "DisjointClasses": [("disjoint_classes", "ce", CL, "member", "u")],
    "SubObjectPropertyOf": [("sub_object_property", "iri", OP, "sub_property", ""), ("super_object_property", "iri", OP, "super_property", "")],
    "SubObjectPropertyOfChain": [("chain", "iri", OP, "chain_member", "l"), ("super_property", "iri", OP, "super_property", "")],
    "EquivalentObjectProperties": [("equivalent_object_properties", "iri", OP, "member", "u")],
    "TransitiveObjectProperty": [("transitive_property", "iri", OP, "property", "")],
    "ReflexiveObjectProperty": [("reflexive_property", "iri", OP, "property", "")],
    "ObjectPropertyDomain": [("object_property", "iri", OP, "property", ""), ("domain", "ce", CL, "domain", "")],
    "ObjectPropertyRange": [("object_property", "iri", OP, "property", ""), ("range", "ce", CL, "range", "")],
    "SubDataPropertyOf": [("sub_data_property", "iri", DP, "sub_property", ""), ("super_data_property", "iri", DP, "super_property", "")],
    "EquivalentDataProperties": [("equivalent_data_properties", "iri", DP, "member", "u")],
    "DataPropertyDomain": [("data_property", "iri", DP, "property", ""), ("domain", "ce", CL, "domain", "")],
    "DataPropertyRange": [("data_property", "iri", DP, "property", ""), ("range", "range", None, None, "")],
    "FunctionalDataProperty": [("functional_property", "iri", DP, "property", "")],
    "SubAnnotationPropertyOf": [("sub_annotation_property", "iri", AP, "sub_property", ""), ("super_annotation_property", "iri", AP, "super_property", "")],
    "AnnotationPropertyDomain": [("annotation_property", "iri", AP, "property", ""), ("domain", "iri", None, "domain", "")],
    "AnnotationPropertyRange": [("annotation_property", "iri", AP, "property", ""), ("range", "iri", None, "range", "")],
    "HasKey": [("class_expression", "ce", CL, "class", ""), ("has_key_object_properties", "iri", OP, "property", "u"), ("has_key_data_properties", "iri", DP, "property", "u")],
    "DatatypeDefinition": [("datatype", "iri", DT, "entity", ""), ("data_range", "range", None, None, "")],
    "Declaration": [("entity_type", "entity_type", None, None, ""), ("iri", "iri", "@entity_type", "entity", "")],
    "ClassAssertion": [("class_expression", "ce", CL, "class", ""), ("individual", "iri", NI, "individual", "")],
    "ObjectPropertyAssertion": [("property", "iri", OP, "property", ""), ("source", "iri", NI, "source", ""), ("target", "iri", NI, "target", "")],
    "NegativeObjectPropertyAssertion": [("property", "iri", OP, "property", ""), ("source", "iri", NI, "source", ""), ("target", "iri", NI, "target", ""), ("negated", "true", None, None, "")],
    "DataPropertyAssertion": [("property", "iri", DP, "property", ""), ("individual", "iri", NI, "individual", ""), ("value", "literal", None, None, "")],
    "NegativeDataPropertyAssertion": [("property", "iri", DP, "property", ""), ("individual", "iri", NI, "individual", ""), ("value", "literal", None, None, ""), ("negated", "true", None, None, "")],
    "SameIndividual": [("same_individuals", "iri", NI, "member", "u")],
    "DifferentIndividuals": [("different_individuals", "iri", NI, "member", "u")],
}

EXPRESSIONS: dict[str, list[tuple]] = {
    "ObjectSomeValuesFrom": [("property", "iri", OP, "restriction_property", ""), ("filler", "ce", CL, "filler", "")],
    "ObjectIntersectionOf": [("operands", "ce", CL, None, "u")],
    "ObjectOneOf": [("individual", "iri", NI, None, "")],
    "ObjectHasValue": [("property", "iri", OP, "restriction_property", ""), ("individual", "iri", NI, "filler", "")],
    "ObjectHasSelf": [("self_property", "iri", OP, "restriction_property", "")],
    "DataSomeValuesFrom": [("property", "iri", DP, "restriction_property", ""), ("range", "range", None, None, "")],
    "DataHasValue": [("property", "iri", DP, "restriction_property", ""), ("value", "literal", None, None, "")],
}

RANGES: dict[str, list[tuple]] = {
    "DataTypeRef": [("datatype", "datatype", None, None, "")],
    "DataIntersectionOf": [("operands", "range", None, None, "u")],
    "DataOneOf": [("value", "literal", None, None, "")],
}

# at least so many members; HasKey asks for one property over both lists instead
MIN_MEMBERS = 2
OPTIONAL = {("HasKey", "has_key_object_properties"), ("HasKey", "has_key_data_properties")}

FIELDS = {**AXIOMS, **EXPRESSIONS, **RANGES}
EXPRESSION_HOLDERS = tuple(sorted(t for t, fields in AXIOMS.items() if any(f[1] == "ce" for f in fields)))
