"""The closed registry of structural constructors.

Every node has an integer tag, a category and ordered fields. A field's role says what a
value there does in its parent. The registry is a small fixed table, so it ships as a
DataFrame literal and joins as a broadcast.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Tag, constructor, category, then field=role; a field name with * is a set,
# with + an ordered list.
_CONSTRUCTORS = """
1 IRI primitive value=value
2 Entity primitive kind=structural iri=iri
3 AnonymousIndividual primitive document_scope=structural local_key=structural
4 Literal primitive lexical_form=structural datatype=datatype language=structural
5 Annotation annotation property=property value=value annotations*=annotation
10 ObjectInverseOf property_expression property=property
11 ObjectPropertyChain sub_object_property_expression properties+=operand
20 FacetRestriction facet_restriction facet=facet value=value
21 DataIntersectionOf data_range operands*=operand
22 DataUnionOf data_range operands*=operand
23 DataComplementOf data_range operand=structural
24 DataOneOf data_range values*=structural
25 DatatypeRestriction data_range datatype=datatype restrictions*=operand
30 ObjectIntersectionOf class_expression operands*=operand
31 ObjectUnionOf class_expression operands*=operand
32 ObjectComplementOf class_expression operand=structural
33 ObjectOneOf class_expression individuals*=individual
34 ObjectSomeValuesFrom class_expression property=property filler=filler
35 ObjectAllValuesFrom class_expression property=property filler=filler
36 ObjectHasValue class_expression property=property value=value
37 ObjectHasSelf class_expression property=property
38 ObjectMinCardinality class_expression cardinality=structural property=property filler=filler
39 ObjectMaxCardinality class_expression cardinality=structural property=property filler=filler
40 ObjectExactCardinality class_expression cardinality=structural property=property filler=filler
41 DataSomeValuesFrom class_expression properties+=operand filler=filler
42 DataAllValuesFrom class_expression properties+=operand filler=filler
43 DataHasValue class_expression property=property value=value
44 DataMinCardinality class_expression cardinality=structural property=property filler=filler
45 DataMaxCardinality class_expression cardinality=structural property=property filler=filler
46 DataExactCardinality class_expression cardinality=structural property=property filler=filler
60 Declaration declaration_axiom entity=declaration annotations*=annotation
61 SubClassOf logical_axiom sub_class=subclass super_class=superclass annotations*=annotation
62 EquivalentClasses logical_axiom expressions*=operand annotations*=annotation
63 DisjointClasses logical_axiom expressions*=operand annotations*=annotation
64 DisjointUnion logical_axiom defined_class=defined_class expressions*=operand annotations*=annotation
70 SubObjectPropertyOf logical_axiom sub_property=sub_property super_property=super_property annotations*=annotation
71 EquivalentObjectProperties logical_axiom properties*=operand annotations*=annotation
72 DisjointObjectProperties logical_axiom properties*=operand annotations*=annotation
73 InverseObjectProperties logical_axiom first=subject second=object annotations*=annotation
74 ObjectPropertyDomain logical_axiom property=property domain=domain annotations*=annotation
75 ObjectPropertyRange logical_axiom property=property range=range annotations*=annotation
76 FunctionalObjectProperty logical_axiom property=property annotations*=annotation
77 InverseFunctionalObjectProperty logical_axiom property=property annotations*=annotation
78 ReflexiveObjectProperty logical_axiom property=property annotations*=annotation
79 IrreflexiveObjectProperty logical_axiom property=property annotations*=annotation
80 SymmetricObjectProperty logical_axiom property=property annotations*=annotation
81 AsymmetricObjectProperty logical_axiom property=property annotations*=annotation
82 TransitiveObjectProperty logical_axiom property=property annotations*=annotation
90 SubDataPropertyOf logical_axiom sub_property=sub_property super_property=super_property annotations*=annotation
91 EquivalentDataProperties logical_axiom properties*=operand annotations*=annotation
92 DisjointDataProperties logical_axiom properties*=operand annotations*=annotation
93 DataPropertyDomain logical_axiom property=property domain=domain annotations*=annotation
94 DataPropertyRange logical_axiom property=property range=range annotations*=annotation
95 FunctionalDataProperty logical_axiom property=property annotations*=annotation
100 DatatypeDefinition logical_axiom datatype=datatype data_range=range annotations*=annotation
101 HasKey logical_axiom class_expression=class_expression object_properties*=property data_properties*=property annotations*=annotation
110 SameIndividual logical_axiom individuals*=individual annotations*=annotation
111 DifferentIndividuals logical_axiom individuals*=individual annotations*=annotation
112 ClassAssertion logical_axiom class_expression=class_expression individual=structural annotations*=annotation
113 ObjectPropertyAssertion logical_axiom property=property source=subject target=object annotations*=annotation
114 NegativeObjectPropertyAssertion logical_axiom property=property source=subject target=object annotations*=annotation
115 DataPropertyAssertion logical_axiom property=property source=subject value=value annotations*=annotation
116 NegativeDataPropertyAssertion logical_axiom property=property source=subject value=value annotations*=annotation
120 AnnotationAssertion annotation_axiom property=property subject=subject value=value annotations*=annotation
121 SubAnnotationPropertyOf annotation_axiom sub_property=sub_property super_property=super_property annotations*=annotation
122 AnnotationPropertyDomain annotation_axiom property=property domain=domain annotations*=annotation
123 AnnotationPropertyRange annotation_axiom property=property range=range annotations*=annotation
140 Variable swrl_extension iri=iri
141 ClassAtom swrl_extension predicate=rule_predicate argument=rule_argument
142 DataRangeAtom swrl_extension predicate=rule_predicate argument=rule_argument
143 ObjectPropertyAtom swrl_extension predicate=rule_predicate source=subject target=rule_argument
144 DataPropertyAtom swrl_extension predicate=rule_predicate source=subject target=rule_argument
145 BuiltInAtom swrl_extension predicate=rule_predicate arguments+=rule_argument
146 SameIndividualAtom swrl_extension first=subject second=rule_argument
147 DifferentIndividualsAtom swrl_extension first=subject second=rule_argument
148 SWRLRule swrl_extension body*=rule_body head*=rule_head annotations*=annotation
"""


# The namespaces of the standard vocabularies.
NAMESPACES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}


def term(short: str) -> str:
    """The full IRI of a standard term, such as rdfs:label."""
    prefix, _, name = short.partition(":")
    return NAMESPACES[prefix] + name


def spelled_out(sql: str) -> str:
    """SQL with standard terms at the start of its string literals written as full IRIs."""
    return re.sub(r"'(owl|rdf|rdfs|xsd):", lambda m: "'" + NAMESPACES[m[1]], sql)


@dataclass(frozen=True)
class Field:
    name: str
    role: str
    kind: str  # one, set or list


@dataclass(frozen=True)
class Constructor:
    tag: int
    name: str
    category: str
    fields: tuple[Field, ...]


def _read() -> dict[str, Constructor]:
    out = {}
    for line in _CONSTRUCTORS.strip().splitlines():
        tag, name, category, *fields = line.split()
        kinds = {"*": "set", "+": "list"}
        parsed = tuple(Field(f.rstrip("*+"), role, kinds.get(f[-1], "one")) for f, role in (x.split("=") for x in fields))
        out[name] = Constructor(int(tag), name, category, parsed)
    return out


BY_NAME = _read()
BY_TAG = {c.tag: c for c in BY_NAME.values()}
#: Declaration order of entity kinds, which signature views sort by.
ENTITY_KINDS = ("class", "datatype", "object_property", "data_property", "annotation_property", "named_individual")
AXIOM_CATEGORIES = ("declaration_axiom", "logical_axiom", "annotation_axiom")


def tag(name: str) -> int:
    return BY_NAME[name].tag


def constructor_spec(spark: SparkSession) -> DataFrame:
    """tag, name, category, field_ordinal, field_name, role, field_kind: one row a field."""
    rows = [(c.tag, c.name, c.category, i, f.name, f.role, f.kind) for c in BY_NAME.values() for i, f in enumerate(c.fields)]
    return spark.createDataFrame(rows, "tag int, name string, category string, field_ordinal int, field_name string, role string, field_kind string")


def constructors(spark: SparkSession) -> DataFrame:
    """tag, name, category: one row a constructor."""
    return spark.createDataFrame([(c.tag, c.name, c.category) for c in BY_NAME.values()], "tag int, name string, category string")
