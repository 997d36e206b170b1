import pytest

from ontolith.operators import hierarchy, imports, views
from ontolith.sources import encoding, functional, mapping, nodes, owlxml, reader, turtle
from ontolith.sources.functional import SyntaxProblem

RICH = """Prefix(:=<urn:x#>) Ontology(<urn:o> <urn:o/1> Import(<urn:leaf>)
Annotation(rdfs:label "rich"@EN)
Declaration(Class(:A)) Declaration(ObjectProperty(:p)) Declaration(ObjectProperty(:q)) Declaration(ObjectProperty(:r)) Declaration(DataProperty(:d)) Declaration(DataProperty(:e)) Declaration(NamedIndividual(:i)) Declaration(Datatype(:t)) Declaration(AnnotationProperty(:note))
SubClassOf(Annotation(rdfs:comment "why") :A ObjectSomeValuesFrom(:p ObjectUnionOf(:B :C)))
EquivalentClasses(:A ObjectIntersectionOf(:B ObjectMinCardinality(2 :p :C)))
DisjointClasses(:A :B :C) DisjointUnion(:U :A :B)
SubObjectPropertyOf(ObjectPropertyChain(:p :q) :r) InverseObjectProperties(:p :q) TransitiveObjectProperty(:r) ObjectPropertyDomain(:p :A) ObjectPropertyRange(:p ObjectComplementOf(:B))
SubDataPropertyOf(:d :e) DataPropertyRange(:d DatatypeRestriction(xsd:integer xsd:minInclusive "3"^^xsd:integer)) DatatypeDefinition(:t DataOneOf("a" "b"))
HasKey(:A (:p) (:d)) SubClassOf(:A DataAllValuesFrom(:d xsd:string)) SubClassOf(:A ObjectHasSelf(:p)) SubClassOf(:A DataMaxCardinality(1 :d))
ClassAssertion(:A :i) ObjectPropertyAssertion(:p :i :j) NegativeDataPropertyAssertion(:d :i "x") DataPropertyAssertion(:d :i "5"^^xsd:integer) SameIndividual(:i :k) DifferentIndividuals(:i :j)
AnnotationAssertion(:note :A "n"@de-DE) SubAnnotationPropertyOf(:note rdfs:comment))"""


def test_every_format_gives_the_same_axioms():
    doc = functional.parse(RICH)
    assert set(functional.parse(functional.write(doc)).axioms) == set(doc.axioms)
    assert set(owlxml.parse(owlxml.write(doc)).axioms) == set(doc.axioms)
    back, left = mapping.map_triples(turtle.parse_turtle(turtle.write_turtle(encoding.encode(doc))))
    assert not left and set(back.axioms) == set(doc.axioms)
    assert (back.ontology_iri, back.version_iri, back.imports, back.annotations) == (doc.ontology_iri, doc.version_iri, doc.imports, doc.annotations)


def test_canonical_round_trip_and_order():
    for axiom in functional.parse(RICH).axioms:
        assert nodes.decode(axiom.canonical) == axiom
    assert [nodes.varint(n).hex() for n in (0, 127, 128)] == ["00", "7f", "8001"]
    big = nodes.make("ObjectMinCardinality", 2**4096 + 17, nodes.entity("object_property", "urn:p"), nodes.entity("class", "urn:c"))
    assert nodes.decode(big.canonical) == big
    names = sorted((nodes.entity("class", f"urn:x#{n}") for n in ("zz", "aaa", "b")), key=lambda n: n.canonical)
    assert [n.values[1].values[0][-1] for n in names] == ["b", "z", "a"]


def test_construction_rules():
    a, b = nodes.entity("class", "urn:a"), nodes.entity("class", "urn:b")
    inner = nodes.make("ObjectUnionOf", [a, b])
    assert nodes.make("ObjectUnionOf", [inner, nodes.entity("class", "urn:c")]).values[0] == tuple(sorted([a, b, nodes.entity("class", "urn:c")], key=lambda n: n.canonical))
    with pytest.raises(nodes.StructureError):
        nodes.make("EquivalentClasses", [a, a])
    assert functional.parse("Ontology(DisjointClasses(<urn:a> <urn:a>))").axioms[0].name == "SubClassOf"
    assert nodes.literal("x", lang="EN") == nodes.literal("x", lang="en") != nodes.literal("x")
    assert nodes.literal("1", "urn:i") != nodes.literal("01", "urn:i")


@pytest.mark.parametrize("text", ["Ontology(SubClassOf(:A :B))", "Ontology(", "Ontology(SubClassOf(<urn:a>))", "Ontology() x", "Ontology(" + "SubClassOf(" + "ObjectComplementOf(" * 600])
def test_bad_functional(text):
    with pytest.raises(ValueError):
        functional.parse(text)


def test_turtle_terms():
    text = """@prefix : <urn:x#> . @base <http://h/d/> . :s :p 1, 1.5, 1e3, true, "a\\"b"@EN, '''l"o
ng''', <rel>, [ :q () ] ; :r (1 :x) . _:b :p "\\u00e9"^^:t ."""
    got = turtle.parse_turtle(text)
    objects = [o for s, p, o in got if s[1] == "urn:x#s" and p[1] == "urn:x#p"]
    assert [o[1] for o in objects[:7]] == ["1", "1.5", "1e3", "true", 'a"b', 'l"o\nng', "http://h/d/rel"]
    assert [o[2] and o[2].rsplit("#")[-1] for o in objects[:5]] == ["integer", "decimal", "double", "boolean", None]
    assert ("blank", "nb", None, None) in {s for s, _, _ in got}


def test_rdf_lists_and_xml_guards():
    with pytest.raises(SyntaxProblem):
        mapping.map_triples(turtle.parse_turtle("@prefix o: <http://www.w3.org/2002/07/owl#> . @prefix r: <http://www.w3.org/1999/02/22-rdf-syntax-ns#> . <urn:a> o:unionOf _:l . _:l r:first <urn:b> ; r:rest _:l ."))
    with pytest.raises(SyntaxProblem):
        turtle.parse_rdfxml('<!DOCTYPE x [<!ENTITY a "b">]><x/>')
    with pytest.raises(mapping.MappingIncomplete):
        mapping.map_triples(turtle.parse_turtle("<urn:a> <urn:p> <urn:b> ."))


def test_equivalence_edges_merge():
    ttl = "@prefix o: <http://www.w3.org/2002/07/owl#> . <urn:a> o:equivalentClass <urn:b> . <urn:b> o:equivalentClass <urn:c> ."
    axioms = mapping.map_triples(turtle.parse_turtle(ttl))[0].axioms
    assert len(axioms) == 1 and len(axioms[0].values[0]) == 3


def test_detection():
    assert reader.detect(b"# c\nPrefix(:=<u:>)\nOntology()") == "functional"
    assert reader.detect(b"<?xml version='1.0'?><!-- c --><rdf:RDF/>") == "rdfxml"
    assert reader.detect(b"<Ontology/>", media_type="text/turtle; charset=utf-8") == "turtle"
    assert reader.detect(b"???", name="x.ttl") == "turtle"
    with pytest.raises(SyntaxProblem):
        reader.detect(b"???")


def test_snapshot_tables(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.ofn").write_text(RICH)
    (tmp_path / "in/copy.ofn").write_text(RICH)
    (tmp_path / "in/leaf.owx").write_text(owlxml.write(functional.parse("Ontology(<urn:leaf> Import(<urn:o>) Declaration(Class(<urn:x#B>)) SubClassOf(<urn:x#B> <urn:x#Top>) EquivalentClasses(<urn:x#B> <urn:x#B2>))")))
    (tmp_path / "in/bad.ttl").write_text("@prefix broken")
    snap = reader.read(spark, str(tmp_path / "in"))
    assert {r["path"].rsplit("/")[-1]: r["error"] is None for r in snap.document.collect()} == {"a.ofn": True, "leaf.owx": True, "bad.ttl": False}
    doc = functional.parse(RICH)
    assert {(r["tag"], r["n"]) for r in views.axiom_type_counts(snap.root).where("tag in (60, 61, 113)").collect()} == {(60, 10), (61, 5), (113, 1)}
    assert snap.root.where("root_kind = 'axiom'").count() == len(set(doc.axioms)) + 3
    assert {(r["child"], r["parent"]) for r in hierarchy.class_edges(snap.sub_class, snap.equivalent_class, hierarchy.BIDIRECTIONAL).collect()} == {("urn:x#B", "urn:x#Top"), ("urn:x#B", "urn:x#B2"), ("urn:x#B2", "urn:x#B")}
    edges = snap.import_edge
    assert imports.statuses(edges).collect()[0].asDict() == {"status": "resolved", "n": 2}
    assert imports.closure(edges).count() == 4
    bad = snap.node.where("entity_kind = 'class' and iri = 'urn:x#A'").first()
    assert nodes.decode(bytes(bad["canonical"])).digest() == bytes(bad["node_id"])
    snap.save(str(tmp_path / "saved"))
    assert reader.load(spark, str(tmp_path / "saved")).root.count() == snap.root.count()


def test_catalyst_bytes_equal_python(spark):
    from pyspark.sql import functions as F

    from ontolith.functions import canonical as C

    names = ["urn:a", "urn:" + "é" * 60, "urn:" + "x" * 200, "urn:" + "y" * 20000]
    rows = spark.createDataFrame([(n,) for n in names], "iri string").select("iri", C.entity(F.lit("class"), F.col("iri")).alias("b"), C.literal(F.col("iri"), F.lit("urn:t"), F.lit("DE")).alias("l"), C.axiom("SubClassOf", C.entity(F.lit("class"), F.col("iri")), C.entity(F.lit("class"), F.lit("urn:s"))).alias("s")).collect()
    for r in rows:
        e = nodes.entity("class", r["iri"])
        assert bytes(r["b"]) == e.canonical
        assert bytes(r["s"]) == nodes.make("SubClassOf", e, nodes.entity("class", "urn:s")).canonical
        assert bytes(r["l"]) == nodes.Node("Literal", (r["iri"], nodes.entity("datatype", "urn:t"), "de")).canonical
