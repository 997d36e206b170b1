import pytest
from pyspark.sql import functions as F

from ontolith import adapters
from ontolith.operators import algebra, anonymous, imports, registry, views
from ontolith.plans.lifting import lift
from ontolith.sources import functional, nodes, reader, wire

TEXT = """Prefix(:=<urn:x#>) Ontology(<urn:o> Import(<urn:leaf>) Annotation(rdfs:label "o") Declaration(Class(:A)) SubClassOf(:A :B) EquivalentClasses(:A :C) ObjectPropertyDomain(:p :A)
SubObjectPropertyOf(:p :q) TransitiveObjectProperty(:q) SubClassOf(:A ObjectMinCardinality(2 ObjectInverseOf(:q))) HasKey(:A (:q) ()) DisjointObjectProperties(:p :q) AnnotationAssertion(rdfs:label :A "a"@EN) ClassAssertion(:A _:x))"""
LEAF = "Ontology(<urn:leaf> Import(<urn:o>) Declaration(Class(<urn:x#B>)))"


@pytest.fixture(scope="module")
def snap(spark):
    return reader.read_texts(spark.createDataFrame([("a.ofn", TEXT), ("b.ttl", LEAF), ("copy.ofn", TEXT)], "path string, content string"))


def test_snapshot_on_disk(spark, snap, tmp_path):
    told = wire.encode(snap, str(tmp_path / "s"))
    assert told["documents"] == 2 and wire.validate(spark, str(tmp_path / "s"))["checksum"] == told["checksum"]
    assert wire.open_snapshot(spark, str(tmp_path / "s"), check=True).root.count() == snap.root.count()
    part = next((tmp_path / "s/parsed").glob("part-*.parquet"))
    part.unlink()
    with pytest.raises(wire.WireError):
        wire.validate(spark, str(tmp_path / "s"))
    with pytest.raises(wire.WireError):
        wire.open_snapshot(spark, str(tmp_path / "none"))
    cache = wire.Cache(spark, str(tmp_path / "cache"), 10**9)
    (tmp_path / "cache").mkdir()
    assert cache.get("k") is None and cache.put("k", snap).root.count() == snap.root.count() and cache.put("k", snap) is not None
    cache.most = 1
    cache.put("l", snap)
    assert [e[0] for e in cache.entries()] == ["l"]


def test_every_view_on_what_was_read(spark, snap):
    assert adapters.conforms(snap) == [] and adapters.conforms(lift(spark, "/root/testdata/sf0.001")) == []
    r = registry.default()
    got = {n: r.fresh(snap, n).count() for n in ("axiom_types", "signature", "declarations", "undeclared", "annotations", "class_hierarchy", "property_hierarchy", "domain_ranges", "references", "expressions")}
    assert got["axiom_types"] == 12 and got["declarations"] == 2 and got["class_hierarchy"] == 1 and got["property_hierarchy"] == 1 and got["domain_ranges"] == 1
    assert {x["iri"] for x in r.fresh(snap, "undeclared").collect()} == {"urn:x#C", "urn:x#p", "urn:x#q"}
    assert snap.document.where("warning is not null").count() == 1
    report = {(x["rule"], x["subject"], x["detail"]) for x in __import__("ontolith.operators.validation", fromlist=["x"]).dl_report(snap.occurrence, snap.declaration, snap.property_axiom).collect()}
    assert {("non-simple property", "~urn:x#q", "38"), ("non-simple property", "urn:x#q", "101"), ("non-simple property", "urn:x#q", "72")} <= report and ("non-simple property", "urn:x#p", "72") not in report
    with pytest.raises(KeyError):
        views.in_document(snap.root, snap.document, "nobody")


def test_closure_by_level(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "path string, content string")
    library = spark.createDataFrame([("urn:leaf", "b.ofn", LEAF), ("urn:o", "a.ofn", TEXT)], "iri string, path string, content string")
    assert reader.load_closure(spark, frame(("a.ofn", TEXT)), library).document.count() == 2
    with pytest.raises(imports.ImportFailure):
        reader.load_closure(spark, frame(("a.ofn", TEXT)), library.limit(0))
    assert reader.load_closure(spark, frame(("a.ofn", TEXT)), library.limit(0), imports.RECORD).import_edge.first()["status"] == "unresolved"
    assert reader.coerce(spark, TEXT).root.count() == reader.coerce(spark, TEXT.encode()).root.count() == 12


def test_composites_of_tables(spark, snap):
    both = algebra.CompositeTables(snap, snap)
    assert both.declaration.count() == snap.declaration.distinct().count()
    with pytest.raises(algebra.DeltaError):
        algebra.in_scope(spark.createDataFrame([("m", "a")], "member string, root_id string"), "document")
    frame = spark.createDataFrame([("a",)], "root_id string")
    with pytest.raises(algebra.DeltaError):
        algebra.compose({"x": frame, "y": frame})
    delta = spark.createDataFrame([("a", "add")], "root_id string, op string")
    assert algebra.effective_fingerprint("f", delta.limit(0)) == "f" != algebra.effective_fingerprint("f", delta)
    assert algebra.composition_digest({"a": "1", "b": "2"}) == algebra.composition_digest({"b": "2", "a": "1"}) != algebra.composition_digest({"a": "2", "b": "1"})
    edges = spark.createDataFrame([("a", "b", "resolved")], "importing string, imported string, status string")
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "document_key string, fingerprint string")
    assert algebra.manifest_digest(edges, docs, "strict") == algebra.manifest_digest(edges, docs.orderBy(F.desc("document_key")), "strict") != algebra.manifest_digest(edges, docs, "ignore")


def test_canonical_graphs():
    ring = lambda names: [(f"_:{names[i]}", "p", f"_:{names[(i + 1) % len(names)]}") for i in range(len(names))]
    one, two = anonymous.canonical_graph(ring("abcdef")), anonymous.canonical_graph(ring("fbdace"))
    assert one[0] == two[0] and one[2] and sorted(one[1].values()) == list(range(6))
    assert anonymous.canonical_graph(ring("abc") + ring("def"))[0] != one[0]
    marked = ring("abcdef") + [("_:c", "q", "urn:x")]
    assert anonymous.canonical_graph(marked)[0] == anonymous.canonical_graph([(s.replace("c", "z"), p, o.replace("_:c", "_:z")) for s, p, o in marked])[0] != one[0]


def test_visitors_and_checks():
    axioms = functional.parse(TEXT).axioms

    class Names(nodes.NodeVisitor):
        def __init__(self):
            self.found = set()

        def visit_IRI(self, node):
            self.found.add(node.values[0])

    v = Names()
    for a in axioms:
        v.visit(a)
    assert "urn:x#q" in v.found and nodes.validate_structural(axioms) == (sum(1 for a in axioms for _ in nodes.walk(a)), None)
    bad = nodes.Node("EquivalentClasses", ((nodes.entity("class", "urn:a"),), ()))
    assert nodes.validate_structural([bad])[1].startswith("EquivalentClasses")


def test_negotiation_and_keys(spark):
    assert adapters.negotiate(adapters.Requirement(frozenset({"views"}), 2)).ok
    no = adapters.negotiate(adapters.Requirement(frozenset({"reasoning"}), 9, frozenset({"Nothing"})))
    assert not no.ok and no.missing == ("reasoning",) and len(no.reasons) == 3
    assert adapters.cache_key("c", "1", "f", {"a": 1, "b": 2}) == adapters.cache_key("c", "1", "f", {"b": 2, "a": 1}) != adapters.cache_key("c", "2", "f")
    assert adapters.plugins() == []
    with adapters.cancellable(spark, "count") as cancel:
        assert spark.range(10).count() == 10 and callable(cancel)
    assert adapters.progress(spark) == []
