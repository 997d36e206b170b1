"""Operators beside their SQL in DuckDB, at the smallest size, and properties of the view algebra."""

import duckdb
import pytest
from pyspark.sql import functions as F

from ontolith import queries
from ontolith.functions import lexical as L
from ontolith.operators import algebra, hierarchy, imports, rdf, views
from ontolith.plans import graph
from ontolith.schema import BY_NAME, constructor_spec, term

# A query of each kind; compare.py runs them all.
SOME = ["axiom_type_counts", "undeclared_entities", "preferred_label", "class_edges_component", "import_closure", "overlay_effective", "delta_combine", "composite_origins", "overlay_views", "role_analysis_non_simple", "lexical_validity", "rdf_list_items", "canonical_order", "structural_digests", "catalog_resolver"]


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, sf, db, name):
    df = queries.queries()[name](spark, sf)
    rel = db.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_registry(spark):
    assert len(BY_NAME) == 76 and BY_NAME["SubClassOf"].tag == 61
    assert constructor_spec(spark).where("name = 'HasKey'").count() == 4


def rows(spark, kind, *values):
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], kind)


def test_strict_deltas(spark):
    base = rows(spark, "root_id string", "a", "b")
    delta = lambda *v: rows(spark, "root_id string, op string", *v)
    for bad in ([("a", "add")], [("z", "remove")], [("c", "add"), ("c", "remove")]):
        with pytest.raises(algebra.DeltaError):
            algebra.apply(base, delta(*bad), strict=True)
    one, two = delta(("c", "add"), ("a", "remove")), delta(("c", "remove"), ("a", "add"), ("d", "add"))
    chained = algebra.Overlay(base, one).then(two)
    assert {r[0] for r in chained.roots().collect()} == {"a", "b", "d"} == {r[0] for r in algebra.apply(algebra.apply(base, one), two).collect()}
    assert {r[0] for r in chained.compact().roots().collect()} == {"a", "b", "d"}
    with pytest.raises(algebra.DeltaError):
        algebra.Overlay(base, one, depth=33)
    assert algebra.fingerprint(chained.roots()).first() == algebra.fingerprint(rows(spark, "root_id string", "d", "b", "a")).first()


def test_components_and_closures(spark):
    edges = rows(spark, "a string, b string", *[(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], ("x", "y"), ("y", "x"), ("z", "z"))
    got = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert {got[f"n{i:03}"] for i in range(61)} == {"n000"} and got["y"] == "x" and "z" not in got
    reach = graph.reachable(edges, rows(spark, "node string", "x", "n058"))
    assert {(r["start"], r["node"], r["depth"]) for r in reach.collect()} == {("x", "x", 0), ("x", "y", 1), ("n058", "n058", 0), ("n058", "n059", 1), ("n058", "n060", 2)}


def test_equivalence_modes(spark):
    sub = rows(spark, "sub string, sup string", ("A", "B"), ("B", "C"))
    equal = rows(spark, "root_id string, member string", ("e", "A"), ("e", "D"), ("f", "A"))
    edges = lambda mode: {tuple(r) for r in hierarchy.class_edges(sub, equal, mode).select("child", "parent").collect()}
    assert edges(hierarchy.PRESERVE) == {("A", "B"), ("B", "C")}
    assert edges(hierarchy.BIDIRECTIONAL) == {("A", "B"), ("B", "C"), ("A", "D"), ("D", "A")}
    assert edges(hierarchy.COMPONENT) == {("A", "B"), ("B", "C")}


def test_import_policies_and_resolvers(spark):
    edges = rows(spark, "importing string, imported string, status string", ("a", "b", "resolved"), ("b", "c", "not_found"))
    assert {r["status"] for r in imports.with_policy(edges, imports.IGNORE).collect()} == {"ignored"}
    assert imports.with_policy(edges, imports.RECORD).count() == 2
    with pytest.raises(imports.ImportFailure):
        imports.with_policy(edges, imports.STRICT)
    asked = rows(spark, "iri string", "u:1", "u:9", "u:loop", "http://h/x/y")
    got = {r["iri"]: (r["target"], r["status"]) for r in imports.resolve_mapping(asked, rows(spark, "iri string, target string", ("u:1", "u:2"), ("u:2", "file"), ("u:loop", "u:l2"), ("u:l2", "u:loop")), limit=8).collect()}
    assert got == {"u:1": ("file", "resolved"), "u:9": (None, "not_found"), "u:loop": (None, "cycle"), "http://h/x/y": (None, "not_found")}
    cat = imports.resolve_catalog(asked, rows(spark, "iri string, target string", ("u:1", "one")), rows(spark, "prefix string, replacement string", ("http://h/", "f/"), ("http://h/x/", "g/")))
    assert {r["iri"]: r["target"] for r in cat.collect()} == {"u:1": "one", "u:9": None, "u:loop": None, "http://h/x/y": "g/y"}
    found = imports.resolve_directory(asked, rows(spark, "path string", "y.ofn"))
    assert {r["iri"]: r["by"] for r in imports.resolve_first(cat, found).collect()} == {"u:1": 0, "u:9": None, "u:loop": None, "http://h/x/y": 0}


def test_rdf_patterns(spark):
    t = rows(spark, "s string, p string, o string", ("x", term("rdf:type"), term("owl:Axiom")), ("x", term("owl:annotatedSource"), "a"), ("x", term("owl:annotatedProperty"), "p"), ("x", term("owl:annotatedTarget"), "b"), ("a", "p", "b"), ("a", "p", "c"))
    assert rdf.reified(t).first()["present"]
    assert rdf.one(t, "p").first()["ambiguous"]
    chain = rdf.component_axioms_to_triples(rows(spark, "root_id string, member string", ("r", "c"), ("r", "a"), ("r", "b")), "eq")
    assert {(r["s"], r["o"]) for r in chain.collect()} == {("a", "b"), ("b", "c")}
    cells = [("l", "x", "l", 1), ("a", "1", "b", 1), ("b", "2", graph.NIL, 0), ("c", "3", "b", 1), ("d", "4", "gone", 1), ("x", "5", "y", 1), ("y", "6", "z", 0), ("z", "7", "x", 0), ("w", "8", "x", 1)]
    got = {(r["head"], r["position"], r["item"]) for r in graph.list_items(rows(spark, "node string, first string, rest string, head int", *cells)).collect()}
    assert got == {("a", 0, "1"), ("a", 1, "2"), ("c", 0, "3"), ("c", 1, "2")}
    assert {(r["node"], r["n"]) for r in graph.shared_tails(rows(spark, "node string, first string, rest string, head int", *cells)).collect()} == {("b", 2), ("x", 2)}


@pytest.mark.parametrize(("lexical", "datatype", "valid"), [("12", "integer", True), ("1.5", "integer", False), ("-0", "nonNegativeInteger", True), ("128", "byte", False), ("-128", "byte", True), ("+0127", "byte", True), ("18446744073709551615", "unsignedLong", True), ("18446744073709551616", "unsignedLong", False), ("9" * 60, "positiveInteger", True), ("0", "positiveInteger", False), ("true", "boolean", True), ("yes", "boolean", False), (".5", "decimal", True), ("-1", "negativeInteger", True), ("0", "negativeInteger", False), ("anything", "dateTime", True)])
def test_literals(spark, lexical, datatype, valid):
    assert rows(spark, "l string, d string", (lexical, f"xsd:{datatype}")).select(L.valid_literal(F.col("l"), F.col("d"))).first()[0] is valid


def test_iris_and_languages(spark):
    got = rows(spark, "v string", "urn:x", "http://h/a b", "rel", "u:%zz", "u:%41").select("v", L.valid_iri(F.col("v")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, False, False, False, True]
    got = rows(spark, "v string", "en", "en-GB-x-a", "e n", "a-b-b", "de-1996-1996", "sl-rozaj-rozaj", "sl-rozaj-biske", "en-x-rozaj-rozaj").select(L.valid_language(F.col("v")).alias("ok")).collect()
    assert [r["ok"] for r in got] == [True, True, False, False, False, False, True, True]


def test_sweep_eviction_ordinals_and_ids(spark):
    assert imports.depth_spans(rows(spark, "start long, end long", (0, 5), (1, 3), (2, 4), (6, 7))).first()["most"] == 3
    gone = algebra.evict(rows(spark, "name string, size long, mtime long", ("a", 5, 1), ("b", 5, 2), ("c", 5, 3)), 10)
    assert [r["name"] for r in gone.collect()] == ["a"]
    ids = views.dense_ids(rows(spark, "iri string", *[f"u{i}" for i in range(50)]), F.struct(F.length("iri"), F.col("iri"))).orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(50)) and [r["iri"] for r in ids[:2]] == ["u0", "u1"]


def test_stream_equals_batch(spark, sf, tmp_path):
    from ontolith.streaming import deltas

    raw = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    raw.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in/log"))
    deltas.follow(deltas.read_log(spark, str(tmp_path / "in/log"), raw.schema), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    from ontolith.plans.lifting import lift

    batch = algebra.last_ops(lift(spark, sf).delta_log)
    assert {tuple(r) for r in deltas.state(spark, str(tmp_path / "out")).select("root_id", "op").collect()} == {tuple(r) for r in batch.collect()}
