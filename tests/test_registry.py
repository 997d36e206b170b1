import pytest

from ontolith.operators.registry import ViewRegistry, default
from ontolith.plans.lifting import lift
from ontolith.sources import reader


def test_named_views(spark, sf):
    t, r = lift(spark, sf), default()
    assert r.view(t, "class_hierarchy").count() == 131
    assert r.view(t, "class_hierarchy") is r.view(t, "class_hierarchy") and r.report()["hits"] == 2
    assert r.view(t, "axiom_types", tag=61, limit=0).count() == 0
    with pytest.raises(TypeError):
        r.view(t, "class_hierarchy", depth=2)
    with pytest.raises(KeyError):
        r.view(t, "no such view")
    with pytest.raises(ValueError):
        r.view(t, "signature", limit=-1)
    r.register("nations", lambda tables: tables.nation)
    with pytest.raises(ValueError):
        r.register("nations", lambda tables: tables.region)
    assert r.view(t, "nations").count() == 25
    r.clear()
    assert r.report()["held"] == 0
    small = ViewRegistry(most=1)
    small.register("a", lambda tables: tables.nation)
    small.register("b", lambda tables: tables.region)
    small.view(t, "a"), small.view(t, "b")
    assert small.report()["held"] == 1


def test_limits_identity_and_columns(spark, tmp_path):
    (tmp_path / "a.ofn").write_text("Ontology(<urn:o> SubClassOf(<urn:a> <urn:b>))")
    (tmp_path / "big.ofn").write_text("Ontology(<urn:big>)" + " " * 1000)
    snap = reader.read(spark, str(tmp_path), max_bytes=500)
    assert snap.document.where("error like 'LimitExceeded%'").count() == 1
    assert [tuple(r)[1:] for r in snap.identity().collect()] == [("urn:o", None, 0)]
    rows = snap.columns().orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(5))
    assert [r["tag"] for r in rows] == [1, 1, 2, 2, 61] and list(rows[4]["children"]) == [2, 3]
