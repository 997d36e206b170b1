"""Sets that don't fit one row or one disk: the same results as from the plain way, with less held."""

import hashlib

from ontolith.operators import algebra, imports


def rows(spark, kind, *values):
    return spark.createDataFrame(list(values), kind)


def test_fingerprints_of_large_documents_are_streamed(spark, monkeypatch):
    told = {"a": [f"r{i}" for i in range(900)], "b": [f"s{i % 50}" for i in range(400)], "c": ["r1"], "d": [f"é{i}" for i in range(300)]}
    root = rows(spark, "document_key string, root_id string", *((k, r) for k, rs in told.items() for r in rs)).repartition(5)

    def plain(rs):
        found = sorted({hashlib.sha256(r.encode()).hexdigest() for r in rs})
        return len(found), hashlib.sha256(f"document\n{len(found)}\n{''.join(found)}".encode()).hexdigest()

    monkeypatch.setattr(algebra, "BLOBS", 64)
    monkeypatch.setattr(algebra, "WAVE", 3 * 32 * 100)
    for held in (1 << 18, 200, 0):
        got = algebra.document_fingerprints(root, held, 100)
        assert {r["document_key"]: (r["n"], r["fingerprint"]) for r in got.collect()} == {k: plain(rs) for k, rs in told.items()}


def test_catalog_asks_only_for_prefixes_as_long_as_rules(spark):
    asked = rows(spark, "iri string", ("http://h/x/y",), ("http://h/z",), ("ht",), ("",), ("urn:a",))
    rules = rows(spark, "prefix string, replacement string", ("http://h/", "f/"), ("http://h/x/", "g/"), ("urn:a", "all"), ("", "none"), (None, "none"))
    found = imports.resolve_catalog(asked, rows(spark, "iri string, target string", ("urn:b", "one")), rules)
    assert {r["iri"]: r["target"] for r in found.collect()} == {"http://h/x/y": "g/y", "http://h/z": "f/z", "ht": None, "": None, "urn:a": "all"}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan and "collect_set" in plan
