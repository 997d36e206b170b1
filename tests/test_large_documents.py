"""Documents with many axioms: read an axiom at a time, told in short rows, and only in the rows that a query asks for."""

import pytest

from ontolith import parsed
from ontolith.sources import functional, reader

MANY = 6000


def text(n: int, end: str = ")") -> str:
    return "Ontology(<urn:o>\n" + "".join(f'Declaration(NamedIndividual(<urn:i:{i}>))\nAnnotationAssertion(<urn:note> <urn:i:{i}> "{i}")\n' for i in range(n)) + end


def test_tokens_of_a_long_text_are_not_all_held():
    reading = functional.Reader(text(MANY))
    reading.begin()
    assert sum(1 for _ in reading.axioms() if len(reading.tokens) <= functional.AHEAD) == 2 * MANY


def test_rows_of_a_long_document_come_in_batches(spark):
    parts = tuple(reader.PARTS)
    rows = reader._Rows(reader._arrow_schema(parts), parts)
    batches = [*rows.document("a.ofn", text(5).encode()), *rows.document("b.ofn", text(MANY).encode()), *rows.flush()]
    assert max(b.num_rows for b in batches) <= reader.BATCH + 100
    count = lambda part: sum(b.column("part").to_pylist().count(part) for b in batches)
    assert (count("document"), count("root"), count("occurrence")) == (2, 2 * MANY + 10, (MANY + 5) * (3 + 7))


def test_a_document_that_fails_at_its_end_has_no_axioms(spark):
    files = spark.createDataFrame([("a.ofn", text(5)), ("b.ofn", text(MANY, "SubClassOf(<urn:a>))")), ("c.ofn", text(3, "x"))], "path string, content string")
    snap = reader.read_texts(files)
    assert {r["path"]: r["error"] is None for r in snap.document.collect()} == {"a.ofn": True, "b.ofn": False, "c.ofn": False}
    assert snap.root.count() == 10 and snap.occurrence.select("root_id").distinct().count() == 10


def test_rows_that_were_not_read_are_an_error(spark):
    snap = reader.read_texts(spark.createDataFrame([("a.ofn", text(2))], "path string, content string"), parts=("root",))
    assert snap.root.count() == 4 and snap.document.count() == 1
    with pytest.raises(ValueError, match="occurrence"):
        snap.occurrence  # noqa: B018


ASKED = {
    "parsed_axiom_types": {"root"},
    "parsed_distinct_nodes": {"node"},
    "parsed_dl_report": {"occurrence", "root"},
    "parsed_documents": {"document"},
    "parsed_load_closure": {"document"},
    "parsed_identities": {"document"},
    "parsed_import_edges": {"document"},
    "parsed_load_report": {"document"},
    "parsed_annotations": {"root"},
    "parsed_class_edges": {"root"},
    "parsed_logical_forms": {"root"},
    "parsed_complex_endpoints": {"root"},
    "parsed_declarations": {"root"},
    "parsed_domain_range_loss": {"root"},
    "parsed_domain_ranges": {"root"},
    "parsed_literals": {"root"},
    "parsed_ontology_annotations": {"root"},
    "parsed_preferred_labels": {"root"},
    "parsed_nested_annotations": {"occurrence"},
    "parsed_places_of_an_iri": {"occurrence"},
    "parsed_places_without_axiom": {"occurrence", "root"},
}


@pytest.mark.parametrize("name", ASKED)
def test_a_query_keeps_the_rows_it_asks_for(spark, sf, monkeypatch, name):
    class Asked(Exception):
        pass

    def read_texts(files, **options):
        raise Asked(options["parts"])

    monkeypatch.setattr(reader, "read_texts", read_texts)
    with pytest.raises(Asked) as asked:
        parsed.queries()[name](spark, sf)
    assert {*asked.value.args[0]} == ASKED[name]
