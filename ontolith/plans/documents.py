"""Ontology documents written from ordinary tables: one of each nation, one of each region, in functional syntax.

They give the readers, mappers and views something to read whose contents SQL can tell as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = "urn:d:"


def _iri(kind: str, key: Column) -> Column:
    return F.concat(F.lit(f"<{PREFIX}{kind}:"), key.cast("string"), F.lit(">"))


def _text(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def regions(region: DataFrame) -> DataFrame:
    """(iri, path, content)"""
    key, name = F.col("r_regionkey"), _iri("region", F.col("r_regionkey"))
    body = _text("Ontology(<urn:doc:region:", key.cast("string"), ">\nDeclaration(Class(", name, "))\nSubClassOf(", name, " <urn:d:World>)\n)")
    return region.select(_text("urn:doc:region:", key.cast("string")).alias("iri"), _text("region/", key.cast("string"), ".ofn").alias("path"), body.alias("content"))


def nations(nation: DataFrame, customer: DataFrame, supplier: DataFrame, anonymous: bool = True) -> DataFrame:
    """(iri, path, content): a nation with its customers as individuals and, if asked for, its suppliers as anonymous ones."""
    own = _iri("nation", F.col("c_nationkey"))
    who = _iri("customer", F.col("c_custkey"))
    money = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    lines = customer.select(
        F.col("c_nationkey").alias("k"),
        _text(
            "Declaration(NamedIndividual(", who, "))\nClassAssertion(", own, " ", who, ")\nDataPropertyAssertion(<urn:d:balance> ", who, ' "', money, '"^^xsd:decimal)\nAnnotationAssertion(rdfs:label ', who, ' "', F.col("c_name"), '"@en)\n'
        ).alias("line"),
    )
    if anonymous:
        lines = lines.unionByName(supplier.select(F.col("s_nationkey").alias("k"), _text("ClassAssertion(", _iri("nation", F.col("s_nationkey")), " _:s", F.col("s_suppkey").cast("string"), ")\n").alias("line")))
    body = lines.groupBy("k").agg(F.array_join(F.sort_array(F.collect_list("line")), "").alias("lines"))
    key, c, r = F.col("n_nationkey").cast("string"), _iri("nation", F.col("n_nationkey")), _iri("region", F.col("n_regionkey"))
    some = _text(c, " ObjectSomeValuesFrom(<urn:d:lies> ", r, ")")
    text = _text(
        "Prefix(rdfs:=<http://www.w3.org/2000/01/rdf-schema#>)\nPrefix(xsd:=<http://www.w3.org/2001/XMLSchema#>)\nOntology(<urn:doc:nation:", key, ">\nImport(<urn:doc:region:", F.col("n_regionkey").cast("string"), ">)\n",
        F.when(F.col("n_nationkey") % 8 == 5, "Import(<urn:doc:missing>)\n").otherwise(""), 'Annotation(rdfs:label "', F.col("n_name"), '")\nDeclaration(ObjectProperty(<urn:d:lies>))\nDeclaration(ObjectProperty(<urn:d:near>))\nDeclaration(DataProperty(<urn:d:balance>))\nDeclaration(Class(', c, "))\nSubClassOf(", c, " ", r, ")\n",
        'SubClassOf(Annotation(Annotation(rdfs:comment "inner") rdfs:comment "outer") ', some, ")\n", F.when(F.col("n_regionkey") < 2, _text("SubClassOf(", some, ")\n")).otherwise(""),
        "EquivalentClasses(", c, " ", _iri("land", F.col("n_nationkey")), ")\nDisjointUnion(", r, " ", c, " ", _iri("rest", F.col("n_nationkey")), ")\nObjectPropertyDomain(<urn:d:lies> ", c, ")\nObjectPropertyRange(<urn:d:lies> ObjectUnionOf(", r, " <urn:d:World>))\nDataPropertyRange(<urn:d:balance> xsd:decimal)\n",
        "SubObjectPropertyOf(<urn:d:lies> <urn:d:near>)\nFunctionalObjectProperty(<urn:d:near>)\nTransitiveObjectProperty(<urn:d:lies>)\nSubClassOf(", c, " ObjectMaxCardinality(1 ObjectInverseOf(<urn:d:near>)))\n",
        F.coalesce("lines", F.lit("")), ")",
    )
    return nation.join(body, F.col("n_nationkey") == F.col("k"), "left").select(_text("urn:doc:nation:", key).alias("iri"), _text("nation/", key, ".ofn").alias("path"), text.alias("content"))
