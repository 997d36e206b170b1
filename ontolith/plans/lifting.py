"""Lifts ordinary tables into axiom tables.

Each view is portable SQL over the input tables or earlier views, so an ontology is a set of lazy
Spark views: nothing is written, filters and columns reach the scans of the tables below.

root_id is the axiom's text form; equal axioms have equal ids, and distinct() makes sets. Standard
terms are written short in the SQL and mean their full IRIs in both engines.

The mapping picks which rows make which axioms (only some of the documents are declared, some of the
pairs are equivalent), so that anti-joins and components have both outcomes; the tables made
so are then read whole by every query.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import spelled_out

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")

VIEWS: dict[str, str] = {
    "sub_class": """
        SELECT 'SubClassOf(' || sub || ' ' || sup || ')' AS root_id, sub, sup, document_key FROM (
            SELECT 'urn:d:nation:' || cast(n_nationkey AS string) AS sub, 'urn:d:region:' || cast(n_regionkey AS string) AS sup, 'region:' || cast(n_regionkey AS string) AS document_key FROM nation
            UNION ALL
            SELECT DISTINCT 'urn:d:brand:' || p_brand, 'urn:d:type:' || p_type, 'parts' FROM part) s""",
    "equivalent_class": """
        SELECT 'EquivalentClasses(T ' || d.h || ')' AS root_id, 'urn:d:doc:' || cast(d.doc_id AS string) AS member, 'documents' AS document_key
        FROM (SELECT doc_id, md5(text) AS h, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) d WHERE d.n >= 2
        UNION ALL
        SELECT 'EquivalentClasses(C ' || cast(a.doc_id AS string) || ')', 'urn:d:doc:' || cast(a.doc_id AS string), 'documents' FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 10 < 4
        UNION ALL
        SELECT 'EquivalentClasses(C ' || cast(a.doc_id AS string) || ')', 'urn:d:doc:' || cast(b.doc_id AS string), 'documents' FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 10 < 4""",
    "declaration": """
        SELECT 'Declaration(' || kind || ' ' || iri || ')' AS root_id, kind, iri, document_key FROM (
            SELECT 'class' AS kind, 'urn:d:region:' || cast(r_regionkey AS string) AS iri, 'region:' || cast(r_regionkey AS string) AS document_key FROM region
            UNION ALL SELECT 'class', 'urn:d:nation:' || cast(n_nationkey AS string), 'region:' || cast(n_regionkey AS string) FROM nation WHERE n_nationkey % 2 = 0
            UNION ALL SELECT 'named_individual', 'urn:d:customer:' || cast(c_custkey AS string), 'customers' FROM customer
            UNION ALL SELECT 'named_individual', 'urn:d:supplier:' || cast(s_suppkey AS string), 'suppliers' FROM supplier
            UNION ALL SELECT 'class', 'urn:d:doc:' || cast(doc_id AS string), 'documents' FROM documents WHERE doc_id % 3 <> 0
            UNION ALL SELECT 'object_property', 'urn:d:placedBy', 'orders'
            UNION ALL SELECT 'data_property', 'urn:d:totalPrice', 'orders'
            UNION ALL SELECT 'datatype', 'urn:d:placedBy', 'orders'
            UNION ALL SELECT 'data_property', 'urn:d:quality', 'documents'
            UNION ALL SELECT 'annotation_property', 'urn:d:quality', 'documents'
            UNION ALL SELECT 'class', 'urn:d:Status', 'orders'
            UNION ALL SELECT 'datatype', 'urn:d:Status', 'orders') d""",
    "class_assertion": """
        SELECT 'ClassAssertion(' || class_iri || ' ' || individual || ')' AS root_id, class_iri, individual, document_key FROM (
            SELECT 'urn:d:nation:' || cast(c_nationkey AS string) AS class_iri, 'urn:d:customer:' || cast(c_custkey AS string) AS individual, 'customers' AS document_key FROM customer
            UNION ALL SELECT 'urn:d:nation:' || cast(s_nationkey AS string), 'urn:d:supplier:' || cast(s_suppkey AS string), 'suppliers' FROM supplier) a""",
    "object_assertion": """
        SELECT 'ObjectPropertyAssertion(' || property || ' ' || source || ' ' || target || ')' AS root_id, property, source, target, 'orders' AS document_key FROM (
            SELECT 'urn:d:placedBy' AS property, 'urn:d:order:' || cast(o_orderkey AS string) AS source, 'urn:d:customer:' || cast(o_custkey AS string) AS target FROM orders
            UNION ALL SELECT DISTINCT 'urn:d:hasPart', 'urn:d:order:' || cast(l_orderkey AS string), 'urn:d:part:' || cast(l_partkey AS string) FROM lineitem
            UNION ALL SELECT DISTINCT 'urn:d:suppliedBy', 'urn:d:order:' || cast(l_orderkey AS string), 'urn:d:supplier:' || cast(l_suppkey AS string) FROM lineitem) o""",
    "data_assertion": """
        SELECT 'DataPropertyAssertion(' || property || ' ' || source || ' ' || lexical || '^^' || datatype || ')' AS root_id, property, source, lexical, datatype, 'orders' AS document_key FROM (
            SELECT 'urn:d:totalPrice' AS property, 'urn:d:order:' || cast(o_orderkey AS string) AS source, cast(cast(o_totalprice AS decimal(18,2)) AS string) AS lexical, 'xsd:decimal' AS datatype FROM orders
            UNION ALL SELECT 'urn:d:size', 'urn:d:part:' || cast(p_partkey AS string), cast(p_size AS string), 'xsd:integer' FROM part
            UNION ALL SELECT DISTINCT 'urn:d:quality', 'urn:d:doc:' || cast(doc_id AS string), cast(quality AS string), 'xsd:boolean' FROM labels) v""",
    "annotation_assertion": """
        SELECT 'AnnotationAssertion(' || property || ' ' || subject || ' ' || value || coalesce('@' || lang, '') || ')' AS root_id, property, subject, value_kind, value, lang, 'annotations' AS document_key FROM (
            SELECT 'rdfs:label' AS property, 'urn:d:doc:' || cast(doc_id AS string) AS subject, 'literal' AS value_kind, text AS value, lower(lang) AS lang FROM documents
            UNION ALL SELECT 'rdfs:label', 'urn:d:customer:' || cast(c_custkey AS string), 'literal', c_name, cast(NULL AS string) FROM customer
            UNION ALL SELECT 'rdfs:label', 'urn:d:source:' || source, 'literal', min(text), lower(lang) FROM documents GROUP BY source, lang
            UNION ALL SELECT 'rdfs:seeAlso', 'urn:d:page:' || cast(page_id AS string), 'iri', url, cast(NULL AS string) FROM pages) n""",
    "domain_range": """
        SELECT 'DomainRange(' || cast(tag AS string) || ' ' || property || ' ' || value || ')' AS root_id, tag, property_kind, property, record_kind, value, NOT (value LIKE '%(%') AS named, 'schema' AS document_key FROM (
            SELECT DISTINCT 74 AS tag, 'object' AS property_kind, 'urn:d:prop:' || p_brand AS property, 'domain' AS record_kind, 'urn:d:type:' || p_type AS value FROM part WHERE p_size < 10
            UNION ALL SELECT DISTINCT 75, 'object', 'urn:d:prop:' || p_brand, 'range', 'ObjectUnionOf(urn:d:type:' || p_type || ' urn:d:mfgr:' || ('s' || cast(p_size AS string)) || ')' FROM part WHERE p_size > 40
            UNION ALL SELECT DISTINCT 93, 'data', 'urn:d:data:' || p_brand, 'domain', CASE WHEN p_size < 5 THEN 'ObjectComplementOf(urn:d:type:' || p_type || ')' ELSE 'urn:d:type:' || p_type END FROM part WHERE p_size < 8
            UNION ALL SELECT DISTINCT 94, 'data', 'urn:d:data:' || p_brand, 'range', 'xsd:integer' FROM part
            UNION ALL SELECT DISTINCT 122, 'annotation', 'urn:d:note:' || ('s' || cast(p_size AS string)), 'domain', 'urn:d:type:' || p_type FROM part WHERE p_size = 1
            UNION ALL SELECT DISTINCT 123, 'annotation', 'urn:d:note:' || ('s' || cast(p_size AS string)), 'range', 'rdfs:Literal' FROM part) v""",
    "property_axiom": """
        SELECT 'Property(' || cast(tag AS string) || ' ' || first || ' ' || second || ' ' || chain || ')' AS root_id, tag, first, second, chain, 'schema' AS document_key FROM (
            SELECT DISTINCT 70 AS tag, 'urn:d:prop:' || p_brand AS first, 'urn:d:prop:' || ('s' || cast(p_size AS string)) AS second, '' AS chain FROM part
            UNION ALL SELECT DISTINCT 70, '', 'urn:d:prop:' || p_type, 'urn:d:prop:' || p_brand || '>urn:d:prop:' || ('s' || cast(p_size AS string)) FROM part WHERE p_size = 7
            UNION ALL SELECT DISTINCT 71, 'urn:d:prop:' || p_type, 'urn:d:same:' || p_type, '' FROM part WHERE p_size < 12
            UNION ALL SELECT DISTINCT 72, 'urn:d:prop:' || p_brand, 'urn:d:prop:' || p_type, '' FROM part WHERE p_size = 5
            UNION ALL SELECT DISTINCT 73, 'urn:d:prop:' || p_type, 'urn:d:inverse:' || p_type, '' FROM part WHERE p_size < 20
            UNION ALL SELECT DISTINCT 76, 'urn:d:prop:' || p_type, '', '' FROM part WHERE p_size = 9
            UNION ALL SELECT DISTINCT 77, 'urn:d:inverse:' || p_type, '', '' FROM part WHERE p_size = 10
            UNION ALL SELECT DISTINCT 79, 'urn:d:prop:' || ('s' || cast(p_size AS string)), '', '' FROM part WHERE p_size < 3
            UNION ALL SELECT DISTINCT 80, 'urn:d:same:' || p_type, '', '' FROM part WHERE p_size = 4
            UNION ALL SELECT DISTINCT 81, 'urn:d:prop:' || p_brand, '', '' FROM part WHERE p_size = 6
            UNION ALL SELECT DISTINCT 82, 'urn:d:prop:' || p_brand, '', '' FROM part WHERE p_size = 2 AND p_retailprice > 950
            UNION ALL SELECT 70, 'owl:bottomObjectProperty', 'urn:d:leastProp', ''
            UNION ALL SELECT 81, 'urn:d:leastProp', '', ''
            UNION ALL SELECT DISTINCT 90, 'urn:d:data:' || p_brand, 'urn:d:data:' || ('s' || cast(p_size AS string)), '' FROM part
            UNION ALL SELECT DISTINCT 91, 'urn:d:data:' || ('s' || cast(p_size AS string)), 'urn:d:sum:' || ('s' || cast(p_size AS string)), '' FROM part
            UNION ALL SELECT DISTINCT 121, 'urn:d:note:' || ('s' || cast(p_size AS string)), 'rdfs:comment', '' FROM part) v""",
    "import_edge": """
        SELECT importing, imported, status FROM (
            SELECT 'nation:' || cast(n_nationkey AS string) AS importing, 'nation:' || cast((7 * n_nationkey + 3) % 25 AS string) AS imported, 'resolved' AS status FROM nation
            UNION ALL SELECT 'nation:' || cast(n_nationkey AS string), 'region:' || cast(n_regionkey AS string), CASE WHEN n_nationkey % 8 = 5 THEN 'unresolved' ELSE 'resolved' END FROM nation) e""",
    "delta_log": """
        SELECT event_id, ts, CASE WHEN event_type IN ('signup', 'view') THEN 'add' ELSE 'remove' END AS op, 'Declaration(named_individual urn:d:user:' || cast(user_id AS string) || ')' AS root_id
        FROM events WHERE event_type IN ('signup', 'view', 'error')""",
    "triple": """
        SELECT source AS s, property AS p, target AS o, 'iri' AS o_kind, cast(NULL AS string) AS o_lang FROM object_assertion
        UNION ALL SELECT sub, 'rdfs:subClassOf', sup, 'iri', cast(NULL AS string) FROM sub_class
        UNION ALL SELECT subject, property, value, value_kind, lang FROM annotation_assertion
        UNION ALL SELECT iri, 'rdf:type', 'owl:' || kind, 'iri', cast(NULL AS string) FROM declaration""",
    "rdf_list": """
        SELECT '_:l' || cast(l_orderkey AS string) || '.' || cast(k AS string) AS node, 'urn:d:part:' || cast(l_partkey AS string) AS first,
               CASE WHEN k < n THEN '_:l' || cast(l_orderkey AS string) || '.' || cast(k + 1 AS string) ELSE 'rdf:nil' END AS rest, CASE WHEN k = 1 THEN 1 ELSE 0 END AS head
        FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) x""",
    "root": """
        SELECT root_id, 61 AS tag, 'axiom' AS root_kind, document_key FROM sub_class
        UNION ALL SELECT DISTINCT root_id, 62, 'axiom', document_key FROM equivalent_class
        UNION ALL SELECT root_id, 60, 'axiom', document_key FROM declaration
        UNION ALL SELECT root_id, 112, 'axiom', document_key FROM class_assertion
        UNION ALL SELECT root_id, 113, 'axiom', document_key FROM object_assertion
        UNION ALL SELECT root_id, 115, 'axiom', document_key FROM data_assertion
        UNION ALL SELECT root_id, 120, 'axiom', document_key FROM annotation_assertion
        UNION ALL SELECT root_id, tag, 'axiom', document_key FROM domain_range
        UNION ALL SELECT root_id, tag, 'axiom', document_key FROM property_axiom""",
    "occurrence": """
        SELECT root_id, 60 AS tag, kind AS entity_kind, iri, 'declaration' AS role, false AS in_annotation FROM declaration
        UNION ALL SELECT root_id, 61, 'class', sub, 'subclass', false FROM sub_class
        UNION ALL SELECT root_id, 61, 'class', sup, 'superclass', false FROM sub_class
        UNION ALL SELECT root_id, 62, 'class', member, 'operand', false FROM equivalent_class
        UNION ALL SELECT root_id, 112, 'class', class_iri, 'class_expression', false FROM class_assertion
        UNION ALL SELECT root_id, 112, 'named_individual', individual, 'structural', false FROM class_assertion
        UNION ALL SELECT root_id, 113, 'object_property', property, 'property', false FROM object_assertion
        UNION ALL SELECT root_id, 113, 'named_individual', source, 'subject', false FROM object_assertion
        UNION ALL SELECT root_id, 113, 'named_individual', target, 'object', false FROM object_assertion
        UNION ALL SELECT root_id, 115, 'data_property', property, 'property', false FROM data_assertion
        UNION ALL SELECT root_id, 115, 'named_individual', source, 'subject', false FROM data_assertion
        UNION ALL SELECT root_id, 115, 'datatype', datatype, 'datatype', false FROM data_assertion
        UNION ALL SELECT root_id, 120, 'annotation_property', property, 'property', true FROM annotation_assertion""",
}


#: Places of one axiom as one scan, where the portable form reads the axioms once a place.
PLACES = {
    "object_assertion": "SELECT root_id, 113 AS tag, inline(array(named_struct('entity_kind', 'object_property', 'iri', property, 'role', 'property'), named_struct('entity_kind', 'named_individual', 'iri', source, 'role', 'subject'), named_struct('entity_kind', 'named_individual', 'iri', target, 'role', 'object'))) FROM object_assertion",
    "data_assertion": "SELECT root_id, 115 AS tag, inline(array(named_struct('entity_kind', 'data_property', 'iri', property, 'role', 'property'), named_struct('entity_kind', 'named_individual', 'iri', source, 'role', 'subject'), named_struct('entity_kind', 'datatype', 'iri', datatype, 'role', 'datatype'))) FROM data_assertion",
    "class_assertion": "SELECT root_id, 112 AS tag, inline(array(named_struct('entity_kind', 'class', 'iri', class_iri, 'role', 'class_expression'), named_struct('entity_kind', 'named_individual', 'iri', individual, 'role', 'structural'))) FROM class_assertion",
    "sub_class": "SELECT root_id, 61 AS tag, inline(array(named_struct('entity_kind', 'class', 'iri', sub, 'role', 'subclass'), named_struct('entity_kind', 'class', 'iri', sup, 'role', 'superclass'))) FROM sub_class",
}


def one_scan(sql: str) -> str:
    """The occurrence view with each kind of axiom read once."""
    kept = [part for part in sql.split("UNION ALL") if not any(part.rstrip().endswith(f"FROM {name}") for name in PLACES)]
    return " UNION ALL ".join([*kept, *(f" SELECT root_id, tag, entity_kind, iri, role, false FROM ({text}) {name}_places " for name, text in PLACES.items())])


@dataclass(frozen=True)
class Tables:
    """The axiom tables of one ontology; attributes are DataFrames."""

    spark: SparkSession
    prefix: str

    def repeating(self, name: str) -> DataFrame:
        """A view whose rows may repeat, for operators that take repeats out themselves: none of its own views does so before."""
        _register(self.spark, self.prefix, {n: sql.replace("SELECT DISTINCT", "SELECT") for n, sql in VIEWS.items()}, "repeating_")
        return self.spark.table(f"{self.prefix}repeating_{name}")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in SOURCES:
            raise AttributeError(name)
        return self.spark.table(self.prefix + name)


_number = itertools.count()


def _register(spark: SparkSession, prefix: str, views: dict[str, str], mark: str = "") -> None:
    """Views under prefix and mark, over input tables under prefix."""
    known = re.compile(r"(?<=FROM )(" + "|".join([*SOURCES, *VIEWS]) + r")\b|(?<=JOIN )(" + "|".join([*SOURCES, *VIEWS]) + r")\b")
    for name, sql in views.items():
        sql = spelled_out(one_scan(sql) if name == "occurrence" else sql)
        spark.sql(known.sub(lambda m: prefix + mark * (m[0] in VIEWS) + m[0], sql)).createOrReplaceTempView(prefix + mark + name)


def lift(spark: SparkSession, sf_dir: str) -> Tables:
    """Registers the input tables and the views above them under a prefix of their own."""
    prefix = f"ontolith_{next(_number)}_"
    for name in SOURCES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(prefix + name)
    _register(spark, prefix, VIEWS)
    return Tables(spark, prefix)


def portable(sql: str) -> str:
    """A query over the views as one statement for another SQL engine."""
    return spelled_out("WITH " + ",\n".join(f"{n} AS ({v})" for n, v in VIEWS.items()) + "\n" + sql)
