"""Registered queries over parsed ontologies: documents are written from the tables, read, and asked; SQL tells the same from the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .operators import anonymous, hierarchy, imports, registry, validation, views
from .plans import documents
from .plans.graph import settle
from .schema import spelled_out, term
from .sources import reader

_QUERIES, _SQL = {}, {}
TABLES = ("region", "nation", "customer", "supplier", "orders", "lineitem")


class Given:
    """The input tables and the documents made of them."""

    def __init__(self, spark, sf_dir: str):
        self.spark = spark
        self.table = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES}

    def nations(self, anonymous: bool = True):
        return documents.nations(*(self.table[t] for t in ("nation", "customer", "supplier")), anonymous=anonymous)

    def regions(self):
        return documents.regions(self.table["region"])

    def read(self, *parts: str) -> reader.Snapshot:
        """All documents, read whole; parts: the rows that the query asks for beside the documents' own, all if none is named."""
        return reader.read_texts(self.nations().unionByName(self.regions()).select("path", "content"), parts=parts or tuple(reader.PARTS))


def query(sql: str):
    def register(fn):
        _QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Given(spark, sf_dir))
        _SQL[fn.__name__] = spelled_out(sql)
        return fn

    return register


_N, _R, _C = "'urn:d:nation:' || cast(n_nationkey AS varchar)", "'urn:d:region:' || cast(n_regionkey AS varchar)", "'urn:d:customer:' || cast(c_custkey AS varchar)"
#: Each axiom of the documents by type.
_ROOTS = """r AS (SELECT 60 AS tag FROM nation CROSS JOIN range(4) UNION ALL SELECT 60 FROM customer UNION ALL SELECT 60 FROM region
 UNION ALL SELECT 61 FROM nation CROSS JOIN range(3) UNION ALL SELECT 61 FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 61 FROM region
 UNION ALL SELECT unnest([62, 64, 70, 74, 75, 76, 82, 94]) FROM nation UNION ALL SELECT 112 FROM customer UNION ALL SELECT 112 FROM supplier UNION ALL SELECT unnest([115, 120]) FROM customer)"""
_ENTITIES = f"""e AS (SELECT 'class' AS entity_kind, {_N} AS iri FROM nation UNION SELECT 'class', 'urn:d:land:' || cast(n_nationkey AS varchar) FROM nation UNION SELECT 'class', 'urn:d:rest:' || cast(n_nationkey AS varchar) FROM nation
 UNION SELECT 'class', 'urn:d:region:' || cast(r_regionkey AS varchar) FROM region UNION SELECT 'class', 'urn:d:World' UNION SELECT 'class', 'owl:Thing' UNION SELECT 'named_individual', {_C} FROM customer
 UNION SELECT 'object_property', 'urn:d:lies' UNION SELECT 'object_property', 'urn:d:near' UNION SELECT 'data_property', 'urn:d:balance' UNION SELECT 'datatype', unnest(['xsd:decimal', 'xsd:string', 'rdf:PlainLiteral']) UNION SELECT 'annotation_property', unnest(['rdfs:label', 'rdfs:comment']))"""


@query(f"WITH {_ROOTS} SELECT tag, count(*) AS n FROM r GROUP BY tag")
def parsed_axiom_types(g):
    return views.axiom_type_counts(g.read("root").root).select("tag", "n")


@query("SELECT 'urn:doc:nation:' || cast(n_nationkey AS varchar) AS ontology_iri, 'nation/' || cast(n_nationkey AS varchar) || '.ofn' AS path, 'functional' AS format, true AS ok FROM nation UNION ALL SELECT 'urn:doc:region:' || cast(r_regionkey AS varchar), 'region/' || cast(r_regionkey AS varchar) || '.ofn', 'functional', true FROM region")
def parsed_documents(g):
    return g.read("document").document.select("ontology_iri", "path", "format", F.col("error").isNull().alias("ok"))


@query(f"WITH {_ENTITIES} SELECT entity_kind, iri FROM e")
def parsed_signature(g):
    return views.entities(g.read("occurrence").occurrence)


@query(f"WITH {_ENTITIES} SELECT entity_kind, iri FROM e WHERE NOT (entity_kind IN ('datatype', 'annotation_property') OR iri LIKE 'owl:%' OR iri LIKE 'urn:d:nation:%' OR iri LIKE 'urn:d:region:%' OR iri LIKE 'urn:d:customer:%' OR entity_kind LIKE '%property')")
def parsed_undeclared(g):
    t = g.read("occurrence", "root")
    return views.undeclared(t.occurrence, t.declaration)


@query(f"WITH {_ENTITIES} SELECT 'missing declaration' AS rule, iri AS subject, entity_kind AS detail FROM e WHERE iri LIKE 'urn:%' AND entity_kind = 'class' AND NOT (iri LIKE 'urn:d:nation:%' OR iri LIKE 'urn:d:region:%') UNION ALL SELECT 'non-simple property', 'urn:d:near', '76' FROM nation UNION ALL SELECT 'non-simple property', '~urn:d:near', '39' FROM nation")
def parsed_dl_report(g):
    t = g.read("occurrence", "root")
    return validation.dl_report(t.occurrence, t.declaration, t.property_axiom)


@query(f"SELECT kind, iri, count(*) AS n FROM (SELECT 'class' AS kind, {_N} AS iri FROM nation UNION ALL SELECT 'class', 'urn:d:region:' || cast(r_regionkey AS varchar) FROM region UNION ALL SELECT 'named_individual', {_C} FROM customer UNION ALL SELECT 'object_property', unnest(['urn:d:lies', 'urn:d:near']) FROM nation UNION ALL SELECT 'data_property', 'urn:d:balance' FROM nation) d GROUP BY 1, 2")
def parsed_declarations(g):
    return g.read("root").declaration.groupBy("kind", "iri").agg(F.count("*").alias("n"))


@query(f"SELECT {_C} AS subject, 'literal' AS value_kind, c_name AS value, 'en' AS lang FROM customer")
def parsed_annotations(g):
    return views.annotation_values(g.read("root").annotation_assertion, views.LABEL)


@query(f"SELECT {_C} AS subject, c_name AS value, 'en' AS lang FROM customer")
def parsed_preferred_labels(g):
    return views.preferred_label(g.read("root").annotation_assertion, ["de", "en"])


@query(f"SELECT {_N} AS child, {_R} AS parent FROM nation UNION SELECT 'urn:d:region:' || cast(r_regionkey AS varchar), 'urn:d:World' FROM region UNION SELECT {_N}, 'urn:d:land:' || cast(n_nationkey AS varchar) FROM nation UNION SELECT 'urn:d:land:' || cast(n_nationkey AS varchar), {_N} FROM nation UNION SELECT 'urn:d:rest:' || cast(n_nationkey AS varchar), {_R} FROM nation")
def parsed_class_edges(g):
    t = g.read("root")
    return hierarchy.class_edges(t.sub_class, t.equivalent_class, hierarchy.BIDIRECTIONAL, t.disjoint_union)


@query("SELECT 70 AS tag, 'urn:d:lies' AS child, 'urn:d:near' AS parent")
def parsed_property_edges(g):
    return hierarchy.property_edges(g.read("root").property_axiom)


@query(f"SELECT 'object' AS property_kind, 'urn:d:lies' AS property, 'domain' AS record_kind, {_N} AS value FROM nation UNION ALL SELECT 'data', 'urn:d:balance', 'range', 'xsd:decimal' FROM nation")
def parsed_domain_ranges(g):
    return hierarchy.domain_ranges(g.read("root").domain_range, named_only=True).select("property_kind", "property", "record_kind", "value")


@query("SELECT 'object' AS property_kind, 'domain' AS record_kind, count(*) AS n, 0::bigint AS lost FROM nation UNION ALL SELECT 'object', 'range', count(*), count(*) FROM nation UNION ALL SELECT 'data', 'range', count(*), 0 FROM nation")
def parsed_domain_range_loss(g):
    return hierarchy.domain_range_loss(g.read("root").domain_range)


@query(f"SELECT 'urn:d:balance' AS property, {_C} AS source, cast(cast(c_acctbal AS decimal(18,2)) AS varchar) AS lexical, 'xsd:decimal' AS datatype, true AS valid FROM customer")
def parsed_literals(g):
    return validation.literal_report(g.read("root").data_assertion.select("property", "source", "lexical", "datatype"))


@query("SELECT status, count(*) AS n FROM (SELECT 'resolved' AS status FROM nation UNION ALL SELECT 'unresolved' FROM nation WHERE n_nationkey % 8 = 5) e GROUP BY 1")
def parsed_import_edges(g):
    return imports.statuses(g.read("document").import_edge)


@query("SELECT 'urn:doc:nation:' || cast(n_nationkey AS varchar) AS ontology_iri, n_name AS value FROM nation")
def parsed_ontology_annotations(g):
    t = g.read("root")
    rows = views.ontology_annotations(t.root).select("document_key", F.col("args")[1]["text"].alias("value"))
    return rows.join(t.document, "document_key").select("ontology_iri", "value")


@query("SELECT 61 AS tag, (SELECT count(*) FROM nation) * 2 + (SELECT count(*) FROM nation WHERE n_regionkey < 2) AS n")
def parsed_complex_endpoints(g):
    return g.read("root").complex_endpoints


@query("SELECT fmt AS format, (SELECT count(*) FROM nation) AS documents, 0::bigint AS failed, (SELECT count(*) FROM nation) * 16 + (SELECT count(*) FROM nation WHERE n_regionkey < 2) + (SELECT count(*) FROM customer) * 4 AS roots, true AS same FROM (VALUES ('functional'), ('owlxml'), ('rdfxml'), ('turtle')) f(fmt)")
def parsed_round_trips(g):
    """Each document written in each format and read again: its axioms are the same."""
    docs = settle(g.nations(anonymous=False).select("path", "content"))
    first = reader.read_texts(docs)
    own = first.root.join(first.document.select("document_key", "ontology_iri"), "document_key").select("ontology_iri", "root_id").distinct()
    ending = {"functional": "ofn", "owlxml": "owx", "rdfxml": "rdf", "turtle": "ttl"}
    out = []
    for fmt in reader.FORMATS:
        written = settle(reader.render_documents(docs, fmt))
        again = reader.read_texts(written.where("content is not null").select(F.concat("path", F.lit(f".{ending[fmt]}")).alias("path"), "content"))
        back = again.root.join(again.document.select("document_key", "ontology_iri"), "document_key").select("ontology_iri", "root_id").distinct()
        one = again.document.agg(F.first("format").alias("format"), F.count("*").alias("documents"), F.count_if(F.col("error").isNotNull()).alias("failed"))
        both = back.withColumn("x", F.lit(1)).unionByName(own.withColumn("x", F.lit(2))).groupBy("ontology_iri", "root_id").agg(F.sum("x").alias("x")).agg(F.count("*").alias("roots"), F.bool_and(F.col("x") == 3).alias("same"))
        out.append(one.join(F.broadcast(both)))
    return reduce(lambda a, b: a.unionByName(b), out)


@query(f"SELECT p, count(*) AS n FROM (SELECT 'rdf:type' AS p FROM nation CROSS JOIN range(2) UNION ALL SELECT 'rdf:type' FROM customer CROSS JOIN range(2) UNION ALL SELECT 'urn:d:balance' FROM customer UNION ALL SELECT 'rdfs:label' FROM customer UNION ALL SELECT 'rdfs:label' FROM nation UNION ALL SELECT 'owl:imports' FROM nation UNION ALL SELECT 'owl:imports' FROM nation WHERE n_nationkey % 8 = 5 UNION ALL SELECT 'owl:equivalentClass' FROM nation UNION ALL SELECT 'owl:disjointUnionOf' FROM nation UNION ALL SELECT 'rdfs:subPropertyOf' FROM nation UNION ALL SELECT 'owl:onProperty' FROM nation CROSS JOIN range(2)) x WHERE p IN ('urn:d:balance', 'owl:imports', 'owl:equivalentClass', 'owl:disjointUnionOf', 'rdfs:subPropertyOf') GROUP BY p")
def parsed_triples(g):
    wanted = ["urn:d:balance", *map(term, ("owl:imports", "owl:equivalentClass", "owl:disjointUnionOf", "rdfs:subPropertyOf"))]
    return reader.encoded_triples(g.nations(anonymous=False)).where(F.col("p").isin(*wanted)).groupBy("p").agg(F.count("*").alias("n"))


@query(f"WITH {_ENTITIES} SELECT 2 AS tag, count(*) AS n FROM e UNION ALL SELECT 60, 3 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer) UNION ALL SELECT 70, 1 UNION ALL SELECT 3, count(*) FROM supplier")
def parsed_distinct_nodes(g):
    """Equal nodes of all documents are one."""
    return g.read("node").node.where("tag in (2, 3, 60, 70)").groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT 'logical' AS form, count(*) * 2 AS n FROM nation UNION ALL SELECT 'written', count(*) * 2 + (SELECT count(*) FROM nation WHERE n_regionkey < 2) FROM nation")
def parsed_logical_forms(g):
    """Sub-class axioms over complex classes with and without their annotations."""
    rows = g.read("root").root.where("tag = 61").where(F.col("args")[1]["kind"] == "expression")
    return rows.select(F.lit("written").alias("form"), F.col("root_id").alias("x")).unionByName(rows.select(F.lit("logical").alias("form"), F.col("logical_id").alias("x"))).distinct().groupBy("form").agg(F.count("*").alias("n"))


@query("SELECT entity_kind, n FROM (SELECT 'class' AS entity_kind, (7 + (SELECT count(*) FROM nation WHERE n_nationkey = 3 AND n_regionkey < 2) + (SELECT count(*) FROM customer WHERE c_nationkey = 3) + (SELECT count(*) FROM supplier WHERE s_nationkey = 3))::bigint AS n UNION ALL SELECT 'iri', 7 + (SELECT count(*) FROM nation WHERE n_nationkey = 3 AND n_regionkey < 2) + (SELECT count(*) FROM customer WHERE c_nationkey = 3) + (SELECT count(*) FROM supplier WHERE s_nationkey = 3)) x")
def parsed_places_of_an_iri(g):
    return views.of_iri(g.read("occurrence").occurrence, "urn:d:nation:3").groupBy(F.coalesce("entity_kind", F.lit("iri")).alias("entity_kind")).agg(F.count("*").alias("n"))


@query("SELECT in_axiom, n FROM (SELECT false AS in_axiom, count(*) * 6 AS n FROM nation) x")
def parsed_places_without_axiom(g):
    """Places inside ontology annotations bear no axiom."""
    t = g.read("occurrence", "root")
    rows = views.with_axiom(t.occurrence, t.root).select(F.col("axiom_id").isNotNull().alias("in_axiom"))
    return rows.where("not in_axiom").groupBy("in_axiom").agg(F.count("*").alias("n"))


@query("SELECT depth, count(*) AS n FROM (SELECT 0 AS depth FROM nation UNION ALL SELECT 0 FROM nation UNION ALL SELECT 1 FROM nation) x GROUP BY depth")
def parsed_nested_annotations(g):
    """Annotations by how many annotations hold them: on ontologies, on axioms, and on those."""
    return g.read("occurrence").nested_annotation.select(F.col("depth").cast("int").alias("depth")).groupBy("depth").agg(F.count("*").alias("n"))


@query("SELECT 'resolved' AS status, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS documents UNION ALL SELECT 'unresolved', (SELECT count(*) FROM nation WHERE n_nationkey % 8 = 5), (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation)")
def parsed_load_closure(g):
    """Nations are read and what they import is found in the library, level by level."""
    t = reader.load_closure(g.spark, g.nations().select("path", "content"), g.regions(), imports.RECORD, parts=("document",))
    return imports.statuses(t.import_edge).join(F.broadcast(t.document.agg(F.count("*").alias("documents"))))


@query("SELECT 'functional' AS format, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS documents, 0::bigint AS failed")
def parsed_load_report(g):
    return imports.totals(g.read("document").document, "format").select("format", "documents", "failed")


@query(f"WITH {_ROOTS}, {_ENTITIES} SELECT 'axiom_types' AS name, count(*) AS n FROM r UNION ALL SELECT 'signature', count(*) FROM e UNION ALL SELECT 'declarations', 3 + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) + (SELECT count(*) FROM customer) UNION ALL SELECT 'undeclared', (SELECT count(*) FROM nation) * 2 + 1 UNION ALL SELECT 'annotations', count(*) FROM customer UNION ALL SELECT 'class_hierarchy', (SELECT count(*) FROM nation) + (SELECT count(*) FROM region) UNION ALL SELECT 'property_hierarchy', 1 UNION ALL SELECT 'domain_ranges', (SELECT count(*) FROM nation) * 3 UNION ALL SELECT 'axiom_type_counts', count(DISTINCT tag) FROM r")
def parsed_views(g):
    """Every built-in view over what was read."""
    t, r = g.read("root", "occurrence"), registry.default()
    names = ["axiom_types", "signature", "declarations", "undeclared", "annotations", "class_hierarchy", "property_hierarchy", "domain_ranges", "axiom_type_counts"]
    return reduce(lambda a, b: a.unionByName(b), [r.fresh(t, n).agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in names])


@query("SELECT 'urn:doc:nation:' || cast(n_nationkey AS varchar) AS ontology_iri, 0 AS ordinal FROM nation UNION ALL SELECT 'urn:doc:region:' || cast(r_regionkey AS varchar), 0 FROM region")
def parsed_identities(g):
    return g.read("document").identity().select("ontology_iri", "ordinal")


# Anonymous individuals: an order and its lines are blank nodes, parts are named.

_ORDERS = "o AS (SELECT l_orderkey AS k, string_agg(cast(l_partkey AS varchar), ',' ORDER BY l_partkey) AS parts, count(*) AS n FROM lineitem GROUP BY 1)"


def _blank_edges(g):
    line = g.table["lineitem"].select(F.concat(F.lit("_:o"), F.col("l_orderkey").cast("string")).alias("o"), F.concat_ws(".", F.concat(F.lit("_:l"), F.col("l_orderkey").cast("string")), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("l"), F.concat(F.lit("urn:d:part:"), F.col("l_partkey").cast("string")).alias("part"))
    line = line.distinct()
    return line.select(F.col("o").alias("s"), F.lit("hasLine").alias("p"), F.col("l").alias("o")).unionByName(line.select(F.col("l").alias("s"), F.lit("part").alias("p"), F.col("part").alias("o")))


_LINES = "d AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), o AS (SELECT l_orderkey AS k, string_agg(cast(l_partkey AS varchar), ',' ORDER BY l_partkey) AS parts, count(*) AS n FROM d GROUP BY 1)"


@query(f"WITH {_LINES} SELECT '_:o' || cast(k AS varchar) AS head, n + 1 AS blanks FROM o")
def blank_components(g):
    """Blank nodes that statements hold together."""
    c = anonymous.partition(_blank_edges(g))
    return c.groupBy("component").agg(F.max(F.when(F.col("node").startswith("_:o"), F.col("node"))).alias("head"), F.count("*").alias("blanks")).select("head", "blanks")


@query(f"WITH {_LINES} SELECT count(DISTINCT parts) AS graphs, count(*) AS components, max(m) AS most FROM (SELECT parts, count(*) OVER (PARTITION BY parts) AS m FROM o) x")
def blank_graphs(g):
    """Components that differ in the names of their blanks alone have one canonical graph."""
    found = anonymous.canonical(_blank_edges(g))
    per = found.groupBy("graph").agg(F.count("*").alias("m"))
    return per.agg(F.count("*").alias("graphs"), F.sum("m").alias("components"), F.max("m").alias("most"))


@query(f"WITH {_LINES} SELECT ordinal, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY parts ORDER BY k) - 1 AS ordinal FROM o) x GROUP BY 1")
def blank_ordinals(g):
    """Equal components are numbered, so that each keeps a label of its own."""
    found = anonymous.occurrence_ordinals(anonymous.canonical(_blank_edges(g)))
    return found.groupBy(F.col("ordinal").cast("long").alias("ordinal")).agg(F.count("*").alias("n"))


@query(f"WITH {_LINES} SELECT count(*) AS blanks, count(*) AS labels FROM (SELECT l_orderkey FROM d UNION ALL SELECT k FROM o) x")
def frozen_blanks(g):
    """Every blank gets a label that does not hang on its name, and no two share one."""
    labels = anonymous.freeze(_blank_edges(g), "urn:doc:orders")
    return labels.agg(F.count("*").alias("blanks"), F.countDistinct("label").alias("labels"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
