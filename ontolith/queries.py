"""Registered queries: each applies an operator to the whole lifted tables; most have the same result in plain SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .functions import canonical as C
from .functions import lexical as L
from .operators import algebra, hierarchy, imports, rdf, registry, validation, views
from .plans import graph
from .plans.lifting import lift, portable
from .schema import spelled_out, term

_QUERIES, _SQL = {}, {}


def query(sql: str | None = None):
    def register(fn):
        name = fn.__name__
        _QUERIES[name] = lambda spark, sf_dir: fn(lift(spark, sf_dir))
        if sql is not None:
            _SQL[name] = portable(sql)
        return fn

    return register


# Axiom types and roots


@query("SELECT tag, CASE tag WHEN 60 THEN 'Declaration' WHEN 61 THEN 'SubClassOf' WHEN 62 THEN 'EquivalentClasses' WHEN 70 THEN 'SubObjectPropertyOf' WHEN 71 THEN 'EquivalentObjectProperties' WHEN 73 THEN 'InverseObjectProperties' WHEN 74 THEN 'ObjectPropertyDomain' WHEN 75 THEN 'ObjectPropertyRange' WHEN 76 THEN 'FunctionalObjectProperty' WHEN 79 THEN 'IrreflexiveObjectProperty' WHEN 80 THEN 'SymmetricObjectProperty' WHEN 82 THEN 'TransitiveObjectProperty' WHEN 90 THEN 'SubDataPropertyOf' WHEN 91 THEN 'EquivalentDataProperties' WHEN 72 THEN 'DisjointObjectProperties' WHEN 77 THEN 'InverseFunctionalObjectProperty' WHEN 81 THEN 'AsymmetricObjectProperty' WHEN 121 THEN 'SubAnnotationPropertyOf' WHEN 93 THEN 'DataPropertyDomain' WHEN 94 THEN 'DataPropertyRange' WHEN 112 THEN 'ClassAssertion' WHEN 113 THEN 'ObjectPropertyAssertion' WHEN 115 THEN 'DataPropertyAssertion' WHEN 120 THEN 'AnnotationAssertion' WHEN 122 THEN 'AnnotationPropertyDomain' WHEN 123 THEN 'AnnotationPropertyRange' END AS name, count(*) AS n FROM root GROUP BY tag")
def axiom_type_counts(t):
    return views.axiom_type_counts(t.root)


@query("SELECT CASE WHEN tag = 60 THEN 'declaration_axiom' WHEN tag >= 120 THEN 'annotation_axiom' ELSE 'logical_axiom' END AS category, count(*) AS n FROM root GROUP BY 1")
def category_counts(t):
    return views.category_counts(t.root)


@query("SELECT root_id, document_key FROM root WHERE tag = 61")
def axioms_by_type(t):
    return views.axioms(t.root, tag=61).select("root_id", "document_key")


@query("SELECT root_id, tag FROM root WHERE document_key = 'region:1'")
def axioms_in_document(t):
    return views.axioms(t.root, document_key="region:1").select("root_id", "tag")


@query("SELECT document_key, tag, count(*) AS n FROM root GROUP BY 1, 2")
def axioms_root_scope(t):
    return t.root.groupBy("document_key", "tag").agg(F.count("*").alias("n"))


@query("SELECT p.root_id, EXISTS (SELECT 1 FROM root r WHERE r.root_id = p.root_id) AS found FROM (SELECT DISTINCT 'SubClassOf(urn:d:nation:' || cast(n_nationkey AS string) || ' urn:d:region:' || cast((n_regionkey + n_nationkey % 2) % 5 AS string) || ')' AS root_id FROM nation) p")
def contains_probe(t):
    probes = t.nation.select(F.concat(F.lit("SubClassOf(urn:d:nation:"), F.col("n_nationkey").cast("string"), F.lit(" urn:d:region:"), ((F.col("n_regionkey") + F.col("n_nationkey") % 2) % 5).cast("string"), F.lit(")")).alias("root_id")).distinct()
    return views.contains(t.root, probes)


# Signature


@query("SELECT DISTINCT entity_kind, iri FROM occurrence")
def signature_entities(t):
    return views.entities(t.occurrence)


@query("SELECT entity_kind, count(DISTINCT iri) AS n FROM occurrence GROUP BY 1")
def signature_by_kind(t):
    return views.entities(t.occurrence).groupBy("entity_kind").agg(F.count("*").alias("n"))


_NOT_BUILTIN = "NOT (entity_kind = 'datatype' AND iri LIKE 'xsd:%') AND NOT (entity_kind = 'annotation_property' AND iri LIKE 'rdfs:%')"


@query(f"SELECT DISTINCT entity_kind, iri FROM occurrence WHERE {_NOT_BUILTIN}")
def signature_no_builtins(t):
    return views.entities(t.occurrence, include_builtins=False)


@query("SELECT DISTINCT o.entity_kind, o.iri FROM occurrence o WHERE EXISTS (SELECT 1 FROM declaration d WHERE d.kind = o.entity_kind AND d.iri = o.iri)")
def signature_declared_only(t):
    return views.entities(t.occurrence).join(views.declared(t.declaration), ["entity_kind", "iri"], "left_semi")


@query("SELECT DISTINCT entity_kind, iri FROM occurrence WHERE NOT in_annotation")
def signature_no_annotation_only(t):
    return views.entities(t.occurrence, include_annotations=False)


@query("SELECT iri, string_agg(entity_kind, ',' ORDER BY entity_kind) AS kinds, count(*) AS n_kinds FROM (SELECT DISTINCT entity_kind, iri FROM occurrence) x GROUP BY iri HAVING count(*) > 1")
def entities_by_iri(t):
    return views.punned(t.occurrence)


@query("SELECT DISTINCT iri FROM occurrence")
def flat_iris(t):
    return views.flat_iris(t.occurrence)


@query("SELECT entity_kind, iri, count(DISTINCT root_id) AS n_roots FROM occurrence GROUP BY 1, 2")
def reference_counts(t):
    return views.signature(t.occurrence).select("entity_kind", "iri", "n_roots")


@query("SELECT entity_kind, iri, count(DISTINCT CASE WHEN NOT in_annotation THEN root_id END) AS n FROM occurrence GROUP BY 1, 2")
def nonannotation_counts(t):
    return views.signature(t.occurrence).select("entity_kind", "iri", F.col("n_roots_plain").alias("n"))


@query("SELECT kind AS entity_kind, iri, count(*) AS n FROM declaration GROUP BY 1, 2")
def declaration_counts(t):
    return views.declaration_counts(t.occurrence)


# Declarations


@query("SELECT DISTINCT kind AS entity_kind, iri FROM declaration")
def declared_entities(t):
    return views.declared(t.declaration)


@query(f"SELECT DISTINCT entity_kind, iri FROM occurrence o WHERE {_NOT_BUILTIN} AND NOT EXISTS (SELECT 1 FROM declaration d WHERE d.kind = o.entity_kind AND d.iri = o.iri)")
def undeclared_entities(t):
    return views.undeclared(t.occurrence, t.declaration)


# Annotations


@query("SELECT DISTINCT subject, value_kind, value, lang FROM annotation_assertion WHERE property = 'rdfs:label' AND subject = 'urn:d:source:src3'")
def annotation_by_subject(t):
    return views.annotation_values(t.annotation_assertion, views.LABEL, "urn:d:source:src3")


@query("SELECT DISTINCT subject, value_kind, value, lang FROM annotation_assertion WHERE property = 'rdfs:label'")
def annotation_values(t):
    return views.annotation_values(t.annotation_assertion, views.LABEL)


@query("SELECT DISTINCT subject FROM annotation_assertion")
def annotation_subjects(t):
    return t.annotation_assertion.select("subject").distinct()


@query("SELECT subject, property, value FROM annotation_assertion WHERE value_kind = 'iri' AND value IN (SELECT url FROM pages)")
def annotation_reverse_iri(t):
    return views.reverse_iri(t.annotation_assertion, t.pages.select(F.col("url").alias("iri"))).select("subject", "property", "value")


def _label_sql(prefs):
    cases = " ".join(f"WHEN lang = '{p}' OR starts_with(lang, '{p}-') THEN {i}" for i, p in enumerate(prefs))
    return f"SELECT subject, value, lang FROM (SELECT subject, value, coalesce(lang, '') AS lang, row_number() OVER (PARTITION BY subject ORDER BY r, value, coalesce(lang, '')) AS k FROM (SELECT *, CASE {cases} WHEN lang IS NULL THEN {len(prefs)} END AS r FROM annotation_assertion WHERE property = 'rdfs:label' AND value_kind = 'literal') x WHERE r IS NOT NULL) y WHERE k = 1"


@query(_label_sql(["de", "en"]))
def preferred_label(t):
    return views.preferred_label(t.annotation_assertion, ["de", "en"])


@query(_label_sql(["es"]))
def preferred_label_es(t):
    return views.preferred_label(t.annotation_assertion, ["es"])


# References and expressions


@query("SELECT root_id, role FROM occurrence WHERE iri = 'urn:d:nation:3' AND entity_kind = 'class'")
def entity_references(t):
    return t.occurrence.where("iri = 'urn:d:nation:3' and entity_kind = 'class'").select("root_id", "role")


@query("SELECT root_id, iri FROM occurrence WHERE role = 'superclass'")
def references_by_role(t):
    return views.references(t.occurrence, "superclass").select("root_id", "iri")


@query("SELECT entity_kind, iri, role, count(*) AS n FROM occurrence GROUP BY 1, 2, 3")
def reference_occurrence_counts(t):
    return views.reference_counts(t.occurrence)


_EXPRESSIONS = "entity_kind IN ('class', 'datatype', 'object_property', 'data_property') AND role <> 'declaration'"


@query(f"SELECT root_id, entity_kind, iri, role FROM occurrence WHERE {_EXPRESSIONS}")
def expression_occurrences(t):
    return views.expressions(t.occurrence).select("root_id", "entity_kind", "iri", "role")


@query(f"SELECT entity_kind, iri, count(*) AS n, count(DISTINCT root_id) AS n_roots, min(root_id) AS first_root FROM occurrence WHERE {_EXPRESSIONS} GROUP BY 1, 2")
def expression_counts(t):
    return views.postings(t.occurrence)


# Hierarchies

_SETS = "m AS (SELECT DISTINCT root_id, member FROM equivalent_class), s AS (SELECT * FROM m WHERE root_id IN (SELECT root_id FROM m GROUP BY 1 HAVING count(*) >= 2))"
#: Recursion over all reached pairs suits the oracle's engine; the engine itself propagates least labels.
_COMPONENTS = """links AS (SELECT DISTINCT s.member AS b, h.hub AS a FROM s JOIN (SELECT root_id, min(member) AS hub FROM s GROUP BY 1) h ON s.root_id = h.root_id),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, b AS seen FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.seen = w.a),
comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY 1)"""


def _with(names: str, body: str, recursive: bool = False) -> str:
    text = portable("").rstrip()
    if recursive:
        text = text.replace("WITH ", "WITH RECURSIVE ", 1)
    return f"{text},\n{names}\n{body}"


def raw(sql: str):
    def register(fn):
        name = fn.__name__
        _QUERIES[name] = lambda spark, sf_dir: fn(lift(spark, sf_dir))
        _SQL[name] = spelled_out(sql)
        return fn

    return register


@query("SELECT DISTINCT sub AS child, sup AS parent FROM sub_class WHERE sub <> sup")
def class_edges_preserve(t):
    return hierarchy.class_edges(t.sub_class, t.equivalent_class)


@raw(_with(_SETS, "SELECT DISTINCT child, parent FROM (SELECT sub AS child, sup AS parent FROM sub_class UNION ALL SELECT x.member, y.member FROM s x JOIN s y ON x.root_id = y.root_id) e WHERE child <> parent"))
def class_edges_bidirectional(t):
    return hierarchy.class_edges(t.sub_class, t.equivalent_class, hierarchy.BIDIRECTIONAL)


@raw(_with(f"{_SETS}, {_COMPONENTS}", "SELECT DISTINCT coalesce(c.component, child) AS child, coalesce(p.component, parent) AS parent FROM (SELECT sub AS child, sup AS parent FROM sub_class UNION ALL SELECT 'urn:d:doc:' || cast(doc_id AS string), 'urn:d:source:' || source FROM documents) e LEFT JOIN comp c ON c.node = child LEFT JOIN comp p ON p.node = parent WHERE coalesce(c.component, child) <> coalesce(p.component, parent)", True))
def class_edges_component(t):
    docs = t.documents.select(F.concat(F.lit("urn:d:doc:"), F.col("doc_id").cast("string")).alias("sub"), F.concat(F.lit("urn:d:source:"), "source").alias("sup"))
    return hierarchy.class_edges(t.sub_class.select("sub", "sup").unionByName(docs), t.equivalent_class, hierarchy.COMPONENT)


@query("SELECT DISTINCT child, parent FROM (SELECT sub AS child, sup AS parent FROM sub_class UNION ALL SELECT 'urn:d:nation:' || cast(n_nationkey AS string), 'urn:d:World' FROM nation) e WHERE child <> parent")
def disjoint_union_edges(t):
    union = t.nation.select(F.concat(F.lit("urn:d:nation:"), F.col("n_nationkey").cast("string")).alias("member"), F.lit("urn:d:World").alias("defined"))
    return hierarchy.class_edges(t.sub_class, t.equivalent_class, disjoint_union=union)


@query("SELECT DISTINCT sub AS child, sup AS parent FROM sub_class WHERE sub IN (SELECT 'urn:d:brand:' || p_brand FROM part)")
def asserted_parents(t):
    brands = t.part.select(F.concat(F.lit("urn:d:brand:"), "p_brand").alias("node")).distinct()
    return hierarchy.parents(hierarchy.class_edges(t.sub_class, t.equivalent_class), brands).select("child", "parent")


@query("SELECT DISTINCT sub AS child, sup AS parent FROM sub_class WHERE sup IN (SELECT 'urn:d:region:' || cast(r_regionkey AS string) FROM region)")
def asserted_children(t):
    regions = t.region.select(F.concat(F.lit("urn:d:region:"), F.col("r_regionkey").cast("string")).alias("node"))
    return hierarchy.children(hierarchy.class_edges(t.sub_class, t.equivalent_class), regions).select("child", "parent")


@raw(_with(_SETS, "SELECT DISTINCT x.member AS child, y.member AS parent FROM s x JOIN s y ON x.root_id = y.root_id WHERE x.member <> y.member"))
def equivalents_one_hop(t):
    return hierarchy.equivalents_one_hop(t.equivalent_class)


@raw(_with(_SETS, "SELECT root_id, string_agg(member, ',' ORDER BY member) AS members, count(*) AS n_members FROM s GROUP BY 1"))
def equivalence_sets(t):
    return hierarchy.equivalence_sets(t.equivalent_class)


@raw(_with(f"{_SETS}, {_COMPONENTS}", "SELECT node, component FROM comp", True))
def equivalence_components(t):
    return hierarchy.components(t.equivalent_class)


@query("SELECT DISTINCT tag, first AS child, second AS parent FROM property_axiom WHERE tag IN (70, 90, 121) AND chain = ''")
def property_edges(t):
    return hierarchy.property_edges(t.property_axiom)


@query("SELECT DISTINCT CASE WHEN swap THEN second ELSE first END AS first, CASE WHEN swap THEN first ELSE second END AS second FROM (SELECT first, second, length(first) > length(second) OR (length(first) = length(second) AND first > second) AS swap FROM property_axiom WHERE tag = 73) x")
def inverse_pairs(t):
    return hierarchy.inverse_pairs(t.property_axiom)


@query("SELECT chain, second AS super_property, cast(len(string_split(chain, '>')) AS integer) AS length FROM property_axiom WHERE tag = 70 AND chain <> ''")
def property_chains(t):
    return hierarchy.property_chains(t.property_axiom)


@query("SELECT property_kind, property, record_kind, value, named FROM domain_range")
def domain_range_records(t):
    return hierarchy.domain_ranges(t.domain_range).select("property_kind", "property", "record_kind", "value", "named")


@query("SELECT property, value FROM domain_range WHERE record_kind = 'range' AND named")
def domain_range_named(t):
    return hierarchy.domain_ranges(t.domain_range, "range", True).select("property", "value")


@query("SELECT property_kind, record_kind, count(*) AS n, count(*) FILTER (WHERE NOT named) AS lost FROM domain_range GROUP BY 1, 2")
def domain_range_loss(t):
    return hierarchy.domain_range_loss(t.domain_range)


# Imports


@raw(_with("reach AS (SELECT importing AS start, importing AS node FROM import_edge UNION SELECT r.start, e.imported FROM reach r JOIN import_edge e ON e.importing = r.node WHERE e.status = 'resolved')", "SELECT start, node FROM reach", True))
def import_closure(t):
    return imports.closure(t.import_edge).select("start", "node")


@query("SELECT status, count(*) AS n FROM import_edge GROUP BY 1")
def import_edge_status(t):
    return imports.statuses(imports.with_policy(t.import_edge, imports.RECORD))


@query("SELECT importing, bool_and(status = 'resolved') AS complete, count(*) AS n FROM import_edge GROUP BY 1")
def import_completeness(t):
    return imports.completeness(t.import_edge)


@query("SELECT md5(text) AS claim, count(DISTINCT md5(source || lang)) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT md5(source || lang)) > 1")
def identity_clashes(t):
    return imports.identity_clashes(t.documents.select(F.md5("text").alias("claim"), F.md5(F.concat("source", "lang")).alias("source_sha256")))


@query("SELECT url AS iri, CASE WHEN starts_with(url, 'https://') THEN 'file:secure/' || substr(url, 9) WHEN starts_with(url, 'http://www.') THEN 'file:www/' || substr(url, 12) WHEN starts_with(url, 'http://') THEN 'file:plain/' || substr(url, 8) END AS target FROM (SELECT DISTINCT url FROM pages) p")
def catalog_resolver(t):
    urls = t.pages.select(F.col("url").alias("iri")).distinct()
    rules = t.spark.createDataFrame([("http://", "file:plain/"), ("http://www.", "file:www/"), ("https://", "file:secure/")], "prefix string, replacement string")
    return imports.resolve_catalog(urls, t.spark.createDataFrame([], "iri string, target string"), rules)


# View algebra

_DELTA = "delta AS (SELECT root_id, op FROM (SELECT root_id, op, row_number() OVER (PARTITION BY root_id ORDER BY ts DESC, event_id DESC) AS k FROM delta_log) x WHERE k = 1)"
_USERS = "base AS (SELECT DISTINCT 'Declaration(named_individual urn:d:user:' || cast(user_id AS string) || ')' AS root_id FROM events WHERE event_type = 'purchase')"


def _users(t):
    return t.events.where("event_type = 'purchase'").select(F.concat(F.lit("Declaration(named_individual urn:d:user:"), F.col("user_id").cast("string"), F.lit(")")).alias("root_id")).distinct()


@raw(_with(f"{_DELTA}, {_USERS}", "SELECT root_id FROM base WHERE root_id NOT IN (SELECT root_id FROM delta WHERE op = 'remove') UNION SELECT root_id FROM delta WHERE op = 'add'"))
def overlay_effective(t):
    return algebra.Overlay(_users(t), algebra.last_ops(t.delta_log)).roots()


@raw(_with(f"{_DELTA}, {_USERS}", "SELECT root_id FROM (SELECT root_id FROM base WHERE root_id NOT IN (SELECT root_id FROM delta WHERE op = 'remove') UNION SELECT root_id FROM delta WHERE op = 'add') e WHERE root_id IN (SELECT 'Declaration(named_individual urn:d:user:' || cast(user_id AS string) || ')' FROM events)"))
def overlay_contains(t):
    probes = t.events.select(F.concat(F.lit("Declaration(named_individual urn:d:user:"), F.col("user_id").cast("string"), F.lit(")")).alias("root_id")).distinct()
    return algebra.Overlay(_users(t), algebra.last_ops(t.delta_log)).contains(probes)


@raw(_with(f"{_DELTA}, {_USERS}", "SELECT base, adds, removes, base + adds - removes AS effective FROM (SELECT (SELECT count(*) FROM base) AS base, (SELECT count(*) FROM delta WHERE op = 'add' AND root_id NOT IN (SELECT root_id FROM base)) AS adds, (SELECT count(*) FROM delta WHERE op = 'remove' AND root_id IN (SELECT root_id FROM base)) AS removes) x"))
def overlay_count_arithmetic(t):
    return algebra.count_change(_users(t), algebra.last_ops(t.delta_log))


_HALVES = "d1 AS (SELECT root_id, op FROM (SELECT root_id, op, row_number() OVER (PARTITION BY root_id ORDER BY ts DESC, event_id DESC) AS k FROM delta_log WHERE event_id % 2 = 0) x WHERE k = 1), d2 AS (SELECT root_id, op FROM (SELECT root_id, op, row_number() OVER (PARTITION BY root_id ORDER BY ts DESC, event_id DESC) AS k FROM delta_log WHERE event_id % 2 = 1) x WHERE k = 1)"


@raw(_with(_HALVES, "SELECT root_id, op FROM d2 WHERE NOT EXISTS (SELECT 1 FROM d1 WHERE d1.root_id = d2.root_id AND d1.op <> d2.op) UNION SELECT root_id, op FROM d1 WHERE NOT EXISTS (SELECT 1 FROM d2 WHERE d1.root_id = d2.root_id AND d1.op <> d2.op)"))
def delta_combine(t):
    half = lambda k: algebra.last_ops(t.delta_log.where(F.col("event_id") % 2 == k))
    return algebra.combine(half(0), half(1)).select("root_id", "op")


@raw(_with(f"{_DELTA}, {_USERS}", "SELECT root_id, op FROM delta WHERE (op = 'add' AND root_id IN (SELECT root_id FROM base)) OR (op = 'remove' AND root_id NOT IN (SELECT root_id FROM base))"))
def delta_noops(t):
    return algebra.noops(_users(t), algebra.last_ops(t.delta_log))


@query("SELECT root_id FROM delta_log GROUP BY 1 HAVING count(DISTINCT op) > 1")
def delta_conflicts(t):
    return algebra.conflicts(t.delta_log)


_BRIDGE = "SELECT 'SubClassOf(urn:d:region:' || cast(r_regionkey AS string) || ' urn:d:World)' AS root_id FROM region"
_MEMBERS = f"c AS (SELECT 'bridge' AS member, root_id FROM ({_BRIDGE}) b UNION SELECT 'customers', root_id FROM root WHERE document_key IN ('customers', 'orders') UNION SELECT 'suppliers', root_id FROM root WHERE document_key IN ('suppliers', 'orders'))"


def _composite(t):
    part = lambda *keys: t.root.where(F.col("document_key").isin(*keys)).select("root_id")
    bridge = t.region.select(F.concat(F.lit("SubClassOf(urn:d:region:"), F.col("r_regionkey").cast("string"), F.lit(" urn:d:World)")).alias("root_id"))
    return algebra.compose({"customers": part("customers", "orders"), "suppliers": part("suppliers", "orders")}, bridge)


@raw(_with(_MEMBERS, "SELECT DISTINCT root_id FROM c"))
def composite_effective(t):
    return algebra.effective(_composite(t))


@raw(_with(_MEMBERS, "SELECT member, count(*) AS n FROM c GROUP BY 1"))
def composite_member_counts(t):
    return algebra.member_counts(_composite(t))


@raw(_with(_MEMBERS, "SELECT root_id FROM c WHERE member = 'bridge'"))
def composite_bridge(t):
    return _composite(t).where("member = 'bridge'").select("root_id")


@raw(_with(_MEMBERS, "SELECT root_id, string_agg(member, ',' ORDER BY member) AS members, count(*) AS n FROM c GROUP BY 1"))
def composite_origins(t):
    return algebra.origins(_composite(t))


def _people(t, which: str):
    return t.customer.select(F.concat(F.lit("urn:d:customer:"), F.col("c_custkey").cast("string")).alias("iri")).where(which)


#: An overlay over the lifted tables: richer customers' declarations and the smaller orders' axioms go, one class comes.
_PATCH = """gone AS (SELECT 'Declaration(named_individual urn:d:customer:' || cast(c_custkey AS string) || ')' AS root_id FROM customer WHERE c_acctbal > 5000
 UNION SELECT 'SubClassOf(urn:d:nation:' || cast(n_nationkey AS string) || ' urn:d:region:' || cast(n_regionkey AS string) || ')' FROM nation WHERE n_regionkey < 2
 UNION SELECT 'ObjectPropertyAssertion(urn:d:placedBy urn:d:order:' || cast(o_orderkey AS string) || ' urn:d:customer:' || cast(o_custkey AS string) || ')' FROM orders WHERE o_totalprice < 50000),
 d2 AS (SELECT root_id, kind, iri FROM declaration WHERE root_id NOT IN (SELECT root_id FROM gone) UNION SELECT 'Declaration(class urn:d:World)', 'class', 'urn:d:World'),
 s2 AS (SELECT root_id, sub, sup FROM sub_class WHERE root_id NOT IN (SELECT root_id FROM gone) UNION SELECT 'SubClassOf(urn:d:region:' || cast(r_regionkey AS string) || ' urn:d:World)', 'urn:d:region:' || cast(r_regionkey AS string), 'urn:d:World' FROM region),
 o2 AS (SELECT root_id, tag, entity_kind, iri, role, in_annotation FROM occurrence WHERE root_id NOT IN (SELECT root_id FROM gone)
  UNION ALL SELECT 'Declaration(class urn:d:World)', 60, 'class', 'urn:d:World', 'declaration', false
  UNION ALL SELECT root_id, 61, 'class', sub, 'subclass', false FROM s2 WHERE sup = 'urn:d:World' UNION ALL SELECT root_id, 61, 'class', sup, 'superclass', false FROM s2 WHERE sup = 'urn:d:World'),
 r2 AS (SELECT root_id, tag FROM root WHERE root_id NOT IN (SELECT root_id FROM gone) UNION ALL SELECT 'Declaration(class urn:d:World)', 60 UNION ALL SELECT root_id, 61 FROM s2 WHERE sup = 'urn:d:World')"""

_VIEWS_OF_PATCH = """SELECT 'axiom_types' AS name, cast(tag AS string) AS item, count(*) AS n FROM r2 GROUP BY tag
 UNION ALL SELECT 'signature', entity_kind, count(DISTINCT iri) FROM o2 GROUP BY entity_kind
 UNION ALL SELECT 'declarations', kind, count(DISTINCT iri) FROM d2 GROUP BY kind
 UNION ALL SELECT 'undeclared', entity_kind, count(DISTINCT iri) FROM o2 WHERE NOT EXISTS (SELECT 1 FROM d2 WHERE d2.kind = o2.entity_kind AND d2.iri = o2.iri) AND NOT (entity_kind = 'datatype' AND iri LIKE 'xsd:%') AND NOT (entity_kind = 'annotation_property' AND iri LIKE 'rdfs:%') GROUP BY entity_kind
 UNION ALL SELECT 'annotations', property, count(DISTINCT subject || ' ' || value || coalesce('@' || lang, '')) FROM annotation_assertion GROUP BY property
 UNION ALL SELECT 'references', role, count(*) FROM o2 GROUP BY role
 UNION ALL SELECT 'expressions', entity_kind, count(*) FROM o2 WHERE entity_kind IN ('class', 'datatype', 'object_property', 'data_property') AND role <> 'declaration' GROUP BY entity_kind
 UNION ALL SELECT 'class_hierarchy', parent, count(*) FROM (SELECT DISTINCT sub AS child, sup AS parent FROM s2 WHERE sub <> sup) e GROUP BY parent
 UNION ALL SELECT 'property_hierarchy', cast(tag AS string), count(*) FROM (SELECT DISTINCT tag, first, second FROM property_axiom WHERE tag IN (70, 90, 121) AND chain = '') p GROUP BY tag
 UNION ALL SELECT 'domain_ranges', record_kind, count(*) FROM domain_range GROUP BY record_kind"""


def _patch(t):
    """The delta of _PATCH: removed root_ids, and added rows by table."""
    iri = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    wrap = lambda head, *parts: F.concat(F.lit(head + "("), F.concat_ws(" ", *parts), F.lit(")")).alias("root_id")
    gone = t.customer.where("c_acctbal > 5000").select(wrap("Declaration", F.lit("named_individual"), iri("urn:d:customer:", "c_custkey")))
    gone = gone.unionByName(t.nation.where("n_regionkey < 2").select(wrap("SubClassOf", iri("urn:d:nation:", "n_nationkey"), iri("urn:d:region:", "n_regionkey"))))
    gone = gone.unionByName(t.orders.where("o_totalprice < 50000").select(wrap("ObjectPropertyAssertion", F.lit("urn:d:placedBy"), iri("urn:d:order:", "o_orderkey"), iri("urn:d:customer:", "o_custkey"))))
    world = t.spark.createDataFrame([("Declaration(class urn:d:World)", "class", "urn:d:World", "patch")], "root_id string, kind string, iri string, document_key string")
    region = iri("urn:d:region:", "r_regionkey")
    subs = t.region.select(wrap("SubClassOf", region, F.lit("urn:d:World")), region.alias("sub"), F.lit("urn:d:World").alias("sup"), F.lit("patch").alias("document_key"))
    ends = subs.select("root_id", F.explode(F.array(F.struct(F.col("sub").alias("iri"), F.lit("subclass").alias("role")), F.struct(F.col("sup").alias("iri"), F.lit("superclass").alias("role")))).alias("x")).select("root_id", F.lit(61).alias("tag"), F.lit("class").alias("entity_kind"), "x.iri", "x.role", F.lit(False).alias("in_annotation"))
    places = world.select("root_id", F.lit(60).alias("tag"), F.lit("class").alias("entity_kind"), "iri", F.lit("declaration").alias("role"), F.lit(False).alias("in_annotation")).unionByName(ends)
    roots = world.select("root_id", F.lit(60).alias("tag")).unionByName(subs.select("root_id", F.lit(61).alias("tag"))).select("root_id", "tag", F.lit("axiom").alias("root_kind"), F.lit("patch").alias("document_key"))
    return gone, {"declaration": world, "sub_class": subs, "occurrence": places, "root": roots}


def _nine_views(t):
    """One row a view and item: what all built-in views say of the tables."""
    r = registry.default()
    count = lambda df, name, item: df.groupBy(F.col(item).cast("string").alias("item")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "item", "n")
    made = lambda name, **options: r.fresh(t, name, **options)
    parts = [
        count(made("axiom_types"), "axiom_types", "tag"), count(made("signature"), "signature", "entity_kind"), count(made("declarations"), "declarations", "entity_kind"), count(made("undeclared"), "undeclared", "entity_kind"),
        count(t.annotation_assertion.select("property", "subject", "value", "lang").distinct(), "annotations", "property"), count(made("references"), "references", "role"), count(views.expressions(t.occurrence), "expressions", "entity_kind"),
        count(made("class_hierarchy"), "class_hierarchy", "parent"), count(made("property_hierarchy"), "property_hierarchy", "tag"), count(made("domain_ranges"), "domain_ranges", "record_kind"),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


@raw(_with(_PATCH, _VIEWS_OF_PATCH))
def overlay_views(t):
    """All built-in views over an overlay of tables, beside SQL over an independent materialisation."""
    gone, added = _patch(t)
    return _nine_views(algebra.OverlayTables(t, gone, added))


_PARTS = "c AS (SELECT 'customers' AS member, root_id, document_key FROM root WHERE document_key IN ('customers', 'orders') UNION ALL SELECT 'suppliers', root_id, document_key FROM root WHERE document_key IN ('suppliers', 'orders')), p AS (SELECT c.member, o.* FROM occurrence o JOIN (SELECT DISTINCT member, root_id FROM c) c ON o.root_id = c.root_id)"


def _member_rows(t):
    part = lambda token, *keys: t.root.where(F.col("document_key").isin(*keys)).select(F.lit(token).alias("member"), "root_id", "document_key")
    return part("customers", "customers", "orders").unionByName(part("suppliers", "suppliers", "orders"))


def _member_places(t):
    return t.occurrence.join(_member_rows(t).select("member", "root_id").distinct(), "root_id")


@raw(_with(_PARTS, "SELECT entity_kind, iri, count(DISTINCT member || ' ' || root_id) AS n FROM p GROUP BY 1, 2"))
def composite_entity_counts(t):
    return algebra.entity_counts(_member_places(t))


@raw(_with(_PARTS, "SELECT entity_kind, iri, count(*) AS n FROM (SELECT DISTINCT entity_kind, iri, role, root_id FROM p) x GROUP BY 1, 2"))
def composite_place_counts(t):
    return algebra.place_counts(_member_places(t))


@raw(_with(_PARTS, "SELECT DISTINCT root_id, 'member:' || member || ':' || document_key AS origin FROM c"))
def composite_provenance(t):
    return algebra.provenance(_member_rows(t))


@query("SELECT name, f || '#' || cast(row_number() OVER (PARTITION BY f ORDER BY name) - 1 AS varchar) AS token FROM (SELECT 'doc' || cast(doc_id AS varchar) AS name, md5(text) AS f FROM documents WHERE text IS NOT NULL) x")
def composite_member_tokens(t):
    return algebra.member_tokens(t.documents.where("text is not null").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), F.md5("text").alias("fingerprint")))


@raw(_with(_PATCH, "SELECT entity_kind, iri, n FROM (SELECT entity_kind, iri, greatest(0, sum(s))::bigint AS n FROM (SELECT DISTINCT entity_kind, iri, root_id, 1 AS s FROM occurrence UNION ALL SELECT DISTINCT entity_kind, iri, root_id, -1 FROM occurrence WHERE root_id IN (SELECT root_id FROM gone) UNION ALL SELECT DISTINCT entity_kind, iri, root_id, 1 FROM o2 WHERE root_id = 'Declaration(class urn:d:World)' OR root_id LIKE '% urn:d:World)') x GROUP BY 1, 2) y WHERE n > 0"))
def incremental_counts(t):
    gone, added = _patch(t)
    base = views.signature(t.occurrence).select("entity_kind", "iri", F.col("n_roots").alias("n"))
    signed = lambda df, sign: df.select("entity_kind", "iri", "root_id").distinct().select("entity_kind", "iri", F.lit(sign).alias("sign"))
    return views.changed_counts(base, signed(t.occurrence.join(gone, "root_id", "left_semi"), -1).unionByName(signed(added["occurrence"], 1)))


@query("SELECT category, name, n FROM (SELECT CASE WHEN tag = 60 THEN 'declaration_axiom' WHEN tag >= 120 THEN 'annotation_axiom' ELSE 'logical_axiom' END AS category, tag, CASE tag WHEN 60 THEN 'Declaration' WHEN 61 THEN 'SubClassOf' WHEN 62 THEN 'EquivalentClasses' WHEN 112 THEN 'ClassAssertion' WHEN 113 THEN 'ObjectPropertyAssertion' WHEN 115 THEN 'DataPropertyAssertion' WHEN 120 THEN 'AnnotationAssertion' END AS name, count(*) AS n FROM root WHERE tag IN (60, 61, 62, 112, 113, 115, 120) GROUP BY GROUPING SETS ((1, 2, 3), (1), ())) x")
def category_rollup(t):
    return views.category_rollup(t.root.where("tag in (60, 61, 62, 112, 113, 115, 120)"))


@query(f"SELECT entity_kind, iri, string_agg(md5(root_id) || '/' || role, ',' ORDER BY md5(root_id) || '/' || role) AS places FROM occurrence WHERE {_EXPRESSIONS} AND iri LIKE 'urn:d:nation:%' GROUP BY 1, 2")
def posting_lists(t):
    return views.posting_lists(t.occurrence.where("iri like 'urn:d:nation:%'"))


# Orders with limits


@query("SELECT root_id, role, entity_kind, iri FROM occurrence ORDER BY root_id, role, entity_kind, iri LIMIT 50")
def topk_occurrences(t):
    return t.occurrence.withColumn("path", F.lit("")).orderBy(*views.occurrence_order()).limit(50).select("root_id", "role", "entity_kind", "iri")


@query("SELECT child, parent FROM (SELECT DISTINCT sub AS child, sup AS parent FROM sub_class WHERE sub <> sup) e ORDER BY length(child), child, length(parent), parent LIMIT 40")
def topk_edges(t):
    return hierarchy.class_edges(t.sub_class, t.equivalent_class).orderBy(*hierarchy.edge_order()).limit(40).select("child", "parent")


@query("SELECT s, p, o FROM triple ORDER BY s, p, o LIMIT 50")
def topk_triples(t):
    return rdf.in_order(t.triple).limit(50).select("s", "p", "o")


@query("SELECT importing, imported, status FROM import_edge ORDER BY importing, imported, status LIMIT 30")
def manifest_edges(t):
    return t.import_edge.orderBy(*imports.edge_order()).limit(30)


# Property hierarchies


@raw(_with("l AS (SELECT first AS a, second AS b FROM property_axiom WHERE tag IN (71, 91)), w AS (SELECT a, b FROM l UNION SELECT b, a FROM l), reach AS (SELECT a AS node, b AS seen FROM w UNION SELECT r.node, w.b FROM reach r JOIN w ON r.seen = w.a)", "SELECT node, least(node, min(seen)) AS component FROM reach GROUP BY 1", True))
def property_components(t):
    return hierarchy.property_components(t.property_axiom)


@query("SELECT DISTINCT first AS child, second AS parent FROM property_axiom WHERE tag IN (70, 90, 121) AND chain = '' AND first IN (SELECT 'urn:d:prop:' || p_brand FROM part)")
def property_parents(t):
    return hierarchy.property_parents(t.property_axiom, t.part.select(F.concat(F.lit("urn:d:prop:"), "p_brand").alias("node")).distinct()).select("child", "parent")


@query("SELECT DISTINCT first AS child, second AS parent FROM property_axiom WHERE tag IN (70, 90, 121) AND chain = '' AND second IN (SELECT 'urn:d:prop:s' || cast(p_size AS string) FROM part)")
def property_children(t):
    return hierarchy.property_children(t.property_axiom, t.part.select(F.concat(F.lit("urn:d:prop:s"), F.col("p_size").cast("string")).alias("node")).distinct()).select("child", "parent")


@query("SELECT first AS property, second AS other FROM property_axiom WHERE tag IN (71, 91) UNION SELECT second, first FROM property_axiom WHERE tag IN (71, 91)")
def property_equivalents(t):
    return hierarchy.property_equivalents(t.property_axiom)


# Sources and caches


@query("SELECT name FROM (SELECT 'page' || cast(page_id AS varchar) AS name, sum(strlen(html)) OVER (ORDER BY strlen(url) DESC, 'page' || cast(page_id AS varchar) ROWS UNBOUNDED PRECEDING) AS held FROM pages) x WHERE held > 100000")
def cache_evictions(t):
    return algebra.evict(t.pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("name"), F.octet_length("html").cast("long").alias("size"), F.octet_length("url").alias("mtime")), 100000).select("name")


@query("SELECT max(held)::bigint AS most FROM (SELECT sum(d) OVER (ORDER BY pos) AS held FROM (SELECT pos, sum(d) AS d FROM (SELECT o_orderkey AS pos, 1 AS d FROM orders UNION ALL SELECT o_orderkey + o_custkey, -1 FROM orders) p GROUP BY pos) s) x")
def open_spans(t):
    return imports.depth_spans(t.orders.select(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey")).alias("end")))


@raw(_with("m AS (SELECT 'order:' || cast(o_orderkey AS string) AS iri, 'customer:' || cast(o_custkey AS string) AS target FROM orders UNION ALL SELECT 'customer:' || cast(c_custkey AS string), 'nation:' || cast(c_nationkey AS string) FROM customer UNION ALL SELECT 'a', 'b' UNION ALL SELECT 'b', 'a'), chase AS (SELECT iri AS origin, iri AS here, 0 AS hops FROM (SELECT iri FROM m UNION SELECT 'nobody') q UNION ALL SELECT c.origin, m.target, c.hops + 1 FROM chase c JOIN m ON m.iri = c.here WHERE c.hops < 8)", "SELECT origin AS iri, CASE WHEN max(hops) BETWEEN 1 AND 7 THEN arg_max(here, hops) END AS target, CASE WHEN max(hops) = 0 THEN 'not_found' WHEN max(hops) >= 8 THEN 'cycle' ELSE 'resolved' END AS status FROM chase GROUP BY origin", True))
def mapping_resolver(t):
    pair = lambda a, b: t.spark.createDataFrame([(a, b)], "iri string, target string")
    m = t.orders.select(F.concat(F.lit("order:"), F.col("o_orderkey").cast("string")).alias("iri"), F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("target"))
    m = m.unionByName(t.customer.select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("iri"), F.concat(F.lit("nation:"), F.col("c_nationkey").cast("string")).alias("target"))).unionByName(pair("a", "b")).unionByName(pair("b", "a"))
    asked = m.select("iri").union(t.spark.createDataFrame([("nobody",)], "iri string")).distinct()
    return imports.resolve_mapping(asked, m, limit=8)


@query("SELECT DISTINCT url AS iri, CASE WHEN x <> '' AND x IN (SELECT regexp_extract(url, '([^/#]+)[/#]?$', 1) FROM pages WHERE page_id > 20) THEN x || '.ofn' END AS target FROM (SELECT url, regexp_extract(url, '([^/#]+)[/#]?$', 1) AS x FROM pages) p")
def directory_resolver(t):
    last = F.concat(F.regexp_extract("url", r"([^/#]+)[/#]?$", 1), F.lit(".ofn"))
    return imports.resolve_directory(t.pages.select(F.col("url").alias("iri")).distinct(), t.pages.where("page_id > 20").select(last.alias("path")))


@query("SELECT iri, coalesce(a, b) AS target, CASE WHEN a IS NOT NULL THEN 0 WHEN b IS NOT NULL THEN 1 END AS by FROM (SELECT DISTINCT url AS iri, CASE WHEN starts_with(url, 'https://') THEN 'first' END AS a, CASE WHEN length(url) > 30 THEN 'second' END AS b FROM pages) x")
def composite_resolver(t):
    asked = t.pages.select(F.col("url").alias("iri")).distinct()
    return imports.resolve_first(asked.select("iri", F.when(F.col("iri").startswith("https://"), "first").alias("target")), asked.select("iri", F.when(F.length("iri") > 30, "second").alias("target")))


# Validation

_ROLE = """e0 AS (SELECT first AS a, second AS b FROM property_axiom WHERE tag = 70 AND chain = '' UNION ALL SELECT first, second FROM property_axiom WHERE tag = 71 UNION ALL SELECT second, first FROM property_axiom WHERE tag = 71
 UNION ALL SELECT first, '~' || second FROM property_axiom WHERE tag = 73 UNION ALL SELECT second, '~' || first FROM property_axiom WHERE tag = 73 UNION ALL SELECT first, '~' || first FROM property_axiom WHERE tag = 80),
e AS (SELECT a, b FROM e0 UNION SELECT CASE WHEN starts_with(a, '~') THEN substr(a, 2) ELSE '~' || a END, CASE WHEN starts_with(b, '~') THEN substr(b, 2) ELSE '~' || b END FROM e0),
seed AS (SELECT first AS r FROM property_axiom WHERE tag = 82 UNION SELECT second FROM property_axiom WHERE tag = 70 AND chain <> '' UNION SELECT 'owl:topObjectProperty' UNION SELECT 'owl:bottomObjectProperty'),
bad AS (SELECT r AS role FROM seed UNION SELECT '~' || r FROM seed UNION SELECT e.b FROM bad JOIN e ON e.a = bad.role)"""


@raw(_with(_ROLE, "SELECT role FROM bad", True))
def role_analysis_non_simple(t):
    return hierarchy.non_simple(t.property_axiom)


@query(f"SELECT DISTINCT 'missing declaration' AS rule, iri AS subject, entity_kind AS detail FROM occurrence o WHERE entity_kind <> 'named_individual' AND NOT (iri LIKE 'rdf:%' OR iri LIKE 'rdfs:%' OR iri LIKE 'xsd:%' OR iri LIKE 'owl:%') AND {_NOT_BUILTIN} AND NOT EXISTS (SELECT 1 FROM declaration d WHERE d.kind = o.entity_kind AND d.iri = o.iri)")
def dl_missing_declaration(t):
    return validation.missing_declarations(t.occurrence, t.declaration)


@query("SELECT 'property punning' AS rule, iri AS subject, string_agg(kind, ',' ORDER BY kind) AS detail FROM (SELECT DISTINCT iri, kind FROM declaration WHERE kind LIKE '%property') x GROUP BY iri HAVING count(*) > 1")
def dl_property_punning(t):
    return validation.property_punning(t.declaration)


@query("SELECT 'class and datatype' AS rule, iri AS subject, '' AS detail FROM declaration WHERE kind IN ('class', 'datatype') GROUP BY iri HAVING count(DISTINCT kind) > 1")
def dl_class_datatype_punning(t):
    return validation.class_datatype_punning(t.declaration)


@raw(_with(_ROLE, "SELECT root_id, tag, role FROM (SELECT root_id, tag, first AS role FROM property_axiom WHERE tag IN (72, 76, 77, 79, 81) UNION ALL SELECT root_id, tag, second FROM property_axiom WHERE tag = 72) x WHERE role IN (SELECT role FROM bad)", True))
def dl_non_simple_uses(t):
    return hierarchy.simple_violations(t.property_axiom).select("root_id", "tag", "role")


@query("SELECT lexical, datatype, CASE datatype WHEN 'xsd:boolean' THEN lexical IN ('0', '1', 'true', 'false') WHEN 'xsd:byte' THEN try_cast(lexical AS bigint) BETWEEN -128 AND 127 ELSE true END AS valid FROM (SELECT DISTINCT lexical, datatype FROM data_assertion UNION ALL SELECT DISTINCT cast(p_size * 5 AS string), 'xsd:byte' FROM part UNION ALL SELECT DISTINCT cast(p_size AS string), 'xsd:boolean' FROM part) x")
def lexical_validity(t):
    own = t.data_assertion.select("lexical", "datatype").distinct()
    size = lambda k, d: t.part.select((F.col("p_size") * k).cast("string").alias("lexical"), F.lit(d).alias("datatype")).distinct()
    return validation.literal_report(own.unionByName(size(5, term("xsd:byte"))).unionByName(size(1, term("xsd:boolean"))))


@query("SELECT DISTINCT url AS iri, regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') AND NOT regexp_matches(url, '[ <>\"{}|^`]') AS valid FROM pages")
def iri_validity(t):
    return validation.iri_report(t.pages.select(F.col("url").alias("iri")).distinct())


# RDF


@query("SELECT s, o FROM triple WHERE p = 'rdfs:subClassOf'")
def rdf_pattern_scan(t):
    return rdf.find(t.triple, p=term("rdfs:subClassOf")).select("s", "o")


@raw(_with("walk AS (SELECT node AS head, 0 AS position, first AS item, rest FROM rdf_list WHERE head = 1 UNION ALL SELECT w.head, w.position + 1, l.first, l.rest FROM walk w JOIN rdf_list l ON l.node = w.rest)", "SELECT head, position, item FROM walk", True))
def rdf_list_items(t):
    return rdf.lists(t.rdf_list).select("head", "position", "item")


@query("SELECT s, p, o FROM triple WHERE p NOT IN ('rdfs:subClassOf', 'rdf:type', 'owl:inverseOf', 'rdfs:domain', 'rdfs:range', 'rdfs:subPropertyOf') AND p NOT IN (SELECT iri FROM declaration WHERE kind LIKE '%property')")
def rdf_unconsumed(t):
    return rdf.unconsumed(t.triple, rdf.entity_kinds(t.triple)).select("s", "p", "o")


@query("SELECT t.p AS p, k.kind AS kind, count(*) AS n FROM triple t JOIN (SELECT iri, CASE min(CASE kind WHEN 'annotation_property' THEN 0 WHEN 'data_property' THEN 1 ELSE 2 END) WHEN 0 THEN 'annotation_property' WHEN 1 THEN 'data_property' ELSE 'object_property' END AS kind FROM declaration WHERE kind LIKE '%property' GROUP BY iri) k ON t.p = k.iri GROUP BY 1, 2")
def rdf_property_uses(t):
    return rdf.property_uses(t.triple, rdf.entity_kinds(t.triple)).groupBy("p", "kind").agg(F.count("*").alias("n"))


# Order and digests


@query("SELECT iri FROM (SELECT DISTINCT iri FROM occurrence WHERE entity_kind = 'class') x ORDER BY strlen(iri), iri LIMIT 20")
def topk_canonical(t):
    return t.occurrence.where("entity_kind = 'class'").select("iri").distinct().orderBy(C.iri_order(F.col("iri"))).limit(20)


@query("SELECT iri, row_number() OVER (ORDER BY strlen(iri), iri) - 1 AS id FROM (SELECT DISTINCT iri FROM occurrence WHERE entity_kind = 'class') x")
def canonical_order(t):
    classes = t.occurrence.where("entity_kind = 'class'").select("iri").distinct()
    return views.dense_ids(classes, C.iri_order(F.col("iri"))).select("iri", F.col("id").cast("long").alias("id"))


@query("SELECT iri, sha256(unhex('6F6E746F6C6974683A7374727563747572616C2D76616C75653A763100020205') || unhex('05') || encode('class') || unhex('01' || lpad(hex(strlen(iri) + 3), 2, '0') || '0102' || lpad(hex(strlen(iri)), 2, '0')) || encode(iri)) AS digest FROM (SELECT DISTINCT iri FROM occurrence WHERE entity_kind = 'class') x")
def structural_digests(t):
    return t.occurrence.where("entity_kind = 'class'").select("iri").distinct().select("iri", C.digest(C.entity(F.lit("class"), F.col("iri"))).alias("digest"))


@query("SELECT count(*) AS n, bit_xor(h) AS mixed, cast(sum(h) AS varchar) AS total FROM (SELECT DISTINCT ('0x' || substr(md5(root_id), 1, 15))::BIGINT AS h, root_id FROM root) x")
def fingerprints(t):
    return algebra.fingerprint(t.root).select("n", "mixed", F.col("total").cast("string").alias("total"))


@query("SELECT document_key, count(*) AS n, sha256('document' || chr(10) || cast(count(*) AS varchar) || chr(10) || string_agg(d, '' ORDER BY d)) AS fingerprint FROM (SELECT DISTINCT document_key, sha256(root_id) AS d FROM root) x GROUP BY 1")
def document_fingerprints(t):
    return algebra.document_fingerprints(t.repeating("root"))


@query("SELECT count(*) AS n, sha256('logical' || chr(10) || cast(count(*) AS varchar) || chr(10) || string_agg(d, '' ORDER BY d)) AS fingerprint FROM (SELECT DISTINCT sha256(root_id) AS d FROM root WHERE tag > 60 AND tag < 120) x")
def logical_fingerprint(t):
    return algebra.view_fingerprint(t.root.where("tag > 60 and tag < 120").select("root_id"), "logical")


@query(f"SELECT count(*) AS n, sha256('signature' || chr(10) || cast(count(*) AS varchar) || chr(10) || string_agg(d, '' ORDER BY d)) AS fingerprint FROM (SELECT DISTINCT sha256(entity_kind || ' ' || iri) AS d FROM occurrence WHERE {_NOT_BUILTIN}) x")
def signature_fingerprint(t):
    return algebra.view_fingerprint(views.entities(t.occurrence, include_builtins=False).select(F.concat_ws(" ", "entity_kind", "iri").alias("root_id")), "signature")


@query("SELECT sha256('snapshot' || chr(10) || cast(count(*) AS varchar) || chr(10) || string_agg(document_key || ' ' || f || chr(10), '' ORDER BY document_key)) AS fingerprint, count(*) AS n FROM (SELECT document_key, sha256('document' || chr(10) || cast(count(*) AS varchar) || chr(10) || string_agg(d, '' ORDER BY d)) AS f FROM (SELECT DISTINCT document_key, sha256(root_id) AS d FROM root) x GROUP BY 1) y")
def snapshot_fingerprint(t):
    return algebra.snapshot_fingerprint(algebra.document_fingerprints(t.root))


@query("SELECT DISTINCT kind AS entity_kind, iri FROM declaration WHERE kind <> 'named_individual' AND regexp_matches(iri, '^urn:')")
def namespace_filter(t):
    return views.declared(t.declaration).where("entity_kind <> 'named_individual'").where(L.namespace(F.col("iri")).startswith("urn:"))


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_SQL)
