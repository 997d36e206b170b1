"""Index views over axiom tables: axiom types, signature, declarations, annotations, references, expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.lexical import language_matches
from ..schema import ENTITY_KINDS, constructors, term

# Entities that need no declaration, by kind.
BUILTINS = {
    "class": ("owl:Thing", "owl:Nothing"),
    "datatype": (
        "rdfs:Literal", "rdf:PlainLiteral", "rdf:XMLLiteral",
        *(f"xsd:{n}" for n in "anyURI base64Binary boolean byte dateTime dateTimeStamp decimal double float hexBinary int integer language long Name NCName negativeInteger NMTOKEN nonNegativeInteger nonPositiveInteger normalizedString positiveInteger short string token unsignedByte unsignedInt unsignedLong unsignedShort".split()),
    ),
    "object_property": ("owl:topObjectProperty", "owl:bottomObjectProperty"),
    "data_property": ("owl:topDataProperty", "owl:bottomDataProperty"),
    "annotation_property": ("rdfs:label", "rdfs:comment", "rdfs:seeAlso", "rdfs:isDefinedBy", "owl:deprecated", "owl:versionInfo", "owl:priorVersion", "owl:backwardCompatibleWith", "owl:incompatibleWith"),
}
LABEL = term("rdfs:label")


# Axiom types


def axiom_type_counts(root: DataFrame) -> DataFrame:
    """Axioms of each exact constructor."""
    spec = F.broadcast(constructors(root.sparkSession))
    return root.where("root_kind = 'axiom'").groupBy("tag").agg(F.count("*").alias("n")).join(spec, "tag").select("tag", "name", "n")


def category_counts(root: DataFrame) -> DataFrame:
    spec = F.broadcast(constructors(root.sparkSession))
    return root.where("root_kind = 'axiom'").groupBy("tag").agg(F.count("*").alias("n")).join(spec, "tag").groupBy("category").agg(F.sum("n").alias("n"))


def category_rollup(root: DataFrame) -> DataFrame:
    """(category, name, n): by type, by category (name null) and of all (both null)."""
    spec = F.broadcast(constructors(root.sparkSession))
    counts = root.where("root_kind = 'axiom'").groupBy("tag").agg(F.count("*").alias("n")).join(spec, "tag")
    return counts.rollup("category", "name").agg(F.sum("n").alias("n"))


def ontology_annotations(root: DataFrame, document_key: str | None = None) -> DataFrame:
    """Roots that annotate an ontology as a whole."""
    out = root.where("root_kind = 'ontology_annotation'")
    return out.where(F.col("document_key") == document_key) if document_key is not None else out


def extensions(root: DataFrame, namespace: str | None = None) -> DataFrame:
    """Extension roots (SWRL rules); any other namespace has none."""
    out = root.where("root_kind = 'extension'")
    return out if namespace in (None, "swrl") else out.where(F.lit(False))


def in_document(root: DataFrame, document: DataFrame, document_key: str) -> DataFrame:
    """Roots of one document; a key that isn't there is a KeyError."""
    if not document.where(F.col("document_key") == document_key).limit(1).count():
        raise KeyError(document_key)
    return root.where(F.col("document_key") == document_key)


def axioms(root: DataFrame, tag: int | None = None, document_key: str | None = None) -> DataFrame:
    """Exact type and document filters; both reach the scans."""
    out = root.where("root_kind = 'axiom'")
    if tag is not None:
        out = out.where(F.col("tag") == tag)
    return out.where(F.col("document_key") == document_key) if document_key is not None else out


def contains(root: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (root_id) with found."""
    return probes.join(root.select("root_id").distinct().withColumn("hit", F.lit(True)), "root_id", "left").select("root_id", F.coalesce("hit", F.lit(False)).alias("found"))


# Signature


def is_builtin(kind: Column, iri: Column) -> Column:
    """Kind and IRI must both match."""
    out = F.lit(False)
    for k, names in BUILTINS.items():
        out = out | ((kind == k) & iri.isin(*map(term, names)))
    return out


def _entities(occurrence: DataFrame, include_builtins: bool, include_annotations: bool) -> DataFrame:
    rows = occurrence.where("entity_kind is not null")
    if not include_builtins:
        rows = rows.where(~is_builtin(F.col("entity_kind"), F.col("iri")))
    return rows if include_annotations else rows.where("not in_annotation")


def entities(occurrence: DataFrame, include_builtins: bool = True, include_annotations: bool = True) -> DataFrame:
    """(entity_kind, iri): the signature without counts."""
    return _entities(occurrence, include_builtins, include_annotations).select("entity_kind", "iri").distinct()


def signature(occurrence: DataFrame, include_builtins: bool = True, include_annotations: bool = True) -> DataFrame:
    """(entity_kind, iri, n_roots, n_roots_plain, n_declarations): counts are of roots, not of places."""
    rows = _entities(occurrence, include_builtins, include_annotations)
    # A root's repeats go first, by 128 bits of its id; then plain sums need no distinct expansion.
    key = (F.xxhash64("root_id").alias("h1"), F.xxhash64(F.lit(1), "root_id").alias("h2"))
    once = rows.groupBy("entity_kind", "iri", *key).agg(F.min(F.col("in_annotation").cast("int")).alias("only_annotation"), F.max((F.col("role") == "declaration").cast("int")).alias("declares"))
    return once.groupBy("entity_kind", "iri").agg(F.count("*").alias("n_roots"), F.sum(1 - F.col("only_annotation")).alias("n_roots_plain"), F.sum("declares").alias("n_declarations"))


def declaration_counts(occurrence: DataFrame) -> DataFrame:
    """(entity_kind, iri, n): declaring roots of each entity."""
    rows = occurrence.where("role = 'declaration' and entity_kind is not null")
    return rows.groupBy("entity_kind", "iri", F.xxhash64("root_id").alias("h1"), F.xxhash64(F.lit(1), "root_id").alias("h2")).agg(F.lit(1).alias("one")).groupBy("entity_kind", "iri").agg(F.count("*").alias("n"))


def changed_counts(base: DataFrame, change: DataFrame) -> DataFrame:
    """Counts (entity_kind, iri, n) after signed changes (entity_kind, iri, sign), never under 0; none left, no row."""
    rows = base.select("entity_kind", "iri", "n").unionByName(change.select("entity_kind", "iri", F.col("sign").cast("long").alias("n")))
    return rows.groupBy("entity_kind", "iri").agg(F.greatest(F.lit(0).cast("long"), F.sum("n")).alias("n")).where("n > 0")


def signature_order() -> Column:
    """The view's order: kind as declared, then IRI."""
    out = F.lit(len(ENTITY_KINDS))
    for i, k in enumerate(ENTITY_KINDS):
        out = F.when(F.col("entity_kind") == k, i).otherwise(out)
    return F.struct(out.alias("kind"), F.col("iri"))


def flat_iris(occurrence: DataFrame) -> DataFrame:
    return occurrence.where("entity_kind is not null").select("iri").distinct()


def punned(occurrence: DataFrame) -> DataFrame:
    """IRIs of more than one kind, with their kinds in view order."""
    kinds = entities(occurrence).groupBy("iri").agg(F.array_join(F.array_sort(F.collect_list("entity_kind")), ",").alias("kinds"), F.count("*").alias("n_kinds"))
    return kinds.where("n_kinds > 1")


# Declarations


def declared(declaration: DataFrame) -> DataFrame:
    return declaration.select(F.col("kind").alias("entity_kind"), "iri").distinct()


def undeclared(occurrence: DataFrame, declaration: DataFrame, include_builtins: bool = False) -> DataFrame:
    """Entities of the signature that no axiom declares."""
    used = occurrence.where("entity_kind is not null").select("entity_kind", "iri")
    if not include_builtins:
        used = used.where(~is_builtin(F.col("entity_kind"), F.col("iri")))
    return used.distinct().join(declared(declaration), ["entity_kind", "iri"], "left_anti")


# Annotations


def annotation_values(assertions: DataFrame, property: str, subject: str | None = None) -> DataFrame:
    rows = assertions.where(F.col("property") == property)
    if subject is not None:
        rows = rows.where(F.col("subject") == subject)
    return rows.select("subject", "value_kind", "value", "lang").distinct()


def reverse_iri(assertions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Assertions whose value is one of the IRIs in wanted (iri)."""
    return assertions.where("value_kind = 'iri'").join(wanted.select(F.col("iri").alias("value")).distinct(), "value", "left_semi")


def preferred_label(assertions: DataFrame, preferences: list[str], property: str = LABEL, untagged: bool = True) -> DataFrame:
    """One literal a subject: the first preference that matches, then untagged; least value of several."""
    rank = F.when(F.col("lang").isNull(), len(preferences)) if untagged else F.when(F.lit(False), 0)
    for i, p in enumerate(preferences):
        rank = rank.when(language_matches(F.col("lang"), F.lit(p)), i)
    rows = assertions.where((F.col("property") == property) & (F.col("value_kind") == "literal")).withColumn("rank", rank).where("rank is not null")
    # min over a struct needs one partial aggregation and no sort.
    best = rows.groupBy("subject").agg(F.min(F.struct("rank", "value", F.coalesce("lang", F.lit("")).alias("lang"))).alias("b"))
    return best.select("subject", F.col("b.value").alias("value"), F.col("b.lang").alias("lang"))


def nested_annotations(edges: DataFrame, rounds: int = 512) -> DataFrame:
    """(container, annotation, depth) from annotation edges (parent, child) under root containers (parent not a child)."""
    from ..plans.graph import descend

    return descend(edges, rounds)


# References and expressions


def references(occurrence: DataFrame, role: str | None = None, include_annotations: bool = True) -> DataFrame:
    rows = occurrence if include_annotations else occurrence.where("not in_annotation")
    return rows.where(F.col("role") == role) if role else rows


def reference_counts(occurrence: DataFrame) -> DataFrame:
    """Places, not roots, by role."""
    return occurrence.groupBy("entity_kind", "iri", "role").agg(F.count("*").alias("n"))


def expressions(occurrence: DataFrame) -> DataFrame:
    """Expression occurrences: classes, datatypes, object and data properties, by role."""
    return occurrence.where(F.col("entity_kind").isin("class", "datatype", "object_property", "data_property") & (F.col("role") != "declaration"))


def postings(occurrence: DataFrame) -> DataFrame:
    """Per expression: places, roots, and the least root."""
    rows = expressions(occurrence).groupBy("entity_kind", "iri", "root_id").agg(F.count("*").alias("places"))
    return rows.groupBy("entity_kind", "iri").agg(F.sum("places").alias("n"), F.count("*").alias("n_roots"), F.min("root_id").alias("first_root"))


def of_iri(occurrence: DataFrame, iri: str) -> DataFrame:
    """All places of an IRI, of every kind of entity and as a bare IRI."""
    return occurrence.where(F.col("iri") == iri)


def with_axiom(occurrence: DataFrame, root: DataFrame) -> DataFrame:
    """Places with axiom_id: their root where that is an axiom, null in ontology annotations and rules."""
    kinds = root.select("root_id", "root_kind").distinct()
    return occurrence.join(kinds, "root_id", "left").withColumn("axiom_id", F.when(F.col("root_kind") == "axiom", F.col("root_id"))).drop("root_kind")


def occurrence_order() -> tuple[Column, ...]:
    """Container, path, role, key."""
    return F.col("root_id"), F.col("path"), F.col("role"), F.col("entity_kind"), F.col("iri")


def posting_lists(occurrence: DataFrame) -> DataFrame:
    """Per expression its sorted places, comma-joined: (entity_kind, iri, places)."""
    rows = expressions(occurrence).select("entity_kind", "iri", F.concat_ws("/", F.md5("root_id"), "role").alias("place"))
    return rows.groupBy("entity_kind", "iri").agg(F.array_join(F.sort_array(F.collect_list("place")), ",").alias("places"))


def dense_ids(entities: DataFrame, order: Column) -> DataFrame:
    """Ids 0, 1, … in the given order, without one task numbering all: ranks within ranges plus range offsets."""
    ranged = entities.withColumn("__key", order).repartitionByRange("__key").withColumn("__part", F.spark_partition_id())
    from ..plans.graph import settle

    ranged = settle(ranged)
    offsets = ranged.groupBy("__part").count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    local = ranged.withColumn("__rank", F.row_number().over(W.partitionBy("__part").orderBy("__key")) - 1)
    return local.join(F.broadcast(offsets.select("__part", "before")), "__part").withColumn("id", F.col("before") + F.col("__rank")).drop("__part", "__rank", "before", "__key")
