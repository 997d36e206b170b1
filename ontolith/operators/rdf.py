"""Triple patterns and the mapping of triples to axioms, as filters and joins over (s, p, o, o_kind, o_lang)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import connected_components, list_items
from ..schema import NAMESPACES, term

#: Predicates that a mapping rule consumes.
SIMPLE_RULES = {term(p): t for p, t in {"rdfs:subClassOf": 61, "rdf:type": 60, "owl:inverseOf": 73, "rdfs:domain": 74, "rdfs:range": 75, "rdfs:subPropertyOf": 70}.items()}


def find(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Pattern scan; what is bound becomes a pushed filter."""
    out = triples
    for name, value in (("s", s), ("p", p), ("o", o)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out


def in_order(triples: DataFrame) -> DataFrame:
    return triples.orderBy("s", "p", "o")


def one(triples: DataFrame, p: str) -> DataFrame:
    """(s, o) of a functional predicate; a subject with several objects is flagged."""
    return triples.where(F.col("p") == p).groupBy("s").agg(F.min("o").alias("o"), (F.countDistinct("o") > 1).alias("ambiguous"))


def contains(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(triples.select("s", "p", "o"), ["s", "p", "o"], "left_semi")


def lists(cells: DataFrame) -> DataFrame:
    return list_items(cells)


def entity_kinds(triples: DataFrame) -> DataFrame:
    """Declared kinds from rdf:type triples."""
    owl = NAMESPACES["owl"]
    return triples.where((F.col("p") == term("rdf:type")) & F.col("o").startswith(owl)).select(F.col("s").alias("iri"), F.expr(f"substring(o, {len(owl) + 1})").alias("kind")).distinct()


def property_uses(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """Triples whose predicate is a declared property, by its kind: annotation before data before object."""
    rank = F.when(F.col("kind") == "annotation_property", 0).when(F.col("kind") == "data_property", 1).when(F.col("kind") == "object_property", 2)
    best = kinds.where("kind like '%property'").groupBy("iri").agg(F.min(F.struct(rank.alias("r"), "kind")).alias("k")).select(F.col("iri").alias("p"), F.col("k.kind").alias("kind"))
    return triples.join(best, "p")


def simple_axioms(triples: DataFrame) -> DataFrame:
    """One axiom a triple, for the rules that need only it."""
    tag = None
    for p, t in SIMPLE_RULES.items():
        tag = F.when(F.col("p") == p, t) if tag is None else tag.when(F.col("p") == p, t)
    return triples.withColumn("tag", tag).where("tag is not null").select("tag", "s", "o")


def merged_equivalences(triples: DataFrame, predicate: str = term("owl:equivalentClass")) -> DataFrame:
    """Edges of one predicate collapse into one axiom a component: (component, member)."""
    edges = triples.where(F.col("p") == predicate).select(F.col("s").alias("a"), F.col("o").alias("b"))
    return connected_components(edges).select("component", F.col("node").alias("member"))


def reified(triples: DataFrame) -> DataFrame:
    """owl:Axiom nodes with their main triple; present tells whether that triple is there."""
    part = lambda p, name: triples.where(F.col("p") == p).select(F.col("s").alias("node"), F.col("o").alias(name))
    nodes = triples.where((F.col("p") == term("rdf:type")) & (F.col("o") == term("owl:Axiom"))).select(F.col("s").alias("node"))
    found = nodes.join(part(term("owl:annotatedSource"), "s"), "node").join(part(term("owl:annotatedProperty"), "p"), "node").join(part(term("owl:annotatedTarget"), "o"), "node")
    return found.join(triples.select("s", "p", "o").distinct().withColumn("there", F.lit(True)), ["s", "p", "o"], "left").select("node", "s", "p", "o", F.coalesce("there", F.lit(False)).alias("present"))


def unconsumed(triples: DataFrame, kinds: DataFrame) -> DataFrame:
    """Triples that no rule takes: predicate neither a rule's nor a declared property's."""
    used = kinds.where("kind like '%property'").select(F.col("iri").alias("p")).distinct()
    return triples.where(~F.col("p").isin(*SIMPLE_RULES)).join(used, "p", "left_anti")


def component_axioms_to_triples(sets: DataFrame, predicate: str) -> DataFrame:
    """Encodes n-ary axioms (root_id, member) as a chain of triples between neighbours in order."""
    ordered = sets.groupBy("root_id").agg(F.array_sort(F.collect_list("member")).alias("m"))
    pairs = ordered.select("root_id", F.explode(F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i - 1] as s, m[i] as o))")).alias("t")).where("t is not null")
    return pairs.select(F.col("t.s").alias("s"), F.lit(predicate).alias("p"), F.col("t.o").alias("o"))
