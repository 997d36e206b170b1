"""Structural and DL checks as unions of rule tables (rule, subject, detail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lexical import valid_iri, valid_literal
from ..schema import NAMESPACES
from .hierarchy import simple_violations
from .views import declared, is_builtin

# Namespaces whose terms need no declaration.
RESERVED = tuple(NAMESPACES[p] for p in ("rdf", "rdfs", "xsd", "owl"))


def reserved(iri):
    out = F.lit(False)
    for p in RESERVED:
        out = out | iri.startswith(p)
    return out


def property_punning(declaration: DataFrame) -> DataFrame:
    """IRIs declared as properties of more than one kind."""
    kinds = declaration.where("kind like '%property'").select("iri", "kind").distinct()
    return kinds.groupBy("iri").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds")).where("n > 1").select(F.lit("property punning").alias("rule"), F.col("iri").alias("subject"), F.col("kinds").alias("detail"))


def class_datatype_punning(declaration: DataFrame) -> DataFrame:
    kinds = declaration.where("kind in ('class', 'datatype')").select("iri", "kind").distinct()
    return kinds.groupBy("iri").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("class and datatype").alias("rule"), F.col("iri").alias("subject"), F.lit("").alias("detail"))


def missing_declarations(occurrence: DataFrame, declaration: DataFrame) -> DataFrame:
    """Used entities without a declaration of their kind; named individuals and reserved terms need none."""
    used = occurrence.where("entity_kind is not null and entity_kind <> 'named_individual'").where(~reserved(F.col("iri")) & ~is_builtin(F.col("entity_kind"), F.col("iri"))).select("entity_kind", "iri").distinct()
    return used.join(declared(declaration), ["entity_kind", "iri"], "left_anti").select(F.lit("missing declaration").alias("rule"), F.col("iri").alias("subject"), F.col("entity_kind").alias("detail"))


def non_simple_uses(property_axiom: DataFrame, occurrence: DataFrame | None = None) -> DataFrame:
    return simple_violations(property_axiom, occurrence).select(F.lit("non-simple property").alias("rule"), F.col("role").alias("subject"), F.col("tag").cast("string").alias("detail"))


def dl_report(occurrence: DataFrame, declaration: DataFrame, property_axiom: DataFrame) -> DataFrame:
    """All rules; a report from axioms alone is never complete."""
    return property_punning(declaration).unionByName(class_datatype_punning(declaration)).unionByName(missing_declarations(occurrence, declaration)).unionByName(non_simple_uses(property_axiom, occurrence))


def literal_report(literals: DataFrame) -> DataFrame:
    """literals (lexical, datatype, …) with valid."""
    return literals.withColumn("valid", valid_literal(F.col("lexical"), F.col("datatype")))


def iri_report(iris: DataFrame) -> DataFrame:
    return iris.withColumn("valid", valid_iri(F.col("iri")))


def validate_profile(name: str) -> dict:
    """Profiles EL, QL and RL aren't decided here: always incomplete, never conforming."""
    return {"profile": name, "complete": False, "conforms": False}
