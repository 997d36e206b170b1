"""What consumers ask of an engine before they use it: features, compatibility, cache keys, plugins, cancelling."""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from .schema import BY_NAME

#: What this engine can do.
FEATURES = frozenset(
    "functional_read functional_write owlxml_read owlxml_write rdfxml_read rdfxml_write turtle_read turtle_write imports overlays composites deltas views custom_views "
    "fingerprints canonical_bytes anonymous_canonical dl_validation snapshots streaming_deltas".split()
)
SCHEMA_VERSION = 2


@dataclass(frozen=True)
class Requirement:
    """What a consumer needs: features, the least schema version, constructors it will meet."""

    features: frozenset[str] = frozenset()
    schema_version: int = 1
    constructors: frozenset[str] = frozenset()


@dataclass(frozen=True)
class Agreement:
    ok: bool
    missing: tuple[str, ...] = ()
    reasons: tuple[str, ...] = field(default=())


def negotiate(need: Requirement, features: frozenset[str] = FEATURES, schema_version: int = SCHEMA_VERSION) -> Agreement:
    """Whether the engine meets a requirement, and what is missing; nothing is imported or run."""
    missing = sorted(need.features - features)
    reasons = [f"no feature {m}" for m in missing]
    if need.schema_version > schema_version:
        reasons.append(f"schema {need.schema_version} is newer than {schema_version}")
    reasons += [f"no constructor {c}" for c in sorted(need.constructors - set(BY_NAME))]
    return Agreement(not reasons, tuple(missing), tuple(reasons))


def cache_key(consumer: str, version: str, fingerprint: str, options: dict | None = None) -> str:
    """A key that changes with the consumer, its version, the data's fingerprint or the options."""
    text = json.dumps([consumer, version, fingerprint, SCHEMA_VERSION, options or {}], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def plugins(group: str = "ontolith.views") -> list[tuple[str, str]]:
    """(name, target) of installed entry points; metadata alone is read, nothing is imported."""
    from importlib.metadata import entry_points

    return sorted((e.name, e.value) for e in entry_points(group=group))


def conforms(provider) -> list[str]:
    """What an object that provides snapshot tables lacks of their columns; nothing, if it conforms."""
    needed = {
        "root": ("root_id", "tag", "root_kind", "document_key"),
        "occurrence": ("root_id", "entity_kind", "iri", "role", "in_annotation"),
        "declaration": ("root_id", "kind", "iri"),
        "sub_class": ("root_id", "sub", "sup"),
        "equivalent_class": ("root_id", "member"),
        "annotation_assertion": ("root_id", "property", "subject", "value_kind", "value", "lang"),
        "property_axiom": ("root_id", "tag", "first", "second", "chain"),
        "domain_range": ("root_id", "property_kind", "property", "record_kind", "value", "named"),
    }
    out = []
    for name, columns in needed.items():
        table = getattr(provider, name, None)
        if table is None:
            out.append(name)
        else:
            out += [f"{name}.{c}" for c in columns if c not in table.columns]
    return out


@contextmanager
def cancellable(spark: SparkSession, description: str = ""):
    """Jobs inside run under a tag; calling what is given cancels them all, from any thread."""
    tag = f"ontolith-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    sc.addJobTag(tag)
    if description:
        sc.setJobDescription(description)
    try:
        yield lambda: sc.cancelJobsWithTag(tag)
    finally:
        sc.removeJobTag(tag)
        if description:
            sc.setJobDescription(None)


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of each stage that runs now."""
    t = spark.sparkContext.statusTracker()
    infos = [t.getStageInfo(s) for s in t.getActiveStageIds()]
    return [(i.stageId, i.numCompletedTasks, i.numTasks) for i in infos if i]
