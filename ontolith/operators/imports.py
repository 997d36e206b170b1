"""Import closures, statuses, identities and resolvers as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import reachable, settle

IGNORE, RECORD, LOCAL, STRICT = "ignore", "record_unresolved", "resolve_local", "resolve_strict"


class ImportFailure(ValueError):
    """An import that the policy does not allow to stay unresolved."""


def closure(edges: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(start, node, depth): documents each start imports, directly or not; cycles end."""
    resolved = edges.where("status = 'resolved'").select(F.col("importing").alias("a"), F.col("imported").alias("b"))
    starts = seeds if seeds is not None else edges.select(F.col("importing").alias("node")).distinct()
    return reachable(resolved, starts)


def with_policy(edges: DataFrame, policy: str = STRICT) -> DataFrame:
    """Edges under a policy: IGNORE marks all ignored, RECORD keeps failures, LOCAL and STRICT raise on the first."""
    if policy == IGNORE:
        return edges.withColumn("status", F.lit("ignored"))
    if policy != RECORD:
        bad = edges.where("status <> 'resolved'").orderBy("importing", "imported").limit(1).collect()
        if bad:
            raise ImportFailure(f"{bad[0]['importing']} imports {bad[0]['imported']}: {bad[0]['status']}")
    return edges


def statuses(edges: DataFrame) -> DataFrame:
    return edges.groupBy("status").agg(F.count("*").alias("n"))


def completeness(edges: DataFrame) -> DataFrame:
    """By importing document: whether all its imports are resolved."""
    return edges.groupBy("importing").agg(F.bool_and(F.col("status") == "resolved").alias("complete"), F.count("*").alias("n"))


def identity_clashes(documents: DataFrame) -> DataFrame:
    """Identity claims (claim, source_sha256) made by sources of different bytes."""
    return documents.select("claim", "source_sha256").distinct().groupBy("claim").agg(F.count("*").alias("n")).where("n > 1")


def unique_sources(documents: DataFrame) -> DataFrame:
    """Each exact source once: the least key stands for its bytes."""
    return documents.groupBy("source_sha256").agg(F.min_by(F.struct(*documents.columns), "document_key").alias("d")).select("d.*")


def resolve_mapping(requests: DataFrame, mapping: DataFrame, limit: int = 128) -> DataFrame:
    """requests (iri) through an exact map (iri, target): an alias chase until no target is itself mapped.

    status is not_found, resolved, or cycle when the chase comes back or passes the limit.
    """
    now = requests.select("iri", F.col("iri").alias("at"), F.lit(0).alias("hops"))
    links = mapping.select(F.col("iri").alias("at"), F.col("target")).distinct()
    done = None
    for _ in range(limit):
        step = settle(now.join(links, "at", "left"))
        ended = step.where("target is null").select("iri", "at", "hops")
        done = ended if done is None else done.unionByName(ended)
        now = step.where("target is not null").select("iri", F.col("target").alias("at"), (F.col("hops") + 1).alias("hops"))
        if not now.limit(1).count():
            break
    looped = now.select("iri", F.lit(None).cast("string").alias("at"), "hops").withColumn("status", F.lit("cycle"))
    return done.withColumn("status", F.when(F.col("hops") == 0, "not_found").otherwise("resolved")).unionByName(looped).select("iri", F.when(F.col("status") == "resolved", F.col("at")).alias("target"), "status")


def resolve_catalog(requests: DataFrame, exact: DataFrame, rewrites: DataFrame) -> DataFrame:
    """An exact entry (iri, target) first, then the longest prefix (prefix, replacement)."""
    hit = requests.join(exact.withColumnRenamed("target", "exact"), "iri", "left")
    # An equi join, not a theta join, on those of a request's own prefixes that are as long as some rule's: lengths are few, whatever the rules.
    lengths = rewrites.where("prefix <> ''").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    own = requests.crossJoin(F.broadcast(lengths)).select("iri", F.explode(F.expr("transform(filter(lengths, n -> n <= length(iri)), n -> substring(iri, 1, n))")).alias("prefix"))
    best = own.join(rewrites, "prefix").groupBy("iri").agg(F.max_by(F.struct("prefix", "replacement"), F.struct(F.length("prefix"), "replacement")).alias("r"))
    out = hit.join(best, "iri", "left")
    return out.select("iri", F.coalesce("exact", F.concat(F.col("r.replacement"), F.expr("substring(iri, length(r.prefix) + 1)"))).alias("target"))


def resolve_directory(requests: DataFrame, files: DataFrame, strategy: str = "basename", prefix: str = "", suffix: str = ".ofn") -> DataFrame:
    """requests (iri) to files (path): by last segment, by path below a prefix, or by sha256 of the IRI; never outside the root."""
    last = F.regexp_extract("iri", r"([^/#]+)[/#]?$", 1)
    below = F.when(F.col("iri").startswith(prefix), F.expr(f"substring(iri, {len(prefix) + 1})"))
    name = {"basename": F.concat(last, F.lit(suffix)), "relative": F.concat(below, F.lit(suffix)), "sha256": F.concat(F.sha2("iri", 256), F.lit(suffix))}[strategy]
    safe = ~name.rlike(r"(^|/)\.\.(/|$)") & ~name.startswith("/")
    return requests.withColumn("path", F.when(safe, name)).join(files.select("path").distinct().withColumn("there", F.lit(True)), "path", "left").select("iri", F.when(F.col("there"), F.col("path")).alias("target"))


def resolve_first(*outcomes: DataFrame) -> DataFrame:
    """Composite resolver: of (iri, target) tables in order, the first target; `by` tells which."""
    rows = reduce(DataFrame.unionByName, [o.select("iri", "target", F.lit(i).alias("by")) for i, o in enumerate(outcomes)])
    found = rows.where("target is not null").groupBy("iri").agg(F.min(F.struct("by", "target")).alias("m"))
    return rows.select("iri").distinct().join(found, "iri", "left").select("iri", F.col("m.target").alias("target"), F.col("m.by").alias("by"))


def depth_spans(spans: DataFrame) -> DataFrame:
    """Most spans (start, end) open at once: a sweep over their ends, by ranges of positions."""
    from .algebra import running

    points = spans.select(F.col("start").alias("at"), F.lit(1).alias("d")).unionByName(spans.select(F.col("end").alias("at"), F.lit(-1).alias("d")))
    steps = points.groupBy("at").agg(F.sum("d").alias("d"))
    return running(steps, "d", F.col("at")).agg(F.max(F.col("before") + F.col("d")).alias("most"))


def edge_order() -> tuple:
    """Manifest order of import edges."""
    return F.col("importing"), F.col("imported"), F.col("status")


def totals(documents: DataFrame, by: str) -> DataFrame:
    """Load report: documents, bytes and failures by one column."""
    return documents.groupBy(by).agg(F.count("*").alias("documents"), F.sum("byte_length").alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("failed"))
