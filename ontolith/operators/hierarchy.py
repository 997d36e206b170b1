"""Asserted class and property hierarchies: one-hop edges, equivalence modes, components, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import term
from ..plans.graph import connected_components, reachable

PRESERVE, BIDIRECTIONAL, COMPONENT = "preserve", "bidirectional", "component"


def named_sets(equivalent: DataFrame) -> DataFrame:
    """(root_id, member) of axioms with at least two distinct named members."""
    members = equivalent.select("root_id", "member").distinct()
    return members.join(members.groupBy("root_id").agg(F.count("*").alias("n")).where("n >= 2").select("root_id"), "root_id", "left_semi")


def equivalence_sets(equivalent: DataFrame) -> DataFrame:
    """One row an axiom: its named members in order, comma-joined."""
    return named_sets(equivalent).groupBy("root_id").agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("members"), F.count("*").alias("n_members"))


def components(equivalent: DataFrame) -> DataFrame:
    """(node, component): stars around each axiom's least member, then connected components."""
    sets = named_sets(equivalent)
    star = sets.join(sets.groupBy("root_id").agg(F.min("member").alias("hub")), "root_id").select(F.col("hub").alias("a"), F.col("member").alias("b"))
    return connected_components(star)


def equivalents_one_hop(equivalent: DataFrame) -> DataFrame:
    """(child, parent) both ways for each pair of an axiom; pairs are what is asked for here."""
    m = named_sets(equivalent)
    return m.alias("x").join(m.alias("y"), (F.col("x.root_id") == F.col("y.root_id")) & (F.col("x.member") != F.col("y.member"))).select(F.col("x.member").alias("child"), F.col("y.member").alias("parent")).distinct()


def class_edges(sub_class: DataFrame, equivalent: DataFrame, mode: str = PRESERVE, disjoint_union: DataFrame | None = None) -> DataFrame:
    """Distinct (child, parent) edges; self loops go."""
    edges = sub_class.select(F.col("sub").alias("child"), F.col("sup").alias("parent"))
    if disjoint_union is not None:
        edges = edges.unionByName(disjoint_union.select(F.col("member").alias("child"), F.col("defined").alias("parent")))
    if mode == BIDIRECTIONAL:
        edges = edges.unionByName(equivalents_one_hop(equivalent))
    elif mode == COMPONENT:
        c = components(equivalent)
        edges = (
            edges.join(c.select(F.col("node").alias("child"), F.col("component").alias("cc")), "child", "left")
            .join(c.select(F.col("node").alias("parent"), F.col("component").alias("pc")), "parent", "left")
            .select(F.coalesce("cc", "child").alias("child"), F.coalesce("pc", "parent").alias("parent"))
        )
    return edges.where("child <> parent").distinct()


def parents(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of the given children (node)."""
    return edges.join(nodes.select(F.col("node").alias("child")), "child", "left_semi")


def children(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("parent")), "parent", "left_semi")


def property_edges(axioms: DataFrame) -> DataFrame:
    """Named sub-property axioms (object 70, data 90, annotation 121); chains are no edges."""
    return axioms.where("tag in (70, 90, 121) and chain = ''").select("tag", F.col("first").alias("child"), F.col("second").alias("parent")).distinct()


def property_chains(axioms: DataFrame) -> DataFrame:
    return axioms.where("tag = 70 and chain <> ''").select("chain", F.col("second").alias("super_property"), F.size(F.split("chain", ">")).alias("length"))


def inverse_pairs(axioms: DataFrame) -> DataFrame:
    """Each pair once, the canonical-least (shorter, then smaller) first."""
    swap = (F.length("first") > F.length("second")) | ((F.length("first") == F.length("second")) & (F.col("first") > F.col("second")))
    return axioms.where("tag = 73").select(F.when(swap, F.col("second")).otherwise(F.col("first")).alias("first"), F.when(swap, F.col("first")).otherwise(F.col("second")).alias("second")).distinct()


def inverse(c: str) -> Column:
    """The inverse role, written with a leading ~; of an inverse, the role."""
    return F.when(F.col(c).startswith("~"), F.expr(f"substring({c}, 2)")).otherwise(F.concat(F.lit("~"), F.col(c)))


def role_edges(axioms: DataFrame) -> DataFrame:
    """(a, b): a is a sub-role of b; every edge has its mirror between inverses."""
    rows = axioms.where("chain = ''")
    sub = rows.where("tag = 70").select(F.col("first").alias("a"), F.col("second").alias("b"))
    same = rows.where("tag = 71")
    both = same.select(F.col("first").alias("a"), F.col("second").alias("b")).unionByName(same.select(F.col("second").alias("a"), F.col("first").alias("b")))
    pair = rows.where("tag = 73")
    to_inverse = pair.select(F.col("first").alias("a"), inverse("second").alias("b")).unionByName(pair.select(F.col("second").alias("a"), inverse("first").alias("b")))
    mirror = rows.where("tag = 80").select(F.col("first").alias("a"), inverse("first").alias("b"))
    edges = sub.unionByName(both).unionByName(to_inverse).unionByName(mirror)
    return edges.unionByName(edges.select(inverse("a").alias("a"), inverse("b").alias("b"))).distinct()


def composite_roles(axioms: DataFrame) -> DataFrame:
    """Seeds (node): top and bottom roles, transitive roles and chain supers, with their inverses."""
    ends = axioms.where("tag = 82").select(F.col("first").alias("node")).unionByName(axioms.where("tag = 70 and chain <> ''").select(F.col("second").alias("node")))
    fixed = axioms.sparkSession.createDataFrame([(term("owl:topObjectProperty"),), (term("owl:bottomObjectProperty"),)], "node string")
    seeds = ends.unionByName(fixed)
    return seeds.unionByName(seeds.select(inverse("node").alias("node"))).distinct()


def non_simple(axioms: DataFrame) -> DataFrame:
    """Roles reachable upwards from composite ones."""
    return reachable(role_edges(axioms), composite_roles(axioms)).select(F.col("node").alias("role")).distinct()


#: Axioms and expressions that need a simple role where they name one: characteristics, disjointness, keys, self, cardinalities.
SIMPLE_TAGS = (37, 38, 39, 40, 72, 76, 77, 79, 81, 101)


def simple_positions(axioms: DataFrame, occurrence: DataFrame | None = None) -> DataFrame:
    """(root_id, tag, role): places that need a simple role, of flat axioms or, where paths are known, of all occurrences."""
    if occurrence is not None and "path" in occurrence.columns:
        last = F.regexp_extract("path", r"(?:^|/)(\d+)\.\d+(?:\.\d+)?(?:/10\.0)?$", 1).cast("int")
        turned = F.col("path").rlike(r"(^|/)10\.0$")
        rows = occurrence.where("entity_kind = 'object_property'").where(last.isin(*SIMPLE_TAGS))
        return rows.select("root_id", last.alias("tag"), F.when(turned, inverse("iri")).otherwise(F.col("iri")).alias("role"))
    needs = axioms.where(F.col("tag").isin(*SIMPLE_TAGS))
    ends = F.when(F.col("tag") == 72, F.array("first", "second")).otherwise(F.array("first"))
    return needs.select("root_id", "tag", F.explode(ends).alias("role"))


def simple_violations(axioms: DataFrame, occurrence: DataFrame | None = None) -> DataFrame:
    """Places that need a simple role over one that isn't, one row a place."""
    return simple_positions(axioms, occurrence).join(non_simple(axioms), "role", "left_semi").select("root_id", "tag", "role")


def property_components(axioms: DataFrame) -> DataFrame:
    """(node, component) of object and data properties that equivalence axioms hold together."""
    return connected_components(axioms.where("tag in (71, 91)").select(F.col("first").alias("a"), F.col("second").alias("b")))


def property_parents(axioms: DataFrame, nodes: DataFrame) -> DataFrame:
    return parents(property_edges(axioms), nodes)


def property_children(axioms: DataFrame, nodes: DataFrame) -> DataFrame:
    return children(property_edges(axioms), nodes)


def property_equivalents(axioms: DataFrame) -> DataFrame:
    """(property, other) both ways for each pair of an equivalence axiom."""
    rows = axioms.where("tag in (71, 91)").where("first <> second")
    return rows.select(F.col("first").alias("property"), F.col("second").alias("other")).unionByName(rows.select(F.col("second").alias("property"), F.col("first").alias("other"))).distinct()


def edge_order() -> tuple[Column, ...]:
    """Child, then parent, shorter IRIs first, as canonical bytes sort."""
    return F.length("child"), F.col("child"), F.length("parent"), F.col("parent")


def domain_ranges(records: DataFrame, record_kind: str | None = None, named_only: bool = False) -> DataFrame:
    rows = records.where(F.col("record_kind") == record_kind) if record_kind else records
    return rows.where("named") if named_only else rows


def domain_range_loss(records: DataFrame) -> DataFrame:
    """How many records named_only leaves out."""
    return records.groupBy("property_kind", "record_kind").agg(F.count("*").alias("n"), F.count_if(~F.col("named")).alias("lost"))
