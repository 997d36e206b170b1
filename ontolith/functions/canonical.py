"""Canonical bytes and digests as Catalyst expressions.

A node is varint(tag) and then its fields: a kind byte and a payload, nodes and set members being framed
by their length. For nodes without variable depth (IRI, Entity, Literal, named axioms) that is
a fixed expression, so it stays in generated code; ordering by the bytes is canonical order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import tag

#: Prefix of what is hashed; a deployment that must match another system's digests passes its own.
DOMAIN = b"ontolith:structural-value:v1\x00\x02"

# Kind bytes of field payloads.
ABSENT, NODE, TEXT, BYTES, INTEGER, ENUM, SET, SEQUENCE = range(8)


def let(value: Column, fn) -> Column:
    """fn of a value that is worked out once and written once, however often fn uses it."""
    return F.transform(F.array(value), fn)[0]


def varint(n: Column) -> Column:
    """LEB128 of a non-negative bigint."""

    def ladder(x):
        out = None
        for size in range(1, 10):
            parts = [F.lpad(F.hex(F.shiftrightunsigned(x, 7 * i).bitwiseAND(F.lit(127)).bitwiseOR(F.lit(128 if i < size - 1 else 0))), 2, "0") for i in range(size)]
            piece = F.concat(*parts)
            out = F.when(x < F.lit(1 << (7 * size)), piece) if out is None else out.when(x < F.lit(1 << (7 * size)), piece) if size < 9 else out.otherwise(piece)
        return F.unhex(out)

    return let(n.cast("long"), ladder)


def byte(n: int) -> Column:
    return F.lit(bytes([n]))


def framed(b: Column) -> Column:
    return let(b, lambda x: F.concat(varint(F.octet_length(x)), x))


def text_field(c: Column) -> Column:
    return F.concat(byte(TEXT), framed(F.encode(c, "UTF-8")))


def enum_field(c: Column) -> Column:
    return F.concat(byte(ENUM), framed(F.encode(c, "UTF-8")))


def node_field(canonical: Column) -> Column:
    return F.concat(byte(NODE), framed(canonical))


def set_field(members: Column) -> Column:
    """An array of canonical bytes: sorted, distinct, counted, each framed."""
    members = F.array_sort(F.array_distinct(members))
    body = F.aggregate(members, F.lit(b""), lambda acc, m: F.concat(acc, framed(m)))
    return F.concat(byte(SET), varint(F.size(members)), body)


def iri(value: Column) -> Column:
    return F.concat(varint(F.lit(tag("IRI"))), text_field(value))


def entity(kind: Column, value: Column) -> Column:
    return F.concat(varint(F.lit(tag("Entity"))), enum_field(kind), node_field(iri(value)))


def literal(lexical: Column, datatype: Column, language: Column) -> Column:
    lang = F.when(language.isNull(), byte(ABSENT)).otherwise(text_field(F.lower(language)))
    return F.concat(varint(F.lit(tag("Literal"))), text_field(lexical), node_field(entity(F.lit("datatype"), datatype)), lang)


def axiom(name: str, *nodes: Column) -> Column:
    """An axiom over single nodes, without annotations."""
    empty = F.concat(byte(SET), varint(F.lit(0)))
    return F.concat(varint(F.lit(tag(name))), *(node_field(n) for n in nodes), empty)


def digest(canonical: Column, domain: bytes = DOMAIN) -> Column:
    """Lower-case hex of the structural digest."""
    return F.sha2(F.concat(F.lit(domain), canonical), 256)


def iri_order(value: Column) -> Column:
    """Sort key that equals canonical order of entities of one kind."""
    return entity(F.lit("class"), value)
