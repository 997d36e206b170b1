"""OWL/XML: elements carry the names of constructors, so both ways follow the registry's shapes."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from urllib.parse import urljoin
from xml.sax.saxutils import escape, quoteattr

from ..schema import BY_NAME
from .functional import _SHAPES, KINDS, PREFIXES, Document, SyntaxProblem
from .nodes import LITERAL, NOTHING, THING, Node, anonymous, boolean, entity, iri, literal, make
from .turtle import guard_xml

NS = PREFIXES["owl"].rstrip("#") + "#"
_XML = "{http://www.w3.org/XML/1998/namespace}"
_DATA_PROPERTY, _RANGES = {"DataProperty"}, {n for n in _SHAPES if BY_NAME[n].category == "data_range"} | {"Datatype"}


class _Reader:
    def __init__(self, text: str, scope: bytes):
        guard_xml(text)
        try:
            self.root = ET.fromstring(text.encode())
        except ET.ParseError as e:
            raise SyntaxProblem(str(e)) from e
        self.scope, self.prefixes = scope, dict(PREFIXES)

    def name(self, e) -> str:
        if not e.tag.startswith("{" + NS + "}"):
            raise SyntaxProblem(f"{e.tag} is no element of this format")
        return e.tag[len(NS) + 2 :]

    def address(self, e) -> str:
        if (x := e.get("IRI")) is not None:
            return urljoin(self.root.get(_XML + "base", ""), x) if ":" not in x else x
        if (x := e.get("abbreviatedIRI")) is not None:
            prefix, _, local = x.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + local
        return (e.text or "").strip()

    def term(self, e):
        n = self.name(e)
        if n in KINDS:
            return entity(KINDS[n], self.address(e))
        if n in ("IRI", "AbbreviatedIRI"):
            text = (e.text or "").strip()
            prefix, _, local = text.partition(":")
            return iri(self.prefixes[prefix] + local if n == "AbbreviatedIRI" else urljoin(self.root.get(_XML + "base", ""), text))
        if n == "AnonymousIndividual":
            return anonymous(self.scope, e.get("nodeID", "").removeprefix("_:"))
        if n == "Literal":
            return literal(e.text or "", e.get("datatypeIRI"), e.get(_XML + "lang"))
        if n == "ObjectInverseOf":
            inner = self.term(e[0])
            return inner.values[0] if inner.name == "ObjectInverseOf" else make("ObjectInverseOf", inner)
        if n == "ObjectPropertyChain":
            return make(n, [self.term(x) for x in e])
        if n == "FacetRestriction":
            return make(n, iri(e.get("facet")), self.term(e[0]))
        if n == "Annotation":
            notes = [self.term(x) for x in e if self.name(x) == "Annotation"]
            rest = [self.term(x) for x in e if self.name(x) != "Annotation"]
            return make(n, *rest, notes)
        if n in _SHAPES:
            return self.build(n, list(e), e.get("cardinality"))
        raise SyntaxProblem(f"unknown element {n}")

    def build(self, n: str, parts, cardinality=None, notes=None):
        shape, args = _SHAPES[n], [self.term(x) for x in parts]
        axiom = notes is not None
        more = (notes,) if axiom else ()
        if shape in ("C", "D", "I", "L", "O", "Q"):
            if not axiom:
                return boolean(n, args) if shape in ("C", "D") else make(n, args)
            if n == "DisjointClasses" and len(args) > 1 and len(set(args)) == 1:
                return make("SubClassOf", args[0], entity("class", NOTHING), notes)
            return make(n, args, notes)
        if shape == "kC":
            return make(n, args[0], args[1:], *more)
        if shape == "tF":
            return make(n, args[0], args[1:])
        if shape == "Rd":
            return make(n, args[:-1], args[-1])
        if shape == "c(":
            kinds = [self.name(x) for x in parts[1:]]
            return make(n, args[0], [a for a, k in zip(args[1:], kinds, strict=True) if k not in _DATA_PROPERTY], [a for a, k in zip(args[1:], kinds, strict=True) if k in _DATA_PROPERTY], *more)
        if shape.endswith("?"):
            if len(args) == 1:
                args.append(entity("class", THING) if "c" in shape else entity("datatype", LITERAL))
            return make(n, int(cardinality), *args)
        return make(n, *args, *more)

    def document(self) -> Document:
        if self.name(self.root) != "Ontology":
            raise SyntaxProblem("the root must be Ontology")
        doc = Document(self.root.get("ontologyIRI"), self.root.get("versionIRI"))
        for e in self.root:
            n = self.name(e)
            if n == "Prefix":
                self.prefixes[e.get("name", "")] = e.get("IRI")
            elif n == "Import":
                doc.imports.append((e.text or "").strip())
            elif n == "Annotation":
                doc.annotations.append(self.term(e))
            else:
                notes = [self.term(x) for x in e if self.name(x) == "Annotation"]
                parts = [x for x in e if self.name(x) != "Annotation"]
                doc.axioms.append(make(n, self.term(parts[0]), notes) if n == "Declaration" else self.build(n, parts, e.get("cardinality"), notes))
        doc.prefixes = self.prefixes
        return doc


def parse(text: str, scope: bytes = bytes(32)) -> Document:
    return _Reader(text, scope).document()


_WORD = {v: k for k, v in KINDS.items()}


def write_term(n: Node) -> str:
    if n.name == "IRI":
        return f"<IRI>{escape(n.values[0])}</IRI>"
    if n.name == "Entity":
        return f"<{_WORD[n.values[0]]} IRI={quoteattr(n.values[1].values[0])}/>"
    if n.name == "AnonymousIndividual":
        return f"<AnonymousIndividual nodeID={quoteattr('_:' + n.values[1].decode())}/>"
    if n.name == "Literal":
        lexical, datatype, lang = n.values
        mark = f" xml:lang={quoteattr(lang)}" if lang else f" datatypeIRI={quoteattr(datatype.values[1].values[0])}"
        return f"<Literal{mark}>{escape(lexical)}</Literal>"
    if n.name == "FacetRestriction":
        return f"<FacetRestriction facet={quoteattr(n.values[0].values[0])}>{write_term(n.values[1])}</FacetRestriction>"
    head, parts = "", []
    for f, v in zip(BY_NAME[n.name].fields, n.values, strict=True):
        if isinstance(v, int):
            head = f' cardinality="{v}"'
        else:
            items = [write_term(x) for x in v] if f.kind != "one" else [write_term(v)]
            parts = items + parts if f.name == "annotations" else parts + items
    return f"<{n.name}{head}>{''.join(parts)}</{n.name}>"


def write(doc: Document) -> str:
    attributes = "".join(f" {k}={quoteattr(v)}" for k, v in (("ontologyIRI", doc.ontology_iri), ("versionIRI", doc.version_iri)) if v)
    lines = [f"<Import>{escape(x)}</Import>" for x in sorted(set(doc.imports))]
    for part in (doc.annotations, doc.axioms):
        lines += [write_term(n) for n in sorted(set(part), key=lambda n: n.canonical)]
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Ontology xmlns="{NS}"{attributes}>\n' + "".join(f"  {x}\n" for x in lines) + "</Ontology>\n"
