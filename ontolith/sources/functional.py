"""OWL 2 functional-style syntax: reader and writer."""

from __future__ import annotations

import re
import sys
from contextlib import contextmanager
from dataclasses import dataclass, field

from ..schema import BY_NAME
from .nodes import LITERAL, NOTHING, THING, Node, anonymous, boolean, entity, iri, literal, make

PREFIXES = {
    "owl": "http://www.w3.org/2002/07/owl#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
}

KINDS = {"Class": "class", "Datatype": "datatype", "ObjectProperty": "object_property", "DataProperty": "data_property", "AnnotationProperty": "annotation_property", "NamedIndividual": "named_individual"}

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)|(?P<string>"(?:[^"\\]|\\["\\])*")|(?P<caret>\^\^)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<open>\()|(?P<close>\))|(?P<eq>:?=)|(?P<blank>_:[\w.\-]+)|(?P<name>[^\s()<>"=@^\#]*:[^\s()<>"=@^]*|[^\s()<>"=@^:]+)""",
    re.X,
)


#: Tokens held at once, and entities that are made once and used again.
AHEAD, KNOWN = 4096, 4096


class SyntaxProblem(ValueError):
    """Text that the grammar does not allow, with its place."""


@dataclass
class Document:
    ontology_iri: str | None = None
    version_iri: str | None = None
    imports: list[str] = field(default_factory=list)
    annotations: list[Node] = field(default_factory=list)
    axioms: list[Node] = field(default_factory=list)
    extensions: list[Node] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)


# How each constructor's arguments are read: one letter a field. c class, C classes, d data range, D data ranges,
# o object property, O properties, p sub-property or chain, q data property, Q data properties, a annotation property,
# i individual, I individuals, l literal, L literals, n number, u IRI, f facets, t datatype, s subject, v annotation value,
# capital letters take all that follow; ? marks a filler that may be left out.
_SHAPES = {
    "ObjectIntersectionOf": "C", "ObjectUnionOf": "C", "ObjectComplementOf": "c", "ObjectOneOf": "I", "ObjectSomeValuesFrom": "oc", "ObjectAllValuesFrom": "oc",
    "ObjectHasValue": "oi", "ObjectHasSelf": "o", "ObjectMinCardinality": "noc?", "ObjectMaxCardinality": "noc?", "ObjectExactCardinality": "noc?",
    "DataSomeValuesFrom": "Rd", "DataAllValuesFrom": "Rd", "DataHasValue": "ql", "DataMinCardinality": "nqd?", "DataMaxCardinality": "nqd?", "DataExactCardinality": "nqd?",
    "DataIntersectionOf": "D", "DataUnionOf": "D", "DataComplementOf": "d", "DataOneOf": "L", "DatatypeRestriction": "tF",
    "SubClassOf": "cc", "EquivalentClasses": "C", "DisjointClasses": "C", "DisjointUnion": "kC",
    "SubObjectPropertyOf": "po", "EquivalentObjectProperties": "O", "DisjointObjectProperties": "O", "InverseObjectProperties": "oo", "ObjectPropertyDomain": "oc", "ObjectPropertyRange": "oc",
    "FunctionalObjectProperty": "o", "InverseFunctionalObjectProperty": "o", "ReflexiveObjectProperty": "o", "IrreflexiveObjectProperty": "o", "SymmetricObjectProperty": "o", "AsymmetricObjectProperty": "o", "TransitiveObjectProperty": "o",
    "SubDataPropertyOf": "qq", "EquivalentDataProperties": "Q", "DisjointDataProperties": "Q", "DataPropertyDomain": "qc", "DataPropertyRange": "qd", "FunctionalDataProperty": "q",
    "DatatypeDefinition": "td", "HasKey": "c(", "SameIndividual": "I", "DifferentIndividuals": "I", "ClassAssertion": "ci", "ObjectPropertyAssertion": "oii", "NegativeObjectPropertyAssertion": "oii",
    "DataPropertyAssertion": "qil", "NegativeDataPropertyAssertion": "qil", "AnnotationAssertion": "asv", "SubAnnotationPropertyOf": "aa", "AnnotationPropertyDomain": "au", "AnnotationPropertyRange": "au",
}
_CLASS_WORDS = {n for n in _SHAPES if BY_NAME[n].category == "class_expression"}
_RANGE_WORDS = {n for n in _SHAPES if BY_NAME[n].category == "data_range"}
_AXIOM_WORDS = {n for n in _SHAPES if BY_NAME[n].category.endswith("axiom")} | {"Declaration"}


class Reader:
    def __init__(self, text: str, scope: bytes = bytes(32), max_depth: int = 512):
        self.text, self.scope, self.max_depth, self.depth = text.lstrip("\ufeff"), scope, max_depth, 0
        self.tokens, self.at, self.lexed = [], 0, 0
        self.prefixes = dict(PREFIXES)
        self.known: dict[tuple[str, str], Node] = {}

    def _lex(self):
        """Drops the tokens that were taken and reads the next AHEAD, so a long text's are never all held."""
        out, at, end, match = self.tokens[self.at :], self.lexed, len(self.text), _TOKEN.match
        while at < end and len(out) < AHEAD:
            m = match(self.text, at)
            if not m:
                raise SyntaxProblem(f"unexpected character {self.text[at]!r} at {at}")
            if m.lastgroup:
                out.append((m.lastgroup, m[0], at))
            at = m.end()
        self.tokens, self.at, self.lexed = out, 0, at

    def peek(self, k: int = 0):
        if self.at + k >= len(self.tokens):
            self._lex()
            if k >= len(self.tokens):
                return "end", "", len(self.text)
        return self.tokens[self.at + k]

    def take(self, kind: str | None = None, value: str | None = None):
        t = self.peek()
        if (kind and t[0] != kind) or (value is not None and t[1] != value):
            raise SyntaxProblem(f"expected {value or kind} at {t[2]}, found {t[1]!r}")
        self.at += 1
        return t[1]

    def word(self, *names) -> bool:
        return self.peek()[0] == "name" and self.peek()[1] in names and self.peek(1)[0] == "open"

    def iri_text(self) -> str:
        kind, value, at = self.peek()
        if kind == "iri":
            self.at += 1
            return value[1:-1]
        if kind == "name" and ":" in value:
            self.at += 1
            prefix, _, local = value.partition(":")
            if prefix not in self.prefixes:
                raise SyntaxProblem(f"unknown prefix {prefix!r} at {at}")
            return self.prefixes[prefix] + local
        raise SyntaxProblem(f"expected an IRI at {at}, found {value!r}")

    def named(self, kind: str) -> Node:
        key = kind, self.iri_text()
        if (found := self.known.get(key)) is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[key] = entity(*key)
        return found

    def call(self, name: str, read):
        self.take("name", name)
        self.take("open")
        self.depth += 1
        if self.depth > self.max_depth:
            raise SyntaxProblem(f"nested deeper than {self.max_depth}")
        out = read()
        self.depth -= 1
        self.take("close")
        return out

    def many(self, read) -> list:
        out = []
        while self.peek()[0] not in ("close", "end"):
            out.append(read())
        return out

    # Terms, by letter of a shape

    def c(self):
        n = self.peek()[1]
        return self.call(n, lambda: self.build(n)) if n in _CLASS_WORDS and self.word(n) else self.named("class")

    def d(self):
        n = self.peek()[1]
        return self.call(n, lambda: self.build(n)) if n in _RANGE_WORDS and self.word(n) else self.named("datatype")

    def o(self):
        if self.word("ObjectInverseOf"):
            inner = self.call("ObjectInverseOf", self.o)
            return inner.values[0] if inner.name == "ObjectInverseOf" else make("ObjectInverseOf", inner)
        return self.named("object_property")

    def p(self):
        if self.word("ObjectPropertyChain"):
            return self.call("ObjectPropertyChain", lambda: make("ObjectPropertyChain", self.many(self.o)))
        return self.o()

    def q(self):
        return self.named("data_property")

    def a(self):
        return self.named("annotation_property")

    def t(self):
        return self.named("datatype")

    def k(self):
        return self.named("class")

    def u(self):
        return iri(self.iri_text())

    def n(self):
        value = self.take("name")
        if not value.isdigit():
            raise SyntaxProblem(f"expected a number, found {value!r}")
        return int(value)

    def i(self):
        if self.peek()[0] == "blank":
            return anonymous(self.scope, self.take()[2:])
        return self.named("named_individual")

    def s(self):
        return self.i() if self.peek()[0] == "blank" else self.u()

    def l(self):  # noqa: E743
        lexical = self.take("string")[1:-1]
        if "\\" in lexical:
            lexical = re.sub(r"\\(.)", r"\1", lexical, flags=re.S)
        if self.peek()[0] == "lang":
            return literal(lexical, lang=self.take()[1:])
        if self.peek()[0] == "caret":
            self.take()
            return literal(lexical, self.iri_text())
        return literal(lexical)

    def v(self):
        return self.l() if self.peek()[0] == "string" else self.s()

    def annotation(self) -> Node:
        def read():
            inner = self.annotation_list()
            return make("Annotation", self.a(), self.v(), inner)

        return self.call("Annotation", read)

    def annotation_list(self) -> list[Node]:
        out = []
        while self.word("Annotation"):
            out.append(self.annotation())
        return out

    def build(self, name: str, annotations=None) -> Node:
        values, shape = [], _SHAPES[name]
        for k, letter in enumerate(shape):
            if letter == "?":
                continue
            optional = shape[k + 1 : k + 2] == "?"
            if optional and self.peek()[0] == "close":
                values.append(entity("class", THING) if letter == "c" else entity("datatype", LITERAL))
            elif letter == "R":
                # Properties up to the last argument, which is the range.
                props = [self.q()]
                while self.peek(1)[0] not in ("close", "open") or (self.peek()[0] in ("iri", "name") and self.peek(1)[0] in ("iri", "name")):
                    props.append(self.q())
                values.append(props)
            elif letter == "F":
                values.append(self.many(lambda: make("FacetRestriction", self.u(), self.l())))
            elif letter == "(":
                for read in (self.o, self.q):
                    self.take("open")
                    values.append(self.many(read))
                    self.take("close")
            elif letter.isupper():
                values.append(self.many(getattr(self, letter.lower())))
            else:
                values.append(getattr(self, letter)())
        if annotations is None and BY_NAME[name].category in ("class_expression", "data_range"):
            return boolean(name, values[0]) if shape in ("C", "D") else make(name, *values)
        if name == "DisjointClasses" and len(values[0]) > 1 and len(set(values[0])) == 1:
            return make("SubClassOf", values[0][0], entity("class", NOTHING), annotations)
        return make(name, *values, annotations)

    def axiom(self) -> Node:
        n = self.peek()[1]
        if n not in _AXIOM_WORDS or not self.word(n):
            raise SyntaxProblem(f"expected an axiom at {self.peek()[2]}, found {self.peek()[1]!r}")

        def read():
            notes = self.annotation_list()
            if n != "Declaration":
                return self.build(n, notes)
            for word, kind in KINDS.items():
                if self.word(word):
                    return make("Declaration", self.call(word, lambda: self.named(kind)), notes)
            raise SyntaxProblem(f"expected an entity at {self.peek()[2]}")

        return self.call(n, read)

    def begin(self) -> Document:
        """What stands before the axioms; axioms() gives those."""
        while self.word("Prefix"):
            self.take()
            self.take("open")
            name = self.take("name") if self.peek()[0] == "name" else ""
            if self.peek()[0] == "eq" and self.peek()[1] == ":=":
                name += ":"
            self.take("eq")
            self.prefixes[name.rstrip(":")] = self.take("iri")[1:-1]
            self.take("close")
        out = Document(prefixes=self.prefixes)
        self.take("name", "Ontology")
        self.take("open")
        self.depth += 1
        if self.peek()[0] in ("iri",) or (self.peek()[0] == "name" and not self.peek(1)[0] == "open"):
            out.ontology_iri = self.iri_text()
            if self.peek()[0] == "iri" or (self.peek()[0] == "name" and not self.peek(1)[0] == "open"):
                out.version_iri = self.iri_text()
        while self.word("Import"):
            out.imports.append(self.call("Import", self.iri_text))
        out.annotations = self.annotation_list()
        return out

    def axioms(self):
        """Each axiom as it is read, to the document's end."""
        while self.peek()[0] not in ("close", "end"):
            yield self.axiom()
        self.depth -= 1
        self.take("close")
        if self.peek()[0] != "end":
            raise SyntaxProblem(f"text after the ontology at {self.peek()[2]}")

    def document(self) -> Document:
        out = self.begin()
        out.axioms = list(self.axioms())
        return out


@contextmanager
def deep(max_depth: int = 512):
    """Room for expressions that nest max_depth deep; a level takes four Python calls."""
    before = sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, 6 * max_depth + 1000))
    try:
        yield
    finally:
        sys.setrecursionlimit(before)


def parse(text: str, scope: bytes = bytes(32), max_depth: int = 512) -> Document:
    with deep(max_depth):
        return Reader(text, scope, max_depth).document()


_WORD_OF = {v: k for k, v in KINDS.items()}


def write_term(n) -> str:
    """Functional syntax of a node or number, with full IRIs."""
    if not isinstance(n, Node):
        return str(n)
    if n.name == "IRI":
        return f"<{n.values[0]}>"
    if n.name == "Entity":
        return f"<{n.values[1].values[0]}>"
    if n.name == "AnonymousIndividual":
        return f"_:{n.values[1].decode()}"
    if n.name == "Literal":
        lexical, datatype, lang = n.values
        quoted = '"' + lexical.replace("\\", "\\\\").replace('"', '\\"') + '"'
        return f"{quoted}@{lang}" if lang else quoted if datatype.values[1].values[0] == "http://www.w3.org/2001/XMLSchema#string" else f"{quoted}^^{write_term(datatype)}"
    if n.name == "FacetRestriction":
        return " ".join(map(write_term, n.values))
    spec, parts = BY_NAME[n.name], []
    if spec.fields[-1].name == "annotations":
        parts += [write_term(x) for x in n.values[-1]]
    for f, v in zip(spec.fields, n.values, strict=True):
        if f.name == "annotations":
            continue
        if n.name == "Declaration":
            parts.append(f"{_WORD_OF[v.values[0]]}({write_term(v)})")
        elif n.name == "HasKey" and f.kind == "set":
            parts.append("(" + " ".join(map(write_term, v)) + ")")
        elif f.kind != "one":
            parts += map(write_term, v)
        else:
            parts.append(write_term(v))
    return f"{n.name}({' '.join(parts)})"


def write(doc: Document) -> str:
    """A deterministic document: axioms in canonical order."""
    head = " ".join(f"<{x}>" for x in (doc.ontology_iri, doc.version_iri) if x)
    lines = [f"Import(<{x}>)" for x in sorted(set(doc.imports))]
    for part in (doc.annotations, doc.axioms):
        lines += [write_term(n) for n in sorted(set(part), key=lambda n: n.canonical)]
    return f"Ontology({head}\n" + "".join(f"  {x}\n" for x in lines) + ")\n"
