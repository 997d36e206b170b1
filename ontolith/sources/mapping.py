"""RDF graphs to structural documents: declared kinds decide, lists are walked, equivalences merge.

Each rule takes triples away; what no rule takes is left over and, in strict mode, an error.
"""

from __future__ import annotations

from collections import defaultdict

from .functional import PREFIXES, Document, SyntaxProblem
from .nodes import Node, anonymous, boolean, entity, iri, literal, make

OWL, RDF, RDFS, XSD = (PREFIXES[p] for p in ("owl", "rdf", "rdfs", "xsd"))
TYPE, NIL = RDF + "type", RDF + "nil"
# Types that declare an entity.
KIND_OF = {OWL + "Class": "class", RDFS + "Class": "class", RDFS + "Datatype": "datatype", OWL + "DataRange": "datatype", OWL + "ObjectProperty": "object_property", OWL + "DatatypeProperty": "data_property", OWL + "AnnotationProperty": "annotation_property", OWL + "OntologyProperty": "annotation_property", OWL + "NamedIndividual": "named_individual"}
CHARACTER = {OWL + "FunctionalProperty": ("FunctionalObjectProperty", "FunctionalDataProperty"), OWL + "InverseFunctionalProperty": ("InverseFunctionalObjectProperty",), OWL + "ReflexiveProperty": ("ReflexiveObjectProperty",), OWL + "IrreflexiveProperty": ("IrreflexiveObjectProperty",), OWL + "SymmetricProperty": ("SymmetricObjectProperty",), OWL + "AsymmetricProperty": ("AsymmetricObjectProperty",), OWL + "TransitiveProperty": ("TransitiveObjectProperty",)}
BUILTIN_ANNOTATIONS = {RDFS + n for n in ("label", "comment", "seeAlso", "isDefinedBy")} | {OWL + n for n in ("versionInfo", "deprecated", "priorVersion", "backwardCompatibleWith", "incompatibleWith")}
FACETS = {XSD + n for n in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "length", "minLength", "maxLength", "pattern", "totalDigits", "fractionDigits")} | {RDF + "langRange"}


class MappingIncomplete(SyntaxProblem):
    def __init__(self, left):
        super().__init__(f"{len(left)} triples fit no rule")
        self.left = left


class Mapper:
    def __init__(self, triples, scope: bytes = bytes(32)):
        self.scope = scope
        self.triples = list(dict.fromkeys(triples))
        self.used: set = set()
        self.by_s = defaultdict(list)
        self.kinds = defaultdict(set)
        for t in self.triples:
            self.by_s[t[0]].append(t)
        for name in BUILTIN_ANNOTATIONS:
            self.kinds[name].add("annotation_property")
        for name in (OWL + "Thing", OWL + "Nothing"):
            self.kinds[name].add("class")
        for s, p, o in self.triples:
            if p[1] == TYPE and s[0] == "iri":
                if o[1] in KIND_OF:
                    self.kinds[s[1]].add(KIND_OF[o[1]])
                elif o[1] in CHARACTER and len(CHARACTER[o[1]]) == 1:
                    self.kinds[s[1]].add("object_property")
        self.notes = self._reified()

    # Triples

    def all(self, s, p: str, use: bool = True):
        found = [t for t in self.by_s.get(s, ()) if t[1][1] == p]
        if use:
            self.used.update(found)
        return [t[2] for t in found]

    def one(self, s, p: str, needed: bool = False):
        found = self.all(s, p)
        if len(found) > 1:
            raise SyntaxProblem(f"{s[1]} has several values of {p}")
        if needed and not found:
            raise SyntaxProblem(f"{s[1]} lacks {p}")
        return found[0] if found else None

    def list(self, head):
        out, seen = [], set()
        while head[1] != NIL or head[0] != "iri":
            if head in seen:
                raise SyntaxProblem("a list leads back to itself")
            seen.add(head)
            out.append(self.one(head, RDF + "first", True))
            head = self.one(head, RDF + "rest", True)
        for cell in seen:
            self.used.update(t for t in self.by_s[cell] if t[1][1] == TYPE and t[2][1] == RDF + "List")
        return out

    def is_kind(self, term, kind: str) -> bool:
        return term[0] == "iri" and kind in self.kinds[term[1]]

    # Terms

    def value(self, t) -> Node:
        return literal(t[1], t[2], t[3]) if t[0] == "literal" else iri(t[1]) if t[0] == "iri" else anonymous(self.scope, t[1])

    def individual(self, t) -> Node:
        return entity("named_individual", t[1]) if t[0] == "iri" else anonymous(self.scope, t[1])

    def role(self, t) -> Node:
        if t[0] == "iri":
            return entity("object_property", t[1])
        inner = self.role(self.one(t, OWL + "inverseOf", True))
        return inner.values[0] if inner.name == "ObjectInverseOf" else make("ObjectInverseOf", inner)

    def data_range(self, t) -> Node:
        if t[0] == "iri":
            return entity("datatype", t[1])
        self.all(t, TYPE)
        for p, name in ((OWL + "intersectionOf", "DataIntersectionOf"), (OWL + "unionOf", "DataUnionOf")):
            if (head := self.one(t, p)) is not None:
                return boolean(name, map(self.data_range, self.list(head)))
        if (x := self.one(t, OWL + "datatypeComplementOf")) is not None:
            return make("DataComplementOf", self.data_range(x))
        if (head := self.one(t, OWL + "oneOf")) is not None:
            return make("DataOneOf", [self.value(x) for x in self.list(head)])
        if (x := self.one(t, OWL + "onDatatype")) is not None:
            facets = []
            for f in self.list(self.one(t, OWL + "withRestrictions", True)):
                for s in list(self.by_s[f]):
                    if s[1][1] in FACETS:
                        self.used.add(s)
                        facets.append(make("FacetRestriction", iri(s[1][1]), self.value(s[2])))
            return make("DatatypeRestriction", entity("datatype", x[1]), facets)
        raise SyntaxProblem(f"{t[1]} is no data range")

    def is_range(self, t) -> bool:
        if t[0] == "iri":
            return "datatype" in self.kinds[t[1]] or t[1].startswith(XSD) or t[1] in (RDFS + "Literal", RDF + "PlainLiteral")
        return any(x[1] == RDFS + "Datatype" or x[1] == OWL + "DataRange" for x in self.all(t, TYPE, False))

    def cls(self, t) -> Node:
        if t[0] == "iri":
            return entity("class", t[1])
        self.all(t, TYPE)
        for p, name in ((OWL + "intersectionOf", "ObjectIntersectionOf"), (OWL + "unionOf", "ObjectUnionOf")):
            if (head := self.one(t, p)) is not None:
                return boolean(name, map(self.cls, self.list(head)))
        if (x := self.one(t, OWL + "complementOf")) is not None:
            return make("ObjectComplementOf", self.cls(x))
        if (head := self.one(t, OWL + "oneOf")) is not None:
            return make("ObjectOneOf", [self.individual(x) for x in self.list(head)])
        return self.restriction(t)

    def restriction(self, t) -> Node:
        many = self.one(t, OWL + "onProperties")
        props = self.list(many) if many is not None else [self.one(t, OWL + "onProperty", True)]
        prop = props[0]
        data = many is not None or self.is_kind(prop, "data_property")
        p = entity("data_property", prop[1]) if data else self.role(prop)
        for key, word in (("someValuesFrom", "SomeValuesFrom"), ("allValuesFrom", "AllValuesFrom")):
            if (x := self.one(t, OWL + key)) is not None:
                if data or (self.is_range(x) and not self.is_kind(prop, "object_property")):
                    return make("Data" + word, [entity("data_property", y[1]) for y in props], self.data_range(x))
                return make("Object" + word, p, self.cls(x))
        if (x := self.one(t, OWL + "hasValue")) is not None:
            return make("DataHasValue", entity("data_property", prop[1]), self.value(x)) if x[0] == "literal" else make("ObjectHasValue", p, self.individual(x))
        if self.one(t, OWL + "hasSelf") is not None:
            return make("ObjectHasSelf", p)
        for key, word in (("min", "MinCardinality"), ("max", "MaxCardinality"), ("", "ExactCardinality")):
            for qualified in (True, False):
                name = f"{key}{'Q' if key else 'q'}ualifiedCardinality" if qualified else f"{key}{'C' if key else 'c'}ardinality"
                if (n := self.one(t, OWL + name)) is None:
                    continue
                c, d = self.one(t, OWL + "onClass"), self.one(t, OWL + "onDataRange")
                if d is not None or data:
                    return make("Data" + word, int(n[1]), entity("data_property", prop[1]), self.data_range(d) if d is not None else entity("datatype", RDFS + "Literal"))
                return make("Object" + word, int(n[1]), p, self.cls(c) if c is not None else entity("class", OWL + "Thing"))
        raise SyntaxProblem(f"{t[1]} is no class expression")

    # Annotations

    def annotations(self, node, skip=()) -> list[Node]:
        out = []
        for t in list(self.by_s.get(node, ())):
            if t[1][1] not in skip and self.is_kind(t[1], "annotation_property"):
                self.used.add(t)
                out.append(make("Annotation", entity("annotation_property", t[1][1]), self.value(t[2]), self.notes.get(t, ())))
        return out

    def _reified(self):
        """Annotations of triples; those of an annotation's own triple are taken before it."""
        self.notes, mains, inner = {}, {}, {}
        for s in list(self.by_s):
            types = {t[2][1] for t in self.by_s[s] if t[1][1] == TYPE}
            if types & {OWL + "Axiom", OWL + "Annotation"}:
                self.all(s, TYPE)
                main = (self.one(s, OWL + "annotatedSource", True), self.one(s, OWL + "annotatedProperty", True), self.one(s, OWL + "annotatedTarget", True))
                if main not in self.by_s.get(main[0], ()):
                    raise SyntaxProblem("an annotated triple is not there")
                mains[s] = main
                inner.setdefault(main[0], []).append(s)
        done = set()

        def take(s):
            if s not in done:
                done.add(s)
                for x in inner.get(s, ()):
                    take(x)
                self.notes.setdefault(mains[s], []).extend(self.annotations(s))

        for s in mains:
            take(s)
        return self.notes

    # Axioms

    def map(self, strict: bool = True) -> tuple[Document, list]:
        doc = Document()
        heads = [t for t in self.triples if t[1][1] == TYPE and t[2][1] == OWL + "Ontology"]
        if len(heads) > 1:
            raise SyntaxProblem("more than one ontology")
        if heads:
            self.used.add(heads[0])
            s = heads[0][0]
            doc.ontology_iri = s[1] if s[0] == "iri" else None
            version = self.one(s, OWL + "versionIRI")
            doc.version_iri = version and version[1]
            doc.imports = [x[1] for x in self.all(s, OWL + "imports")]
            doc.annotations = self.annotations(s)
        for t in self.triples:
            if t[1][1] == TYPE and t[0][0] == "iri" and t[2][1] in KIND_OF:
                self.used.add(t)
                doc.axioms.append(make("Declaration", entity(KIND_OF[t[2][1]], t[0][1]), self.notes.get(t, ())))
        self._special(doc)
        self._equivalences(doc)
        for t in self.triples:
            if t not in self.used and (axiom := self._simple(t)) is not None:
                self.used.add(t)
                doc.axioms.append(axiom)
        left = [t for t in self.triples if t not in self.used]
        if left and strict:
            raise MappingIncomplete(left)
        return doc, left

    def _special(self, doc):
        for s in list(self.by_s):
            types = {t[2][1] for t in self.by_s[s] if t[1][1] == TYPE}
            if OWL + "NegativePropertyAssertion" in types:
                self.all(s, TYPE)
                who, prop = self.one(s, OWL + "sourceIndividual", True), self.one(s, OWL + "assertionProperty", True)
                if (x := self.one(s, OWL + "targetValue")) is not None:
                    doc.axioms.append(make("NegativeDataPropertyAssertion", entity("data_property", prop[1]), self.individual(who), self.value(x), self.annotations(s)))
                else:
                    doc.axioms.append(make("NegativeObjectPropertyAssertion", self.role(prop), self.individual(who), self.individual(self.one(s, OWL + "targetIndividual", True)), self.annotations(s)))
            for name, key in (("AllDisjointClasses", "members"), ("AllDisjointProperties", "members"), ("AllDifferent", "members"), ("AllDifferent", "distinctMembers")):
                if OWL + name in types and (head := self.one(s, OWL + key)) is not None:
                    self.all(s, TYPE)
                    items = self.list(head)
                    if name == "AllDisjointClasses":
                        doc.axioms.append(make("DisjointClasses", [self.cls(x) for x in items], self.annotations(s)))
                    elif name == "AllDifferent":
                        doc.axioms.append(make("DifferentIndividuals", [self.individual(x) for x in items], self.annotations(s)))
                    elif all(self.is_kind(x, "data_property") for x in items):
                        doc.axioms.append(make("DisjointDataProperties", [entity("data_property", x[1]) for x in items], self.annotations(s)))
                    else:
                        doc.axioms.append(make("DisjointObjectProperties", [self.role(x) for x in items], self.annotations(s)))

    def _equivalences(self, doc):
        """All edges of one predicate between connected terms make one axiom."""
        for p, build in ((OWL + "equivalentClass", self._equal_class), (OWL + "equivalentProperty", self._equal_property), (OWL + "sameAs", lambda m, n: make("SameIndividual", [self.individual(x) for x in m], n))):
            top: dict = {}

            def root(x, top=top):
                top.setdefault(x, x)
                while top[x] != x:
                    x = top[x]
                return x

            edges = [t for t in self.triples if t[1][1] == p and t[2][0] != "literal" and not (p == OWL + "equivalentClass" and t[0][0] == "iri" and "datatype" in self.kinds[t[0][1]])]
            for s, _, o in edges:
                a, b = root(s), root(o)
                top[max(a, b, key=str)] = min(a, b, key=str)
            groups, notes = defaultdict(list), defaultdict(list)
            for x in top:
                groups[root(x)].append(x)
            for t in edges:
                self.used.add(t)
                notes[root(t[0])] += self.notes.get(t, [])
            for r, members in groups.items():
                if len(members) > 1:
                    doc.axioms.append(build(members, notes[r]))

    def _equal_class(self, members, notes):
        return make("EquivalentClasses", [self.cls(x) for x in members], notes)

    def _equal_property(self, members, notes):
        if any(self.is_kind(x, "data_property") for x in members):
            return make("EquivalentDataProperties", [entity("data_property", x[1]) for x in members], notes)
        return make("EquivalentObjectProperties", [self.role(x) for x in members], notes)

    def _simple(self, t):
        s, (_, p, _, _), o = t
        notes = self.notes.get(t, ())
        annotation, data = self.is_kind(s, "annotation_property"), self.is_kind(s, "data_property")
        if p == RDFS + "subClassOf":
            return make("SubClassOf", self.cls(s), self.cls(o), notes)
        if p == RDFS + "subPropertyOf":
            if annotation:
                return make("SubAnnotationPropertyOf", entity("annotation_property", s[1]), entity("annotation_property", o[1]), notes)
            if data:
                return make("SubDataPropertyOf", entity("data_property", s[1]), entity("data_property", o[1]), notes)
            return make("SubObjectPropertyOf", self.role(s), self.role(o), notes)
        if p == OWL + "propertyChainAxiom":
            return make("SubObjectPropertyOf", make("ObjectPropertyChain", [self.role(x) for x in self.list(o)]), self.role(s), notes)
        if p in (RDFS + "domain", RDFS + "range"):
            word = "Domain" if p.endswith("domain") else "Range"
            if annotation:
                return make(f"AnnotationProperty{word}", entity("annotation_property", s[1]), iri(o[1]), notes)
            if data:
                return make(f"DataProperty{word}", entity("data_property", s[1]), self.cls(o) if word == "Domain" else self.data_range(o), notes)
            return make(f"ObjectProperty{word}", self.role(s), self.cls(o), notes)
        if p == OWL + "disjointWith":
            return make("DisjointClasses", [self.cls(s), self.cls(o)], notes)
        if p == OWL + "propertyDisjointWith":
            return make("DisjointDataProperties", [entity("data_property", x[1]) for x in (s, o)], notes) if data else make("DisjointObjectProperties", [self.role(s), self.role(o)], notes)
        if p == OWL + "inverseOf" and s[0] == "iri":
            return make("InverseObjectProperties", self.role(s), self.role(o), notes)
        if p == OWL + "differentFrom":
            return make("DifferentIndividuals", [self.individual(s), self.individual(o)], notes)
        if p == OWL + "disjointUnionOf":
            return make("DisjointUnion", entity("class", s[1]), [self.cls(x) for x in self.list(o)], notes)
        if p == OWL + "equivalentClass":
            return make("DatatypeDefinition", entity("datatype", s[1]), self.data_range(o), notes)
        if p == OWL + "hasKey":
            items = self.list(o)
            is_data = [self.is_kind(x, "data_property") for x in items]
            return make("HasKey", self.cls(s), [self.role(x) for x, d in zip(items, is_data, strict=True) if not d], [entity("data_property", x[1]) for x, d in zip(items, is_data, strict=True) if d], notes)
        if s[0] == "iri" and p in (OWL + "intersectionOf", OWL + "unionOf", OWL + "oneOf", OWL + "complementOf"):
            made = {"intersectionOf": lambda: boolean("ObjectIntersectionOf", map(self.cls, self.list(o))), "unionOf": lambda: boolean("ObjectUnionOf", map(self.cls, self.list(o))), "oneOf": lambda: make("ObjectOneOf", [self.individual(x) for x in self.list(o)]), "complementOf": lambda: make("ObjectComplementOf", self.cls(o))}
            return make("EquivalentClasses", [entity("class", s[1]), made[p.removeprefix(OWL)]()], notes)
        if p == TYPE:
            if o[0] == "iri" and o[1] in CHARACTER:
                names = CHARACTER[o[1]]
                return make(names[1], entity("data_property", s[1]), notes) if len(names) > 1 and data else make(names[0], self.role(s), notes)
            if o[1] in (OWL + "DeprecatedClass", OWL + "DeprecatedProperty"):
                return make("AnnotationAssertion", entity("annotation_property", OWL + "deprecated"), iri(s[1]), literal("true", XSD + "boolean"), notes)
            if o[0] == "blank" or not o[1].startswith((OWL, RDF)) or o[1] in (OWL + "Thing", OWL + "Nothing"):
                return make("ClassAssertion", self.cls(o), self.individual(s), notes)
            return None
        kinds = self.kinds.get(p, ())
        if "annotation_property" in kinds:
            return make("AnnotationAssertion", entity("annotation_property", p), self.value(s), self.value(o), notes)
        if "data_property" in kinds and o[0] == "literal":
            return make("DataPropertyAssertion", entity("data_property", p), self.individual(s), self.value(o), notes)
        if "object_property" in kinds and o[0] != "literal":
            return make("ObjectPropertyAssertion", entity("object_property", p), self.individual(s), self.individual(o), notes)
        return None


def map_triples(triples, scope: bytes = bytes(32), strict: bool = True) -> tuple[Document, list]:
    """The document, and the triples that fit no rule."""
    return Mapper(triples, scope).map(strict)
