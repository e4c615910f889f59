"""Schemas: kinds, their attributes and references; compiled from a short form or read from documents.

The short form (DSL) is a map of kinds::

    {"patient": {"id": {"type": "string", "attribute": "id", "scope": "context"}, "parent": "dataset",
                 "attributes": [["sex", {"enum-of": ["male", "female"]}, "cardinality-one", "doc"], ...]}}

``scope`` is ``context`` (unique inside the parent), ``global`` (unique everywhere) or
``none``.  Beyond types, the short form also takes ``reference-data``,
``create-on-import`` and ``synthetic-id`` (the attributes it is made of).
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property
from graphlib import TopologicalSorter

from pyspark.sql import types as T

from weft.sources.edn import Keyword

# The types that attributes have.
SIMPLE_TYPES = ("string", "keyword", "boolean", "long", "bigint", "float", "double", "bigdec", "ref", "instant", "uuid", "uri", "symbol", "bytes")
_SPARK = {
    "long": T.LongType(), "int": T.LongType(), "float": T.DoubleType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "instant": T.TimestampNTZType(),
    "bigdec": T.DecimalType(38, 18), "bigint": T.DecimalType(38, 0), "bytes": T.BinaryType(),
}
ONE, MANY = "one", "many"


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Attribute:
    kind: str
    name: str
    type: str = "string"
    many: bool = False
    ref_to: str | None = None
    enum: tuple[str, ...] = ()
    tuple_of: tuple[str, ...] = ()
    unique: bool = False
    doc: str = ""

    @property
    def ident(self) -> str:
        return f"{self.kind}/{self.name}"

    @property
    def spark_type(self) -> T.DataType:
        base: T.DataType = _SPARK.get(self.type, T.StringType())
        if self.tuple_of:
            base = T.StructType([T.StructField(f"_{i}", _SPARK.get(t, T.StringType())) for i, t in enumerate(self.tuple_of, 1)])
        return T.ArrayType(base) if self.many else base


@dataclass(frozen=True)
class Kind:
    name: str
    id: str | None = None
    scope: str = "none"
    parent: str | None = None
    reference_data: bool = False
    create_on_import: bool = False
    synthetic: tuple[str, ...] = ()
    attributes: Mapping[str, Attribute] = field(default_factory=dict)

    @property
    def needs_uid(self) -> bool:
        return self.scope == "context"


@dataclass(frozen=True)
class Schema:
    kinds: Mapping[str, Kind]
    version: str = "1.0.0"

    def kind(self, name: str) -> Kind:
        if name not in self.kinds:
            raise SchemaError(f"no kind {name!r}")
        return self.kinds[name]

    @cached_property
    def attributes(self) -> dict[str, Attribute]:
        return {a.ident: a for k in self.kinds.values() for a in k.attributes.values()}

    @cached_property
    def enums(self) -> set[str]:
        return {v for a in self.attributes.values() for v in a.enum}

    @cached_property
    def children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for k in self.kinds.values():
            if k.parent:
                out.setdefault(k.parent, []).append(k.name)
        return out

    def family(self, kind: str) -> list[str]:
        """A kind and its ancestors, up to the root."""
        out = [kind]
        while (parent := self.kind(out[-1]).parent) is not None:
            if parent in out:
                raise SchemaError(f"{kind!r} is its own ancestor")
            out.append(parent)
        return out

    def kind_at(self, start: str | None, attribute: str) -> str | None:
        """The kind that an attribute of a kind leads to; at the top the attribute names the kind itself."""
        if start is None:
            return self.singular(attribute)
        found = self.kind(start).attributes.get(attribute)
        if found and found.ref_to:
            return found.ref_to
        guess = self.singular(attribute)
        return guess if guess and start in self.family(guess)[1:] else None

    def singular(self, name: str) -> str | None:
        """A kind by its name or its plural."""
        for guess in (name, name[:-1] if name.endswith("s") else name, name[:-3] + "y" if name.endswith("ies") else name):
            if guess in self.kinds:
                return guess
        return None

    def reference_order(self) -> list[str]:
        """Reference kinds, each after those it refers to; references to itself don't count."""
        refs = {k.name for k in self.kinds.values() if k.reference_data}
        graph = {k: {a.ref_to for a in self.kinds[k].attributes.values() if a.ref_to in refs and a.ref_to != k} for k in sorted(refs)}
        return list(TopologicalSorter(graph).static_order())

    def table(self, kind: str) -> T.StructType:
        return T.StructType([T.StructField(a.name, a.spark_type) for a in self.kind(kind).attributes.values()])


def _text(x: object) -> str:
    return str(x).lstrip(":")


def _typed(kind: str, spec: object) -> dict[str, object]:
    if isinstance(spec, Mapping):
        if len(spec) != 1:
            raise SchemaError(f"{kind}: a type has one key, not {sorted(map(str, spec))}")
        (key, value), *_ = spec.items()
        if _text(key) == "ref-to":
            return {"type": "ref", "ref_to": _text(value)}
        if _text(key) == "enum-of":
            return {"type": "ref", "enum": tuple(_text(v) for v in value)}
        if _text(key) == "tuple-of":
            return {"type": "tuple", "tuple_of": tuple(_text(v) for v in value)}
        raise SchemaError(f"{kind}: unknown type {key}")
    if _text(spec) not in SIMPLE_TYPES:
        raise SchemaError(f"{kind}: unknown type {spec}")
    return {"type": _text(spec)}


def compile_dsl(document: Mapping) -> Schema:
    """A schema from the short form; what is wrong with it is said before anything is made."""
    kinds: dict[str, Kind] = {}
    for raw, body in document.items():
        name, body = _text(raw), {_text(k): v for k, v in body.items()}
        unknown = set(body) - {"id", "parent", "attributes", "reference-data", "create-on-import", "synthetic-id", "doc"}
        if unknown:
            raise SchemaError(f"{name}: unknown keys {sorted(unknown)}")
        attributes: dict[str, Attribute] = {}
        ident, scope = None, "none"
        if "id" in body:
            own = {_text(k): v for k, v in body["id"].items()}
            ident, scope = _text(own["attribute"]), _text(own.get("scope", "none"))
            if scope not in ("context", "global", "none"):
                raise SchemaError(f"{name}: unknown scope {scope}")
            attributes[ident] = Attribute(name, ident, unique=scope == "global", doc=str(own.get("doc", "")), **_typed(name, own.get("type", "string")))
        for spec in body.get("attributes", []):
            if len(spec) < 3:
                raise SchemaError(f"{name}: an attribute has a name, a type and a cardinality: {spec}")
            attribute, kind, cardinality, *doc = spec
            short = _text(attribute)
            if _text(cardinality) not in ("cardinality-one", "cardinality-many"):
                raise SchemaError(f"{name}/{short}: unknown cardinality {cardinality}")
            typed = _typed(f"{name}/{short}", kind)
            if "enum" in typed:
                typed["enum"] = tuple(v if "/" in v else f"{name}.{short}/{v}" for v in typed["enum"])
            attributes[short] = Attribute(name, short, many=_text(cardinality).endswith("many"), doc=str(doc[0]) if doc else "", **typed)
        parent = _text(body["parent"]) if body.get("parent") else None
        kinds[name] = Kind(name, ident, scope, parent, bool(body.get("reference-data")), bool(body.get("create-on-import")), tuple(map(_text, body.get("synthetic-id", ()))), attributes)
    for kind in kinds.values():
        if kind.parent and kind.parent not in kinds:
            raise SchemaError(f"{kind.name}: no parent kind {kind.parent}")
        for a in kind.attributes.values():
            if a.ref_to and a.ref_to not in kinds:
                raise SchemaError(f"{a.ident} refers to no kind {a.ref_to}")
        for part in kind.synthetic:
            if part not in kind.attributes:
                raise SchemaError(f"{kind.name}: no attribute {part} for its id")
    return Schema(kinds)


def infer_dsl(schema: Schema) -> dict[str, dict]:
    """The short form of a schema; compiling it gives the schema back."""
    out: dict[str, dict] = {}
    for kind in schema.kinds.values():
        body: dict[str, object] = {}
        if kind.id:
            own = kind.attributes[kind.id]
            body["id"] = {"type": own.type, "attribute": kind.id, "scope": kind.scope, **({"doc": own.doc} if own.doc else {})}
        if kind.parent:
            body["parent"] = kind.parent
        for flag, name in ((kind.reference_data, "reference-data"), (kind.create_on_import, "create-on-import")):
            if flag:
                body[name] = True
        if kind.synthetic:
            body["synthetic-id"] = list(kind.synthetic)
        rest = [a for a in kind.attributes.values() if a.name != kind.id]
        if rest:
            body["attributes"] = [
                [a.name, {"ref-to": a.ref_to} if a.ref_to else {"enum-of": list(a.enum)} if a.enum else {"tuple-of": list(a.tuple_of)} if a.tuple_of else a.type, f"cardinality-{MANY if a.many else ONE}", *([a.doc] if a.doc else [])]
                for a in rest
            ]
        out[kind.name] = body
    return out


def metaschema(schema: Schema) -> dict[str, dict]:
    """The relational view: a table for each kind with its key, and the joins that references make."""
    tables = {k.name: {"key": "uid" if k.needs_uid else k.id, "columns": sorted(k.attributes)} for k in schema.kinds.values()}
    joins = {a.ident: a.ref_to for a in schema.attributes.values() if a.ref_to}
    return {"tables": tables, "joins": joins}


def json_schema(schema: Schema, root: str = "dataset") -> dict:
    """JSON Schema of an import configuration under ``root`` and the reference kinds beside it."""
    scalar = {"long": "integer", "bigint": "integer", "float": "number", "double": "number", "bigdec": "number", "boolean": "boolean"}

    def value(a: Attribute) -> dict:
        base: dict = {"type": "array"} if a.tuple_of else {"enum": list(a.enum)} if a.enum else {"type": scalar.get(a.type, "string")}
        either = {"anyOf": [base, {"type": "string"}]} if base.get("type") != "string" else base  # or a column's name
        return {"anyOf": [either, {"type": "array", "items": either}]} if a.many else either

    def definition(kind: Kind) -> dict:
        properties = {a.name: value(a) for a in kind.attributes.values()}
        for child in schema.children.get(kind.name, []):
            properties[f"{child}s"] = {"type": "array", "items": {"$ref": f"#/definitions/{child}"}}
        return {"type": "object", "properties": properties}

    definitions = {k.name: definition(k) for k in schema.kinds.values()}
    top = {root: {"$ref": f"#/definitions/{root}"}, "import": {"type": "object"}}
    top |= {f"{k}s": {"type": "array", "items": {"$ref": f"#/definitions/{k}"}} for k in schema.reference_order()}
    return {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "properties": top, "required": [root], "definitions": definitions}


def from_documents(attributes: Iterable[Mapping], enums: Iterable[Mapping], metamodel: Iterable[Iterable[Mapping]]) -> Schema:
    """A schema from installed documents: attribute definitions, enum idents, and lists of kinds and references.

    Keys are matched by the part after the slash, so the documents' namespaces don't matter.
    """

    def short(entry: Mapping) -> dict[str, object]:
        return {str(k).rpartition("/")[2]: v for k, v in entry.items()}

    defined, version = {}, "1.0.0"
    for entry in map(short, attributes):
        if "ident" in entry:
            if "version" in entry:
                version = str(entry["version"])
            if "valueType" in entry:
                defined[_text(entry["ident"])] = entry
    values = [_text(short(e)["ident"]) if isinstance(e, Mapping) else _text(e) for e in enums]
    kind_rows, ref_rows = [], []
    for group in metamodel:
        for entry in map(short, group):
            (ref_rows if "from" in entry else kind_rows if "name" in entry else []).append(entry)
    refs = {_text(r["id"]): r for r in ref_rows}
    by_attribute: dict[str, list[str]] = {}
    for v in values:
        space = v.rpartition("/")[0]
        by_attribute.setdefault("/".join(space.rsplit(".", 1)) if "." in space else space, []).append(v)
    kinds: dict[str, Kind] = {}
    for row in kind_rows:
        name = _text(row["name"])
        own: dict[str, Attribute] = {}
        for ident, entry in defined.items():
            space, _, attribute = ident.rpartition("/")
            if space != name:
                continue
            ref = refs.get(ident)
            kind = _text(entry["valueType"]).rpartition("/")[2]
            elements = tuple(_text(t).rpartition("/")[2] for t in entry.get("tupleTypes", ()))
            if ref and ref.get("tuple-types"):
                elements = tuple(_text(t) for t in ref["tuple-types"])
            if kind == "tuple" and not elements:
                elements = (_text(entry.get("tupleType", "string")).rpartition("/")[2],) * 2
            own[attribute] = Attribute(
                name, attribute, kind, _text(entry.get("cardinality", "one")).endswith("many"), _text(ref["to"]) if ref and "to" in ref else None, tuple(by_attribute.get(ident, ())),
                elements, "unique" in entry, str(entry.get("doc", "")),
            )
        parts = sorted((short(p) for p in row.get("synthetic-composite-components", ())), key=lambda p: p["index"])
        ident = row.get("context-id") or row.get("global-id")
        kinds[name] = Kind(
            name, _text(ident).rpartition("/")[2] if ident else None, "context" if "context-id" in row else "global" if "global-id" in row else "none", _text(row["parent"]) if row.get("parent") else None,
            bool(row.get("ref-data")), bool(row.get("create-on-import") or row.get("allow-create-on-import")), tuple(_text(p["attribute"]).rpartition("/")[2] for p in parts), own,
        )
    return Schema(kinds, version)


def to_documents(schema: Schema, namespace: str = "schema") -> tuple[list[dict], list, list[list[dict]]]:
    """A schema as documents of attributes, enums and metamodel, which ``from_documents`` reads back."""
    k = Keyword
    attributes: list[dict] = [{k(f"{namespace}/ident"): k(f"{namespace}/version"), k(f"{namespace}/version"): schema.version}]
    refs = []
    for a in schema.attributes.values():
        entry: dict = {k("db/ident"): k(a.ident), k("db/valueType"): k(f"db.type/{'ref' if a.enum or a.ref_to else a.type}"), k("db/cardinality"): k(f"db.cardinality/{MANY if a.many else ONE}")}
        if a.unique:
            entry[k("db/unique")] = k("db.unique/identity")
        if a.doc:
            entry[k("db/doc")] = a.doc
        attributes.append(entry)
        if a.ref_to or a.tuple_of:
            ref = {k("ref/id"): k(a.ident), k("ref/from"): k(a.kind)}
            if a.ref_to:
                ref[k("ref/to")] = k(a.ref_to)
            if a.tuple_of:
                ref[k("ref/tuple-types")] = [k(t) for t in a.tuple_of]
            refs.append(ref)
    kinds = []
    for kind in schema.kinds.values():
        row: dict = {k("kind/name"): k(kind.name)}
        if kind.id and kind.scope in ("context", "global"):
            row[k(f"kind/{kind.scope}-id")] = k(f"{kind.name}/{kind.id}")
        if kind.parent:
            row[k("kind/parent")] = k(kind.parent)
        if kind.reference_data:
            row[k("kind/ref-data")] = True
        if kind.create_on_import:
            row[k("kind/create-on-import")] = True
        if kind.synthetic:
            row[k("kind/synthetic-composite-components")] = [{k("kind/index"): i, k("kind/attribute"): k(f"{kind.name}/{p}")} for i, p in enumerate(kind.synthetic)]
        kinds.append(row)
    return attributes, [{k("db/ident"): k(v)} for a in schema.attributes.values() for v in a.enum], [kinds, refs]


def compatible(installed: str, wanted: str) -> str:
    """``same``, ``upgrade`` (another revision of one major and minor version) or an error."""
    a, b = (tuple(int(p) for p in v.split(".")) for v in (installed, wanted))
    if a == b:
        return "same"
    if a[:2] == b[:2]:
        return "upgrade"
    raise SchemaError(f"schema {wanted} can't be used where {installed} is installed")


def save(schema: Schema, path: str) -> None:
    with open(path, "w", encoding="utf-8") as file:
        json.dump({"version": schema.version, "kinds": infer_dsl(schema)}, file, indent=1, sort_keys=True)


def load(path: str) -> Schema:
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    return Schema(compile_dsl(found["kinds"]).kinds, found["version"])
