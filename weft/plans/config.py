"""From a configuration tree to an import plan.

A configuration holds ``import`` (user, mappings), ``dataset`` and lists of reference
kinds.  A map with an input file is a job, any other a literal entity; where it stands
in the tree says its kind and its parents.  The plan is made on the driver and holds
no data: every parent path and reference scope is a literal by the time rows are read.

Directive keys are matched by their local name, whatever namespace a file gives them.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from weft.functions.exprs import COMPOSITE_SEPARATOR, PATH_SEPARATOR
from weft.plans.schema import Kind, Schema
from weft.sources.configs import local
from weft.sources.edn import Glob, Keyword, Symbol

# The directives of a job.
DIRECTIVES = (
    "input-tsv-file", "input-csv-file", "na", "omit-if-na", "constants", "variable", "value", "variables", "reverse", "rev-variable", "rev-attr",
    "many-delimiter", "many-variable", "precomputed", "input-file", "format", "column-attribute", "indexed-by", "value-type",
)
_MATRIX = ("input-file", "format", "column-attribute", "indexed-by", "value-type")
STAGE_IMPORT, STAGE_REFERENCE, STAGE_LITERAL, STAGE_DATA, STAGE_REVERSE, STAGE_MATRIX = 0, 1, 2, 3, 4, 5


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Scope:
    """Where an entity stands: kinds and ids of its ancestors below the dataset."""

    kinds: tuple[str, ...] = ()
    ids: tuple[str, ...] = ()

    def path(self) -> str:
        return PATH_SEPARATOR.join(self.ids)


@dataclass(frozen=True)
class Matrix:
    sparse: bool
    indexed_by: Mapping[str, str]  # column -> attribute
    column_attribute: str | None
    value_type: str


@dataclass(frozen=True)
class Job:
    kind: str
    stage: int
    order: int
    inputs: tuple[str, ...]
    separator: str
    scope: Scope
    columns: Mapping[str, str] = field(default_factory=dict)
    tuples: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    many: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    constants: Mapping[str, object] = field(default_factory=dict)
    na: tuple[str, ...] = ()
    omit: tuple[str, ...] | str = ()
    variable: str | None = None
    value: str | None = None
    variables: Mapping[str, str] = field(default_factory=dict)
    reverse: tuple[str, str] | None = None  # column of the parent's id, and the parent's kind
    references: Mapping[str, str | None] = field(default_factory=dict)  # attribute -> path before its value
    matrix: Matrix | None = None

    def required(self) -> list[str]:
        """Columns that the files must have."""
        found = [*self.columns.values(), *[c for cs in self.tuples.values() for c in cs], *[c for c, _ in self.many.values()]]
        found += [c for c in (self.variable, self.value, self.reverse and self.reverse[0]) if c]
        return [*found, *(self.matrix.indexed_by if self.matrix else ())]


@dataclass(frozen=True)
class Literal:
    kind: str
    scope: Scope
    attributes: Mapping[str, object]
    path: str | None
    stage: int = STAGE_LITERAL


@dataclass(frozen=True)
class ImportPlan:
    dataset: str
    user: str | None
    mappings: str | None
    literals: tuple[Literal, ...]
    jobs: tuple[Job, ...]


def _value(x: object) -> object:
    return str(x) if isinstance(x, (Keyword, Symbol)) else x


def _is_job(node: Mapping) -> bool:
    return any(local(k) in ("input-tsv-file", "input-csv-file", "input-file") for k in node)


class _Planner:
    def __init__(self, schema: Schema, root: str, glob: Callable[[str, str], list[str]] | None) -> None:
        self.schema, self.root, self.glob = schema, root, glob
        self.literals: list[Literal] = []
        self.jobs: list[Job] = []

    # -- names ---------------------------------------------------------------------

    def attribute(self, kind: Kind, key: object) -> str:
        space, _, name = str(key).rpartition("/")
        if space and space != kind.name:
            raise ConfigError(f"{key}: an attribute of {space!r} among those of {kind.name!r}")
        if name not in kind.attributes:
            raise ConfigError(f"{kind.name!r} has no attribute {name!r}")
        return name

    def reference(self, kind: Kind, attribute: str, scope: Scope) -> str | None:
        """The path that stands before a reference's value: none for global ids and children of the dataset."""
        target = kind.attributes[attribute].ref_to
        if target is None:
            return None
        found = self.schema.kind(target)
        if found.scope != "context" or found.parent is None or self.schema.kind(found.parent).parent is None:
            return None
        if found.parent in scope.kinds:
            at = len(scope.kinds) - 1 - scope.kinds[::-1].index(found.parent)
            return PATH_SEPARATOR.join(scope.ids[: at + 1])
        raise ConfigError(f"{kind.name}/{attribute}: no {target!r} in sight of {'/'.join(scope.kinds) or 'the dataset'}")

    def paths(self, name: object) -> tuple[str, ...]:
        if isinstance(name, Glob):
            folder = name.folder if "://" in name.folder else os.path.join(self.root, name.folder)
            if self.glob is None:
                raise ConfigError("a glob needs a session to look for files")
            return tuple(self.glob(folder, name.pattern))
        return (str(name) if "://" in str(name) else os.path.join(self.root, str(name)),)

    # -- nodes ---------------------------------------------------------------------

    def node(self, node: object, kind: Kind, scope: Scope, stage: int) -> None:
        if isinstance(node, (list, tuple)):
            for inner in node:
                self.node(inner, kind, scope, stage)
        elif not isinstance(node, Mapping):
            raise ConfigError(f"{kind.name!r}: expected a map, not {node!r}")
        elif _is_job(node):
            self.jobs.append(self.job(node, kind, scope, stage))
        else:
            self.literal(node, kind, scope, stage)

    def literal(self, node: Mapping, kind: Kind, scope: Scope, stage: int) -> None:
        own, children = {}, []
        for key, value in node.items():
            nested = isinstance(value, Mapping) or (isinstance(value, (list, tuple)) and any(isinstance(v, Mapping) for v in value))
            child = self.schema.kind_at(kind.name, local(key)) if nested else None
            if child:
                children.append((self.schema.kind(child), value))
            elif nested:
                raise ConfigError(f"{kind.name!r} has no {local(key)!r} below it")
            else:
                own[self.attribute(kind, key)] = [_value(v) for v in value] if isinstance(value, (list, tuple)) else _value(value)
        ident = self.identity(kind, own)
        for name in [n for n in own if kind.attributes[n].ref_to]:
            before = self.reference(kind, name, scope)
            if before:
                own[name] = [f"{before}{PATH_SEPARATOR}{v}" for v in own[name]] if isinstance(own[name], list) else f"{before}{PATH_SEPARATOR}{own[name]}"
        below = scope if kind.parent is None else Scope((*scope.kinds, kind.name), (*scope.ids, ident)) if ident else scope
        path = below.path() if kind.scope == "context" and ident else None
        self.literals.append(Literal(kind.name, scope, own, path, stage))
        for child, value in children:
            self.node(value, child, below, STAGE_DATA if stage == STAGE_LITERAL else stage)

    @staticmethod
    def identity(kind: Kind, own: Mapping[str, object]) -> str | None:
        if kind.synthetic and kind.id not in own:
            parts = [str(own[p]) for p in kind.synthetic if p in own]
            if not parts:
                raise ConfigError(f"{kind.name!r} has none of {list(kind.synthetic)} to make its id of")
            return COMPOSITE_SEPARATOR.join(parts)
        if kind.id and kind.id not in own:
            raise ConfigError(f"a literal {kind.name!r} has no {kind.id!r}")
        return str(own[kind.id]) if kind.id else None

    def job(self, node: Mapping, kind: Kind, scope: Scope, stage: int) -> Job:
        spec: dict[str, object] = {}
        plain: dict[str, object] = {}
        for key, value in node.items():
            name = local(key)
            if name in DIRECTIVES and not (name in kind.attributes and str(key).rpartition("/")[0] in ("", kind.name)):
                spec[name] = value
            elif "/" in str(key) and str(key).rpartition("/")[0] != kind.name:
                raise ConfigError(f"unknown directive {key}")
            else:
                plain[self.attribute(kind, key)] = value
        given = [k for k in ("variable", "value", "variables") if k in spec]
        if given and len(given) != 3:
            raise ConfigError(f"{kind.name!r}: long rows need variable, value and variables, not {given} alone")
        matrix = "input-file" in spec
        columns, tuples, many = {}, {}, {}
        constants = {self.attribute(kind, k): _value(v) for k, v in (spec.get("constants") or {}).items()}
        for name, value in plain.items():
            if matrix or isinstance(value, (Keyword, bool, int, float)):
                constants[name] = _value(value)
            elif isinstance(value, Mapping):
                own = {local(k): v for k, v in value.items()}
                if set(own) != {"many-delimiter", "many-variable"}:
                    raise ConfigError(f"{kind.name}/{name}: many values need a delimiter and a column")
                many[name] = str(own["many-variable"]), str(own["many-delimiter"])
            elif isinstance(value, (list, tuple)):
                wanted = kind.attributes[name].tuple_of
                if wanted and len(wanted) != len(value):
                    raise ConfigError(f"{kind.name}/{name}: {len(value)} columns for a tuple of {len(wanted)}")
                tuples[name] = tuple(map(str, value))
            else:
                columns[name] = str(value)
        omit = spec.get("omit-if-na", ())
        omit = [str(o) for o in omit] if isinstance(omit, (list, tuple)) else [str(omit)]
        na = spec.get("na", ())
        reverse = None
        if "reverse" in spec:
            own = {local(k): v for k, v in spec["reverse"].items()}
            parent = str(own["rev-attr"]).rpartition("/")[0]
            reverse = str(own["rev-variable"]), self.schema.kind(parent).name
        variables = {str(k): self.attribute(kind, v) for k, v in (spec.get("variables") or {}).items()}
        used = {*columns, *tuples, *many, *constants, *variables.values()}
        details = None
        if matrix:
            index = {str(k): self.attribute(kind, v) for k, v in (spec.get("indexed-by") or {}).items()}
            details = Matrix(local(str(spec.get("format", "dense"))).endswith("sparse"), index, self.attribute(kind, spec["column-attribute"]) if "column-attribute" in spec else None, local(spec.get("value-type", "double")))
            if details.sparse == bool(details.column_attribute):
                raise ConfigError(f"{kind.name!r}: a dense matrix, and only that, has a column attribute")
            used |= {*index.values(), *([details.column_attribute] if details.column_attribute else [])}
        return Job(
            kind.name, STAGE_MATRIX if matrix else STAGE_REVERSE if reverse else stage, len(self.jobs),
            self.paths(spec.get("input-file", spec.get("input-tsv-file", spec.get("input-csv-file")))), "," if "input-csv-file" in spec else "\t", scope,
            columns, tuples, many, constants, tuple(str(v) for v in (na if isinstance(na, (list, tuple, set, frozenset)) else [na])),
            "*" if "*" in omit else tuple(o.rpartition("/")[2] for o in omit), str(spec["variable"]) if given else None, str(spec["value"]) if given else None, variables, reverse,
            {a: self.reference(kind, a, scope) for a in sorted(used) if kind.attributes[a].ref_to}, details,
        )


def plan(config: Mapping, schema: Schema, root: str = ".", glob: Callable[[str, str], list[str]] | None = None) -> ImportPlan:
    """Check a configuration and plan its import; ``glob`` finds files by folder and pattern."""
    top = {local(k): v for k, v in config.items()}
    missing = {"import", "dataset"} - set(top)
    if missing:
        raise ConfigError(f"a configuration needs {sorted(missing)}")
    about = {local(k): v for k, v in top.pop("import").items()}
    dataset = top.pop("dataset")
    planner = _Planner(schema, root, glob)
    reference = {}
    for key, value in top.items():
        kind = schema.singular(key)
        if kind is None or not schema.kinds[kind].reference_data:
            raise ConfigError(f"{key!r} is no reference kind")
        reference[kind] = value
    for name in schema.reference_order():
        if name in reference:
            planner.node(reference[name], schema.kind(name), Scope(), STAGE_REFERENCE)
    planner.node(dataset, schema.kind("dataset"), Scope(), STAGE_LITERAL)
    found = next(x for x in planner.literals if x.kind == "dataset")
    name = str(found.attributes[schema.kind("dataset").id])
    for literal in planner.literals:
        if literal.path == name:
            raise ConfigError(f"{literal.kind!r} has the dataset's own name")
    jobs = sorted(planner.jobs, key=lambda j: (j.stage, j.order))
    return ImportPlan(name, about.get("user"), about.get("mappings"), tuple(planner.literals), tuple(jobs))
